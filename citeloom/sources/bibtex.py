"""BibTeX text to entries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY = "struct<key: string, entry_type: string, fields: map<string,string>>"


class _Reader:
    """A cursor over BibTeX text."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def skip(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def word(self, stops: str) -> str:
        start = self.at
        while self.at < len(self.text) and self.text[self.at] not in stops:
            self.at += 1
        return self.text[start : self.at].strip()

    def braced(self, closing: str) -> str:
        """Text up to ``closing`` at brace depth 0; inner braces stay."""
        start, depth = self.at, 0
        while self.at < len(self.text):
            ch = self.text[self.at]
            if ch == "\\":
                self.at += 2
                continue
            if depth == 0 and ch == closing:
                out = self.text[start : self.at]
                self.at += 1
                return out
            depth += (ch == "{") - (ch == "}")
            self.at += 1
        raise ValueError("a value does not end")

    def value(self, strings: dict[str, str]) -> str:
        """Braced, quoted or bare parts, joined where ``#`` stands between them."""
        parts: list[str] = []
        while True:
            self.skip()
            if self.peek() == "{":
                self.at += 1
                parts.append(self.braced("}"))
            elif self.peek() == '"':
                self.at += 1
                parts.append(self.braced('"'))
            else:
                bare = self.word(",}#")
                parts.append(strings.get(bare.lower(), bare))
            self.skip()
            if self.peek() != "#":
                return "".join(parts)
            self.at += 1


def parse_entry(text: str | None) -> tuple[str, str, dict[str, str]] | None:
    """(key, type, fields) of the first entry, None if there is none that can be read.

    The text must start with ``@``. Field names and types are lower case; ``@comment`` and ``@preamble`` are passed
    over, ``@string`` names are put in where they are used bare; a repeated field keeps its last value.
    """
    if text is None or not text.lstrip().startswith("@") or "{" not in text:
        return None
    r, strings = _Reader(text), {}
    try:
        while (start := text.find("@", r.at)) >= 0:
            r.at = start + 1
            kind = r.word("{(").lower()
            if not r.peek():
                return None
            r.at += 1
            if kind in ("comment", "preamble"):
                r.braced("}")
                continue
            if kind == "string":
                name = r.word("=").lower()
                r.at += 1
                strings[name] = r.value(strings)
                r.word("}")
                r.at += 1
                continue
            key = r.word(",}")
            fields: dict[str, str] = {}
            while r.peek() == ",":
                r.at += 1
                r.skip()
                if r.peek() in ("}", ""):
                    break
                name = r.word("=,}").lower()
                if r.peek() != "=":
                    return None
                r.at += 1
                fields[name] = r.value(strings)
                r.skip()
            if r.peek() not in ("}", ")") or not key:
                return None
            return key, kind, fields
    except ValueError:
        return None
    return None


def parse_bibtex(df: DataFrame, column: str) -> DataFrame:
    """Adds ``entry`` (struct key, entry_type, fields), NULL where the text holds no entry."""

    @F.pandas_udf(ENTRY)
    def read(texts: pd.Series) -> pd.DataFrame:
        rows = [parse_entry(t) for t in texts]
        return pd.DataFrame(
            {
                "key": [r and r[0] for r in rows],
                "entry_type": [r and r[1] for r in rows],
                "fields": [r and r[2] for r in rows],
            }
        )

    entry = read(F.col(column))
    return df.withColumn("_e", entry).withColumn("entry", F.when(F.col("_e.key").isNotNull(), F.col("_e"))).drop("_e")


def looks_like_bibtex(column: str) -> Column:
    """True for a response that can be an entry: it has ``@``, ``author`` and ``title``."""
    c = F.col(column)
    return c.contains("@") & c.contains("author") & c.contains("title")

