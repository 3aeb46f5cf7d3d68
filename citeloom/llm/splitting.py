"""Problem 3: cutting oversized texts at natural boundaries.

Method: agglomerative merging. A text starts as atomic segments (sentences and lines; words, then runs of characters,
where a sentence alone is too long). Adjacent pairs wait in a heap by the strength of the boundary between them; the
weakest boundary is removed first, as long as the merged piece and its overlap fit the limit. Texts within the limit
never leave the JVM.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.arrow import map_with_ids

LIMIT = 4000
OVERLAP = 200
#: Boundary strengths, weakest first.
INSIDE_WORD, WORD, SENTENCE, LINE, PARAGRAPH, HEADING = range(6)
BOUNDARY_NAMES = ("word part", "word", "sentence", "line", "paragraph", "heading", "end")
END = 6

_HEAD = regex.compile(r"\\(?:section|subsection|subsubsection|paragraph|begin)\b")
_BREAK = regex.compile(r"(?:\r\n|\r|\n)\s*|[.!?][)\]'\"}]*\s+|[。！？]\s*")
# Abbreviations (and initials) whose full stop ends no sentence.
_SHORT_FORM = regex.compile(
    r"(?<![^\s(\[{~])(?:et al|[Ff]igs?|[Ee]qs?|[Ss]ecs?|[Rr]efs?|[Tt]abs?|[Tt]hm|[Cc]h|cf|[Ee]\.g|[Ii]\.e|vs|resp|[Nn]o|approx|Drs?|Profs?|[A-Z])$"
)
_WORD_END = regex.compile(r"\s+")
_RUN = regex.compile(r"\S+")
_LINES = regex.compile(r"\r\n|\r|\n")


def _atoms(text: str, room: int) -> tuple[list[int], list[int]]:
    """End offsets of the atomic segments, and the strength of the boundary at each end but the last."""
    ends: list[int] = []
    strengths: list[int] = []

    def add(end: int, strength: int) -> None:
        """Close a segment at ``end``; one over ``room`` is taken apart at words, then by force."""
        start = ends[-1] if ends else 0
        if end <= start:
            return
        if end - start > room:
            for m in _WORD_END.finditer(text, start, end):
                if m.end() < end:
                    _force(m.end(), WORD)
            _force(end, strength)
        else:
            ends.append(end)
            strengths.append(strength)

    def _force(end: int, strength: int) -> None:
        at = ends[-1] if ends else 0
        while end - at > room:
            at += room
            ends.append(at)
            strengths.append(INSIDE_WORD)
        if end > at:
            ends.append(end)
            strengths.append(strength)

    for m in _BREAK.finditer(text):
        gap = m.group()
        if gap[0] == "." and "\n" not in gap and "\r" not in gap and _SHORT_FORM.search(text, max(0, m.start() - 8), m.start()):
            continue
        lines = len(_LINES.findall(gap))
        if lines and _HEAD.match(text, m.end()):
            strength = HEADING
        else:
            strength = PARAGRAPH if lines > 1 else LINE if lines else SENTENCE
        add(m.end(), strength)
    add(len(text), END)
    return ends, strengths


def _merge(ends: list[int], strengths: list[int], limit: int, room: int) -> list[int]:
    """Indexes of the segments that still end a piece once no adjacent pair fits any more."""
    n = len(ends)
    start = [0, *ends[:-1]]
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(strengths[i], ends[i + 1] - start[i], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or after[i] != j or ends[j] - start[i] != size:
            continue  # one side has grown since: the pair was pushed again with its new size
        if size > (limit if start[i] == 0 else room):
            continue  # pieces only grow, so this boundary stays for good
        alive[i] = False
        start[j] = start[i]
        before[j] = before[i]
        if before[j] >= 0:
            after[before[j]] = j
            p = before[j]
            heapq.heappush(heap, (strengths[p], ends[j] - start[p], p, j))
        if after[j] < n:
            k = after[j]
            heapq.heappush(heap, (strengths[j], ends[k] - start[j], j, k))
    return [i for i in range(n) if alive[i]]


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, boundary) of the pieces of ``text`` in code points.

    Every piece is at most ``limit`` long. Pieces tile the text but for the overlap: each after the first starts
    ``overlap`` characters before the end of the one before. A text within the limit is one piece, ``""`` too.
    """
    if overlap < 0 or overlap >= limit:
        raise ValueError("0 <= overlap < limit is required")
    if len(text) <= limit:
        return [(0, len(text), BOUNDARY_NAMES[END])]
    room = limit - overlap
    ends, strengths = _atoms(text, room)
    out: list[tuple[int, int, str]] = []
    for i in _merge(ends, strengths, limit, room):
        start = max(0, out[-1][1] - overlap) if out else 0
        out.append((start, ends[i], BOUNDARY_NAMES[strengths[i]]))
    return out


def longest_run(text: str) -> int:
    """Length of the longest stretch without white space."""
    return max((m.end() - m.start() for m in _RUN.finditer(text)), default=0)


def pieces(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every row: id, ``piece``, ``n_pieces``, ``start``, ``size``, ``boundary``, ``cut``, ``text``.

    ``boundary`` says where the piece itself ends (``word part`` if inside a word). ``cut`` is of the whole text: ``forced`` where it has
    more than ``limit`` characters in a row without white space, else ``clean``; a clean text may still have a piece that ends inside a
    word, namely one between ``limit - overlap`` and ``limit`` characters long. NULL texts give no piece, empty ones one empty piece, NULL ids stay NULL. Only texts over the limit go to Python.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.col("_text").isNotNull())
    small = rows.filter(F.char_length("_text") <= limit).select(
        "_id",
        F.lit(0).alias("piece"),
        F.lit(1).alias("n_pieces"),
        F.lit(0).alias("start"),
        F.char_length("_text").alias("size"),
        F.lit(BOUNDARY_NAMES[END]).alias("boundary"),
        F.lit("clean").alias("cut"),
        F.col("_text").alias("text"),
    )
    large = rows.filter(F.char_length("_text") > limit)
    names = small.columns

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for key, text in zip(pdf["_id"], pdf["_text"]):
                found = split_text(text, limit, overlap)
                kind = "forced" if longest_run(text) > limit else "clean"
                out.extend(
                    (key, i, len(found), a, b - a, boundary, kind, text[a:b])
                    for i, (a, b, boundary) in enumerate(found)
                )
            yield pd.DataFrame(out, columns=names)

    kind = large.schema["_id"].dataType.simpleString()
    schema = "piece int, n_pieces int, start int, size int, boundary string, cut string, text string"
    found = map_with_ids(large, {"_id": kind}, ("_text",), cut, schema)
    return small.unionByName(found).withColumnRenamed("_id", id_col)
