"""Problem 8: passages of evaluation items inside documents.

Method: Wu-Manber multi-pattern search over words. The patterns are all runs of ``SEED`` words of the items. A shift
table over blocks of two words tells how far the window may jump; where the shift is zero, the bucket of the block's
patterns is compared directly. A hit is then extended along its diagonal, allowing single replaced words at least
``APART`` words apart; any qualifying passage of 20 words contains an unbroken run of 9, so no passage is missed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.arrow import map_with_ids
from citeloom.operators.skew import split_join
from citeloom.session import materialise

PASSAGE = 20
APART = 10
SEED = 9
#: Items of up to this size are broadcast to every task (their tables take some hundred times as much there).
TABLE_BYTES = 1 << 20
#: Size of the tables that are broadcast for more items: shifts (bytes) and buckets (bits), in powers of two.
SHIFT_BITS, FILTER_BITS, CHUNKS = 24, 27, 64

_WORD = re.compile(r"[^\W_]+")
_HUNK = re.compile(r"^@@ [^\n]*?@@[^\n]*$", re.M)


def words_of(text: str) -> list[str]:
    """Lower-case words; layout, punctuation, comment and diff marks and hunk headers vanish."""
    if "@@" in text:
        text = _HUNK.sub(" ", text)
    return _WORD.findall(text.lower())


class WuManber:
    """Finds runs of ``seed`` words of the items in a sequence of words."""

    def __init__(self, items: Sequence[tuple[int, str]], passage: int = PASSAGE, apart: int = APART, seed: int = SEED):
        if seed > passage // 2 - 1 or seed >= apart:
            raise ValueError("a passage must always contain an unbroken run of seed words")
        self.passage, self.apart, self.seed = passage, apart, seed
        self.items = [(i, words_of(t or "")) for i, t in items]
        self.shift: dict[tuple[str, str], int] = {}
        self.buckets: dict[tuple[str, str], dict[tuple[str, ...], list[tuple[int, int]]]] = {}
        for n, (_, w) in enumerate(self.items):
            for at in range(len(w) - seed + 1):
                run = w[at : at + seed]
                for j in range(1, seed):
                    block = (run[j - 1], run[j])
                    jump = seed - 1 - j
                    if self.shift.get(block, seed) > jump:
                        self.shift[block] = jump
                self.buckets.setdefault((run[-2], run[-1]), {}).setdefault(tuple(run), []).append((n, at))

    def longest(self, doc: list[str], item: list[str], i: int, j: int) -> int:
        """Longest passage on the diagonal through doc[i] = item[j]: first and last word equal, replaced words apart."""
        back = min(i, j)
        i, j = i - back, j - back
        n = min(len(doc) - i, len(item) - j)
        best = start = 0
        last_gap = None  # the last replaced word inside the running passage
        open_ = False
        k = 0
        while k < n:
            if doc[i + k] == item[j + k]:
                if not open_:
                    start, last_gap, open_ = k, None, True
                best = max(best, k - start + 1)
            elif open_:
                if last_gap is not None and k - last_gap < self.apart:
                    start = last_gap + 1  # the passage can only go on behind the earlier replaced word
                last_gap = k
                if start >= k:
                    open_ = False
            k += 1
        return best

    def leaks(self, text: str) -> dict[int, int]:
        """Item id -> words of its longest passage, for items with a passage of at least ``passage`` words."""
        doc = words_of(text)
        seed, shift, buckets = self.seed, self.shift, self.buckets
        found: dict[int, int] = {}
        tried: set[tuple[int, int]] = set()
        end, n, far = seed - 1, len(doc), seed - 1
        while end < n:
            jump = shift.get((doc[end - 1], doc[end]), far)
            if jump:
                end += jump
                continue
            at = end - seed + 1
            for item, j in buckets[doc[end - 1], doc[end]].get(tuple(doc[at : end + 1]), ()):
                if (item, at - j) not in tried:
                    tried.add((item, at - j))
                    name, w = self.items[item]
                    size = self.longest(doc, w, at, j)
                    if size >= self.passage and size > found.get(name, 0):
                        found[name] = size
            end += 1
        return found


def _seed(passage: int, apart: int) -> int:
    return min(SEED, passage // 2 - 1, apart - 1)


def leaked(documents: DataFrame, items: DataFrame, passage: int = PASSAGE, apart: int = APART) -> DataFrame:
    """(doc_id, item_id, words): documents holding at least ``passage`` consecutive words of an item.

    ``words`` is the length of the longest such passage. NULL and empty texts hold nothing; repeated document rows
    are reported once, and so are those of a NULL ``doc_id``. Items of up to ``TABLE_BYTES`` are broadcast and the documents are read
    once; the buckets of larger sets stay distributed (``leaked_from_many``), with the same result.
    """
    listed = items.select("item_id", "item_text").filter("item_id IS NOT NULL AND item_text IS NOT NULL").distinct()
    size = listed.agg(F.coalesce(F.sum(F.octet_length("item_text") + 20), F.lit(0))).first()[0]
    if size > TABLE_BYTES:
        return leaked_from_many(documents, listed, passage, apart)
    seed = _seed(passage, apart)
    kind = documents.schema["doc_id"].dataType.simpleString()
    ikind = items.schema["item_id"].dataType.simpleString()
    texts = documents.select("doc_id", "text").filter(F.length("text") > 0)
    shared = documents.sparkSession.sparkContext.broadcast([(str(r["item_id"]), r["item_text"]) for r in listed.collect()])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = WuManber(shared.value, passage, apart, seed)
        for pdf in batches:
            rows = [(d, i, n) for d, t in zip(pdf["doc_id"], pdf["text"]) for i, n in tables.leaks(t).items()]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "words"])

    out = map_with_ids(texts, {"doc_id": kind, "item_id": ikind}, ("text",), search, "words int")
    return out.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))


def _block(a: str, b: str) -> int:
    return crc32(f"{a} {b}".encode())


def _run(words: Sequence[str]) -> int:
    return int.from_bytes(blake2b(" ".join(words).encode(), digest_size=8).digest(), "little", signed=True)


def _tables(listed: DataFrame, runs: DataFrame, seed: int) -> tuple[bytes, bytes]:
    """The shift table and a filter of the suffix buckets, hashed to a fixed size: collisions shorten a jump or ask a bucket in vain,
    they lose nothing. Built by the tasks; the driver gets the finished tables only."""
    far = seed - 1

    def shifts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.full(1 << SHIFT_BITS, far, np.uint8)
        for pdf in batches:
            for text in pdf["item_text"]:
                w = words_of(text)
                at = [_block(a, b) & (1 << SHIFT_BITS) - 1 for a, b in zip(w, w[1:])]
                for i, slot in enumerate(at):  # as the last block of a run, or before it in a run that ends later
                    jump = max(0, seed - 2 - i) if len(w) >= seed else far
                    if jump < table[slot]:
                        table[slot] = jump
        step = len(table) // CHUNKS
        yield pd.DataFrame({"chunk": range(CHUNKS), "held": [table[i * step : (i + 1) * step].tobytes() for i in range(CHUNKS)]})

    def buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(1 << FILTER_BITS, bool)
        for pdf in batches:
            table[pdf["run"].to_numpy() & (1 << FILTER_BITS) - 1] = True
        packed = np.packbits(table, bitorder="little")
        step = len(packed) // CHUNKS
        yield pd.DataFrame({"chunk": range(CHUNKS), "held": [packed[i * step : (i + 1) * step].tobytes() for i in range(CHUNKS)]})

    def together(df: DataFrame, emit, join) -> bytes:
        def fold(pdf: pd.DataFrame) -> pd.DataFrame:
            held = pdf["held"].map(lambda b: np.frombuffer(b, np.uint8))
            return pd.DataFrame({"chunk": pdf["chunk"][:1], "held": [join(held.tolist()).tobytes()]})

        schema = "chunk int, held binary"
        merged = df.mapInPandas(emit, schema).groupBy("chunk").applyInPandas(fold, schema)
        return b"".join(bytes(r["held"]) for r in sorted(merged.collect(), key=lambda r: r["chunk"]))

    return together(listed.select("item_text"), shifts, np.minimum.reduce), together(runs.select("run"), buckets, np.bitwise_or.reduce)


def leaked_from_many(documents: DataFrame, listed: DataFrame, passage: int = PASSAGE, apart: int = APART) -> DataFrame:
    """``leaked`` for any number of items: no task and not the driver holds all of them.

    The shift table and a filter of the buckets have a fixed size and are broadcast. One pass over the documents emits the runs that
    pass both; the buckets are a table joined by run (hot runs, such as stock phrases, are split). Documents and items that share
    a run are then compared directly; only texts of such documents are read again and moved.
    """
    seed = _seed(passage, apart)
    kind = documents.schema["doc_id"].dataType.simpleString()
    ikind = listed.schema["item_id"].dataType.simpleString()
    texts = documents.select("doc_id", "text").filter(F.length("text") > 0)

    def item_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for item, text in zip(pdf["item_id"], pdf["item_text"]):
                w = words_of(text)
                rows += {(item, _run(w[i : i + seed])) for i in range(len(w) - seed + 1)}
            yield pd.DataFrame(rows, columns=["item_id", "run"])

    runs = materialise(map_with_ids(listed, {"item_id": ikind}, ("item_text",), item_runs, "run long"), "p8-runs")
    shared = documents.sparkSession.sparkContext.broadcast(_tables(listed, runs, seed))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shift, held = shared.value
        mask, bits = (1 << SHIFT_BITS) - 1, (1 << FILTER_BITS) - 1
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                w = words_of(text)
                found, end, n = set(), seed - 1, len(w)
                while end < n:
                    if jump := shift[_block(w[end - 1], w[end]) & mask]:
                        end += jump
                        continue
                    run = _run(w[end - seed + 1 : end + 1])
                    at = run & bits
                    if held[at >> 3] >> (at & 7) & 1:
                        found.add(run)
                    end += 1
                rows += [(doc, run) for run in found]
            yield pd.DataFrame(rows, columns=["doc_id", "run"])

    hits = materialise(map_with_ids(texts, {"doc_id": kind}, ("text",), scan, "run long").distinct(), "p8-hits")
    met = materialise(split_join(hits, runs, "run").select("doc_id", "item_id").distinct(), "p8-met")
    same_doc = F.col("d").eqNullSafe(F.col("doc_id"))
    kept = texts.join(met.select(F.col("doc_id").alias("d")).distinct(), same_doc, "left_semi")
    pairs = kept.join(met.select(F.col("doc_id").alias("d"), "item_id"), same_doc).drop("d").join(listed, "item_id")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for item, group in pdf.groupby("item_id", sort=False):
                tables = WuManber([(item, group["item_text"].iloc[0])], passage, apart, seed)
                rows += [(d, i, n) for d, t in zip(group["doc_id"], group["text"]) for i, n in tables.leaks(t).items()]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "words"])

    out = map_with_ids(pairs, {"doc_id": kind, "item_id": ikind}, ("text", "item_text"), compare, "words int")
    return out.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))
