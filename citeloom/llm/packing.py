"""Problem 7: filling containers of fixed capacity with texts, sizes in tokens of a public tokenizer.

Method: exact-complement hashing on the counts of each length. Lengths are at most the capacity, so the histogram and
the plan made from it have a bounded size at any number of texts. The plan opens a container with the longest length
left, looks up whether a single length, a pair or a triple fills the gap exactly under the counts still available (sums of one and
of two lengths are indexed; a triple is a length whose rest is in the index of pairs, as there may be over a billion triples),
places the best fit where none does, and repeats each pattern as often as the counts allow. Texts then find their
container by their rank within their length; ranks come from per-task counts and prefix sums, so no length, however
common, is gathered anywhere.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.arrow import map_with_ids
from citeloom.session import materialise

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that splits text before the merges of the rank file.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

Pattern = tuple[tuple[int, int], ...]


def encoder(ranks: bytes):
    """The tokenizer of a ``.tiktoken`` rank file (its content)."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=PRETOKENS, mergeable_ranks=table, special_tokens={})


def token_pieces(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, tokens, part, seq: each text, those over ``capacity`` cut every ``capacity`` tokens.

    ``seq`` numbers the pieces of equal length within the task ``part``. The rank file is read on the driver and
    shipped to the tasks (under a megabyte). NULL and empty texts are one piece of no tokens.
    """
    with open(tokenizer, "rb") as f:
        ranks = documents.sparkSession.sparkContext.broadcast(f.read())
    kind = documents.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(ranks.value).encode_ordinary
        part = TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                n = len(encode(text)) if text else 0
                for piece, start in enumerate(range(0, max(n, 1), capacity)):
                    size = min(capacity, n - start)
                    rows.append((doc, piece, start, size, part, seen[size]))
                    seen[size] += 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "tokens", "part", "seq"])

    schema = "piece int, start int, tokens int, part int, seq long"
    return map_with_ids(documents, {"doc_id": kind}, ("text",), count, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, Pattern]]:
    """(times, ((length, copies), ...)): patterns that use up every length of the histogram exactly."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in histogram.items():
        if not 0 < size <= capacity:
            raise ValueError(f"length {size} is outside 1..{capacity}")
        left[size] = n
    out: list[tuple[int, Pattern]] = []
    while left.any():
        free = left.copy()
        sizes = np.flatnonzero(free)[::-1]
        used = [int(sizes[0])]
        free[used[0]] -= 1
        gap = capacity - used[0]
        singles, pairs = _index(free)
        while gap:
            fill = _complement(free, gap, singles, pairs)
            if fill:
                used += fill
                break
            below = np.flatnonzero(free[: gap + 1])
            if not len(below):
                break
            best = int(below[-1])
            used.append(best)
            free[best] -= 1
            gap -= best
            if not free[best]:
                singles, pairs = _index(free)
        copies = Counter(used)
        times = min(int(left[s]) // k for s, k in copies.items())
        for s, k in copies.items():
            left[s] -= times * k
        out.append((times, tuple(sorted(copies.items(), reverse=True))))
    return out


def _index(free: np.ndarray) -> tuple[int, int]:
    """Bit sets of the lengths and of the sums of two lengths that are available."""
    singles = pairs = 0
    present = [int(s) for s in np.flatnonzero(free)]
    for s in present:
        singles |= 1 << s
    for s in present:
        pairs |= singles << s
    return singles, pairs


def _complement(free: np.ndarray, gap: int, singles: int, pairs: int) -> list[int]:
    """One, two or three available lengths that sum to ``gap`` exactly, the longest first; none gives ``[]``."""
    if singles >> gap & 1:
        return [gap]

    def two(total: int, taken: int = 0) -> list[int]:
        if not pairs >> total & 1:
            return []
        for a in range(min(total - 1, len(free) - 1), (total - 1) // 2, -1):
            b = total - a
            if singles >> a & 1 and singles >> b & 1:
                need = Counter((a, b, taken) if taken else (a, b))
                if all(free[s] >= k for s, k in need.items()):
                    return [a, b]
        return []

    if found := two(gap):
        return found
    for a in range(gap - 2, 0, -1):
        if singles >> a & 1 and (found := two(gap - a, a)):
            return [a, *found]
    return []


def containers(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, tokens, container: where each text goes; only texts over ``capacity`` are split.

    Containers are numbered from 0. Texts without tokens (NULL and empty ones) lie in container 0; an empty table
    gives no rows. Equal texts are separate items, and so are rows of a NULL or repeated ``doc_id``.
    """
    items = materialise(token_pieces(documents, capacity, tokenizer), "p7-pieces")
    per_part = items.groupBy("tokens", "part").agg(F.count("*").alias("n"))
    histogram = {r["tokens"]: r["n"] for r in per_part.groupBy("tokens").agg(F.sum("n").alias("n")).collect()}
    histogram.pop(0, None)
    keys, first, copies, base = [], [], [], []
    used: Counter[int] = Counter()
    opened = 0
    for times, pattern in plan(histogram, capacity):
        for size, k in pattern:
            keys.append((size << 44) + used[size])
            first.append(used[size])
            copies.append(k)
            base.append(opened)
            used[size] += times * k
        opened += times
    order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
    shared = documents.sparkSession.sparkContext.broadcast(
        tuple(np.array(x, dtype=np.int64)[order] for x in (keys, first, copies, base))
    )

    @F.pandas_udf("long")
    def place(tokens: pd.Series, rank: pd.Series) -> pd.Series:
        keys, first, copies, base = shared.value
        size, rank = tokens.to_numpy(np.int64), rank.to_numpy(np.int64)
        if not len(keys):
            return pd.Series(np.zeros(len(size), np.int64))
        at = np.searchsorted(keys, (size << 44) + rank, side="right") - 1
        at = np.maximum(at, 0)
        return pd.Series(np.where(size == 0, 0, base[at] + (rank - first[at]) // copies[at]))

    before = Window.partitionBy("tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("tokens", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = items.join(offsets, ["tokens", "part"])
    return ranked.select(
        "doc_id", "piece", "start", "tokens", place("tokens", F.col("offset") + F.col("seq")).alias("container")
    )


def fill(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """container, n_pieces, used: how full each container is."""
    return (
        containers(documents, capacity, tokenizer)
        .groupBy("container")
        .agg(F.count("*").alias("n_pieces"), F.sum("tokens").cast("long").alias("used"))
    )
