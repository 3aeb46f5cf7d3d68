"""Problem 1: bibliography entries and records of another source that describe one publication.

Method: MinHash blocking across attributes (bands over the title's character trigrams alone, and shorter bands joined
with the first author's family name), pairwise similarity features, a logistic classifier trained on weak labels and
calibrated on held-out ones. Titles are compared once however many rows carry them; rows meet only their title's
candidates. A record source holds a work at most once, so an entry keeps its most probable record.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import bbl
from citeloom.llm.name_variants import _one_edit
from citeloom.operators.skew import split_join
from citeloom.session import materialise

#: Bands over title trigrams alone: two titles of Jaccard similarity 0.87 meet with probability 0.997, of 0.35 with 0.0006.
TITLE_BANDS, TITLE_ROWS = 20, 10
#: Bands joined with the first author: similarity 0.65 meets with probability 0.994.
AUTHOR_BANDS, AUTHOR_ROWS = 16, 3
#: Rows that the classifier is fitted and calibrated on, at most; all candidate pairs are scored.
LABELLED_ROWS = 40_000
THRESHOLD = 0.5

# Words that mark another publication, and words that mark the same one in another edition.
SEQUEL_WORDS = (
    "revisited", "rethinking", "limits", "part", "two", "three", "ii", "iii", "negative", "result", "results", "open",
    "questions", "reply", "response", "comment", "comments", "addendum", "erratum", "corrigendum", "sequel", "further",
    "reconsidered", "beyond", "continued",
)
EDITION = re.compile(
    r"\s*\b(?:extended abstract|preprint|technical report|tech report|full version|extended version|short paper"
    r"|arxiv(?: preprint)?(?: arxiv)?(?: ?\d{4} \d{4,5})?(?: ?v\d+)?|(?:19|20)\d\d)$"
)
#: Last words of what ``EDITION`` matches; its other matches end in a digit.
EDITION_ENDS = frozenset(("abstract", "preprint", "report", "version", "paper", "arxiv"))
STOP_WORDS = ("a", "an", "and", "by", "for", "from", "in", "of", "on", "over", "the", "to", "under", "via", "with")
_MARKUP = re.compile(r"\\[`'\"^~=.]|\\[A-Za-z]+\s*|[{}]")
_WORD = re.compile(r"[^\W_]+")
_ASCII_WORDS = {i: chr(i).lower() if chr(i).isalnum() else " " for i in range(128)}
_NOT_ASCII = re.compile(r"[^\x00-\x7f]")
_AND = re.compile(r"\s+and\s+", re.I)
_UNBRACED = re.compile(r"\{([^{}\\]{1,3})\}")
_FOUR_DIGITS = re.compile(r"\d{4}")
_ARTICLE_TITLE, _QUOTED, _PERSON, _YEAR = (re.compile(x) for x in (bbl.ARTICLE_TITLE, bbl.QUOTED, bbl.PERSON, bbl.YEAR))
_SHORT = re.compile(r"[A-Z]{1,3}|(?:[A-Za-z]\.-?)+")
_CAPS = re.compile(r"[A-Z'\-]{4,}")


def fold(text: str) -> str:
    """Without accents; ASCII text is returned as it is."""
    if text.isascii():
        return text
    return _NOT_ASCII.sub(lambda m: "" if unicodedata.combining(m[0]) else m[0], unicodedata.normalize("NFKD", text))


def _unmarked(text: str) -> str:
    """Without markup; most texts have none and are returned as they are."""
    return _MARKUP.sub("", text) if "\\" in text or "{" in text or "}" in text else text


def words(text: str | None) -> str:
    """Lower-case words without accents or markup, one space between."""
    if not text:
        return ""
    plain = _unmarked(fold(text))
    return " ".join(plain.translate(_ASCII_WORDS).split() if plain.isascii() else _WORD.findall(plain.lower()))


def title_key(text: str | None) -> str:
    """Words of a title, spelling of -ise and -ize made one, edition marks at the end taken off."""
    key = words(text).replace("z", "s")
    while key[-1:].isdecimal() or key.rpartition(" ")[2] in EDITION_ENDS:
        if (shorter := EDITION.sub("", key).strip()) == key:
            break
        key = shorter
    return key


def family(name: str) -> str:
    """Family name of one printed name (accents gone), by the position and case of its words; ``""`` if none."""
    plain = fold(_unmarked(name)).replace("~", " ")
    comma = "," in plain
    w = [x for x in plain.replace(",", " ").split() if x[0].isalpha() or any(ch.isalpha() for ch in x)]
    if not w:
        return ""
    caps = [x for x in w if _CAPS.fullmatch(x)]
    if comma:
        out = w[0]
    elif caps and len(caps) < len(w):
        out = caps[0]
    elif len(w) > 1 and _SHORT.fullmatch(w[-1]) and not _SHORT.fullmatch(w[0]):
        out = w[0]
    else:
        out = w[-1]
    out = out.lower()
    return out if out.isalpha() else "".join(ch for ch in out if ch.isalpha())


def first_family(authors: str | None) -> str | None:
    """Family name of the first author of a printed list; None for a missing list."""
    if not authors:
        return None
    head = _AND.split(authors.strip("{ \n"), maxsplit=1)[0]
    # Before the first comma stands either the whole first name or, as one word, the family name of it.
    return family(head.split(",", 1)[0]) or None


def raw_title(raw: str) -> str | None:
    """Title of an item: tagged, else its second block, else (without blocks) its first quoted span."""
    plain = _UNBRACED.sub(r"\1", raw)
    if m := _ARTICLE_TITLE.search(plain):
        return m[1]
    if r"\newblock" in plain:
        blocks = [b for x in plain.split(r"\newblock") if (b := x.strip())]
        return blocks[1] if len(blocks) > 1 else None
    return m[1] if (m := _QUOTED.search(plain)) else None


def raw_authors(raw: str) -> str | None:
    if bbl.AUTHOR_FIELD in raw:
        return ", ".join(_PERSON.findall(raw.split(bbl.AUTHOR_FIELD, 1)[1])) or None
    lines = raw.strip().split("\n")
    if len(lines) < 2:
        return None
    line = lines[1].strip()
    return re.split(r"``|\bet[ ~]al", line, maxsplit=1)[0].strip() or None


def _number(texts: list[str]) -> np.ndarray:
    """64-bit numbers of texts."""
    return pd.util.hash_array(np.array(texts, dtype=object)).view(np.int64)


def entries(bib: DataFrame) -> DataFrame:
    """entry_id, tid, title, first, authors, year of each row, from its fields or else its ``raw`` item.

    ``tid`` numbers the title. A row whose ``raw`` has another title than its field comes with both, as either may be misprinted. Rows
    without a title in either place are left out; ``raw`` is read only where a field is missing or its title is not found in it.
    """
    f = F.col("fields")
    lacking = ~(
        F.coalesce(f["title"].rlike(r"[\p{L}\p{N}]"), F.lit(False))
        & F.coalesce(f["author"].rlike(r"\p{L}"), F.lit(False))
        & F.coalesce(f["year"].rlike(r"\d"), F.lit(False))
    )
    other = ~F.coalesce(F.lower(f["raw"]).contains(F.lower(f["title"])), F.lit(False))
    needed = bib.select(
        "entry_id", f["title"].alias("t"), f["author"].alias("a"), f["year"].alias("y"), F.when(lacking | other, f["raw"]).alias("raw")
    )
    kind = bib.schema["entry_id"].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for entry, t, a, y, raw in zip(pdf["entry_id"], pdf["t"], pdf["a"], pdf["y"], pdf["raw"]):
                titles = dict.fromkeys(k for k in (title_key(t), title_key(raw_title(raw)) if raw else "") if k)
                if not titles or entry != entry:
                    continue
                who = words(a)
                if not who and raw:
                    a = raw_authors(raw)
                    who = words(a)
                m = _FOUR_DIGITS.search(_unmarked(y)) if y else None
                m = m or (_YEAR.search(raw) if raw else None)
                rows += [(entry, title, first_family(a), who or None, float(m[0]) if m else None) for title in titles]
            out = pd.DataFrame(rows, columns=["entry_id", "title", "first", "authors", "year"])
            out.insert(1, "tid", _number(out["title"].tolist()))
            yield out.astype({"year": "Int32"})

    return needed.filter("entry_id IS NOT NULL").mapInPandas(
        read, f"entry_id {kind}, tid long, title string, first string, authors string, year int"
    )


def records(dblp: DataFrame) -> DataFrame:
    """hit_id, tid, title, first, families, year of each record; untitled ones are left out."""
    needed = dblp.select(
        "hit_id", F.col("info.title").alias("t"), F.col("info.year").alias("y"), F.col("info.authors.author.text").alias("names")
    )
    kind = dblp.schema["hit_id"].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for hit, t, y, names in zip(pdf["hit_id"], pdf["t"], pdf["y"], pdf["names"]):
                if not (title := title_key(t)):
                    continue
                families = [f for n in (names if names is not None else ()) if n and (f := family(n))]
                m = _FOUR_DIGITS.search(y) if y else None
                rows.append((hit, title, families[0] if families else None, families, float(m[0]) if m else None))
            out = pd.DataFrame(rows, columns=["hit_id", "title", "first", "families", "year"])
            out.insert(1, "tid", _number(out["title"].tolist()))
            yield out.astype({"year": "Int32"})

    return needed.filter("hit_id IS NOT NULL").mapInPandas(
        read, f"hit_id {kind}, tid long, title string, first string, families array<string>, year int"
    )


def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(
        0, 1 << 32, n, dtype=np.uint64
    ).astype(np.uint32)


def minhash(texts: list[str], n: int) -> np.ndarray:
    """(len(texts), n) minima of ``n`` hashes over each text's character trigrams (padded, so none is without)."""
    padded = [f"  {t} " for t in texts]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    code = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(sizes)
    inside = np.ones(len(code), bool)
    inside[ends - 1] = inside[ends - 2] = False
    at = np.flatnonzero(inside)
    x = (code[at] * np.uint32(0x9E3779B1)) ^ (code[at + 1] * np.uint32(0x85EBCA6B)) ^ (code[at + 2] * np.uint32(0xC2B2AE35))
    for shift, mul in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        x = (x ^ (x >> np.uint32(shift))) * np.uint32(mul)
    x ^= x >> np.uint32(16)
    starts = np.concatenate(([0], np.cumsum(sizes - 2)[:-1]))
    out = np.empty((n, len(texts)), np.uint32)
    y, shifted = np.empty_like(x), np.empty_like(x)
    for k, (a, b) in enumerate(zip(*_hashes(n))):
        np.multiply(x, a, out=y)
        y += b
        np.right_shift(y, np.uint32(15), out=shifted)
        y ^= shifted
        np.minimum.reduceat(y, starts, out=out[k])
    return out.T


def _fold_rows(values: np.ndarray, seed: int) -> np.ndarray:
    key = np.full(len(values), seed * 0x9E3779B97F4A7C15 + 1 & (1 << 64) - 1, np.uint64)
    for k in range(values.shape[1]):
        key = (key ^ values[:, k].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return key


def title_bands(titles: DataFrame) -> DataFrame:
    """(band, tid) of rows of (tid, title): blocks of titles alone."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            sig, tid = minhash(pdf["title"].tolist(), TITLE_BANDS * TITLE_ROWS), pdf["tid"].to_numpy()
            keys = [_fold_rows(sig[:, b * TITLE_ROWS : (b + 1) * TITLE_ROWS], b) for b in range(TITLE_BANDS)]
            yield pd.DataFrame({"band": np.concatenate(keys).view(np.int64), "tid": np.tile(tid, TITLE_BANDS)})

    return titles.mapInPandas(emit, "band long, tid long")


def author_bands(titles: DataFrame) -> DataFrame:
    """(band, tid) of rows of (tid, title, firsts): blocks of a looser title band and a first author."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            sig = minhash(pdf["title"].tolist(), AUTHOR_BANDS * AUTHOR_ROWS)
            who = pd.util.hash_array(pdf["first"].to_numpy(object)).astype(np.uint64)
            keys = [
                (_fold_rows(sig[:, b * AUTHOR_ROWS : (b + 1) * AUTHOR_ROWS], 1000 + b) ^ who) * np.uint64(0xD6E8FEB86659FD93)
                for b in range(AUTHOR_BANDS)
            ]
            tid = pdf["tid"].to_numpy()
            yield pd.DataFrame({"band": np.concatenate(keys).view(np.int64), "tid": np.tile(tid, AUTHOR_BANDS)})

    return titles.mapInPandas(emit, "band long, tid long")


def blocks(rows: DataFrame) -> DataFrame:
    """(band, tid) of the distinct titles and (title, first author) pairs of rows of (tid, title, first)."""
    # One shuffle: the titles of a (title, author) pair lie where the pairs of the title lie.
    named = rows.select("tid", "title", "first").distinct()
    titles = rows.groupBy("tid").agg(F.min("title").alias("title"))
    return title_bands(titles).unionByName(author_bands(named.filter("first IS NOT NULL")))


def _trigrams(text: str) -> set[str]:
    t = f"  {text} "
    return {t[i : i + 3] for i in range(len(t) - 2)}


def _alike(a: str, b: str) -> bool:
    if a == b:
        return True
    if min(len(a), len(b)) < 3 or abs(len(a) - len(b)) > 2 or len(set(a) ^ set(b)) > 4:  # an edit changes two letters at most
        return False
    return _one_edit(a, b) or (min(len(a), len(b)) >= 6 and _two_edits(a, b))


def _two_edits(a: str, b: str) -> bool:
    """At most two edits apart: one leaves the words one edit apart behind the common start."""
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    swapped = a[:2] == b[:2][::-1] and _one_edit(a[2:], b[2:])
    return swapped or _one_edit(a[1:], b[1:]) or _one_edit(a[1:], b) or _one_edit(a, b[1:])


@lru_cache(1 << 16)
def _marks_sequel(word: str) -> bool:
    return word in SEQUEL_WORDS or (len(word) >= 6 and any(len(s) >= 6 and _one_edit(word, s) for s in SEQUEL_WORDS))


def title_features(a: str, b: str) -> tuple[float, int, int, int]:
    """Trigram similarity, words of either side without a counterpart, and words that mark another publication."""
    if a == b:
        return 1.0, 0, 0, 0
    x, y = _trigrams(a), _trigrams(b)
    both = len(x & y)
    similar = both / (len(x) + len(y) - both)
    u, v = a.split(), b.split()
    only_u = [w for w in u if w not in v]
    only_v = [w for w in v if w not in u]
    for w in list(only_u):
        hit = next((z for z in only_v if _alike(w, z)), None)
        if hit is not None:
            only_u.remove(w)
            only_v.remove(hit)
    if only_u and only_v:  # words that are written together on one side
        one, other = "".join(only_u), "".join(only_v)
        if _alike(one, other):
            only_u, only_v = [], []
    sequel = sum(_marks_sequel(w) for w in only_u) + sum(_marks_sequel(w) for w in only_v)
    return similar, sum(w not in STOP_WORDS for w in only_u), sum(w not in STOP_WORDS for w in only_v), sequel


FEATURES = ("similar", "lost", "added", "swapped", "sequel", "shared", "no_authors", "near_year", "far_year", "no_year")


def title_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of titles that share a block, with their features; ``left`` and ``right`` have (tid, title, first).

    Blocks of any size are split (``split_join``), such as those of titles made by one template.
    """
    mine, theirs = materialise(blocks(left), "p1-bands"), materialise(blocks(right).withColumnRenamed("tid", "rid"), "p1-bands")
    pairs = split_join(mine, theirs, "band").select("tid", "rid").distinct()
    a = left.groupBy("tid").agg(F.min("title").alias("a"))
    b = right.groupBy(F.col("tid").alias("rid")).agg(F.min("title").alias("b"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(t, r, *title_features(x, y)) for t, r, x, y in zip(pdf["tid"], pdf["rid"], pdf["a"], pdf["b"])]
            yield pd.DataFrame(rows, columns=["tid", "rid", "similar", "only_a", "only_b", "sequel"])

    return pairs.join(b, "rid").join(a, "tid").mapInPandas(
        compare, "tid long, rid long, similar double, only_a int, only_b int, sequel int"
    )


def features(pairs: DataFrame) -> DataFrame:
    """Adds the classifier's columns to rows with authors (words with one space between), families and both years."""
    known = F.col("authors").isNotNull() & (F.col("authors") != "") & (F.size(F.coalesce("families", F.array())) > 0)
    # The condition runs for each family of each pair, so it only searches text.
    listed = F.concat(F.lit(" "), "authors", F.lit(" "))
    joined = F.replace("authors", F.lit(" "), F.lit(""))
    shared = F.size(
        F.filter("families", lambda x: listed.contains(F.concat(F.lit(" "), x, F.lit(" "))) | ((F.length(x) >= 6) & joined.contains(x)))
    ) / F.size("families")
    gap = F.abs(F.col("year") - F.col("r_year"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return pairs.withColumns({
        "lost": F.least(F.col("only_b"), F.lit(4)).cast("double"),
        "added": F.least(F.col("only_a"), F.lit(4)).cast("double"),
        "swapped": F.least("only_a", "only_b", F.lit(3)).cast("double"),
        "sequel": F.least(F.col("sequel"), F.lit(2)).cast("double"),
        "shared": F.when(known, shared).otherwise(0.0),
        "no_authors": (~known).cast("double"),
        "near_year": flag(gap == 1),
        "far_year": flag(gap > 1),
        "no_year": flag(gap.isNull()),
    })


def weak_label() -> Column:
    """1 for all but certain matches, 0 for all but certain others, NULL for pairs that are left to the classifier.

    Two views vote: a whole title lets authors and year vary, and equal authors in one year let the title be damaged.
    """
    whole = (F.col("similar") >= 0.9) & (F.col("only_a") + F.col("only_b") == 0)
    timely = F.col("far_year") + F.col("no_year") == 0
    same_people = (F.col("shared") == 1) & timely & (F.col("near_year") == 0)
    match = (F.col("sequel") == 0) & ((whole & (F.col("shared") >= 0.5) & timely) | (same_people & (F.col("similar") >= 0.55)))
    other = (
        ((F.col("no_authors") == 0) & (F.col("shared") == 0) & (F.col("similar") < 0.9))
        | ((F.col("sequel") > 0) & (F.col("far_year") == 1))
        | ((F.col("swapped") >= 2) & (F.col("far_year") == 1))
        | ((F.col("similar") < 0.6) & (F.col("far_year") == 1))
    )
    return F.when(match & ~other, 1).when(other & ~match, 0)


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic regression, by Newton steps: the most probable ones under normal
    priors around ``prior``. Labels outweigh it as soon as there are a few; without any it is the answer."""
    x = np.column_stack([x, np.ones(len(x))])
    w = prior.astype(float)
    ridge = np.full(len(w), penalty)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * (w - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


#: Where the weights are thought to lie before any label is seen: title and author agreement for, any doubt against.
PRIOR = np.array([4.0, -0.8, -0.8, -2.0, -3.0, 4.0, 2.0, -0.5, -2.5, -0.5, -4.0])


def train(sample: pd.DataFrame) -> np.ndarray:
    """Classifier weights with the calibration folded in.

    Half of the labelled pairs are fitted, with authors or year hidden in part of the copies so that pairs without
    them get sound weights; the other half sets the slope and offset of Platt's calibration. The same is done with any number
    of labels: weights start from ``PRIOR``, the calibration from none (slope 1, offset 0).
    """
    x, y = sample[list(FEATURES)].to_numpy(float), sample["label"].to_numpy(float)
    at = {f: i for i, f in enumerate(FEATURES)}
    rng = np.random.default_rng(7)
    hidden = rng.random(len(x))
    masked = x.copy()
    who, when = hidden < 0.15, (hidden >= 0.15) & (hidden < 0.3)
    masked[who, at["shared"]], masked[who, at["no_authors"]] = 0, 1
    masked[when, at["near_year"]] = masked[when, at["far_year"]] = 0
    masked[when, at["no_year"]] = 1
    half = rng.random(len(x)) < 0.5
    w = fit(masked[half], y[half], PRIOR)
    margin = masked[~half] @ w[:-1] + w[-1]
    slope, offset = fit(margin[:, None], y[~half], np.array([1.0, 0.0]))
    out = w * slope
    out[-1] += offset
    return out


def matches(bib: DataFrame, dblp: DataFrame) -> DataFrame:
    """(entry_id, hit_id, confidence): the most probable record of every entry that has one.

    Every candidate pair is scored: each entry with all records of all titles like its own, whatever their number; a title that many
    entries or records share is split. Rows without a title in ``title`` or ``raw`` match nothing; every copy of an entry is listed; ties go
    to the more similar title, then the smaller ``hit_id``. Empty tables give no rows.
    """
    left = materialise(entries(bib), "p1-entries")
    right = materialise(records(dblp), "p1-records")
    titled = materialise(title_pairs(left, right), "p1-titles")
    # Records of one title with equal authors and year score alike and ties go to the smallest id, so one row stands for them.
    hits = right.groupBy(F.col("tid").alias("rid"), "families", F.col("year").alias("r_year")).agg(F.min("hit_id").alias("hit_id"))
    offered = materialise(split_join(titled, materialise(hits, "p1-hits"), "rid").drop("rid"), "p1-offers")
    rows = left.count()

    def scored(some: DataFrame) -> DataFrame:
        return features(split_join(some.select("entry_id", "tid", "authors", "year"), offered, "tid"))

    # The same entries are drawn on every run: by the hash of their identifier, as many as LABELLED_ROWS may need.
    order = F.xxhash64("entry_id", F.lit(11))
    share = min(1.0, 3 * LABELLED_ROWS / max(1, rows))
    drawn = left if share == 1.0 else left.filter(order <= int((2 * share - 1) * (1 << 62)) * 2)
    # Written before it is filtered: a filter would compute the columns of each of its conditions anew, for either label.
    labelled = scored(drawn).select("entry_id", "hit_id", *FEATURES, weak_label().alias("label"))
    labelled = materialise(labelled, "p1-labelled")
    picked = None
    for label in (0, 1):
        part = labelled.filter(F.col("label") == label).orderBy(order, "hit_id").limit(LABELLED_ROWS // 2)
        picked = part if picked is None else picked.unionByName(part)
    weights = train(picked.select(*FEATURES, "label").toPandas())
    margin = F.lit(float(weights[-1]))
    for f, w in zip(FEATURES, weights):
        margin = margin + F.col(f) * float(w)
    best = (
        scored(left)
        .withColumn("confidence", 1 / (1 + F.exp(-margin)))
        .filter(F.col("confidence") >= THRESHOLD)
        .groupBy("entry_id")
        .agg(F.max_by(F.struct("hit_id", "confidence"), F.struct("confidence", "similar", -F.col("hit_id"))).alias("m"))
    )
    return best.select("entry_id", "m.hit_id", F.col("m.confidence").alias("confidence"))
