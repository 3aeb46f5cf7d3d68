"""Problem 4: spellings of one person or body.

Method: noisy-channel attribution. Frequent forms are the candidate canonical ones; a candidate's prior is how often
its spellings are printed, the channel knows one-letter typos, abbreviated and dropped given names, nicknames and
reordering (how likely each is, is estimated from the spellings), and every form is attached to its maximum posterior. Under each of its blocking keys a form is judged against
all holders that the channel tells apart: written-out names meet every written-out name that is close in family and given
name; initials meet the first in rank of each family name, with and without further initials.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import bbl
from citeloom.operators.skew import hot_first_join, split_join
from citeloom.session import materialise, release

# Common short forms of given names.
NICKNAMES = {
    "abby": ("abigail",), "alex": ("alexander", "alexandra"), "andy": ("andrew",), "beth": ("elizabeth",),
    "betty": ("elizabeth",), "bill": ("william",), "bob": ("robert",), "bobby": ("robert",), "cathy": ("catherine",),
    "charlie": ("charles",), "chris": ("christopher", "christina"), "dan": ("daniel",), "dave": ("david",),
    "dick": ("richard",), "dora": ("dorothea", "theodora"), "dot": ("dorothy",), "ed": ("edward",), "eddie": ("edward",),
    "fred": ("frederick",), "freddy": ("frederick",), "gabi": ("gabriella",), "gabby": ("gabriella",), "greg": ("gregory",),
    "hank": ("henry",), "jack": ("john",), "jake": ("jacob",), "jim": ("james",), "jo": ("josephine", "joanna"),
    "joe": ("joseph",), "josie": ("josephine",), "kate": ("katherine",), "kathy": ("katherine",), "katie": ("katherine",),
    "ken": ("kenneth",), "kit": ("christopher",), "larry": ("lawrence",), "leo": ("leopold", "leonard"), "liz": ("elizabeth",),
    "maggie": ("margaret",), "max": ("maximilian",), "meg": ("margaret",), "mike": ("michael",), "mina": ("wilhelmina",),
    "nick": ("nicholas",), "peg": ("margaret",), "peggy": ("margaret",), "rob": ("robert",), "ron": ("ronald",),
    "sam": ("samantha", "samuel"), "sasha": ("alexander",), "steve": ("steven", "stephen"), "ted": ("theodore", "edward"),
    "theo": ("theodore",), "tim": ("timothy",), "tom": ("thomas",), "tony": ("anthony",), "tori": ("victoria",),
    "vicky": ("victoria",), "will": ("william",), "ben": ("benjamin",), "val": ("valentin",),
}
BODY_WORDS = {
    "institute": "institute", "inst": "institute", "laboratory": "laboratory", "lab": "laboratory", "labs": "laboratory",
    "collaboration": "collaboration", "collab": "collaboration", "consortium": "consortium", "consort": "consortium",
    "group": "group", "team": "team", "university": "university", "univ": "university", "center": "center",
    "centre": "center", "project": "project", "society": "society", "soc": "society", "network": "network",
    "association": "association", "assoc": "association", "foundation": "foundation", "department": "department",
    "dept": "department", "committee": "committee", "agency": "agency",
}
#: Also readable as initials.
BODY_SHORT = {"wg": "group"}
_BODY_NOISE = ("the", "of", "for", "working")

#: What the channel does: letters mistyped, further initials dropped, nicknames used, given names abbreviated.
OPERATIONS = ("typos", "dropped", "nicknames", "initials")
#: Log-likelihood of each before any spelling is seen, and how many spellings that belief counts for.
BELIEF = dict(zip(OPERATIONS, (-4.0, -0.5, -2.0, -2.5)))
BELIEF_COUNTS = 1000
#: A typo is believed only in words long enough that two real names are hardly ever one letter apart; given names may
#: be shorter, since there the whole family name agrees.
FAMILY_LETTERS = 5
GIVEN_LETTERS = 3

_ACCENT = re.compile(r"\\[`'\"^~=.uvHtcdbk]\s*\{?\\?([A-Za-z])\}?")


def fold(text: str) -> str:
    """Without accents (LaTeX ones too), braces and ties; the letters' case stays."""
    text = _ACCENT.sub(r"\1", text).replace("~", " ").replace("{", "").replace("}", "")
    return "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))


def _letters(text: str) -> str:
    return "".join(ch for ch in text.lower() if ch.isalpha())


def _one_edit(a: str, b: str) -> bool:
    """Equal, or one insertion, deletion, substitution or swap of neighbours apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i:]


def _body_word(word: str) -> str | None:
    w = _letters(word)
    if w in BODY_WORDS:
        return BODY_WORDS[w]
    if len(w) > 6:
        return next((full for full in dict.fromkeys(BODY_WORDS.values()) if len(full) > 6 and _one_edit(w, full)), None)
    return None


def parse(name: str) -> list[tuple[str, str, str]]:
    """Readings (family, given, initials) of a spelling, likeliest first; ``given`` is ``""`` if only initials show.

    Two written-out words without a comma or capitals may stand in either order.
    A double given name keeps its hyphen and has one initial. For a body the family is its own name, the given name its kind, and there are no initials.
    """
    text = fold(name)
    words = [w for w in re.split(r"[\s]+", text.replace(",", " , ")) if w == "," or any(ch.isalpha() for ch in w)]
    plain = [w for w in words if w != ","]
    if not plain:
        return []
    kinds = [k for w in plain if (k := _body_word(w))]
    if kinds and len(plain) > 1:
        core = [w for w in plain if not _body_word(w) and _letters(w) not in _BODY_NOISE]
        if core:
            return [(_letters("".join(core)), kinds[0], "")]

    def initials(word: str) -> str | None:
        """Letters of ``G.``, ``G.V.``, ``GV``, the first of ``J.-L.``; None for a written-out word."""
        parts = [p for p in word.split(".") if p]
        if all(len(p.lstrip("-")) == 1 for p in parts):
            return "".join(p for p in parts if p[0] != "-").lower()
        if word.isalpha() and word.isupper() and len(word) <= 3:
            return word.lower()
        return None

    def person(given: list[str], family: list[str]) -> tuple[str, str, str]:
        full, short = [], ""
        for w in given:
            if (s := initials(w)) is not None:
                short += s
            else:
                short += "" if full else _letters(w)[:1]
                full += [x for p in re.split(r"-+", w) if (x := _letters(p))]
        return _letters("".join(family)), "-".join(full), short

    if "," in words:
        at = words.index(",")
        family, given = words[:at], [w for w in words[at + 1 :] if w != ","]
        if family and given:
            return [person(given, family)]
    if len(plain) == 1:
        return [(_letters(plain[0]), "", "")]
    caps = [len(_letters(w)) > 3 and w.upper() == w for w in plain]
    if any(caps) and not all(caps):
        family = [w for w, c in zip(plain, caps) if c]
        return [person([w for w, c in zip(plain, caps) if not c], family)]
    if initials(plain[-1]) is not None and initials(plain[0]) is None:
        out = [person(plain[-1:], plain[:-1])]
        if plain[-1].lower() in BODY_SHORT:
            out.append((_letters("".join(plain[:-1])), BODY_SHORT[plain[-1].lower()], ""))
        return out
    lead = 1
    while lead < len(plain) - 1 and initials(plain[lead]) is not None:
        lead += 1
    out = [person(plain[:lead], plain[lead:])]
    if len(plain) - lead > 1 and lead == 1:
        more = lead + 1
        while more < len(plain) - 1 and initials(plain[more]) is not None:
            more += 1
        out.append(person(plain[:more], plain[more:]))
    if len(plain) == 2 and initials(plain[0]) is None and initials(plain[1]) is None:
        out.append(person(plain[1:], plain[:1]))
    return out


def _deletes(word: str, least: int) -> set[str]:
    """The word and all it becomes by leaving out one letter: two words one edit apart share one of these."""
    if len(word) < least:
        return {word}
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


def _name_keys(family: str, given: str) -> set[str]:
    """Keys of a written-out name: any two that the channel takes for each other share one."""
    families, solids = _deletes(family, FAMILY_LETTERS), _deletes(given.replace("-", ""), GIVEN_LETTERS)
    heads = (*NICKNAMES.get(given, ()), given.split("-")[0])
    return {f"g|{f}|{g}" for f in families for g in solids} | {f"n|{f}|{h}" for f in families for h in heads}


def _initial_keys(family: str, given: str, short: str) -> list[tuple[str, str, bool, bool]]:
    """(key, class, probes, offers) of a form. Under an offered key a form can be found, under a probed one initials look.

    Initials fit any given name, so forms of one key and class (family, further initials or none) are equally likely
    for them, and the one of highest rank stands for all.
    """
    out: dict[tuple[str, str], list[bool]] = {}

    def put(key: str, kind: str, probes: bool = True, offers: bool = True) -> None:
        flags = out.setdefault((key, kind), [False, False])
        flags[0] |= probes
        flags[1] |= offers

    first, rest = short[:1], short[1:]
    for f in _deletes(family, FAMILY_LETTERS) if first else ():
        put(f"i|{f}|{short}", family, probes=not given)
        put(f"i|{f}|{first}.", f"{family}|{'+' if rest else '-'}", probes=not rest and not given)
        put(f"i|{f}|{first}-", family, probes=bool(rest) and not given, offers=not rest)
    return [(k, c, a, b) for (k, c), (a, b) in out.items() if a or b]


def _given(a: str, b: str) -> tuple[int, int] | None:
    """(typos, nicknames) that make one given name of the other."""
    x, y = a.replace("-", ""), b.replace("-", "")
    if x == y:
        return 0, 0
    if b in NICKNAMES.get(a, ()) or a in NICKNAMES.get(b, ()):
        return 0, 1
    if set(NICKNAMES.get(a, ())) & set(NICKNAMES.get(b, ())):
        return 0, 2
    if ("-" in a) != ("-" in b) and a.split("-")[0] == b.split("-")[0]:
        return 0, 1
    return (1, 0) if min(len(x), len(y)) >= GIVEN_LETTERS and _one_edit(x, y) else None


def channel(a: tuple[str, str, str], b: tuple[str, str, str]) -> tuple[int, int, int, int] | None:
    """How often each of ``OPERATIONS`` is needed to print form ``b`` as ``a``; None where the channel cannot do that."""
    typos = 0
    if a[0] != b[0]:
        if min(len(a[0]), len(b[0])) < FAMILY_LETTERS or not _one_edit(a[0], b[0]):
            return None
        typos = 1
    if not a[2] or not b[2]:
        given = _given(a[1], b[1]) if a[1] and b[1] and not a[2] and not b[2] else None
        return None if given is None else (typos + given[0], 0, given[1], 0)
    middle_a, middle_b = a[2][1:], b[2][1:]
    if middle_a and middle_b and middle_a != middle_b:
        return None
    dropped = int(middle_a != middle_b)
    if a[1] and b[1]:
        given = _given(a[1], b[1])
        return None if given is None else (typos + given[0], dropped, given[1], 0)
    return (typos, dropped, 0, 1) if a[2][0] == b[2][0] else None


def _likelihood(a: tuple[str, str, str], b: tuple[str, str, str], weights: dict[str, float] = BELIEF) -> float | None:
    """Log-likelihood that form ``b`` is printed as ``a``; None where the channel cannot do that."""
    done = channel(a, b)
    return None if done is None else sum(n * weights[o] for o, n in zip(OPERATIONS, done))


def raw_names(raw: Column) -> Column:
    """Author list of a ``raw`` item, up to ``et al.`` or the quoted title; a full stop behind a word is not part of it."""
    line = F.regexp_replace(bbl.item_author(raw), r"(?s)\s*,?\s*(?:``.*|\\emph\{)?\s*$", "")
    return F.regexp_replace(line, r"(?<=\p{L}{2})\.$", "")


def printed(papers: DataFrame, bib: DataFrame) -> DataFrame:
    """(name, n): how often each string between separators stands in an author list of a paper or an entry.

    An entry without ``author`` counts by the author line of its ``raw`` item. Lists are cut at `` and `` and at commas; neighbouring parts are also tried together, since ``Family, Given`` has a
    comma of its own. Strings that are no spelling simply match nothing later.
    """
    f = F.col("fields")
    listed = F.when(f["author"].rlike(r"\S"), f["author"]).otherwise(raw_names(f["raw"]))
    lists = papers.select(F.col("authors").alias("x")).unionAll(bib.select(listed.alias("x")))
    parts = F.transform(
        F.split(F.regexp_replace("x", r"\s+", " "), r", and | and |; ?"), lambda p: F.split(p, ", ?")
    )
    tried = F.flatten(
        F.transform(
            parts,
            lambda p: F.concat(
                p,
                F.when(
                    F.size(p) > 1,
                    F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p)), lambda a, b: F.concat(a, F.lit(", "), b)),
                ).otherwise(F.array().cast("array<string>")),
            ),
        )
    )
    strings = lists.filter(F.col("x").isNotNull()).select(F.explode(tried).alias("name"))
    return strings.filter("name <> ''").groupBy("name").agg(F.count("*").alias("n"))


_FORM = ("family", "given", "short")


def written_pairs(forms: DataFrame) -> DataFrame:
    """(form, c_form): written-out forms, each with all forms of higher rank that are close in family and given name.

    Keys are shared by pairs of family and given name, whatever the further initials; those must not conflict.
    """
    size = F.length("given") + F.length("short")
    rest = F.when(F.col("short") != "", F.substring("short", 2, 1 << 20)).otherwise("")
    bases = forms.filter("given <> ''").groupBy("family", "given").agg(
        F.collect_list(F.struct("n", size.alias("size"), "form", rest.alias("rest"))).alias("held")
    )
    bases = materialise(bases.withColumn("base", F.xxhash64("family", "given")), "p4-bases")

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = [_name_keys(*x) for x in zip(pdf["family"], pdf["given"])]
            hashed = pd.util.hash_array(np.array([k for ks in keys for k in ks], dtype=object)).view(np.int64)
            yield pd.DataFrame({"key": hashed, "base": np.repeat(pdf["base"].to_numpy(), [len(ks) for ks in keys])})

    spread = int(forms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = bases.select("base", "family", "given").repartition(spread, "base").mapInPandas(emit, "key long, base long")
    shared = keyed.groupBy("key").agg(F.collect_set("base").alias("bases")).filter("size(bases) > 1").select("bases")
    near = shared.distinct().select(F.explode("bases").alias("base"), "bases").select("base", F.explode("bases").alias("c_base"))
    near = near.filter("base <> c_base").distinct().unionByName(bases.select("base", F.col("base").alias("c_base")))
    mine = bases.select("base", F.col("held").alias("a"))
    theirs = bases.select(F.col("base").alias("c_base"), F.col("held").alias("cs"))
    met = near.join(mine, "base").join(theirs, "c_base").select(F.explode("a").alias("a"), "cs")
    rank = lambda x: F.struct(x["n"], x["size"], x["form"])
    fits = lambda c: (c["rest"] == F.col("a.rest")) | (c["rest"] == "") | (F.col("a.rest") == "")
    found = met.select(F.col("a.form").alias("form"), F.explode(F.filter("cs", lambda c: (rank(c) > rank(F.col("a"))) & fits(c))).alias("c"))
    return found.select("form", F.col("c.form").alias("c_form"))


def _posterior(weights: dict[str, float]) -> Column:
    """Log of prior (how often the candidate is printed) times channel."""
    score = F.log(F.col("c_n") + 1.0)
    for o in OPERATIONS:
        score = score + F.col(o) * weights[o]
    return score


def estimated(judged: DataFrame) -> dict[str, float]:
    """Log-likelihoods of the channel's operations: how often they are needed where every form goes to its maximum posterior.

    One step of hard expectation maximisation from ``BELIEF``, which weighs as ``BELIEF_COUNTS`` spellings: few data leave it as it is.
    """
    best = judged.groupBy("form").agg(F.max_by(F.struct(*OPERATIONS), F.struct(_posterior(BELIEF).alias("p"), "to")).alias("o"))
    total, *done = best.agg(F.count("*"), *[F.coalesce(F.sum(f"o.{o}"), F.lit(0)) for o in OPERATIONS]).first()
    rate = {o: (n + BELIEF_COUNTS * math.exp(BELIEF[o])) / (total + BELIEF_COUNTS) for o, n in zip(OPERATIONS, done)}
    return {o: math.log(r) for o, r in rate.items()}


def attached(forms: DataFrame, judged: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(form, to): every form with its maximum posterior, itself where it has no candidate."""
    best = judged.groupBy("form").agg(F.max_by("to", F.struct(_posterior(weights).alias("p"), "to")).alias("to"))
    return forms.select("form").join(best, "form", "left").select("form", F.coalesce("to", "form").alias("to"))


def clusters(names: DataFrame, papers: DataFrame, bib: DataFrame) -> DataFrame:
    """(name_id, cluster): ``cluster`` is the smallest ``name_id`` of the spellings of one person or body.

    NULL names and names without a letter are left out, of rows of equal ``name_id`` the first name counts; namesakes with the same
    letters cannot be told apart.
    """
    spark, kind = names.sparkSession, names.schema["name_id"].dataType.simpleString()
    spelled = names.filter("name IS NOT NULL AND name_id IS NOT NULL").groupBy("name_id").agg(F.min("name").alias("name"))
    seen = spelled.join(printed(papers, bib), "name", "left").select(
        "name_id", "name", F.coalesce("n", F.lit(0)).alias("n")
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (i, n, at, *reading)
                for i, name, n in zip(pdf["name_id"], pdf["name"], pdf["n"])
                for at, reading in enumerate(parse(name))
            ]
            yield pd.DataFrame(rows, columns=["name_id", "n", "at", *_FORM])

    readings = materialise(
        seen.mapInPandas(read, f"name_id {kind}, n long, at int, family string, given string, short string"), "p4-readings"
    )
    # Of several readings the one that more other spellings share is taken, then the one that is printed more often as the likeliest
    # reading of a spelling. Both belong to the reading, so the two orders of a name come to the same one.
    natural = F.sum(F.when(F.col("at") == 0, F.col("n") + 1).otherwise(0)).alias("natural")
    shared = readings.groupBy(*_FORM).agg(F.count("*").alias("others"), natural)
    taken = (
        readings.join(shared, list(_FORM))
        .groupBy("name_id")
        .agg(F.max_by(F.struct(*_FORM, "n"), F.struct("others", "natural", -F.col("at"))).alias("r"))
        .select("name_id", *[F.col(f"r.{c}").alias(c) for c in (*_FORM, "n")])
    )
    chosen = materialise(taken, "p4-taken")
    seed = 0
    while True:  # forms are numbered by a hash that tells all of them apart
        form = F.xxhash64(F.lit(seed), *_FORM).alias("form")
        forms = materialise(chosen.groupBy(form, *_FORM).agg(F.sum("n").alias("n")), "p4-forms")
        if forms.groupBy("form").agg(F.count("*").alias("k")).filter("k > 1").isEmpty():
            break
        seed += 1
    named = materialise(chosen.select("name_id", form), "p4-names")
    release(readings, chosen)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, kinds, probes, offers, rows = [], [], [], [], []
            for at, (family, given, short) in enumerate(zip(pdf["family"], pdf["given"], pdf["short"])):
                for key, kind, a, b in _initial_keys(family, given, short):
                    keys.append(key)
                    kinds.append(kind)
                    probes.append(a)
                    offers.append(b)
                    rows.append(at)
            out = pdf[["form", "n"]].iloc[rows].reset_index(drop=True)
            # Written-out names go before initials, then the more frequent, then the longer, then any fixed order.
            out["full"] = (pdf["given"] != "").to_numpy()[rows]
            out["size"] = (pdf["given"].str.len() + pdf["short"].str.len()).to_numpy()[rows]
            hashed, kinds = (pd.util.hash_array(np.array(x, dtype=object)).view(np.int64) for x in (keys, kinds))
            yield out.assign(key=hashed, kind=kinds, probes=probes, offers=offers)

    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a few bytes a form become dozens of keys
    keyed = forms.repartition(spread, "form").mapInPandas(
        emit, "form long, n long, full boolean, size int, key long, kind long, probes boolean, offers boolean"
    )
    keyed = materialise(keyed, "p4-keys")
    rank = F.struct("full", "n", "size", "form")
    best_of_kind = keyed.groupBy("key", "kind").agg(
        F.max(F.when(F.col("offers"), rank)).alias("c"), F.count_if("probes").alias("held")
    )
    top = best_of_kind.groupBy("key").agg(F.collect_list("c").alias("cs"), F.sum("held").alias("held")).filter("size(cs) > 0 AND held > 0")
    of_initials = (
        hot_first_join(keyed.filter("probes").select("key", rank.alias("me")), top, "key", "held", keyed.count())
        .select("me", F.explode(F.filter("cs", lambda c: c > F.col("me"))).alias("c"))
        .select("me.form", F.col("c.form").alias("c_form"))
        .distinct()
    )
    pairs = of_initials.unionByName(written_pairs(forms))
    described = forms.select("form", *_FORM, "n")
    others = described.select(*[F.col(c).alias(f"c_{c}") for c in described.columns])
    candidates = pairs.join(described, "form").join(others, "c_form")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                a, b = (r.family, r.given, r.short), (r.c_family, r.c_given, r.c_short)
                mine = (bool(r.given), r.n, len(r.given) + len(r.short), r.form)
                other = (bool(r.c_given), r.c_n, len(r.c_given) + len(r.c_short), r.c_form)
                if other > mine and (done := channel(a, b)) is not None:
                    rows.append((r.form, r.c_form, *done, r.c_n))
            yield pd.DataFrame(rows, columns=["form", "to", *OPERATIONS, "c_n"])

    counts = ", ".join(f"{o} int" for o in OPERATIONS)
    judged = materialise(candidates.mapInPandas(judge, f"form long, to long, {counts}, c_n long"), "p4-judged")
    release(keyed)
    links = materialise(attached(forms, judged, estimated(judged)), "p4-links")
    # Every link leads to a form of higher rank, so chains end; each round halves what is left of them.
    while True:
        onward = links.select(F.col("form").alias("to"), F.col("to").alias("next"))
        stepped = materialise(links.select("form", "to").join(onward, "to").select("form", F.col("next").alias("to"), (F.col("to") != F.col("next")).alias("moved")), "p4-links")
        release(links)
        links, done = stepped, stepped.filter("moved").isEmpty()
        if done:
            break
    per_form = named.groupBy("form").agg(F.count("*").alias("held"))
    placed = hot_first_join(named, links.select("form", "to").join(per_form, "form"), "form", "held", named.count()).select("name_id", "to")
    heads = placed.groupBy("to").agg(F.min("name_id").alias("cluster"))
    return placed.join(heads, "to").select("name_id", "cluster")


def same(found: DataFrame) -> DataFrame:
    """(name_a, name_b), smaller first: all pairs of spellings within a cluster of ``clusters``."""
    found = materialise(found, "p4-clusters")
    a = found.select("cluster", F.col("name_id").alias("name_a"))
    b = found.select("cluster", F.col("name_id").alias("name_b"))
    return split_join(a, b, "cluster").filter("name_a < name_b").select("name_a", "name_b")
