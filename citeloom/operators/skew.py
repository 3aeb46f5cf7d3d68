"""Joins that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.session import materialise, release

#: A key is hot if it holds at least 1/HOT_SHARE of all rows (and HOT_ROWS rows): there are at most HOT_SHARE such
#: keys at any data size. Their rows are broadcast only if they also measure at most HOT_BYTES.
HOT_SHARE = 1000
HOT_ROWS = 20_000
HOT_BYTES = 32 << 20
SALTS = 64
#: Rows of one key, on either side, that meet in one task of ``split_join``.
SIDE = 4_000


def hot_threshold(rows: int) -> int:
    return max(HOT_ROWS, rows // HOT_SHARE)


def hot_first_join(big: DataFrame, small: DataFrame, key: str, n: str, rows: int, how: str = "inner") -> DataFrame:
    """Join of ``big`` with ``small``, which has one row a key and the key's row count in ``big`` in ``n``.

    ``rows`` is the size of ``big`` or more, so at most ``HOT_SHARE`` keys can be hot. Rows of hot keys never move: their
    rows of ``small`` are broadcast if they measure up to ``HOT_BYTES``; else they are copied to ``SALTS`` partitions,
    among which the hot rows of ``big`` are spread. All others meet by an ordinary shuffle join (which adaptive execution
    splits where a partition is large). NULL keys join nothing; with ``how="left"`` rows without a partner stay.
    """
    bound = hot_threshold(rows)
    hot = small.filter(F.col(n) >= bound)
    cold = small.filter(F.col(n) < bound)
    count, size = hot.agg(F.count("*"), F.sum(F.length(F.to_json(F.struct(*[F.col(c) for c in hot.columns]))))).first()
    if not count:
        return big.join(cold, key, how)
    if count > HOT_SHARE:
        raise ValueError("rows is smaller than the big side")
    keys = F.broadcast(hot.select(key))
    rest = big if how == "inner" else big.join(keys, key, "left_anti")  # rows of hot keys have their partner already
    if size <= HOT_BYTES:
        met = big.join(F.broadcast(hot), key)
    else:
        own = F.xxhash64(*[c for c, kind in big.dtypes if "map<" not in kind])  # the same when a lost task runs again
        spread = big.join(keys, key, "left_semi").withColumn("_salt", F.pmod(own, F.lit(SALTS)).cast("int"))
        copied = hot.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = spread.join(copied, [key, "_salt"]).drop("_salt")
    return met.unionByName(rest.join(cold, key, how))


def split_join(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Inner join of two sides that may both hold many rows of a key, such as blocks of candidates.

    A key with over ``SIDE`` rows on a side is cut into tiles of at most about ``SIDE`` x ``SIDE`` pairs, each with a place of its
    own in the shuffle; a row goes to every tile of its row or column. Both sides are read several times: pass written tables.
    Rows must be distinct or at least not all equal, since tiles are chosen by a hash of the row.
    Rows are counted by bucket of keys first, and by key only in buckets of over ``SIDE`` rows: a bucket holds a quarter of that on average.
    """
    most = max(a.count(), b.count())
    if most <= SIDE:
        return a.join(b, key)
    bucket = F.pmod(F.xxhash64(key), F.lit(1 + 4 * most // SIDE))

    def full(side: DataFrame) -> DataFrame:
        return side.filter(F.col(key).isNotNull()).groupBy(bucket.alias("_bucket")).count().filter(F.col("count") > SIDE).select("_bucket")

    suspects = materialise(full(a).unionByName(full(b)).distinct(), "buckets")
    if suspects.isEmpty():
        release(suspects)
        return a.join(b, key)

    def sizes(side: DataFrame, n: str) -> DataFrame:
        return side.withColumn("_bucket", bucket).join(suspects, "_bucket", "left_semi").groupBy(key).agg(F.count("*").alias(n))

    counted = sizes(a, "_na").join(sizes(b, "_nb"), key)
    heavy = counted.filter((F.col("_na") > SIDE) | (F.col("_nb") > SIDE)).select(
        key, "_na", "_nb", F.ceil(F.col("_na") / SIDE).alias("_pa"), F.ceil(F.col("_nb") / SIDE).alias("_pb")
    )
    heavy = materialise(heavy, "blocks")
    release(suspects)
    rows_a, rows_b = heavy.agg(F.sum("_na"), F.sum("_nb")).first()
    if rows_a is None:
        return a.join(b, key)

    def tiled(side: DataFrame, n: str, rows: int, mine: str, other: str) -> DataFrame:
        columns = [F.col(c) for c in side.columns]
        sized = heavy.select(key, n, "_pa", "_pb")
        own = F.pmod(F.xxhash64(*columns), F.coalesce(mine, F.lit(1)))
        all_others = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, F.lit(1)) - 1))
        at = {"_ta": own, "_tb": all_others} if mine == "_pa" else {"_ta": all_others, "_tb": own}
        return hot_first_join(side, sized, key, n, rows, "left").withColumns(at).select(*side.columns, "_ta", "_tb")

    left = tiled(a, "_na", rows_a, "_pa", "_pb")
    right = tiled(b, "_nb", rows_b, "_pb", "_pa")
    return left.join(right, [key, "_ta", "_tb"]).drop("_ta", "_tb")
