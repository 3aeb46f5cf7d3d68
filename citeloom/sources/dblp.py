"""DBLP search responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.schemas import DBLP_RESPONSE


def read_hits(responses: DataFrame, key: str = "key") -> DataFrame:
    """``dblp`` rows (key, hit_pos, info) of (key, json); ``key`` may be any other column, such as the search.

    A response counts only if its total is above zero and it lists hits; broken JSON gives none. A hit with a single
    author as an object has no author list, as before.
    """
    parsed = responses.select(key, F.from_json("json", DBLP_RESPONSE).alias("r")).select(key, "r.result.hits")
    total = F.try_to_number(F.col("hits.@total"), F.lit("999999999999"))
    listed = parsed.filter((F.coalesce(total, F.lit(0)) > 0) & (F.size("hits.hit") > 0))
    return listed.select(key, F.posexplode("hits.hit").alias("hit_pos", "h")).select(key, "hit_pos", F.col("h.info").alias("info"))
