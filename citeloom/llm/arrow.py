"""Python operators over rows with an identifier of any type."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Fn = Callable[[Iterator[pd.DataFrame]], Iterable[pd.DataFrame]]


def map_with_ids(df: DataFrame, ids: dict[str, str], others: tuple[str, ...], fn: Fn, schema: str) -> DataFrame:
    """``mapInPandas`` over the columns ``ids`` and ``others`` of ``df``; ``fn`` yields ``ids`` and the columns of ``schema``.

    ``ids`` maps the identifiers' names in the output to their types. They travel as text, so that NULL stays NULL and no
    number loses digits (pandas would make floats of integers with gaps).
    """
    inside = df.select(*[F.col(c).cast("string").alias(c) for c in ids if c in df.columns], *others)
    out = inside.mapInPandas(fn, ", ".join([*(f"`{c}` string" for c in ids), schema]))
    return out.withColumns({c: F.col(c).cast(kind) for c, kind in ids.items()})
