"""How many records fill each field."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.schema import JATS_PATHS


def field_coverage(records: DataFrame, fields: Iterable[str] = JATS_PATHS) -> DataFrame:
    """``(field, filled, empty, n_values)`` of list columns, in one pass over ``records``.

    A null list and a list without elements are empty; ``n_values`` counts the elements.
    All counts are one aggregate that combines before the shuffle, whatever the number
    of fields. A table without rows has a row of zeros for each field.
    """
    def counted(field: str) -> list:
        size = F.greatest(F.coalesce(F.size(F.col(f"`{field}`")), F.lit(0)), F.lit(0))
        return [F.count_if(size > 0), F.count_if(size == 0), F.coalesce(F.sum(size), F.lit(0))]

    names = ["filled", "empty", "n_values"]
    rows = F.array(*[
        F.struct(F.lit(f).alias("field"), *[c.alias(n) for c, n in zip(counted(f), names, strict=True)])
        for f in fields
    ])
    return records.agg(rows.alias("_fields")).select(F.explode("_fields").alias("_f")).select("_f.*")
