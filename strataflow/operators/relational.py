"""A child level from a table that exists already, without collecting and expanding arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import algebra as A


def expand_from(parents: DataFrame, children: DataFrame, key: str, child_key: str, order: list[str], value: Column) -> DataFrame:
    """(_k0, _k1, o, v, c): parents have _k0; children are ordered in their parent by `order`."""
    rows = children.withColumn("_v", value).join(parents.select("_k0", F.col(key).alias(child_key)), child_key)
    # the join has dealt the rows by this key already, so that they don't move again
    at = F.row_number().over(Window.partitionBy(child_key, "_k0").orderBy(*order)) - 1
    return rows.select("_k0", at.cast("long").alias("_k1"), A.present(F.col("_v")).alias("p")).select("_k0", "_k1", "p.*")


def uncommitted(rows: DataFrame, markers: DataFrame, key: str) -> DataFrame:
    """Rows without a commit marker."""
    return rows.join(markers.select(key).distinct(), key, "left_anti")
