"""Results and their merging across vaults: a cap per vault, a total order, a cap of all, and whether either cut."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.errors import EngineError


@dataclass
class Result:
    """Rows in order, and what a caller may ask besides. `truncated` runs a count when called."""

    rows: DataFrame
    cut: DataFrame | None = None
    hint: str | None = None
    partial: dict = field(default_factory=dict)

    def truncated(self) -> bool:
        """Did a limit leave rows out? cut: a row if so."""
        return self.cut is not None and bool(self.cut.take(1))


def check_limit(limit: int, most: int = 1000, name: str = "limit") -> int:
    if not 1 <= limit <= most:
        raise EngineError("invalid_request", f"{name} must be from 1 to {most}")
    return limit


def per_vault(rows: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """At most limit rows of each vault; the window is pruned before its shuffle."""
    rank = F.row_number().over(Window.partitionBy("vault").orderBy(*order))
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= limit).drop("__rank")


def merged(rows: DataFrame, order: Sequence[Column], limit: int) -> Result:
    """The first rows in a total order. limit + 1 rows of any one vault imply as many of all, so one cap tells."""
    return Result(rows.orderBy(*order).limit(limit), rows.limit(limit + 1).groupBy().count().where(F.col("count") > limit))
