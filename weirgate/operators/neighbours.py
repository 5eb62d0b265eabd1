"""The row before or after a row of its entity, where one entity may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_neighbour(df: DataFrame, entity: str, order: list[str], held: Column, cell: Column, later: bool = False) -> DataFrame:
    """``df`` with ``_beside``: the struct ``held`` of the row before (``later``: after) in ``order``, null where there is none.

    Rows are sorted within cells of an entity, which must not fall as
    ``order`` rises; the first row of a cell takes the end of the cell before
    it. So no task sorts a whole entity, only the ends of its cells. Nulls come
    first, in cells as in the order; a null entity is one of its own.
    """
    by = (lambda c: F.col(c).desc()) if later else (lambda c: F.col(c).asc())
    rows = df.withColumn("_cell", cell)
    inside = rows.withColumn("_in", F.lag(held).over(Window.partitionBy(entity, "_cell").orderBy(*map(by, order))))
    end = (F.min_by if later else F.max_by)(held, F.struct(*order))
    ends = rows.groupBy(F.col(entity).alias("_e"), F.col("_cell").alias("_c")).agg(end.alias("_end"))
    carried = ends.select("_e", "_c", F.lag("_end").over(Window.partitionBy("_e").orderBy(by("_c"))).alias("_carry"))
    both = inside.join(carried, F.col(entity).eqNullSafe(F.col("_e")) & F.col("_cell").eqNullSafe(F.col("_c")), "left")
    return both.select(*df.columns, F.coalesce("_in", "_carry").alias("_beside"))
