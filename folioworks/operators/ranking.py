"""Running values over an order, for groups of any size.

A window sorts each group in one task, which is wrong where a single archive, file or batch may hold a third of all rows.
`ordered_scan` is a two-level scan: range-partition by (group, order), scan every slice of a group on its own, then add
what the group's earlier slices carry over. A group has at most as many slices as there are partitions, so the carry
table stays small whatever the group's size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.session import durable


def ordered_scan(df: DataFrame, keys: list[str], order: list[str],
                 measures: dict[str, tuple[str, Column | None]]) -> DataFrame:
    """Add running measures to `df`, per `keys`, along `order` (columns whose values are unique within a group).

    Kinds: `number` (1, 2, …), `sum` (inclusive), `before` (last non-NULL value strictly earlier), `size` (rows of the
    group).
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _sliced(df, keys, order, measures, slices)


def _measure(kind: str, value: Column | None, window) -> Column:
    if kind == "number":
        return F.row_number().over(window).cast("bigint")
    if kind == "size":
        return F.count(F.lit(1)).over(window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    if kind == "sum":
        return F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return F.last(value, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))


def _windowed(df, keys, order, measures):
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.select("*", *[_measure(kind, value, window).alias(name) for name, (kind, value) in measures.items()])


def _sliced(df, keys, order, measures, slices):
    values = {name: f"_v_{name}" for name, (kind, value) in measures.items() if value is not None}
    ranged = df.select("*", *[measures[name][1].alias(col) for name, col in values.items()])
    # Slice numbers must not change between the two uses below, hence a durable copy.
    ranged = durable(ranged.repartitionByRange(slices, *keys, *order).withColumn("_slice", F.spark_partition_id()))
    inputs = {name: (kind, F.col(values[name]) if name in values else None) for name, (kind, _) in measures.items()}
    local = _windowed(ranged, [*keys, "_slice"], order, inputs)

    def total(name, kind):
        if kind in ("number", "size"):
            return F.count(F.lit(1))
        if kind == "sum":
            return F.sum(values[name])
        return F.max_by(F.col(values[name]), F.when(F.col(values[name]).isNotNull(), F.struct(*order)))

    def carried(name, kind, window):
        column = F.col(f"_t_{name}")
        if kind == "size":
            return F.sum(column).over(Window.partitionBy(*keys)) - column
        return F.last(column, ignorenulls=True).over(window) if kind == "before" else F.sum(column).over(window)

    totals = ranged.groupBy(*keys, "_slice").agg(
        *[total(name, kind).alias(f"_t_{name}") for name, (kind, _) in measures.items()])
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "_slice", *[carried(name, kind, earlier).alias(f"_c_{name}")
                                             for name, (kind, _) in measures.items()])
    on = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "_slice"]])
    joined = local.alias("l").join(carry.alias("c"), on)
    out = []
    for name, (kind, _) in measures.items():
        here, before = F.col(f"l.{name}"), F.col(f"c._c_{name}")
        out.append((F.coalesce(here, before) if kind == "before" else
                    F.when(before.isNull(), here).otherwise(F.coalesce(here, F.lit(0)) + before)).alias(name))
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], *out)
