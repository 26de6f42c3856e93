"""Exact percentiles per group without sorting a group.

Every group's value range is cut into slices.  Counts by slice (partial
aggregates) and their running sums tell the slice that holds each wanted rank;
only the values of those slices are looked at again, as a histogram of distinct
values.  A window holds the slices of a group, or the distinct values of one
slice, never a group's rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 1024


def exact_quantiles(df: DataFrame, group: Sequence[str], value: str, shares: dict[str, float], slices: int = SLICES) -> DataFrame:
    """One row per group with, per name in ``shares``, the least value that at least this share of the values does not exceed.

    Null values do not count; a group without any has null percentiles.  A null group is a group.
    """
    names = [f"_g{i}" for i in range(len(group))]
    v = F.col(value).cast("double")
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(group, names)], v.alias("_v"))

    def same(a: DataFrame, b: DataFrame, right: str) -> Column:
        on = F.lit(True)
        for n in names:
            on = on & a[n].eqNullSafe(b[f"{n}{right}"])
        return on

    def renamed(right: str) -> list[Column]:
        return [F.col(n).alias(f"{n}{right}") for n in names]

    span = rows.groupBy(*names).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("_v").alias("_n"))
    right = span.select(*renamed("r"), "_lo", "_hi")
    part = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * slices),
                                                       F.lit(slices - 1))).otherwise(F.lit(0))
    sliced = rows.where("_v IS NOT NULL").join(right, same(rows, right, "r")).select(*names, "_v", part.alias("_s"))
    order = Window.partitionBy(*names).orderBy("_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = sliced.groupBy(*names, "_s").agg(F.count("*").alias("_c")).withColumn("_upto", F.sum("_c").over(order))
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(q).alias("q")) for n, q in shares.items()])).alias("_w")
    ranks = span.where("_n > 0").select(*renamed("w"), wanted, "_n").select(
        *[f"{n}w" for n in names], F.col("_w.name").alias("_name"), F.greatest(F.ceil(F.col("_w.q") * F.col("_n")), F.lit(1)).alias("_rank"))
    held = upto.join(ranks, same(upto, ranks, "w") & (F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_c"))).select(
        *renamed("h"), F.col("_s").alias("_sh"), "_name", (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_within"))
    slots = held.select(*[f"{n}h" for n in names], "_sh").distinct()
    values = sliced.join(slots, same(sliced, slots, "h") & (F.col("_s") == F.col("_sh"))).groupBy(*names, "_s", "_v").agg(F.count("*").alias("_c"))
    inner = Window.partitionBy(*names, "_s").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = values.withColumn("_upto", F.sum("_c").over(inner))
    found = values.join(held, same(values, held, "h") & (F.col("_s") == F.col("_sh")) & (F.col("_within") <= F.col("_upto"))
                        & (F.col("_within") > F.col("_upto") - F.col("_c")))
    wide = found.groupBy(*names).agg(*[F.max(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in shares])
    wide = wide.select(*renamed("x"), *shares)
    return span.join(wide, same(span, wide, "x"), "left").select(*[span[n].alias(c) for n, c in zip(names, group)],
                                                                F.col("_n").alias("n_values"), *shares)
