"""Running sums and repeated rows that put no large group into one task; native."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.plans.scale import broadcast_if_small, written

#: Rows that a task orders at once, and copies that it makes of a row.
PER_BUCKET, CHUNK = 1 << 16, 10_000


def running_start(df: DataFrame, by: list[str], order: list[str], amount: str, per_bucket: int = PER_BUCKET) -> DataFrame:
    """df with __start: the sum of `amount` over the rows of the same group (`by`, no nulls) that come before, in a fixed order.

    A group is dealt by a hash of `order` to as many buckets as its count asks for; a row's start is its bucket's plus what
    comes before it in there. Rows that agree in `order` share a bucket, so they should be one row with their number.
    df is read three times, so it should be a written table.
    """
    groups = df.groupBy(*by).agg(F.ceil(F.count("*") / F.lit(per_bucket)).cast("long").alias("__buckets"))
    dealt = df.join(broadcast_if_small(written(groups, "running-groups")), by).withColumn("__bucket", F.pmod(F.xxhash64(*order), F.col("__buckets")))
    sums = dealt.groupBy(*by, "__bucket").agg(F.sum(amount).alias("__sum"))
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(sums.select(*by, "__bucket", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset")), "running-offsets")
    inside = Window.partitionBy(*by, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    started = dealt.withColumn("__inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    out = started.join(broadcast_if_small(offsets), [*by, "__bucket"]).withColumn("__start", F.col("__offset") + F.col("__inside"))
    return out.drop("__buckets", "__bucket", "__inside", "__offset")


def repeated(df: DataFrame, times: str, index: str) -> DataFrame:
    """Each row `times` times (0: not at all), with index 1, 2, ...; many copies of a row are made by many tasks.

    df is read twice, so it should be a written table.
    """
    few = df.where((F.col(times) > 0) & (F.col(times) <= CHUNK)).withColumn(index, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times).cast("long"))))
    parts = df.where(F.col(times) > CHUNK).withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / CHUNK))))
    dealt = parts.repartition(F.xxhash64("__part"))
    each = F.sequence(F.col("__part") * CHUNK + 1, F.least(F.col(times).cast("long"), (F.col("__part") + 1) * CHUNK))
    return few.unionByName(dealt.withColumn(index, F.explode(each)).drop("__part"))
