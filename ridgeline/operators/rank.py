"""Global ranks without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.sources.store import stored


def ranked(df: DataFrame, order: list[Column | str], name: str = "rank", partitions: int | None = None) -> tuple[DataFrame, int]:
    """df, stored, with each row's place (from 0) in a total order, and the number of rows.

    Rows are dealt by ranges of the order and sorted there; a place is the number of rows in earlier partitions, of
    which the driver sees one count each, plus the place inside. The order must be total for places to be unique facts.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    dealt = stored(dealt, "ranked")
    part = F.call_function("shiftright", F.col("__at"), F.lit(33))
    counts = {r["p"]: r["c"] for r in dealt.groupBy(part.alias("p")).agg(F.count("*").alias("c")).collect()}
    before, total = {}, 0
    for p in sorted(counts):
        before[p], total = total, total + counts[p]
    if not total:
        return dealt.withColumn(name, F.lit(0).cast("long")).drop("__at"), 0
    starts = F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv])
    return dealt.withColumn(name, F.element_at(starts, part) + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at"), total
