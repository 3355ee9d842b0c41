"""Live profile: a stream over a growing log folder, aggregated to the best value of each cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.config import Projection
from ridgeline.operators.grid import with_cells
from ridgeline.sources.store import shared_root


def live_profile(spark: SparkSession, folder: str, schema: T.StructType, p: Projection, max_files: int = 1) -> DataFrame:
    """A streaming DataFrame: cell, logl, n. State is one row per active cell."""
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)
    return with_cells(log, p).groupBy(*p.cells).agg(F.max("logl").alias("logl"), F.count("*").alias("n"))


def run_available(profile: DataFrame, name: str, checkpoint: str | None = None) -> DataFrame:
    """Processes what is there in micro-batches and returns the final state of the stream."""
    spark = profile.sparkSession
    root = checkpoint or shared_root(spark)
    q = (
        profile.writeStream.format("memory").queryName(name).outputMode("complete")
        .option("checkpointLocation", f"{root.rstrip('/')}/stream-{name}-{spark.sparkContext.applicationId}").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.table(name)
