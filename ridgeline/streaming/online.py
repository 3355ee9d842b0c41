"""Stateful operators over a growing log: a registry of optima with its stop rule, and a capped pool of best points.

Both keep their state in the stream's state store, keyed by a shard of the log, and go on from the checkpoint after a
restart: the result of a stream that stopped half way and began anew is that of one run over all rows. A key's rows are
handled in the order of `seq` inside a micro-batch, so results depend on which files make a batch only if a later file
holds an earlier `seq`.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from ridgeline.plans import kernels as K

POINT = ArrayType(DoubleType())


class OptimaRegistry(StatefulProcessor):
    """Leader clustering of finished runs (seq, x, value, converged) with the rule that stops a multistart.

    Output for each batch and key: the registry's entries, how many runs were taken and whether the rule holds. Runs that
    come after the rule held are not taken.
    """

    OUTPUT = StructType([
        StructField("key", LongType()), StructField("entry", IntegerType()), StructField("point", POINT), StructField("value", DoubleType()),
        StructField("count", LongType()), StructField("runs", LongType()), StructField("stopped", IntegerType()),
    ])

    def __init__(self, bounds: list[tuple[float, float]], radius: float, roi: float, min_starts: int, undiscovered: float, optima: tuple | None = None):
        self.bounds, self.radius, self.rule = np.array(bounds, float), radius, (roi, min_starts, undiscovered, optima)

    def init(self, handle: StatefulProcessorHandle) -> None:
        entry = StructType([StructField("point", POINT), StructField("value", DoubleType()), StructField("count", LongType())])
        self.entries = handle.getListState("entries", entry)
        self.seen = handle.getValueState("seen", StructType([StructField("runs", LongType()), StructField("stopped", IntegerType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs, stopped = self.seen.get() if self.seen.exists() else (0, 0)
        span = self.bounds[:, 1] - self.bounds[:, 0]
        registry = []
        for e in self.entries.get() if self.entries.exists() else ():
            point = np.array(e[0], float)
            registry.append({"point": point, "unit": (point - self.bounds[:, 0]) / span, "value": e[1], "count": e[2]})
        batch = pd.concat(list(rows)).sort_values("seq")
        roi, least, undiscovered, optima = self.rule
        for r in batch.itertuples(index=False):
            if stopped:
                break
            runs += 1
            if r.converged and np.isfinite(r.value):
                K.register_optimum(registry, np.array(r.x, float), float(r.value), self.bounds, self.radius)
            stopped = int(K.should_stop(registry, runs, roi, least, undiscovered, optima))
        self.entries.put([([float(v) for v in e["point"]], float(e["value"]), int(e["count"])) for e in registry])
        self.seen.update((int(runs), int(stopped)))
        yield pd.DataFrame(
            [(key[0], k, [float(v) for v in e["point"]], float(e["value"]), int(e["count"]), int(runs), int(stopped)) for k, e in enumerate(registry)],
            columns=[f.name for f in self.OUTPUT],
        )

    def close(self) -> None:
        pass


class BestPoints(StatefulProcessor):
    """The `capacity` best points (seq, x, value) of a key, the earlier of equals, and how many came in all.

    A key's state is at most `capacity` points. A table's best points are the best of its keys' best.
    """

    OUTPUT = StructType([
        StructField("key", LongType()), StructField("rank", IntegerType()), StructField("seq", LongType()), StructField("x", POINT),
        StructField("value", DoubleType()), StructField("came", LongType()),
    ])

    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        point = StructType([StructField("seq", LongType()), StructField("x", POINT), StructField("value", DoubleType())])
        self.points = handle.getListState("points", point)
        self.came = handle.getValueState("came", StructType([StructField("n", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = [(-p[2], p[0], list(p[1])) for p in self.points.get()] if self.points.exists() else []
        came = self.came.get()[0] if self.came.exists() else 0
        for part in rows:
            came += len(part)
            best += [(-float(r.value), int(r.seq), [float(v) for v in r.x]) for r in part.itertuples(index=False)]
            best = sorted(best)[: self.capacity]
        self.points.put([(s, x, -v) for v, s, x in best])
        self.came.update((int(came),))
        yield pd.DataFrame([(key[0], k, s, x, -v, int(came)) for k, (v, s, x) in enumerate(best)], columns=[f.name for f in self.OUTPUT])

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which stateful processors need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def online(stream: DataFrame, key: str, processor: StatefulProcessor) -> DataFrame:
    """stream through a processor, keyed by `key` (long): each batch gives the new state of the keys that it touches."""
    return stream.groupBy(key).transformWithStateInPandas(processor, outputStructType=processor.OUTPUT, outputMode="Update", timeMode="None")


def run_online(updates: DataFrame, path: str, checkpoint: str, batches: int | None = None) -> None:
    """Processes what is there and appends the updates, with their batch's number, to a Parquet table at path.

    batches stops the stream after so many: it goes on from the checkpoint when called again. A batch that is repeated
    after a failure replaces its own rows.
    """
    done: list[int] = []

    def sink(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        done.append(batch)

    q = updates.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", checkpoint)
    if batches is None:
        q.trigger(availableNow=True).start().awaitTermination()
        return
    running = q.start()
    while running.isActive and len(done) < batches:
        running.awaitTermination(1)
    running.stop()


def latest(spark: SparkSession, path: str, per: str = "key") -> DataFrame:
    """The last update of each key in a table that run_online wrote."""
    d = spark.read.parquet(path)
    last = d.groupBy(per).agg(F.max("batch").alias("batch"))
    return d.join(last, [per, "batch"]).drop("batch")
