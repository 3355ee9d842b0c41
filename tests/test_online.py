import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.plans import kernels as K
from ridgeline.streaming import online as O

BOX = [(-5.0, 5.0)] * 2


@pytest.fixture
def rocks(spark):
    with O.rocksdb(spark):
        yield


def runs(n=90, seed=3):
    rng = np.random.default_rng(seed)
    peaks = np.array([(3.0, 2.0), (-3.0, -3.0), (3.0, -2.0)])
    return [(k, k % 2, (peaks[k % 3] + rng.normal(0, 0.02, 2)).tolist(), -float(rng.random() / 10), bool(rng.random() > 0.1)) for k in range(n)]


def logged(spark, folder, files=6):
    rows, schema = runs(), "seq long, key long, x array<double>, value double, converged boolean"
    for i in range(files):  # files in the order of seq
        part = rows[i * len(rows) // files : (i + 1) * len(rows) // files]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return rows, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def registry(rows, radius=0.02, roi=4.0):
    box, entries, n = np.array(BOX), [], 0
    for _, _, x, v, converged in rows:
        n += 1
        if converged:
            K.register_optimum(entries, np.array(x), v, box, radius)
        if K.should_stop(entries, n, roi, 10, 0.5, None):
            return entries, n, 1
    return entries, n, 0


def test_registry_goes_on_from_its_checkpoint(spark, tmp_path, rocks):
    rows, stream = logged(spark, f"{tmp_path}/log")
    updates = O.online(stream, "key", O.OptimaRegistry(BOX, 0.02, 4.0, 10, 0.5))
    O.run_online(updates, f"{tmp_path}/out", f"{tmp_path}/check", batches=2)
    half = {r.key: r.runs for r in O.latest(spark, f"{tmp_path}/out").collect()}
    assert 0 < sum(half.values()) < len(rows)
    O.run_online(updates, f"{tmp_path}/out", f"{tmp_path}/check")
    got = O.latest(spark, f"{tmp_path}/out").collect()
    for key in (0, 1):
        entries, n, stopped = registry([r for r in rows if r[1] == key])
        mine = sorted((r for r in got if r.key == key), key=lambda r: r.entry)
        assert [(r.point, r["count"]) for r in mine] == [(e["point"].tolist(), e["count"]) for e in entries]
        assert {(r.runs, r.stopped) for r in mine} == {(n, stopped)}


def test_best_points_are_capped_and_go_on(spark, tmp_path, rocks):
    rows, stream = logged(spark, f"{tmp_path}/log")
    updates = O.online(stream.drop("converged"), "key", O.BestPoints(7))
    O.run_online(updates, f"{tmp_path}/out", f"{tmp_path}/check", batches=3)
    O.run_online(updates, f"{tmp_path}/out", f"{tmp_path}/check")
    got = O.latest(spark, f"{tmp_path}/out")
    for key in (0, 1):
        want = sorted((-r[3], r[0]) for r in rows if r[1] == key)[:7]
        mine = got.filter(F.col("key") == key).orderBy("rank").collect()
        assert [(-r.value, r.seq) for r in mine] == want and {r.came for r in mine} == {45}
