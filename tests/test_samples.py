import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.sources import samples as L


def frame(spark, rows, cols):
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], cols)


def test_formats():
    assert [L.infer_format(p) for p in ("a.csv", "a.CSV", "b.h5", "b.hdf5", "b.he5", "none", "w.txt", "x.parquet")] == ["csv", "csv", "hdf5", "hdf5", "hdf5", "csv", "csv", "parquet"]
    with pytest.raises(ValueError):
        L._format("a", "xml")
    with pytest.raises(ImportError, match="h5py"):
        L._format("a.h5", None)


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_round_trip_append_and_refusals(spark, tmp_path, fmt):
    cols = L.log_columns(5, phase=False)
    x = np.random.default_rng(0).normal(size=(50, 5))
    x[3, 4] = -np.inf
    path = f"{tmp_path}/log"
    L.write_log(frame(spark, x[:20], cols), path, fmt)
    L.write_log(frame(spark, x[20:], cols), path, fmt, "append")
    got = np.array(sorted(map(tuple, L.read_log(spark, path, cols, fmt).collect())))
    assert np.allclose(got, np.array(sorted(map(tuple, x))), rtol=1e-9)
    with pytest.raises(Exception):
        L.write_log(frame(spark, x, cols), path, fmt)
    with pytest.raises(Exception):
        L.read_log(spark, path, cols[:-1], fmt).collect()


def test_batches_and_combine(spark, tmp_path):
    cols = L.log_columns(3, phase=False)
    df = frame(spark, np.arange(750).reshape(250, 3), cols).coalesce(1)
    assert [len(b) for b in L.batches(df, 100)] == [100, 100, 50]
    for k in range(3):
        L.write_log(df.limit(40), f"{tmp_path}/{k}")
    n = L.combine_files(spark, [f"{tmp_path}/{k}" for k in range(3)] + [f"{tmp_path}/missing"], f"{tmp_path}/all", cols)
    assert n == 120
    with pytest.raises(ValueError):
        L.combine_files(spark, ["a"], "a", cols)
    with pytest.raises(ValueError):
        L.combine([df, df.drop("logl")])


def test_json():
    assert L.to_json({"a": (1.0, float("inf")), 2: np.float64("nan")}) == '{\n "2": null,\n "a": [\n  1.0,\n  null\n ]\n}'


def test_log_writer_commits_whole_writes(spark, tmp_path):
    from ridgeline.sources.log_writer import LogWriter

    path, cols = f"{tmp_path}/log", ["x0", "logl", "phase"]
    d = spark.range(40).selectExpr("id / 7.0D AS x0", "CASE WHEN id = 3 THEN double('-inf') ELSE -id END AS logl", "cast(id % 3 AS int) AS phase")
    with LogWriter(spark, path) as log:
        log.write_batch(d.repartition(4))
        log.write_batch(d.limit(5))
        log.flush()
        with pytest.raises(ValueError, match="columns"):
            log.write_batch(d.select("x0"))
    log.close()
    log.close()
    with pytest.raises(ValueError, match="closed"):
        log.write_batch(d)
    back = L.read_log(spark, path, cols, "csv")
    assert back.count() == 45 and back.filter("logl = double('-inf')").count() == 2
    assert abs(back.agg({"x0": "sum"}).first()[0] - (d.agg({"x0": "sum"}).first()[0] + d.limit(5).agg({"x0": "sum"}).first()[0])) < 1e-6

    @F.udf("double")
    def fails(i):
        if i == 39:
            raise RuntimeError("this task fails")
        return float(i)

    bad = spark.range(0, 40, 1, 4).select(fails("id").alias("x0"), F.lit(0.0).alias("logl"), F.lit(1).alias("phase"))
    with pytest.raises(Exception, match="this task fails"):
        LogWriter(spark, path).write_batch(bad)
    assert L.read_log(spark, path, cols, "csv").count() == 45  # the tasks that ended left nothing


def test_volume_output(spark, tmp_path):
    import json

    band = spark.createDataFrame([(0.0, 1.0, -0.5), (0.5, 1.0, -1.5)], "x0 double, x1 double, logl double")
    out, where = L.write_volume_output(band, {"n_samples": 2, "drift": float("inf")}, f"{tmp_path}/v.csv")
    assert L.read_log(spark, out, ["x0", "x1", "logl"]).count() == 2 and where == f"{tmp_path}/v_summary.json"
    summary = json.loads("\n".join(r.value for r in spark.read.text(where, wholetext=True).collect()))
    assert summary == {"n_samples": 2, "drift": None, "output_file": out}
    with pytest.warns(UserWarning, match="replaced"):
        L.write_volume_output(band.limit(1), {"n_samples": 1}, f"{tmp_path}/v.csv")
    assert L.read_log(spark, out, ["x0", "x1", "logl"]).count() == 1
    out, where = L.write_volume_output(band.limit(0), {"n_samples": 0}, f"{tmp_path}/none.csv", f"{tmp_path}/s.json")
    assert out is None and not (tmp_path / "none.csv").exists() and (tmp_path / "s.json").exists()
