"""Evaluation logs: read, write, combine, export. Rows are parameters, value and, in full logs, the phase."""

from __future__ import annotations

import json
import math
import warnings
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text logs: fixed format of a number, and of a row.
NUMBER, DELIMITER = "%.10e", ", "
HDF5 = (".h5", ".hdf5", ".he5")
FORMATS = ("csv", "parquet", "hdf5")


def infer_format(path: str) -> str:
    low = path.lower()
    return "hdf5" if low.endswith(HDF5) else "parquet" if low.endswith(".parquet") else "csv"


def _format(path: str, fmt: str | None) -> str:
    fmt = fmt or infer_format(path)
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known: {', '.join(FORMATS)}")
    if fmt == "hdf5":
        try:
            import h5py  # noqa: F401
        except ImportError as e:
            raise ImportError("HDF5 logs need the optional package h5py; write Parquet instead") from e
    return fmt


def log_columns(width: int, phase: bool = True) -> list[str]:
    k = width - 1 - phase
    return [*(f"x{i}" for i in range(k)), "logl", *(["phase"] if phase else [])]


def log_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.DoubleType()) for c in columns])


def text_line(columns: list[str]) -> Column:
    """A row as text; infinite values are spelled out, as number formats have no digits for them."""
    cells = []
    for c in columns:
        x = F.col(c).cast("double")
        cells.append(F.when(x == float("-inf"), "-inf").when(x == float("inf"), "inf").when(F.isnan(x) | x.isNull(), "nan").otherwise(F.format_string(NUMBER, x)))
    return F.concat_ws(DELIMITER, *cells)


def write_log(df: DataFrame, path: str, fmt: str | None = None, mode: str = "errorifexists") -> None:
    """mode: errorifexists, overwrite, or append to a log of the same width."""
    fmt = _format(path, fmt)
    if fmt == "hdf5":
        raise NotImplementedError("HDF5 is read only; write Parquet")
    if fmt == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        df.select(text_line(df.columns).alias("value")).write.mode(mode).text(path)


def read_log(spark: SparkSession, path: str, columns: list[str], fmt: str | None = None) -> DataFrame:
    """A log with these columns, all double but the phase; an empty folder of text is an empty log."""
    fmt = _format(path, fmt)
    if fmt == "parquet":
        df = spark.read.parquet(path)
        if len(df.columns) != len(columns):
            raise ValueError(f"{path} has {len(df.columns)} columns, not {len(columns)}")
        df = df.toDF(*columns)
    elif fmt == "csv":
        raw = spark.read.text(path).filter(F.trim("value") != "")
        cells = F.split("value", r"\s*,\s*")
        wrong = F.size(cells) != len(columns)
        number = lambda k: F.when(
            wrong, F.raise_error(F.concat(F.lit("a row has another width: "), F.col("value"))).cast("double")
        ).otherwise(F.get(cells, F.lit(k)).cast("double"))
        df = raw.select(*[number(k).alias(c) for k, c in enumerate(columns)])
    else:
        df = _read_hdf5(spark, path, columns)
    return df.withColumn("phase", F.col("phase").cast("int")) if "phase" in columns else df


def _read_hdf5(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    import h5py

    with h5py.File(path) as f:
        rows = len(f["samples"])
    starts = spark.range(0, max(rows, 1), 100_000)

    def chunk(frames):
        import pandas as pd

        for pdf in frames:
            with h5py.File(path) as f:
                for at in pdf["id"]:
                    yield pd.DataFrame(f["samples"][at : at + 100_000], columns=columns)

    return starts.mapInPandas(chunk, log_schema(columns))


def batches(df: DataFrame, size: int = 10_000) -> Iterator[list]:
    """Rows in blocks, one partition in the driver at a time."""
    block = []
    for row in df.toLocalIterator():
        block.append(tuple(row))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def combine(logs: list[DataFrame]) -> DataFrame:
    """UNION ALL of logs of one width: order inside each log and duplicates stay."""
    widths = {len(d.columns) for d in logs}
    if len(widths) > 1:
        raise ValueError(f"logs of different widths: {sorted(widths)}")
    return reduce(DataFrame.union, logs)


def combine_files(spark: SparkSession, inputs: list[str], output: str, columns: list[str], fmt: str | None = None) -> int:
    """Combines the logs that exist; returns the number of rows."""
    if output in inputs:
        raise ValueError("the output is one of the inputs")
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    found = [p for p in inputs if path(p).getFileSystem(conf).exists(path(p))]
    if not found:
        return 0
    write_log(combine([read_log(spark, p, columns) for p in found]), output, fmt)
    return read_log(spark, output, columns, fmt).count()


def json_safe(x):
    """Non-finite numbers become null, tuples lists, keys text."""
    if isinstance(x, dict):
        return {str(k): json_safe(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [json_safe(v) for v in x]
    if hasattr(x, "item") and not isinstance(x, (str, bytes)):
        x = x.item()
    return None if isinstance(x, float) and not math.isfinite(x) else x


def to_json(summary: dict) -> str:
    return json.dumps(json_safe(summary), indent=1, sort_keys=True)


def default_summary_file(output: str) -> str:
    """output with `_summary.json` for its extension."""
    folder, _, name = output.rpartition("/")
    stem = name.rpartition(".")[0] or name
    return f"{folder}/{stem}_summary.json" if folder else f"{stem}_summary.json"


def write_volume_output(band: DataFrame, summary: dict, output: str, summary_file: str | None = None) -> tuple[str | None, str]:
    """Writes a band of samples, unless it has none, in the format of the extension, replacing what is there, and the
    summary as one JSON text; the two paths, the first None without samples."""
    spark = band.sparkSession
    if summary["n_samples"]:
        path = spark._jvm.org.apache.hadoop.fs.Path(output)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            warnings.warn(f"{output} is replaced", stacklevel=2)
        write_log(band, output, mode="overwrite")
    written = output if summary["n_samples"] else None
    where = summary_file or default_summary_file(output)
    text = to_json({**summary, "output_file": written})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(where)
    return written, where


def dense(profile: DataFrame, grid: DataFrame, cells: list[str], value: str = "logl") -> DataFrame:
    """Every cell of the grid, NaN where the profile has none."""
    out = grid.join(profile.select(*cells, value), cells, "left")
    return out.withColumn(value, F.coalesce(value, F.lit(float("nan"))))
