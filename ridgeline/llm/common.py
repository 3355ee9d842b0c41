"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: bytes.translate table: lower-cases A-Z, blanks every ASCII byte that is no letter or digit.
#: Bytes of multi-byte characters stay, so splitting on blanks gives the words of WORD.
WORD_BYTES = bytes(
    (b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32) for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, UTF-8 encoded; none for a null."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def is_held_out(doc_id: Column | str) -> Column:
    """Rows whose crc32 of doc_id as text leaves 2 after division by 4."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % 4 == 2


_KEPT: dict[str, Callable[[], object]] = {}


def keeps(operator: str, release: Callable[[], object]) -> None:
    """Names what lets go of the state that an operator keeps in a Python worker between its tasks."""
    _KEPT[operator] = release


def begins(operator: str) -> None:
    """Called by the operator's tasks: workers serve one operator after another, and the others' state goes."""
    for name, release in _KEPT.items():
        if name != operator:
            release()


def shared_dir(spark: SparkSession) -> str:
    """A folder of this session under spark.checkpoint.dir. Where that is unset, a session in one process gets a temporary
    folder; on a cluster that is an error, since executors would not see each other's files."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="ridgeline-")
        spark.conf.set("spark.checkpoint.dir", root)
    app = spark.sparkContext.applicationId
    return f"{root.rstrip('/')}/ridgeline-{app}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets; removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may have ended before
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that `written` made, once nothing reads them any more."""
    for df in tables:
        _remove(df.sparkSession, df.stored_at)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
