import gzip
import hashlib
import os

import pytest
from oracle import check_oracle

from ridgeline.llm import warc as W

PAGES = "page_id long, url string, html string"
BIG = "<p>é" + "x" * 1200
ROWS = [
    (1, "http://a/\r\nb ü", BIG), (5, None, BIG), (3, "http://c", BIG), (3, "http://c", BIG), (7, "u", "small"), (8, "u", "small"),
    (9, "u", None), (10, "u", ""), (None, "u", BIG), (None, None, "y" * 2000), (11, "u", "long " * 40000), (5, None, BIG),
]


def test_oracle(spark, sf):
    check_oracle(spark, W.op4_warc, W.OP4_SQL, sf)


def archive(spark, rows, path, **k):
    return W.write_warc(spark.createDataFrame(rows, PAGES).repartition(3), path, **k)


def test_round_trip_and_edges(spark, tmp_path):
    out = f"{tmp_path}/a"
    archive(spark, ROWS, out)
    rows = W.read_warc(spark, out).collect()
    assert len(rows) == len(ROWS)
    kinds = {}
    for r in rows:
        kinds.setdefault(r.page_id, set()).add((r.record_type, r.refers_to))
    assert kinds[1] == kinds[3] == {("revisit", 5)} and kinds[5] == {("response", None)}
    assert kinds[7] == kinds[8] == kinds[9] == {("response", None)}
    assert kinds[None] == {("revisit", 5), ("response", None)}
    sizes = {(r.page_id, r.payload_bytes, r.payload_digest) for r in rows}
    assert (1, len(BIG.encode()), hashlib.sha1(BIG.encode()).hexdigest()) in sizes and (9, 0, hashlib.sha1(b"").hexdigest()) in sizes
    assert {r.html for r in rows if r.page_id == 5} == {BIG}


def test_deterministic_files_rolling_and_manifest(spark, tmp_path):
    rows = [(i, f"http://x/{i}", hashlib.sha256(str(i).encode()).hexdigest() * 40) for i in range(300)]
    a = archive(spark, rows, f"{tmp_path}/a", roll_bytes=5000, shard_bytes=200_000)
    b = W.write_warc(spark.createDataFrame(rows[::-1], PAGES).repartition(7), f"{tmp_path}/b", roll_bytes=5000, shard_bytes=200_000)
    assert a == b and len(a) > 4 and sum(f["records"] for f in a) == 300
    names = {n for n in os.listdir(f"{tmp_path}/a") if not n.endswith(".crc")}
    assert names == {f["name"] for f in a} | {"_MANIFEST.json"}
    for f in a:
        raw = open(f"{tmp_path}/a/{f['name']}", "rb").read()
        assert hashlib.sha256(raw).hexdigest() == f["sha256"] and len(raw) == f["bytes"]
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_same_files_whatever_the_settings(spark, tmp_path):
    rows = [(i, f"http://x/{i}", str(i) * 900) for i in range(100)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        a = archive(spark, rows, f"{tmp_path}/a", shard_bytes=20_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert a == archive(spark, rows, f"{tmp_path}/b", shard_bytes=20_000) and len(a) > 4


def test_reads_what_the_manifest_commits(spark, tmp_path):
    rows = [(i, f"http://x/{i}", str(i) * 900) for i in range(60)]
    out = f"{tmp_path}/a"
    files = archive(spark, rows, out, shard_bytes=20_000)
    stray = f"{out}/zzz-0000.warc.gz"  # a failed attempt's file
    open(stray, "wb").write(gzip.compress(b"WARC/1.1\r\n"))
    assert W.read_warc(spark, out).count() == 60
    path = f"{out}/{files[1]['name']}"
    whole = open(path, "rb").read()
    os.path.exists(f"{out}/.{files[1]['name']}.crc") and os.remove(f"{out}/.{files[1]['name']}.crc")
    for damaged in (whole[:-40], whole + whole, None):
        os.remove(path) if damaged is None else open(path, "wb").write(damaged)
        with pytest.raises(Exception):
            W.read_warc(spark, out).count()
    open(path, "wb").write(whole)
    assert W.read_warc(spark, out).count() == 60
    os.remove(f"{out}/_MANIFEST.json")
    with pytest.raises(ValueError):
        W.read_warc(spark, out)


def test_empty_and_clashing(spark, tmp_path):
    assert archive(spark, [], f"{tmp_path}/e") == []
    assert W.read_warc(spark, f"{tmp_path}/e").count() == 0
    df = spark.createDataFrame(ROWS, PAGES)
    for c in ("shard", "digest", "bytes", "kind", "keep", "refers_to"):
        df = df.withColumn(c, W.F.lit("x"))
    W.write_warc(df, f"{tmp_path}/c")
    archive(spark, ROWS, f"{tmp_path}/d")
    assert sorted(map(repr, W.read_warc(spark, f"{tmp_path}/c").collect())) == sorted(map(repr, W.read_warc(spark, f"{tmp_path}/d").collect()))
