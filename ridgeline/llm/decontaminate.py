"""Benchmark decontamination: a broadcast hash set of test n-grams, DataFrame functions only.

The benchmark's windows (WINDOW consecutive words, or a whole item that has fewer) become a table with one row per
distinct window: a 64-bit hash, its words, its items. It is broadcast if its measured size is at most
BROADCAST_BYTES; a larger one is joined by shuffles, first on the hash and then on the words at the places found.
Each document becomes its array of window hashes in one narrow pass; explode, hash lookup and the check of the words
themselves run fused, so a window that is not in the benchmark never becomes a stored row. A closing entry in every array carries the
document through the same join, so documents without hits need no second scan.

Defined results: null has no words; a document with no hits has n_items 0 and the digest of the empty string;
benchmark rows without words have no window; rows of one item_id count as one item and a null item_id as the empty
string; repeated documents are repeated in the result; empty tables give no rows or no hits; other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import UPPER, WORD, lower_ascii, table, written

WINDOW = 10
#: Bytes of the windows' rows as they are broadcast.
BROADCAST_BYTES = 128 << 20
#: Hash of the closing entry; a window that hashes to it still meets its own words.
CLOSING = 0


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _hashes(h: str, n: str, size: int) -> Column:
    """Hashes of all windows of `size` words over the array column h of n word hashes."""
    at = lambda i: F.xxhash64(*[F.get(F.col(h), i + k) for k in range(size)])
    return F.when(F.col(n) >= size, F.transform(F.sequence(F.lit(0), F.col(n) - size), at)).otherwise(
        F.array().cast("array<bigint>")
    )


def benchmark_windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """hash, size, win (words), items (sorted item ids as strings): one row per distinct window."""
    b = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w"))
    n = F.size("w")
    cut = F.when(n >= window, F.transform(F.sequence(F.lit(0), n - window), lambda i: F.slice("w", i + 1, window)))
    wins = b.filter(n > 0).select("item", F.explode(F.coalesce(cut, F.array("w"))).alias("win"))
    each = wins.groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return each.select(F.size("win").alias("size"), "win", F.transform("win", lambda x: F.xxhash64(x)).alias("h"), "items")


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (array of hit word ranges, end exclusive), text_hash."""
    wins = written(benchmark_windows(bench, window), "windows")
    padded = lambda c: F.aggregate(c, F.lit(24), lambda n, x: n + 16 + F.octet_length(x))
    text_bytes = padded("win") + padded("items") + 64
    facts = wins.agg(F.sort_array(F.collect_set("size")).alias("sizes"), F.sum(text_bytes).alias("bytes")).first()
    sizes = facts["sizes"] or [window]  # at most `window` values
    hashed = None
    for s in sizes:
        part = wins.filter(F.col("size") == s).select(
            F.xxhash64(*[F.get("h", F.lit(k)) for k in range(s)]).alias("hash"), "size", "win", "items"
        )
        hashed = part if hashed is None else hashed.unionByName(part)
    spark = docs.sparkSession
    closing = spark.range(1).select(
        F.lit(CLOSING).cast("long").alias("hash"), F.lit(0).alias("size"),
        F.lit(None).cast("array<string>").alias("win"), F.lit(None).cast("array<string>").alias("items"),
    )
    d = docs.select(F.col("doc_id").alias("__doc"), F.xxhash64("text").alias("__text"), words(F.col("text")).alias("__w"))
    d = d.withColumn("__n", F.size("__w")).withColumn("__h", F.transform("__w", lambda x: F.xxhash64(x)))
    all_hashes = F.concat(*[_hashes("__h", "__n", s) for s in sizes], F.array(F.lit(CLOSING).cast("long")))
    d = d.select("__doc", "__text", "__n", "__w", all_hashes.alias("__all"))
    # outer: else Spark infers a filter on the array and pushes it, all hashes with it, below the words' projection
    rows = d.select("__doc", "__text", "__n", "__w", F.posexplode_outer("__all").alias("__i", "__hash"))

    # entry __i of the joined arrays: which size it belongs to, and where its window starts
    before, start, size_at, last = F.lit(0), None, None, F.lit(0)
    for s in sizes:
        count = F.greatest(F.col("__n") - s + 1, F.lit(0))
        here = F.col("__i") < before + count
        start = F.when(here, F.col("__i") - before) if start is None else start.when(here, F.col("__i") - before)
        size_at = F.when(here, F.lit(s)) if size_at is None else size_at.when(here, F.lit(s))
        before = before + count
        last = before
    is_closing = F.col("__i") == last
    key = ["__doc", "__text", "__n"]
    span = F.struct(start.alias("start"), (start + F.col("size")).alias("end"))
    if (facts["bytes"] or 0) <= broadcast_bytes:
        same = (F.col("size") == size_at) & (F.slice("__w", start + 1, F.col("size")) == F.col("win"))
        hit = rows.join(
            F.broadcast(hashed.unionByName(closing)),
            (F.col("__hash") == F.col("hash"))
            & F.when(is_closing, F.col("size") == 0).otherwise(F.when(F.col("size") > 0, same).otherwise(F.lit(False))),
        ).select(
            *key,
            F.when(~is_closing, span).alias("span"),
            "items",
            F.when(is_closing, 1).otherwise(0).alias("closing"),
        )
    else:
        # no words in the exploded rows: hash hits first, then the words at those places, joined as they stand
        places = (
            rows.filter(~is_closing)
            .select(*key, "__i", size_at.alias("size"), F.col("__hash").alias("hash"))
            .join(hashed.select("hash", "size"), ["hash", "size"], "left_semi")
            .groupBy(*key).agg(F.collect_set("__i").alias("__places"))
            .select(F.col("__doc").alias("__d"), F.col("__text").alias("__t"), "__places")
        )
        found = d.join(places, F.col("__doc").eqNullSafe(F.col("__d")) & (F.col("__text") == F.col("__t")))
        found = found.select(*key, "__w", F.explode("__places").alias("__i"))
        found = found.select(*key, start.alias("__start"), F.slice("__w", start + 1, size_at).alias("win")).join(wins, "win")
        span = F.struct(F.col("__start").alias("start"), (F.col("__start") + F.col("size")).alias("end"))
        hit = found.select(*key, span.alias("span"), "items", F.lit(0).alias("closing")).unionByName(
            d.select(*key, F.lit(1).alias("closing")), allowMissingColumns=True
        )
    per = hit.groupBy(*key).agg(
        F.sort_array(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.sum("closing").cast("int").alias("copies"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["upto"], s["end"]).alias("upto"),
            (a["n"] + F.greatest(s["end"] - F.greatest(a["upto"], s["start"]), F.lit(0))).alias("n"),
        ),
        lambda a: a["n"].cast("long"),
    )
    per = per.withColumn("__hit", covered).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return per.select(
        F.col("__doc").alias("doc_id"),
        F.col("__n").cast("long").alias("n_words"),
        F.col("__hit").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("__hit") > 0).alias("contaminated"),
        "spans",
        F.col("__text").alias("text_hash"),
    )


def _hits(docs: DataFrame, bench: DataFrame, window: int, *more: str) -> tuple[DataFrame, Column]:
    """__bad, __hash and `more` of the contaminated rows, once each, and the condition that joins docs to them."""
    hit = contamination(docs, bench, window).filter("contaminated")
    hit = hit.select(F.col("doc_id").alias("__bad"), F.col("text_hash").alias("__hash"), *more).dropDuplicates(["__bad", "__hash"])
    return hit, docs["doc_id"].eqNullSafe(F.col("__bad")) & (F.xxhash64(docs["text"]) == F.col("__hash"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without a hit, by doc_id and text, with all their columns."""
    hit, same = _hits(docs, bench, window)
    return docs.join(hit, same, "left_anti")


def cut_spans(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text, n_hit: each hit word goes with the separators before it; what follows the last word stays."""
    found, same = _hits(docs, bench, window, "spans", "n_hit")
    d = docs.select("doc_id", "text").join(found, same, "left")
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    units = F.regexp_extract_all("text", F.lit(f"{gap}*{word}+"), F.lit(0))
    kept = F.filter(units, lambda u, i: ~F.exists("spans", lambda s: (s["start"] <= i) & (i < s["end"])))
    rest = F.regexp_extract("text", f"{gap}*$", 0)
    return d.select(
        "doc_id",
        F.when(F.col("spans").isNotNull(), F.concat(F.array_join(kept, ""), rest)).otherwise(F.col("text")).alias("text"),
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("spans", "text_hash")


OP9_SQL = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') AS w
  FROM documents
), iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') AS w
  FROM benchmark
), ip AS (
  SELECT item, w, least(len(w), {WINDOW}) AS size, unnest(range(0, greatest(len(w) - {WINDOW}, 0) + 1)) AS p
  FROM iw WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item, size, array_to_string(w[p + 1 : p + size], ' ') AS g FROM ip
), sizes AS (SELECT DISTINCT size FROM win
), dp AS (
  SELECT doc_id, size, w, unnest(range(0, greatest(len(w) - size + 1, 0))) AS p FROM dw, sizes
), dg AS (
  SELECT doc_id, size, p, array_to_string(w[p + 1 : p + size], ' ') AS g FROM dp
), hit AS (
  SELECT doc_id, p, dg.size AS size, item FROM dg JOIN win ON dg.size = win.size AND dg.g = win.g
), pos AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM hit) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT dw.doc_id AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos ON dw.doc_id = pos.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id
"""
