"""Exact dedup: a tree merge of sorted digest runs, DataFrame functions only.

Every input partition is a run of records (digest, best row, count). There are fan_in ** rounds places, and a place
holds one run. In a round, places whose numbers differ in one digit (to the base fan_in) exchange: each sends every
other the records that have that one's digit, and merges the sorted parts it gets, folding equal digests: the best
row stays and the counts add up. So the runs that hold a given text become fewer by the factor fan_in in every round,
and after the last one the place that the digest names holds its only record. A hot text has one record a place
after the first round, which deals it to places / fan_in tasks; a record is some 60 bytes, whatever the text.
Joining the records to the documents' digests (a sort-merge join, which adaptive execution splits when one digest is
hot) gives each document its group. Texts themselves never move.

Equality is verified by the SHA-256, the length in bytes and a 64-bit hash of another family, all of the whole
normalised text, at every level.

Defined results: null counts as empty; all empty texts form one group; of equal texts the one with the most code
points stays, then the smallest doc_id, a null doc_id last, and of different texts under one doc_id the one with the
largest hash; a repeated row counts in group_size, and its repeats are all kept or all dropped; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import partitions, table, written

BLANKS = r"[\x20\x09-\x0D]+"
FAN_IN = 4
KEY = ["digest", "bytes", "check"]


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, points (code points) and text_hash of the text, digest (SHA-256), bytes and second hash of the text without blanks."""
    text = F.coalesce("text", F.lit(""))
    bare = docs.select("doc_id", F.length(text).alias("points"), F.xxhash64("text").alias("text_hash"), F.regexp_replace(text, BLANKS, "").alias("bare"))
    return bare.select(
        "doc_id",
        "points",
        "text_hash",
        F.unhex(F.sha2("bare", 256)).alias("digest"),
        F.octet_length("bare").alias("bytes"),
        F.xxhash64("bare").alias("check"),
    )


def merge_round(level: DataFrame, runs: int, fan_in: int, digit: int) -> DataFrame:
    """One exchange of sorted runs along one digit of the places' numbers, and the merge of what each place got."""
    unit = fan_in**digit
    own, named = (F.floor(c / unit) % fan_in for c in (F.col("run"), F.pmod("check", F.lit(runs))))
    moved = level.withColumn("run", (F.col("run") + (named - own) * unit).cast("int"))
    moved = moved.repartitionById(runs, F.col("run")).sortWithinPartitions("run", *KEY)
    # sorted and in place: this aggregation exchanges nothing
    return moved.groupBy("run", *KEY).agg(F.max("best").alias("best"), F.sum("group_size").alias("group_size"))


def merge_runs(d: DataFrame, places: int, fan_in: int = FAN_IN) -> DataFrame:
    """One record per distinct text (digest, bytes, check, best, group_size), over at least `places` places."""
    rounds = 1
    while fan_in**rounds < places:
        rounds += 1
    runs = fan_in**rounds
    # bitwise_not orders like the negative, without its overflow: the largest is the smallest doc_id, and null loses
    level = d.select(
        F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run"),
        *KEY,
        F.struct("points", F.bitwise_not("doc_id").alias("inverse"), "text_hash").alias("best"),
        F.lit(1).cast("long").alias("group_size"),
    )
    for digit in range(rounds):
        level = merge_round(level, runs, fan_in, digit)
    return level.drop("run")


def _rows(docs: DataFrame, fan_in: int) -> DataFrame:
    """exact_groups with text_hash."""
    d = written(digests(docs), "digests")
    groups = merge_runs(d, partitions(docs.sparkSession), fan_in)
    stays = F.struct("points", F.bitwise_not("doc_id").alias("inverse"), "text_hash").eqNullSafe(F.col("best"))
    return d.join(groups, KEY).select(
        "doc_id",
        F.bitwise_not("best.inverse").alias("keep_id"),
        "group_size",
        stays.alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "text_hash",
    )


def exact_groups(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs."""
    return _rows(docs, fan_in).drop("text_hash")


def drop_copies(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """The rows of docs that stay, by doc_id and text, with all their columns."""
    kept = _rows(docs, fan_in).filter("kept").select(F.col("doc_id").alias("__kept"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col("__kept")) & (F.xxhash64(docs["text"]) == F.col("__hash")), "left_semi")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY bare ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY bare) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY bare ORDER BY points DESC, doc_id) AS kept,
       sha256(bare) AS text_sha256
FROM n
"""
