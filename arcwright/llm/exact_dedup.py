"""Exact dedup by two-pass Bloom filtering.

The first pass puts a 64-bit hash of every normalised text into a filter that keeps only bits set by two rows or
more; the second tests every row. Rows that cannot be repeated pass straight through; only the others, as
(id, digest) without text, are shuffled and grouped by their SHA-256. Groups are counted with partial sums; rows of large
groups, of which there are fewer than HOT_GROUPS, get their group from a broadcast table and meet in no task.

Defined results: null text counts as empty, and empty texts equal one another; rows that repeat both text and id
count as members of one group, of which one row is marked kept; a null id sorts first; an empty table gives no rows.
`deduplicate` keeps, of rows equal in id and normalised text, the one whose raw text is smallest; columns of any name pass through.
A filter is at most 32 MB, so it may be broadcast; more hashes than it can hold are tested in parts, a range of hashes
each, one filter after another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from arcwright.llm import common
from arcwright.plans.loops import cut

#: A group is large with more than HOT_ROWS rows and more than one in HOT_GROUPS of the rows tested, so fewer than HOT_GROUPS are.
HOT_GROUPS = 1000
HOT_ROWS = 1000


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, sha, key, row): the text is read once, here; row tells repeated rows apart."""
    sha = F.unhex(F.sha2(normalised(F.col("text")), 256))
    return cut(docs.select("doc_id", sha.alias("sha"), F.monotonically_increasing_id().alias("row")).withColumn("key", F.xxhash64("sha")))


def _tested(d: DataFrame) -> DataFrame:
    """(doc_id, sha, row, maybe), one filter for each part of the hashes."""
    rows = d.count()
    parts = common.bloom_parts(rows)
    bits, out = common.bloom_bits(-(-rows // parts)), None
    part = F.pmod(F.shiftright("key", 40), F.lit(parts))
    for k in range(parts):
        own = d if parts == 1 else d.where(part == k)
        filter_ = d.sparkSession.sparkContext.broadcast(common.bloom_build(own.select("key"), bits, twice=True))

        def test(batches, filter_=filter_):
            for b in batches:
                has = common.bloom_has(filter_.value, bits, np.asarray(b.column("key"))) if b.num_rows else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("sha"), b.column("row"), pa.array(has, pa.bool_())], names=["doc_id", "sha", "row", "maybe"])

        made = own.mapInArrow(test, "doc_id long, sha binary, row long, maybe boolean")
        if parts > 1:  # before the next filter is built
            made = cut(made)
            filter_.destroy()
        out = made if out is None else out.union(made)
    return out


def groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    common.small_batches(docs.sparkSession)
    tested = _tested(digests(docs))
    straight = tested.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    again = tested.where("maybe").select("doc_id", "sha", "row")
    sizes = cut(again.groupBy("sha").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("group_size")))
    hot = max(HOT_ROWS, (sizes.agg(F.sum("group_size")).first()[0] or 0) // HOT_GROUPS)
    large = sizes.where(F.col("group_size") > hot).select("sha", F.struct("first", "group_size").alias("large"))
    flagged = again.join(F.broadcast(large), "sha", "left")
    met = flagged.where("large is not null").select("doc_id", "row", "sha", "large.first", "large.group_size")
    met = met.union(flagged.where("large is null").select("doc_id", "row", "sha").join(sizes.where(F.col("group_size") <= hot), "sha").select("doc_id", "row", "sha", "first", "group_size"))
    repeated = met.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "sha")
    return straight.union(repeated).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents whose row stays, with all their columns.

    The ids of dropped rows go into a Bloom filter, so that only documents which may be among them are shuffled.
    Where a dropped and a kept row share an id, the row kept is the one with the smallest text digest of that id.
    """
    spark = docs.sparkSession
    out = cut(groups(docs))
    lost = cut(out.where("not kept").select("doc_id", "text_sha256").distinct())
    stay = out.where("kept").select("doc_id", "text_sha256")
    # a row is identified by id and digest, nulls equal; of wholly repeated rows one is kept
    same = F.col("a.text_sha256").eqNullSafe(F.col("b.text_sha256")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    twice = cut(stay.alias("a").join(lost.alias("b"), same, "left_semi"))
    gone = cut(lost.alias("a").join(twice.alias("b"), same, "left_anti"))
    return without(docs, gone, twice)


def without(docs: DataFrame, gone: DataFrame, once: DataFrame) -> DataFrame:
    """docs less the rows (doc_id, text_sha256) of `gone`, and with one row only for each of `once`."""
    spark = docs.sparkSession
    touched = gone.select("doc_id").union(once.select("doc_id"))
    bits = common.bloom_bits(touched.count())
    filter_ = spark.sparkContext.broadcast(common.bloom_build(touched.select(F.coalesce("doc_id", F.lit(-1).cast("long")).alias("key")), bits, twice=False))

    @F.pandas_udf("boolean")
    def maybe(ids):
        import pandas as pd

        return pd.Series(common.bloom_has(filter_.value, bits, ids.to_numpy(np.int64)))

    flag, sha, id_, lost, twice = common.fresh(docs.columns, "maybe", "sha", "id", "gone", "once")
    flagged = docs.withColumn(flag, maybe(F.coalesce("doc_id", F.lit(-1).cast("long"))))
    sure = flagged.where(~F.col(flag)).drop(flag)
    rest = flagged.where(flag).drop(flag).withColumn(sha, F.sha2(normalised(F.col("text")), 256))
    same = lambda other: F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(sha) == F.col(other))
    rest = rest.join(gone.select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(lost)), same(lost), "left_anti")
    both = rest.join(once.select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(twice)), same(twice), "left")
    single = both.where(F.col(twice).isNull()).select(*docs.columns)
    whole = F.struct(*docs.columns)
    multiple = both.where(F.col(twice).isNotNull()).groupBy("doc_id", sha).agg(F.min_by(whole, F.coalesce("text", F.lit(""))).alias(flag)).select(f"{flag}.*")
    return sure.union(single).union(multiple)


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.table(spark, sf_dir, "documents"))
