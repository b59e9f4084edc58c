"""Exact token counts from a histogram of encoded lengths.

Documents are encoded once and aggregated by length; suffix sums over the histogram answer, for every context limit,
how many documents and tokens reach it and how many tokens are left when each document is cut there. Quantiles and
totals come from the same rows.

Defined results: null and empty texts have length 0; repeated rows count each; an empty table has an empty histogram, total 0 and
no quantile. Only the column text is read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from arcwright.llm import common
from arcwright.plans.loops import cut

#: Bits of a length that one level of the suffix sums deals with.
DIGIT = 6


def lengths(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: n_tokens."""

    def run(batches):
        encode = common.encoder(path)
        for batch in batches:
            for part in common.runs(batch):
                yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in encode(common.strings(part.column("text")))], pa.int64())], names=["n_tokens"])

    return docs.select("text").mapInArrow(run, "n_tokens long")


def histogram(docs: DataFrame, path: str) -> DataFrame:
    return lengths(docs, path).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Per length L: documents and tokens of length L or more, and tokens kept when cut at L.

    The histogram has as many rows as there are different lengths. It is summed digit by digit, DIGIT bits each: lengths within
    their range, ranges within the next larger one, and so on, so that no task sorts more than 2**DIGIT rows.
    """
    hist = cut(hist)
    h = hist.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"))
    longest, total = hist.agg(F.max("n_tokens"), F.sum(F.col("n_tokens") * F.col("n_docs"))).first()
    range_ = lambda level: F.shiftright("n_tokens", DIGIT * level)
    own = lambda level: Window.partitionBy("up").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0 if level == 0 else -1)
    docs, tokens, levels = [], [], max(1, -(-max(1, longest or 0).bit_length() // DIGIT))
    s = h
    for level in range(levels):
        sums = h.groupBy(range_(level).alias("at")).agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t")).withColumn("up", F.shiftright("at", DIGIT))
        above = sums.select(F.col("at").alias(f"r{level}"), F.sum("d").over(own(level)).alias(f"d{level}"), F.sum("t").over(own(level)).alias(f"t{level}"))
        s = s.withColumn(f"r{level}", range_(level)).join(above, f"r{level}")
        docs.append(F.coalesce(f"d{level}", F.lit(0)))
        tokens.append(F.coalesce(f"t{level}", F.lit(0)))
    s = s.select("n_tokens", "n_docs", sum(docs[1:], docs[0]).alias("docs_at_least"), sum(tokens[1:], tokens[0]).alias("tokens_at_least"))
    all_ = F.lit(total or 0).cast("long")
    cut_ = all_ - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")
    return s.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", cut_.alias("tokens_cut_here"), all_.alias("all_tokens"))


def total_at(sums: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut at `limit`, which need not be a length that occurs."""
    at = sums.where(F.col("n_tokens") > limit).orderBy("n_tokens").first()
    if at is None:
        return int((sums.agg(F.max("all_tokens")).first()[0]) or 0)
    return at.all_tokens - at.tokens_at_least + at.docs_at_least * limit


def quantile(sums: DataFrame, q: float) -> int | None:
    """The smallest length that at least a share q of the documents does not exceed."""
    n = sums.agg(F.max("docs_at_least")).first()[0]
    if not n:
        return None
    return sums.where(F.lit(n) - F.col("docs_at_least") + F.col("n_docs") >= F.lit(max(1, int(np.ceil(q * n))))).agg(F.min("n_tokens")).first()[0]


SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(histogram(common.table(spark, sf_dir, "documents"), common.tokenizer_path()))
