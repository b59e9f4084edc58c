"""Compression classifier for text quality.

One zstandard dictionary is built from blocks of good and one from blocks of bad labelled text. Every whole text is
compressed with both, in independent blocks of 4 KB so that a dictionary helps a long text as much as a short one;
the normalised difference of the two sizes alone becomes a score by a logistic calibration (of it and its square) fitted on labelled texts that the dictionaries have not seen.

Training takes at most SAMPLE labelled documents a class (a documented bound, the smallest hashes of their ids) and
BLOCKS blocks of each for the dictionaries; scoring reads every text whole.

Defined results: null text scores as the empty text; labels that are null or without document are ignored; of several
labels of one document the smallest counts, of several texts of a labelled id the smallest, and rows that repeat an id are each scored; without two documents of each kind every score is the share of label 1 (0.5
without any), and `keep_good` keeps all documents, since nothing was learned; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from arcwright.llm import common
from arcwright.plans.loops import cut

SAMPLE = 4000
BLOCK = 4096
#: Blocks of one document, evenly spread over it, that may go into a dictionary.
BLOCKS = 4
DICTIONARY = 110_000
LEVEL = 3
ACCEPT = 0.7


def _blocks(text: str | None) -> list[bytes]:
    raw = (text or "").encode()
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)] or [b""]


def _dictionary(blocks: list[bytes]):
    import zstandard

    try:
        made = zstandard.train_dictionary(DICTIONARY, blocks)
    except zstandard.ZstdError:  # too few or too small
        made = zstandard.ZstdCompressionDict((b"".join(blocks) or b" " * 8)[-DICTIONARY:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return made.as_bytes(), made.dict_id() == 0


def features(bad: int, good: int) -> list[float]:
    """The normalised difference of the sizes under both dictionaries, and its square."""
    difference = 10 * (bad - good) / (bad + good)
    return [difference, difference**2]


class Sizes:
    """Features of a text from its sizes under both dictionaries."""

    def __init__(self, dictionaries):
        import zstandard

        self.both = []
        for raw, content in dictionaries:
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT if content else zstandard.DICT_TYPE_FULLDICT)
            d.precompute_compress(level=LEVEL)
            self.both.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, text: str | None) -> list[float]:
        blocks = _blocks(text)
        return features(*(sum(len(c.compress(b)) for b in blocks) for c in self.both))


def _logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray | float = 1.0):
    """Mean, deviation and weights of a ridge logistic regression; times: how many rows each stands for."""
    mean, deviation = x.mean(0), x.std(0) + 1e-9
    a = np.c_[np.ones(len(x)), (x - mean) / deviation]
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (times * p * (1 - p))[:, None]).T @ a + np.eye(len(w)), a.T @ (times * (p - y)) + w)
        w -= step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
    return mean, deviation, w


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """labels: (doc_id, quality). The model is a few hundred KB."""
    common.small_batches(docs.sparkSession)
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for q in (0, 1)]
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    # of rows that repeat an id one is learned from, so the bound holds
    sample = sample.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    sample = cut(sample.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int")))
    # a class that the hash puts in one half is dealt to both
    halves = {(r.quality, r.half) for r in sample.select("quality", "half").distinct().collect()}
    for q in (0, 1):
        if ((q, 0) in halves) != ((q, 1) in halves):
            ids = sorted(r.doc_id for r in sample.where(F.col("quality") == q).select("doc_id").distinct().collect())
            sample = sample.withColumn("half", F.when(F.col("quality") == q, F.col("doc_id").isin(ids[1::2]).cast("int")).otherwise(F.col("half")))

    def pick(batches):
        for b in batches:
            rows = []
            for q, text in zip(b.column("quality").to_pylist(), b.column("text").to_pylist()):
                blocks = _blocks(text)
                at = np.unique(np.linspace(0, len(blocks) - 1, min(BLOCKS, len(blocks))).astype(int))
                rows += [(q, blocks[i]) for i in at]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["quality", "block"])

    seen = sample.where("half = 0").mapInArrow(pick, "quality int, block binary").collect()
    blocks = [sorted(bytes(r.block) for r in seen if r.quality == q) for q in (0, 1)]
    prior = sample.agg(F.avg("quality")).first()[0]
    if not blocks[0] or not blocks[1]:
        return {"constant": 0.5 if prior is None else float(prior)}
    model = {"dictionaries": [_dictionary(b) for b in blocks]}

    def measure(batches):
        sizes = Sizes(model["dictionaries"])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("quality"), pa.array([sizes(x) for x in b.column("text").to_pylist()], pa.list_(pa.float64()))], names=["quality", "x"])

    unseen = sample.where("half = 1").mapInArrow(measure, "quality int, x array<double>").collect()
    if len({r.quality for r in unseen}) < 2:
        return {"constant": float(prior)}
    unseen.sort(key=lambda r: (r.quality, r.x))
    # the sample is bounded class by class, so each of its rows stands for its class's share of all labels
    y = np.array([r.quality for r in unseen])
    all_ = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    share = np.array([all_[q] / sum(all_.values()) for q in (0, 1)])
    return model | {"logistic": _logistic(np.array([r.x for r in unseen]), y.astype(float), (share * len(y) / np.bincount(y))[y])}


def _scorer(model: dict):
    if "constant" in model:
        return lambda texts: np.full(len(texts), model["constant"])
    sizes, (mean, deviation, w) = Sizes(model["dictionaries"]), model["logistic"]
    return lambda texts: 1 / (1 + np.exp(-np.clip(w[0] + ((np.array([sizes(t) for t in texts]) - mean) / deviation) @ w[1:], -30, 30)))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs with a column score in 0..1, which replaces one of that name; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(*(c for c in docs.columns if c.lower() != "score"))

    def run(batches):
        scorer = _scorer(shared.value)
        for batch in batches:
            for part in common.runs(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scorer(part.column("text").to_pylist()), pa.float64())], names=[*part.schema.names, "score"])
        common.release()

    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(run, StructType([f for f in docs.schema.fields]).add("score", DoubleType()))


def keep_good(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The documents that score at least `accept`, all columns."""
    model = train(docs, labels)
    if "constant" in model:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = _scorer(shared.value)
        for batch in batches:
            for part in common.runs(batch):
                yield part.filter(pa.array(scorer(part.column("text").to_pylist()) >= accept, pa.bool_()))
        common.release()

    return docs.mapInArrow(run, docs.schema)


SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").where(common.fold("doc_id", 4) != 2)
    scored = score(docs.withColumn("held_out", F.coalesce(common.fold("doc_id", 4) == 2, F.lit(False))), train(docs, labels))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
