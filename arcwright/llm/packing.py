"""Best-fit packing by sums of squares.

A piece goes where the sum, over residual gaps, of the squared number of open sequences with that gap becomes
smallest (of equal places the tightest). Documents are encoded with an end id; those longer than a sequence are cut
from the end into whole sequences, so only the first piece may be shorter and needs a place.

Each task packs what it reads, without a shuffle. Sequences it leaves with a gap of LOOSE tokens or more are taken
apart, and their pieces, as narrow rows, packed again in larger groups.

Defined results: null text is an empty document and packs as its end id; repeated ids are packed like others; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from arcwright.llm import common
from arcwright.plans.loops import cut

CAPACITY = 2048
END = 0
LOOSE = 16
#: Pieces that one task of the second round packs.
GROUP = 200_000
#: Pieces of text that a worker keeps encoded, and bytes of text encoded at a time: a smaller share of an executor's
#: memory than the other encoding operators take, as packing ends pipelines whose earlier stages fill the JVM's heap.
KNOWN = 400_000
RUN = 1 << 20

_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, gap int"


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in it, final gap of it) of each piece; pieces are placed longest first."""
    n = np.zeros(capacity + 1, np.int64)  # open bins by gap
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    rise = np.zeros(capacity + 1, np.int64)  # what one more bin of a gap adds to the sum; closed bins add nothing
    rise[1:] = 1
    big = np.iinfo(np.int64).max // 4
    fall = np.full(capacity + 1, big)  # what one less adds
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        change = fall[s:] + rise[: capacity + 1 - s]
        g = int(change.argmin())
        if change[g] > rise[capacity - s]:
            b, g = len(fill), capacity - s
            fill.append(0)
        else:
            b = open_[g + s].pop()
            k = g + s
            n[k] -= 1
            rise[k] -= 2
            fall[k] = 1 - 2 * n[k] if n[k] else big
        where[i], offset[i] = b, fill[b]
        fill[b] += s
        if g:
            open_[g].append(b)
            n[g] += 1
            rise[g] += 2
            fall[g] = 1 - 2 * n[g]
    return where, offset, capacity - np.array(fill, np.int64)[where] if len(lengths) else where


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """First round: pieces with places in sequences of the task."""

    def run(batches):
        from pyspark import TaskContext

        encode = common.encoder(path, KNOWN)
        base = TaskContext.get().partitionId() << 36
        doc, piece, start, length, crc = [], [], [], [], []
        for batch in batches:
            for part in common.runs(batch, limit=RUN):
                for i, ids in zip(part.column("doc_id").to_pylist(), encode(common.strings(part.column("text")))):
                    raw = np.append(ids, np.uint32(END)).astype("<u4")
                    first = len(raw) % capacity or min(len(raw), capacity)
                    for k, a in enumerate([0, *range(first, len(raw), capacity)]):
                        b = first if k == 0 else a + capacity
                        doc.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(raw[a:b].tobytes()))
            common.release()
        yield _packed([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], base, capacity)
        common.release()

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)


def _packed(columns: list, base: int, capacity: int) -> pa.RecordBatch:
    where, offset, gap = pack(columns[3].to_numpy(zero_copy_only=False), capacity)
    return pa.RecordBatch.from_arrays([*columns, pa.array(base + where), pa.array(offset), pa.array(gap.astype(np.int32))], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "gap"])


def sequences(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    common.small_batches(docs.sparkSession)
    first = cut(pieces(docs, path, capacity))
    loose = first.where(F.col("gap") >= LOOSE)
    groups = max(1, loose.count() // GROUP)

    def again(t: pa.Table) -> pa.Table:
        group = t.column("group")[0].as_py()
        columns = [t.column(c).combine_chunks() for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        return pa.Table.from_batches([_packed(columns, (1 << 62) + (group << 36), capacity)])

    second = loose.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "sequence_id", "offset"), F.lit(groups)).cast("int")).groupBy("group").applyInArrow(again, _SCHEMA)
    return first.where(F.col("gap") < LOOSE).union(second).drop("gap")


SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(common.table(spark, sf_dir, "documents"), common.tokenizer_path())
