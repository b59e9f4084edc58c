"""Token output as one wavelet matrix a shard.

A shard file holds the tokens of consecutive documents as bit planes, highest bit first: each plane has one bit of
every token in that plane's order, after which tokens with bit 0 are moved before those with bit 1. With counts of
ones at every 512th place this answers access, rank (how often an id occurs before a place) and select (where its
k-th occurrence is) from the one compressed file.

File, little-endian: magic "WMT1", uint32 planes, uint64 tokens, uint64 documents; then sections, each uint64 raw
size, uint64 stored size, zstandard data: document ids (int64), which of them are there (packed bits; others are null),
ends of documents (uint64), zeros of each plane
(uint64), and each plane's bits (packed, most significant first, padded to 64 bytes). Rank counts are made on
opening.

Shards are ranges of doc_id (and of the text's hash within one id, so that rows of one id may be split), no fewer than
the session's partitions and of about SHARD_BYTES of input files, so that a shard fits in a task. A file is written under a name of
its task's attempt and then moved to its place, so a repeated task leaves one whole file.

Defined results: null text is an empty document, which is its end id alone; rows with a repeated id follow one another;
null ids come first and are read back as null; an empty table writes no file; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from arcwright.llm import common
from arcwright.plans.loops import checkpoint_root, cut

MAGIC = b"WMT1"
END = 0
_BLOCK = 512
_LEVEL = 1
SHARD_BYTES = 32 << 20
#: Tokens worked through at a time, so that they stay in a core's cache.
_RUN = 1 << 17


def _put(out: list[bytes], raw: bytes) -> None:
    import zstandard

    stored = zstandard.ZstdCompressor(level=_LEVEL).compress(raw)
    out.append(struct.pack("<QQ", len(raw), len(stored)))
    out.append(stored)


def encode(tokens: np.ndarray, doc_ids: pa.Array, ends: np.ndarray) -> bytes:
    """The file of a shard; ends: how many tokens end with each document."""
    n = len(tokens)
    planes = max(1, int(tokens.max()).bit_length()) if n else 1
    x = tokens.astype(np.uint16 if planes <= 16 else np.uint32)
    zeros, bits = [], []
    for p in range(planes - 1, -1, -1):
        one = (x & x.dtype.type(1 << p)) != 0
        raw = np.packbits(one).tobytes()
        bits.append(raw + bytes(-len(raw) % (_BLOCK // 8)))
        low = 0
        high = z = n - int(np.count_nonzero(one))
        zeros.append(z)
        y = np.empty_like(x)
        for i in range(0, n, _RUN):
            part, own = x[i : i + _RUN], one[i : i + _RUN]
            a, b = part[np.flatnonzero(~own)], part[np.flatnonzero(own)]
            y[low : low + len(a)], y[high : high + len(b)] = a, b
            low, high = low + len(a), high + len(b)
        x = y
    out = [MAGIC, struct.pack("<IQQ", planes, n, len(doc_ids))]
    _put(out, np.asarray(doc_ids.fill_null(0)).astype("<i8").tobytes())
    _put(out, np.packbits(np.asarray(doc_ids.is_valid())).tobytes())
    _put(out, ends.astype("<u8").tobytes())
    _put(out, np.array(zeros, "<u8").tobytes())
    for raw in bits:
        _put(out, raw)
    return b"".join(out)


class WaveletMatrix:
    """Reads a shard file."""

    def __init__(self, data: bytes):
        import zstandard

        if data[:4] != MAGIC:
            raise ValueError("not a shard of tokens")
        self.planes, self.n, self.documents = struct.unpack_from("<IQQ", data, 4)
        at, z = 24, zstandard.ZstdDecompressor()

        def take() -> bytes:
            nonlocal at
            size, stored = struct.unpack_from("<QQ", data, at)
            at += 16 + stored
            return z.decompress(data[at - stored : at], max_output_size=size) if size else b""

        ids, valid = np.frombuffer(take(), "<i8"), np.unpackbits(np.frombuffer(take(), np.uint8), count=self.documents).view(bool)
        self.doc_ids, self.ends = pa.array(ids, pa.int64(), mask=~valid), np.frombuffer(take(), "<u8").astype(np.int64)
        self.zeros = np.frombuffer(take(), "<u8").astype(np.int64)
        self.bits = [np.frombuffer(take(), np.uint8) for _ in range(self.planes)]
        self._ranks: list[np.ndarray | None] = [None] * self.planes

    def _ones(self, plane: int, at: int) -> int:
        """Ones before a place."""
        if self._ranks[plane] is None:
            per = np.bitwise_count(self.bits[plane].reshape(-1, _BLOCK // 8)).sum(axis=1, dtype=np.int64)
            self._ranks[plane] = np.r_[0, np.cumsum(per)]
        block = at // _BLOCK
        raw = self.bits[plane][block * (_BLOCK // 8) : at // 8]
        more = int(np.bitwise_count(raw).sum()) + (int(self.bits[plane][at // 8] >> (8 - at % 8)).bit_count() if at % 8 else 0)
        return int(self._ranks[plane][block]) + more

    def access(self, at: int) -> int:
        """The token at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for p in range(self.planes):
            bit = int(self.bits[p][at >> 3]) >> (7 - (at & 7)) & 1
            ones = self._ones(p, at)
            at = int(self.zeros[p]) + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def rank(self, token: int, at: int) -> int:
        """How often a token occurs before a place."""
        if token >> self.planes:
            return 0
        a, b = 0, min(max(at, 0), self.n)
        for p in range(self.planes):
            ones_a, ones_b = self._ones(p, a), self._ones(p, b)
            if token >> (self.planes - 1 - p) & 1:
                a, b = int(self.zeros[p]) + ones_a, int(self.zeros[p]) + ones_b
            else:
                a, b = a - ones_a, b - ones_b
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Where the k-th occurrence (from 0) is; -1 if there are fewer."""
        if not 0 <= k < self.count(token):
            return -1
        low, high = 0, self.n  # the least place before which there are more than k
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.rank(token, mid) > k else (mid + 1, high)
        return low - 1

    def tokens(self) -> np.ndarray:
        """All tokens, by undoing the planes from the last to the first."""
        x = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for p in range(self.planes - 1, -1, -1):
            one = np.unpackbits(self.bits[p], count=self.n).view(bool)
            before = np.empty_like(x)
            low, high, set_ = 0, int(self.zeros[p]), x.dtype.type(1 << (self.planes - 1 - p))
            for i in range(0, self.n, _RUN):
                part, own = before[i : i + _RUN], one[i : i + _RUN]
                a, b = np.flatnonzero(~own), np.flatnonzero(own)
                part[a], part[b] = x[low : low + len(a)], x[high : high + len(b)] | set_
                low, high = low + len(a), high + len(b)
            x = before
        return x

    def document(self, k: int) -> np.ndarray:
        """Tokens of the k-th document of the shard."""
        a = int(self.ends[k - 1]) if k else 0
        return np.fromiter((self.access(i) for i in range(a, int(self.ends[k]))), np.uint32)


def _file(uri: str):
    """(filesystem, path) of any address that Spark's own file systems share with pyarrow."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its file system: Spark's default one where none is named."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _settle(system, made: str, at: str) -> None:
    """Moves a finished file to its place; where another attempt was first, its file, which is the same, stays."""
    from pyarrow import fs

    try:
        system.move(made, at)
    except OSError:
        if system.get_file_info(at).type != fs.FileType.File:
            raise
        system.delete_file(made)


def write(docs: DataFrame, folder: str, path: str, shards: int | None = None) -> DataFrame:
    """Encodes docs in ascending doc_id order into shard files under `folder`; (shard, file, documents, tokens) of each."""
    shards = shards or max(common.partitions(docs.sparkSession), -(-common.estimated_bytes(docs.select("doc_id", "text")) // SHARD_BYTES))
    folder = _qualified(docs.sparkSession, folder)

    def run(batches):
        from pyspark import TaskContext

        encoder_ = common.encoder(path)
        ids, tokens, lengths = [], [], []
        for batch in batches:
            for part in common.runs(batch):
                made = encoder_(common.strings(part.column("text")))
                ids += part.column("doc_id").to_pylist()
                lengths += [len(x) + 1 for x in made]
                flat = np.concatenate([y for x in made for y in (x, _END)])
                tokens.append(flat.astype(np.uint16) if len(flat) == 0 or flat.max() < 1 << 16 else flat)
        if not ids:
            return
        context = TaskContext.get()
        name = f"{folder}/shard-{context.partitionId():05d}.wmt"
        data = encode(np.concatenate(tokens), pa.array(ids, pa.int64()), np.cumsum(lengths))
        system, at = _file(name)
        system.create_dir(at.rpartition("/")[0], recursive=True)
        with system.open_output_stream(f"{at}.{context.taskAttemptId()}") as f:
            f.write(data)
        _settle(system, f"{at}.{context.taskAttemptId()}", at)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([context.partitionId()], pa.int32()), "file": [name], "documents": [len(ids)], "tokens": [int(sum(lengths))]})

    order = ["doc_id", F.xxhash64("text")]
    ordered = docs.select("doc_id", "text").repartitionByRange(shards, *order).sortWithinPartitions(*order)
    return cut(ordered.mapInArrow(run, "shard int, file string, documents long, tokens long"))


_END = np.array([END], np.uint32)


def read(spark: SparkSession, written: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of `write`.

    The list of shards, one row a file, is the only thing the driver holds.
    """
    files, start = [], 0
    for r in sorted(written.collect(), key=lambda r: r.shard):
        files.append((r.file, start))
        start += r.tokens
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                system, at = _file(file)
                with system.open_input_stream(at) as f:
                    shard = WaveletMatrix(f.read())
                tokens = shard.tokens().astype("<u4")
                begin = np.r_[0, shard.ends[:-1]].astype(np.int64)
                crc = [zlib.crc32(tokens[a:b].tobytes()) for a, b in zip(begin, shard.ends)]
                yield pa.RecordBatch.from_arrays([shard.doc_ids, pa.array(base + begin), pa.array(shard.ends - begin), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    each = spark.createDataFrame(files, "file string, base long").repartition(len(files))
    return each.mapInArrow(run, schema)


SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return read(spark, write(docs, f"{checkpoint_root(spark)}/tokens-{uuid.uuid4().hex}", common.tokenizer_path()))
