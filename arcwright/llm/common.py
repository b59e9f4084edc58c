"""What the operators share: text access in Arrow batches, hashing, Bloom filters, tokenization."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from arcwright.plans.shipping import ship

#: Rows of one Arrow batch are worked through in runs of about this many bytes.
RUN_BYTES = 2 << 20


#: Rows and bytes of one Arrow batch between Spark and Python, so that long texts don't pile up on either side.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """Lowers the session's bounds of Arrow batches to those above, where they are higher."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        try:
            now = int(re.match(r"-?\d+", spark.conf.get(key))[0])
        except Exception:  # this version has no such setting
            continue
        if not 0 < now <= most:
            spark.conf.set(key, str(most))
    return ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold(name: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % modulus


def partitions(spark: SparkSession) -> int:
    """What the session deals a shuffle into; sized by whoever runs the job to fit an executor's memory."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def strings(column) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def runs(batch: pa.RecordBatch, name: str = "text", limit: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into slices of about `limit` bytes of text; a longer text is a slice of its own."""
    column = batch.column(name)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def release() -> None:
    """Gives memory that a task has freed back to the machine; workers outlive tasks and share an executor's bound."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def estimated_bytes(df: DataFrame, column: str = "text") -> int:
    """About how many bytes a table's files hold, as Spark plans with; where it has no idea, the bytes of a column, read once."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else int(df.select(F.sum(F.octet_length(column))).first()[0] or 0)


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores in front until no column has it, whatever its case."""
    low, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in low:
            name = f"_{name}"
        low.add(name.lower())
        out.append(name)
    return out


# Shifts and factors of the public 64-bit finaliser.
def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place on a fresh array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# --- Bloom filters -------------------------------------------------------------------------

BLOOM_HASHES = 4
#: Bits of the largest filter that is broadcast: 32 MB. Filters of more keys are built and asked in parts, a range of hashes each.
BLOOM_MAX_BITS = 1 << 28
BLOOM_PER_KEY = 16
_SLICE_BITS = 1 << 19


def bloom_bits(keys: int) -> int:
    """A power of two with at least BLOOM_PER_KEY bits a key, within the bound."""
    return min(BLOOM_MAX_BITS, 1 << max(13, int(np.ceil(np.log2(max(1, keys) * BLOOM_PER_KEY)))))


def bloom_parts(keys: int) -> int:
    """How many filters of the bound hold so many keys."""
    return max(1, -(-keys * BLOOM_PER_KEY // BLOOM_MAX_BITS))


def bloom_positions(keys: np.ndarray, bits: int) -> np.ndarray:
    """(hashes, keys) bit positions."""
    x = mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    a, b = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    i = np.arange(BLOOM_HASHES, dtype=np.uint64)[:, None]
    return ((a + i * b) & np.uint64(bits - 1)).astype(np.int64)


def bloom_build(keys: DataFrame, bits: int, twice: bool) -> np.ndarray:
    """The filter of one long column, as bytes of packed bits.

    twice: only bits set by at least two rows, so it holds every key of two rows or more (two passes in one:
    what a first filter has seen already goes into the second). Positions are shuffled by slice of the filter
    and a slice is merged by one task; the driver receives `bits` / 8 bytes, at most 32 MB.
    """
    name = keys.columns[0]

    def emit(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at = bloom_positions(np.asarray(batch.column(name)), bits)
            # a key's own positions may coincide; they count once for it
            at.sort(axis=0)
            first = np.ones(at.shape, bool)
            first[1:] = at[1:] != at[:-1]
            at, count = np.unique(at[first], return_counts=True)
            part = at // _SLICE_BITS
            for s in np.unique(part):
                own = part == s
                code = (at[own] % _SLICE_BITS).astype(np.uint32) * 2 + (count[own] > 1)
                yield pa.RecordBatch.from_pydict({"part": pa.array([int(s)], pa.int32()), "at": pa.array([code.astype(np.uint32).tobytes()], pa.binary())})

    def merge(t: pa.Table) -> pa.Table:
        once, more = np.zeros(_SLICE_BITS, bool), np.zeros(_SLICE_BITS, bool)
        for x in t.column("at").to_pylist():
            code = np.frombuffer(x, np.uint32)
            at = code >> 1
            more[at] |= once[at] | (code & 1).astype(bool)
            once[at] = True
        return pa.table({"part": t.column("part")[:1], "set": pa.array([np.packbits(more if twice else once).tobytes()], pa.binary())})

    out = np.zeros(max(bits, _SLICE_BITS) // 8, np.uint8)
    width = _SLICE_BITS // 8
    slices = keys.mapInArrow(emit, "part int, at binary").groupBy("part").applyInArrow(merge, "part int, set binary")
    for r in slices.collect():
        out[r.part * width : (r.part + 1) * width] = np.frombuffer(r.set, np.uint8)
    return out


def bloom_has(filter_bytes: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    at = bloom_positions(keys, bits)
    return ((filter_bytes[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)


# --- tokens --------------------------------------------------------------------------------


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: New pieces encoded at a time; the library takes about a hundred times their bytes for a moment.
LEARN = 40_000


class Encoder:
    """Ids of whole texts by the tokenizers library.

    A byte-level vocabulary first cuts a text into pieces by a fixed pattern and encodes each piece alone, so
    a piece is encoded by the library once, kept (at most about `limit` of them, those met most) and looked up after that.
    The pattern is applied here only to texts of printable ASCII, line ends, tabs and Latin letters, where
    Python's character classes agree with the vocabulary's, and without a token that was added to the vocabulary;
    any other text goes to the library whole.
    """

    def __init__(self, path: str, limit: int = 800_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.limit, self.turn = limit, 0
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        # the same model, given pieces that are cut and written in its alphabet already
        self.pieces = Tokenizer.from_file(path)
        self.pieces.pre_tokenizer = pre_tokenizers.Split(_ALPHABET[10], "isolated")
        self.alphabet = dict(enumerate(_ALPHABET))
        (self.line_end,) = self._encode(["\n"])[0]
        self._clear()

    def _clear(self):
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 16, np.int64)
        self.hits = np.zeros(1 << 16, np.int32)

    def _thin(self):
        """Keeps the half of the pieces met most often; what is kept never changes an id."""
        n = len(self.known)
        keep = np.sort(np.argpartition(-self.hits[:n], n // 2)[: n // 2])
        words, flat, ends, hits = list(self.known), self.flat, self.ends, self.hits
        lengths = np.diff(ends)[keep]
        at = np.repeat(ends[keep] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        self._clear()
        self._note([words[i] for i in keep.tolist()], flat[at], lengths)
        self.hits[: len(keep)] = hits[keep] // 2

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]):
        """Encodes distinct pieces that have no number yet.

        Their bytes are written in the vocabulary's alphabet, one text for all, with a character between them that
        no piece contains; the library's model then encodes them without cutting them once more.
        """
        text = "\n".join(new).encode().decode("latin-1").translate(self.alphabet)
        flat = np.asarray(self.pieces.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        between = flat == self.line_end
        lengths = np.diff(np.r_[-1, np.flatnonzero(between), len(flat)]) - 1
        flat = flat[~between]
        self._note(new, flat, lengths)

    def _note(self, new: list[str], flat: np.ndarray, lengths: np.ndarray):
        n = len(self.known)
        used = int(self.ends[n])
        while used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(new) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            self.hits = np.concatenate([self.hits, np.zeros_like(self.hits)])
        self.flat[used : used + len(flat)] = flat
        self.ends[n + 1 : n + 1 + len(new)] = used + np.cumsum(lengths)
        self.known.update(zip(new, range(n, n + len(new))))

    def _number(self, pieces: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            new = list(dict.fromkeys([pieces[i] for i in missing]))
            odd = [p for p in new if "\n" in p]
            if odd:
                ids = self._encode(odd)
                self._note(odd, np.concatenate([np.asarray(x, np.uint32) for x in ids]), np.array([len(x) for x in ids]))
                new = [p for p in new if "\n" not in p]
            for k in range(0, len(new), LEARN):
                self._learn(new[k : k + LEARN])
            at[missing] = [self.known[pieces[i]] for i in missing]
        return at

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        plain, pieces, counts = [], [], []
        if len(self.known) > self.limit:
            self._thin()
        for i, text in enumerate(texts):
            if not text:
                out[i] = np.zeros(0, np.uint32)
            elif not _sure(text) or self.added(text):
                out[i] = np.asarray(self._encode([text])[0], np.uint32)
            else:
                cut_ = (_PIECES_ASCII if text.isascii() else _PIECES).findall(text)
                plain.append(i)
                pieces += cut_
                counts.append(len(cut_))
        if not plain:
            return out
        at = self._number(pieces)
        self.turn += 1
        if self.turn % 4 == 0:  # often enough to tell which are met most
            times = np.bincount(at)
            self.hits[: len(times)] += times.astype(np.int32)
        begin = self.ends[at]
        length = self.ends[at + 1] - begin
        stop = np.cumsum(length)
        begin -= stop
        begin += length
        flat = self.flat[np.repeat(begin, length) + np.arange(stop[-1])]
        ends = stop[np.cumsum(counts) - 1]
        for i, a, b in zip(plain, np.concatenate([[0], ends[:-1]]), ends):
            out[i] = flat[a:b]
        return out


# The vocabulary's splitting pattern, for the characters that _UNSURE leaves.
_CUT = r" ?[{0}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s{0}0-9]+|\s+(?!\S)|\s+"
_PIECES = re.compile(_CUT.format("A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"))
_PIECES_ASCII = re.compile(_CUT.format("A-Za-z"), re.ASCII)
# The characters a byte-level vocabulary writes bytes with: visible ones stand for themselves, the others follow from U+0100.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_ALPHABET = [chr(b if b in _SHOWN else 256 + len({*range(b)} - _SHOWN)) for b in range(256)]
_UNSURE = re.compile("[^\\n\\r\\t\x20-\x7e\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]")

_PLAIN = np.zeros(128, bool)
_PLAIN[32:127] = True
_PLAIN[[9, 10, 13]] = True


def _sure(text: str) -> bool:
    if text.isascii():
        return bool(_PLAIN[np.frombuffer(text.encode(), np.uint8)].all())
    return not _UNSURE.search(text)


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, limit: int = 800_000) -> Encoder:
    """One a worker process for each path and bound of pieces kept."""
    if (path, limit) not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path, limit] = Encoder(path, limit)
    return _encoders[path, limit]
