"""Benchmark decontamination with one Aho-Corasick automaton.

Test texts and documents are normalised alike (A-Z lower-cased, words are runs of characters other than ASCII
separators); every window of ten consecutive item words is a pattern " w1 ... w10 ". One scan of a document's
normalised text finds all of them; ends of matches map to word numbers, and those to offsets in the original text.

Defined results: null or wordless texts have no words and no hits; items without words have no window; windows
that several items share count for each of them, and items of one id count once; an item without an id hits words like any
other and counts as no item; an empty benchmark hits nothing; repeated rows are scanned each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from arcwright.llm import common

WINDOW = 10
#: Characters of patterns one automaton may hold; a larger benchmark has several, one after another in one pass.
AUTOMATON_CHARS = 32 << 20

_KEEP = np.array([c >= 0x80 or chr(c).isalnum() for c in range(256)])
_MAP = bytes((ord(chr(c).lower()) if c < 0x80 else c) if _KEEP[c] else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_MAP).split()


def windows(rows: list[tuple[str, str]], width: int = WINDOW) -> dict[str, list[str]]:
    """Pattern -> the items that have it (one whose rows lie apart may be there more than once)."""
    out: dict[str, list[str]] = {}
    for item, text in rows:
        w = words(text)
        if w:
            for i in range(max(1, len(w) - width + 1)):
                own = out.setdefault(f" {b' '.join(w[i : i + width]).decode()} ", [])
                if not own or own[-1] != item:
                    own.append(item)
    return out


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places as disjoint ranges, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Scanner:
    """Finds the windows in texts; `spans` gives them in offsets of the original."""

    def __init__(self, patterns: dict[str, list[str]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for p, items in patterns.items():
            self.automaton.add_word(p, (p.count(" ") - 1, items))
        self.size = len(patterns)
        if self.size:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, hit word ranges [from, to) in order and disjoint, items."""
        w = words(text)
        if not w or not self.size:
            return len(w), [], set()
        line = f" {b' '.join(w).decode()} "
        found = list(self.automaton.iter(line))
        if not found:
            return len(w), [], set()
        blanks = np.flatnonzero(np.array(list(line), "U1") == " ") if not line.isascii() else np.flatnonzero(np.frombuffer(line.encode(), np.uint8) == 32)
        items = set().union(*{id(own): own for _, (_, own) in found}.values())  # a window that occurs often counts its items once
        ranges: list[tuple[int, int]] = []
        for end, (n, own) in found:
            to = int(np.searchsorted(blanks, end))
            ranges.append((to - n, to))
        return len(w), united(ranges), items - {None}

    def spans(self, text: str | None) -> list[tuple[int, int]]:
        """Character offsets [from, to) of the hit passages in the original text."""
        _, ranges, _ = self.scan(text)
        if not ranges:
            return []
        raw = text.encode()
        keep = _KEEP[np.frombuffer(raw, np.uint8)]
        start = np.flatnonzero(keep & ~np.r_[False, keep[:-1]])
        stop = np.flatnonzero(keep & ~np.r_[keep[1:], False]) + 1
        chars = lambda n: len(raw[:n].decode())
        return [(chars(start[a]), chars(stop[b - 1])) for a, b in ranges]


def _chunks(rows: Iterable[tuple[str, str]], limit: int = AUTOMATON_CHARS):
    """Items by chunks whose patterns fit one automaton."""
    chunk, size = [], 0
    for item, text in rows:
        n = len(text or "") * WINDOW
        if chunk and size + n > limit:
            yield chunk
            chunk, size = [], 0
        chunk.append((item, text))
        size += n
    if chunk:
        yield chunk


def _shared(docs: DataFrame, benchmark: DataFrame) -> list:
    """The items, read to the driver one after another and broadcast in chunks within the bound; at least one chunk."""
    rows = ((None if r.item_id is None else str(r.item_id), r.text) for r in benchmark.select("item_id", "text").toLocalIterator())
    return [docs.sparkSession.sparkContext.broadcast(chunk) for chunk in _chunks(rows)] or [docs.sparkSession.sparkContext.broadcast([])]


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, starts, ends, items) per document: hit word ranges and items.

    All of a benchmark within the bound is one automaton. Beyond it, several follow one another in the same pass over the
    documents; each adds its hits to those a row carries already, so no rows are joined.
    """
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, starts array<long>, ends array<long>, items array<string>"
    out, chunks = docs.select("doc_id", "text"), _shared(docs, benchmark)
    for k, shared in enumerate(chunks):
        more = k + 1 < len(chunks)
        out = out.mapInArrow(_scan(shared, k, more), kinds + (", text string" if more else ""))
    return out


def _scan(shared, before: int, more: bool):
    def scan(batches):
        scanner = Scanner(windows(shared.value))
        for batch in batches:
            for part in common.runs(batch):
                got = [scanner.scan(x) for x in part.column("text").to_pylist()]
                ranges, items = [r for _, r, _ in got], [i for _, _, i in got]
                if before:
                    old = zip(*(part.column(c).to_pylist() for c in ("starts", "ends", "items")))
                    for i, (starts, ends, own) in enumerate(old):
                        ranges[i], items[i] = united([*zip(starts, ends), *ranges[i]]), items[i] | set(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([n for n, _, _ in got], pa.int64()),
                        pa.array([[a for a, _ in r] for r in ranges], pa.list_(pa.int64())),
                        pa.array([[b for _, b in r] for r in ranges], pa.list_(pa.int64())),
                        pa.array([sorted(i) for i in items], pa.list_(pa.string())),
                        *([part.column("text")] if more else []),
                    ],
                    names=["doc_id", "n_words", "starts", "ends", "items", *(["text"] if more else [])],
                )

    return scan


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Digest columns of `hits`: n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    h = hits(docs, benchmark).withColumn("n_hit", n_hit)
    return h.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, all columns; decided where the text is, so nothing is shuffled."""
    common.small_batches(docs.sparkSession)
    out = docs
    for shared in _shared(docs, benchmark):

        def keep(batches, shared=shared):
            scanner = Scanner(windows(shared.value))
            for batch in batches:
                for part in common.runs(batch):
                    yield part.filter(pa.array([not scanner.scan(x)[1] for x in part.column("text").to_pylist()], pa.bool_()))

        out = out.mapInArrow(keep, docs.schema)
    return out


#: Document words are numbered; windows of each width that occurs are joined on their words.
SQL = r"""
WITH words AS (
    SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item, least(len(w), 10) AS width, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS pattern
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM items WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM windows),
grams AS (
    SELECT id, width, k, array_to_string(w[k : k + width - 1], ' ') AS pattern
    FROM (SELECT id, w, width, unnest(range(1, len(w) - width + 2)) AS k FROM words JOIN widths ON len(w) >= width)),
met AS (SELECT id, k, width, pattern FROM grams SEMI JOIN windows USING (width, pattern)),
hit AS (SELECT id, count(DISTINCT place) AS n_hit FROM (SELECT id, unnest(range(k, k + width)) AS place FROM met) GROUP BY id),
own AS (
    SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS line
    FROM (SELECT DISTINCT id, item FROM met JOIN windows USING (width, pattern) WHERE item IS NOT NULL) GROUP BY id)
SELECT words.id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(line, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit ON words.id = hit.id LEFT JOIN own ON words.id = own.id
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
