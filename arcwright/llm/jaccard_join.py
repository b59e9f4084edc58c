"""Size-aware heavy-light Jaccard join on word n-grams.

A document is the set of 64-bit hashes of its distinct n-word shingles. Two documents link when
100 * intersection >= threshold * union. The join is exact on these sets (a hash collision of two shingles, expected
below once in 10**8 distinct shingles, is the only source of error).

1. `shared_prefixes`: documents are read once and each deals the smallest hashes of its set out by hash, packed in
   bytes and combined per task (a hash that a task meets often leaves it once). By the prefix principle a document
   that links to another has several of them in common with others; most documents have not and end here.
2. Sets of the rest; equal sets collapse into a class, represented by its smallest doc_id.
3. Heavy-light candidates between classes. Hashes are ordered rarest first. A light class (few shingles) enumerates
   all 2-subsets of its prefix; a heavy one is entered into the inverted list of each hash of its prefix. The boundary
   is the size at which the cost in rows, taken from the histogram of sizes, is least. Light classes
   within reach of a heavy one are in the lists as well. Classes meeting in a subset or list are joined to the first
   of it only, so candidates stay linear in the input, and their connected components contain every link.
4. Each such component is checked by scanning inverted lists of whole sets in memory; large ones are cut in blocks
   and every pair of blocks is a task. A task gives back a spanning forest of its links, no lists of pairs.

Defined results: null, empty or wordless text has the empty set and links with nothing; fewer words than n make one
shingle; in `components` rows that repeat an id count as one document with the links of each, in `one_of_each` each is judged by
itself; rows without an id have no row in `components` and stay in `one_of_each`; an empty table gives no rows; columns of any
name pass through `one_of_each`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, functions as F

from arcwright.llm import common
from arcwright.operators.components import min_labels
from arcwright.plans.loops import clear, cut

WORDS = 4
THRESHOLD = 85
#: Shingles and classes that one block of a candidate component may hold.
BLOCK_SHINGLES = 400_000
BLOCK_CLASSES = 1500
BLOCK_LEAST = 300
#: Sizes beyond this are heavy whatever the histogram says: their 2-subsets outnumber any list.
LARGEST_LIGHT = 400
#: A list is large with more than HOT_ROWS rows and more than one in HOT_LISTS of all rows.
HOT_LISTS = 1000
HOT_ROWS = 100
#: Bytes of input files whose smallest hashes meet in one bucket, about: a few million hashes.
BUCKET_BYTES = 32 << 20
#: Bytes of text hashed at a time; hashing takes about sixty times as much memory for a moment.
RUN = 512 << 10

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTE = common.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i < n."""
    if len(_POWERS[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            f = np.full(max(n, 1 << 20), b, np.uint64)
            f[0] = 1
            _POWERS[k] = np.multiply.accumulate(f)
    return _POWERS[0][:n], _POWERS[1][:n]


def shingle_sets(column: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes (uint64) of each text's n-word shingles."""
    column = pa.compute.fill_null(column, "")
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    base, size = int(offsets[0]), int(offsets[-1] - offsets[0])
    if not size:
        return [np.zeros(0, np.uint64)] * len(column)
    low = _LOWER[np.frombuffer(column.buffers()[2], np.uint8, size, base)]
    offsets = offsets - base
    word = ~_BLANK[low]
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    before, after = np.r_[False, word[:-1]], np.r_[word[1:], False]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    stops = np.flatnonzero(word & (~after | edge[1:])) + 1
    power, inverse = _powers(size)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(_BYTE[low] * power, out=sums[1:])
    words = common.mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))
    at = np.searchsorted(starts, offsets)
    factors = common.mix(np.arange(11, 11 + n, dtype=np.uint64)) | np.uint64(1)
    if len(words) >= n:
        grams = words[: len(words) - n + 1] * factors[0]
        for k in range(1, n):
            grams = grams + words[k : len(words) - n + 1 + k] * factors[k]
        grams = common.mix(grams)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(common.mix((words[a:b] * factors[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _need(n, threshold: int):
    """Least intersection with any linked set, of a set of n: ceil(threshold * n / 100)."""
    return (threshold * n + 99) // 100


def _share(n):
    """How many hashes of its prefix a linked set of n has in common with its partner, at least."""
    return np.maximum(1, n // 10)


def _join(t: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in t.column(name).to_pylist() if x is not None)])


def shared_prefixes(docs: DataFrame, n: int, threshold: int) -> DataFrame:
    """(doc_id, n_shingles, linked) per document; linked is false only where no link is possible.

    With need(s) = ceil(t * s) and share(s), the s - need(s) + share(s) smallest hashes of two linked sets have
    at least min(share) of them in common, and the partner's size is at least need(s).
    """
    spark = common.small_batches(docs.sparkSession)
    # a bucket is one group in memory, so their number follows the text
    buckets = max(common.partitions(spark), -(-common.estimated_bytes(docs) // BUCKET_BYTES))

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.asarray(batch.column("doc_id"))
            sets = [s for part in common.runs(batch, limit=RUN) for s in shingle_sets(part.column("text"), n)]
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            lengths = np.minimum(sizes, sizes - _need(sizes, threshold) + _share(sizes))
            own = np.repeat(np.arange(len(sets)), lengths)
            hashes = np.concatenate([s[:k] for s, k in zip(sets, lengths)])
            order = np.argsort(hashes, kind="stable")
            hashes, own = hashes[order], own[order]
            first = np.r_[True, hashes[1:] != hashes[:-1]] if len(hashes) else np.zeros(0, bool)
            group = np.cumsum(first) - 1
            many = np.bincount(group, minlength=0)[group] > 1 if len(hashes) else first
            counts = np.bincount(own[many], minlength=len(sets))
            # one row for each hash; that of a hash met twice here needs no answer
            hashes, sender, asks = hashes[first], ids[own[first]], ~many[first]
            to = ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets
            order = np.argsort(to, kind="stable")
            hashes, sender, asks, to = hashes[order], sender[order], asks[order], to[order]
            ends = np.searchsorted(to, np.arange(buckets + 1))
            rows = [(int(ids[0]) % buckets, None, None, None, ids.tobytes(), sizes.tobytes(), counts.astype(np.int64).tobytes())]
            rows += [(k, hashes[a:b].astype(np.uint32).tobytes(), sender[a:b].tobytes(), asks[a:b].tobytes(), None, None, None) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int32(), *[pa.binary()] * 6])], names=["bucket", "hashes", "senders", "asks", "ids", "sizes", "counts"])
        common.release()

    join = _join

    def meet(t: pa.Table) -> pa.Table:
        hashes, senders, asks = join(t, "hashes", np.uint32), join(t, "senders", np.int64), join(t, "asks", bool)
        order = np.argsort(hashes, kind="stable")
        hashes, senders, asks = hashes[order], senders[order], asks[order]
        same = hashes[1:] == hashes[:-1]
        many = np.r_[False, same] | np.r_[same, False] if len(hashes) else np.zeros(0, bool)
        met, times = np.unique(senders[many & asks], return_counts=True)
        ids = join(t, "ids", np.int64)
        # answers go to the documents' own buckets, packed like the questions
        ids, sizes, counts = np.r_[ids, met], np.r_[join(t, "sizes", np.int64), np.full(len(met), -1)], np.r_[join(t, "counts", np.int64), times]
        to = (common.mix(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        ids, sizes, counts, ends = ids[order], sizes[order], counts[order], np.searchsorted(to[order], np.arange(buckets + 1))
        rows = [(k, ids[a:b].tobytes(), sizes[a:b].tobytes(), counts[a:b].tobytes()) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if b > a]
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate([pa.int32(), *[pa.binary()] * 3])], names=["home", "ids", "sizes", "counts"])

    def add(t: pa.Table) -> pa.Table:
        ids, at = np.unique(join(t, "ids", np.int64), return_inverse=True)
        sizes = np.full(len(ids), -1)
        np.maximum.at(sizes, at, join(t, "sizes", np.int64))
        met = np.bincount(at, join(t, "counts", np.int64), minlength=len(ids)).astype(np.int64)
        return pa.table({"doc_id": ids, "n_shingles": sizes, "met": met})

    packed = docs.select("doc_id", "text").mapInArrow(pack, "bucket int, hashes binary, senders binary, asks binary, ids binary, sizes binary, counts binary")
    parts = packed.groupBy("bucket").applyInArrow(meet, "home int, ids binary, sizes binary, counts binary")
    every = parts.groupBy("home").applyInArrow(add, "doc_id long, n_shingles long, met long")
    least = F.floor(F.floor((threshold * F.col("n_shingles") + 99) / 100) / 10)
    return every.select("doc_id", "n_shingles", ((F.col("n_shingles") > 0) & (F.col("met") >= F.greatest(F.lit(1), least))).alias("linked"))


def sets_of(docs: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """(doc_id, n, a, b, hashes) of the chosen ids (a few others may come along); a, b are a digest of the set."""
    bits = common.bloom_bits(chosen.count())
    filter_ = docs.sparkSession.sparkContext.broadcast(common.bloom_build(chosen.select("doc_id"), bits, twice=False))

    def read(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.filter(pa.array(common.bloom_has(filter_.value, bits, np.asarray(batch.column("doc_id")))))
            for part in common.runs(batch, limit=RUN):
                sets = shingle_sets(part.column("text"), n)
                digest = [(s.sum(dtype=np.uint64), common.mix(s + np.uint64(77)).sum(dtype=np.uint64)) for s in sets]
                full = [len(s) > 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(np.array([a for a, _ in digest], np.uint64).view(np.int64)),
                        pa.array(np.array([b for _, b in digest], np.uint64).view(np.int64)),
                        pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n", "a", "b", "hashes"],
                ).filter(pa.array(full, pa.bool_()))
        common.release()

    return docs.select("doc_id", "text").mapInArrow(read, "doc_id long, n long, a long, b long, hashes array<long>")


def light_boundary(sizes: dict[int, int], threshold: int, largest: int = LARGEST_LIGHT) -> int:
    """The largest size that is light: where rows for subsets of the light and for list entries of the heavy are fewest.

    An entry costs two rows, its own and its link to the first of its list; a subset, rarely shared, costs one.
    """
    order = sorted(sizes)
    entry = {s: 2 * sizes[s] * (s - _need(s, threshold) + 1) for s in order}
    subsets = {s: sizes[s] * (p := s - _need(s, threshold) + 2) * (p - 1) / 2 for s in order}
    best, at = sum(entry.values()), 0
    for x in [s for s in order if s <= largest]:
        reach = _need(x + 1, threshold)
        cost = sum(subsets[s] for s in order if s <= x) + sum(entry[s] for s in order if s >= reach)
        if cost < best:
            best, at = cost, x
    return at


def candidates(reps: DataFrame, threshold: int) -> DataFrame:
    """Edges (u, v) between classes such that all linked classes are connected. reps: (rep, n, a, hashes)."""
    each = reps.select("rep", "n", F.explode("hashes").alias("h"), "a")
    seen = cut(each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"))
    sizes = {r.n: r.c for r in reps.where(F.col("n") <= 2 * LARGEST_LIGHT).groupBy("n").agg(F.count("*").alias("c")).collect()}
    light = light_boundary(sizes, threshold)
    n, need = F.col("n"), F.floor((threshold * F.col("n") + 99) / 100)
    # hashes of one class only are its rarest, so they fill the front of its prefix
    ordered = each.join(seen, "h").groupBy("rep", "n", "a").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("o"))
    ordered = ordered.withColumn("alone", n - F.size("o"))
    width = lambda k: F.greatest(F.lit(0), n - need + k - F.col("alone")).cast("int")
    pick = lambda k: F.transform(F.slice("o", 1, width(k)), lambda x: x["h"])
    ordered = cut(ordered.select("rep", "n", pick(1).alias("one"), F.when(n <= light, pick(2)).alias("two")))
    reach = int(_need(light + 1, threshold))
    lists = ordered.where(n >= reach).select("rep", F.explode("one").alias("sig"))
    pairs = F.flatten(F.transform("two", lambda x, i: F.transform(F.slice("two", i + 2, F.size("two")), lambda y: F.xxhash64(x, y))))
    subsets = ordered.where((n <= light) & (F.size("two") > 1)).select("rep", F.explode(pairs).alias("sig"))
    met = lists.union(subsets)
    firsts = cut(met.groupBy("sig").agg(F.min("rep").alias("v"), F.count("*").alias("c")).where("c > 1"))
    # lists that hold more than their share of all rows, fewer than HOT_LISTS of them, are broadcast and meet in no task
    most = max(HOT_ROWS, (firsts.agg(F.sum("c")).first()[0] or 0) // HOT_LISTS)
    large = firsts.where(F.col("c") > most).select("sig", F.col("v").alias("first"))
    flagged = met.join(F.broadcast(large), "sig", "left")
    edges = flagged.where("first is not null").select(F.col("rep").alias("u"), F.col("first").alias("v"))
    rest = flagged.where("first is null").select("sig", "rep").join(firsts.where(F.col("c") <= most).select("sig", "v"), "sig")
    return edges.union(rest.select(F.col("rep").alias("u"), "v")).where("u <> v").distinct()


def verified(clusters: DataFrame, threshold: int) -> DataFrame:
    """Edges (u, v): a spanning forest of the links. clusters: (cluster, rep, n, hashes)."""
    spark = clusters.sparkSession
    size = clusters.groupBy("cluster").agg(F.sum("n").alias("t"), F.count("*").alias("m"))
    # about sixteen blocks, of no fewer than BLOCK_LEAST classes and within the bounds
    per = F.least(F.greatest(F.col("m") / 16, F.lit(BLOCK_LEAST)), F.lit(BLOCK_CLASSES))
    blocks = F.greatest(F.ceil(F.col("t") / BLOCK_SHINGLES), F.ceil(F.col("m") / per)).cast("int")
    size = size.select("cluster", blocks.alias("blocks"), "t")
    c = clusters.join(size, "cluster")
    small = c.where("blocks = 1")
    tasks = max(common.partitions(spark), int((small.agg(F.sum("n")).first()[0] or 0) // BLOCK_SHINGLES) + 1)
    small = small.select(F.concat(F.lit("s"), F.pmod(F.xxhash64("cluster"), F.lit(tasks))).alias("task"), "cluster", F.lit(0).alias("side"), "rep", "n", "hashes")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    large = c.where("blocks > 1").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.select(
        F.concat_ws("/", F.lit("b"), "cluster", F.least("own", "other"), F.greatest("own", "other")).alias("task"),
        "cluster",
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
        "rep",
        "n",
        "hashes",
    )

    def check(t: pa.Table) -> pa.Table:
        cluster, side, rep, n = (t.column(k).to_numpy() for k in ("cluster", "side", "rep", "n"))
        hashes = t.column("hashes").combine_chunks()
        flat, offsets = hashes.flatten().to_numpy(), np.r_[0, np.cumsum(n)]
        us, vs = [], []
        order = np.argsort(cluster, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
            for a, b in _links([flat[offsets[i] : offsets[i + 1]] for i in own], side[own], threshold):
                us.append(rep[own[a]])
                vs.append(rep[own[b]])
        common.release()
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return small.union(large).groupBy("task").applyInArrow(check, "u long, v long")


def _links(sets: list[np.ndarray], side: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets; where both sides 1 and 2 are there, of those between the sides."""
    m = len(sets)
    if m < 2:
        return []
    n = np.fromiter(map(len, sets), np.int64, m)
    _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), n)
    order = np.argsort(token, kind="stable")
    begin = np.r_[0, np.cumsum(df)]
    lists = owner[order]
    at = np.r_[0, np.cumsum(n)]
    parent = np.arange(m)

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i in range(m):
        own = token[at[i] : at[i + 1]]
        own = own[df[own] > 1]
        if len(own) < _need(n[i], threshold):
            continue
        length = df[own]
        stop = np.cumsum(length)
        met = np.bincount(lists[np.repeat(begin[own] - (stop - length), length) + np.arange(stop[-1])], minlength=m)
        linked = 100 * met >= threshold * (n[i] + n - met)
        linked[: i + 1] = False
        if side[i]:
            linked &= side != side[i]
        for j in np.flatnonzero(linked):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, int(j)))
    return out


def components(docs: DataFrame, n: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    every = cut(shared_prefixes(docs, n, threshold))
    clear(docs.sparkSession)
    sets = cut(sets_of(docs, every.where("linked").select("doc_id"), n))
    classes = cut(sets.groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep")))
    member = sets.select("doc_id", "n", "a", "b").join(classes, ["n", "a", "b"]).select("doc_id", "rep").where("doc_id <> rep")
    # one row for each class: that of its representative
    reps = cut(sets.join(classes.withColumn("doc_id", F.col("rep")), ["doc_id", "n", "a", "b"]).select("rep", "n", "a", "hashes"))
    edges = cut(candidates(reps, threshold))
    clear(docs.sparkSession)
    cluster = min_labels(edges)
    clear(docs.sparkSession)
    clusters = reps.join(cluster.select(F.col("v").alias("rep"), F.col("component").alias("cluster")), "rep")
    found = cut(verified(clusters, threshold))
    del cluster, clusters, edges
    clear(docs.sparkSession)
    links = found.union(member.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    label = min_labels(links)
    return every.join(label, every.doc_id == label.v, "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """The first row of each component, all columns; rows without an id stay.

    First is the smallest id. Rows that repeat an id are judged one by one, after all others: each is a document of its own,
    numbered beyond the largest id in the order of the rows.
    """
    (key, flag), columns = common.fresh(docs.columns, "key", "maybe"), docs.columns
    repeated = cut(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"))
    if repeated.isEmpty():
        keyed = docs.withColumn(key, F.col("doc_id"))
    else:
        top = docs.agg(F.max("doc_id")).first()[0]
        marked = docs.join(repeated.withColumn(flag, F.lit(True)), "doc_id", "left")
        keyed = cut(marked.withColumn(key, F.when(F.col(flag), F.lit(top) + 1 + F.monotonically_increasing_id()).otherwise(F.col("doc_id"))).drop(flag))
    gone = cut(components(keyed.select(F.col(key).alias("doc_id"), "text"), n, threshold).where("doc_id <> component_id").select(F.col("doc_id").alias(key)))
    bits = common.bloom_bits(gone.count())
    filter_ = docs.sparkSession.sparkContext.broadcast(common.bloom_build(gone, bits, twice=False))

    @F.pandas_udf("boolean")
    def maybe(ids):
        import pandas as pd

        return pd.Series(common.bloom_has(filter_.value, bits, ids.to_numpy(np.int64)))

    flagged = keyed.withColumn(flag, maybe(F.coalesce(key, F.lit(-1).cast("long"))))
    rest = flagged.where(flag).join(gone, key, "left_anti")
    return flagged.where(~F.col(flag)).select(*columns).union(rest.select(*columns))


#: Every pair that shares a shingle, and all that is reached by links: for tables of a few thousand documents.
SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
    SELECT DISTINCT id, array_to_string(w[k : k + 3], ' ') AS s
    FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM words WHERE len(w) > 0)),
sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
links AS (
    SELECT a, b FROM (
        SELECT x.id AS a, y.id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.s = y.s AND x.id <> y.id GROUP BY x.id, y.id)
    JOIN sizes p ON p.id = a JOIN sizes q ON q.id = b WHERE 100 * common >= 85 * (p.n + q.n - common)),
reached AS (SELECT id AS a, id AS b FROM words UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT words.id AS doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM words LEFT JOIN sizes USING (id) JOIN (SELECT a AS id, min(b) AS component_id FROM reached GROUP BY a) USING (id)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(common.table(spark, sf_dir, "documents"))
