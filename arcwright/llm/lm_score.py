"""Masked pseudo-likelihood with a bidirectional window network.

Texts are cut in words once; each run of texts is kept as numbers with a dictionary of its own. Words are counted over all
documents. The WORDS most frequent and CLASSES classes of all others (by length and last letter) are the leaves of a binary
tree, built so that frequent leaves are near its root. A network with one hidden layer sees the embeddings of SIDE words on
either side of a place, never the word there, and decides at every node on the way to that word's leaf, so the
probabilities of all leaves add up to one and a place costs its leaf's depth, however many words there are. A word beyond
the vocabulary is predicted by its class, then by one of CELLS cells of the class in proportion to the cell's count
in the corpus, then as one of the distinct words of the cell.

The network is trained in numpy on every place of every whole text: the rounds deal all places out among themselves, so that
each is trained on once; in a round every task runs minibatch descent over its own places, and the tasks' parameters are
averaged, each row (a word's embedding, a node) weighted by how often a task met it. A document's score is the sum over
all its places of log p(word | both sides).

Bounds, whatever the corpus: WORDS words of the vocabulary, CLASSES * CELLS cells. Parameters take at most 1.6 MB. Averaging is
done in two steps, so a task adds up about the square root of the number of tasks, and the driver as many, one after another.

Defined results: null or wordless text has no places, score 0 and mean null; words that the vocabulary has not seen are scored
by their class and cell as one more word of it; rows that repeat an id or a text are scored each and count each in training;
an empty table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from arcwright.llm import common
from arcwright.plans.loops import cut

SIDE = 2
WORDS = 16_320
CLASSES = 64
CELLS = 1024
EMBED, HIDDEN = 8, 15  # even numbers of columns, HIDDEN with one more for the bias
#: Steps of descent, round by round.
RATES = (1.0, 0.7, 0.4)
#: What the steps of embeddings and of nodes are multiplied by, and the most that a row moves along the mean of its gradients.
EMBED_RATE, EMBED_MOST = 32.0, 8.0
NODE_RATE, NODE_MOST = 10.0, 1.0
BATCH = 4096
#: Nodes nearest to the root, which most places pass: they are worked on as one dense matrix.
DENSE = 64
SIDES = np.r_[-SIDE:0, 1 : SIDE + 1]
#: A word's number in a line.
NUMBER = np.uint16
#: Characters of text in one line, about.
LINE_CHARS = 6 << 20
#: Places that a task of training has at least, so that the parameters it returns stay small beside them.
TASK_PLACES = 8_000_000
SEED = 71

_WORD = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+")
_WORD_ASCII = re.compile(r"[a-z0-9]+|[^a-z0-9]+")


def _cut(token: str) -> list[str]:
    return (_WORD_ASCII if token.isascii() else _WORD).findall(token)


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, and runs of other characters, between blanks; lower case."""
    return [w for token in (text or "").lower().split() for w in _cut(token)]


def word_class(word: str) -> int:
    return (ord(word[-1]) * 4 + min(len(word) // 4, 3)) % CLASSES


def word_cell(word: str) -> int:
    """The cell of a word beyond the vocabulary, its class included."""
    return word_class(word) * CELLS + zlib.crc32(word.encode("utf-8", "surrogatepass")) % CELLS


def raw_lines(docs: DataFrame) -> DataFrame:
    """(doc_ids, n, known, line): several texts in one row, their words as places in the row's own list of distinct words.

    Texts are split at blanks; only distinct pieces are cut further.
    """

    def run(batches):
        doc_ids, pieces, size = [], [], 0
        known, sizes = _numbering(), []
        for batch in batches:
            for part in common.runs(batch):
                doc_ids += part.column("doc_id").to_pylist()
                for text in part.column("text").to_pylist():
                    own = (text or "").lower().split()
                    size += len(text or "")
                    sizes.append(len(own))
                    pieces.append(np.fromiter(map(known.__getitem__, own), np.uint32, len(own)))
                if size > LINE_CHARS:
                    yield _raw_line(doc_ids, np.concatenate(pieces), np.array(sizes), list(known))
                    doc_ids, pieces, size = [], [], 0
                    known, sizes = _numbering(), []
        if doc_ids:
            yield _raw_line(doc_ids, np.concatenate(pieces), np.array(sizes), list(known))
        common.release()

    common.small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_ids array<long>, n array<long>, known array<string>, line binary")


def _numbering() -> defaultdict:
    """Gives each new key the next number."""
    made: defaultdict = defaultdict()
    made.default_factory = made.__len__
    return made


def _raw_line(doc_ids: list, pieces: np.ndarray, sizes: np.ndarray, known: list[str]) -> pa.RecordBatch:
    number, flat, length = _numbering(), [], np.zeros(len(known), np.int64)
    for i, piece in enumerate(known):
        own = _cut(piece)
        length[i] = len(own)
        flat += [number[w] for w in own]
    begin = np.cumsum(length) - length
    n = length.take(pieces)
    stop = np.cumsum(n)
    line = np.array(flat, np.uint32).take(np.repeat(begin.take(pieces) - (stop - n), n) + np.arange(n.sum())) if len(pieces) else np.zeros(0, np.uint32)
    ends = np.r_[0, stop].take(np.cumsum(sizes))
    return pa.RecordBatch.from_arrays(
        [pa.array([doc_ids], pa.list_(pa.int64())), pa.array([np.diff(np.r_[0, ends])], pa.list_(pa.int64())), pa.array([list(number)], pa.list_(pa.string())), pa.array([line.tobytes()], pa.binary())],
        names=["doc_ids", "n", "known", "line"],
    )


def counts(raw: DataFrame) -> DataFrame:
    """(word, n) over all documents, added up in each task first."""

    def pairs(total) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for known, line in zip(batch.column("known"), batch.column("line")):
                known = known.as_py()
                for w, k in zip(known, np.bincount(np.frombuffer(line.as_py(), np.uint32), minlength=len(known)).tolist()):
                    total[w] += k
                if len(total) > 300_000:
                    yield pairs(total)
                    total.clear()
        yield pairs(total)

    return raw.select("known", "line").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def huffman(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, side) of leaves 0.. and inner nodes after them, the last being the root: the lightest two are joined again and again."""
    m = len(weights)
    heap = [(int(x), i) for i, x in enumerate(weights)]
    heapq.heapify(heap)
    parent, side = np.zeros(2 * m - 1, np.int32), np.zeros(2 * m - 1, np.int8)
    for k in range(m, 2 * m - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = k
        side[j] = 1
        heapq.heappush(heap, (a + b, k))
    return parent, side


def vocabulary(raw: DataFrame) -> dict:
    """number: of each word; tree: parents and sides; start: log odds of each node, where training starts; share: log p of a word within its class, by cell."""
    spark = raw.sparkSession
    c = cut(counts(raw))
    top = c.orderBy(F.desc("n"), "word").limit(WORDS).collect()
    number = {r.word: i for i, r in enumerate(top)}
    beyond = c.join(F.broadcast(spark.createDataFrame([(w,) for w in number], "word string")), "word", "left_anti")

    def run(batches):
        size, n = np.zeros(CLASSES * CELLS, np.int64), np.zeros(CLASSES * CELLS, np.int64)
        for batch in batches:
            cells = np.fromiter(map(word_cell, batch.column("word").to_pylist()), np.int64, batch.num_rows)
            size += np.bincount(cells, minlength=len(size))
            np.add.at(n, cells, np.asarray(batch.column("n")))
        at = np.flatnonzero(size)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, size[at], n[at])], names=["cell", "words", "n"])

    per = beyond.mapInArrow(run, "cell long, words long, n long").groupBy("cell").agg(F.sum("words").alias("words"), F.sum("n").alias("n"))
    size, n = np.zeros(CLASSES * CELLS), np.zeros(CLASSES * CELLS)
    for r in per.collect():
        size[r.cell], n[r.cell] = r.words, r.n
    total = n.reshape(CLASSES, CELLS).sum(1)
    share = np.log((n + 1) / np.repeat(total + CELLS, CELLS)) - np.log(size + 1)
    weights = np.r_[[r.n for r in top], total + 1].astype(np.int64)
    parent, side = huffman(weights)
    mass = np.r_[weights, np.zeros(len(weights) - 1, np.int64)].astype(float)
    one = np.zeros(len(mass))
    for i in range(len(mass) - 1):  # parents come after their children
        mass[parent[i]] += mass[i]
        one[parent[i]] += mass[i] * side[i]
    p = (one / mass)[len(weights) :]
    return {"number": number, "tree": (parent, side), "start": np.log(p / (1 - p))[::-1].astype(np.float32), "share": share}


class Tree:
    """For each leaf the nodes on its way, numbered from the root, and the sides taken; those of the dense top apart from the others."""

    def __init__(self, parent: np.ndarray, side: np.ndarray):
        m = self.leaves = (len(parent) + 1) // 2
        root = 2 * m - 2
        leaf, at = np.arange(m), np.arange(m)
        way = []
        while len(leaf):
            inner = at != root
            leaf, at = leaf[inner], at[inner]
            way.append((leaf, root - parent[at], side[at]))
            at = parent[at]
        leaf, node, turn = (np.concatenate(x) for x in zip(*way))
        self.dense = min(DENSE, m - 1)
        self.parts = []
        for own in (node < self.dense, node >= self.dense):
            order = np.argsort(leaf[own], kind="stable")
            length = np.bincount(leaf[own], minlength=m)
            self.parts.append(((np.cumsum(length) - length).astype(np.int32), length.astype(np.int32), node[own][order].astype(NUMBER), turn[own][order].astype(np.float32)))

    def way(self, leaf: np.ndarray):
        """In the dense top: length of each leaf's way, where the ways begin, and all their nodes and sides."""
        start, length, node, turn = self.parts[0]
        n = length.take(leaf)
        stop = np.cumsum(n, dtype=np.int32)
        at = np.repeat(start.take(leaf) - (stop - n), n)
        at += np.arange(len(at), dtype=np.int32)
        return n, stop - n, node.take(at), turn.take(at)

    def below(self, leaf: np.ndarray):
        """Below the top: which leaves go on, longest ways first, and step by step how many still do, with their nodes and sides."""
        start, length, node, turn = self.parts[1]
        n = length.take(leaf)
        rows = np.argsort(-n.astype(np.int16), kind="stable")
        going = len(n) - np.cumsum(np.bincount(n))
        rows = rows[: going[0]]
        start = start.take(leaf.take(rows))

        def steps():
            for k, m in enumerate(going[:-1].tolist()):
                at = start[:m] + k
                yield m, node.take(at), turn.take(at)

        return rows, int(n.sum()), steps()


_trees: dict[tuple, Tree] = {}


def tree_of(parent: np.ndarray, side: np.ndarray) -> Tree:
    """One a worker process, for the tasks that follow one another there."""
    key = (len(parent), zlib.crc32(parent.tobytes()), zlib.crc32(side.tobytes()), DENSE)
    if key not in _trees:
        _trees.clear()
        _trees[key] = Tree(parent, side)
    return _trees[key]


class Network:
    """Parameters as one flat vector, so that averages are plain sums."""

    def __init__(self, tree: Tree, flat: np.ndarray | None = None):
        self.tree, self.edge = tree, tree.leaves
        shapes = [("e", (tree.leaves + 1, EMBED)), ("t", (tree.leaves - 1, HIDDEN + 1)), ("w", (2 * SIDE * EMBED, HIDDEN)), ("b", (1, HIDDEN))]
        size = sum(int(np.prod(s)) for _, s in shapes)
        fresh = flat is None
        self.flat = np.random.default_rng(SEED).standard_normal(size).astype(np.float32) * np.float32(0.2) if fresh else flat.astype(np.float32).copy()
        self.rows, at = [], 0
        for name, shape in shapes:
            n = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + n].reshape(shape))
            self.rows.append(shape)
            at += n
        if fresh:
            self.t[:] = 0
            self.b[:] = 0
        #: How often each embedding and node was trained on, and how many places.
        self.met = [np.zeros(len(self.e), np.int64), np.zeros(len(self.t), np.int64)]
        self.seen = 0

    def weights(self) -> np.ndarray:
        """How often each row of the parameters was trained on."""
        return np.r_[self.met[0], self.met[1], np.full(sum(s[0] for s in self.rows[2:]), self.seen)].astype(np.float32)

    def spread(self, weights: np.ndarray) -> np.ndarray:
        """Of each row, for each parameter."""
        return np.repeat(weights, np.concatenate([np.full(s[0], s[1]) for s in self.rows]))

    def _hidden(self, context: np.ndarray):
        x = self.e.take(context, axis=0).reshape(len(context), -1)
        h = np.empty((len(context), HIDDEN + 1), np.float32)
        z = x @ self.w
        z += self.b
        np.tanh(z, out=h[:, :HIDDEN])
        h[:, HIDDEN] = 1
        return x, h

    def _top(self, h: np.ndarray, leaf: np.ndarray):
        """Log odds at the dense nodes: all of them, where those on the ways are, and what is said of ways."""
        z = h @ self.t[: self.tree.dense].T
        n, begin, node, turn = self.tree.way(leaf)
        at = np.repeat(np.arange(0, len(leaf) * self.tree.dense, self.tree.dense, dtype=np.int64), n)
        at += node
        return z, at, begin, node, turn

    def log_p(self, context: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        _, h = self._hidden(context)
        z, at, begin, _, turn = self._top(h, leaf)
        out = -np.add.reduceat(np.log(_odds(z.ravel().take(at), turn)), begin).astype(np.float64)
        rows, _, steps = self.tree.below(leaf)
        h, total = h.take(rows, axis=0), np.ones(len(rows))
        for k, (m, node, turn) in enumerate(steps):
            total[:m] *= _odds(np.einsum("ij,ij->i", h[:m], self.t.take(node, axis=0)), turn)
            if k % 16 == 15:  # factors of up to e**30 each stay within a double
                out[rows] -= np.log(total)
                total[:] = 1
        out[rows] -= np.log(total)
        return out

    def step(self, context: np.ndarray, leaf: np.ndarray, rate: float) -> None:
        n, dense = len(leaf), self.tree.dense
        x, h = self._hidden(context)
        z, at, _, node, turn = self._top(h, leaf)
        g = _error(z.ravel().take(at), turn)
        z.fill(0)
        z.ravel()[at] = g
        back = z @ self.t[:dense]
        met = np.bincount(node, minlength=dense)
        top = z.T @ h
        top *= _damped(rate, NODE_RATE, NODE_MOST, n, np.maximum(met, 1.0))
        self.met[1][:dense] += met
        rows, visits, steps = self.tree.below(leaf)
        if len(rows):
            own, nodes, to = np.empty((visits, HIDDEN + 1), np.float32), np.empty(visits, NUMBER), 0
            hr, deep = h.take(rows, axis=0), np.zeros((len(rows), HIDDEN + 1), np.float32)
            for m, node, turn in steps:
                t = self.t.take(node, axis=0)
                g = _error(np.einsum("ij,ij->i", hr[:m], t), turn)[:, None]
                t *= g
                deep[:m] += t
                np.multiply(hr[:m], g, out=own[to : to + m])
                nodes[to : to + m] = node
                to += m
            back[rows] += deep
            self._descend(self.t, 1, nodes, own, n, rate, NODE_RATE, NODE_MOST)
        self.t[:dense] -= top
        back = back[:, :HIDDEN] * (1 - h[:, :HIDDEN] ** 2)
        gx = (back @ self.w.T).reshape(-1, EMBED)
        self.w -= np.float32(rate / n) * (x.T @ back)
        self.b -= np.float32(rate / n) * back.sum(0)
        self._descend(self.e, 0, context.reshape(-1), gx, n, rate, EMBED_RATE, EMBED_MOST)
        self.seen += n

    def _descend(self, table: np.ndarray, which: int, row: np.ndarray, g: np.ndarray, n: int, rate: float, times: float, most: float) -> None:
        """Takes each row's gradients together."""
        order = np.argsort(row, kind="stable")
        row = row.take(order)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        # pairs of floats are added as complex numbers, which halves the work a row
        total = np.add.reduceat(g.take(order, axis=0).view(np.complex64), first, axis=0).view(np.float32)
        met = np.diff(np.r_[first, len(row)])
        total *= _damped(rate, times, most, n, met)
        row = row.take(first)
        table[row] -= total
        self.met[which][row] += met


def _damped(rate: float, times: float, most: float, n: int, met: np.ndarray) -> np.ndarray:
    """Factors of the sums of gradients of rows met so often in n places: as for a mean over n, but larger for rarer rows."""
    met = met.astype(float)
    return (rate * np.minimum(times / np.sqrt(n * met), most / met)).astype(np.float32)[:, None]


def _error(z: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """p(side 1) less the side taken."""
    z = np.negative(np.clip(z, -30, 30))
    np.exp(z, out=z)
    z += 1
    np.reciprocal(z, out=z)
    z -= turn
    return z


def _odds(z: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """1 / p(side taken)."""
    z = np.clip(z * (1 - 2 * turn), -30, 30)
    np.exp(z, out=z)
    z += 1
    return z


def lines(raw: DataFrame, vocab: dict) -> DataFrame:
    """(doc_ids, n, line, cells): the numbers of the words of several texts, a gap of SIDE before and after each; cells of those beyond the vocabulary."""
    shared = raw.sparkSession.sparkContext.broadcast(vocab["number"])

    def run(batches):
        number = shared.value
        base, edge = len(number), len(number) + CLASSES
        for batch in batches:
            for ids, n, known, line in zip(batch.column("doc_ids"), batch.column("n").to_pylist(), batch.column("known"), batch.column("line")):
                known, n = known.as_py(), np.array(n, np.int64)
                cell = np.full(len(known), -1, np.int64)
                leaf = np.fromiter((number.get(w, -1) for w in known), np.int64, len(known))
                for i in np.flatnonzero(leaf < 0).tolist():
                    cell[i] = word_cell(known[i])
                    leaf[i] = base + cell[i] // CELLS
                raw_ = np.frombuffer(line.as_py(), np.uint32)
                out = np.full(len(raw_) + SIDE * (len(n) + 1), edge, NUMBER)
                out[_places(n)[1]] = leaf.astype(NUMBER)[raw_]
                cells = cell[raw_]
                yield pa.RecordBatch.from_arrays([pa.array([ids.as_py()], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64())), pa.array([out.tobytes()], pa.binary()), pa.array([cells[cells >= 0].astype(np.uint16).tobytes()], pa.binary())], names=["doc_ids", "n", "line", "cells"])
        common.release()

    return raw.mapInArrow(run, "doc_ids array<long>, n array<long>, line binary, cells binary")


def _places(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of each place, and where the place is in the line."""
    own = np.repeat(np.arange(len(n)), n)
    return own, np.arange(len(own)) + SIDE * (own + 1)


def _turn(n: np.ndarray, turn: int, turns: int) -> np.ndarray:
    """The places in a line that a round trains on, in random order; each place is in one of the rounds."""
    return np.random.default_rng(SEED).permutation(_places(n)[1][turn::turns])


def descend(made: DataFrame, vocab: dict, rates: tuple = RATES) -> np.ndarray:
    """The parameters, trained on `lines`."""
    spark, turns = made.sparkSession, len(rates)
    places = made.select(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    tasks = max(1, min(made.rdd.getNumPartitions(), -(-places // TASK_PLACES)))
    made, groups = made.select("n", "line").coalesce(tasks), max(1, int(np.sqrt(tasks)))
    net = Network(Tree(*vocab["tree"]))
    net.t[:, HIDDEN] = vocab["start"]
    flat = net.flat
    if not places:
        return flat
    for turn, rate in enumerate(rates):
        shared = spark.sparkContext.broadcast((vocab["tree"], flat, rate, turn))

        def run(batches, shared=shared):
            from pyspark import TaskContext

            tree, start, rate, turn = shared.value
            net = Network(tree_of(*tree), start)
            for batch in batches:
                for n, packed in zip(batch.column("n").to_pylist(), batch.column("line")):
                    line, at = np.frombuffer(packed.as_py(), NUMBER), _turn(np.array(n, np.int64), turn, turns)
                    for i in range(0, len(at), BATCH):
                        here = at[i : i + BATCH]
                        net.step(line.take(here[:, None] + SIDES), line.take(here), rate * min(1.0, np.sqrt(len(here) / BATCH)))
            if net.seen:
                weights = net.weights()
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % groups], pa.int32()), pa.array([weights.tobytes()], pa.binary()), pa.array([(net.flat * net.spread(weights)).tobytes()], pa.binary())], names=["g", "weights", "sum"])
            common.release()

        def add(t: pa.Table) -> pa.Table:
            weights, total = _added(zip(t.column("weights").to_pylist(), t.column("sum").to_pylist()))
            return pa.table({"g": t.column("g")[:1], "weights": pa.array([weights.astype(np.float32).tobytes()], pa.binary()), "sum": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

        schema = "g int, weights binary, sum binary"
        parts = cut(made.mapInArrow(run, schema).groupBy("g").applyInArrow(add, schema))
        weights, total = _added((r.weights, r["sum"]) for r in parts.orderBy("g").toLocalIterator())
        weights = net.spread(weights)
        flat = np.where(weights > 0, total / np.maximum(weights, 1), flat).astype(np.float32)
    return flat


def _added(rows) -> tuple[np.ndarray, np.ndarray]:
    weights, total = 0, 0
    for w, s in rows:
        weights, total = weights + np.frombuffer(w, np.float32).astype(float), total + np.frombuffer(s, np.float32).astype(float)
    return weights, total


def train(docs: DataFrame, rates: tuple = RATES) -> tuple[dict, np.ndarray]:
    """The vocabulary, and the parameters as one vector."""
    raw = cut(raw_lines(docs))
    vocab = vocabulary(raw)
    return vocab, descend(cut(lines(raw, vocab)), vocab, rates)


def score(docs: DataFrame, vocab: dict, flat: np.ndarray) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_p) of every whole text."""
    return score_lines(lines(raw_lines(docs), vocab), vocab, flat)


def score_lines(made: DataFrame, vocab: dict, flat: np.ndarray) -> DataFrame:
    """The same for the texts of `lines`."""
    shared = made.sparkSession.sparkContext.broadcast((vocab["tree"], vocab["share"], len(vocab["number"]), flat))

    def run(batches):
        tree, share, known, flat = shared.value
        net = Network(tree_of(*tree), flat)
        for batch in batches:
            for ids, n, packed, cells in zip(batch.column("doc_ids"), batch.column("n").to_pylist(), batch.column("line"), batch.column("cells")):
                n, line = np.array(n, np.int64), np.frombuffer(packed.as_py(), NUMBER)
                own, at = _places(n)
                p = np.zeros(len(own))
                for i in range(0, len(own), 2 * BATCH):
                    here = at[i : i + 2 * BATCH]
                    p[i : i + 2 * BATCH] = net.log_p(line.take(here[:, None] + SIDES), line.take(here))
                p[line.take(at) >= known] += share.take(np.frombuffer(cells.as_py(), np.uint16))
                total = np.bincount(own, p, minlength=len(n)).astype(float)
                mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids.as_py(), pa.int64()), pa.array(n), pa.array(total), mean], names=["doc_id", "n_tokens", "log_likelihood", "mean_log_p"])
        common.release()

    return made.mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double, mean_log_p double")


SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = cut(raw_lines(common.table(spark, sf_dir, "documents")))
    vocab = vocabulary(raw)
    made = cut(lines(raw, vocab))
    return score_lines(made, vocab, descend(made, vocab))
