"""Language identification by hyperdimensional profiles.

Every letter has a random +1/-1 vector (fixed by its code point), a trigram is the product of its letters' vectors
rotated by their places, a text is the sum of its trigrams, and a language's prototype is the sum of its training
texts, each of length one. A text gets the language whose prototype has the largest cosine with it.

Training takes about SAMPLE documents a language (a documented bound: the share that is expected to give so many, by
hash of the id) of the LANGUAGES values of lang that most documents have (a second bound); any value is a language, however
odd. Prediction reads every text whole. Prototypes are languages x DIMENSIONS floats.

Defined results: `und` with score 0 for null text or text without a letter, and where no language is known; ties go to
the language first in order, and so does a text with letters but too short for a trigram; a null or empty lang is not learned;
rows that repeat an id are predicted each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from arcwright.llm import common

DIMENSIONS = 1024
SAMPLE = 2000
LANGUAGES = 500
SEED = 20_061
#: Cosines are sharpened by this factor before they are made into shares.
SHARPNESS = 40.0
RUN = 256 << 10
_TERMS = 8192

_letters: list[np.ndarray] = []
_vectors: dict[int, np.ndarray] = {}


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def letter_vector(code: int) -> np.ndarray:
    if code not in _vectors:
        if len(_vectors) > 20_000:
            _vectors.clear()
        bits = np.random.Generator(np.random.Philox(key=[SEED, code])).integers(0, 2, DIMENSIONS, np.int8)
        _vectors[code] = 2 * bits - 1
    return _vectors[code]


def bundle(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of the texts, which of them have a letter)."""
    low = [(t or "").lower() for t in texts]
    lengths = np.fromiter((len(t) + 1 for t in low), np.int64, len(low))
    codes = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _is_letter()[codes]
    keep = is_letter | np.r_[False, is_letter[:-1]]
    owner = np.repeat(np.arange(len(low)), lengths)[keep]
    codes = np.where(is_letter, codes, 0)[keep]
    present = np.zeros(0x110000, bool)
    present[codes] = True
    alphabet = np.flatnonzero(present)
    has = np.bincount(owner, minlength=len(low)) > 0
    out = np.zeros((len(low), DIMENSIONS), np.float32)
    if len(codes) < 3:
        return out, has
    number = np.zeros(0x110000, np.int64)
    number[alphabet] = np.arange(len(alphabet))
    s, k = number[codes], len(alphabet)
    grams = (s[:-2] * k + s[1:-1]) * k + s[2:]
    same = owner[:-2] == owner[2:]
    grams, owner = grams[same], owner[:-2][same]
    if k**3 <= 1 << 22:
        seen = np.zeros(k**3, bool)
        seen[grams] = True
        terms = np.flatnonzero(seen)
        place = np.zeros(k**3, np.int64)
        place[terms] = np.arange(len(terms))
        at = place[grams]
    else:
        terms, at = np.unique(grams, return_inverse=True)
    vectors = np.stack([letter_vector(int(c)) for c in alphabet])
    first, second = np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1)
    for i in range(0, len(terms), _TERMS):
        t = terms[i : i + _TERMS]
        inside = (at >= i) & (at < i + _TERMS) if len(terms) > _TERMS else slice(None)
        counts = np.bincount(owner[inside] * len(t) + at[inside] - i, minlength=len(low) * len(t)).reshape(len(low), len(t)).astype(np.float32)
        bound = first[t // (k * k)] * second[t // k % k] * vectors[t % k]
        out += counts @ bound.astype(np.float32)
    return out, has


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """docs: (doc_id, text, lang). Languages in order and their prototypes.

    Bundles are summed per task and then per language, so the driver gets one vector a language.
    """
    common.small_batches(docs.sparkSession)
    known = docs.where("lang is not null and lang <> '' and text is not null")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).withColumn("rate", F.lit(float(sample)) / F.col("n"))
    rates = {r.lang: r.rate for r in sizes.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not rates:
        return [], np.zeros((0, DIMENSIONS), np.float32)
    unit = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[F.lit(x) for kv in rates.items() for x in kv])[F.col("lang")]
    chosen = known.where(unit < share).select("text", "lang")

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in common.runs(batch, limit=RUN):
                vectors, has = bundle(part.column("text").to_pylist())
                vectors, langs = _unit(vectors), np.array(part.column("lang").to_pylist(), object)
                for lang in set(langs[has]):
                    sums[lang] = sums.get(lang, 0) + vectors[has & (langs == lang)].sum(0, dtype=np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["lang", "v"])

    def add(t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x) for x in t.column("v").to_pylist()], axis=0)
        return pa.table({"lang": t.column("lang")[:1], "v": pa.array([total.tobytes()], pa.binary())})

    got = sorted((r.lang, np.frombuffer(r.v)) for r in chosen.mapInArrow(run, "lang string, v binary").groupBy("lang").applyInArrow(add, "lang string, v binary").collect())
    return [lang for lang, _ in got], _unit(np.array([v for _, v in got], np.float32).reshape(-1, DIMENSIONS))


def identify(docs: DataFrame, languages: list[str], prototypes: np.ndarray) -> DataFrame:
    """docs without text, and lang_pred, score (which replace columns of these names)."""
    shared = docs.sparkSession.sparkContext.broadcast((languages, prototypes))
    rest = [c for c in docs.columns if c.lower() not in ("text", "lang_pred", "score")]

    def run(batches):
        names, proto = shared.value
        for batch in batches:
            for part in common.runs(batch, limit=RUN):
                vectors, has = bundle(part.column("text").to_pylist())
                if names:
                    cosine = _unit(vectors) @ proto.T
                    best = cosine.argmax(axis=1)
                    share = 1 / np.exp(SHARPNESS * (cosine - cosine[np.arange(len(best)), best][:, None])).sum(axis=1)
                    lang = [names[b] if h else "und" for b, h in zip(best, has)]
                else:
                    lang, share = ["und"] * len(has), np.zeros(len(has))
                    has = np.zeros(len(has), bool)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(lang, pa.string()), pa.array(np.where(has, share, 0.0), pa.float64())], names=[*rest, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([docs.schema[c] for c in rest]).add("lang_pred", StringType()).add("score", DoubleType())
    return docs.mapInArrow(run, schema)


SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    learned = train(docs.where(common.fold("doc_id", 3) != 1).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", F.coalesce(common.fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "text"), *learned)
