import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arcwright.llm import common, decontaminate, exact_dedup, jaccard_join, langid, lm_score, packing, quality, sharding, token_counts, wavelet

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PLAIN = [(1, None), (2, ""), (3, "a  b"), (4, "a\tb"), (5, "a b"), (6, " \n"), (7, "x" * 50_000 + " y" * 30_000), (8, "a b c"), (8, "a b c"), (9, "Ünï çödé 日本 <|endoftext|>"), (10, "one two three four five six seven eight nine ten eleven")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


def prose(seed, n, words=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(400)]
    return [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, words)))) for i in range(n)]


def near(seed, n=150):
    rows, r = prose(seed, n), random.Random(seed)
    for i in range(n, 2 * n):
        w = rows[r.randrange(len(rows))][1].split()
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            w[r.randrange(len(w))] = f"new{r.randrange(50)}"
        rows.append((i, " ".join(w)))
    return rows


def brute_components(rows, n=4, threshold=85):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    best = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    for _ in sets:
        changed = False
        for a, b in links:
            m = min(best[a], best[b])
            changed |= best[a] != m or best[b] != m
            best[a] = best[b] = m
        if not changed:
            break
    return {i: (len(sets[i]), best[i]) for i in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard(spark, seed):
    rows = near(seed)
    made = jaccard_join.components(docs(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in made} == brute_components(rows) and len(made) == len(rows)


def test_jaccard_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_LEAST", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", 3)
    rows = near(3, 60) + [(200 + i, f"q{i} " + " ".join(f"w{k}" for k in range(60))) for i in range(12)]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(docs(spark, rows)).collect()} == brute_components(rows)


def test_jaccard_edges(spark):
    made = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(docs(spark, PLAIN)).collect()}
    assert made[1] == made[2][:1] + (1,) and made[6] == (0, 6) and made[3] == made[4] == made[5] == (1, 3)
    assert jaccard_join.components(docs(spark, [])).count() == 0
    extra = docs(spark, near(4, 20)).selectExpr("*", "1 as component_id", "2 as met")
    assert jaccard_join.one_of_each(extra).columns == extra.columns


def test_boundary():
    assert jaccard_join.light_boundary({}, 85) == 0
    assert 5 <= jaccard_join.light_boundary({n: 10 for n in range(1, 400)}, 85) < 60


def test_exact(spark):
    made = sorted(exact_dedup.groups(docs(spark, PLAIN)).collect(), key=lambda r: (r.doc_id, not r.kept))
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    size, first = Counter(norm(t) for _, t in PLAIN), {}
    for i, t in PLAIN:
        first.setdefault(norm(t), i)
    assert len(made) == len(PLAIN)
    for r, (i, t) in zip(made, PLAIN):
        assert (r.doc_id, r.keep_id, r.group_size, r.text_sha256) == (i, first[norm(t)], size[norm(t)], sha256(norm(t).encode()).hexdigest())
    assert sum(r.kept for r in made) == len(first)
    kept = exact_dedup.deduplicate(docs(spark, PLAIN)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(first.values())
    assert exact_dedup.groups(docs(spark, [])).count() == 0 and exact_dedup.deduplicate(docs(spark, [])).count() == 0


def test_exact_without_ids(spark):
    rows = [(None, "x"), (None, "x"), (None, "y"), (3, "x"), (4, None), (4, "")]
    assert sorted((str(r.doc_id), r.text or "") for r in exact_dedup.deduplicate(docs(spark, rows)).collect()) == [("4", ""), ("None", "x"), ("None", "y")]


def test_exact_large_groups(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 3)
    monkeypatch.setattr(exact_dedup, "HOT_GROUPS", 4)
    texts = ["large"] * 40 + ["small", "small", "alone"] + ["other  one"] * 5
    made = {r.doc_id: r for r in exact_dedup.groups(docs(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert (made[i].keep_id, made[i].group_size, made[i].kept) == (texts.index(t), texts.count(t), i == texts.index(t))


def test_exact_filters_in_parts(spark, monkeypatch):
    """Filters of few bits: several parts, nearly all rows tested again, the same result."""
    monkeypatch.setattr(common, "BLOOM_MAX_BITS", 1 << 13)
    rows = [(i, f"text {i % 1500}") for i in range(2000)]
    assert common.bloom_parts(2000) == 4
    made = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.groups(docs(spark, rows)).collect()}
    assert made == {i: (i % 1500, 2 if i % 1500 < 500 else 1) for i, _ in rows}
    assert exact_dedup.deduplicate(docs(spark, rows)).count() == 1500


def test_names_of_columns(spark):
    """Columns named like those that operators make for themselves pass through all that return whole rows."""
    names = ["_maybe", "maybe", "_sha", "sha", "_id", "id", "_once", "once", "_gone", "gone", "score", "_score", "key", "_key", "rep", "c", "component", "met", "slot", "row", "n", "line", "items", "starts", "part", "_part"]
    rows = [(1, "a b c d e f"), (2, "a  b c d e f"), (2, "x y z"), (2, "x y z"), (3, "a b c d e f"), (None, "a b c d e f"), (4, None)]
    df = docs(spark, rows).select("*", *(F.lit(f"its {x}").alias(x) for x in names))
    bench = spark.createDataFrame([("q", "x y z")], "item_id string, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for made in (exact_dedup.deduplicate(df), jaccard_join.one_of_each(df), decontaminate.clean(df, bench), quality.keep_good(df, labels)):
        got = made.collect()
        assert made.columns == df.columns and got and all(r[x] == f"its {x}" for r in got for x in names)
    model = quality.train(docs(spark, [(i, "good text here") for i in range(9)] + [(10 + i, "B!A!D") for i in range(9)]), spark.createDataFrame([(i, 1) for i in range(9)] + [(10 + i, 0) for i in range(9)], "doc_id long, quality int"))
    assert "logistic" in model and quality.score(df, model).columns == [*(x for x in df.columns if x != "score"), "score"]
    assert quality.score(df, model).count() == len(rows)


def test_rows_that_repeat_an_id(spark):
    """A row is dropped for what it holds, not for its id."""
    text = "one two three four five six seven"
    rows = [(1, text), (2, text), (2, "something else altogether, not like it"), (3, None), (3, None), (5, text)]
    assert sorted((r.doc_id, r.text) for r in jaccard_join.one_of_each(docs(spark, rows)).collect() if r.text) == [(1, text), (2, rows[2][1])]
    # of rows equal in id and normalised text, the smallest raw text
    same = [(7, "a  b"), (7, "a b"), (7, "a\tb"), (8, "a b")]
    assert [(r.doc_id, r.text) for r in exact_dedup.deduplicate(docs(spark, same).repartition(3)).collect()] == [(7, "a\tb")]


def test_empty_tables(spark, tmp_path):
    none, path = docs(spark, []), common.tokenizer_path()
    bench, labels = spark.createDataFrame([], "item_id string, text string"), spark.createDataFrame([], "doc_id long, quality int")
    made = [
        langid.identify(none, *langid.train(none)), jaccard_join.components(none), jaccard_join.one_of_each(none), quality.score(none, quality.train(none, labels)), quality.keep_good(none, labels),
        exact_dedup.groups(none), exact_dedup.deduplicate(none), token_counts.suffix_sums(token_counts.histogram(none, path)), packing.sequences(none, path), lm_score.score(none, *lm_score.train(none)),
        decontaminate.contamination(none, bench), decontaminate.clean(none, bench), wavelet.read(spark, wavelet.write(none, str(tmp_path), path)), sharding.place(none, "doc_id", ["a"]),
    ]
    assert [x.count() for x in made] == [0] * len(made)
    sums = made[7]
    assert token_counts.total_at(sums, 10) == 0 and token_counts.quantile(sums, 0.5) is None


def test_jaccard_large_lists(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_ROWS", 3)
    monkeypatch.setattr(jaccard_join, "HOT_LISTS", 1000)
    rows = near(6, 60) + [(300 + i, f"q{i} " + " ".join(f"w{k}" for k in range(60))) for i in range(12)]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(docs(spark, rows)).collect()} == brute_components(rows)


def test_bloom_twice(spark):
    keys = [1, 2, 3, 3, 4, 5, 5, 5, None][:8]
    df = spark.createDataFrame([(k,) for k in keys], "key long").repartition(3)
    bits = common.bloom_bits(8)
    f = common.bloom_build(df, bits, twice=True)
    assert common.bloom_has(f, bits, np.array([3, 5])).all()
    assert common.bloom_has(f, bits, np.arange(1000, 2000)).mean() < 0.05


def brute_hits(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
    patterns = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            patterns[tuple(w[k : k + 10])].add(str(i))
    out = {}
    for d, t in texts:
        w, hit, found = words(t), set(), set()
        for p, own in patterns.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found |= own
        out[d] = (len(w), len(hit), len(found), sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_decontaminate(spark, monkeypatch):
    r = random.Random(5)
    items = [(i, " ".join(r.choice("abc") for _ in range(r.randint(0, 14)))) for i in range(30)] + [(30, None), (31, "é Ü!")]
    texts = [(i, r.choice(["", "X. "]) + ", ".join(r.choice("abcABC") for _ in range(r.randint(0, 60)))) for i in range(60)] + [(98, "É Ü é Ü"), (99, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda df: {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in df.collect()}
    want = brute_hits(texts, items)
    assert key(decontaminate.contamination(docs(spark, texts), bench)) == want
    clean = {x.doc_id for x in decontaminate.clean(docs(spark, texts), bench).collect()}
    assert clean == {d for d, w in want.items() if not w[4]}
    monkeypatch.setattr(decontaminate._chunks, "__defaults__", (300,))
    assert len(decontaminate._shared(docs(spark, []), bench)) > 3
    assert {x.doc_id for x in decontaminate.clean(docs(spark, texts), bench).collect()} == clean
    assert key(decontaminate.contamination(docs(spark, texts), bench)) == want
    assert decontaminate.contamination(docs(spark, texts), bench.where("false")).where("contaminated").count() == 0
    scanner = decontaminate.Scanner(decontaminate.windows([("a", "one TWO three")]))
    assert [("é, One--two\nthree.")[a:b] for a, b in scanner.spans("é, One--two\nthree.")] == ["One--two\nthree"]


def test_encoder():
    e = common.Encoder(common.tokenizer_path(), limit=50)
    r = random.Random(6)
    texts = ["".join(r.choice(" \n\t\r'a1.,éß$日  s_²ªtrevmldŸȺ") for _ in range(r.randint(0, 30))) for _ in range(3000)]
    texts += ["<|endoftext|> x", "hello <|endoftext|> x", "a<|endoftext|><|endoftext|>", "<|endoftext| >", "é <|endoftext|>\n"]
    texts += ["".join(chr(c) for c in range(i, i + 64) if not 0xD800 <= c < 0xE000) for i in range(0, 0x3000, 64)] + [f"a {chr(c)}{chr(c)} b1{chr(c)}" for c in range(0x20, 0x2100) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(texts), 100):
        assert [x.tolist() for x in e(texts[i : i + 100])] == [true_encode(t) for t in texts[i : i + 100]]
    assert e(["hello <|endoftext|> x"])[0].tolist() == [31373, 220, 50256, 2124]


def test_encoder_on_all_documents(spark):
    e = common.Encoder(common.tokenizer_path(), limit=3000)
    texts = [x.text or "" for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for i in range(0, len(texts), 50):
        assert [x.tolist() for x in e(texts[i : i + 50])] == [true_encode(t) for t in texts[i : i + 50]]


_fresh = []


def true_encode(text):
    """By the library alone, as loaded from the file."""
    from tokenizers import Tokenizer

    if not _fresh:
        _fresh.append(Tokenizer.from_file(common.tokenizer_path()))
    return _fresh[0].encode(text, add_special_tokens=False).ids


def true_ids(rows):
    return [(i, np.array(true_encode(t or "") + [0], "<u4")) for i, t in rows]


def test_wavelet(spark, tmp_path):
    rows = PLAIN + prose(7, 40)
    ids = sorted(((i, x.tobytes()) for i, x in true_ids([(100 + i if k >= len(PLAIN) else i, t) for k, (i, t) in enumerate(rows)])), key=lambda x: x[0])
    df = docs(spark, [(100 + i if k >= len(PLAIN) else i, t) for k, (i, t) in enumerate(rows)])
    written = wavelet.write(df, str(tmp_path), common.tokenizer_path())
    made = sorted(wavelet.read(spark, written).collect(), key=lambda r: r.start)
    start = 0
    for r, (i, raw) in zip(made, ids, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(raw) // 4, zlib.crc32(raw))
        start += len(raw) // 4
    rows = [(None, "x"), (-5, "y z"), (-1, "w"), (None, None), *((3, f"copy {i}") for i in range(20)), (2, "<|endoftext|>")]
    again = sorted(wavelet.read(spark, wavelet.write(docs(spark, rows), str(tmp_path / "n"), common.tokenizer_path(), shards=5)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in again] == [None, None, -5, -1, 2] + [3] * 20 and [r.start for r in again] == np.r_[0, np.cumsum([r.n_tokens for r in again])][:-1].tolist()
    assert Counter((r.doc_id, r.ids_crc32) for r in again) == Counter((i, zlib.crc32(raw.tobytes())) for i, raw in true_ids(rows))


def test_wavelet_queries():
    x = np.random.default_rng(1).integers(0, 300, 5000).astype(np.uint32)
    m = wavelet.WaveletMatrix(wavelet.encode(x, pa.array([0, None]), np.array([10, 5000])))
    assert m.doc_ids.to_pylist() == [0, None] and (m.tokens() == x).all() and [m.access(i) for i in range(50)] == x[:50].tolist() and m.document(0).tolist() == x[:10].tolist()
    for t in (0, 7, 299, 5000):
        where = np.flatnonzero(x == t)
        assert m.count(t) == len(where) and m.rank(t, 1234) == (x[:1234] == t).sum() and [m.select(t, k) for k in range(len(where))] == where.tolist() and m.select(t, len(where)) == -1


def test_packing(spark):
    rows = PLAIN + [(100 + i, t) for i, t in prose(8, 300, 900)]
    made = packing.sequences(docs(spark, rows), common.tokenizer_path()).collect()
    want = Counter()
    for i, raw in true_ids(rows):
        first = len(raw) % 2048 or min(2048, len(raw))
        for k, a in enumerate([0, *range(first, len(raw), 2048)]):
            b = first if not k else a + 2048
            want[i, k, a, b - a, zlib.crc32(raw[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in made) == want
    bins = defaultdict(list)
    for r in made:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    open_ = []  # first fit, longest first, of all pieces at once
    for n in sorted((r.length for r in made), reverse=True):
        k = next((k for k, g in enumerate(open_) if g >= n), None)
        if k is None:
            open_.append(2048 - n)
        else:
            open_[k] -= n
    assert len(bins) <= 1.03 * len(open_) + 1
    assert packing.sequences(docs(spark, []), common.tokenizer_path()).count() == 0


def test_token_counts(spark):
    rows = PLAIN + [(100 + i, t) for i, t in prose(9, 200)]
    n = sorted(len(x) - 1 for _, x in true_ids(rows))
    sums = token_counts.suffix_sums(token_counts.histogram(docs(spark, rows), common.tokenizer_path())).cache()
    for r in sums.collect():
        k = r.n_tokens
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least, r.tokens_cut_here, r.all_tokens) == (n.count(k), sum(x >= k for x in n), sum(x for x in n if x >= k), sum(min(x, k) for x in n), sum(n))
    assert token_counts.total_at(sums, 33) == sum(min(x, 33) for x in n) and token_counts.quantile(sums, 0.5) == n[-(-len(n) // 2) - 1]


def test_quality(spark):
    good = prose(10, 120)
    bad = [(1000 + i, "!! ".join(t.upper().split())) for i, t in prose(11, 120)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(77777, 1), (5, None)], "doc_id long, quality int")
    model = quality.train(docs(spark, good[:90] + bad[:90]), labels)
    made = {r.doc_id: r.score for r in quality.score(docs(spark, good + bad + [(5000, None), (5001, "")]), model).collect()}
    assert np.mean([made[i] >= 0.7 for i, _ in good[90:]]) > 0.85 and np.mean([made[i] < 0.7 for i, _ in bad[90:]]) > 0.85
    assert made[5000] == made[5001] and all(0 <= s <= 1 for s in made.values())
    none = quality.train(docs(spark, good), labels.where("false"))
    assert {r.score for r in quality.score(docs(spark, good), none).collect()} == {0.5}
    extra = docs(spark, good + bad).selectExpr("*", "3 as score")
    assert quality.keep_good(extra, labels).columns == extra.columns


def test_langid(spark):
    r = random.Random(12)
    word = {"xx": "abcde", "yy": "vwxyz", "zz": "йцукен"}
    rows = [(i, " ".join("".join(r.choice(a) for _ in range(5)) for _ in range(40)), lang) for i, (lang, a) in enumerate(list(word.items()) * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = langid.train(df.where("doc_id < 45"))
    made = {x.doc_id: x for x in langid.identify(df.drop("lang").union(spark.createDataFrame([(900, None), (901, "12 !?"), (902, "")], "doc_id long, text string")), *learned).collect()}
    assert all(made[i].lang_pred == lang for i, _, lang in rows) and {made[i].lang_pred for i in (900, 901, 902)} == {"und"}
    assert all(0 <= x.score <= 1 for x in made.values())
    v, _ = langid.bundle(["ab c"])
    a, b, c, edge = (langid.letter_vector(ord(x)).astype(int) if x else langid.letter_vector(0).astype(int) for x in ("a", "b", "c", ""))
    three = lambda x, y, z: np.roll(x, 2) * np.roll(y, 1) * z
    assert (v[0] == three(a, b, edge) + three(b, edge, c) + three(edge, c, edge)).all()
    clash = df.selectExpr("*", "'?' as lang_pred", "'?' as score")
    assert sorted((x.doc_id, x.lang_pred) for x in langid.identify(clash, *learned).collect()) == sorted((i, lang) for i, _, lang in rows)
    assert langid.identify(df.drop("lang"), *langid.train(df.where("false"))).where("lang_pred <> 'und'").count() == 0


def lm_paths(parent, side, leaf):
    """(node, side) from the leaf up; nodes are numbered from the root."""
    out, root = [], len(parent) - 1
    while leaf != root:
        out.append((root - parent[leaf], side[leaf]))
        leaf = parent[leaf]
    return out


def brute_log_p(rows, vocab, flat):
    """Summed log-probabilities, one place and one node at a time, in plain Python."""
    parent, side = vocab["tree"]
    leaves, E, H, S = (len(parent) + 1) // 2, lm_score.EMBED, lm_score.HIDDEN, lm_score.SIDE
    cuts = np.cumsum([(leaves + 1) * E, (leaves - 1) * (H + 1), 2 * S * E * H])
    e, t, w, b = (x.astype(float) for x in np.split(flat, cuts))
    e, t, w = e.reshape(-1, E), t.reshape(-1, H + 1), w.reshape(-1, H)
    out = {}
    for i, text in rows:
        own = re.findall(r"[^\W_]+|(?:[^\w\s]|_)+", (text or "").lower())
        leaf = [vocab["number"].get(x, len(vocab["number"]) + lm_score.word_class(x)) for x in own]
        padded, total = [leaves] * S + leaf + [leaves] * S, 0.0
        for k, word in enumerate(own):
            x = np.concatenate([e[padded[k + S + j]] for j in (*range(-S, 0), *range(1, S + 1))])
            h = np.r_[np.tanh(x @ w + b), 1.0]
            for node, turn in lm_paths(parent, side, leaf[k]):
                z = float(h @ t[node])
                total += -np.log1p(np.exp(-z if turn else z))
            if word not in vocab["number"]:
                total += vocab["share"][lm_score.word_cell(word)]
        out[i] = (len(own), total)
    return out


def test_lm(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "WORDS", 150)
    monkeypatch.setattr(lm_score, "BATCH", 64)
    r = random.Random(13)
    rows = [(i, " ".join("the cat sat on a mat".split() * r.randint(1, 9))) for i in range(100)] + [(200 + i, t) for i, t in prose(14, 100)]
    rows += [(900, None), (901, "mat mat mat a a sat"), (902, "the cat sat on a mat"), (903, " "), (904, "Ünseen, wörd! 日本"), (905, "the cat sat on a mat"), (905, "the cat"), (906, "the dog " * 30_000)]
    df = docs(spark, rows)
    vocab, flat = lm_score.train(df.repartition(3))
    made = sorted((x.doc_id, x.n_tokens, x.log_likelihood) for x in lm_score.score(df, vocab, flat).collect())
    some = [x for x in rows if x[0] != 906]
    want = sorted((i, *brute_log_p([(i, t)], vocab, flat)[i]) for i, t in some)
    assert [x[:2] for x in made] == sorted([(i, n) for i, n, _ in want] + [(906, 60_000)])
    assert np.allclose([x[2] for x in made if x[0] != 906], [x[2] for x in want], rtol=1e-4, atol=1e-4)
    of = {x.doc_id: x for x in lm_score.score(df, vocab, flat).collect()}
    assert of[900].mean_log_p is None and of[900].log_likelihood == 0 and of[902].mean_log_p > of[901].mean_log_p
    # the probabilities of all leaves add up to one, whatever the context
    net = lm_score.Network(lm_score.Tree(*vocab["tree"]), flat)
    n = net.tree.leaves
    for context in ([0, 1, 2, 3], [n, n, 5, n - 1]):
        assert np.isclose(np.exp(net.log_p(np.repeat([context], n, 0).astype(np.uint16), np.arange(n, dtype=np.uint16))).sum(), 1, atol=1e-4)
    empty = docs(spark, [])
    assert lm_score.score(empty, *lm_score.train(empty)).count() == 0
    clash = docs(spark, rows[:20]).selectExpr("*", "1 as n", "'x' as line", "2 as n_tokens")
    assert lm_score.score(clash, vocab, flat).count() == 20


def test_lm_gradient(monkeypatch):
    """A step goes down the gradient that small changes of the parameters give."""
    monkeypatch.setattr(lm_score, "DENSE", 3)
    parent, side = lm_score.huffman(np.array([50, 20, 9, 9, 5, 4, 2, 1]))
    tree = lm_score.Tree(parent, side)
    net, r = lm_score.Network(tree), np.random.default_rng(3)
    net.t[:] = r.standard_normal(net.t.shape) * 0.3
    context, leaf = r.integers(0, 9, (1, 2 * lm_score.SIDE)).astype(np.uint16), np.array([6], np.uint16)
    before, start = net.flat.copy(), net.log_p(context, leaf)[0]
    net.step(context, leaf, 1e-3)
    moved, rate = net.flat - before, np.concatenate([np.full(net.e.size, lm_score.EMBED_MOST), np.full(net.t.size, lm_score.NODE_MOST), np.ones(net.w.size + net.b.size)])
    for i in np.flatnonzero(np.abs(moved) > 1e-6)[::7]:
        x = before.copy()
        x[i] += 1e-2
        up = lm_score.Network(tree, x).log_p(context, leaf)[0]
        x[i] -= 2e-2
        down = lm_score.Network(tree, x).log_p(context, leaf)[0]
        twice = (context == i // lm_score.EMBED).sum() if i < net.e.size else 1  # an embedding met twice moves along the mean
        assert np.isclose((up - down) / 2e-2, moved[i] / (1e-3 * rate[i]) * max(1, twice), rtol=0.05, atol=2e-3)
    assert net.log_p(context, leaf)[0] > start


def test_sharding(spark, tmp_path):
    names = [f"s{i}" for i in range(20)]
    table = sharding.lookup_table(names, 2039)
    assert Counter(table.tolist()).most_common()[0][1] - Counter(table.tolist()).most_common()[-1][1] <= 1
    less = sharding.lookup_table(names[:-1], 2039)
    assert ((table != less) & (table != 19)).mean() < 0.15
    made = sharding.place(docs(spark, PLAIN + [(None, "x")]), "doc_id", names, 2039).collect()
    assert len(made) == len(PLAIN) + 1 and all(r.shard_id == table[r.slot] and r.shard == names[r.shard_id] for r in made)
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 2040)
    extra = docs(spark, [(i, "x") for i in range(300)]).selectExpr("*", "'hot' as shard", "1 as slot")
    sharding.write(extra, "shard", names, str(tmp_path / "out"), 2039, files=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 300 and back.select("shard").distinct().count() == 1 and back.select(F.input_file_name()).distinct().count() > 1


def rows_of_pieces(rows):
    want = Counter()
    for i, raw in true_ids(rows):
        first = len(raw) % 2048 or min(2048, len(raw))
        for k, a in enumerate([0, *range(first, len(raw), 2048)]):
            b = first if not k else a + 2048
            want[i, k, a, b - a, zlib.crc32(raw[a:b].tobytes())] += 1
    return want


def brute_contaminated(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
    found = defaultdict(set)
    for t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            found[len(w[k : k + 10])].add(tuple(w[k : k + 10]))
    w = words(text)
    return any(tuple(w[k : k + n]) in own for n, own in found.items() for k in range(len(w) - n + 1))


def brute_pipeline(rows, scorer, items):
    """Rows that the first four stages keep, one document after another."""
    rows = [(i, t) for (i, t), s in zip(rows, scorer([t for _, t in rows])) if s >= 0.7]
    seen, kept = set(), []
    for i, t in sorted(rows, key=lambda x: x[0]):
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        if norm not in seen:
            seen.add(norm)
            kept.append((i, t))
    first = brute_components(kept, 5, 80)
    return [(i, t) for i, t in kept if first[i][1] == i and not brute_contaminated(t, items)]


def run_pipeline(spark, sf_dir):
    import corpus_pipeline

    made = corpus_pipeline.run(spark, sf_dir).collect()
    fill = Counter()
    for r in made:
        fill[r.sequence_id] += r.length
    assert all(n <= 2048 for n in fill.values())
    return Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in made)


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    table = lambda name: common.table(spark, folder, name)
    rows = [(r.doc_id, r.text) for r in table("documents").select("doc_id", "text").collect()]
    scorer = quality._scorer(quality.train(table("documents"), table("labels")))
    kept = brute_pipeline(rows, scorer, [r.text for r in table("benchmark").collect()])
    assert 0 < len(kept) < len(rows) and run_pipeline(spark, folder) == rows_of_pieces(kept)


def test_pipeline_edges(spark, tmp_path):
    rows = [*PLAIN[:8], *PLAIN[9:], (20, "a b c d e f g h i j k"), (21, "x, A b c d e f g h i J? k")]
    for name, has in (("plain", rows), ("empty", [])):
        docs(spark, has).selectExpr("*", "1 as score", "'?' as shard", "2 as n_shingles").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(3, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([("q", "a b c d e f g h i j"), (None, None)], "item_id string, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    kept = brute_pipeline(rows, lambda texts: [1.0] * len(texts), ["a b c d e f g h i j", None])
    assert {20, 21} & {i for i, _ in kept} == set()
    assert run_pipeline(spark, f"{tmp_path}/plain") == rows_of_pieces(kept)
    assert not run_pipeline(spark, f"{tmp_path}/empty")


def test_pipeline_near_copies(spark):
    import corpus_pipeline

    text = [f"w{k}" for k in range(60)]
    part = lambda a, b: [*text[:a], *(f"{b}{k}" for k in range(a, 60))]
    # of 5-word shingles 0.806 and 0.778 are shared with the first, of 4-word ones 0.81 and 0.78
    rows = [(1, " ".join(text)), (2, " ".join(part(54, "x"))), (3, " ".join(part(53, "y"))), (4, "other words altogether, but five")]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in rows}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert 0.8 <= like(1, 2) < 0.85 and like(1, 3) < 0.8 and like(2, 3) < 0.8
    assert sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, docs(spark, rows), "").collect()) == [1, 3, 4]


def test_lm_trains_on_every_place(spark):
    n = np.array([0, 1, 5, 0, 40, 2])
    own, at = lm_score._places(n)
    dealt = np.concatenate([lm_score._turn(n, k, 3) for k in range(3)])
    assert len(at) == n.sum() and sorted(dealt) == sorted(at) and np.bincount(own, minlength=6).tolist() == n.tolist()
    # texts of a few words train the network too
    df = docs(spark, [(i, "the cat sat") for i in range(300)] + [(300 + i, "a dog ran") for i in range(300)] + [(900, "the dog sat")])
    vocab, flat = lm_score.train(df)
    start = lm_score.Network(lm_score.Tree(*vocab["tree"]))
    start.t[:, -1] = vocab["start"]
    before, made = ({x.doc_id: x.mean_log_p for x in lm_score.score(df, vocab, f).collect()} for f in (start.flat, flat))
    assert made[0] > before[0] + 0.05 and made[0] > made[900]
    # before training, every word has its frequency
    assert np.isclose(before[0], np.log(300 / (1803 + 64)), atol=0.02)


def test_lm_words_beyond_the_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "WORDS", 3)
    rows = [(1, "a a a a b b b b c c c c"), (2, "dxe dxe dxe"), (3, "exe"), (4, "fxe")]
    vocab = lm_score.vocabulary(lm_score.raw_lines(docs(spark, rows)))
    assert set(vocab["number"]) == {"a", "b", "c"} and len({lm_score.word_cell(w) for w in ("dxe", "exe", "fxe")}) == 3
    share = lambda w: np.exp(vocab["share"][lm_score.word_cell(w)])
    # of the class's five words and one for each cell: a word seen three times, once, or never
    total = 5 + lm_score.CELLS
    assert np.isclose(share("dxe"), 4 / total / 2) and np.isclose(share("exe"), 2 / total / 2) and np.isclose(share("gxe"), 1 / total)


def test_quality_without_a_classifier(spark):
    good, bad = prose(10, 12), [(1000 + i, "!! ".join(t.upper().split())) for i, t in prose(11, 12)]
    df = docs(spark, good + bad)
    for has in ([], [(1, 0)], [(1, 1), (1000, 0)], [(1, 1), (2, 0), (3, 0)]):
        labels = spark.createDataFrame(has, "doc_id long, quality int")
        assert quality.keep_good(df, labels).count() == len(good + bad)
    # both labels of each class in one half by their hash
    half = {r.doc_id: r.half for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).alias("half")).collect()}
    same = lambda rows, h: [i for i, _ in rows if half[i] == h][:2]
    few = [(i, 1) for i in same(good, 0)] + [(i, 0) for i in same(bad, 1)]
    assert len(few) == 4 and "logistic" in quality.train(df, spark.createDataFrame(few, "doc_id long, quality int"))


def test_jaccard_negative_ids(spark):
    rows = [(i - 150, t) for i, t in near(5, 75)]
    made = jaccard_join.components(docs(spark, rows).repartition(8)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in made} == brute_components(rows)


def test_langid_brute(spark):
    """Predictions and scores against bundles made trigram by trigram."""
    r = random.Random(21)
    alphabets = {"xx": "abcdeé", "yy": "deéfgh", "zz": "ghiß"}
    rows = [(i, " ".join("".join(r.choice(a) for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 6))) + r.choice(["", "!", " 7", "."]), lang) for i, (lang, a) in enumerate(list(alphabets.items()) * 15)]

    def vector(text):
        seq, was = [], False
        for c in text.lower() + "\n":
            if c.isalpha() or was:
                seq.append(ord(c) if c.isalpha() else 0)
            was = c.isalpha()
        v = [langid.letter_vector(c).astype(float) for c in seq]
        return sum((np.roll(a, 2) * np.roll(b, 1) * c for a, b, c in zip(v, v[1:], v[2:])), np.zeros(langid.DIMENSIONS))

    unit = lambda x: x / max(np.linalg.norm(x), 1e-9)
    known = [x for x in rows if x[0] % 2]
    proto = {lang: unit(sum(unit(vector(t)) for _, t, own in known if own == lang)) for lang in alphabets}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for x in langid.identify(df.drop("lang"), *langid.train(df.where("doc_id % 2 = 1"))).collect():
        cosine = {lang: float(unit(vector(rows[x.doc_id][1])) @ p) for lang, p in proto.items()}
        best = max(sorted(cosine), key=cosine.get)
        assert x.lang_pred == best and np.isclose(x.score, 1 / sum(np.exp(langid.SHARPNESS * (c - cosine[best])) for c in cosine.values()), atol=1e-3)


def test_quality_brute(spark):
    """Scores against sizes taken block by block with the dictionaries themselves."""
    import zstandard

    good = prose(22, 60, 200)
    bad = [(1000 + i, "!! ".join(t.upper().split())) for i, t in prose(23, 60)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad], "doc_id long, quality int")
    rows = good + bad + [(5000, None), (5001, "long " * 5000)]
    model = quality.train(docs(spark, good + bad), labels)
    mean, deviation, w = model["logistic"]
    kinds = [zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_FULLDICT for _, raw in model["dictionaries"]]
    made = {r.doc_id: r.score for r in quality.score(docs(spark, rows), model).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        blocks = [raw[k : k + quality.BLOCK] for k in range(0, max(1, len(raw)), quality.BLOCK)]
        size = [sum(len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=kind), write_content_size=False, write_checksum=False, write_dict_id=False).compress(b)) for b in blocks) for (d, _), kind in zip(model["dictionaries"], kinds)]
        x = np.array(quality.features(*size))
        assert np.isclose(made[i], 1 / (1 + np.exp(-(w[0] + ((x - mean) / deviation) @ w[1:]))), atol=0.02)


def test_sharding_brute():
    """Each shard's whole order of preference is written down; they take turns claiming the first slot that is free."""
    names, size = [f"s{i}" for i in range(7)], 101
    order = []
    for s in names:
        offset, step = zlib.crc32(f"offset {s}".encode()) % size, zlib.crc32(f"step {s}".encode()) % (size - 1) + 1
        order.append([(offset + k * step) % size for k in range(size)])
    owner = {}
    while len(owner) < size:
        for i, slots in enumerate(order):
            if len(owner) < size:
                owner[next(s for s in slots if s not in owner)] = i
    assert sharding.lookup_table(names, size).tolist() == [owner[s] for s in range(size)]


def test_packing_brute():
    """Every place is tried, and the sum of squares taken over all open sequences."""
    for seed in range(5):
        lengths, capacity = np.random.default_rng(seed).integers(1, 21, 60), 20
        gaps, where = [], {}
        for i in sorted(range(60), key=lambda i: (-lengths[i], i)):
            s = int(lengths[i])

            def cost(after):
                return sum(c * c for g, c in Counter(after).items() if g)

            tries = [(cost([*gaps[:k], g - s, *gaps[k + 1 :]]), 0, g - s) for k, g in enumerate(gaps) if g >= s] + [(cost([*gaps, capacity - s]), 1, capacity - s)]
            least, new, gap = min(tries)
            if new:
                where[i] = len(gaps)
                gaps.append(gap)
            else:  # of sequences with this gap, the one that has had it for the shortest time
                where[i] = None
                gaps[next(k for k, g in enumerate(gaps) if g == gap + s)] = gap
        bins, _, gap = packing.pack(lengths, capacity)
        assert sorted(gaps) == sorted(gap[np.unique(bins, return_index=True)[1]].tolist())


def test_decontaminate_items_without_an_id(spark):
    bench = spark.createDataFrame([(None, "one two"), ("q", "three four"), ("q", "three four"), ("r", None)], "item_id string, text string")
    made = {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in decontaminate.contamination(docs(spark, [(1, "One two. three FOUR"), (2, "one two"), (3, "one")]), bench).collect()}
    assert made == {1: (4, 4, 1, sha256(b"q").hexdigest(), True), 2: (2, 2, 0, sha256(b"").hexdigest(), True), 3: (1, 0, 0, sha256(b"").hexdigest(), False)}
    again = docs(spark, [(1, "one two"), (1, "one two"), (1, None)])
    assert [x.n_hit for x in decontaminate.contamination(again, bench).orderBy("n_hit").collect()] == [0, 2, 2] and decontaminate.clean(again, bench).count() == 1


def test_files_are_moved_once(tmp_path):
    """A second attempt finds the first one's file and leaves it."""
    from pyarrow import fs

    system = fs.LocalFileSystem()
    for k in range(2):
        (tmp_path / f"a.{k}").write_bytes(b"same")
        wavelet._settle(system, str(tmp_path / f"a.{k}"), str(tmp_path / "a"))
    assert [x.name for x in tmp_path.iterdir()] == ["a"]

    class Refusing:
        """Like file systems that do not move onto a file."""

        def move(self, made, at):
            raise OSError("there is such a file")

        get_file_info, delete_file = system.get_file_info, system.delete_file

    (tmp_path / "a.2").write_bytes(b"same")
    wavelet._settle(Refusing(), str(tmp_path / "a.2"), str(tmp_path / "a"))
    assert [x.name for x in tmp_path.iterdir()] == ["a"]
    with pytest.raises(OSError):
        wavelet._settle(Refusing(), str(tmp_path / "a.3"), str(tmp_path / "b"))


def test_kinds_of_ids_and_extra_rows(spark):
    """Repeated rows and ids, nulls in every column, for the operators that give a row for each document."""
    rows = [(None, None), (None, "a b c"), (1, "a b c"), (1, "a b c"), (1, "other words here"), (2, "")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    path = common.tokenizer_path()
    learned = langid.train(spark.createDataFrame([(1, "a b c", "xx"), (2, "d e f", None), (3, None, "yy"), (4, "g h", "")], "doc_id long, text string, lang string"))
    assert learned[0] == ["xx"]
    counted = lambda made: Counter((x.doc_id for x in made.collect()))
    want = Counter(i for i, _ in rows)
    model = quality.train(df, spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int"))
    vocab, flat = lm_score.train(df)
    bench = spark.createDataFrame([("q", "no such words")], "item_id string, text string")
    for made in (langid.identify(df.drop("lang"), *learned), quality.score(df, model), lm_score.score(df, vocab, flat), decontaminate.contamination(df, bench), exact_dedup.groups(df), sharding.place(df, "doc_id", ["a", "b"]), packing.sequences(df, path)):
        assert counted(made) == want
    assert sum(x.n_docs for x in token_counts.suffix_sums(token_counts.histogram(df, path)).collect()) == len(rows)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.components(df).collect()} == {1: (1, 1), 2: (0, 2)}
