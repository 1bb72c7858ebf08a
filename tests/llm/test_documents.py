"""Operators on documents: brute force, defined results for odd rows, empty tables."""

import math
import time
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import xxhash
from compare import SMALL, duck_rows, spark_rows

from sievecast.llm import common, language, lines, lm, mixing, quality, queries, simhash, tokenfiles


def text_of(r):
    return (r.text or "").encode()


def test_language(spark, docs, empty):
    out = language.identify(docs).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    by_id = {r.doc_id: r for r in out if r.doc_id is not None}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (50, 51, 52, 53))
    assert all(r.held_out == (crc32(str(r.doc_id or "").encode() if r.doc_id is not None else b"") % 4 == 2) for r in out)
    assert language.identify(empty).count() == 0
    nothing = language.identify(docs.filter("lang is null")).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    kept = language.accepted(docs)
    assert kept.columns == docs.columns and {50, 51, 52, 53}.isdisjoint(r.doc_id for r in kept.collect())


def test_language_on_held_out_documents(spark):
    out = queries.QUERIES["op1_language_id"](spark, SMALL)
    truth = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    held = out.join(truth, "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95


def test_many_languages_get_fewer_buckets(spark, docs, monkeypatch):
    monkeypatch.setattr(language, "MODEL_BYTES", 2 * 4 * 1024 + 100)
    model = language.train(docs.filter("lang is not null"))
    assert model.languages == ("de", "en") and model.log_prob.shape == (2, 1025)
    assert np.allclose(np.exp(model.log_prob[:, :-1]).sum(axis=1), 1, atol=1e-3)
    assert language.identify(docs).count() == docs.count()


def test_neighbours_do_not_matter():
    rng = np.random.default_rng(1)
    model = language.LanguageModel(("a", "b"), np.zeros(2), np.hstack([rng.normal(size=(2, 1 << 10)), np.zeros((2, 1))]).astype(np.float32))
    texts = ["hello there", "x", "other words", "İ and ß"]
    together = model.predict(texts)[1]
    assert np.allclose(together, [model.predict([t])[1][0] for t in texts])


def test_lm(spark, docs, empty):
    rows, out = docs.collect(), lm.score_texts(docs).collect()
    assert len(out) == len(rows)
    counts = Counter()
    for r in rows:
        if crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 7 != 2:
            counts.update([*text_of(r).lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r in rows:
        words = [*text_of(r).lower().split(), b""]
        want[r.doc_id, len(words), sum(counts[w] > 0 for w in words), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), 4)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in out) == want
    assert all(r.train_tokens == n and r.score < 0 for r in out)
    assert lm.score_texts(empty).count() == 0


def test_lm_groups_by_bytes(spark, docs):
    counts = lm.word_counts(docs)
    tables, rows = lm.word_tables(counts, held=10), counts.collect()
    assert tables.unigram.min() > 0 and tables.tokens == sum(r.c for r in rows)
    own = set(list(tables.place)[: lm.OWN_WORDS])
    want = Counter()
    for r in rows:
        if bytes(r.word) not in own:
            want[lm._group(bytes(r.word)) - lm.OWN_WORDS] += r.c + 1
    assert [n - 1 for n in tables.group_total] == [want[g] for g in range(lm.GROUPS)]


def test_lm_is_normalised_and_better_than_its_base(spark):
    rng = np.random.default_rng(2)
    unigram = rng.dirichlet(np.ones(12))
    p = lm.Parameters.initial(unigram, 4)
    logs = lm.log_tables(p)
    for w2, w1 in ((0, 0), (3, 5)):
        total = sum(10 ** lm.token_log_probs(logs, np.array([w2]), np.array([w1]), np.array([w]))[0] for w in range(12))
        assert total == pytest.approx(1, abs=1e-4)
    r = queries.QUERIES["op2_lm_scoring"](spark, SMALL).filter("held_out").selectExpr("sum(score) a", "sum(base_score) b").first()
    assert r.a > r.b


def test_trained_lm_is_normalised_over_all_words(spark):
    """In any context the probabilities of all words of the training texts, and of one unknown a group, add up to 1."""
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").select("text")
    counts = lm.word_counts(texts)
    tables = lm.word_tables(counts, held=3000)
    model = lm.train(texts, tables)
    logs, rows = lm.log_tables(model), counts.collect()
    assert len(rows) > lm.OWN_WORDS + lm.GROUPS
    _, classes, _ = tables.ids([bytes(r.word) for r in rows])
    c = np.array([r.c for r in rows])
    own = classes < lm.OWN_WORDS
    within = np.where(own, 1.0, (c + 1) / tables.group_total[np.where(own, 0, classes - lm.OWN_WORDS)])
    for w2, w1 in ((0, 0), (5, 700), (1000, 3)):
        of_class = 10 ** lm.token_log_probs(logs, np.full(len(model.bias), w2), np.full(len(model.bias), w1), np.arange(len(model.bias))).astype(float)
        unknown = (of_class[lm.OWN_WORDS :] / tables.group_total).sum()
        assert (of_class[classes] * within).sum() + unknown == pytest.approx(1, abs=1e-3)


def test_lm_of_long_texts_in_parts(spark, docs, monkeypatch):
    """Words, classes and lengths of texts are the same in parts of any size."""
    import pyarrow as pa

    tables = lm.word_tables(lm.word_counts(docs), held=10)
    column = pa.array([r.text for r in docs.collect()])

    def whole():
        parts = list(lm._texts(column, tables))
        assert [p[0] for p in parts[1:]] == [p[1] for p in parts[:-1]] and parts[-1][1] == len(column)
        return [np.concatenate([p[k] for p in parts]).tolist() for k in (2, 3, 4)], [w for p in parts for w in p[5]]

    before = whole()
    monkeypatch.setattr(lm, "_WORDS_AT_ONCE", 40)
    monkeypatch.setattr(lm, "pieces_of", lambda x: common.pieces_of(x, 100))
    assert whole() == before and sum(before[0][2]) == len(before[0][0])


def test_lm_does_not_depend_on_how_its_input_is_split(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 1 << 14)
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    tables = lm.word_tables(lm.word_counts(texts), held=3000)
    assert lm.shards_for(tables.tokens) > 2
    models = [lm.train(texts.repartition(n), tables, rounds=2) for n in (1, 8, 64)]
    for m in models[1:]:
        assert all(np.array_equal(x, y) for x, y in zip(models[0].arrays(), m.arrays(), strict=True))


def test_lm_shards_grow_with_the_tokens():
    assert [lm.shards_for(n) for n in (0, 1, lm.SHARD_TOKENS, 16 * lm.SHARD_TOKENS, 10_000 * lm.SHARD_TOKENS)] == [1, 1, 1, 8, 1000]


def test_lm_sequences_hold_every_token_once(spark):
    """Long texts come in pieces of at most PIECE tokens, equal texts of other ids under other keys, nulls as an end alone."""
    long = " ".join(f"w{i % 700}" for i in range(2 * lm.PIECE + 5))
    docs = spark.createDataFrame([(1, long), (2, "a b"), (3, "a b"), (4, None), (4, None), (5, ""), (6, "a" * 1000)], "doc_id long, text string")
    tables = lm.word_tables(lm.word_counts(docs))
    assert max(map(len, tables.place)) <= lm.HELD_BYTES and lm._group(b"a" * 1000) >= lm.OWN_WORDS
    rows = lm.sequences(docs, tables).collect()
    assert sorted(len(r.classes) // 2 for r in rows) == [1, 1, 1, 2, 3, 3, 6, lm.PIECE, lm.PIECE]
    parts = [np.frombuffer(r.classes, np.uint16) for r in sorted(rows, key=lambda r: r.piece) if len(r.classes) > 10 or r.piece]
    assert np.concatenate(parts).tolist() == tables.ids([*long.encode().split(), lm.END])[1].tolist()
    assert len({r.key for r in rows if len(r.classes) == 6}) == 2


def test_a_shard_takes_full_batches_wherever_texts_end():
    steps = []

    class Recorder:
        def step(self, w2, w1, w):
            steps.append((w2.copy(), w1.copy(), w.copy()))

    rng = np.random.default_rng(4)
    texts = [np.r_[rng.integers(1, 50, n), 0] for n in rng.integers(0, 9000, 40)]
    shard = lm._Shard(Recorder())
    for t in texts:
        shard.add(t, np.array([len(t)]))
    shard.finish()
    ids, lengths = np.concatenate(texts), np.array([len(t) for t in texts])
    assert [len(w) for _, _, w in steps[:-1]] == [lm.BATCH] * (len(ids) // lm.BATCH)
    for have, want in zip(zip(*steps, strict=True), (*lm.contexts(ids, common.starts_of(lengths)), ids), strict=True):
        assert np.array_equal(np.concatenate(have), want)


def test_lm_looks_words_up_in_blocks(spark, docs, monkeypatch):
    """Short texts are looked up together, long ones in blocks; words come out the same."""
    import pyarrow as pa

    tables = lm.word_tables(lm.word_counts(docs), held=10)
    column, calls, places = pa.array(["a b", None, "", "c"] * 500 + [" ".join(f"w{i}" for i in range(9000))]), [], lm.WordTables.places
    monkeypatch.setattr(lm.WordTables, "places", lambda self, words: calls.append(len(words)) or places(self, words))
    out = list(lm._texts(column, tables))
    words = [w for x in column.to_pylist() for w in [*(x or "").encode().split(), lm.END]]
    assert len(calls) <= 3 and sum(calls) == len(words)
    monkeypatch.setattr(lm, "_LOOKED_UP", 3)
    blocks = list(lm._texts(column, tables))
    assert len(calls) > 300
    for have in (out, blocks):
        at, classes, rare = tables.ids(words)
        assert [np.concatenate([p[k] for p in have]).tolist() for k in (2, 3)] == [at.tolist(), classes.tolist()] and [w for p in have for w in p[5]] == rare


class PlainTrainer:
    """The formulas of a step one by one: every token's own products, rows summed by sorting, all tables moved whole."""

    def __init__(self, start, unigram, noise, rate, seed, dtype):
        self.p, self.dtype = [x.astype(dtype) for x in start.arrays()], dtype
        self.squares = [np.full(x.shape, 1e-6, dtype) for x in self.p]
        self.cumulative, self.offset = np.cumsum(unigram), np.log(noise * unigram).astype(dtype)
        self.noise, self.rate, self.draw = noise, rate, np.random.default_rng(seed)

    def scatter(self, ids, rows):
        order = np.argsort(ids.astype(np.uint16), kind="stable")
        ids, out = ids[order], np.zeros((len(self.offset), rows.shape[1]), self.dtype)
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        out[ids[first]] = np.add.reduceat(rows[order], first, axis=0)
        return out

    def step(self, w2, w1, w):
        (context, target, first, second, bias), n = self.p, len(self.offset)
        others = np.minimum(np.searchsorted(self.cumulative, self.draw.random(self.noise)), n - 1)
        c1, c2, q = context[w1], context[w2], target[w]
        h = c1 @ first + c2 @ second
        true = 1 / (1 + np.exp((h * q).sum(axis=1) + bias[w] - self.offset[w]))
        noise = -1 / (1 + np.exp(self.offset[others] - bias[others] - h @ target[others].T))
        to_h = true[:, None] * q + noise @ target[others]
        d_target = self.scatter(w, true[:, None] * h)
        np.add.at(d_target, others, noise.T @ h)
        d_bias = np.bincount(w, true, n) + np.bincount(others, noise.sum(axis=0), n)
        d_context = self.scatter(w1, to_h @ first.T) + self.scatter(w2, to_h @ second.T)
        for x, g, s in zip(self.p, (d_context, d_target, c1.T @ to_h, c2.T @ to_h, d_bias), self.squares, strict=True):
            g = (g / len(w)).astype(self.dtype)
            s += g * g
            x += self.rate * g / np.sqrt(s)


def lm_batches(n, size=lm.BATCH):
    """(unigram, n batches of contexts and words) with classes as frequent as in texts."""
    rng = np.random.default_rng(8)
    classes = lm.OWN_WORDS + lm.GROUPS
    unigram = 1 / np.arange(2, classes + 2)
    unigram /= unigram.sum()
    return unigram, [tuple(rng.choice(classes, size - 7 * (i % 2), p=unigram) for _ in range(3)) for i in range(n)]


@pytest.mark.parametrize("width", [lm.WIDTH, 7])
def test_lm_step_is_what_its_formulas_say(width):
    unigram, batches = lm_batches(30)
    start = lm.Parameters.initial(unigram, width)
    plain, own = PlainTrainer(start, unigram, lm.NOISE, lm.RATE, 5, np.float64), lm.Trainer(start, unigram, seed=5)
    for b in batches:
        plain.step(*b)
        own.step(*b)
    for x, y, before in zip(own.p.arrays(), plain.p, start.arrays(), strict=True):
        assert np.allclose(x, y, atol=1e-4) and np.abs(x - before).max() > 0.02
    assert own.seen == sum(len(w) for _, _, w in batches)


def test_lm_step_takes_less_time_than_its_formulas():
    """A step must not go back to products of every token's own contexts and sums by sorting: these took 1.6 times its time."""
    unigram, batches = lm_batches(30)
    start = lm.Parameters.initial(unigram, lm.WIDTH)
    plain, own = PlainTrainer(start, unigram, lm.NOISE, lm.RATE, 5, np.float32), lm.Trainer(start, unigram, seed=5)
    took = {plain: [], own: []}
    for _ in range(10):
        for t in took:
            began = time.thread_time()
            for b in batches:
                t.step(*b)
            took[t].append(time.thread_time() - began)
    assert min(took[own]) < 0.85 * min(took[plain])


def test_mixing(spark, duck, docs, empty):
    out = mixing.mix(docs.drop("n_tokens")).collect()
    assert len(out) == docs.count()
    words = sum(r.mix_size for r in out)
    targets = {r.source: (r.mix_target, r.mix_source_size) for r in out}
    assert sum(t for t, _ in targets.values()) == pytest.approx(1.5 * words)
    for source, (target, size) in targets.items():
        taken = sum(r.mix_size * len(r.mix_positions) for r in out if r.source == source)
        assert target <= 2 * size and abs(taken - target) <= max(r.mix_size for r in out if r.source == source)
    assert all(len(r.mix_positions) <= 2 and all(0 <= p <= 1 for p in r.mix_positions) for r in out)
    assert mixing.mix(empty).count() == 0
    order = mixing.training_order(docs)
    assert order.columns == docs.columns and order.count() == sum(len(r.mix_positions) for r in out)
    df = queries.QUERIES["op3_source_mixing"](spark, SMALL)
    columns = sorted(df.columns)
    assert spark_rows(df, columns) == duck_rows(duck, queries.ORACLE_SQL["op3_source_mixing"], columns)


def brute_fingerprint(text, k=3):
    words = text.lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(nodes):
        for y in nodes[:i]:
            if linked(x, y):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {x: find(x) for x in nodes}


def test_simhash(spark, docs, empty):
    rows, out = docs.collect(), simhash.near_duplicates(docs).collect()
    prints = [(r.doc_id, brute_fingerprint(text_of(r))) for r in rows]
    assert Counter((r.doc_id, r.fp % (1 << 64)) for r in out) == Counter(prints)
    roots = brute_components(sorted({f for _, f in prints}), lambda a, b: bin(a ^ b).count("1") <= 2)
    least = {}
    for i, f in prints:
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    assert all(r.component_id == least.get(roots[r.fp % (1 << 64)]) for r in out)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs).collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert sorted(ids) == sorted(set(least.values()))


def test_simhash_hot_buckets(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 40)
    fps = {int(b) for b in base}
    for b in base:
        x = int(b)
        for _ in range(8):
            x ^= 1 << int(rng.integers(62))
            fps.add(x)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = {frozenset((a, b)) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 2}
    for hot in (2, 4096):
        got = [frozenset((r.a, r.b)) for r in simhash.links(df, hot).collect()]
        assert len(got) == len(want) and set(got) == want


def test_line_dedup(spark, docs, empty):
    long = "a line that is long enough to be looked at"
    rows = [(1, f"{long} one\nshort\nunique line number one with enough bytes"), (2, f"{long} onX\nshort"), (3, f"{long} oYX"), (4, f"{long}, which is another"), (None, f"{long} one"), (5, None), (5, ""), (2, f"{long} onX\nshort")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, removed string")
    got = {(r.doc_id, tuple(r.removed)) for r in lines.repeated_lines(df).collect()}
    assert got == {(2, (0, 1)), (3, (0,)), (None, (0,))}
    out = lines.deduplicate(df)
    assert out.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(1, rows[0][1]), (4, rows[3][1]), (5, None), (5, "")])
    assert lines.deduplicate(empty).count() == 0
    assert lines.deduplicate(docs).count() > 0


def test_line_dedup_of_short_lines(spark):
    """The pipeline takes out equal lines of any length; a whole copy goes, whatever its lines and its blank ones."""
    import corpus_pipeline

    copy = "a line that is long enough to be looked at\nshort\n\n \t"
    rows = [(1, copy), (2, copy), (3, "All rights reserved.\nits own"), (4, "other\n\n\nAll rights reserved."), (5, "shorT"), (6, "short"), (7, "\n \n"), (8, "\n \n"), (9, "x\nx"), (None, "short"), (10, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.drop_repeated_lines(spark, df, SMALL)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(1, copy), rows[2], (4, "other\n\n"), (5, "shorT"), rows[6], rows[7], (9, "x"), (10, None)])


def test_line_dedup_in_blocks(spark):
    """Links of a bucket that is dealt out in many blocks connect the same lines."""
    stem = "x" * 40
    texts = [stem + str(i).zfill(2) + stem for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (4, 1024):
        removed = lines.repeated_lines(df, block=block).collect()
        assert sorted(r.doc_id for r in removed) == list(range(1, 30))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_join_finds_all():
    rng = np.random.default_rng(4)
    made = []
    for _ in range(40):
        x = bytearray(rng.choice(list(b"abc"), rng.integers(7, 15)).astype(np.uint8).tobytes())
        for _ in range(4):
            made.append(bytes(x))
            at = int(rng.integers(0, len(x)))
            x[at : at + int(rng.integers(0, 2))] = bytes(rng.choice(list(b"abc"), rng.integers(0, 2)).astype(np.uint8))
    made = list(dict.fromkeys(made))
    i, j = np.array([(a, b) for a in range(len(made)) for b in range(a)]).T
    near = np.array([levenshtein(made[a], made[b]) <= 2 for a, b in zip(i, j, strict=True)])
    assert (lines.within(made, i, j) == near).all()
    buckets = {}
    for row, key in zip(*lines.segment_keys(made, 2, 6), strict=True):
        buckets.setdefault(int(key) >> 1, ([], []))[int(key) & 1].append(int(row))
    shared = {frozenset((a, b)) for index, probe in buckets.values() for a in index for b in index + probe}
    assert all(frozenset((int(a), int(b))) in shared for a, b, n in zip(i, j, near, strict=True) if n and min(len(made[a]), len(made[b])) >= 6)


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(40)] + [(50, None, 1), (None, 1, 0), (4, 0, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.score_quality(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert quality.score_quality(empty, labels).count() == 0
    constant = {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()}
    assert constant == {0.5}


def brute_quality_features(texts):
    """Neighbours' index vectors summed word by word, then plain means over each text's words and neighbours."""
    def index(n, width, seed):
        at, sign = quality._index_vectors(n, width, seed)
        out = np.zeros((n, width))
        for i in range(n):
            out[i, at[i]] = sign[i]
        return out

    def bucket(w):
        return crc32(w.lower()) % quality.BUCKETS

    marks, vectors = index(quality.BUCKETS, quality.WIDTH, 1), np.zeros((quality.BUCKETS, quality.WIDTH))
    for words in texts:
        for a, b in zip(words, words[1:]):
            vectors[bucket(a)] += marks[bucket(b)]
            vectors[bucket(b)] += marks[bucket(a)]
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    of_shape, own = index(quality.SHAPES, quality.SHAPE_WIDTH, 2), index(quality.BUCKETS, quality.OWN_WIDTH, 3)
    for words in texts:
        n = max(len(words), 1)
        mean = sum((own[bucket(w)] for w in words), np.zeros(quality.OWN_WIDTH)) / n
        repeats = np.linalg.norm(mean) / quality.MARKS**0.5
        word = sum((vectors[bucket(w)] for w in words), np.zeros(quality.WIDTH)) / n
        shapes = sum((of_shape[crc32(quality.shape(w)) % quality.SHAPES] for w in words), np.zeros(quality.SHAPE_WIDTH)) / n
        products = sum((vectors[bucket(a)] * vectors[bucket(b)] for a, b in zip(words, words[1:])), np.zeros(quality.WIDTH)) / max(len(words) - 1, 1)
        yield np.r_[word, products, shapes, repeats, repeats**2, np.log1p(len(words))]


def test_quality_features_by_brute_force(spark, docs):
    rows = docs.collect()
    got = quality.pooled(docs, quality.word_vectors(docs)).collect()
    want = list(brute_quality_features([text_of(r).split() for r in rows]))
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in rows)
    by_id = {}
    for r, f in zip(rows, want, strict=True):
        by_id.setdefault(r.doc_id, []).append(f)
    for r in got:
        assert min(np.abs(np.array(r.features) - f).max() for f in by_id[r.doc_id]) < 1e-4, r.doc_id


def test_quality_of_long_texts_in_parts(monkeypatch):
    """A text of many parts gives the sums it gives whole; shapes know letters of any script."""
    import pyarrow as pa

    texts = ["Der Hund 12 läuft. " * 2000, "", "kurz", None]
    ids = quality.WordIds()
    whole = list(quality._runs(pa.array(texts), ids))
    of_word, of_shape = (np.random.default_rng(i).normal(size=(n, 5)) for i, n in ((1, quality.BUCKETS), (2, quality.SHAPES)))

    def sums(parts):
        out = np.zeros((len(texts), 13))
        for first, end, w, lengths in parts:
            quality._add_words(out[first:end], w, lengths, of_word, of_shape, 3)
        return out

    before = sums(whole)
    monkeypatch.setattr(quality, "_WORDS_AT_ONCE", 700)
    monkeypatch.setattr(quality, "_ADDED_AT_ONCE", 300)
    parts = list(quality._runs(pa.array(texts), ids))
    assert [p[:2] for p in parts] == [(0, 1), (1, 4)] and np.allclose(sums(parts), before)
    assert quality.shape("ÄÖllé٣4-x".encode()) == b"Aa0-a"


def test_quality_on_held_out_documents(spark):
    middle = SMALL.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{middle}/labels.parquet").select("doc_id", "quality")
    held = queries.QUERIES["op7_quality_classifier"](spark, middle).join(labels, "doc_id").filter("held_out and quality is not null").collect()
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.9


def test_quality_by_word_vectors_alone(spark):
    """The word vectors carry the score: without shapes, repetition and length it is as good on held-out rows."""
    large = SMALL.replace("sf0.001", "sf0.1")
    documents, labels = (spark.read.parquet(f"{large}/{name}.parquet") for name in ("documents", "labels"))
    labels = labels.filter("quality is not null").select("doc_id", "quality")
    rows = quality.pooled(documents, quality.word_vectors(documents)).join(labels, "doc_id").toPandas().sort_values("doc_id")
    x, y = np.array(rows["features"].to_list(), np.float64)[:, : 2 * quality.WIDTH], rows["quality"].to_numpy(np.float64)
    held = np.array([crc32(str(i).encode()) % 5 == 0 for i in rows["doc_id"]])
    scores = quality.fit(x[~held], y[~held]).scores(x[held])
    good, bad = scores[y[held] == 1], scores[y[held] == 0]
    assert (good[:, None] > bad).mean() > 0.995


def test_token_counts(spark, docs, empty):
    want = Counter((r.doc_id, len(text_of(r).split())) for r in docs.collect())
    for file_bytes, block in ((1 << 28, 1 << 22), (100, 6)):
        got = tokenfiles.token_counts(docs, file_bytes, block).collect()
        assert Counter((r.doc_id, r.n_tokens) for r in got) == want
    assert tokenfiles.token_counts(empty).count() == 0


def test_token_file_without_a_last_end(spark):
    blocks = spark.createDataFrame([("f", 0, 0, 3, [1]), ("f", 1, 3, 3, []), ("f", 2, 6, 3, [6]), ("g", 0, 0, 2, [0, 1])], "file string, block long, first long, tokens long, ends array<long>")
    got = {(r.file, r.ordinal, r.n_tokens) for r in tokenfiles.document_lengths(blocks).collect()}
    assert got == {("f", 0, 1), ("f", 1, 4), ("f", 2, 2), ("g", 0, 0), ("g", 1, 0)}


def test_bit_planes_find_all_pairs():
    """Buckets of many sizes, one of some thousands, against a plain count of differing bits."""
    rng = np.random.default_rng(11)
    keys = np.sort(rng.integers(0, 40, 3000) * (rng.random(3000) < 0.3))
    fps = rng.choice(rng.integers(0, 1 << 63, 60, np.uint64), 3000) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64))
    for radius in (0, 1, 2, 3):
        i, j = simhash.close_pairs(keys, fps, radius)
        want = {(a, a + 1 + b) for a in range(3000) for b in np.flatnonzero((np.bitwise_count(fps[a + 1 :] ^ fps[a]) <= radius) & (keys[a + 1 :] == keys[a])).tolist()}
        assert len(i) == len(want) and set(zip(i.tolist(), j.tolist(), strict=True)) == want


CLASHES = ("_key _bucket _source _inside _before _s _b w0 w1 target source_size mix_position mix_size position key bucket named before inside _id _hash _removed _text_hash digest removed stays root fp text_hash c0 c3 lang_pred score evidence held_out").split()


def test_columns_of_any_name_stay(spark):
    """Every name that the operators use inside, as a column of the input: values stay, and results are those without such columns."""
    import corpus_pipeline

    plain = [(i, f"the quick brown fox number {i // 2} jumps over the lazy dog\nline {i}", ("en", None)[i % 5 == 0], f"s{i % 3}") for i in range(30)] + [(None, None, "en", None), (None, "the end of it", "en", "s1")]
    names = ["doc_id", "text", "lang", "source", *CLASHES]
    with_clashes = spark.createDataFrame([(*r, *[f"{c}!"[:9] for c in CLASHES]) for r in plain], ", ".join(f"`{n}` {t}" for n, t in zip(names, ["long", "string", "string", "string"] + ["string"] * len(CLASHES), strict=True)))
    alone = spark.createDataFrame(plain, "doc_id long, text string, lang string, source string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got, want = stage(spark, with_clashes, SMALL), stage(spark, alone, SMALL)
        assert got.columns == names, name
        assert all(r[c] == f"{c}!"[:9] for r in got.collect() for c in CLASHES), name
        assert Counter(tuple(r[:4]) for r in got.collect()) == Counter(tuple(r) for r in want.collect()), name


def test_long_texts_in_parts():
    """A text of many parts gives what it gives whole."""
    rng = np.random.default_rng(12)
    words = [bytes(rng.choice(list(b"abcdefgh"), rng.integers(1, 9)).astype(np.uint8)) for _ in range(400_000)]
    text = b" ".join(words)
    assert len(text) > 2 * simhash._BYTES_AT_ONCE
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)], np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes))
    assert int(simhash.fingerprints_of([text])[0]) == want
    model = language.LanguageModel(("a", "b"), np.zeros(2), np.hstack([rng.normal(size=(2, 1 << 10)), np.zeros((2, 1))]).astype(np.float32))
    logs, n = model.logs([text.decode(), "abc"])
    whole, starts = language._grams([text.decode(), "abc"], np.array([len(text), 3]), model.orders, 1 << 10)
    assert n.tolist() == [2 * len(text), 6]
    assert np.allclose(logs, [sum(np.add.reduceat(own[h], starts, dtype=np.float64) for h in whole) for own in model.log_prob])


def test_hot_segments(spark):
    """Thousands of lines that share a segment are dealt again by two; no link is lost."""
    rng = np.random.default_rng(13)
    stem = "a segment that very many lines begin with: "
    rest = ["".join(rng.choice(list("abcdefghij"), 84)) for _ in range(1500)]
    twins = [x[:40] + "#" + x[41:] for x in rest[:50]]
    df = spark.createDataFrame(list(enumerate(stem + x for x in rest + twins)), "doc_id long, text string")
    removed = lines.repeated_lines(df, block=256).collect()
    assert sorted(r.doc_id for r in removed) == list(range(1500, 1550))


def test_language_rejects_what_no_language_explains(spark):
    rng = np.random.default_rng(14)
    known = [(i, f"the house number {i} and the garden with some flowers", "en") for i in range(300)]
    noise = [(1000 + i, "".join(map(chr, rng.integers(0x3400, 0x9FFF, 60))), None) for i in range(10)]
    kept = language.accepted(spark.createDataFrame(known + noise, "doc_id long, text string, lang string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(300))


def test_sums_of_a_thousand_tasks(spark):
    """A task that adds up parts holds one sum, whatever number of tasks has sent some."""
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql import functions as F

    made = spark.range(0, 1000, 1, 1000).select((F.col("id") % 3).cast("int").alias("slice"), F.col("id").alias("tokens"), F.lit(np.arange(4, dtype=np.float64).tobytes()).alias("sums"))
    got = {r.slice: (r.tokens, np.frombuffer(r.sums).tolist()) for r in common.summed(made, "sums", np.float64, "tokens").collect()}
    assert got == {k: (sum(range(k, 1000, 3)), [float(x * len(range(k, 1000, 3))) for x in range(4)]) for k in range(3)}

    held = {}

    class Parts:
        schema = made.schema

        def repartition(self, *keys):
            return self

        sortWithinPartitions = repartition  # noqa: N815

        def mapInArrow(self, run, schema):  # noqa: N802
            held["run"] = run

    common.summed(Parts(), "sums", np.float64, "tokens")
    own = pa.schema([("slice", pa.int32()), ("tokens", pa.int64()), ("sums", pa.binary())])
    part = np.ones(1 << 16).tobytes()
    batches = (pa.RecordBatch.from_arrays([pa.array([k // 500], pa.int32()), pa.array([1]), pa.array([part])], schema=own) for k in range(1000))
    tracemalloc.start()
    sums = [np.frombuffer(b.column(2)[0].as_py())[0] for b in held["run"](batches)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sums == [500.0, 500.0] and most < 8 * len(part)


def test_deduplicate_costs_its_lines(spark):
    import time
    from hashlib import sha256

    def seconds(n):
        text = "\n".join(sha256(str(k).encode()).hexdigest() for k in range(n))
        df = spark.createDataFrame([(1, text), (2, text + "\nlast"), (3, None)], "doc_id long, text string")
        began = time.time()
        out = {r.doc_id: r.text for r in lines.deduplicate(df).collect()}
        assert out == {1: text, 2: "last", 3: None}
        return time.time() - began

    seconds(100)
    assert seconds(40_000) < 4 * max(seconds(5_000), 2)
