"""Fill-in-middle, decontamination and periodic runs: brute force, odd rows, empty tables."""

import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from compare import SMALL, duck_rows, spark_rows
from pyspark.sql import functions as F

from sievecast.llm import decontaminate, infill, periodic, queries, suffixes

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def digest(text):
    return sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_decontamination"])
def test_queries_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    assert spark_rows(df, columns) == duck_rows(duck, queries.ORACLE_SQL[name], columns)


# fill-in-middle


def cut_by_hand(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    made = f"<S>{suffix}<P>{prefix}<M>{middle}" if h4 % 100 < 80 else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return len(units), "spm" if h4 % 100 < 80 else "psm", len(prefix), len(middle), made


def test_white_bytes_are_told_apart():
    every = np.arange(256, dtype=np.uint8)
    for shift in range(8):
        x = np.roll(every, shift)
        flags = infill.white_bytes(x.view("<u8")).view(np.uint8)
        assert np.array_equal(flags == 0x80, (x == 0x20) | ((x >= 9) & (x <= 13))) and set(flags.tolist()) <= {0, 0x80}


def test_fill_in_middle(spark, docs, empty):
    odd = [" a b 　", "x" * 7, "x" * 8, " " * 9, "a  ", "  a", "<P", "a<P> b", "<" * 30, "\x0b\x0ctab\tend\r\n", "𝄞 é " * 50]
    more = spark.createDataFrame([(1000 + 40 * k + i, x) for i, x in enumerate(odd) for k in range(12)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    out = infill.fill_in_middle(both).withColumn("again", infill.restore(F.col("output"), F.col("form")))
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.again) for r in out.collect())
    rows = both.collect()
    want = Counter((r.doc_id, *cut_by_hand(r.doc_id, r.text), r.text or "") for r in rows)
    assert got == want and {k[2] for k in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(empty).count() == 0 and infill.fill_in_middle(docs).columns[0] == "doc_id"


def test_fill_in_middle_in_slices_and_batches(spark, docs):
    want = Counter(map(tuple, infill.fill_in_middle(docs).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert Counter(map(tuple, infill.fill_in_middle(docs).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# decontamination


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def hits_by_hand(text, items, size):
    words, hit, found = words_of(text), set(), set()
    for name, item in items:
        w = words_of(item)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            for at in range(len(words) - n + 1):
                if words[at : at + n] == w[k : k + n]:
                    hit.update(range(at, at + n))
                    found.add("" if name is None else str(name))
    return len(words), len(hit), sorted(found)


ITEMS = [(1, "One two THREE four five six seven eight nine ten eleven twelve"), (2, "short item"), (3, None), (None, "no,name.here; at-all"), (4, "..."), (5, "short item"), (6, "ten eleven twelve one two three four five six seven eight"), (1, "x1 x2"), (7, "w" * 100 + " tail"), (8, "")]


def made_texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [*"one two three four five six seven eight nine ten eleven twelve short item x1 x2 tail no name here at all".split(), "w" * 100, "w" * 99, "Ünü", "Ä"]
    out = [None, "", " .,; ", "ONE two,three-four five six seven eight nine ten", "w" * 100 + "!tail"]
    while len(out) < n:
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            item = words_of(rng.choice(ITEMS)[1])
            k = rng.randint(0, len(words))
            words[k:k] = item[rng.randint(0, 2) :]
        out.append(rng.choice((" ", ", ", "\n")).join(words))
    return out


@pytest.mark.parametrize(("shard_words", "block_words"), [(1 << 20, 1 << 18), (64, 1 << 18), (1 << 20, 8), (50, 8)])
def test_decontamination(spark, shard_words, block_words, monkeypatch):
    if block_words == 8:
        monkeypatch.setattr(decontaminate, "PIECE_WORDS", 4)
    texts = made_texts(shard_words, 90)
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts)] + [(5, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_ids", F.lit("clash")).repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("n_words", F.lit("clash"))
    out = decontaminate.contaminated(docs, items, shard_words=shard_words, block_words=block_words).collect()
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in out)
    want = Counter()
    for i, t in rows:
        n, hit, found = hits_by_hand(t, ITEMS, 10)
        want[i, n, hit, tuple(found)] += 1
    assert got == want and any(r.longest >= 10 for r in out)


def test_a_long_text_spans_shards(spark):
    rng = random.Random(3)
    words = [rng.choice("abcdefgh") + str(rng.randint(0, 50)) for _ in range(3000)]
    item = " ".join(words[1490:1530])
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    items = spark.createDataFrame([(9, item)], "item_id long, text string")
    for shard_words in (1 << 20, 500, 1500, 1511):
        r = decontaminate.contaminated(docs, items, shard_words=shard_words).first()
        assert (r.n_words, r.n_hit, r.item_ids, r.longest) == (3000, 40, ["9"], 40), shard_words


def test_decontaminate_removes_and_empty_tables(spark, docs, empty):
    items = spark.createDataFrame([("a", "the quick brown fox jumps over the lazy dog and")], "item_id string, text string")
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {50, 51, 52, 53, 55, 56, None}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, none).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.contaminated(empty, items).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(5)
    for n, k in ((1, 2), (7, 2), (300, 2), (300, 3), (500, 70_000)):
        codes = np.append(rng.integers(1, k, n), 0).astype(np.int32)
        assert suffixes.suffix_array(codes, n + 1).tolist() == sorted(range(n + 1), key=lambda i: codes[i:].tolist())


# periodic runs


def runs_by_hand(words):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed_by_hand(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted_by_hand(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def periodic_texts(seed, n):
    rng, out = random.Random(seed), [None, "", " \n", "a " * 11, "a " * 12, "a b " * 500, "x y z " * 4 + "a b c d e f g h", "ab " * 30 + "c " + "ab " * 30]
    while len(out) < n:
        words = [f"w{rng.randint(0, rng.choice((1, 2, 5, 60)))}" for _ in range(rng.choice((3, 20, 90, 250)))]
        for _ in range(rng.randint(0, 3)):
            a, p = rng.randrange(len(words)), rng.randint(1, max(1, len(words) // 3))
            for i in range(a + p, min(len(words), a + p * rng.randint(2, 9))):
                words[i] = words[i - p]
        out.append(rng.choice((" ", "\t", "  \n")).join(words))
    return out


@pytest.mark.parametrize("batch_words", [1, 700, 1 << 18])
def test_periodic_runs(spark, docs, empty, batch_words):
    rows = [(k if k % 9 else None, t) for k, t in enumerate(periodic_texts(batch_words, 120))] + [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 5000]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash")).repartition(3)
    got = Counter((r.doc_id, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic.repeated_runs(table, batch_words=batch_words).collect())
    want = Counter()
    for i, t in rows:
        words = (t or "").split()
        runs = runs_by_hand(words)
        want[i, tuple(runs), collapsed_by_hand(words, runs)] += 1
    assert got == want
    assert periodic.repeated_runs(empty).count() == 0


def test_op13_by_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = set()
    for r in rows:
        words = planted_by_hand(r.doc_id, r.text)
        if len(words) > 1500:
            continue
        runs = runs_by_hand(words)
        s, n, q = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        want.add((r.doc_id, len(runs), s, n, q, 1000 * n // q if runs else None, digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)), digest(collapsed_by_hand(words, runs))))
    got = {tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, SMALL).collect()}
    assert want <= got and len(got) == len(rows) and sum(1 for x in want if x[1]) > 5


def test_planted_texts(spark, docs):
    got = Counter((r.doc_id, " ".join((r.text or "").split())) for r in periodic.planted(docs).collect())
    assert got == Counter((r.doc_id, " ".join(planted_by_hand(r.doc_id, r.text))) for r in docs.collect())


def test_long_and_regular_texts():
    rng = np.random.default_rng(2)
    tile = np.tile(rng.integers(1, 9000, 700), 60)
    for codes, want in ((np.ones(40_000), (0, 40_000, 1)), (tile, (0, len(tile), 700))):
        codes = np.append(codes, 0).astype(np.int32)
        start, stop, period = periodic.runs_of(codes, np.array([len(codes) - 1]))
        assert want in list(zip(start.tolist(), stop.tolist(), period.tolist(), strict=True))


def test_runs_need_blocks():
    with pytest.raises(ValueError):
        periodic.runs_of(np.zeros(1, np.int32), np.array([0]), shortest=5)
