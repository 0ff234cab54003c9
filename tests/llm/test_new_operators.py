"""Spelling variants, decontamination and lexical search against brute force and SQL."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshlytics.llm import decontaminate, lexical_search, registry, spelling
from meshlytics.llm.common import ascii_words, saved

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOW))


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_fm_decontamination", "op13_treap_search"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = con.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = Counter(tuple(r[names.index(c)] for c in columns) for r in result.fetchall())
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == want and want


def test_words_of_batches():
    texts = ["Ab c-d", None, "", "é9X", "x", "y z.", "..", "日本 q"]
    array = pa.array(["skip me", *texts]).slice(1)
    words, before, places = ascii_words(array)
    got = [words.to_pylist()[a:b] for a, b in zip(before, before[1:])]
    assert got == [words_of(t) for t in texts]
    for k, t in enumerate(texts):
        for w, (a, b) in zip(got[k], places[before[k] : before[k + 1]]):
            assert t.encode()[a:b].decode().translate(LOW) == w


# 11 ---------------------------------------------------------------------------------------------------------------------
def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(words):
    out = {}
    form = {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
        out[w] = len(others)

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, out[w], words[form[w]] if form[w] else None) for w, n in words.items()}


def variants(seed, size, letters="abé"):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 12))) for _ in range(size)]
    out = {}
    for w in stems:
        out[w] = rng.choice([2, 30, 400, 5000])
        for _ in range(rng.randint(0, 6)):
            p, kind = rng.randrange(len(w)), rng.random()
            v = w[:p] + rng.choice(letters) * (kind < 0.7) + w[p + (kind > 0.35) :]
            if len(v) >= 7:
                out.setdefault(v, rng.choice([2, 3, 30]))
    return out


@pytest.mark.parametrize("crowd", [200, 3])
def test_variants_by_brute_force(spark, crowd):
    words = variants(crowd, 40)
    words |= {"prefixed" + a + b: 2 for a in "abcdefghij" for b in "abcdefgh"} | {
        "prefixedzz": 50, "prefixedzzz": 600, "ab" * 40: 2, "ab" * 39 + "aab": 30
    }
    got = spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n long"), crowd=crowd)
    assert {tuple(r) for r in got.collect()} == grouped(words)


def test_vocabulary_and_edge_cases(spark):
    rng = random.Random(5)
    rows = [
        (
            i, " ".join(rng.choice(["Sevenly", "sevenly", "ÀÉîöüßÿ", "short", "longer1longerer", "x" * 5000]) for _ in range(30))
        ) for i in range(40)
    ]
    rows += [(None, "nullable nullable"), (7, None), (8, ""), (9, "12 34"), rows[0]]
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    got = {r["word"]: r["n"] for r in spelling.vocabulary(docs).collect()}
    assert got == {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    assert spelling.group_variants(spelling.vocabulary(docs.limit(0))).count() == 0


# 12 ---------------------------------------------------------------------------------------------------------------------
def test_suffixes_and_ranks():
    rng = np.random.default_rng(3)
    for alphabet in (2, 50):
        body = rng.integers(1, alphabet + 1, 3000)
        text = np.append(np.tile(body, 2), 0).astype(np.int64)
        want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
        assert decontaminate.sorted_suffixes(text).tolist() == want
        rows, zeros = decontaminate.Wavelet.of(text.astype(np.uint32))
        w = decontaminate.Wavelet(rows, zeros)
        at = rng.integers(0, len(text), 200)
        symbol, times = w.read(at)
        assert (symbol == text[at]).all() and all(times[k] == (text[: at[k]] == text[at[k]]).sum() for k in range(200))
        (got,) = w.ranks(np.full(200, 2), at)
        assert all(got[k] == (text[: at[k]] == 2).sum() for k in range(200))


def hits(text, items, window=10):
    w, hit, ids = words_of(text), set(), set()
    for item, other in items:
        o = words_of(other)
        for p in range(max(len(o) - window, 0) + 1) if o else ():
            phrase = o[p : p + window]
            for q in range(len(w) - len(phrase) + 1):
                if w[q : q + len(phrase)] == phrase:
                    hit |= set(range(q, q + len(phrase)))
                    ids |= {item} - {None}
    return len(w), hit, sorted(ids)


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(11)
    vocabulary = ["a", "b", "cé", "d9", "E", "日本"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([1, 3, 12, 25]) if k else 2)) for k in range(6)] + [
        (6, ""), (7, None), (None, text(11)), (3, text(14)), (8, text(40)), (9, "no such words at all")
    ]
    docs = []
    for k in range(120):
        parts = [text(rng.randint(0, 40))] + [rng.choice(items)[1] or "" for _ in range(rng.randint(0, 2))] + [text(rng.randint(0, 9))]
        docs.append((k, ", ".join(parts)))
    docs += [
        (500, None), (501, ""), (502, "..."), docs[3], docs[3], (None, items[4][1]), (503, text(20_000)), (504, items[10][1]),
        (505, items[10][1].upper() + ".")
    ]
    return docs, items


@pytest.mark.parametrize("shard,block", [(1_000_000, 100_000), (300, 7)])
def test_decontamination_by_brute_force(spark, passages, shard, block):
    docs, items = passages
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"shard": F.lit("clash"), "spans": F.lit(1)})
    shards = saved(decontaminate.index(frame, shard=shard), "index")
    got = decontaminate.contamination(shards, spark.createDataFrame(items, "item_id long, text string"), block=block).collect()

    def spans(found):
        out = []
        for q in sorted(found):
            out = [*out[:-1], (out[-1][0], q + 1)] if out and out[-1][1] == q else [*out, (q, q + 1)]
        return out

    want = Counter()
    for doc, text in docs:
        n, hit, ids = hits(text, items)
        want[doc, n, tuple(spans(hit)), tuple(ids)] += 1
    assert Counter((r["key"], r["n_words"], tuple((s["start"], s["end"]) for s in r["spans"]), tuple(r["items"])) for r in got) == want
    assert sum(len(k[2]) > 0 for k in want) > 50


def test_removal_and_empty_tables(spark):
    docs = spark.createDataFrame(
        [(1, "keep THIS; one-two three four, and that", "x"), (2, None, "y"), (3, "clean", "z")], "doc_id long, text string, spans string"
    )
    items = spark.createDataFrame([("q", "One two three FOUR")], "item_id string, text string")
    out = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, items).collect()}
    assert out == {1: "keep THIS; , and that", 2: None, 3: "clean"}
    shards = saved(decontaminate.index(docs.limit(0)), "index")
    assert decontaminate.contamination(shards, items).count() == 0
    shards = saved(decontaminate.index(docs), "index")
    assert [tuple(r["items"]) for r in decontaminate.contamination(shards, items.limit(0)).collect()] == [()] * 3


# 13 ---------------------------------------------------------------------------------------------------------------------
def ranked(docs, items, top=10):
    tf = [(d, Counter(words_of(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in tf]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in tf for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * k + 1))) for t, k in df.items()}
    by_id = {}
    for i, text in items:
        by_id.setdefault(i, set()).update(words_of(text))
    out = Counter()
    for i, terms in by_id.items():
        scores = []
        for (d, c), size in zip(tf, sizes):
            s = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (10 + 90 * size * n // total))) for t in terms if t in c)
            scores += [(-s, d is not None, d)] * (s > 0)
        for rank, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1):
            out[i, rank, d, -s] += 1
    return out


@pytest.mark.parametrize("block,shard,beam,slots", [(100_000, 8192, 64, 16_000_000), (5, 16, 1, 100)])
def test_search_by_brute_force(spark, block, shard, beam, slots):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(vocabulary[min(int(rng.paretovariate(0.7)), 59)] for _ in range(n))
    docs = [(k, text(rng.choice([0, 1, 5, 30, 80]))) for k in range(200)]
    docs += [(900 - k, docs[7][1] + " w33 w34") for k in range(40)] + [
        (None, docs[7][1]), (950, None), (5, text(40)), (5, "w33 w34"), (951, text(30_000))
    ]
    items = [(k, text(rng.choice([1, 3, 20]))) for k in range(12)] + [
        (20, "W33 w34, w33"), (21, "unknown"), (22, None), (None, "w40 w41"), (3, "w5 w50")
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"key": F.lit("clash"), "n": F.lit(1)})
    got = lexical_search.search(
        frame, spark.createDataFrame(items, "item_id long, text string"), block=block, shard=shard, beam=beam, slots=slots
    )
    assert Counter(tuple(r) for r in got.collect()) == ranked(docs, items)


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(docs.limit(0), items).count() == 0 == lexical_search.search(docs, items.limit(0)).count()


def test_treap_holds_all_points():
    rng = np.random.default_rng(1)
    flat = rng.choice(64 * 50, 400, replace=False)
    rows, columns, impacts = flat // 50, flat % 50, rng.integers(1, 1000, 400)
    tree = lexical_search.Treap(rows, columns, impacts)
    for r, c, v in zip(rows, columns, impacts):
        cell = np.zeros(1, np.int64)
        for b in range(tree.levels - 1, -1, -1):
            assert tree.most[cell[0]] >= v
            cell = tree.children(cell, np.array([(r >> b & 1) << 1 | c >> b & 1]))
        assert tree.most[cell[0]] == v


# Mends --------------------------------------------------------------------------------------------------------------
def test_digit_runs_of_any_length_and_many_spans():
    """Parts of any length are read, and time goes with the length of a text, not with its square."""
    from time import perf_counter

    from meshlytics.llm import pii

    for n in (5_000, 100_000):
        assert pii._scan("0" * n + ".1.1.1")[0] == [(0, 1, n + 6)]
        assert pii._scan("1" * n + ".1.1.1")[0] == [] and pii._scan("1.1.1." + "0" * n + "256")[0] == []
    every = {(k, "any"): 5.0 for k in range(1, 5)}  # weights that take whatever they can

    def seconds(spans):
        text = "x a@b.cd y 555 0100 2345\n" * spans
        t = perf_counter()
        base, runs = pii._scan(text)
        found = pii._spans(base, runs, every)
        pii._lessons("a@b.cd 10.0.0.1 " * spans)
        assert len(base) == spans and len(found) >= 2 * spans
        return perf_counter() - t

    seconds(100)
    assert seconds(50_000) < 30 * max(seconds(5_000), 0.05)
    base, runs = pii._scan("call 10.0.0.1 or 10.0.0.2 now a@b.cd 5550100234 x")
    slow = [
        x for cue, run in runs for s, e, label in pii.decode(run, every, cue) for x in [(run[s][0], label - 1, run[e - 1][1])] if not any(
            p < x[2] and x[0] < q for p, _, q in base
        )
    ]
    assert pii._spans(base, runs, every) == sorted([tuple(x) for x in base] + slow)


def test_links_at_the_threshold_are_not_lost():
    """Of pairs at exactly 0.85 none falls below the filters; the cuts are those of the exact tail."""
    from meshlytics.llm import minhash

    rng = np.random.default_rng(4)
    for k in (64, 512):
        t, p = 0.85, 1.0
        low = minhash.near_enough(k, 85)
        tail = sum(math.comb(k, i) * t**i * (1 - t) ** (k - i) for i in range(round(low * k)))
        assert tail <= minhash.LOST_BY_ESTIMATE < tail + math.comb(k, round(low * k)) * t ** round(low * k) * (1 - t) ** (k - round(low * k))
        tail = sum(math.comb(k, i) * t**i * (1 - t) ** (k - i) for i in range(minhash.shared_at_least(k, 85)))
        p = 2 * (tail + minhash.LOST_BY_ESTIMATE)
        assert p < 1e-6
        missed = 0
        for _ in range(3000):
            union = np.unique(rng.integers(0, 1 << 63, 2000, dtype=np.uint64))
            own = rng.permutation(len(union))
            a, b = np.sort(union[own[: len(union) - 150]]), np.sort(union[own[150:]])
            sa, sb = a[:k], b[:k]
            ok = minhash.estimate(sa, sb, len(a), len(b), k) >= low and len(np.intersect1d(sa, sb)) >= minhash.shared_at_least(k, 85)
            missed += not ok
        assert missed == 0
