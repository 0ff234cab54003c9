"""Operators 9 and 10, and the pipeline."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from meshlytics.llm import language_id, minhash, pii
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]"
]


def brute(text):
    digits = lambda m: pii.only_digits(m.group())
    ok = [
        lambda m: True, lambda m: all(int(p) <= 255 for p in m.group().split(".")),
        lambda m: 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m)), lambda m: 10 <= len(digits(m)) <= 15
    ]
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if ok[k](m))


def test_base_spans_are_those_of_the_patterns():
    random.seed(5)
    for _ in range(20_000):
        x = "".join(random.choice("a1@.+- (2\n@.-9b%") for _ in range(random.randrange(40)))
        assert pii._scan(x)[0] == brute(x)


def test_long_runs_are_cheap():
    import time

    for x in ("1" * 200_000, "@" + "a" * 200_000, "a@" * 100_000, "1 " * 50_000, "(1" + ")" * 200_000):
        began = time.time()
        pii._scan(x)
        assert time.time() - began < 10


def test_pii(spark):
    rows = [(k, f"call +1 (269) 555-32{k:02d} or x{k}@mail.example.com, from 10.0.0.{k} or 4532 0151 1283 0366.", "e") for k in range(20)]
    rows += [
        (100, "+1 (269) 555-3296 4532015112830366 end", "e"), (101, None, "e"), (102, "", "e"), (103, "no data 12 here", "e"),
        (103, "no data 12 here", "e"), (104, "4532015112830366, x " * 20_000, "e")
    ]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()}
    for k, t, _ in rows:
        base = brute(t or "")
        assert got[k].base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[b]}:{a}:{c}" for a, b, c in base).encode()).hexdigest()
        assert set(f"{pii.KINDS[b]}:{a}:{c}" for a, b, c in base) <= set(got[k].spans.split(","))
    assert got[100].n_phone == got[100].n_card == 0 and got[100].spans == "phone:0:17,card:18:34"  # the patterns lose both
    assert got[104].spans.count("card") == 20_000  # a very long text
    assert got[103].spans == "" == got[101].spans
    clean = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()}
    assert clean[0] == "call <PHONE> or <EMAIL>, from <IP> or <CARD>." and clean[100] == "<PHONE> <CARD> end" and clean[101] is None
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [r.spans for r in pii.find(spark.createDataFrame([(1, "nothing")], "doc_id long, text string")).collect()] == [""]


def test_model_decides(spark):
    """Forms that no pattern knows are found, and what only looks like personal data is left alone; the untrained rule, which
    takes each open candidate, gets most of this wrong."""
    random.seed(3)

    def card():
        d = "45" + "".join(random.choice("0123456789") for _ in range(13))
        return d + next(c for c in "0123456789" if pii.luhn(d + c))

    digits = lambda n: "".join(random.choice("0123456789") for _ in range(n))
    forms = [
        lambda: f"call +1 ({digits(3)}) 555-{digits(4)} now", lambda: f"at +44 20 {digits(4)} {digits(4)} or", lambda: f"pay {card()} then",
        lambda: f"by x{digits(2)}@mail.example.com and", lambda: f"from 10.{random.randrange(256)}.0.{random.randrange(256)} on",
        lambda: f"version {digits(1)}.{digits(1)} of {digits(4)}"
    ]
    rows = [(k, random.choice(forms)()) for k in range(400)]
    planted = {
        "+1 (269) 555-3296 4532015112830366 end": {("phone", "+1 (269) 555-3296"), ("card", "4532015112830366")},
        "card 4532.0151.1283.0366 ok": {("card", "4532.0151.1283.0366")}, "card 4532.0151.1283.0367 ok": set(),
        "write to bob @ example.com today": {("email", "bob @ example.com")}, "tel 1 269 555-3296": {("phone", "1 269 555-3296")},
        "since 2024-01-31 10:15:00 there": set(), "order 100200300": set(), "a price of 1,234,567.89": set(), "310.0.0.7": set(),
    }
    texts = list(planted)
    df = spark.createDataFrame([*rows, *((1000 + k, t) for k, t in enumerate(texts))], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find(df).where("doc_id >= 1000").collect()}
    rule = {(k, "any"): 1.0 for k in range(1, 5)}
    differ = 0
    for k, t in enumerate(texts):
        found = {(x.split(":")[0], t[int(x.split(":")[1]) : int(x.split(":")[2])]) for x in got[1000 + k].split(",") if x}
        assert found == planted[t], t
        base, runs = pii._scan(t)
        differ += {(pii.KINDS[k], t[s:e]) for s, k, e in pii._spans(base, runs, rule)} != found
    assert differ >= 4


def segmentations(ends, n):
    """All of them, as lists of (first atom, end, label, features)."""
    if n == 0:
        yield []
    else:
        for s, k, f in ends[n - 1]:
            for rest in segmentations(ends, s):
                yield [*rest, (s, n, k, f)]


def test_decoding_and_likelihood_are_those_of_all_segmentations():
    rng = np.random.default_rng(2)
    for line in ("+1 (269) 555-3296 4532015112830366", "10 20 30 40 50 60 70", "bob @ x.org 4532 0151 1283 0366", "1 2"):
        for _ in range(20):
            (cue, atoms), = pii.sequences(line, 0)
            ends = pii.candidates(atoms, cue)
            w = {(k, x): rng.normal() for here in ends for _, k, f in here for x in f}
            every = list(segmentations(ends, len(atoms)))
            total = [sum(pii.score(w, k, f) for _, _, k, f in x) for x in every]
            entities = [[(s, e, k) for s, e, k, _ in x if k] for x in every]
            best = pii.decode(atoms, w, cue)
            assert total[entities.index(best)] >= max(total) - 1e-9
            gold = set(entities[int(rng.integers(len(every)))])
            at = [[pii.score(w, k, f) for _, k, f in here] for here in ends]
            value, off = pii.likelihood(ends, gold, at)
            assert abs(value - (total[[set(x) for x in entities].index(gold)] - np.logaddexp.reduce(total))) < 1e-9
            e = int(rng.integers(len(ends)))
            c = int(rng.integers(len(ends[e])))
            if ends[e][c][1]:
                at[e][c] += 1e-5
                assert abs((pii.likelihood(ends, gold, at)[0] - value) / 1e-5 + off[e][c]) < 1e-3  # finite difference


def test_segmentations_that_tie_have_no_entities():
    for line in ("+1 (269) 555-3296 4532015112830366", "10 20 30 40"):
        ((cue, atoms),) = pii.sequences(line, 0)
        assert pii.decode(atoms, {}, cue) == []  # all score nothing
    assert pii.decode([], {}) == [] and pii.sequences("no numbers", 0) == []


def test_pii_keeps_clashing_columns(spark):
    df = spark.createDataFrame(
        [(1, "10.0.0.1", "mine", "mine", "mine", "mine"), (1, "10.0.0.1", "mine", "mine", "mine", "mine")],
        "doc_id long, text string, _base string, _runs string, _lessons string, N_IP string"
    )
    assert [(r._base, r._runs, r._lessons, r.n_ip, r.spans) for r in pii.find(df).collect()] == [("mine", "mine", "mine", 1, "ip:0:8")] * 2
    assert [(r._base, r.text) for r in pii.redact(df).collect()] == [("mine", "<IP>")] * 2


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs.where(~language_id.held_out()))
    got = language_id.identify(
        docs.withColumn("score", F.lit("old")), model
    ).where(language_id.held_out()).select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) >= 0.9 and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame(
        [(1, None), (2, ""), (3, "12 !"), (4, "the of and " * 50_000), (4, "the of and")], "doc_id long, text string"
    )
    rows = Counter((r.doc_id, r.lang_pred) for r in language_id.identify(odd, model).collect())
    assert rows[1, "und"] == rows[2, "und"] == rows[3, "und"] == 1 and rows[4, "und"] == 0 and sum(rows.values()) == 5
    none = language_id.fit(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language_id.identify(odd, none).collect()} == {"und"}
    assert language_id.identify(odd.limit(0), model).count() == 0


def test_rare_language_and_frequencies_of_all_rows(spark):
    """A language with 1 of 500 rows is learnt from a sample of 200, and document frequencies are those of all rows."""
    rng = np.random.default_rng(5)
    rows = [
        (k, " ".join("abcdefgh"[i] for i in rng.integers(0, 8, 30)), "xx") for k in range(1497)
    ] + [(5000 + k, f"zuz zyz zuz {'zy' * (k + 1)}", "zz") for k in range(3)]
    rows += [(9000, "12 34", "yy"), (9001, None, "yy"), (9002, "abc", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language_id.fit(df, sample=200)
    assert model.languages == ["xx", "zz"] and model.predict("zuz zyz")[0] == "zz" and model.predict("ab cd ef")[0] == "xx"
    seen = sum((language_id.counts(t) > 0).astype(int) for _, t, y in rows[:1500])
    assert np.allclose(model.idf, np.log(1501 / (1 + seen)) + 1, atol=1e-5)


def test_language_by_brute_force():
    """Counts against a loop over characters, training against dense rules, and the temperature against its grid."""
    for text in ("Ab c", "é  É\n1x", "日本", "aaaa bbb", "x"):
        low = "".join(c if c >= "\x80" or "a" <= c <= "z" else " " for c in text.lower())
        low = " " + re.sub(" +", " ", low) + " "

        def slot(gram):
            p, q, m = 0x9E3779B1, 0x85EBCA6B, (1 << 32) - 1
            c = [ord(x) for x in gram]
            k = [0, c[0] * 0xC2B2AE35 + 1, 0, 0]
            if len(c) > 1:
                two = (c[0] * p + c[1]) & m
                k[2] = two * 0x27D4EB2F + 2
                if len(c) > 2:
                    k[3] = ((two * q + c[2]) & m) * 0x165667B1 + 3
            h = k[len(c)] & m
            h ^= h >> 15
            return ((h * 0x2C1B3C6D) & m) >> (32 - 15)

        want = Counter(slot(low[i : i + n]) for n in (1, 2, 3) for i in range(len(low) - n + 1) if n > 1 or 0 < i < len(low) - 1)
        got = language_id.counts(text)
        assert {k: v for k, v in enumerate(got.tolist()) if v} == dict(want), text
    rng = np.random.default_rng(1)
    rows = [
        (
            np.array([*np.flatnonzero(x), 6]), np.array([*x[x != 0], 1.0]), int(y)
        ) for x, y in zip(rng.integers(0, 3, (40, 6)).astype(float), rng.integers(0, 3, 40))
    ]
    w, bias = language_id.ftrl(rows, 6, 3, passes=2)
    z, n, alpha, beta, l1, l2 = np.zeros((7, 3)), np.zeros((7, 3)), 0.5, 1.0, 0.02, 0.05
    order = np.random.default_rng(7)
    for _ in range(2):
        for r in order.permutation(40):
            x = np.zeros(7)
            x[rows[r][0]] = rows[r][1]
            v = np.array(
                [[0.0 if abs(z[i, c]) <= l1 else -(z[i, c] - np.sign(z[i, c]) * l1) / ((beta + n[i, c] ** 0.5) / alpha + l2) for c in range(3)] for i in range(7)]
            )
            p = np.exp(x @ v) / np.exp(x @ v).sum()
            p[rows[r][2]] -= 1
            for i in np.flatnonzero(x):
                for c in range(3):
                    g = x[i] * p[c]
                    z[i, c] += g - ((n[i, c] + g * g) ** 0.5 - n[i, c] ** 0.5) / alpha * v[i, c]
                    n[i, c] += g * g
    dense = np.array(
        [[0.0 if abs(z[i, c]) <= l1 else -(z[i, c] - np.sign(z[i, c]) * l1) / ((beta + n[i, c] ** 0.5) / alpha + l2) for c in range(3)] for i in range(7)]
    )
    assert np.allclose(w, dense[:6]) and np.allclose(bias, dense[6])


def test_language_ties_and_temperature(spark):
    """Two languages with the same texts tie: the first in order. Scores of rows kept apart are calibrated better than raw ones."""
    rows = [(k, "abc def", "bb" if k % 2 else "aa") for k in range(40)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["aa", "bb"] and 0.3 < model.predict("abc def")[1] < 0.7
    model.weights[:], model.bias[:] = 0, 0
    assert model.predict("abc def") == ("aa", 0.5)


def test_held_out_is_the_crc(spark):
    import zlib

    ids = list(range(200))
    got = spark.createDataFrame([(k,) for k in ids], "doc_id long").select("doc_id", language_id.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame(
        [
            (10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "123 456", "en", "s", 7),
            (None, "the of and in that", "en", None, None)
        ],
        docs.schema
    )
    current = docs.unionByName(extra)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "minhash_near_dedup", "pii", "best_fit_packing"]
    kept = stages["language_id"](spark, current, SF).cache()
    assert kept.columns == docs.columns and kept.where("doc_id >= 1000000").count() == 0 and kept.count() >= docs.count() - 2
    lines = stages["line_dedup"](spark, kept, SF).cache()
    assert lines.columns == docs.columns and lines.count() == kept.count()
    assert lines.where("n_chars <> length(text)").count() == 0
    near = stages["minhash_near_dedup"](spark, lines, SF).cache()
    texts = [(r.doc_id, r.text) for r in lines.where("doc_id is not null").collect()]
    sets = {k: set(minhash.shingles(t, 5).tolist()) for k, t in texts}
    links = [(a, b) for a in sets for b in sets if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    gone = {r.doc_id for r in lines.collect()} - {r.doc_id for r in near.collect()}
    from tests.llm.test_pairs import smallest_reachable

    want = smallest_reachable(sets, links)
    assert gone == {k for k in sets if want[k] != k}
    clean = stages["pii"](spark, near, SF).cache()
    assert clean.columns == docs.columns and clean.count() == near.count()
    assert not any(brute(r.text or "") for r in clean.collect())
    packed = stages["best_fit_packing"](spark, clean, SF)
    assert packed.select("doc_id").distinct().count() == clean.select("doc_id").distinct().count()
    assert stages["minhash_near_dedup"](spark, lines.limit(0), SF).count() == 0


def test_near_dedup_keeps_different_texts_of_an_id(spark):
    stage = dict(corpus_pipeline.STAGES)["minhash_near_dedup"]
    rows = [
        (1, "one two three four five six"), (1, "other words are standing here"), (2, "One two three four five six"),
        (None, "one two three four five six"), (None, "a text of its own here"), (3, "repeated row of some words"),
        (3, "repeated row of some words"), (4, ""), (5, None)
    ]
    docs = spark.createDataFrame(
        [(k, t, "en", "s", 1, "x") for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _row string"
    )
    got = stage(spark, docs, SF)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([rows[0], rows[1], rows[4], rows[5], rows[7], rows[8]])


def test_run(spark, tmp_path):
    """``run`` gives what its stages give one after the other, over null, empty and repeated rows too."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    extra = spark.createDataFrame(
        [
            (10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "the of and in that", "en", "s", 7),
            (10**6 + 2, "the of and in that", "en", "s", 7)
        ],
        docs.schema
    )
    docs.unionByName(extra).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        current = spark.createDataFrame(stage(spark, current, str(tmp_path)).collect(), stage(spark, current, str(tmp_path)).schema)
    want = Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in current.collect())
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got.collect()) == want and len(want) > 20
    assert sum(n for (k, *_), n in want.items() if k == 10**6 + 2) == 1 and not any(k in (10**6, 10**6 + 1) for k, *_ in want)


def test_learning_holds_one_dense_count(spark, monkeypatch):
    """The counts of many sampled texts are kept sparse: a dense one is of one text at a time."""
    import gc
    import weakref

    df = spark.createDataFrame([(k, f"words of text {'ab' * k}", "en") for k in range(40)], "doc_id long, text string, lang string").coalesce(1)
    plain, live, most = language_id.counts, [], []

    def watched(text, slots=language_id.SLOTS):
        n = plain(text, slots)
        live.append(weakref.ref(n))
        most.append(sum(x() is not None for x in live))
        return n

    got = []
    monkeypatch.setattr(language_id, "counts", watched)
    monkeypatch.setattr(language_id, "map_batches", lambda rows, fn, schema: got.append((rows, fn)) or (_ for _ in ()).throw(InterruptedError))
    with pytest.raises(InterruptedError):
        language_id.fit(df)
    ((rows, fn),) = got
    table = rows.toArrow().combine_chunks().to_batches()[0]
    live.clear(), most.clear(), gc.collect()
    assert len(fn(table)[1]) == 40 and max(most) <= 2
