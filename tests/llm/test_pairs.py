"""Operators 2, 4 and 8 against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from meshlytics.llm import ann, common, embedding_dedup, minhash


def smallest_reachable(nodes, links):
    root = {v: v for v in nodes}

    def find(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in nodes}


def test_components(spark):
    random.seed(1)
    links = [
        (random.randrange(300), random.randrange(300)) for _ in range(200)
    ] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = smallest_reachable(range(600), links)
    assert all(got.get(v, v) == want[v] for v in range(600))
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_copies(n, words, changes, rng, base):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(changes + 1)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_texts(spark, words, percent):
    rng = random.Random(words)
    vocabulary = [f"w{k}" for k in range(400)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [" ".join(some(rng.randrange(1, 200))) for _ in range(150)]
    passage = " ".join(some(60))
    texts += [f"{passage} {' '.join(some(rng.randrange(5, 60)))}" for _ in range(120)]  # a frequent passage, mostly not similar
    for size, changes in ((60, 2), (120, 8), (400, 12), (20, 1), (8, 1), (4, 1)):
        texts += near_copies(25, size, changes, rng, some(size))
    texts += [texts[0]] * 30 + ["", "   \t\n", None, "One", "oNE", "one two", "İ i", "x " * 20000, "x " * 20000 + "y"]
    rows = [(k, t, 0) for k, t in enumerate(texts)] + [(None, texts[1], 0), (5, texts[5], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(5)
    got = minhash.near_duplicates(df, words=words, percent=percent).collect()
    assert len(got) == len(rows)

    def shingle_set(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\v\f\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()

    sets = [shingle_set(t) for t in texts]
    links = [
        (a, b) for a in range(len(texts)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    want = smallest_reachable(range(len(texts)), links)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_near_pair_alone_in_its_wide_lists(spark):
    """Near copies of passages that thousands of texts share: their lists are long with 64 values, and of two with 512."""
    rng = random.Random(1)
    some = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passages = [some(100) for _ in range(4)]
    texts = [[*sum(rng.sample(passages, 3), []), *some(88)] for _ in range(3000)]
    texts += [[*sum(order, []), *some(10)] for order in (passages, passages[::-1])]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in texts]
    seen = Counter(s for x in sets for s in x)
    place = {s: k for k, s in enumerate(s for s, n in seen.items() if n > 1)}
    m = np.zeros((len(sets), len(place)), np.float32)
    for k, x in enumerate(sets):
        m[k, [place[s] for s in x if s in place]] = 1
    both, size = m @ m.T, np.array([len(x) for x in sets])
    links = np.argwhere(np.triu(100 * both >= 80 * (size[:, None] + size[None, :] - both), 1)).tolist()
    assert links == [[3000, 3001]]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert got == smallest_reachable(range(len(texts)), links)


def test_blocks_find_what_hubs_miss(spark):
    """Lists of many members in different components: blocks of bounded size still find each near pair, in few rows."""
    rng = np.random.default_rng(3)
    common_part = rng.integers(0, 2**60, 40)
    sets = [np.unique(np.concatenate([common_part, rng.integers(0, 2**60, 20)])) for _ in range(60)]
    sets += [np.unique(np.append(s[:-1], rng.integers(0, 2**60))) for s in sets[:10]]
    nodes = spark.createDataFrame([(k, len(s), s.tolist()) for k, s in enumerate(sets)], "id long, n long, sketch array<long>")
    apart = spark.createDataFrame(
        [(1, k, len(s), k, len(sets)) for k, s in enumerate(sets)], "v long, id long, n long, comp long, size long"
    )
    got = minhash.block_links(apart, nodes, 512, 85, block=16).collect()
    assert {(r.a, r.b) for r in got} == {(k, 60 + k) for k in range(10)} and all(r.sure for r in got)


def test_trees_are_verified_in_blocks(spark):
    """Texts longer than a sketch: of promising pairs the near ones are found, across blocks and a large component too."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**9)}" for _ in range(900)]
    texts = [" ".join([*base[: 900 - 9 * k], *(f"v{k}x{j}" for j in range(9 * k))]) for k in range(24)]
    sets = [minhash.shingles(t, 5) for t in texts]
    links = [(a, b) for b in range(24) for a in range(b) if minhash.similar(sets[a], sets[b], 80)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    chain = spark.createDataFrame([(k, k + 1) for k in range(23)], "a long, b long")
    known = spark.createDataFrame([(0, k) for k in range(1, 6)], "a long, b long")
    got = [(r.a, r.b) for r in minhash.cluster_links(chain, known, df, 5, 512, 80, block=4).collect()]
    assert set(map(tuple, map(sorted, got))) <= set(links)
    assert smallest_reachable(range(24), got + [(0, k) for k in range(1, 6)]) == smallest_reachable(range(24), links)


def test_each_two_components_meet_in_a_block(spark):
    rows = [(1, k, min(k, 40) if k < 60 else 0) for k in range(150)] + [(2, 200 + k, 7) for k in range(9)]
    dealt = minhash.in_blocks(spark.createDataFrame(rows, "v long, id long, comp long"), "v", 8).collect()
    groups = {}
    for r in dealt:
        groups.setdefault((r.v, r.i, r.j), []).append(r)
    met = {(a.id, b.id) for g in groups.values() for a in g for b in g}
    assert all((a[1], b[1]) in met for a in rows for b in rows if a[0] == b[0] and a[2] != b[2])
    assert all(g[0].v == 1 for g in groups.values()) and max(map(len, groups.values())) < 40


def test_near_texts_by_text_ids(spark):
    rows = [
        ("b", "one two three four five six"), ("a", "one two three four five six"), ("c", "other words are here now"),
        (None, "one two three four five six"), ("c", "")
    ]
    got = sorted(
        ((r.doc_id or "", r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()),
        key=str
    )
    assert got == [("", None, True), ("a", "a", True), ("b", "a", False), ("c", "c", True), ("c", "c", True)]


def vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16))
    x = [c + rng.normal(size=16) * s for c in centres for s in (0.02, 0.15, 0.3) for _ in range(25)] + list(rng.normal(size=(200, 16)))
    x += [x[0]] * 40 + [2 * x[3]]
    rows = [(k, [float(np.float32(v)) for v in e], None if k % 31 == 0 else k % 2, "z") for k, e in enumerate(x)]
    odd = [
        (9001, None, 0, "z"), (9002, [0.0] * 16, 0, "z"), (9003, [float("nan")] + [1.0] * 15, 0, "z"),
        (9004, [float("inf")] + [1.0] * 15, 0, "z"), (9005, [None] + [1.0] * 15, 0, "z"), (9006, [], 0, "z"), (9020, [1.0, 2.0], 0, "z"),
        (None, rows[0][1], 0, "z")
    ]
    return rows, spark.createDataFrame(
        [*rows, *odd, rows[1]], "vec_id long, embedding array<float>, label int, score string"
    ).repartition(4)


def test_search(spark):
    rows, df = vectors(spark)
    got = ann.search(df, df.where("vec_id % 20 = 0"), top=20, block=100).collect()
    x = {k: np.array(e) for k, e, _, _ in rows}
    ids = np.array(sorted(x))
    m = np.stack([x[k] for k in ids])
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in own] == list(range(1, 21)) and q not in [v for _, v, _ in own]
        assert all(abs(s - float(x[v] @ x[q])) < 1e-9 for _, v, s in own)
        assert [(-round(s, 9), v) for _, v, s in own] == sorted((-round(s, 9), v) for _, v, s in own)
        s = m @ x[q]
        s[ids == q] = -np.inf
        least = np.sort(s)[-20]
        hits += sum(sc >= least - 1e-9 for _, _, sc in own)
        total += 20
    assert hits / total >= 0.97 and 9020 not in {r.query_id for r in got}
    few = df.where("vec_id < 5")
    assert ann.search(few, few.where("vec_id = 0"), top=20).count() == 4
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_search_by_odd_parts_and_index(spark):
    """Six components are three parts, the last alone in its byte; packing loses nothing."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 6))
    books = ann.fit(x, ann.eta(x))
    codes = ann.encode(x, books, ann.eta(x))
    rough = np.stack(list(ann.scan(x[:5], ann.packed(codes), books)))
    decoded = books[np.arange(3)[None], codes].reshape(300, 6)
    assert np.allclose(rough, x[:5] @ decoded.T, atol=1e-4)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got = ann.search(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>"),
        spark.createDataFrame(rows[::20], "vec_id long, embedding array<double>"), top=5, block=64
    ).collect()
    want = {(q, int(v)) for q in range(0, 300, 20) for v in np.argsort(-(x @ x[q]) + 1e9 * (np.arange(300) == q))[:5]}
    assert len(got) == 75 and len(want & {(r.query_id, r.vec_id) for r in got}) >= 74


def test_many_links(spark):
    """A third of the vectors are near to each other: counts and components without all pairs, ties and copies too."""
    rng = np.random.default_rng(6)
    centre = rng.normal(size=32)
    x = [centre + rng.normal(size=32) * 0.15 for _ in range(300)] + [centre] * 50 + list(rng.normal(size=(500, 32)))
    rows = [(k, v.tolist(), "a") for k, v in enumerate(x)]
    got = {
        r.vec_id: r for r in embedding_dedup.near_vectors(
            spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), shard=128
        ).collect()
    }
    u = np.stack(x) / np.linalg.norm(np.stack(x), axis=1, keepdims=True)
    near = u @ u.T >= 0.93
    assert near[:350, :350].mean() > 0.5 and {k: r.n_links for k, r in got.items()} == dict(enumerate((near.sum(1) - 1).tolist()))
    different = near[:, [*range(301), *range(350, 850)]].sum(1) - 1  # the copies of one vector are one text
    audited = {k: r for k, r in got.items() if r.audit_links}
    assert len(audited) > 20 and all(r.audit_links == different[k] and r.audit_missed == 0 and r.beam > 0 for k, r in audited.items())
    want = smallest_reachable(range(len(x)), [(a, b) for a, b in np.argwhere(near).tolist() if a < b])
    assert {k: r.component_id for k, r in got.items()} == want


def test_near_vectors(spark):
    rows, df = vectors(spark)
    got = embedding_dedup.near_vectors(df, shard=60, beam=4).collect()
    live = [(k, np.array(e) / np.linalg.norm(e), label) for k, e, label, _ in rows if label is not None]
    links = [(a, b) for a, x, l in live for b, y, m in live if b < a and l == m and float(x @ y) >= 0.93]
    n = {k: 0 for k, _, _, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    want = smallest_reachable(n, links)
    assert len(got) == df.count()
    for r in got:
        if r.vec_id in n:
            assert (r.n_links, r.component_id, r.kept) == (n[r.vec_id], want[r.vec_id], want[r.vec_id] == r.vec_id)
        else:
            assert r.n_links == 0 and r.component_id == r.vec_id and r.kept
            assert (r.beam, r.audit_links, r.audit_missed) == (int(r.vec_id == 9020), 0, 0)  # alone of its length, it queries its own shard
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0
