"""Operators 1 and 5 against the libraries themselves and against simple packing."""

import os
import subprocess
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meshlytics.llm import packing
from meshlytics.llm import sentencepiece_codec as codec

TEXTS = [
    "", " ", "  a  b ", "\n", "a\n b", "a \n\n  ", "日本 語▁x", "<s> </s> <unk> <0x0A>", "\t tab nb", "é é", "😀 emoji  ", "12 345",
    "don't it's", "a.b., x", "क़ख़ ab", "word " * 3000, "<|endoftext|> x"
]


@pytest.fixture(scope="module")
def peer():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=codec.default_model())


def test_ids_are_those_of_sentencepiece(spark, peer):
    rows = [(k, t, "old") for k, t in enumerate([*TEXTS, None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece_ids string").repartition(3)
    got = {r.doc_id: r for r in codec.encode(df).collect()}
    for k, t in enumerate(TEXTS):
        assert list(got[k].piece_ids) == peer.encode(t) and got[k].n_pieces == len(peer.encode(t))
        assert got[k].ids_crc32 == zlib.crc32(np.array(peer.encode(t), "<u4").tobytes()) and got[k].parity
    assert got[len(TEXTS)].piece_ids is None and got[len(TEXTS)].parity is None
    back = {r.doc_id: r.decoded for r in codec.decode(codec.encode(df)).collect()}
    assert all(back[k] == t.replace("▁", " ") for k, t in enumerate(TEXTS)) and back[len(TEXTS)] is None
    assert all(got[k].decoded_crc32 == zlib.crc32(back[k].encode()) for k in range(len(TEXTS))) and got[len(TEXTS)].decoded_crc32 is None


def ids_of(encoder, texts):
    """Of each text its ids, by an encoder that returns all in a row."""
    ids, bounds = encoder.encode(pa.array(texts, pa.string()))[:2]
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_any_text(peer, texts):
    texts = [t.replace("\x00", "") for t in texts]
    assert ids_of(codec.codec(codec.default_model(), True, 1000), texts) == peer.encode(texts)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab.,\n ▁é0", max_size=40))
def test_words_and_marks(peer, text):
    assert ids_of(codec.codec(codec.default_model(), True, 1000), [text]) == [peer.encode(text)]


def test_small_memo_gives_the_same(peer):
    assert ids_of(codec.Codec(codec.default_model(), False, 3), TEXTS) == peer.encode(TEXTS)


def test_whole_texts_are_checked(spark):
    rows = [(1, "some words, and more."), (1, "some words, and more."), (2, None), (3, "x " * 30000)]
    got = codec.encode(spark.createDataFrame(rows, "doc_id long, text string"), whole_every=1).collect()
    assert [
        (r.parity, r.whole_parity) for r in sorted(got, key=lambda r: r.doc_id)
    ] == [(True, True), (True, True), (None, None), (True, True)]
    assert {r.whole_parity for r in codec.encode(spark.createDataFrame(rows, "doc_id long, text string"), parity=False).collect()} == {None}


def test_every_text_is_checked_whole(spark):
    """No share of the texts: both libraries encode and decode each one, whatever its hash; nulls alone are left out."""
    rows = [(k, f"{t} text no. {k}, once" if k % 2 else t) for k, t in enumerate(TEXTS * 12)] + [(-1, None)]
    got = codec.encode(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.parity, r.whole_parity) for r in got if r.doc_id >= 0} == {(True, True)}
    assert [(r.parity, r.whole_parity) for r in got if r.doc_id < 0] == [(None, None)]
    got = codec.op1_sentencepiece(spark, "/root/testdata/sf0.001").where("piece_ids IS NOT NULL").collect()
    assert len(got) > 100 and all(r.parity and r.whole_parity for r in got)


def test_the_whole_text_decides_parity():
    """A peer that differs where words meet, or in decoding alone, is found out, in texts with plain and with odd spacing."""
    own = codec.Codec(codec.default_model(), True, 100)

    class Other:
        def __init__(self, peer):
            self.peer = peer

        def encode(self, texts, **options):
            return [x[:-1] if "differs here" in t else x for t, x in zip(texts, self.peer.encode(texts, **options))]

        def decode(self, ids, **options):
            return [x.replace("back", "BACK") for x in self.peer.decode(ids, **options)]

    texts = ["it differs here", "it differs", "differs  here", " it differs here", "it goes back", ""]
    own.peer = Other(own.peer)
    ids, bounds, agree = own.encode(pa.array(texts))
    assert agree.tolist() == [False, True, True, False, True, True]
    runs = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    assert own.decoded_alike(runs, own.decode_all(ids, bounds)) == [True, True, True, True, False, True]


@pytest.fixture(scope="module")
def trained(tmp_path_factory):
    """Small models of the sentencepiece library: both kinds, with and without normaliser, prefix, byte fallback, user pieces."""
    import duckdb
    from sentencepiece import SentencePieceTrainer

    texts = [
        x[0][:400] for x in duckdb.sql(
            "SELECT text FROM '/root/testdata/sf0.001/documents.parquet' WHERE text <> '' ORDER BY doc_id LIMIT 150"
        ).fetchall()
    ]
    out, folder = {}, tmp_path_factory.mktemp("models")
    forms = {
        "nfkc": {}, "identity": {"normalization_rule_name": "identity"},
        "folded": {"normalization_rule_name": "nfkc_cf", "byte_fallback": True, "vocab_size": 900},
        "plain": {"add_dummy_prefix": False, "remove_extra_whitespaces": False},
        "user": {"user_defined_symbols": ["<sep>", "the"], "unk_surface": "?"},
        "users": {"user_defined_symbols": ["a", "an", "nt", "ee", "日本", "\u2581the", "a long piece of text", "ñ"]},
    }
    for kind in ("unigram", "bpe"):
        for name, settings_ in forms.items():
            path = folder / f"{kind}_{name}"
            SentencePieceTrainer.train(
                sentence_iterator=iter(texts), model_prefix=str(path), model_type=kind, minloglevel=2,
                **{"vocab_size": 600, "hard_vocab_limit": False} | settings_
            )
            out[kind, name] = f"{path}.model"
    return texts, out


def test_trained_models(trained):
    from sentencepiece import SentencePieceProcessor

    odd = [
        "   ", "क़ख़", "ﬁne Ⅷ ½ ＡＢ", "x　y", "▁", "▁▁ x", "ÀÉ é", "\r\n x", "\r\n", "a <sep> the x<sep>y", "<0x41>", "aa###bb%%%", "é́ ½",
        "✗✗ ✗"
    ]
    for (kind, name), path in trained[1].items():
        peer, own = SentencePieceProcessor(model_file=path), codec.Codec(path, True, 100)
        texts = [*TEXTS, *odd, *(t[:300] for t in trained[0])]
        want = peer.encode(texts)
        got, agree = ids_of(own, texts), own.encode(pa.array(texts))[2].tolist()
        assert agree == [a == b for a, b in zip(got, want)]
        assert got == want, (kind, name)
        assert own.decode(want) == [peer.decode(x) for x in want], (kind, name)
        size = own.tokenizer.get_vocab_size()
        runs = [*want, *(np.random.default_rng(k).integers(0, len(own.model["pieces"]), 12).tolist() for k in range(50) if size)]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in runs])]).astype(np.int64)
        assert own.decode_all(
            np.array([i for x in runs for i in x], np.uint32), bounds
        ) == [own._decode(x).encode() for x in runs], (kind, name)


def test_suffix_marker_is_refused(tmp_path):
    from sentencepiece import SentencePieceTrainer

    SentencePieceTrainer.train(
        sentence_iterator=iter(["some words here", "more words there"]), model_prefix=str(tmp_path / "m"), vocab_size=30,
        hard_vocab_limit=False, treat_whitespace_as_suffix=True, minloglevel=2
    )
    with pytest.raises(ValueError):
        codec.parse_model(str(tmp_path / "m.model"))


def test_bytes_that_are_no_text(peer):
    own = codec.codec(codec.default_model(), False, 1000)
    byte = {v: k for k, v in own.bytes.items()}
    for raw in (b"\xe3\x81", b"\xff\xfea", b"\xe3\x81\x82\x80", b"\xf0\x9f\x98"):
        ids = [byte[b] for b in raw]
        assert own.decode([ids, [5, *ids, 5]]) == [peer.decode(ids), peer.decode([5, *ids, 5])]


def test_empty_table(spark):
    assert codec.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_word_encoder(text):
    e = packing.encoder(packing.default_tokenizer(), 1000)
    assert e.by_words and ids_of(e, [text]) == [e.tokenizer.encode(text, add_special_tokens=False).ids]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abÉßİﬁſ.,'s \n\x1c%0²̈", max_size=40))
def test_words_of_odd_letters(text):
    e = packing.encoder(packing.default_tokenizer(), 1000)
    assert ids_of(e, [text, text]) == [e.tokenizer.encode(text, add_special_tokens=False).ids] * 2


def test_other_tokenizers_take_whole_texts():
    import public_tokenizers

    e = packing.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"), 100)
    assert not e.by_words and ids_of(e, TEXTS) == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_a_task_leaves_one_tokenizer_and_no_words(spark, monkeypatch):
    """Workers live on: each task's words go, and no task adds a tokenizer to those before."""
    got, seen = [], []
    monkeypatch.setattr(packing, "map_batches", lambda df, fn, schema, forget: got.append((fn, forget)) or df)
    packing.tokenize_pieces(spark.createDataFrame([], "doc_id long, text string"), memo=77)
    ((cut, forget),) = got
    packing.encoder.cache_clear()
    forget()
    assert not packing.encoder.cache_info().currsize  # a task without rows loads nothing
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words", "naïve 12 words."])], ["doc_id", "text"])
    want = [x.to_pylist() for x in cut(batch)]
    for _ in range(3):
        assert [x.to_pylist() for x in cut(batch)] == want
        seen.append(packing.encoder(packing.default_tokenizer(), 77))
        assert seen[-1].memo.young
        forget()
        assert not seen[-1].memo.young and not seen[-1].memo.old
    assert all(x is seen[0] for x in seen)


def test_encoding_starts_no_threads():
    """A worker's task has one core; the library's threads, one for each core of the machine, held memory of their own."""
    code = """
import os
import pyarrow as pa
from meshlytics.llm import packing
before = len(os.listdir("/proc/self/task"))
e = packing.WordEncoder(packing.default_tokenizer(), 1000)
e.encode(pa.array([f"{k}-{k} \u65e5{k}" for k in range(3000)]))
print(len(os.listdir("/proc/self/task")) - before)
"""
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"} | {"PYTHONPATH": str(Path(__file__).parents[2])}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=60)
    assert done.stdout == "0\n", done.stderr


def test_packing_is_exact_and_gapless(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    texts = [*TEXTS, None, "the cat sat. " * 900, "w " * 2047, "w " * 2048, "dup", "dup"]
    rows = [(min(k, len(texts) - 2), x, "extra") for k, x in enumerate(texts)]  # the last two share id and text
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, piece string")).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for k, x in enumerate(texts[:-2]):
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")
        pieces = sorted(by_doc[k], key=lambda r: r.piece)
        assert [p.start for p in pieces] == list(range(0, len(ids), 2048)) and sum(p.length for p in pieces) == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in pieces)
    assert len(by_doc[len(texts) - 2]) == 2
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(by_seq) <= -(-total // 2048) + 1


def test_best_fit_and_bounds():
    lengths = [1500, 900, 700, 600, 548, 448, 400]
    bins = packing.best_fit_decreasing(lengths, 2048)
    assert max(bins) + 1 == packing.lower_bound(np.array(lengths), 2048) == 3
    assert packing.lower_bound(np.array([1100] * 5), 2048) == 5  # no two fit together; the sum alone says 3
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = rng.integers(1, 2048, rng.integers(1, 12))
        assert packing.lower_bound(x, 2048) <= max(packing.best_fit_decreasing(x.tolist(), 2048)) + 1


def test_groups_exchange(spark):
    """With tiny groups each leaves a gap; exchange comes near one global packing."""
    rng = np.random.default_rng(2)
    lengths = rng.integers(50, 1500, 600).tolist()
    items = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "id long, length long")
    packed = packing.pack(items, ["id"], group=40)
    sums = [r.s for r in packed.groupBy("sequence_id").agg(F.sum("length").alias("s")).collect()]
    alone = packing.pack(items, ["id"], group=40, rounds=0).select("sequence_id").distinct().count()
    assert max(sums) <= 2048 and packed.count() == 600
    bounds = packed.groupBy("group_bins").agg(
        F.max(F.expr("group_bins - group_bound")).alias("gap"), F.min(F.expr("group_bins - group_bound")).alias("least")
    ).collect()
    assert all(0 <= r.least <= r.gap <= r.group_bins for r in bounds)
    assert len(sums) <= alone and len(sums) <= max(packing.best_fit_decreasing(lengths, 2048)) + 1 + 0.03 * len(sums)


def test_packing_keeps_clashing_columns(spark):
    items = spark.createDataFrame(
        [(k % 3, 700, f"x{k}", "old", k) for k in range(9)] + [(None, 2048, "full", "old", 9)],
        "id long, length long, _item string, Sequence_ID string, n long"
    )
    got = packing.pack(items, ["id"]).collect()
    assert sorted(r._item for r in got) == sorted(["full", *(f"x{k}" for k in range(9))]) and sorted(r.n for r in got) == list(range(10))
    assert all(isinstance(r.sequence_id, int) for r in got) and len({r.sequence_id for r in got}) == 6
