"""Best-fit packing with certified bounds.

Pieces are dealt by hash to groups of bounded size. Each group packs its pieces best-fit decreasing and certifies its
number of sequences with a lower bound from dual-feasible functions. Groups whose count is above their bound give up
their emptier sequences, the others the emptiest one, and what was given up is dealt to new groups, whole sequences at
a time, and packed again; a group keeps what came in if that was no worse. Rounds end when nothing is left to
exchange, or after ``rounds``. Only (id, piece, length) rows are shuffled, never texts.

Defined results: a null or empty text is one piece that holds only the end id; a text of just the capacity is one full
piece; longer texts are cut, the last piece may be short; repeated rows are packed once each; pieces of equal length go
by hash; an empty table packs into nothing; other columns of ``pack`` stay, but for those named like the results.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MARKS, Memo, byte_slices, free_names, map_batches, read_table, saved, ship, without, word_ids

#: Pieces that one group packs, about.
GROUP = 16_384
#: Rounds of exchange.
ROUNDS = 3
#: Bytes of text that are encoded at once, and words that are remembered.
SLICE_BYTES, MEMO = 1_000_000, 60_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: How a tokenizer must split texts for its words to be encoded one by one: no token goes past white space, letters are
#: apart from other characters. Fixed values, as in the file.
BY_WORDS = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed",
                "invert": True
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def byte_characters() -> dict[int, int]:
    """The character by which byte-level tokenizers write each byte: itself where it can be printed, else one after 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in plain)}


class WordEncoder:
    """Ids of texts: of each word once, then from memory. Words are runs without ASCII white space; words of Latin letters,
    less one mark behind, go straight to the tokenizer's model, other words through all of the tokenizer. Tokenizers
    that split texts in another way encode whole texts. A task has one core, so one thread: each of the library's takes memory."""

    def __init__(self, path: str, memo: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        settings = json.loads(self.tokenizer.to_str())
        self.by_words = all(settings[k] == v for k, v in BY_WORDS.items())
        self.model, self.characters = self.tokenizer.model, byte_characters()
        self.memo = Memo(self._encode, memo)
        self.marks = np.array([0, *(int(np.frombuffer(x, "<u4")[0]) for x in self._one_by_one(list(MARKS)))], "<u4")

    def _one_by_one(self, words: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _encode(self, words: list[str]) -> list[bytes]:
        out, rest = [b""] * len(words), []
        for k, w in enumerate(words):
            low = w if w.isascii() else w.lower()  # words come with ASCII letters in lower case
            # Letters below this one are whole characters in each normal form, and the same letters to every Unicode version.
            if low.isalpha() and len(low) == len(w) and max(low) < "\u0250":
                written = low if low.isascii() else low.encode().decode("latin-1").translate(self.characters)
                out[k] = array("I", [t.id for t in self.model.tokenize(written)]).tobytes()
            else:
                rest.append(k)
        for k, x in zip(rest, self._one_by_one([words[k] for k in rest])):
            out[k] = x
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each one's begin (and the last one's end)."""
        texts = pc.fill_null(texts, "")
        if not self.by_words:
            raw = self._one_by_one(texts.to_pylist())
            return np.frombuffer(b"".join(raw), "<u4"), np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int64)
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))

        def ids_of(words):
            known = self.memo.fill(words)
            return [known[w] for w in words]

        ids, ends, _ = word_ids(split.flatten().dictionary_encode(), self.marks, ids_of)
        return ids, ends[np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(split)))])]


@lru_cache(maxsize=2)
def encoder(path: str, memo: int) -> WordEncoder:
    return WordEncoder(path, memo)


PIECES = T.StructType(
    [
        T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType())
    ]
)


def tokenize_pieces(
    docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None,
    memo: int = MEMO, with_ids: bool = False
) -> DataFrame:
    """A row per piece: ``key``, piece, start, length, ids_crc32, and ``ids`` (array<int>) if asked for."""
    path = tokenizer or default_tokenizer()
    schema = T.StructType([docs.schema[key], *PIECES.fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])
    end = np.asarray([end_id], "<u4")

    def cut(batch):
        rows, piece, start, length, crc, ids = [], [], [], [], [], []
        for low, high in byte_slices(batch.column(1), SLICE_BYTES):
            every, bounds = encoder(path, memo).encode(batch.column(1).slice(low, high - low))
            for row, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()), low):
                own = np.concatenate([every[a:b], end])
                for k, at in enumerate(range(0, len(own), capacity)):
                    part = own[at : at + capacity]
                    rows.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part.view("<i4"))
        keys = batch.column(0).take(pa.array(rows, pa.int64()))
        return [
            keys, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
            *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])
        ]

    def forget():
        # The words alone: a tokenizer that is dropped does not give its memory back, so each task's new one would add to it.
        if encoder.cache_info().currsize:
            encoder(path, memo).memo.clear()

    return map_batches(docs.select(key, text), cut, schema, forget)


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each item: longest items first, each into the fullest bin that has room."""
    bins, room_of, free = [0] * len(lengths), [], {}
    rooms: list[int] = []  # the different amounts of room, in order
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[k]
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = free[room].pop()
            if not free[room]:
                del free[room], rooms[at]
        else:
            b, room = len(room_of), capacity
            room_of.append(capacity)
        bins[k] = b
        if left := room - n:
            if left in free:
                free[left].append(b)
            else:
                free[left] = [b]
                insort(rooms, left)
    return bins


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Of the number of bins: the largest value of three families of dual-feasible functions (Fekete and Schepers)."""
    x = np.asarray(lengths, np.int64)
    if not len(x):
        return 0
    sizes, counts = np.unique(x, return_counts=True)
    best = -(-int((sizes * counts).sum()) // capacity)
    # U(e): items over C - e count as whole bins, items under e as nothing.
    for e in np.unique(np.concatenate([sizes[sizes * 2 <= capacity], capacity - sizes[sizes * 2 > capacity]])):
        total = np.where(sizes > capacity - e, capacity, np.where(sizes >= e, sizes, 0))
        best = max(best, -(-int((total * counts).sum()) // capacity))
    # u(k): x (k + 1) / C rounded down, over k, unless x (k + 1) / C is whole.
    for k in range(1, 21):
        whole = sizes * (k + 1) % capacity == 0
        scaled = np.where(whole, sizes * k, sizes * (k + 1) // capacity * capacity)
        best = max(best, -(-int((scaled * counts).sum()) // (k * capacity)))
    # phi(e): items over C / 2 as the bin without what fits beside them in units of e.
    for e in sizes[sizes * 2 <= capacity][:: max(1, int((sizes * 2 <= capacity).sum()) // 64)]:
        whole = capacity // e
        f = np.where(2 * sizes > capacity, 2 * (whole - (capacity - sizes) // e), np.where(2 * sizes == capacity, whole, 2 * (sizes // e)))
        best = max(best, -(-int((f * counts).sum()) // (2 * whole)))
    return best


def pack(
    items: DataFrame, key: list[str], length: str = "length", capacity: int = 2048, group: int = GROUP, rounds: int = ROUNDS
) -> DataFrame:
    """``items`` with ``sequence_id``, ``offset``, ``group_bins`` and ``group_bound``, all long: of the group that packed the
    item last, how many sequences it made and how many it needed at least. They replace columns of their names.

    ``key`` names the columns by whose hash items are dealt; rows may repeat in it or be null.
    """
    ship(items.sparkSession)
    results = ("sequence_id", "offset", "group_bins", "group_bound")
    items = items.select(*without(items, *results))
    (number_of,) = free_names(items.columns, "_item")
    # Written with the table, the numbers are those of one run; keys may be null or repeated.
    rows = saved(items.withColumn(number_of, F.monotonically_increasing_id()), "items")
    full = rows.where(F.col(length) >= capacity)
    rest = rows.where(F.col(length) < capacity).select(
        F.xxhash64(*key).alias("h"), F.col(number_of).alias("item"), F.col(length).cast("long").alias("n")
    )
    out_schema = "item long, n long, bin long, place long, bins long, bound long, opened boolean"

    def job(number: int):
        def repack(pdf: pd.DataFrame) -> pd.DataFrame:
            g = int(pdf["g"].iloc[0])
            pdf = pdf.sort_values(["n", "h"], ascending=False, kind="stable").reset_index(drop=True)
            n = pdf["n"].to_numpy()
            bins = np.asarray(best_fit_decreasing(n.tolist(), capacity), np.int64)
            if number and pdf["bin"].nunique() <= bins.max() + 1:
                bins = np.unique(pdf["bin"].to_numpy(), return_inverse=True)[1].astype(np.int64)
            fill = np.bincount(bins, weights=n).astype(np.int64)
            count, bound = len(fill), lower_bound(n, capacity)
            # With a gap: as many of the emptiest bins as might close it, and some that can mix with them.
            give = 1 if count <= bound else min(count, 8 * (count - bound) + count // 4)
            opened = np.zeros(count, bool)
            opened[np.argsort(fill, kind="stable")[:give]] = True
            opened &= fill < capacity
            order = np.argsort(bins, kind="stable")
            ends = np.cumsum(n[order])
            first = np.concatenate([[0], np.cumsum(fill)])[bins[order]]
            place = np.empty(len(n), np.int64)
            place[order] = ends - n[order] - first
            return pdf[["item"]].assign(
                n=n, bin=(number << 58) | (g << 18) | bins, place=place, bins=count, bound=bound, opened=opened[bins]
            )

        return repack

    todo, done, before = rest, None, None
    for number in range(rounds + 1):
        count = todo.count() if number == 0 else before
        groups = max(1, -(-count // group))
        by = F.xxhash64("h", "item") if number == 0 else F.xxhash64("bin")
        dealt = todo if number == 0 else todo.select("item", "n", "bin", F.xxhash64("item").alias("h"))
        packed = saved(
            dealt.withColumn("g", F.pmod(by, F.lit(groups))).groupBy("g").applyInPandas(job(number), out_schema), f"packed{number}"
        )
        todo = packed.where("opened")
        before = todo.count() if number < rounds else 0
        last = before == 0 or (groups == 1 and number > 0)
        part = packed if last else packed.where("not opened")
        done = part if done is None else done.unionByName(part)
        if last:
            break
    placed = done.select(F.col("item").alias(number_of), *[F.col(x).alias(y) for x, y in zip(("bin", "place", "bins", "bound"), results)])
    some = rows.where(F.col(length) < capacity).join(placed, number_of)
    # A full piece is a sequence of its own; its number is negative, those of bins are not.
    one = F.lit(1).cast("long")
    alone = full.withColumns(dict(zip(results, (-F.monotonically_increasing_id() - 1, F.lit(0).cast("long"), one, one))))
    return alone.unionByName(some).drop(number_of)


def pack_documents(docs: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, group_bins, group_bound."""
    return pack(tokenize_pieces(docs), ["doc_id", "piece"])


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset, group_bins, group_bound."""
    return pack_documents(read_table(spark, sf_dir, "documents"))


QUERIES = {"op5_best_fit_packing": op5_best_fit_packing}
ORACLES: dict[str, str] = {}
