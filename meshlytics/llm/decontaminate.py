"""Benchmark passages in documents, by an FM-index of each shard of the corpus.

Documents are dealt to shards of about ``SHARD`` words as they are read; no text is shuffled. A shard's words are numbered
and its suffixes sorted (three words at once, then by doubling, only where suffixes still agree; a document's end
differs from every other); the words before the sorted suffixes are kept as a wavelet matrix, with each ``EVERY``-th
suffix's place. That index is a row of a table, which can be searched for other phrases later.

Phrases are windows of ``window`` consecutive words of each item, or a shorter item whole. They are searched from their
last word to their first, all of a block at once: each step narrows a range of sorted suffixes by two ranks. The places
of what is found come from walking back to a sampled suffix. Words inside any occurrence are hit, and runs of them are the
spans to remove. Phrases are dealt to blocks of about ``PHRASES``, which bounds what the driver and a task hold of them,
however large the benchmark is; results of the blocks are merged by document.

Defined results: words are runs of ASCII letters, digits and other characters than ASCII, A-Z in lower case; null and
empty texts have none and are not hit; a document of any length is in one shard; repeated rows are documents of their
own; items that share an id are one item by name; items without words are no phrases; the words of an item whose id is
null are hit, but it is neither counted nor listed; an empty table of documents gives no rows, an empty benchmark no
hits; other columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_words, byte_slices, gathered, map_batches, read_table, release, saved, ship, with_columns

#: Words of a shard, about; one longer document is a shard of its own.
SHARD = 1_000_000
#: Of so many places in a document one is sampled, its first word always.
EVERY = 8
#: Phrases of a block, about.
PHRASES = 100_000
#: Bytes of texts that are cut into words at once.
SLICE_BYTES = 4_000_000
WINDOW = 10


def sorted_suffixes(symbols: np.ndarray) -> np.ndarray:
    """The places of ``symbols`` in the order of the suffixes that begin there. The last symbol occurs once, so no two suffixes
    agree up to their end."""
    n = len(symbols)
    wide = max(1, int(symbols.max()).bit_length())
    step = max(1, 63 // wide)
    padded = np.concatenate([symbols, np.zeros(step, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(step):
        key = key << wide | padded[j : j + n]
    order = np.argsort(key)
    rank, at = np.empty(n, np.int64), np.arange(n)
    rank[order] = _group_starts(key[order], at)
    slots = _shared(rank[order], at)  # places of the order that are not settled
    while len(slots):
        own = order[slots]
        key = rank[own] << 32 | rank[own + step]  # suffixes that agree so far are longer than that
        by = np.argsort(key)
        own, key = own[by], key[by]
        order[slots] = own
        rank[own] = _group_starts(key, slots)
        slots = slots[_shared(rank[own], np.arange(len(own)))]
        step *= 2
    return order


def _group_starts(keys: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Of each of the sorted ``keys`` the slot of the first one equal to it."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return slots[np.flatnonzero(new)][np.cumsum(new) - 1]


def _shared(ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
    same = ranks[1:] == ranks[:-1]
    both = np.zeros(len(ranks), bool)
    both[1:] = same
    both[:-1] |= same
    return at[both]


class Bits:
    """Rows of bits with rank: how many ones stand before a place."""

    def __init__(self, words: np.ndarray):
        self.words = words  # levels x 64-bit words, one more than the bits need
        ones = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int32)
        self.before = np.zeros(words.shape, np.int32)
        self.before[:, 1:] = ones[:, :-1]

    def rank(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level, word] + np.bitwise_count(self.words[level, word] & mask).astype(np.int64)

    def get(self, level: int, at: np.ndarray) -> np.ndarray:
        return (self.words[level, at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


def packed(bits: np.ndarray) -> np.ndarray:
    out = np.zeros((len(bits) >> 6) + 1, np.uint64)
    raw = np.packbits(bits, bitorder="little")
    out.view(np.uint8)[: len(raw)] = raw
    return out


class Wavelet:
    """A wavelet matrix: of each symbol its bits from the highest on, zeros before ones on each level."""

    def __init__(self, words: np.ndarray, zeros: np.ndarray):
        self.bits, self.zeros, self.levels = Bits(words), zeros, len(zeros)

    @staticmethod
    def of(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        levels = max(1, int(symbols.max()).bit_length())
        rows, zeros = [], []
        for level in range(levels):
            bit = (symbols >> np.uint32(levels - 1 - level)) & np.uint32(1) > 0
            rows.append(packed(bit))
            zeros.append(len(bit) - int(np.count_nonzero(bit)))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        return np.stack(rows), np.array(zeros, np.int64)

    def ranks(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """How often each symbol occurs before each of the places."""
        at = np.concatenate([np.zeros(len(symbol), np.int64), *places])
        for level in range(self.levels):
            one = np.tile((symbol >> (self.levels - 1 - level)) & 1 > 0, len(places) + 1)
            ones = self.bits.rank(level, at)
            at = np.where(one, self.zeros[level] + ones, at - ones)
        first, *rest = np.split(at, len(places) + 1)
        return [x - first for x in rest]

    def read(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at places, and how often each occurs before."""
        symbol, low = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for level in range(self.levels):
            one = self.bits.get(level, at)
            ones, first = self.bits.rank(level, at), self.bits.rank(level, low)
            symbol = symbol << 1 | one
            at, low = np.where(one, self.zeros[level] + ones, at - ones), np.where(one, self.zeros[level] + first, low - first)
        return symbol, at - low


FIELDS = ["vocabulary", "counts", "wavelet", "zeros", "marks", "sampled", "starts"]


def build(words: np.ndarray, vocabulary: pa.Array, sizes: np.ndarray) -> dict:
    """The index of documents of ``sizes`` words, which are places in ``vocabulary``. Behind each document stands an end."""
    docs = len(sizes)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])  # of the documents in the text with ends
    text = np.zeros(starts[-1], np.int64)
    ends = starts[1:] - 1
    is_word = np.ones(len(text), bool)
    is_word[ends] = False
    text[is_word] = words + docs
    text[ends] = np.arange(docs)[::-1]  # each end is another symbol, the last the smallest
    order = sorted_suffixes(text)
    before = np.where(  # ends are 0; what stands before place 0 is one
        text[order - 1] >= docs, text[order - 1] - docs + 1, 0
    ).astype(np.uint32)
    rows, zeros = Wavelet.of(before)
    keep = np.zeros(len(text), bool)
    first = np.repeat(starts[:-1], sizes + 1)
    keep[(np.arange(len(text)) - first) % EVERY == 0] = True
    marked = keep[order]
    counts = np.concatenate(  # suffixes that begin with a smaller symbol
        [[docs], docs + np.cumsum(np.bincount(words, minlength=len(vocabulary)))]
    )
    values = [
        counts.astype("<u4"), rows.astype("<u8"), zeros.astype("<u4"), packed(marked).astype("<u8"), order[marked].astype("<u4"),
        starts.astype("<u4")
    ]
    return dict(zip(FIELDS, [vocabulary, *[x.tobytes() for x in values]]))


class Index:
    """A shard's index as it is searched."""

    def __init__(self, row: dict):
        get = lambda name, kind="<u4": np.frombuffer(row[name], kind)
        self.vocabulary, self.starts, self.counts, zeros = row["vocabulary"], get("starts").astype(np.int64), get("counts").astype(np.int64), get("zeros").astype(np.int64)
        self.wavelet = Wavelet(get("wavelet", "<u8").reshape(len(zeros), -1), zeros)
        self.marks, self.sampled = Bits(get("marks", "<u8").reshape(1, -1)), get("sampled").astype(np.int64)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges (low, high) of sorted suffixes that begin with each row of ``phrases``: symbols from 1 on, right-aligned
        behind zeros; -1 is a word that the shard has not."""
        n, width = phrases.shape
        low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.flatnonzero((phrases[:, -1] > 0) & ~(phrases < 0).any(1))
        c = phrases[live, -1]
        low[live], high[live] = self.counts[c - 1], self.counts[c]
        for j in range(width - 2, -1, -1):
            live = live[(high[live] > low[live])]
            going = live[phrases[live, j] > 0]
            if not len(going):
                continue
            c = phrases[going, j]
            a, b = self.wavelet.ranks(c, low[going], high[going])
            low[going], high[going] = self.counts[c - 1] + a, self.counts[c - 1] + b
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places of sorted suffixes, each walked back to a sampled one."""
        out, at, steps = np.empty(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            found = self.marks.get(0, at[todo])
            done = todo[found]
            out[done] = self.sampled[self.marks.rank(0, at[done])] + steps[done]
            todo = todo[~found]
            symbol, times = self.wavelet.read(at[todo])
            at[todo] = self.counts[symbol - 1] + times
            steps[todo] += 1
        return out


def index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard: int = SHARD) -> DataFrame:
    """The index table: a row per shard, with the keys and sizes of its documents."""
    kind = docs.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField("shard", T.LongType()), T.StructField("keys", T.ArrayType(kind)),
            T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("vocabulary", T.ArrayType(T.StringType())),
            *[T.StructField(x, T.BinaryType()) for x in FIELDS[1:]]
        ]
    )
    ship(docs.sparkSession)

    def make(batches):
        from pyspark import TaskContext

        base, number = TaskContext.get().partitionId() << 32, 0
        words, keys, sizes, total = [], [], [], 0

        def flush():
            nonlocal words, keys, sizes, total, number
            own, own_keys = np.concatenate(sizes), pa.concat_arrays(keys)
            if total:
                known = pa.chunked_array(words).dictionary_encode().combine_chunks()
                row = build(np.asarray(known.indices, np.int64), known.dictionary, own)
            else:
                row = dict.fromkeys(FIELDS, b"") | {"vocabulary": pa.array([], pa.string())}
            out = [
                pa.array([base + number], pa.int64()), one_list(own_keys), one_list(pa.array(own, pa.int64())), one_list(row["vocabulary"]),
                *[pa.array([row[x]], pa.binary()) for x in FIELDS[1:]]
            ]
            words, keys, sizes, total, number = [], [], [], 0, number + 1
            release()
            return pa.RecordBatch.from_arrays(out, schema.fieldNames())

        for batch in batches:
            for low, high in byte_slices(batch.column(1), SLICE_BYTES):
                part, places, _ = ascii_words(batch.column(1).slice(low, high - low))
                at = 0
                while at < high - low:  # up to the document with which the shard is full
                    stop = min(high - low, max(at + 1, int(np.searchsorted(places, places[at] + shard - total))))
                    words.append(part.slice(places[at], places[stop] - places[at]))
                    keys.append(batch.column(0).slice(low + at, stop - at))
                    sizes.append(np.diff(places[at : stop + 1]))
                    total += int(places[stop] - places[at])
                    at = stop
                    if total >= shard:
                        yield flush()
        if keys:
            yield flush()

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(make, schema)


def one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def phrases(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``item`` and ``phrase`` (words with spaces between) of all windows of all items, and ``place``, their number in the item."""
    kind = items.schema[key].dataType
    schema = T.StructType([T.StructField("item", kind), T.StructField("phrase", T.StringType()), T.StructField("place", T.LongType())])

    def make(batch):
        words, before, _ = ascii_words(batch.column(1))
        sizes = np.diff(before)
        width = np.minimum(sizes, window)
        number = np.where(sizes > 0, sizes - width + 1, 0)
        row = np.repeat(np.arange(len(sizes)), number)
        place = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
        starts, widths = before[:-1][row] + place, width[row]
        inside = gathered(np.arange(len(words)), starts, widths)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(widths)]), pa.int32()), words.take(pa.array(inside)))
        return [batch.column(0).take(pa.array(row)), pc.binary_join(lists, " "), pa.array(place, pa.int64())]

    return map_batches(items.select(F.col(key).alias("item"), F.col(text).alias("text")), make, schema)


def find_in(shards: DataFrame, block: pa.Table, window: int) -> DataFrame:
    """``shard``, ``place`` of documents with phrases of a block in them, their ``spans`` (words, end exclusive) and ``items``."""
    encoded = block.column("phrase").combine_chunks().dictionary_encode()
    known = encoded.dictionary
    holder = np.asarray(encoded.indices, np.int64)
    by = np.argsort(holder, kind="stable")
    owners = block.column("item").combine_chunks().take(pa.array(by))
    first = np.searchsorted(holder[by], np.arange(len(known) + 1))
    parts = pc.split_pattern(known, " ")
    terms = parts.flatten().dictionary_encode()
    sizes = np.diff(np.asarray(parts.offsets))
    table = np.zeros((len(known), window), np.int64)  # 1 + the term's number, right-aligned
    row = np.repeat(np.arange(len(known)), sizes)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    table[row, window - sizes[row] + inside] = np.asarray(terms.indices, np.int64) + 1
    spark_item = shards.sparkSession.createDataFrame(block.slice(0, 0)).schema["item"].dataType
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType(
        [
            T.StructField("shard", T.LongType()), T.StructField("place", T.LongType()), T.StructField("spans", T.ArrayType(span)),
            T.StructField("items", T.ArrayType(spark_item))
        ]
    )
    words = terms.dictionary

    def search(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {x: batch.column(batch.schema.get_field_index(x))[k] for x in FIELDS}
                if not len(row["vocabulary"].values):
                    continue
                own = Index({x: v.values if x == "vocabulary" else v.as_buffer() for x, v in row.items()})
                local = np.concatenate(  # -1: not in this shard
                    [[0], np.asarray(pc.fill_null(pc.index_in(words, own.vocabulary), -2), np.int64) + 1]
                )
                low, high = own.search(local[table])
                hit = np.flatnonzero(high > low)
                if not len(hit):
                    continue
                times = (high - low)[hit]
                which = np.repeat(hit, times)
                places = own.locate(gathered(np.arange(own.starts[-1]), low[hit], times))
                doc = np.searchsorted(own.starts, places, "right") - 1
                change = np.zeros(own.starts[-1] + 1, np.int64)
                np.add.at(change, places, 1)
                np.add.at(change, places + sizes[which], -1)
                covered = np.concatenate([[0], np.cumsum(change) > 0])
                starts, ends = np.flatnonzero(np.diff(covered) > 0), np.flatnonzero(np.diff(covered) < 0)
                of = np.searchsorted(own.starts, starts, "right") - 1
                docs = np.unique(of)
                spans = pa.StructArray.from_arrays([pa.array(starts - own.starts[of]), pa.array(ends - own.starts[of])], ["start", "end"])
                pair = np.unique(doc * len(known) + which)
                owner = gathered(np.arange(len(owners)), first[pair % len(known)], np.diff(first)[pair % len(known)])
                owner_doc = np.repeat(pair // len(known), np.diff(first)[pair % len(known)])
                lists = lambda values, at: pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(at, np.append(docs, docs[-1] + 1)), pa.int32()), values
                )
                shard = pa.array(np.full(len(docs), batch.column(batch.schema.get_field_index("shard"))[k].as_py()), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [shard, pa.array(docs, pa.int64()), lists(spans, of), lists(owners.take(pa.array(owner)), owner_doc)],
                    schema.fieldNames()
                )
            release()

    return shards.select("shard", *FIELDS, "keys").mapInArrow(search, schema)


def merged(spans):
    """Sorted spans, those that overlap or touch as one."""
    step = lambda done, x: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]),
        F.concat(
            F.slice(done, F.lit(1), F.size(done) - 1),
            F.array(
                F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"))
            )
        )
    ).otherwise(F.concat(done, F.array(x)))
    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:bigint,end:bigint>>"), step)


def contamination(
    shards: DataFrame, items: DataFrame, item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, block: int = PHRASES
) -> DataFrame:
    """A row per document of the index table ``shards``: ``key``, ``n_words``, ``spans`` (runs of hit words: start, end
    exclusive) and ``items`` (ids of items with a phrase in it, sorted, each once)."""
    table = saved(phrases(items, item_key, item_text, window), "phrases")
    number = max(1, -(-table.count() // block))
    own = F.pmod(F.xxhash64("phrase", "item", "place"), F.lit(number))
    found = None
    for k in range(number):
        part = find_in(shards, table.where(own == k).select("phrase", "item").distinct().toArrow(), window)
        found = part if found is None else found.unionByName(part)
    hits = found.groupBy("shard", "place").agg(
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_list("items"))))).alias("items")
    )
    if number > 1:
        hits = hits.withColumn("spans", merged(F.col("spans")))
    docs = shards.select("shard", F.posexplode(F.arrays_zip("keys", "sizes")).alias("place", "x")).select(
        "shard", F.col("place").cast("long").alias("place"), F.col("x.keys").alias("key"), F.col("x.sizes").alias("n_words")
    )
    out = docs.join(hits, ["shard", "place"], "left")
    empty = lambda c: F.coalesce(c, F.array().cast(hits.schema[c].dataType))
    return out.select("key", "n_words", empty("spans").alias("spans"), empty("items").alias("items"))


def remove(text: pa.Array, spans: pa.Array) -> pa.Array:
    """Each text without its ``spans`` of words: cut from a span's first word up to the end of its last."""
    _, before, places = ascii_words(text)
    out = []
    for k, (t, cut) in enumerate(zip(text.to_pylist(), spans.to_pylist())):
        if t is None or not cut:
            out.append(t)
            continue
        raw, parts, at = t.encode("utf-8", "surrogatepass"), [], 0
        for s in cut:
            first, last = places[before[k] + s["start"], 0], places[before[k] + s["end"] - 1, 1]
            parts.append(raw[at:first])
            at = last
        out.append(b"".join([*parts, raw[at:]]).decode("utf-8", "surrogatepass"))
    return pa.array(out, pa.string())


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the passages of ``items``. ``key`` is unique: it joins the spans to the texts."""
    found = contamination(saved(index(docs, key, text), "fm_index"), items).where(F.size("spans") > 0).select(
        F.col("key").alias("_key"), F.col("spans").alias("_spans")
    )
    joined = docs.join(found, docs[key].eqNullSafe(F.col("_key")), "left").drop("_key")
    return with_columns(joined, lambda t, s: [remove(t, s)], [docs.schema[text]], [text, "_spans"], drop=("_spans",)).select(*docs.columns)


def op12_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all of ``benchmark``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    shards = saved(index(read_table(spark, sf_dir, "documents")), "fm_index")
    rows = contamination(shards, read_table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return rows.select(
        F.col("key").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


QUERIES = {"op12_fm_decontamination": op12_fm_decontamination}

#: Windows as joined words; each width of a phrase is a join of its own.
ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, text FROM documents),
lists AS (SELECT d, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM docs),
words AS (SELECT d, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM lists),
items AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(greatest(len(w) - {WINDOW - 1}, least(len(w), 1)))) AS p FROM items),
phrases AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS size, array_to_string(w[p + 1:p + {WINDOW}], ' ') AS phrase FROM starts),
widths AS (SELECT DISTINCT size FROM phrases),
grams AS (SELECT d, p, size, array_to_string(w[p:p + size - 1], ' ') AS phrase FROM (SELECT d, w, unnest(range(1, len(w) + 1)) AS p FROM lists), widths WHERE p + size - 1 <= len(w)),
found AS (SELECT d, p, size, item_id FROM grams JOIN phrases USING (size, phrase)),
hits AS (SELECT d, count(DISTINCT q) AS n FROM (SELECT d, unnest(range(p, p + size)) AS q FROM found) GROUP BY d),
of AS (SELECT d, count(*) AS n, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT d, CAST(item_id AS VARCHAR) AS i FROM found WHERE item_id IS NOT NULL) GROUP BY d)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit, coalesce(of.n, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN lists USING (d) LEFT JOIN hits USING (d) LEFT JOIN of USING (d)
"""
ORACLES = {"op12_fm_decontamination": ORACLE}
