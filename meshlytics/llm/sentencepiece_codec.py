"""SentencePiece encoding and decoding with the Tokenizers library as the backend.

The model file (a protobuf) is read field by field and rebuilt: its character map as the normaliser, the metaspace
marker and dummy prefix, unigram scores or BPE merges in score order, and byte fallback. Texts are encoded in batches
on all threads of a task. Where no piece of a model goes on past a marker that follows other text, or from a letter to
a full stop or comma (checked on the model), a text's pieces are those of its words and marks; each new word is encoded
once and remembered. Where parity is asked for, the sentencepiece library encodes every text whole and decodes its ids, and both
results are compared.

The sentencepiece library adds unigram scores in single precision, this backend in double. Where parity is asked for
and a tie is broken otherwise for that reason, the path is searched again in single precision.

Defined results: a null text has null ids; an empty text has an empty list; a null among ids to decode gives null.
Rows, repeated ones too, keep their other columns; columns named like the results are replaced. Very long texts are
ordinary; an empty table gives no rows. Models with word, character or unused pieces, or with the marker behind words,
are refused.
"""

from __future__ import annotations

import codecs
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import MARKS, Memo, byte_slices, gathered, read_table, with_columns, word_ids

MARK = "▁"
#: Piece types of the public sentencepiece_model.proto. Fixed values.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: What the library of version 0.2.3 counts for each byte of a user piece, as measured. Fixed value.
USER_SCORE = 0.1
#: Model types of the same file. Fixed values.
UNIGRAM, BPE = 1, 2
#: Words that are remembered, and bytes of text that are encoded at once.
MEMO, SLICE_BYTES = 200_000, 2_000_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fields(data: bytes):
    """(number, value) of each field of a protobuf message; submessages and strings as bytes, floats as bytes of 4."""
    at, end = 0, len(data)

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


def parse_model(path: str) -> dict:
    """Pieces with scores and types, and the settings of the trainer and normaliser that encoding needs."""
    with open(path, "rb") as f:
        data = f.read()
    out = {
        "pieces": [], "model_type": UNIGRAM, "byte_fallback": False, "charsmap": b"", "add_dummy_prefix": True,
        "remove_extra_whitespaces": True, "escape_whitespaces": True, "unk_surface": " ⁇ "
    }
    for number, value in fields(data):
        if number == 1:
            piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(fields(value))
            out["pieces"].append((piece[1].decode(), float(np.frombuffer(piece[2], "<f4")[0]), piece[3]))
        elif number == 2:
            spec = dict(fields(value))
            out["model_type"] = spec.get(3, UNIGRAM)
            out["byte_fallback"] = bool(spec.get(35, 0))
            out["unk_surface"] = spec[44].decode() if 44 in spec else out["unk_surface"]
            if spec.get(24, 0):
                raise ValueError("models with the marker behind words are not rebuilt")
        elif number == 3:
            spec = dict(fields(value))
            out["charsmap"] = spec.get(2, b"")
            out |= {
                k: bool(spec.get(n, 1)) for n, k in ((3, "add_dummy_prefix"), (4, "remove_extra_whitespaces"), (5, "escape_whitespaces"))
            }
    if any(kind == UNUSED for _, _, kind in out["pieces"]):
        raise ValueError("models with unused pieces are not rebuilt")
    return out


def parse_charsmap(blob: bytes) -> dict[str, str]:
    """What the precompiled character map replaces: a trie as a double array, then the replacements, each ended by a null."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, texts = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64), blob[4 + size :]
    offset = (units >> 10) << ((units & (1 << 9)) >> 6)
    leaf, label = (units >> 8) & 1, units & ((1 << 31) | 255)
    nodes, keys, out = np.array([0]), [b""], {}
    letters = np.arange(1, 256)
    while len(nodes):
        below = (nodes ^ offset[nodes])[:, None] ^ letters[None]
        row, letter = ((below < len(units)) & (label[np.minimum(below, len(units) - 1)] == letters[None])).nonzero()
        keys = [keys[r] + bytes([c + 1]) for r, c in zip(row.tolist(), letter.tolist())]
        nodes = below[row, letter]
        for key, node in zip(keys, nodes.tolist()):
            if leaf[node]:
                at = int(units[node ^ offset[node]] & 0x7FFFFFFF)
                out[key.decode()] = texts[at : texts.index(b"\0", at)].decode()
    return out


class Normalizer:
    """A model's normal form of a text: characters replaced, the longest match first; user pieces are left as they are."""

    def __init__(self, model: dict):
        self.model = model
        self.table = parse_charsmap(model["charsmap"])
        self.user = sorted((p for p, _, kind in model["pieces"] if kind == USER_DEFINED), key=len, reverse=True)
        self.single = str.maketrans({k: v for k, v in self.table.items() if len(k) == 1})
        longer = [k for k in self.table if len(k) > 1]
        self.longest = max(map(len, longer), default=1)
        # Each longer key has a character that is in few texts; the line end has too many.
        self.hints = {next((c for c in k[1:] if c != "\n"), k[0]) for k in longer}
        self.space = MARK if model["escape_whitespaces"] else " "

    def _mapped(self, text: str) -> str:
        if not self.user and self.hints.isdisjoint(text):
            return text.translate(self.single)
        out, at = [], 0
        while at < len(text):
            if user := next((u for u in self.user if text.startswith(u.replace(MARK, " "), at) or text.startswith(u, at)), None):
                out.append(user)
                at += len(user)
                continue
            size = next((n for n in range(min(self.longest, len(text) - at), 0, -1) if text[at : at + n] in self.table), 0)
            out.append(self.table[text[at : at + size]] if size else text[at])
            at += size or 1
        return "".join(out)

    def __call__(self, text: str) -> str:
        if not text:
            return ""
        text, tidy = self._mapped(text), self.model["remove_extra_whitespaces"]
        if tidy:
            text = re.sub(" {2,}", " ", text.lstrip(" "))
            if not text:
                return ""
        if self.model["escape_whitespaces"]:
            text = text.replace(" ", MARK)
        text = (self.space if self.model["add_dummy_prefix"] else "") + text
        return text.rstrip(self.space) if tidy else text


def scored(model: dict) -> list[tuple[str, float]]:
    """The pieces' scores as a unigram model's search has them: a user piece's is the best ordinary one, but at least
    ``USER_SCORE``, for each of its bytes, less 0.1."""
    best = max((s for _, s, kind in model["pieces"] if kind == NORMAL and s > USER_SCORE), default=USER_SCORE)
    return [(p, len(p.encode()) * best - 0.1 if kind == USER_DEFINED else s) for p, s, kind in model["pieces"]]


def rebuild(model: dict):
    """A tokenizers.Tokenizer that encodes normal forms as the parsed model does, but for unigram models' byte fallback."""
    from tokenizers import AddedToken, Tokenizer, models

    pieces = model["pieces"]
    unknown = next((k for k, x in enumerate(pieces) if x[2] == UNKNOWN), None)
    if model["model_type"] == UNIGRAM:
        # Names that no normal form holds, so that only ordinary pieces are met in texts.
        least = min((s for _, s, kind in pieces if kind == NORMAL), default=0.0)  # others don't lower the unknown's score
        kernel = models.Unigram(
            [(p, s) if kind in (NORMAL, USER_DEFINED) else (f" \0{k}", least) for k, ((p, s), (_, _, kind)) in enumerate(zip(scored(model), pieces))],
            unk_id=unknown, byte_fallback=False
        )
    elif model["model_type"] == BPE:
        ids = {p: k for k, (p, _, _) in enumerate(pieces)}
        mergeable = {p for p, _, kind in pieces if kind in (NORMAL, USER_DEFINED)}
        merges = []
        for k, (p, score, kind) in enumerate(pieces):
            if kind == NORMAL:
                merges += [
                    (-score, k, ids[p[:i]], ids[p[i:]], p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in mergeable and p[i:] in mergeable
                ]
        merges.sort()
        kernel = models.BPE(
            ids, [x[4:] for x in merges], unk_token=pieces[unknown][0] if unknown is not None else None, fuse_unk=True,
            byte_fallback=model["byte_fallback"]
        )
    else:
        raise ValueError("only unigram and BPE models are rebuilt")
    t = Tokenizer(kernel)
    if model["model_type"] == BPE:  # user pieces are never merged or cut
        t.add_tokens([AddedToken(p, normalized=False) for p, _, kind in pieces if kind == USER_DEFINED])
    t.encode_special_tokens = True
    return t


class Codec:
    """Encodes and decodes for one task: the rebuilt tokenizer, the word rule and the words met so far."""

    def __init__(self, path: str, parity: bool, memo: int):
        self.model = parse_model(path)
        self.tokenizer, self.normal = rebuild(self.model), Normalizer(self.model)
        self.peer = None
        if parity:
            from sentencepiece import SentencePieceProcessor

            self.peer = SentencePieceProcessor(model_file=path)
        pieces = self.model["pieces"]
        self.unknown = next((k for k, x in enumerate(pieces) if x[2] == UNKNOWN), -1)
        self.bytes = {k: int(p[1:-1], 16) for k, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.of_byte = {v: k for k, v in self.bytes.items()} if self.model["byte_fallback"] else {}
        scores = [s for _, s, kind in pieces if kind == NORMAL] or [0.0]
        self.ordinary = {
            p: (k, s) for k, ((p, s), (_, _, kind)) in enumerate(zip(scored(self.model), pieces)) if kind in (NORMAL, USER_DEFINED)
        }
        # Where a user piece's score is the least, the backend would price unknown characters by it.
        self.user_ids = {self.ordinary[p][0] for p in self.normal.user}
        self.by_path = self.model["model_type"] == UNIGRAM and any(self.ordinary[p][1] < min(scores) for p in self.normal.user)
        # An unknown character costs ten more than the least score.
        self.unknown_score = float(np.float32(min(scores) - 10))
        surface = {CONTROL: lambda p: "", UNKNOWN: lambda p: self.model["unk_surface"]}
        self.surfaces = [surface.get(kind, lambda p: p.replace(MARK, " "))(p) for p, _, kind in pieces]
        # Of all pieces in a row their bytes, where each one's begin, how many there are, and whether it is another kind.
        raw = [bytes([self.bytes[k]]) if k in self.bytes else s.encode() for k, s in enumerate(self.surfaces)]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        special = np.array([kind in (CONTROL, UNKNOWN) for _, _, kind in pieces])
        self.places = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes, sizes, special
        identity = not self.model["charsmap"] and not self.model["remove_extra_whitespaces"] and self.model["escape_whitespaces"]
        split = not any(MARK in p.lstrip(MARK) or "\n" in p or re.search(f"[A-Za-z][{MARKS}]", p) for p in self.ordinary)
        self.chunked = identity and split and self.model["model_type"] == BPE and self.model["byte_fallback"] and self.model["add_dummy_prefix"]
        self.memo = Memo(self._encode_words, memo)
        marks = self._pieces_of(list(MARKS)) if self.chunked else []
        self.chunked &= all(len(x) == 1 for x in marks)
        self.marks = np.array([0, *(x[0] for x in marks)], "<u4")

    def _pieces_of(self, texts: list[str]) -> list[list[int]]:
        """Of normal forms, by the backend."""
        out = []
        for text, e in zip(texts, self.tokenizer.encode_batch(texts, add_special_tokens=False)):
            ids = e.ids
            if self.of_byte and self.unknown in ids:
                ids = [
                    i for k, span in zip(ids, e.offsets) for i in (
                        [k] if k != self.unknown else [self.of_byte[b] for b in text[slice(*span)].encode()]
                    )
                ]
            out.append(ids)
        return out

    def _best_path(self, text: str) -> list[int]:
        """The best path of a unigram model in single precision; of equal ones the first found."""
        longest = max(map(len, self.ordinary), default=1)
        best, back = [0.0] + [None] * len(text), [None] * (len(text) + 1)

        def reach(at: int, end: int, k: int, score: float) -> None:
            score = best[at] + score
            if k not in self.user_ids:  # user pieces are compared in double precision
                score = float(np.float32(score))
            if best[end] is None or score > best[end]:
                best[end], back[end] = float(np.float32(score)), (at, k)

        for at in range(len(text)):
            if best[at] is not None:
                ends = [end for end in range(at + 1, min(at + longest, len(text)) + 1) if text[at:end] in self.ordinary]
                for end in ends:
                    reach(at, end, *self.ordinary[text[at:end]])
                if at + 1 not in ends:
                    reach(at, at + 1, self.unknown, self.unknown_score)
        out, end = [], len(text)
        while end:
            at, k = back[end]
            if k != self.unknown:
                out.append(k)
            elif self.of_byte:
                out += [self.of_byte[b] for b in reversed(text[at:end].encode())]
            elif not out or out[-1] != k:
                out.append(k)
            end = at
        return out[::-1]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Of each word (a line end before it counts as its part, else the marker does) its ids as little-endian bytes. Many
        are encoded as one text, told apart by line ends."""
        plain = list({w.removeprefix("\n") if w[:1] == "\n" else MARK + w for w in words})
        line_end = self._pieces_of(["\n"])[0]
        joined = ["\n".join(plain[low : low + 256]) for low in range(0, len(plain), 256)]
        own = split_at(self._pieces_of(joined), line_end[0])
        if len(own) != len(plain) or len(line_end) != 1:
            raise ValueError("this model's line ends are no pieces of their own")
        known, first = dict(zip(plain, own)), array("I", line_end).tobytes()
        return [first + known[w[1:]] if w[:1] == "\n" else known[MARK + w] for w in words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts in a row, where each one's begin (and the last one's end), and whether the libraries agree on
        the whole text. A null counts as empty."""
        texts = pc.fill_null(texts, "")
        if not self.chunked:
            return self._whole(texts.to_pylist())
        # Words are what stands between single spaces; texts with other spacing, or with markers of their own, go whole.
        odd = pc.match_substring_regex(texts, f"\\A(?: |\\z)|  |{MARK}")
        split = pc.split_pattern(pc.replace_substring(pc.if_else(odd, "", texts), "\n", " \n"), " ")

        def ids_of(words):
            known = self.memo.fill(words)
            return [known[w] for w in words]

        ids, ends, _ = word_ids(split.flatten().dictionary_encode(), self.marks, ids_of)
        ends = ends[np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(split)))])]
        rows = np.flatnonzero(np.asarray(odd))
        if len(rows):
            parts = [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            for row, more in zip(rows.tolist(), self._pieces_of([self.normal(t) for t in texts.take(pa.array(rows)).to_pylist()])):
                parts[row] = np.array(more, "<u4")
            ids, ends = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        agree = np.ones(len(texts), bool)
        if self.peer is not None:
            theirs = self.peer.encode(texts.to_pylist(), return_type="numpy", num_threads=1)
            agree[:] = [np.array_equal(ids[a:b], x) for a, b, x in zip(ends[:-1].tolist(), ends[1:].tolist(), theirs)]
        return ids, ends, agree

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        normal = [self.normal(t) for t in texts]
        own, agree = [self._best_path(t) for t in normal] if self.by_path else self._pieces_of(normal), [True] * len(texts)
        if self.peer is not None:
            for k, theirs in enumerate(self.peer.encode(texts, num_threads=1)):
                if own[k] != theirs and self.model["model_type"] == UNIGRAM and (again := self._best_path(normal[k])) == theirs:
                    own[k] = again
                agree[k] = own[k] == theirs
        ids = np.fromiter((i for x in own for i in x), "<u4", sum(map(len, own)))
        return ids, np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64), np.array(agree, bool)

    def decode(self, ids: list[list[int] | None]) -> list[str | None]:
        return [None if x is None or None in x else self._decode(x) for x in ids]

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The texts (UTF-8) of runs of ``ids`` between ``bounds``. Surfaces are put together for all at once; texts with other
        pieces than ordinary ones and bytes, with bytes that are no UTF-8, or of models that tidy spaces go one by one."""
        places = self.places
        if self.model["remove_extra_whitespaces"] or not self.model["add_dummy_prefix"]:
            return [self._decode(ids[a:b].tolist()).encode("utf-8", "surrogatepass") for a, b in zip(bounds, bounds[1:])]
        sizes = places[2][ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])[bounds]
        odd = np.concatenate([[0], np.cumsum(places[3][ids])])[bounds]
        raw = gathered(places[0], places[1][ids], sizes).tobytes()
        out = []
        for k, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
            text = raw[a + (raw[a:b][:1] == b" ") : b]
            try:
                if odd[k + 1] > odd[k]:
                    raise UnicodeError
                text.decode()
            except UnicodeError:
                text = self._decode(ids[bounds[k] : bounds[k + 1]].tolist()).encode("utf-8", "surrogatepass")
            out.append(text)
        return out

    def _decode(self, ids: list[int]) -> str:
        """Control pieces have no text, bytes that are no UTF-8 become replacement characters, the prefix is taken away."""
        out, raw, start = [], bytearray(), True
        for k in [*ids, None]:
            if (byte := self.bytes.get(k)) is not None:
                raw.append(byte)
                continue
            if raw:
                out.append(decoded_bytes(bytes(raw)))
                raw.clear()
                start = False
            if k is None:
                break
            text = self.surfaces[k]
            if start and (
                self.model["add_dummy_prefix"] or self.model["remove_extra_whitespaces"]
            ) and k != self.unknown and text[:1] == " ":
                text = text[1:]
                start = self.model["remove_extra_whitespaces"] and not text
            else:
                start = start and not text
            out.append(text)
        return "".join(out)

    def decoded_alike(self, ids: list[np.ndarray], texts: list[bytes]) -> list[bool]:
        """Whether the other library decodes each one's ids to its text."""
        theirs = self.peer.decode([x.astype(np.int32) for x in ids], num_threads=1) if ids else []
        return [a.encode("utf-8", "surrogatepass") == b for a, b in zip(theirs, texts)]


def split_at(texts: list[list[int]], mark: int) -> list[bytes]:
    """The ids between marks, as little-endian bytes; a text's end is one more mark."""
    ids = np.fromiter((k for ids in texts for k in (*ids, mark)), "<u4", sum(map(len, texts)) + len(texts))
    raw, ends = ids.tobytes(), (4 * np.flatnonzero(ids == mark)).tolist()
    return [raw[a:b] for a, b in zip([0, *(x + 4 for x in ends[:-1])], ends)]


def decoded_bytes(raw: bytes) -> str:
    """UTF-8, but a replacement character for each byte that is not."""
    return raw.decode("utf-8", "one_by_one")


def _one_by_one(error: UnicodeError) -> tuple[str, int]:
    return "\ufffd", error.start + 1


codecs.register_error("one_by_one", _one_by_one)


@lru_cache(maxsize=2)
def codec(path: str, parity: bool, memo: int) -> Codec:
    return Codec(path, parity, memo)


def encode(
    df: DataFrame, text: str = "text", model: str | None = None, parity: bool = True, memo: int = MEMO, whole_every: int = 1,
    drop_text: bool = False
) -> DataFrame:
    """``df`` with ``piece_ids`` array<int>, ``n_pieces`` long, ``ids_crc32`` long (of the ids as little-endian unsigned
    32-bit numbers), ``parity`` (the ids are those that the sentencepiece library gives the whole text) and ``whole_parity``
    (and both libraries decode them alike), both of every text, null without check, and ``decoded_crc32`` long: of the text
    that every row's ids are decoded to, in UTF-8. With ``whole_every`` above 1 one text in so many is decoded by both, by hash."""
    path = model or default_model()
    new = [
        T.StructField("piece_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_pieces", T.LongType()),
        T.StructField("ids_crc32", T.LongType()), T.StructField("parity", T.BooleanType()), T.StructField("whole_parity", T.BooleanType()),
        T.StructField("decoded_crc32", T.LongType())
    ]

    def part(texts: pa.Array) -> list[pa.Array]:
        own = codec(path, parity, memo)
        ids, bounds, agree = own.encode(texts)
        null = np.asarray(pc.is_null(texts))
        lists = pa.ListArray.from_arrays(
            pa.array(bounds.astype(np.int32), mask=np.append(null, False)), pa.array(ids.astype(np.int32)),
            type=pa.list_(pa.field("element", pa.int32(), False))
        )
        raw = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        texts_back = own.decode_all(ids, bounds)
        asked = ~null & parity
        if whole_every > 1:
            asked &= [a and zlib.crc32(t.as_buffer()) % whole_every == 0 for a, t in zip(asked.tolist(), texts)]
        rows, whole = np.flatnonzero(asked), agree.copy()
        whole[rows] &= np.array(own.decoded_alike([raw[k] for k in rows], [texts_back[k] for k in rows]), bool)
        crc = np.array([zlib.crc32(x) for x in raw], np.int64)
        back = np.array([zlib.crc32(x) for x in texts_back], np.int64)
        return [
            lists, pa.array(np.diff(bounds), pa.int64(), mask=null), pa.array(crc, pa.int64(), mask=null),
            pa.array(agree, mask=null | (not parity)), pa.array(whole, mask=~asked), pa.array(back, pa.int64(), mask=null)
        ]

    def add(texts):
        parts = [part(texts.slice(low, high - low)) for low, high in byte_slices(texts, SLICE_BYTES)]
        return [pa.concat_arrays(x) for x in zip(*parts)] if parts else [
            pa.array([], t) for t in (pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64())
        ]

    return with_columns(df, add, new, [text], drop=(text,) if drop_text else ())


def decode(df: DataFrame, ids: str = "piece_ids", model: str | None = None, to: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids`` in the column ``to``; control pieces have no text; null ids give null."""
    path = model or default_model()
    return with_columns(
        df, lambda x: [pa.array(codec(path, False, MEMO).decode(x.to_pylist()), pa.string())], [T.StructField(to, T.StringType())], [ids]
    )


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, piece_ids, n_pieces, ids_crc32, parity, whole_parity, decoded_crc32."""
    return encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), drop_text=True)


QUERIES = {"op1_sentencepiece": op1_sentencepiece}
ORACLES: dict[str, str] = {}
