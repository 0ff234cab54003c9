"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give the base spans. Around digits and at-signs the text is cut into atoms (runs without white space, less
the marks around them); runs of neighbouring atoms are sequences for the model. Candidate segments are up to ``LONGEST``
atoms whose mere count of digits, groups or at-signs leaves a kind open; features of the whole span (digits, groups and
their lengths, separators, checksum, range, marks inside, a cue word before) score each, and a dynamic programme over
segment ends chooses boundaries and kinds together. Weights are trained by gradient ascent on the exact likelihood.

What is learnt from: at most ``SAMPLE`` sequences with base spans and as many without, those of least hash of all; the
same with base spans written otherwise (no plus sign, other separators, spaces about the at-sign), labelled alike; and
with base spans spoilt (a wrong digit, a number over 255, digits missing), labelled as none. Sequences of over
``LEARN_ATOMS`` atoms are only scanned. So the model finds numbers that touch, of which one match swallows both and fails
its check, and forms that the patterns don't know. Model spans that touch base spans are dropped.

Defined results: a null text counts as empty and has no spans; very long texts are one pass, and very long runs of
numbers and very many spans cost time in proportion to their length and number; segmentations of equal score go to the fewer entities; repeated rows get
the same spans; an empty table gives no rows; other columns stay, but for those named like the results; without any base
span to learn from, only base spans are returned.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, free_names, read_table, saved, with_columns, without

KINDS = ("email", "ip", "card", "phone")
#: Atoms in a segment at most.
LONGEST = 6
#: The most sequences with base spans that the model is fitted on, and without; and the most atoms of one.
SAMPLE, LEARN_ATOMS = 400, 64
#: Words that tell what a number behind them is, or is not. Fixed values.
CUES = frozenset(
    "call phone tel telephone fax mobile cell card visa credit account ip host server address mail email contact version release order invoice isbn date serial id".split()
)
#: Numbers that are no personal data. Fixed values.
OTHERS = [
    "2024-01-31 10:15:00", "31.12.2024 23:59", "1,234,567.89", "10:15:30.123456", "20240131101530", "version 3.10.200", "978-3-16-148410-0",
    "1 000 000 000", "12 34 56 78", "@name 2024", "order 100200300", "1999-2031", "3.14159265358979", "100 200 300 400", "0-306-40615-2",
    "1706696100", "10 20 30 40"
]
#: How often each of these counts as one more sequence.
OTHERS_WEIGHT = 20

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Its parts, so that long runs without a match cost no more than their length.
LOCAL, DOMAIN = frozenset(
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
), re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits does; looking behind keeps long runs cheap.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HINT = re.compile(r"[0-9@]")
ATOM = re.compile(r"[^\s]+")
GROUPS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def octet(digits: str) -> bool:
    """At most 255, however many zeros stand before."""
    rest = digits.lstrip("0")
    return len(rest) <= 3 and int(rest or 0) <= 255


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def lines_with_hints(text: str):
    """(start, line) of the lines that hold a digit or an at-sign; no pattern goes past a line's end."""
    at = 0
    while m := HINT.search(text, at):
        low = text.rfind("\n", 0, m.start()) + 1
        high = text.find("\n", m.start())
        high = len(text) if high < 0 else high
        yield low, text[low:high]
        at = high


def base_in_line(line: str, low: int) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' spans."""
    out = []
    done, sign = 0, line.find("@")
    while sign >= 0:
        start = sign
        while start > done and line[start - 1] in LOCAL:
            start -= 1
        if start < sign and (m := DOMAIN.match(line, sign + 1)):
            done = m.end()
            out.append((low + start, 0, low + done))
        sign = line.find("@", max(done, sign + 1))
    out += [(low + m.start(), 1, low + m.end()) for m in IP.finditer(line) if all(octet(p) for p in m.group().split("."))]
    for m in CARD.finditer(line):
        d = only_digits(m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((low + m.start(), 2, low + m.end()))
    if "+" in line:
        out += [(low + m.start(), 3, low + m.end()) for m in PHONE.finditer(line) if 10 <= len(only_digits(m.group())) <= 15]
    return out


def sequences(line: str, low: int) -> list[tuple[str, list]]:
    """Runs of neighbouring atoms with digits or at-signs, or beside a loose at-sign: the cue word before the run, and of each
    atom (start, end, text, whether marks stood before it or behind it)."""
    found = [(m.start(), m.end(), m.group()) for m in ATOM.finditer(line)]
    hint = [bool(HINT.search(x)) for _, _, x in found]
    for k, (_, _, x) in enumerate(found):
        if x[0] == "@" or x[-1] == "@":
            hint[max(k - 1, 0)] = hint[k] = hint[min(k + 1, len(found) - 1)] = True
    out, run, last = [], [], None
    for k, (start, end, x) in enumerate(found):
        if not hint[k]:
            continue
        a = start + len(x) - len(x.lstrip("\"'<[{" + "(" * (")" not in x)))
        b = max(a, end - len(x) + len(x.rstrip(".,;:!?\"'>]}" + ")" * ("(" not in x))))
        if not run or last != start - 1:
            run = []
            cue = found[k - 1][2].strip(".,;:!?()").lower() if k else ""
            out.append((cue if cue in CUES else "", run))
        run.append((low + a, low + b, line[a:b], a > start, b < end))
        last = end
    return out


def features(atoms: list, cue: str) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """The kinds that are open to a segment of atoms, and what holds of it."""
    span = " ".join(x[2] for x in atoms)
    groups = GROUPS.findall(span)
    n, ats = sum(map(len, groups)), span.count("@")
    letters = any(map(str.isalpha, span))
    kinds = [1] * (ats == 1 and len(atoms) <= 3)
    if not letters and not ats:
        kinds += [2] * (len(groups) == 4 and max(map(len, groups)) <= 3) + [3] * (12 <= n <= 19) + [4] * (7 <= n <= 15)
    if not kinds:
        return (), ()
    f = ["any", f"atoms {len(atoms)}", f"digits {min(n, 20)}", f"groups {min(len(groups), 7)}"]
    if ats:
        user, _, host = span.replace(" ", "").partition("@")
        f += ["user" if user and user[-1] in LOCAL else "no user", "host" if DOMAIN.fullmatch(host) else "no host"]
    else:
        f.append("lengths " + "-".join(str(len(g)) for g in groups) if len(groups) < 6 else "many groups")
        f += ["octets" if all(int(g) < 256 for g in groups) else "no octets"] * (2 in kinds)
        f += ["luhn" if luhn("".join(groups)) else "no luhn"] * (3 in kinds)
    f += [f"has {c}" for c in "+()-./:," if c in span]
    f += ["plus inside"] * ("+" in span[1:]) + ["mark inside"] * any(
        x[4] or y[3] for x, y in zip(atoms, atoms[1:])
    ) + [f"cue {cue}"] * bool(cue)
    return tuple(kinds), tuple(f)


LABELS = 1 + len(KINDS)  # 0 is none; such segments are one atom long and score nothing


def candidates(atoms: list, cue: str = "") -> list[list[tuple[int, int, tuple[str, ...]]]]:
    """For each end (1..n): (first atom, label, features)."""
    size = [sum("0" <= c <= "9" for c in x[2]) + 7 * x[2].count("@") for x in atoms]
    ends = []
    for e in range(1, len(atoms) + 1):
        here, total = [(e - 1, 0, ())], 0
        for s in range(e - 1, max(-1, e - 1 - LONGEST), -1):
            total += size[s]
            if 4 <= total <= 26:
                kinds, f = features(atoms[s:e], cue if s == 0 else "")
                here += [(s, k, f) for k in kinds]
        ends.append(here)
    return ends


def score(w: dict, label: int, f: tuple[str, ...]) -> float:
    return sum(w.get((label, x), 0.0) for x in f) if label else 0.0


def decode(atoms: list, w: dict, cue: str = "") -> list[tuple[int, int, int]]:
    """(first atom, end, label) of the best segmentation's entities; ties to the first candidate met, none before others."""
    best, back = [0.0], [None]
    for e, here in enumerate(candidates(atoms, cue), 1):
        top, s, label = max(((best[s] + score(w, label, f), s, label) for s, label, f in here), key=lambda x: x[0])
        best.append(top)
        back.append((s, e, label))
    out, e = [], len(atoms)
    while e:
        s, _, label = back[e]
        if label:
            out.append((s, e, label))
        e = s
    return out[::-1]


def likelihood(ends: list, gold: set, at) -> tuple[float, list[list[float]]]:
    """The log-likelihood of the segmentation with the entities ``gold``, and each candidate's share of what is expected,
    less what is true. ``at``: the candidates' scores."""
    n = len(ends)
    a, b = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    a[0] = b[n] = 0
    for e in range(n):
        a[e + 1] = np.logaddexp.reduce([a[s] + x for (s, _, _), x in zip(ends[e], at[e])])
    for e in range(n - 1, -1, -1):
        for (s, _, _), x in zip(ends[e], at[e]):
            b[s] = np.logaddexp(b[s], b[e + 1] + x)
    true, off = 0.0, []
    for e in range(n):
        row = []
        for (s, k, _), x in zip(ends[e], at[e]):
            own = k > 0 and (s, e + 1, k) in gold
            true += x * own
            row.append(np.exp(a[s] + x + b[e + 1] - a[n]) - own)
        off.append(row)
    return true - a[n], off


def train(data: list[tuple[list, str, set[tuple[int, int, int]]]], steps: int = 60, rate: float = 1.0, l2: float = 1e-3) -> dict:
    """Weights by gradient ascent on the mean log-likelihood, the step of each weight falling with the gradients it has had;
    data: atoms, cue and the entities among the atoms."""
    # Sequences of the same make-up are the same to the model and count as often as they occur.
    same: dict = {}
    for atoms, cue, gold in data:
        ends = candidates(atoms, cue)
        if any(len(here) > 1 for here in ends):
            key = (tuple(tuple(x) for x in ends), frozenset(gold))
            same[key] = same.get(key, 0) + 1
    names = sorted({(k, x) for ends, _ in same for here in ends for _, k, f in here for x in f})
    place = {x: i for i, x in enumerate(names)}
    w, seen, total = np.zeros(len(names)), np.full(len(names), 1e-8), max(sum(same.values()), 1)
    rows = [
        (
            ends, gold, times / total, [[np.array([place[k, x] for x in f], int) for _, k, f in here] for here in ends]
        ) for (ends, gold), times in same.items()
    ]
    for _ in range(steps):
        g = -l2 * w
        for ends, gold, share, at in rows:
            for row, here in zip(likelihood(ends, gold, [[w[i].sum() for i in here] for here in at])[1], at):
                for off, i in zip(row, here):
                    g[i] -= share * off
        seen += g * g
        w += rate * g / np.sqrt(seen)
    return {x: float(w[i]) for x, i in place.items()}


def variants(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """A piece of text with its entities (start, kind, end) written otherwise, and spoilt."""
    out = []

    def put(change, stays: bool) -> None:
        parts, found, at, size = [], [], 0, 0
        for s, k, e in spans:
            new = change(k, text[s:e])
            parts += [text[at:s], new]
            size += s - at
            found += [(size, k, size + len(new))] * stays
            size += len(new)
            at = e
        made = "".join(parts) + text[at:]
        if made != text:
            out.append((made, found))

    grouped = lambda x, by: by.join(GROUPS.findall(x))
    fours = lambda x, by: by.join(re.findall("[0-9]{1,4}", only_digits(x)))
    rest = lambda x: y if len(only_digits(y := x.partition(" ")[2])) >= 10 else x  # noqa: E731  without the country
    put(lambda k, x: x.replace("@", " @ ") if k == 0 else fours(x, ".") if k == 2 else x.removeprefix("+") if k == 3 else x, True)
    put(lambda k, x: fours(x, " ") if k == 2 else grouped(rest(x), "-") if k == 3 else x, True)
    put(lambda k, x: only_digits(x) if k == 2 else "+" + grouped(x, ".") if k == 3 else x, True)
    put(lambda k, x: rest(x) if k == 3 else x, True)
    spoilt = {
        0: lambda x: "@" + x.split("@")[1].split(".")[0], 1: lambda x: GROUPS.sub("9" + x[0] + "7", x, count=1),
        2: lambda x: x[:-1] + str((int(x[-1]) + 1) % 10), 3: lambda x: x[: len(x) - 5]
    }
    put(lambda k, x: spoilt[k](x), False)
    return out


def labelled(line: str, spans: list[tuple[int, int, int]]):
    """(atoms, cue, entities) of each sequence of a line, for learning."""
    kinds = {(s, e): k + 1 for s, k, e in spans}
    for cue, run in sequences(line, 0):
        starts, ends = {x[0]: i for i, x in enumerate(run)}, {x[1]: i + 1 for i, x in enumerate(run)}
        yield run, cue, {
            (starts[s], ends[e], k) for (s, e), k in kinds.items() if s in starts and e in ends and 0 < ends[e] - starts[s] <= LONGEST
        }


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _scan(text: str | None) -> tuple[list, list]:
    """Base spans, and the sequences near which the model may find more, with atoms' places."""
    base, runs = [], []
    for low, line in lines_with_hints(text or ""):
        base += base_in_line(line, low)
        runs += sequences(line, low)
    return sorted(base), runs


def _lessons(text: str | None) -> list[str]:
    """What there is to learn from a text: each sequence of atoms as ``1`` or ``0`` (with base spans or without) and JSON of
    its piece of the line and the base spans in it."""
    out = []
    for low, line in lines_with_hints(text or ""):
        base = sorted(base_in_line(line, 0))
        for cue, run in sequences(line, 0):
            if len(run) <= LEARN_ATOMS:
                a, b = run[0][0], run[-1][1]
                lead = f"{cue} " * bool(cue)
                inside = [
                    (s - a + len(lead), k, e - a + len(lead)) for s, k, e in base[
                        bisect_left(base, (a,)) : bisect_left(base, (b,))
                    ] if e <= b
                ]
                out.append(f"{int(bool(inside))}{json.dumps([lead + line[a:b], inside])}")
    return out


def fit(rows: DataFrame, lessons: str, sample: int = SAMPLE) -> dict | None:
    """The weights, from the lessons of all ``rows``."""
    each = rows.select(F.explode(lessons).alias("x")).distinct().select("x", F.xxhash64("x").alias("h"))
    some = [[r["x"] for r in each.where(F.startswith("x", F.lit(c))).orderBy("h", "x").limit(sample).collect()] for c in "10"]
    if not some[0]:
        return None
    data = [x for line in OTHERS for x in labelled(line, [])] * OTHERS_WEIGHT
    for item in some[0] + some[1]:
        line, spans = json.loads(item[1:])
        for piece, found in [(line, spans), *variants(line, spans)]:
            data += labelled(piece, found)
    return train(data)


def _spans(base: list, runs: list, w: dict | None) -> list[tuple[int, int, int]]:
    """Base spans, and those of the model that touch none of them."""
    out = [tuple(x) for x in base]
    starts, reach = [x for x, _, _ in base], list(accumulate((y for _, _, y in base), max))  # ``base`` is sorted
    for cue, run in runs if w is not None else ():
        for s, e, label in decode(run, w, cue):
            a, b = run[s][0], run[e - 1][1]
            before = bisect_left(starts, b)
            if not before or reach[before - 1] <= a:
                out.append((a, label - 1, b))
    return sorted(out)


RESULTS = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_email, n_ip, n_card, n_phone, base_sha256 and spans (``kind:start:end``, by start,
    comma-joined, in code points, the end exclusive)."""
    docs = docs.select(*[c for c in docs.columns if c == text or c in without(docs, *RESULTS)])
    found, sequence, lessons = free_names([*docs.columns, *RESULTS], "_base", "_runs", "_lessons")
    strings = T.StringType()
    fields = [
        *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base_sha256", strings), T.StructField(found, strings),
        T.StructField(sequence, strings), T.StructField(lessons, T.ArrayType(strings))
    ]

    def scan(texts):
        every = texts.to_pylist()
        pairs = [_scan(t) for t in every]
        n = [pa.array([sum(x[1] == k for x in base) for base, _ in pairs], pa.int64()) for k in range(len(KINDS))]
        sha = [hashlib.sha256(spans_text(base).encode()).hexdigest() for base, _ in pairs]
        return [
            *n, pa.array(sha, pa.string()), pa.array([json.dumps(b) for b, _ in pairs], pa.string()),
            pa.array([json.dumps(r) for _, r in pairs], pa.string()), pa.array([_lessons(t) for t in every], pa.list_(pa.string()))
        ]

    rows = saved(with_columns(docs, scan, fields, [text], drop=(text,)), "pii")
    w = fit(rows, lessons)

    def add(bases, all_runs):
        return [
            pa.array(
                [spans_text(_spans(json.loads(b), json.loads(r), w)) for b, r in zip(bases.to_pylist(), all_runs.to_pylist())], pa.string()
            )
        ]

    return with_columns(rows.drop(lessons), add, [T.StructField("spans", strings)], [found, sequence], drop=(found, sequence))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in angle brackets. Two passes over the texts: one to learn,
    one to find and replace; no texts are shuffled."""
    learn = [T.StructField("lessons", T.ArrayType(T.StringType()))]
    lessons = saved(
        with_columns(
            docs.select(F.col(text).alias("text")), lambda x: [pa.array([_lessons(t) for t in x.to_pylist()], pa.list_(pa.string()))],
            learn, ["text"], drop=("text",)
        ).where(F.size("lessons") > 0),
        "lessons"
    )
    w = fit(lessons, "lessons")
    discard(lessons)

    def change(texts):
        out = []
        for t in texts.to_pylist():
            if t is None:
                out.append(None)
                continue
            parts, at = [], 0
            for s, k, e in _spans(*_scan(t), w):
                if s >= at:
                    parts += [t[at:s], f"<{KINDS[k].upper()}>"]
                at = max(at, e)
            out.append("".join(parts) + t[at:])
        return [pa.array(out, pa.string())]

    return with_columns(docs, change, [docs.schema[text]], [text]).select(*docs.columns)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    return find(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op9_pii": op9_pii}
ORACLES: dict[str, str] = {}
