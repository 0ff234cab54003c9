"""Operators 3, 6 and 7: small cases, and the whole smallest tables against their SQL."""

from collections import Counter

import duckdb
import pytest

from meshlytics.llm import license_scan, line_dedup, preference_format

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("module", [line_dedup, license_scan, preference_format])
def test_sql(spark, module):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, f in module.QUERIES.items():
        df = f(spark, SF)
        assert not any(x in df._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow", "Pandas"))
        columns = sorted(df.columns)
        result = con.execute(module.ORACLES[name])
        names = [d[0] for d in result.description]
        assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(
            tuple(r[names.index(c)] for c in columns) for r in result.fetchall()
        )


def test_lines(spark):
    rows = [(k, f"top {k}\n  menu \n\nown {k}", "h", "x") for k in range(9)] + [
        (9, "menu\nmenu", "h", "x"), (10, "menu", None, "x"), (11, None, "h", "x"), (12, "", "h", "x"), (13, "menu", "other", "x")
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df, max_ratio=0.5, min_pages=5).collect()}
    assert got[0].text == "top 0\n\nown 0" and (got[0].n_lines, got[0].n_dropped) == (4, 1)
    assert (got[9].text, got[9].n_dropped) == ("", 2)
    assert got[10].text == "menu" and got[13].text == "menu" and got[11].text is None and got[11].n_lines is None and got[12].text == ""
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_licenses(spark):
    mit = dict(license_scan.known_texts())["MIT"]
    british = "Copyright (c) 2020 Someone\n" + mit.upper().replace("SUBLICENSE", "SUB-LICENSE").replace(",", " ,").replace("MIT LICENSE", "MIT Licence")
    assert "MIT LICENCE" in british.upper()
    rows = [
        (1, british, "d"), (2, mit + " and more", "d"), (3, "A text.\nReleased under the MIT License!\nLicensed under CC BY-NC 4.0.", "d"),
        (4, None, "d"), (5, "", "d"), (6, "Copyright 2020", "d"), (3, "again", "d")
    ]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, digest string")).collect()
    by = {(r.doc_id, r.text): r for r in got}
    assert len(got) == 7 and by[1, british].license == "MIT" and by[2, mit + " and more"].license is None
    assert by[3, rows[2][1]].notices == "CC-BY-NC-4.0,MIT" and by[3, "again"].notices == ""
    assert by[4, None].digest is None and by[4, None].notices is None and by[5, ""].digest == by[6, "Copyright 2020"].digest and by[5, ""].license is None
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_each_licence_text(spark):
    """Every text is known by its name when wrapped anew, with other holders, British spellings and other case."""
    import re
    import textwrap

    rows = []
    for k, (name, text) in enumerate(license_scan.known_texts()):
        lines = [x for x in text.split("\n") if not re.match(r"\s*(copyright (\(c\)|©|[0-9])|©)", x, re.I)]
        wrapped = "\n".join(textwrap.wrap(" ".join(lines), 61, break_on_hyphens=False))
        wrapped = re.sub("license", "licence", wrapped, flags=re.I).replace("organization", "organisation")
        rows.append((2 * k, name, text, "x"))
        if license_scan.TERMS_END + "\n" in text:
            continue  # the advice behind the terms has a copyright line as an example, which must keep its place
        rows.append((2 * k + 1, name, f"Copyright (c) 1999-2031, Someone Else Ltd.\nAll rights reserved.\n\n{wrapped.upper()}", "x"))
    names = {n for _, n, _, _ in rows}
    assert {
        "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0",
        "Zlib", "Unlicense", "BSL-1.0"
    } <= names
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, name string, text string, _lines string")).collect()
    assert len(got) == len(rows) and all(r._lines == "x" for r in got)
    assert [(r.doc_id, r.name, r.license) for r in got if r.name != r.license] == [], [
        (r.name, r.text[:100], len(r.text)) for r in got if r.name != r.license
    ]
    changed = spark.createDataFrame(
        [(1, dict(license_scan.known_texts())["MIT"].replace("free of charge", "for a charge"))], "doc_id long, text string"
    )
    assert license_scan.scan(changed).first().license is None


def test_very_long_texts(spark):
    """Each native operator takes texts of a megabyte and keeps them whole."""
    long = "\n".join(f"line {k} of many " + "word " * 60 for k in range(5000))
    df = spark.createDataFrame([(1, "h", long), (2, "h", long + "\nown")], "doc_id long, source string, text string")
    assert [r.n_lines for r in line_dedup.dedup_lines(df, min_pages=3).orderBy("doc_id").collect()] == [5000, 5001]
    assert {r.text for r in line_dedup.dedup_lines(df, min_pages=2).collect()} == {"", "own"}
    assert {r.license for r in license_scan.scan(df).collect()} == {None}
    turn = "array<struct<role:string,text:string>>"
    got = preference_format.format_pairs(
        spark.createDataFrame([(1, [("assistant", long)], [])], f"pair_id long, chosen {turn}, rejected {turn}")
    ).first()
    assert len(got.chosen) == len(long) + len("<|im_start|>assistant\n<|im_end|>\n")


def test_clashing_columns_stay(spark):
    extra = "_host string, _drop string, _kept string, _part string, _parts string, _gone string, _lines string, _a string, _b string, N_LINES string, digest string"
    row = tuple("mine" for _ in range(11))
    docs = spark.createDataFrame([(k, "h", "same line\nown", *row) for k in range(6)], f"doc_id long, source string, text string, {extra}")
    got = line_dedup.dedup_lines(docs, min_pages=6).collect()
    assert all(
        r.text == "" and r.n_lines == r.n_dropped == 2 and r._kept == r._host == r._drop == r._part == r._gone == r._parts == "mine" for r in got
    )
    assert all(r._lines == "mine" and r.notices == "" and r.digest != "mine" for r in license_scan.scan(docs).collect())
    turn = "array<struct<role:string,text:string>>"
    pairs = spark.createDataFrame(
        [(1, [("user", "x")], [("user", "x")], "mine", "mine")], f"pair_id long, chosen {turn}, rejected {turn}, _a string, _b string"
    )
    assert [(r._a, r._b, r.n_prompt_turns) for r in preference_format.format_pairs(pairs).collect()] == [("mine", "mine", 1)]


def test_line_at_the_ratio_stays_and_hot_hosts_join_in_parts(spark):
    rows = [
        (k, "h", f"common\nown {k}\n{'half' if k % 2 else 'other'}") for k in range(20)
    ] + [(100 + k, f"s{k % 3}", "menu") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df, max_ratio=0.5, min_pages=5).collect()}
    assert len(got) == 50 and got[1].text == "own 1\nhalf" and got[2].text == "own 2\nother" and got[100].text == ""


def test_repeated_rows_are_scanned_each(spark):
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License.")]
    assert [
        (r.notices, r.license) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    ] == [("MIT", "MIT")] * 2


def test_preferences(spark):
    turn = "array<struct<role:string,text:string>>"
    u, a = ("user", "hi"), ("assistant", "hello")
    rows = [
        (1, [u, a, ("user", "x"), ("assistant", "good")], [u, a, ("user", "x"), ("assistant", "bad"), u]), (2, [u, a], [u, a]),
        (3, [u], [a]), (4, None, [u]), (5, [(None, None)], [(None, None), a])
    ]
    got = {
        r.pair_id: r for r in preference_format.format_pairs(
            spark.createDataFrame(rows, f"pair_id long, chosen {turn}, rejected {turn}")
        ).collect()
    }
    assert got[1].n_prompt_turns == 3 and got[1].chosen == "<|im_start|>assistant\ngood<|im_end|>\n" and got[1].prompt.count("<|im_start|>") == 3
    for r in got.values():
        for text, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            runs = [tuple(map(int, x.split(":"))) for x in mask.split(",")] if mask else []
            assert sum(n for n, _ in runs) == len(text)
            at, learnt = 0, ""
            for n, flag in runs:
                learnt += text[at : at + n] * flag
                at += n
            assert learnt.count("<|im_end|>") == text.count("<|im_start|>assistant")
    assert got[2].chosen == got[2].rejected == "" and got[2].n_prompt_turns == 2 and got[3].n_prompt_turns == 0
    assert got[4].prompt == "" and got[4].rejected != "" and got[5].n_prompt_turns == 1
    conv = spark.createDataFrame(
        [(1, 1, "user", "a"), (1, 1, "user", "a"), (None, 1, "user", "b"), (1, None, None, None)],
        "conv_id long, turn long, role string, text string"
    )
    assert [len(r.turns) for r in preference_format.turns_of(conv).collect()] == [3]
    assert preference_format.turns_of(conv.limit(0)).count() == 0


def test_very_many_boilerplate_lines_of_long_texts(spark):
    """Each line is looked up in one of many lists of hashes; what stays is what a plain count says."""
    texts = [[f"line {k}" if k % 3 else f"line {k} of {page}" for k in range(1, 6001)] + ["line 1", ""] for page in range(6)]
    df = spark.createDataFrame([(k, "h", "\n".join(x)) for k, x in enumerate(texts)], "doc_id long, source string, text string")
    pages_with = Counter(line for x in texts for line in set(x))
    want = {k: "\n".join(line for line in x if line == "" or pages_with[line] < 5) for k, x in enumerate(texts)}
    got = line_dedup.dedup_lines(df, max_ratio=0.5, min_pages=5).collect()
    assert {r.doc_id: r.text for r in got} == want
    assert {(r.n_lines, r.n_dropped) for r in got} == {(6002, 4001)}
