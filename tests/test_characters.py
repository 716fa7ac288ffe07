"""The character detectors' golden cases, and the stack formulas against plain Python."""

import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from underlay.functions import text as T
from underlay.operators import brackets
from underlay.operators import characters as C
from underlay.operators.findings import union

UNIT = "file_id string, inside string, unit_no int, page int, text string"


def tag(t):
    return "".join(chr(0xE0000 + ord(c)) for c in t)


CASES = {
    "one": ("Hello​world", [("zero-width", 1, 6, "Helloworld")]),
    "run": ("a​​​b", [("zero-width", 1, 2, "ab")]),
    "two": ("a​b​c", [("zero-width", 1, 2, "abc"), ("zero-width", 1, 4, "abc")]),
    "bom": ("﻿Hello", []),
    "inner bom": ("x﻿y", [("zero-width", 1, 2, "xy")]),
    "family": ("\U0001f468‍\U0001f469‍\U0001f467", []),
    "persian": ("می‌خواهم", []),
    "joiner": ("a‍b", [("zero-width", 1, 2, "ab")]),
    "override": ("invoice‮gpj.exe", [("bidi-control", 1, 8, "invoiceexe.jpg")]),
    "closed": ("a‮b‬c", [("bidi-control", 1, 2, "abc"), ("bidi-control", 1, 4, "abc")]),
    "tags": ("Hello" + tag("SECRET") + " world", [("tag-characters", 1, 6, "Hello world")]),
    "homoglyph": ("Login at аpple.com now", [("mixed-script", 1, 10, "Login at аpple.com now")]),
    "cyrillic": ("Привет мир", []),
    "words": ("Moscow Москва", []),
    "japanese": ("漢字かなカナ", []),
    "tokyo": ("東京Tokyo", []),
    "tie": ("aа", [("mixed-script", 1, 2, "aа")]),
    "lines": ("x\n\r\ny a​b\r\nz", [("zero-width", 3, 4, "y ab")]),
    "separator": ("p q​r", [("zero-width", 2, 2, "qr")]),
    "planes": ("\U0001f600\U0001f600​x", [("zero-width", 1, 3, "\U0001f600\U0001f600x")]),
    "joiner at a line's start": ("\U0001f468\n\u200d\U0001f469", [("zero-width", 2, 1, "\U0001f469")]),
    "mark and joiner": ("\ufeff\u200dx", [("zero-width", 1, 2, "\ufeffx")]),
    "two words": ("аb cа", [("mixed-script", 1, 2, "аb cа"), ("mixed-script", 1, 5, "аb cа")]),
    "nested": ("a\u202b\u202eb\u202cc", [("bidi-control", 1, 2, "abc"), ("bidi-control", 1, 5, "abc")]),
    "flag": ("\U0001f3f4" + tag("gb"), [("tag-characters", 1, 2, "\U0001f3f4")]),
}


@pytest.fixture(scope="module")
def found(spark):
    units = spark.createDataFrame([(k, "", 0, 7, t) for k, (t, _) in CASES.items()], UNIT)
    out = {}
    for r in union(C.detect(units)).collect():
        assert r.page == 7
        out.setdefault(r.file_id, []).append(r)
    return out


@pytest.mark.parametrize("case", CASES)
def test_golden(found, case):
    got = sorted((r.detector, r.line, r.column, r.human_sees) for r in found.get(case, []))
    assert got == sorted(CASES[case][1])


def test_details(found):
    assert found["run"][0].codepoints == ["U+200B"] * 3
    assert found["tags"][0].decoded == "SECRET" and "tag characters: SECRET" in found["tags"][0].machine_reads
    assert "never closed" in found["override"][0].summary and "never closed" not in found["closed"][0].summary
    assert found["homoglyph"][0].basis == "circumstantial" and found["one"][0].basis == "direct"


def test_two_runs_on_a_line_keep_the_text_between(spark):
    units = spark.createDataFrame([("x", "", 0, None, "a" + tag("AB") + "mid" + tag("CD") + "e")], UNIT)
    assert {r.machine_reads for r in C.tag_characters(units).collect()} == {"a⟨tag characters: AB⟩mid⟨tag characters: CD⟩e"}


def still_open(text):
    embeds, isolates = [], []
    for i, c in enumerate(text):
        cp = ord(c)
        if cp in T.EMBEDDINGS:
            embeds.append(i)
        elif cp == T.POP and embeds:
            embeds.pop()
        elif cp in T.ISOLATES:
            isolates.append(i)
        elif cp == T.POP_ISOLATE and isolates:
            isolates.pop()
    return set(embeds) | set(isolates)


def rendered(body):
    out, turned, inside = "", "", False
    for c in body:
        cp = ord(c)
        if inside and cp in (T.POP, T.POP_ISOLATE):
            out, turned, inside = out + turned, "", False
        elif not inside and cp == T.OVERRIDE:
            inside = True
        elif cp not in T.BIDI:
            if inside:
                turned = c + turned
            else:
                out += c
    return out + turned


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("ab\U0001f600" + "".join(map(chr, T.BIDI))), max_size=25), min_size=30, max_size=30))
def test_stacks_and_overrides(spark, texts):
    units = spark.createDataFrame([(str(i), "", 0, None, t) for i, t in enumerate(texts)], UNIT)
    got = {}
    for r in brackets.controls(units).where("open").collect():
        got.setdefault(int(r.file_id), set()).add(r.pos)
    for i, t in enumerate(texts):
        assert got.get(i, set()) == still_open(t)
    for r in C.bidi_control(units).collect():
        assert r.human_sees == rendered(texts[int(r.file_id)])


def test_long_lines_stay_linear(spark):
    """A million characters on one line, and as many lines, in seconds."""
    long = "abcd " * 100_000
    units = spark.createDataFrame([("line", "", 0, None, f"{long}\u202e{long}\u200b{long}"), ("lines", "", 0, None, "x\n" * 500_000 + "y\u200bz")], UNIT)
    start = time.perf_counter()
    got = sorted((r.file_id, r.detector, r.line, r.column, len(r.human_sees)) for r in union(C.detect(units)).collect())
    assert got == [("line", "bidi-control", 1, 500_001, 1_500_001), ("line", "zero-width", 1, 1_000_002, 1_500_001), ("lines", "zero-width", 500_001, 2, 2)]
    assert time.perf_counter() - start < 60


def test_expressions(spark):
    rows = spark.createDataFrame([(1, " 　 x\ty  "), (26, ""), (27, "\x1c\x85"), (702, "a\r\nb\x0bc\n"), (703, "\n")], "n int, t string")
    r = rows.select(T.column_name(F.col("n")).alias("c"), T.blank(F.col("t")).alias("b"), T.strip(F.col("t")).alias("s"), T.squash(F.col("t")).alias("q"), T.lines(F.col("t")).alias("l")).collect()
    assert [x.c for x in r] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert [x.b for x in r] == [False, True, True, False, True]
    assert r[0].s == "x\ty" and r[0].q == "x y" and r[3].l == ["a", "b", "c"] and r[4].l == [""]
