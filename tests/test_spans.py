"""Regex spans: execution forms, the Column finder, membership."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanflow.functions.spans import EXEC_PATTERNS, PATTERNS, find_spans, in_spans, match_count

CODES = ["MLD", "MLU", "MM", "MCU", "MCD", "BSD", "BSU", "RED", "REU", "SD", "SU", "ED", "EU", "AND", "ANU",
         "LD", "LU", "ASD", "ASU", "AED", "AEU", "aD", "aU", "xD", "cD", "cU"]


def spans_py(pattern, s, first=False):
    out = [(m.start(), m.end()) for m in re.finditer(pattern, s)]
    return out[:1] if first else out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(CODES), max_size=60))
def test_exec_forms_match_specified_patterns(tokens):
    s = "".join(tokens)
    for name in PATTERNS:
        assert spans_py(PATTERNS[name], s) == spans_py(EXEC_PATTERNS[name], s), (name, s)


def test_find_spans_column_matches_python(spark):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice(CODES) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    texts += ["", "MLDMMMLUBSDBSU", "BSDBSUBSDBSUxBSDBSU", "MM" * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, s string")
    cols = []
    for name, p in PATTERNS.items():
        cols.append(find_spans("s", p).alias(f"{name}_all"))
        cols.append(find_spans("s", p, first_only=True).alias(f"{name}_first"))
        cols.append(match_count("s", p).alias(f"{name}_n"))
    got = {r["id"]: r for r in df.select("id", *cols).collect()}
    for i, t in enumerate(texts):
        for name, p in PATTERNS.items():
            want = spans_py(p, t)
            assert [(x["start"], x["end"]) for x in got[i][f"{name}_all"]] == want
            assert [(x["start"], x["end"]) for x in got[i][f"{name}_first"]] == want[:1]
            assert got[i][f"{name}_n"] == len(want)


def test_long_repetition_does_not_overflow(spark):
    df = spark.range(1).select(F.repeat(F.lit("MM"), 100_000).alias("s"))
    r = df.select(F.size(find_spans("s", PATTERNS["mov_mouse"])).alias("n"),
                  match_count("s", PATTERNS["mov_mouse"]).alias("c")).first()
    assert r["n"] == 1 and r["c"] == 1


@pytest.mark.parametrize("v,expected", [(0, 0), (1, 1), (4, 1), (5, 0), (7, 0), (8, 1), (None, 0)])
def test_in_spans_strict(spark, v, expected):
    df = spark.createDataFrame([(v,)], "v int").withColumn(
        "sp", F.expr("array(named_struct('start', 0, 'end', 5), named_struct('start', 7, 'end', 9))"))
    assert df.select(in_spans("v", "sp").alias("x")).first()["x"] == expected


def test_in_spans_empty_and_null(spark):
    df = spark.createDataFrame([(3,)], "v int")
    r = df.select(in_spans("v", F.expr("cast(array() as array<struct<start:int,end:int>>)")).alias("a"),
                  in_spans("v", F.lit(None).cast("array<struct<start:int,end:int>>")).alias("b")).first()
    assert r["a"] == 0 and r["b"] == 0
