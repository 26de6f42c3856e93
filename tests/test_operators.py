"""Unit tests of the stand-alone operators."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanflow.functions.metrics import percentage, task_flag
from spanflow.functions.text import classify_editor, composite_key, event_token
from spanflow.functions.timefn import epoch_us, half_day, local_time, weekday
from spanflow.operators import features as feat
from spanflow.operators.commands import by_category, catalogue_frame, category_counts, count_commands
from spanflow.operators.islands import change_groups, consecutive_groups
from spanflow.operators.quantiles import exact_quantiles
from spanflow.operators.sampling import complement, stratified, with_sample
from spanflow.operators.sessionize import assign_runs, time_gap
from spanflow.operators.sequences import end_offset, ordered_concat
from spanflow.operators.spans import span_flags, span_rows
from spanflow.plans import cleaning, runfeatures
from spanflow.plans.keystream import load_key_events

from conftest import SF_SMALL


def test_classify_editor_first_match_wins(spark):
    titles = ["a - Eclipse", "b - Spring Tool Suite 4", "c - Visual Studio Code", "d - NetBeans", "e - Sublime Text",
              "f - Notepad++", "Eclipse Installer", "x - Eclipse - Visual Studio Code", None]
    df = spark.createDataFrame([(t,) for t in titles], "app string")
    got = [r["e"] for r in df.select(classify_editor("app").alias("e")).collect()]
    assert got == ["eclipse", "eclipse", "vscode", "netbeans", "sublime text", "notepad++", "other", "eclipse", "other"]


def test_composite_key_and_token(spark):
    df = spark.createDataFrame([("kbd", None, "up", "ML"), ("kbd", "a", "down", "a"), ("kbd", "b", "move", "b"),
                                ("kbd", "c", "up", None)], "device string, keyval string, kind string, ev string")
    r = df.select(composite_key("device", "keyval", null_col="keyval").alias("k"),
                  event_token("ev", "kind").alias("t")).collect()
    assert [x["k"] for x in r] == ["mouse", "kbd - a", "kbd - b", "kbd - c"]
    assert [x["t"] for x in r] == ["MLU", "aD", "b", None]


def naive_runs(rows, gap=40_000_000):
    out, last = {}, {}
    for key, t, seq in sorted(rows, key=lambda x: (x[0], x[1], x[2])):
        prev = last.get(key)
        g = 0 if prev is None else t - prev[0]
        run = 1 if prev is None else prev[1] + (1 if g > gap else 0)
        idx = 1 if prev is None else prev[2] + 1
        out[(key, seq)] = (g, run, idx)
        last[key] = (t, run, idx)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bucketed_sessionization_equals_sequential_scan(spark, seed):
    rnd = random.Random(seed)
    rows, seq = [], 0
    for user in range(4):
        t = rnd.randint(0, 10**9)
        for _ in range(rnd.randint(1, 300)):
            t += rnd.choice([0, 1, 39_999_999, 40_000_000, 40_000_001, rnd.randint(0, 120_000_000)])
            rows.append((user, t, seq))
            seq += 1
    df = spark.createDataFrame([(u, "e", t, s) for u, t, s in rows], "user_id long, editor string, t_us long, seq long")
    got = {(r["user_id"], r["seq"]): (r["gap_us"], r["task_runs"], r["row_id"])
           for r in assign_runs(df, ("user_id", "editor")).collect()}
    assert got == naive_runs(rows)


def test_time_gap(spark):
    df = spark.createDataFrame([(1, 10, 0), (1, 25, 1), (2, 5, 2), (1, 25, 3)], "user_id long, t_us long, id long")
    got = {r["id"]: r["gap_us"] for r in time_gap(df, ["user_id"], tie="id").collect()}
    assert got == {0: 0, 1: 15, 3: 0, 2: 0}


def test_epoch_us_ntz_and_ltz(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 00:00:01.5' as a, timestamp'2024-01-01 00:00:01.5' as b")
    r = df.select(epoch_us("a", df.schema["a"].dataType).alias("a"), epoch_us("b", df.schema["b"].dataType).alias("b")).first()
    assert r["a"] == 1704067201500000 == r["b"]


def test_modular_operators_equal_fused_stream(spark, golden):
    ev = cleaning.run_events(golden)
    runs = ordered_concat(ev)
    mod = span_flags(end_offset(ev), span_rows(runs))
    fused = cleaning.episodes(golden, "all").filter(F.col("typ") == "E")
    cols = ["in_del_mouse", "in_mov_mouse", "in_del_key", "in_mov_key"]
    a = {r["seq"]: (r["last_index"], *[r[c] for c in cols]) for r in mod.collect()}
    b = {r["seq"]: (r["last_index"], *[r[c] for c in cols]) for r in fused.collect()}
    assert a == b


def test_change_and_consecutive_groups(spark):
    df = spark.createDataFrame([(1, "e", 1, i, i, f, i + 1) for i, f in enumerate([False, True, True, False, True])],
                               "user_id long, editor string, task_runs long, t_us long, seq long, f boolean, row_id long")
    g = [r["group_f"] for r in change_groups(df, ["f"]).orderBy("seq").collect()]
    assert g == [1, 2, 2, 3, 4]
    c = [r["consecutive_groups"] for r in consecutive_groups(df.filter("f")).orderBy("seq").collect()]
    assert c == [1, 1, 2]


def test_task_flag_three_valued(spark):
    df = spark.createDataFrame([(None, 1), (None, 0), (0.0, 0), (2.0, 0)], "p double, c long")
    assert [r["f"] for r in df.select(task_flag("p", "c").alias("f")).collect()] == [1, None, 0, 1]


def test_percentage_zero_divisor(spark):
    df = spark.createDataFrame([(5, 0), (1, 4)], "p long, t long")
    assert [r["x"] for r in df.select(percentage("p", "t").alias("x")).collect()] == [None, 25.0]


def test_fill_numeric_keeps_strings(spark):
    df = spark.createDataFrame([(None, None, None)], "a long, b double, s string")
    r = feat.fill_numeric(df).first()
    assert r["a"] == 0 and r["b"] == 0.0 and r["s"] is None


def test_duration_range_half_open(spark):
    df = spark.createDataFrame([(9.99,), (10.0,), (899.99,), (900.0,)], "task_time double")
    assert [r["task_time"] for r in feat.duration_range(df).collect()] == [10.0, 899.99]


def test_local_calendar(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 03:00:00' as ts")
    r = df.select(local_time("ts", "America/Bogota").alias("l")).select(
        F.hour("l").alias("h"), F.dayofmonth("l").alias("d"), weekday("l").alias("w"), half_day("l").alias("m")).first()
    assert (r["h"], r["d"], r["w"], r["m"]) == (22, 31, "Sunday", "Afternoon")


def test_commands_long_and_wide_agree(spark):
    rows = [("eclipse", "c1", "BSDBSU", "Delete"), ("eclipse", "c2", "ANDANU", "Navigation"),
            ("vscode", "c3", "MLUBSD", "Delete,Navigation")]
    runs = spark.createDataFrame([(1, "eclipse", 1, "BSDBSUBSDBSUANDANU"), (1, "vscode", 2, "MLUBSDBSU"),
                                  (2, "netbeans", 1, "BSDBSU")], "user_id long, editor string, task_runs long, key_string string")
    long = {(r["user_id"], r["editor"]): (r["del_commands"], r["nav_commands"])
            for r in by_category(runs, count_commands(runs, catalogue_frame(spark, rows))).collect()}
    wide = {(r["user_id"], r["editor"]): (r["del_commands"], r["nav_commands"])
            for r in runs.withColumns(category_counts(rows)).collect()}
    assert long == {(1, "eclipse"): (2, 1), (1, "vscode"): (1, 1), (2, "netbeans"): (0, 0)}
    assert wide == long
    # a catalogue in several pieces, and only commands that occur
    pieces = count_commands(runs, catalogue_frame(spark, rows), piece_bytes=120)
    assert sorted(map(tuple, pieces.collect())) == sorted(map(tuple, count_commands(runs, catalogue_frame(spark, rows)).collect()))
    assert pieces.where("n = 0").isEmpty() and pieces.count() == 3
    assert "Join" not in count_commands(runs, catalogue_frame(spark, rows))._jdf.queryExecution().executedPlan().toString()


def test_command_counts_with_zeros_has_every_command_of_the_editor(spark):
    rows = [("eclipse", "c1", "BSDBSU", "Delete"), ("eclipse", "c2", "ANDANU", "Navigation"), ("vscode", "c3", "MLUBSD", "Delete,Navigation")]
    runs = spark.createDataFrame([(1, "eclipse", 1, "BSDBSUBSDBSU"), (1, "vscode", 2, "AND"), (2, "netbeans", 1, "BSDBSU")],
                                 "user_id long, editor string, task_runs long, key_string string")
    got = count_commands(runs, catalogue_frame(spark, rows), piece_bytes=120, zeros=True)
    assert {(r["user_id"], r["editor"], r["command_id"], r["n"]) for r in got.collect()} == {
        (1, "eclipse", "c1", 2), (1, "eclipse", "c2", 0), (1, "vscode", "c3", 0)}


def test_command_counts_query_keeps_commands_that_do_not_occur(spark):
    from spanflow.plans import catalog
    got = catalog.QUERIES["command_counts"](spark, SF_SMALL)
    assert not got.where("n = 0").isEmpty()
    per_editor = Counter(ed for ed, *_ in runfeatures.COMMANDS)
    runs = cleaning.run_table(load_key_events(spark, SF_SMALL)).groupBy("editor").count().collect()
    assert got.count() == sum(r["count"] * per_editor[r["editor"]] for r in runs)


def test_exact_quantiles_equal_sorted_values(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, 0.0, rnd.uniform(0, 9), rnd.expovariate(0.01)])) for _ in range(700)]
    rows += [("same", 5.0)] * 30 + [("none", None)] * 3 + [("one", -1.5)]
    shares = {"least": 0.0, "q1": 0.25, "half": 0.5, "q99": 0.99, "most": 1.0}
    df = spark.createDataFrame(rows, "g string, v double")
    for slices in (1024, 3):
        got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", shares, slices).collect()}
        assert set(got) == {g for g, _ in rows}
        for g, r in got.items():
            v = sorted(x for h, x in rows if h == g and x is not None)
            assert r["n_values"] == len(v)
            assert [r[n] for n in shares] == [v[max(math.ceil(q * len(v)), 1) - 1] if v else None for q in shares.values()]


def test_sample_column_with_null_strata_and_small_ones(spark):
    rows = [(i, None if i % 5 == 0 else "ab"[i % 2]) for i in range(101)] + [(500, "lonely")]
    df = spark.createDataFrame(rows, "id long, s string")
    got = with_sample(df, ["s"], ["id"], 0.5, 1).collect()
    assert sorted(r["id"] for r in got) == sorted(i for i, _ in rows)
    n, k = Counter(r["s"] for r in got), Counter(r["s"] for r in got if r["in_sample"])
    assert all(k[s] == round(0.5 * n[s]) for s in n) and k["lonely"] == 0


def test_stratified_is_exact_and_complement_partitions(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("ab"), rnd.choice([1, 2, 3])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, s string, t int")
    smp = stratified(df, ["s", "t"], ["id"], 0.5, 2018)
    rest = complement(df, smp, ["id"])
    n = {(r["s"], r["t"]): r["count"] for r in df.groupBy("s", "t").count().collect()}
    got = {(r["s"], r["t"]): r["count"] for r in smp.groupBy("s", "t").count().collect()}
    for k, v in n.items():
        half = v / 2
        want = int(half) if half - int(half) != 0.5 else (int(half) if int(half) % 2 == 0 else int(half) + 1)
        assert got[k] == want
    a = {r["id"] for r in smp.collect()}
    b = {r["id"] for r in rest.collect()}
    assert not (a & b) and (a | b) == set(range(3000))
    # Deterministic, and equal to ranking each stratum in one window.
    assert a == {r["id"] for r in stratified(df, ["s", "t"], ["id"], 0.5, 2018).collect()}
    from pyspark.sql import Window
    from spanflow.operators.sampling import order_key
    w = Window.partitionBy("s", "t").orderBy(order_key(["id"], 2018), "id")
    ref = (df.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("s", "t")))
             .filter(F.col("rn") <= F.bround(F.col("n") * 0.5, 0)))
    assert a == {r["id"] for r in ref.collect()}
