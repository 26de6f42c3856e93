"""Paths taken at scale: no broadcast of the bucket summary, and a hot key."""

import random

from spanflow.operators import partitions
from spanflow.operators.sequences import end_offset, ordered_concat
from spanflow.operators.sessionize import assign_runs
from spanflow.operators.spans import span_flags, span_rows
from spanflow.plans import cleaning
from spanflow.plans.keystream import load_key_events

from conftest import SF_SMALL
from test_operators import naive_runs


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_summary_join_without_broadcast_gives_same_result(spark):
    k = load_key_events(spark, SF_SMALL)
    with_bc = _rows(cleaning.run_penalties(k))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = cleaning.run_penalties(k)
        plan = df._jdf.queryExecution().executedPlan().toString()
        without_bc = _rows(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" not in plan
    assert with_bc == without_bc


def test_partitions_of_the_run_stage_grow_with_the_input(spark, tmp_path, monkeypatch):
    """A task's share of the run-keyed sorts must not grow with the data: twice the files, twice the partitions, and the same rows."""
    k = load_key_events(spark, SF_SMALL)
    k.write.parquet(str(tmp_path / "one"))
    k.withColumn("user_id", k.user_id + 10**6).write.parquet(str(tmp_path / "two"))
    one, both = spark.read.parquet(str(tmp_path / "one")), spark.read.parquet(str(tmp_path / "one"), str(tmp_path / "two"))
    assert partitions.input_bytes(both) > 1.9 * partitions.input_bytes(one) > 0 == partitions.input_bytes(spark.range(3))
    builds = {"stream": cleaning.episodes, "modular": lambda x: span_flags(end_offset(cleaning.run_events(x)), span_rows(ordered_concat(cleaning.run_events(x))))}
    before = {name: _rows(build(one)) for name, build in builds.items()}
    monkeypatch.setattr(partitions, "INPUT_BYTES", partitions.input_bytes(one) // 12)
    for name, build in builds.items():
        n, m = (build(x).rdd.getNumPartitions() for x in (one, both))
        assert 12 <= n <= 13 and 23 <= m <= 26, (name, n, m)
        assert _rows(build(one)) == before[name]


def test_hot_user_sessionization(spark):
    """One user holds most events (and several editors' worth of buckets)."""
    rnd = random.Random(11)
    rows, seq, t = [], 0, 10**12
    for _ in range(20000):
        t += rnd.choice([100_000, 2_000_000, 39_999_999, 40_000_001, 90_000_000])
        rows.append((0, t, seq))
        seq += 1
    for user in range(1, 6):
        t = 10**12
        for _ in range(50):
            t += rnd.randint(0, 80_000_000)
            rows.append((user, t, seq))
            seq += 1
    df = spark.createDataFrame([(u, "e", t, s) for u, t, s in rows], "user_id long, editor string, t_us long, seq long")
    got = {(r["user_id"], r["seq"]): (r["gap_us"], r["task_runs"], r["row_id"])
           for r in assign_runs(df.repartition(8), ("user_id", "editor")).collect()}
    assert got == naive_runs(rows)
