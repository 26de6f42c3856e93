"""Plan shape of the flagship: built-in expressions only, no single-partition
exchange, one exchange of events by run key."""

import re

from spanflow.plans import cleaning
from spanflow.plans.keystream import load_key_events

from conftest import SF_SMALL


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_plan(spark):
    df = cleaning.run_penalties(load_key_events(spark, SF_SMALL))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan_text(df)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert "SinglePartition" not in p
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", p)
    run_keyed = [e for e in exchanges if "task_runs" in e]
    assert len(run_keyed) == 1, exchanges
    # the events by (user, editor, segment), the summary of segments by user stream, the events by run, and the
    # reused name of the first
    assert len(exchanges) <= 4, exchanges


def test_sessionizer_scans_and_shuffles_events_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan_text(cleaning.run_events(load_key_events(spark, SF_SMALL)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert p.count("FileScan") == 1 and p.count("ReusedExchange") == 1
    assert p.count("REPARTITION_BY_COL") == 2  # the exchange, and its name where it is used again


def test_split_reads_only_strata_and_keys_before_its_one_pass(spark):
    from spanflow.operators.sampling import with_sample
    from spanflow.plans.keystream import read_table
    c = read_table(spark, SF_SMALL, "customer")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan_text(with_sample(c, ["c_nationkey", "c_mktsegment"], ["c_custkey"]))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", p)
    assert sum("c_name" in s for s in scans) == 1 and "SinglePartition" not in p
    # the rows themselves are never dealt by stratum
    assert not any("c_name" in line for line in p.splitlines() if "Exchange hashpartitioning" in line)
