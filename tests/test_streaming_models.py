"""Streaming task runs and the model queries (rows-only checks)."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from spanflow.plans import cleaning
from spanflow.plans.keystream import load_key_events
from spanflow.streaming.runs import run_stream

from conftest import SF_SMALL


def test_stream_rule_equals_batch_runs(spark, golden):
    batch = {(r["first_us"], r["last_us"], r["n_events"], r["key_string"])
             for r in cleaning.run_table(golden).collect()}
    stream_logic = {(r["first_us"], r["last_us"], r["n_events"], r["key_string"])
                    for r in run_stream(golden).collect()}
    assert stream_logic == batch


def test_stream_query_runs(spark):
    df = E.queries()["stream_task_runs"](spark, SF_SMALL)
    k = load_key_events(spark, SF_SMALL)
    assert df.count() == cleaning.run_table(k).count()


def test_model_queries_produce_rows(spark):
    qs = E.queries()
    bench = qs["model_benchmark"](spark, SF_SMALL).collect()
    assert {(r["target"], r["model"]) for r in bench} == {(t, m) for t in ("del", "nav") for m in ("tree", "gbt", "enet")}
    assert all(r["rmse"] is not None and r["rmse"] >= 0 for r in bench)
    imp = qs["importance"](spark, SF_SMALL)
    assert imp.filter(F.col("importance") < 0).count() == 0 and imp.count() > 0
    coef = qs["coefficients"](spark, SF_SMALL)
    assert coef.filter(F.col("feature") == "(Intercept)").count() == 2
