"""Native span finder vs a row-at-a-time Python UDF on the same run strings.

usage: python tools/udf_compare.py [sf_dir] [cpus]
The run table is staged once; both variants then compute the spans of all four
patterns for every run and count them (no-op sink, median of 3).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from spanflow.functions.spans import PATTERNS, find_spans  # noqa: E402
from spanflow.plans import cleaning  # noqa: E402
from spanflow.plans.keystream import load_key_events  # noqa: E402
from spanflow.session import get_session  # noqa: E402
from spanflow.sources.tables import stage  # noqa: E402

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    cpus = sys.argv[2] if len(sys.argv) > 2 else "4"
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                        conf={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    runs = stage(cleaning.run_table(load_key_events(spark, sf_dir)).select("key_string"))
    compiled = {n: re.compile(p) for n, p in PATTERNS.items()}

    def make_udf(name):
        rx = compiled[name]
        return F.udf(lambda s: [(m.start(), m.end()) for m in rx.finditer(s)] if s is not None else [], SPANS)

    native = runs.select(*[F.size(find_spans("key_string", p)).alias(n) for n, p in PATTERNS.items()])
    udf = runs.select(*[F.size(make_udf(n)("key_string")).alias(n) for n in PATTERNS])

    def timed(df):
        ts = []
        for _ in range(4):
            t0 = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            ts.append(time.perf_counter() - t0)
        return statistics.median(ts[1:])

    same = native.agg(*[F.sum(c) for c in PATTERNS]).first() == udf.agg(*[F.sum(c) for c in PATTERNS]).first()
    plan = udf._jdf.queryExecution().executedPlan().toString()
    print(json.dumps({"runs": runs.count(), "native_sec": round(timed(native), 3), "python_udf_sec": round(timed(udf), 3),
                      "same_counts": same, "udf_plan_has_BatchEvalPython": "BatchEvalPython" in plan}))


if __name__ == "__main__":
    main()
