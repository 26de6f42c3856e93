"""The fused run pipeline against a plain Python loop on random key streams."""

import random
import re

import pytest

from spanflow.functions.metrics import FREE_US, RUN_GAP_US
from spanflow.functions.spans import PATTERNS
from spanflow.operators.islands import FAMILIES
from spanflow.plans import cleaning

CODES = ["MLD", "MLU", "MM", "MCU", "MCD", "BSD", "BSU", "RED", "REU", "SD", "SU", "ED", "EU", "AND", "ANU",
         "LD", "LU", "ASD", "ASU", "AED", "AEU", "aD", "xD", "cU"]
STEPS = [0, 1, 300_000, 1_000_000, 2_000_000, RUN_GAP_US, RUN_GAP_US + 1, 90_000_000]


def random_stream(seed):
    rnd = random.Random(seed)
    rows, seq = [], 0
    for user in range(3):
        for editor in ("eclipse", "vscode"):
            t = 1_704_067_200_000_000 + rnd.randint(0, 10**9)
            for _ in range(rnd.randint(1, 120)):
                t += rnd.choice(STEPS)
                rows.append((user, editor, seq, t, rnd.choice(CODES)))
                seq += 1
    return rows


def expected(rows, mode):
    out = {}
    streams = {}
    for u, e, seq, t, tok in rows:
        streams.setdefault((u, e), []).append((t, seq, tok))
    for (u, e), evs in streams.items():
        evs.sort()
        runs, cur, last = [], [], None
        for ev in evs:
            if last is not None and ev[0] - last > RUN_GAP_US:
                runs.append(cur)
                cur = []
            cur.append(ev)
            last = ev[0]
        runs.append(cur)
        for rn, run in enumerate(runs, start=1):
            s = "".join(tok for _, _, tok in run)
            offs, pos = [], 0
            for _, _, tok in run:
                pos += len(tok)
                offs.append(pos - 1)
            inside = {}
            for name, p in PATTERNS.items():
                spans = [(m.start(), m.end()) for m in re.finditer(p, s)]
                if mode == "first":
                    spans = spans[:1]
                inside[name] = [any(a < o < b for a, b in spans) for o in offs]
            pens = {}
            for fam, pats in FAMILIES.items():
                flags = [any(inside[p][i] for p in pats) for i in range(len(run))]
                total, start = None, None
                for i, f in enumerate(flags + [False]):
                    if f and start is None:
                        start = i
                    if not f and start is not None:
                        d = run[i - 1][0] - run[start][0]
                        total = (total or 0) + max(d - FREE_US, 0)
                        start = None
                pens[fam] = total
            task = run[-1][0] - run[0][0]
            if task > 0:
                out[(u, e, rn)] = (s, len(run), task, pens)
    return out


@pytest.mark.parametrize("seed,mode", [(1, "all"), (2, "all"), (3, "first"), (4, "first")])
def test_run_penalties_equal_python_loop(spark, seed, mode):
    rows = random_stream(seed)
    df = spark.createDataFrame(rows, "user_id long, editor string, seq long, t_us long, key_event string")
    got = {}
    for r in cleaning.run_penalties(df, mode).collect():
        got[(r["user_id"], r["editor"], r["task_runs"])] = (
            r["key_string"], r["n_events"], r["task_us"], {f: r[f"penalty_{f}_us"] for f in FAMILIES})
    assert got == expected(rows, mode)
