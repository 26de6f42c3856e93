"""The 20-event golden scenario, computed by hand (FIXTURES.md section 3)."""

import pytest
from pyspark.sql import functions as F

from spanflow.plans import cleaning


def by_run(df):
    return {r["task_runs"]: r for r in df.collect()}


def test_runs_and_strings(golden):
    runs = by_run(cleaning.run_table(golden))
    assert set(runs) == {1, 2}
    assert runs[1]["key_string"] == "MLDMMMMMLUBSDBSUaDaUBSDBSUBSDBSUANDANUANDANU"
    assert runs[1]["n_events"] == 16
    assert runs[2]["key_string"] == "MMMMcDcU"
    assert runs[2]["n_events"] == 4


def test_gap_of_exactly_40s_stays_and_40_001_breaks(golden):
    ev = {r["seq"]: r for r in cleaning.sessionized(golden).collect()}
    assert ev[12]["gap_us"] == 40_000_000 and ev[12]["task_runs"] == 1 and ev[12]["is_new_task_run"] == 0
    assert ev[16]["gap_us"] == 40_001_000 and ev[16]["task_runs"] == 2 and ev[16]["is_new_task_run"] == 1
    assert ev[0]["gap_us"] == 0 and ev[0]["row_id"] == 1 and ev[19]["row_id"] == 20


EXPECTED = {
    # (run, mode): {family: (events, islands, penalty or None)}
    (1, "all"): {"del": (10, 2, 1.95), "del_mouse": (6, 1, 1.15), "nav": (6, 2, 1.123), "nav_mouse": (2, 1, 0.0)},
    (1, "first"): {"del": (6, 1, 1.15), "del_mouse": (6, 1, 1.15), "nav": (6, 2, 1.123), "nav_mouse": (2, 1, 0.0)},
    (2, "all"): {"del": (0, 0, None), "del_mouse": (0, 0, None), "nav": (2, 1, 0.0), "nav_mouse": (2, 1, 0.0)},
    (2, "first"): {"del": (0, 0, None), "del_mouse": (0, 0, None), "nav": (2, 1, 0.0), "nav_mouse": (2, 1, 0.0)},
}


@pytest.mark.parametrize("mode", ["all", "first"])
def test_islands_and_penalties(golden, mode):
    isl = cleaning.islands(golden, mode).collect()
    rp = by_run(cleaning.run_penalties(golden, mode))
    for run in (1, 2):
        for fam, (n_ev, n_isl, pen) in EXPECTED[(run, mode)].items():
            rows = [r for r in isl if r["task_runs"] == run and r["family"] == fam]
            assert sum(r["n_events"] for r in rows) == n_ev, (run, fam)
            assert len(rows) == n_isl, (run, fam)
            got = rp[run][f"penalty_{fam}"]
            if pen is None:
                assert got is None
            else:
                assert got == pytest.approx(pen, abs=1e-9), (run, fam)
    assert rp[1]["task_time"] == pytest.approx(50.123)
    assert rp[2]["task_time"] == pytest.approx(2.976)


def test_percentages(golden):
    r1 = by_run(cleaning.run_penalties(golden, "all"))[1]
    assert r1["percentage_del"] == pytest.approx(3.890430, abs=1e-6)
    assert r1["percentage_del_mouse"] == pytest.approx(2.294356, abs=1e-6)
    assert r1["percentage_nav"] == pytest.approx(2.240488, abs=1e-6)


def test_zero_duration_runs_are_dropped(spark):
    df = spark.createDataFrame([(1, "vscode", 0, 10**15, "BSD")],
                               "user_id long, editor string, seq long, t_us long, key_event string")
    assert cleaning.run_penalties(df).count() == 0


def test_flags_are_strictly_inside(golden):
    st = cleaning.episodes(golden, "all").filter(F.col("typ") == "E")
    rows = {r["seq"]: r for r in st.collect()}
    # BSD at offset 12 and BSU at 15 lie inside the delete-key span [10, 16).
    assert rows[4]["last_index"] == 12 and rows[4]["in_del_key"]
    assert rows[5]["last_index"] == 15 and rows[5]["in_del_key"]
    # aD/aU between the two delete-key matches are not flagged.
    assert not rows[6]["in_del_key"] and not rows[7]["in_del_key"]
