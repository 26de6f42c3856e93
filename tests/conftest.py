import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from spanflow.session import get_session
    s = get_session("local[4]", shuffle_partitions=4,
                    conf={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                          "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


GOLDEN = [
    (0, "MLD"), (500, "MM"), (900, "MM"), (1500, "MLU"), (2000, "BSD"), (2250, "BSU"), (5000, "aD"),
    (5100, "aU"), (6000, "BSD"), (6100, "BSU"), (7800, "BSD"), (7900, "BSU"), (47900, "AND"),
    (48000, "ANU"), (50000, "AND"), (50123, "ANU"), (90124, "MM"), (90624, "MM"), (93000, "cD"),
    (93100, "cU"),
]
GOLDEN_T0_US = 1_704_067_200_000_000


@pytest.fixture(scope="session")
def golden(spark):
    rows = [(1, "eclipse", i, GOLDEN_T0_US + ms * 1000, tok) for i, (ms, tok) in enumerate(GOLDEN)]
    return spark.createDataFrame(rows, "user_id long, editor string, seq long, t_us long, key_event string")
