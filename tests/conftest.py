import sys
from datetime import timedelta
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from eventwatch.schema import SECURITY_EVENT  # noqa: E402
from eventwatch.session import build_session  # noqa: E402
from fixtures import T0  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield s
    s.stop()


@pytest.fixture
def make_events(spark):
    """Rows given as dicts with `at` seconds after T0 -> SECURITY_EVENT frame."""

    def make(rows):
        out = []
        for i, r in enumerate(rows):
            r = dict(r)
            at = T0 + timedelta(seconds=r.pop("at", 0))
            full = {
                "event_id": f"e{i:05d}", "timestamp": at, "ingested_at": at, "source": "ssh-server-01",
                "source_type": "linux_server", "event_type": "unknown", "severity": "info",
                "bytes_out": 0, "bytes_in": 0, "metadata": {}, **r,
            }
            out.append(tuple(full.get(f.name) for f in SECURITY_EVENT))
        return spark.createDataFrame(out, SECURITY_EVENT)

    return make
