import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from lakeprep.session import build_session
    s = build_session("local[4]", app_name="lakeprep-tests", shuffle_partitions=4)
    if not s.conf.get("spark.checkpoint.dir", None):
        # Tests only: a private scratch root when the session names none.
        path = tempfile.mkdtemp(prefix="lakeprep-test-")
        s.conf.set("spark.checkpoint.dir", path)
        s.sparkContext.setCheckpointDir(path)
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="lakeprep-t-")


def task_totals(spark, action, counter: str) -> int:
    """Sum of a counter over the tasks of the stages that ``action`` starts (``inputRecords``, ``shuffleWriteBytes``)."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    none = gateway.jvm.java.util.ArrayList()

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
        return [found.apply(i) for i in range(found.length())]
    last = max((s.stageId() for s in stages()), default=-1)          # the store forgets old stages
    action()
    return sum(getattr(s, counter)() for s in stages() if s.stageId() > last)


def rows(df, order=None):
    data = [tuple(r) for r in df.collect()]
    return sorted(data, key=lambda t: tuple((x is None, str(x)) for x in t)) if order is None else data
