import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablewash.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = str(tmp_path_factory.mktemp("warehouse"))
    s = local_session("*", shuffle_partitions=8, app="tablewash-tests",
                      extra_conf={"spark.sql.warehouse.dir": warehouse})
    yield s


def rows(df, order=None):
    """Collect as a list of tuples (optionally sorted)."""
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=repr) if order else out
