import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from convolake.session import session

    shared = str(tmp_path_factory.mktemp("shared"))
    s = session("local[4]", 4, **{"spark.checkpoint.dir": shared, "spark.sql.warehouse.dir": shared + "/warehouse", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
