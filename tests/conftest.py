import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))


@pytest.fixture(scope="session")
def spark():
    from weftgraph.session import get_session

    # tables of a few rows: compiling plans would take most of the time
    small = {"spark.sql.shuffle.partitions": "2", "spark.default.parallelism": "2", "spark.sql.codegen.wholeStage": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    s = get_session("tests", "local[4]", **small)
    s.sparkContext.setLogLevel("ERROR")
    return s
