import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from drawspark.session import session

    made = session("local[8]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="6g", spark__ui__showConsoleProgress="false", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    made.sparkContext.setLogLevel("ERROR")
    made.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield made
    made.stop()


@pytest.fixture(scope="session")
def sf(request):
    return f"{DATA}/sf0.001"
