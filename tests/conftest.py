import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lodestar.session import local_session

    yield local_session(cores=4, partitions=4, memory="4g", **{"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"})
