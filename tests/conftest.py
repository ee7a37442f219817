import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from paperloom.session import local_session

    shared = str(tmp_path_factory.mktemp("checkpoints"))
    session = local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": shared, "spark.driver.memory": "2g"})
    yield session
    session.stop()
