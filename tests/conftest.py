import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from mnemospark.session import local_session, ship

    session = local_session(cores=4, partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()
