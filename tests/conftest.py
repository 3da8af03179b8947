import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from eventloom.session import local_session

    s = local_session(cpus=4, memory="4g", shuffle_partitions=4)
    yield s
    s.stop()
