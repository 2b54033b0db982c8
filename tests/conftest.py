import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sunmesh.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    return build_session("local[8]", 8, **{"spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": shared})
