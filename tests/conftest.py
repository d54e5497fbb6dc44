import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from linkscore.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    session = local_session(4, memory="4g", spark__checkpoint__dir=folder)
    yield session
    session.stop()


@pytest.fixture
def make_pages(spark):
    def make(*markup, url="http://s/"):
        rows = [(i + 1, url, html) for i, html in enumerate(markup)]
        return spark.createDataFrame(rows, "page_id bigint, url string, html string")

    return make
