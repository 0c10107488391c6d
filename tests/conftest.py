import pytest

from tests.session import make_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return make_session(tmp_path_factory.mktemp("spark"))
