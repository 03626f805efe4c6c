import pytest

from tokenloom.session import local_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, 8)
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (doc_id, text) pairs, with the table's other columns and a clashing one."""

    def make(rows, **more):
        full = [(i, t, more.get("lang", {}).get(i, "en"), "s", None, 7) for i, t in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens int")

    return make
