import os

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, component_id string, unit string, part int"
@pytest.fixture
def docs_of(spark):
    """A documents table of (id, text[, lang[, source]]) rows, with extra columns whose names clash with the operators' own."""

    def make(rows):
        full = [(*r, *[None, "s"][len(r) - 2 :])[:4] if len(r) < 4 else r for r in rows]
        return spark.createDataFrame([(i, t, la, so, None, 7, "x", "y", 3) for i, t, la, so in full], DOCS)

    return make


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF", SF)
