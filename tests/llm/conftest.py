from __future__ import annotations

import pytest

EXTRA = "lang string, digest string, _place string, words string, token long, n long, label string"


@pytest.fixture
def docs(spark):
    """Rows of ``doc_id, text`` as documents with columns whose names operators use themselves."""
    def make(rows):
        wide = [(i, t, "en", "d", "p", "w", 1, 2, "l") for i, t in rows]
        return spark.createDataFrame(wide, f"doc_id long, text string, {EXTRA}").repartition(3)
    return make
