import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents from (doc_id, text, lang, source) rows."""

    def make(rows):
        full = [(*row, None if row[1] is None else len(row[1])) for row in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")

    return make
