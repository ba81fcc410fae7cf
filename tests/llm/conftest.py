from __future__ import annotations

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from texts, or from (doc_id, text) or (doc_id, text, source) rows."""

    def build(rows, extra: str = ""):
        full = []
        for i, row in enumerate(rows):
            row = row if isinstance(row, tuple) else (i, row)
            doc_id, text, source = (*row, "s")[:3]
            full.append((doc_id, text, "en", source, len(text or "")))
        return spark.createDataFrame(full, DOCUMENT)

    return build
