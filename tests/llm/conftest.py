import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from llm_cases import cases  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, part int, h string, kept string, component_id string, carried string, text_sha256 string, payload binary"


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en" if (i or 0) % 2 else None, None, None, "b", 1, "h", None, "c", "d", "e", b"p") for i, t in cases()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
