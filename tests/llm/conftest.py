import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent.parent)
sys.path.insert(0, ROOT)
# Python workers import the package as well.
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

from gradus.llm.common import prepare  # noqa: E402

LONG = " ".join(f"word{k}" for k in range(9000))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def llm(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return prepare(spark)


@pytest.fixture(scope="session")
def odd_docs(llm):
    """Nulls in every column, empty and long texts, repeated rows, odd white space, extra columns whose names clash."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", 1.0),
        (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", 1.0),
        (2, None, "en", None, None),
        (3, "", None, "a", 2.0),
        (None, "token = abcdef0123456789abcdef0123456789ab", "en", "a", 2.0),
        (4, LONG, "en", "a", 2.0),
        (5, "  \n\t ", "en", "a", 2.0),
        (6, "Éa ñ   x y <|endoftext|> z\x1cq 日本 a,b. c!?\n\nd", "en", "b", 2.0),
        (7, "x" * 5000, "en", "b", 2.0),
    ]
    return llm.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
