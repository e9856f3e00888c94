import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from conftest_words import prose  # noqa: E402

@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, nulls, empty, blank and very long ones."""
    passage = prose(1, 70)
    long = prose(2, 30_000)
    return [None, "", " \t\n ", "one", "one two", passage, passage, f"{prose(3, 30)} {passage} {prose(4, 20)}", f"{prose(5, 9)}\n{passage.replace(' ', '  ')}", long, long + " end", prose(6, 49), prose(6, 49), prose(7, 120), prose(7, 120).replace("a", "a", 1) + " x", "é ü ñ 漢字 🙂 " + prose(8, 60), passage.upper()]


@pytest.fixture
def docs(spark, texts):
    rows = [(k, t, "en", f"s{k % 3}" if k % 5 else None, len(t) if t is not None else None, k * 2, "x") for k, t in enumerate(texts)]
    rows += [(4, texts[7], "en", "s1", 3, 0, "x"), (None, texts[5], None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, label int, features string")


@pytest.fixture
def no_docs(docs):
    return docs.where("false")
