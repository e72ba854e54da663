import base64
import json
import random

import pytest

from rulespan.llm.common import Workspace

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def ws(spark):
    return Workspace(spark, "test")


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with nulls, empty, blank and long texts, exact and near copies, repeated rows and ids, null ids, ties."""
    rng = random.Random(5)
    base = prose(rng, 400)
    near = base.split()
    near[200] = "changed"
    texts = [None, "", " \t\n\x0b\f\r ", "one", "Éa ß two", base, base, " ".join(near), prose(rng, 30_000), prose(rng, 150), "a" * 1500, "x y " * 600, f"{prose(rng, 50)}\n{base[:900]}", "1 2\n1 2\n\n1 2\n#*$%&|<>"]
    out = [(i, t, "en" if i % 3 else None, None if i == 4 else f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return out + [out[5], (5, "other text under the id of five", "en", "s", 31), (None, base, None, None, None), (None, "null id", "en", "s", 7), (None, "null id", "en", "s", 7)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, COLUMNS)


@pytest.fixture(scope="session")
def cluttered(odd):
    """The same documents with further columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    names = ["fp", "u", "w", "h", "dig", "key", "root", "b", "row", "n_words", "length", "start", "task", "value", "rank", "at", "url_", "part", "place", "n", "_t", "_m"]
    return odd.withColumns({c: F.lit("clash") for c in names})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def token():
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode()
    return f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': '1234567890'})}.c2lnbmF0dXJlX19fX19fX18"
