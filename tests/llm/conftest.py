import pytest

SMALL = "/root/testdata/sf0.001"

#: Columns whose names operators use inside, with values that must not matter.
CLASHING = {"key": 1, "score": 2.0, "size": 3, "length": 4, "ranges": "x", "p": 0.5, "fp": 5, "root": 6, "copies": 7, "unit": 8, "lang": None, "source": None, "n_chars": 0, "h": "h", "node": "n", "host": "q"}


@pytest.fixture(scope="session")
def make(spark):
    """make(rows of (doc_id, text, source)) -> documents with further, clashing columns."""

    def build(rows):
        extra = {k: v for k, v in CLASHING.items() if k != "source"}
        kinds = {int: "bigint", float: "double", str: "string", type(None): "string"}
        schema = "doc_id bigint, text string, source string, " + ", ".join(f"`{k}` {kinds[type(v)]}" for k, v in extra.items())
        return spark.createDataFrame([(*r, *([None] * (3 - len(r))), *extra.values()) for r in rows], schema)

    return build
