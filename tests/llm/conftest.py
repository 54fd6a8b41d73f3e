import pytest

from redline.llm.common import begin


@pytest.fixture(scope="session")
def llm(spark):
    """The session, with the package shipped to the Python workers."""
    begin(spark)
    return spark


#: Columns whose names clash with what the operators call theirs.
CLASHES = {"row": 1, "w": 2, "key": "k", "node": 3, "id": 4, "h": 5, "rank": 6, "score": 7.0, "length": 8, "tmpl": "t",
           "probability": 0.5, "d0": "x", "digest": "d", "n_words": 9, "site": "s", "p": None}


@pytest.fixture
def docs(llm):
    """Documents from (doc_id, text) pairs with language, source and clashing extra columns."""
    def make(rows, extra=True):
        names = ["doc_id", "text", "lang", "source", "n_chars"] + (list(CLASHES) if extra else [])
        kinds = {int: "long", str: "string", float: "double", type(None): "string"}
        schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(
            f", {k} {kinds[type(v)]}" for k, v in CLASHES.items()) * extra
        data = [(i, t, "en", "src0", len(t or "")) + (tuple(CLASHES.values()) if extra else ()) for i, t in rows]
        assert len(names) == len(schema.split(", "))
        return llm.createDataFrame(data, schema)
    return make
