import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def llm(spark):
    """The session as the training-data operators set it up."""
    from ragspark.llm.common import ready
    return ready(spark)


@pytest.fixture(scope="session")
def odd_docs(llm):
    """Null, empty, blank, one-word, repeated, equal, very long and wordless texts; columns
    whose names clash with the operators' own."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, " \t\n", "en", None), (4, "one", None, "s"),
            (5, "the same text here again and again", "en", "s"), (5, "the same text here again and again", "en", "s"),
            (6, "the same text here again and again", "fr", "t"), (7, long, "en", "s"), (8, "*** 123 !!!", "en", "s"),
            (9, "x" * 200_000, "en", "s"), (None, "a row without an id", "en", "s"), (10, "日本 é ß 🙂 ok", "de", "t")]
    d = llm.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)
    from pyspark.sql import functions as F
    return d.withColumns({c: F.lit("clash") for c in
                          ("score", "ids", "label", "budget", "rank", "key", "t", "i", "id", "shard", "same", "_range", "domain")})


@pytest.fixture(scope="session")
def no_docs(llm):
    return llm.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(llm):
    return llm.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def queries():
    from ragspark.llm import registry
    return registry.queries()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
