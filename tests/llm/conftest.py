import pytest

from concordia.session import Scratch

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def scratch(spark):
    with Scratch(spark, "test") as s:
        yield s


@pytest.fixture()
def documents(spark):
    """Texts (or (id, text) pairs) to a documents table."""
    def make(texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCUMENT)
    return make


@pytest.fixture()
def landed(spark, tmp_path):
    """Writes tables to a folder as the queries find them."""
    def make(**tables):
        for name, df in tables.items():
            df.write.parquet(f"file://{tmp_path}/{name}.parquet")
        return f"file://{tmp_path}"
    return make
