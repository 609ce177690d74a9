import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank string, fp string, key string, size string"


@pytest.fixture
def docs(spark):
    """A frame of documents from (id, text) or (id, text, lang, source), with more columns whose names the operators use inside."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", 1, "r", "f", "k", "z") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def stored(spark, tmp_path):
    """A frame written and read again, as the operators that read twice ask for."""

    def store(df):
        path = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return store
