"""Registered queries against their SQL on small tables of rows that the given ones lack."""

import duckdb
import pytest

from quarry.queries import ORACLES, QUERIES

from .test_queries import rows

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def holds(spark, tmp_path):
    """Whether a query equals its SQL over tables given as name=(rows, schema)."""

    def check(name, **tables):
        con = duckdb.connect()
        for t, (data, schema) in tables.items():
            spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        got, want = QUERIES[name](spark, str(tmp_path)), con.execute(ORACLES[name])
        assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall())
        return True

    return check


def documents(*texts):
    return [(i, t, lang, "a", None) for i, (t, lang) in enumerate(texts)], DOCUMENTS


def test_one_text_in_two_languages(holds):
    assert holds("embedding_cache_split", documents=documents(("same", "de"), ("same ", "en"), ("", "de"), ("", "fr"), (None, "de"), (None, "es"), ("same", None), ("other", "de")))


@pytest.mark.parametrize("name", ["extracted_answers", "evidence_sufficiency"])
def test_scores_that_tie_when_rounded(holds, name):
    """The last document is a word shorter, which its score tells in the seventh digit only."""
    texts = [(f"Document {'abcdefghij'[i % 10]} has a pump here. " + "zz " * (1000 - i // 999), "en") for i in range(1000)]
    assert holds(name, documents=documents(*texts), benchmark=([(1, "pump")], "item_id long, text string"))
