import pytest

from textspark import operations
from textspark.operators.predictions import MissingModel


def test_dispatch(spark):
    docs = spark.createDataFrame([(1, "Red blue\nred"), (2, None)], "doc_id bigint, text string")
    row = operations.dispatch("core/text.statistics", docs).orderBy("doc_id").first()
    assert (row.bytes, row.chars, row.words, row.lines) == (12, 12, 3, 2)
    assert operations.dispatch("core/text.normalize", docs).orderBy("doc_id").first().text == "red blue red"
    assert operations.dispatch("lexical/lexical.corpusStats", docs).first().unique_terms == 2
    with pytest.raises(ValueError, match="no operation"):
        operations.dispatch("core/none", docs)
    with pytest.raises(MissingModel):
        operations.dispatch("embeddings/embeddings.embed", docs)
    assert "core/text.tokenize" in operations.describe()
