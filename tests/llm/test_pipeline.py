"""The pipeline's stages on odd rows and on an empty table."""

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline


@pytest.fixture(scope="module")
def odd(make_text):
    clean = make_text(1, 60)
    return [(1, clean), (2, clean), (3, None), (4, ""), (5, "123 !!"), (None, make_text(2, 60)), (6, make_text(3, 60) + " a.b@c.de"), (7, "x" * 200_000), (8, make_text(4, 3000)), (1, clean), (6, make_text(5, 60))]


def test_stages(spark, sf, docs_of, odd):
    docs = docs_of(odd)
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, sf)
        rows = after.collect()
        kept[name] = sorted((r.doc_id for r in rows), key=str)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
            docs = spark.createDataFrame(rows, docs.schema)
    assert not {3, 4, 5} & set(kept["language"]) and {1, 2, 6, 8} <= set(kept["language"])
    assert kept["near_duplicates"].count(1) == 1 and 2 not in kept["near_duplicates"] and kept["near_duplicates"].count(6) == 2
    assert "[EMAIL]" in "".join(r.text for r in docs.collect())
    assert kept["bpe"] == kept["pii"] == kept["decontamination"] == kept["near_duplicates"]


def test_empty(spark, sf, docs_of):
    docs = docs_of([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
