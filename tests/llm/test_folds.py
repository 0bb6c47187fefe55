import pytest

from quillstream.llm.folds import sample_ids


@pytest.mark.parametrize("total", [99, 100, 101, 129, 130, 131, 200])
def test_sample_of_a_little_more_than_the_limit(spark, total):
    ids = spark.range(total).withColumnRenamed("id", "doc_id")
    got = [r[0] for r in sample_ids(ids, 100, 3).collect()]
    assert len(got) == len(set(got)) == min(total, 100)
    assert got == [r[0] for r in sample_ids(ids, 100, 3).collect()]
