"""The pieces leave in few partitions, however many the shuffle has."""

import pytest

from driftmap.llm import packing, queries

TEXTS = [f"word{i % 7} and some text number {i} of many" * (1 + i % 5) for i in range(120)]


@pytest.fixture
def shuffled(spark):
    """Forty partitions that stay forty."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(old, ("false", "40", "-1")):
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("block_docs, most", [(32768, 2), (12, 20)])
def test_pieces_leave_in_few_partitions(spark, shuffled, block_docs, most):
    """Each partition is a file that an executor writes and starts processes for; all rows are there."""
    table = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = packing.pack(table, queries.vocabulary("word_bpe_49k.json"), 2, 64, block_docs=block_docs)
    assert got.rdd.getNumPartitions() <= most
    rows = got.collect()
    by: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        by.setdefault(r["doc_id"], []).append(r)
    assert sorted(by) == list(range(len(TEXTS)))
    for pieces in by.values():
        assert [p["start"] for p in pieces] == [sum(q["length"] for q in pieces[:i]) for i in range(len(pieces))]
        assert sum(p["length"] for p in pieces) == pieces[0]["doc_tokens"]
