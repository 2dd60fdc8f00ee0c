"""An append that failed, or is run again, gives the answer of its batch."""

import pytest

from tidemark.llm import exact_dedup


def answer(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_retry_after_a_failure_between_index_and_result(spark, docs, monkeypatch):
    want = answer(exact_dedup.DigestIndex(spark, buckets=3).append(docs))
    index, settled = exact_dedup.DigestIndex(spark, buckets=3), exact_dedup.settled

    def lost(df, name="table"):
        if name == "verdicts":
            raise RuntimeError("lost")
        return settled(df, name)

    monkeypatch.setattr(exact_dedup, "settled", lost)
    with pytest.raises(RuntimeError):
        index.append(docs, batch="monday")
    monkeypatch.setattr(exact_dedup, "settled", settled)
    assert answer(index.append(docs, batch="monday")) == want
    assert sum(r.kept for r in index.append(docs, batch="monday").collect()) > 0


def test_replay_after_another_batch_and_in_either_order(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "doc_id long, text string")
    one, two = rows((1, "a b"), (2, "c")), rows((3, "ab"), (4, "d"), (5, "d"))
    for first, second, names in ((one, two, "xy"), (two, one, "yx")):
        index = exact_dedup.DigestIndex(spark, buckets=2)
        before = answer(index.append(first, batch=names[0])), answer(index.append(second, batch=names[1]))
        assert (answer(index.append(first, batch=names[0])), answer(index.append(second, batch=names[1]))) == before
        assert index.read().count() == 3
