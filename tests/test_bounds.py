"""What a task holds in Python follows set sizes, not the number of rows of an Arrow batch."""

import numpy as np
import pyarrow as pa
import pytest

from tarn.operators import blockmax, chunk, embed
from tarn.plans import catalogue
from tarn.streaming import session


def test_sums_are_handed_on_within_a_batch(monkeypatch):
    monkeypatch.setattr(embed, "SUMS", 8)
    ups = [[{"a": f"p{i // 3}", "w": 0.5}, {"a": f"r{i // 6}", "w": 0.25}] for i in range(120)]
    vectors = np.arange(240, dtype=float).reshape(120, 2)
    batch = pa.record_batch([pa.array(ups), pa.array(vectors.tolist(), pa.list_(pa.float64()))], ["ups", "embedding"])
    out = list(embed._lifted(iter([batch])))
    assert len(out) > 5 and max(b.num_rows for b in out) <= 9
    sums: dict = {}
    for b in out:
        for of, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            sums[of] = sums.get(of, 0) + np.array(part)
    assert len(sums) == 60 and all(np.allclose(sums[f"p{i}"], vectors[i * 3 : i * 3 + 3].sum(0) / 2) for i in range(40)) and all(np.allclose(sums[f"r{i}"], vectors[i * 6 : i * 6 + 6].sum(0) / 4) for i in range(20))


def test_chunks_are_handed_on_within_a_batch(monkeypatch):
    monkeypatch.setattr(chunk, "HELD", 100)
    texts = ["one two three four", None, "", "five six seven"] * 20
    batch = pa.record_batch([pa.array(range(80)), pa.array(texts)], ["id", "text"])
    fn = chunk.splitter("recursive", chunk_size=8, chunk_overlap=0)
    out = list(chunk._batched(fn)(iter([batch])))
    assert len(out) > 5 and max(sum(map(len, b.column(2).to_pylist())) for b in out) < 130
    want = [(i, n, t) for i, text in enumerate(texts) for n, t in enumerate(fn(text) if text else [])]
    assert [r for b in out for r in zip(*(c.to_pylist() for c in b.columns), strict=True)] == want


def test_counts_are_handed_on_within_a_batch(monkeypatch):
    monkeypatch.setattr(blockmax, "COUNTED", 10)
    batch = pa.record_batch([pa.array(range(50), pa.int64()), pa.array(["a b c b", " ", None, "d e f", "a"] * 10)], ["seq", "text"])
    out = list(blockmax._counted(iter([batch])))
    assert len(out) > 4 and sum(b.num_rows for b in out) == 30
    first = out[0].to_pylist()[0]
    assert first == {"seq": 0, "len": 4, "terms": ["a", "b", "c"], "tfs": [1, 2, 1]}


def test_files_of_the_stream_follow_the_table(spark, tmp_path, monkeypatch):
    """A table read in many parts comes as many files, so that no task writes a third of it."""
    spark.range(400).selectExpr("id doc_id", "concat('w', id % 5) text", "'s' source").repartition(9).write.parquet(str(tmp_path / "documents.parquet"))
    seen = []

    def stop(spark, source, *rest):
        seen.append(len(spark.read.parquet(source).inputFiles()))
        raise InterruptedError

    monkeypatch.setattr(session, "ingest", stop)
    parts = catalogue.corpus(spark, str(tmp_path)).rdd.getNumPartitions()
    with pytest.raises(InterruptedError):
        catalogue.QUERIES["incremental_postings"](spark, str(tmp_path))
    assert parts > 3 and seen == [parts]
