"""The pipeline on the smallest tables: every stage against what brute force keeps."""

import pytest

pytest.importorskip("llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from llm import secret_scan  # noqa: E402

from .test_operators import brute_components, plain  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "benchmark", "secrets", "pieces"]
    state = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in state.collect()}
        state = corpus_pipeline.materialize(stage(spark, state, SF), "test")
        after = {r["doc_id"]: r for r in state.collect()}
        assert set(after) <= set(before)
        if name == "near_copies":
            assert set(after) == {i for i, (_, c) in brute_components([(i, r["text"]) for i, r in before.items()]).items() if c == i}
        if name == "benchmark":
            windows = set()
            for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
                w = plain(r["text"])
                n = min(10, len(w))
                windows |= {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set()
            sizes = {len(w) for w in windows}
            dirty = {i for i, r in before.items() if any(tuple(w[j : j + n]) in windows for w in [plain(r["text"])] for n in sizes for j in range(len(w) - n + 1))}
            assert set(after) == set(before) - dirty
        if name == "secrets":
            assert set(after) == set(before) and all(r["text"] == secret_scan.redact(before[i]["text"]) and r["n_chars"] == len(r["text"]) for i, r in after.items())
        if name != "pieces":
            assert state.columns == docs.columns
    assert all(r["piece_ids"] for r in state.collect())
    assert len(after) > 0.7 * docs.count()
