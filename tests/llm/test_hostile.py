"""One table of everything awkward through every operator and every stage: output names as extra columns, null and repeated
keys, keys of text, null, empty and very long texts, and no rows at all."""

import pytest

pytest.importorskip("llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402

from llm import decontaminate, jaccard_join, license_scan, quality_rules, secret_scan, sentencepiece_codec, substring_dedup, toxicity, url_filter  # noqa: E402

SF = "/root/testdata/sf0.001"
#: Names of results and of inner columns, as columns of the input.
CLASHES = """n_words n_removed kept host path rule verdict block_score quality base_failed word_chars n_symbols n_dup_lines n_repeat_words n_shingles component_id doc n one two key score
held_out predicted spans n_base first_word last_word base_labels labels text_md5 hits n_hit n_items piece_ids decoded anchor item_id prefix tokens""".split()
LONG = " ".join(f"w{i}" for i in range(200_000))
TEXTS = [("a", "plain words of a text " * 12), ("b", "plain words of a text " * 12), ("a", "plain words of a text " * 12), (None, "plain words of a text " * 12), (None, None), ("c", None), ("d", ""), ("d", " \n\t "), ("e", LONG), ("f", "Σ ß \U0001F600 | * # é"), ("f", "another text of the same key")]


@pytest.fixture(scope="module")
def awkward(spark):
    base = spark.createDataFrame(TEXTS, "doc_id string, text string")
    return base.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


def stages(spark):
    bench = spark.createDataFrame([("i", "another text of the same key"), (None, "x"), ("j", None), ("k", "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15")], "item_id string, text string")
    model = toxicity.train(["bad words here", "nice words here"] * 8, [1, 0] * 8)
    return {
        "dedup": lambda df: substring_dedup.remove_repeats(df),
        "urls": lambda df: url_filter.filter_urls(df, url="text"),
        "quality": lambda df: quality_rules.judge_quality(df),
        "jaccard": lambda df: jaccard_join.near_duplicates(df),
        "pieces": lambda df: sentencepiece_codec.decode_pieces(sentencepiece_codec.encode_pieces(df)),
        "toxicity": lambda df: toxicity.score_toxicity(df, model),
        "secrets": lambda df: secret_scan.scan_secrets(df),
        "redacted": lambda df: secret_scan.redact_secrets(df),
        "licenses": lambda df: license_scan.scan_licenses(df),
        "kept": lambda df: jaccard_join.keep_one_each(df),
        "clean": lambda df: decontaminate.decontaminate(df, bench),
    }


@pytest.mark.parametrize("name", ["dedup", "urls", "quality", "jaccard", "pieces", "toxicity", "secrets", "redacted", "licenses", "kept", "clean"])
def test_awkward_rows(spark, awkward, name):
    run = stages(spark)[name]
    rows = run(awkward).collect()
    if name in ("kept", "clean"):
        # of the equal texts b goes, repeated rows of a and the nameless one stay; the benchmark drops the long text and one row of f
        assert len(rows) == len(TEXTS) - (1 if name == "kept" else 2), sorted((r["doc_id"] or "", (r["text"] or "")[:20]) for r in rows)
        assert set(rows[0].asDict()) == set(awkward.columns)
    else:
        assert len(rows) == len(TEXTS)
    assert len({len(r) for r in rows}) == 1 and run(awkward.limit(0)).count() == 0


def test_dedup_and_jaccard_of_awkward_rows(spark, awkward):
    removed = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in substring_dedup.remove_repeats(awkward).collect()}
    assert removed[("b", 60)] == 60 and removed[("a", 60)] == 0 and removed[(None, 60)] == 0 and removed[("e", 200_000)] == 0
    found = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard_join.near_duplicates(awkward).collect()}
    assert found[("b", 5)] == found[("a", 5)] == "a" and found[(None, 5)] is None and found[("e", 199_996)] == "e" and found[("d", 0)] == "d"


def test_pipeline_stages_of_awkward_rows(spark, awkward):
    names = {"a": 1, "b": 2, "c": 3, "d": 4, "e": 5, "f": 6}
    number = F.coalesce(*[F.when(F.col("doc_id") == k, v) for k, v in names.items()]).cast("long")
    docs = awkward.withColumn("doc_id", number).withColumn("n_chars", F.char_length("text").cast("long")).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), "n_chars", "score", "hits", "key", "n")
    for which, most in ((docs, len(TEXTS)), (docs.limit(0), 0)):
        state = which
        for name, stage in corpus_pipeline.STAGES:
            state = corpus_pipeline.materialize(stage(spark, state, SF), f"awkward-{name}")
            assert state.count() <= most and set(docs.columns) <= set(state.columns)
        assert not most or state.where("doc_id = 5").first()["piece_ids"]
