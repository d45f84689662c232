"""Filtering stages on tables whose columns have the names used inside, or lack n_chars."""
import pytest

from postlens.llm import mixing, setsketch, suffix, toxicity

NAMES = ["_toxicity", "_id", "_spans", "_r", "mix_id", "mix_more", "mix_words", "__id"]
STAGES = {
    "toxicity": lambda d, labels: toxicity.without_toxic(d, labels),
    "setsketch": lambda d, labels: setsketch.representatives(d),
    "suffix": lambda d, labels: suffix.without_repeats(d),
    "mixing": lambda d, labels: mixing.mixed_documents(d),
}


@pytest.mark.parametrize("stage", STAGES)
def test_extra_columns_survive(spark, stage):
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    passage = " ".join(f"same{i}" for i in range(60))
    rows = [(1, "first " + passage, "a"), (2, passage + " and " + " ".join(f"other{i}" for i in range(90)), "b"), (3, None, None), (4, "", "a")]
    rows = [(*r, *(f"{n}{r[0]}" for n in NAMES)) for r in rows]
    schema = "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in NAMES)
    docs = spark.createDataFrame(rows, schema)
    out = STAGES[stage](docs, labels)
    assert out.columns == docs.columns
    got = out.collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4}
    assert all(r[n] == f"{n}{r.doc_id}" for r in got for n in NAMES)


def test_the_sample_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i}") for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    positive, unlabelled, _ = toxicity._sample(docs, labels, 10, 12)
    assert len(positive) == 10 and len(unlabelled) == 12
