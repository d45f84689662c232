"""op1: the model, its bar and its rare words come from the lines of all texts."""
from postlens.llm import licenses


def test_every_line_is_counted(spark):
    rows = [(i, f"the house of number {i}\nunder the tree\n\nGPL stands here {i % 7}") for i in range(1500)]
    rows += [(None, "the house"), (1, None), (2, ""), (3, "the house"), (3, "the house")]
    got = licenses.line_vectors(spark.createDataFrame(rows, "doc_id long, text string"), ["gpl", "house of", "the", "under", "under the"], [["under", "the", "tree"]])
    assert {tuple(r.found): r.n for r in got.collect()} == {("house of", "the"): 1500, ("gpl",): 1500, ("the",): 3}


def test_a_word_that_is_common_after_the_first_documents_is_no_anchor(spark):
    few = [(i, f"a line of prose number {i}") for i in range(400)]
    many = [(400 + i, f"mpl{i} and isc stand in prose {i}") for i in range(1200)]
    anchors = licenses.train(spark.createDataFrame(few + many, "doc_id long, text string"), variants=4, steps=5)[-1]
    assert "isc" not in anchors and "mpl" in anchors
