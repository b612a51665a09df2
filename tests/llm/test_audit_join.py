from conftest import plan_of

from tablegauge.llm import audit


def test_labels_are_not_gathered_on_the_driver(spark):
    """The labels and their copies grow with the corpus, whatever their file's size."""
    docs = spark.createDataFrame([(i, f"text {i}", "a") for i in range(6)], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(4)], "doc_id bigint, quality int, toxic int")
    labelled = audit.with_labels(audit.failure_rows(docs), labels)
    assert {(r["doc_id"], r["good"], r["toxic"]) for r in labelled.collect()} == {(i, i in (1, 3), False) for i in range(6)}
    plan = plan_of(labelled)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
