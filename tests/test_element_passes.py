import json

import pytest

from waypost.sources.elements import read_elements


def save(tmp_path, *documents):
    for k, d in enumerate(documents):
        (tmp_path / f"d{k}.json").write_text(json.dumps(d))
    return f"file://{tmp_path}"


def test_texts_are_not_shuffled(spark, tmp_path):
    """Documents that lie in one block are read by the task that has the block; only counts are put in order."""
    found = read_elements(spark, save(tmp_path, {"rows": [{"a": i} for i in range(30)]}, {"rows": [{"a": 30}]}))
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert [json.loads(r.text)["a"] for r in found.orderBy("ordinal").collect()] == list(range(31))


@pytest.mark.parametrize("block", ["40", "128m"])
def test_key_of_mixed_arrays_and_odd_names(spark, tmp_path, block):
    """A plain value before an object does not move it to another key; a key may hold braces."""
    path = save(tmp_path, {"x": {"b": 0}, "rows": [1, "}{", {"a": 1}, 2, {"a": 2}], "y": [[{"c": [{}]}], {"d": 1}]})
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = read_elements(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [("rows", 0, {"a": 1}), ("rows", 1, {"a": 2}), ("x", 0, {"b": 0}), ("y", 0, {"d": 1})]
    assert sorted(((r.key, r.ordinal, json.loads(r.text)) for r in got), key=lambda r: r[:2]) == want


def test_key_with_a_brace(spark, tmp_path):
    got = read_elements(spark, save(tmp_path, {"x": {"b": 0}, "a}b{": [{"a": 1}]})).collect()
    assert sorted((r.key, r.ordinal) for r in got) == [("a}b{", 0), ("x", 0)]
