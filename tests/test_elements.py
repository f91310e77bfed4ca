import json
import random

import pytest

from waypost.sources.elements import read_elements

ODD = ["", "}", "}{", "}{}{ }", "{", "[{", "}]", '"', "\\", '\\"}', "a\\\\", "é\U0001f600", "\n", '":[{', "x" * 300]


def value(rng, depth=0):
    kind = rng.randint(0, 7 if depth < 3 else 4)
    if kind < 3:
        return rng.choice(ODD)
    if kind == 3:
        return rng.choice([None, True, 1.5, -3])
    if kind == 4:
        return [[1, 2], [[3]]]
    if kind == 5:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(ODD): value(rng, depth + 1) for _ in range(rng.randint(0, 3))}


def thing(rng):
    return {k: value(rng) for k in rng.sample(["a", "b", *ODD], rng.randint(0, 4))}


def document(rng):
    out = {"text": rng.choice(ODD), "none": None, "numbers": [1, [2, 3]]}
    for key in rng.sample(["rows", "more", "one", "two"], rng.randint(0, 4)):
        out[key] = thing(rng) if key in ("one", "two") else [thing(rng) for _ in range(rng.randint(0, 8))]
        out[f"{key} is"] = rng.choice([*ODD, 4, []])
    return out


def expected(documents):
    seen, out = {}, []
    for d in documents:
        for key, v in d.items():
            for e in [v] if isinstance(v, dict) else v if isinstance(v, list) else []:
                if isinstance(e, dict):
                    out.append((key, seen.get(key, 0), e))
                    seen[key] = seen.get(key, 0) + 1
    return sorted(out, key=lambda r: r[:2])


@pytest.mark.parametrize("block", ["64", "700", "128m"])
def test_documents_in_blocks(spark, tmp_path, block):
    rng = random.Random(block)
    documents = [document(rng) for _ in range(12)]
    for k, d in enumerate(documents):
        text = json.dumps(d, ensure_ascii=bool(k % 2), indent=[None, 1, 4][k % 3])
        (tmp_path / f"d{k:03}.json").write_text(" \n" * (k % 2) + text + "\n" * (k % 3), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = read_elements(spark, f"file://{tmp_path}").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(((r.key, r.ordinal, json.loads(r.text)) for r in got), key=lambda r: r[:2]) == expected(documents)


@pytest.mark.parametrize("cut", ['{"rows": [{"a": 1}', '{"rows": [{"a": "b', '{"rows": [{"a": 1}]', '{"rows": [{"a": {"b": 1}, ', '{"rows": [{"a": 1}]}}'])
def test_documents_that_end_early(spark, tmp_path, cut):
    (tmp_path / "d.json").write_text(cut)
    with pytest.raises(ValueError, match="not a whole JSON document"):
        read_elements(spark, f"file://{tmp_path}/d.json")


def test_documents_without_elements(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    (tmp_path / "b.json").write_text('{"rows": [], "x": 1}\n')
    assert read_elements(spark, f"file://{tmp_path}").count() == 0
