"""Leaves of JSON on variants, against the reading of one text at a time."""

import json
import random

from quarry.operators import extract
from quarry.operators.json_leaves import leaves

SCHEMA = "path string, text string, key string, value long"


def got(spark, texts):
    rows = spark.createDataFrame([(f"p{k}", t, "clash", k) for k, t in enumerate(texts)], SCHEMA)
    return sorted((r.path, r.key, r.value) for r in leaves(rows).collect())


def expected(texts):
    return sorted(r[:3] for k, t in enumerate(texts) if t is not None for r in extract.flatten_json(f"p{k}", t))


def grown(rng, depth):
    kind = rng.random()
    if depth and kind < 0.45:
        return {rng.choice("abcdef") * rng.randint(1, 3) + str(i): grown(rng, depth - 1) for i in range(rng.randint(0, 5))}
    if depth and kind < 0.65:
        return [grown(rng, depth - 1 if rng.random() < 0.3 else 0) for _ in range(rng.randint(0, 14))]
    return rng.choice([None, True, False, 0, -7, 10**12, 2.5, 1.25, 3.0, "", "x", 'é "quoted"\n', "1", "a.b"])


def test_leaves_equal_one_text_at_a_time(spark):
    rng = random.Random(8)
    texts = [json.dumps(grown(rng, 6), ensure_ascii=rng.random() < 0.5) for _ in range(250)]
    texts += [None, "", "{broken", "null", "7", '"x"', "[]", "[1, [2]]", "{}", '{"": {"": 1}}', '{"a": 1e3, "b": 12345678901234567890}', texts[0], texts[0]]
    rows = expected(texts)
    assert len(rows) > 400 and got(spark, texts) == rows


def test_deep_and_wide_texts(spark):
    deep = '{"k":' * 25 + "1" + "}" * 25
    wide = json.dumps({f"f{i}": "long " * 200 if i % 50 == 0 else i for i in range(3000)})
    assert got(spark, [deep, wide]) == expected([deep, wide])


def test_no_rows(spark):
    assert got(spark, ['{"a": 1, "a": 2}', None]) == []
    assert leaves(spark.createDataFrame([], SCHEMA)).collect() == []
