import pytest
from pyspark.sql import functions as F

from rosterlens.functions import variants as W


@pytest.mark.parametrize(
    ("raw", "kind", "text", "items"),
    [
        ('{"a": "x"}', "scalar", "x", ["x"]), ('{"a": 5}', "scalar", "5", ["5"]), ('{"a": true}', "scalar", "true", ["true"]), ('{"a": ["x", null, 2]}', "list", "x", ["x", "2"]), ('{"a": []}', "list", None, []),
        ('{"a": [{"name": "n"}, {"b": 1}]}', "list", '{"name":"n"}', ["n", '{"b":1}']), ('{"a": {"name": "n", "z": 1}}', "object", "n", ["n"]), ('{"a": {"z": 1}}', "object", '{"z":1}', ['{"z":1}']), ('{"a": null}', None, None, []), ("{}", None, None, []),
        ('{"a": ', None, None, []), ("no object", None, None, []), (None, None, None, []), ("", None, None, []), ('text ```json\n{"a": "fenced"}\n``` text', "scalar", "fenced", ["fenced"]), ('{"a": "x"} {"a": "y"}', None, None, []),
    ],
)
def test_values(value, raw, kind, text, items):
    assert value(lambda r: W.kind(W.parse(r), "$.a"), r=raw) == kind
    assert value(lambda r: W.text(W.parse(r), "$.a"), r=raw) == text
    assert value(lambda r: W.items(W.parse(r), "$.a"), r=raw) == items


def test_schema(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": 2, "b": ["x"]}',), ("broken",)], "r string")
    assert W.schema(df, W.parse(F.col("r"))).first()["schema"] == "OBJECT<a: BIGINT, b: ARRAY<STRING>>"
