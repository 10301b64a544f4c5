"""Functions on texts, JSON values and failures against plain Python versions of their definitions."""

import json

import pytest
from pyspark.sql import functions as F

from tracelake.functions import text as T
from tracelake.functions.contracts import UNEVALUABLE, Unevaluable, contract_issues, string_leaves, violations
from tracelake.functions.failures import strictly_decoded, widely_decoded


def values(spark, column, texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(column(F.col("t"))).collect()]


def test_templates(spark):
    texts = ["x at /usr/lib/a.py  line 12\u00a0now", "id 0xdeadbeef1 12345678 x12", "C:\\a\\b\\c.txt fails", None, ""]
    assert values(spark, T.error_template, texts) == ["x at <path> line <n> now", "id <id> <id> x1<n>", "<path> fails", None, ""]
    assert values(spark, T.error_template, ["failed 12 times, -3.5e2 left"]) == ["failed <n> times, <n> left"]


def test_head_tail(spark):
    long = "a" * 600 + "b" * 600
    cut = values(spark, lambda c: T.head_tail(c, 500), [long, "short", None])
    rest = 500 - len(T.OMITTED)
    assert cut == [long[: (rest + 1) // 2] + T.OMITTED + long[-(rest // 2) :], "short", None]
    with pytest.raises(ValueError):
        T.head_tail(F.col("t"), 79)


def test_failure_message(spark):
    trace = "Traceback (most recent call last):\n  File x\nValueError: bad\n  more"
    found = values(spark, lambda c: T.failure_message(c, F.when(c.startswith("Trace"), "python_traceback").otherwise("m")), [trace, "\n\n first line \nsecond", "", "Traceback only"])
    assert found == ["ValueError: bad", "first line", "m", "Python traceback"]


STRICT = [
    ('{"isError": true}', "structured_error_flag"), ('{"isError": "true"}', None), ('{"success": false}', "structured_error_flag"), ('{"success": "false"}', None),
    ('{"error": "x"}', "structured_error_value"), ('{"error": ""}', None), ('{"error": null}', None), ('{"error": []}', None), ('{"error": false}', None), ('{"error": {}}', "structured_error_value"),
    ('{"status": "Failed"}', "structured_error_status"), ('{"status": " failed"}', None), ('{"result": {"success": false}}', "nested_error_flag"),
    ('"Process exited with code 3"', "shell_exit_code_3"), ('"error: x\\nProcess exited with code 0"', None), ('" Error: no"', "error_prefix"), ('"{\\"isError\\": true}"', "structured_error_flag"), ("3", None), ("null", None),
]


def test_strict_decoder(spark):
    df = spark.createDataFrame([(i, j) for i, (j, _) in enumerate(STRICT)], "i int, j string").withColumn("v", F.parse_json("j"))
    def markers(error, outcome=None):
        rows = df.select("i", F.col("v").alias("output"), F.lit("t").alias("tool"), F.lit(error).cast("boolean").alias("explicit_error"), F.lit(outcome).cast("string").alias("outcome_marker"))
        return [r.marker for r in strictly_decoded(rows).orderBy("i").select("marker").collect()]

    assert markers(None) == [m for _, m in STRICT]
    assert set(markers(False)) == {None} and set(markers(True, "m")) == {"m"} and set(markers(True)) == {"explicit_error_field"}


FEATURE = [
    ('{"is_error": true}', "structured_error_flag"), ('{"ok": false}', "structured_unsuccessful"), ('{"status": " Crashed "}', "structured_status_crashed"),
    ('{"exit_code": 2}', "nonzero_exit_code"), ('{"exit_code": true}', "nonzero_exit_code"), ('{"returncode": 0.5}', None), ('{"error": "x"}', None),
    ('"failed - x"', "tool_output_error_prefix"), ('"{\\"isError\\": true}"', None), ("null", None),
]


def test_feature_decoder(spark):
    df = spark.createDataFrame([(i, j) for i, (j, _) in enumerate(FEATURE)], "i int, j string").withColumn("v", F.parse_json("j"))
    def markers(error):
        rows = df.select("i", F.col("v").alias("output"), F.lit("t").alias("tool"), F.lit(error).cast("string").alias("error"))
        return [r.marker for r in widely_decoded(rows).orderBy("i").select("marker").collect()]

    assert markers(None) == [m for _, m in FEATURE] and set(markers("e")) == {"span_error"}


def test_contracts(spark):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 2}, "b": {"enum": ["x", 1]}}, "additionalProperties": False}
    assert violations({"b": "y", "c": 1, "d": 2}, schema) == [("required", "$"), ("enum", "$.b"), ("additionalProperties", "$")]
    assert violations({"a": 1}, schema) == [("minimum", "$.a")]
    assert violations({"a": True}, schema) == [("type", "$.a")]
    assert violations({"a": 2.0}, schema) == []
    for rule, good, bad in (
        ({"$defs": {"n": {"type": "integer"}}, "properties": {"a": {"$ref": "#/$defs/n"}}}, {"a": 1}, {"a": "x"}), ({"not": {"required": ["a"]}}, {}, {"a": 1}),
        ({"patternProperties": {"^x": {"type": "string"}}, "additionalProperties": False}, {"x1": "s"}, {"y": 1}), ({"if": {"required": ["a"]}, "then": {"required": ["b"]}}, {"c": 1}, {"a": 1}),
        ({"properties": {"a": {"prefixItems": [{"type": "integer"}], "items": {"type": "string"}}}}, {"a": [1, "x"]}, {"a": [1, 2]}), ({"propertyNames": {"maxLength": 1}}, {"a": 1}, {"ab": 1}),
        ({"properties": {"a": {"uniqueItems": True, "contains": {"const": 1}}}}, {"a": [1, 2]}, {"a": [2, 2]}), ({"dependentRequired": {"a": ["b"]}}, {"b": 1}, {"a": 1}),
        ({"properties": {"a": {"multipleOf": 0.5}}}, {"a": 1.5}, {"a": 1.2}), ({"oneOf": [{"required": ["a"]}, {"required": ["b"]}]}, {"a": 1}, {"a": 1, "b": 2}),
    ):
        assert violations(good, rule) == [] and violations(bad, rule), rule
    for unknown in ({"$ref": "#/x"}, {"$ref": "http://x"}, {"$ref": "#nowhere"}, {"$ref": "#"}, {"properties": 3}):
        with pytest.raises(Unevaluable):
            violations({"a": 1}, unknown)
    assert violations({"a": 1}, {"x-own": 3, "format": "date"}) == []
    df = spark.createDataFrame([('{"a": "x"}', json.dumps(schema)), (None, "{}"), ("{}", "null"), ("{}", '{"$ref": "#/x"}'), ("{}", "3")], "a string, s string")
    assert [[x.issue for x in r[0]] for r in df.select(contract_issues("a", "s")).collect()] == [["argument_type_mismatch"], [], [], [UNEVALUABLE], [UNEVALUABLE]]
    leaves = df.limit(1).select(string_leaves(F.lit('{"a": {"b": ["x", 1, {"c": "y"}]}}'))).first()[0]
    assert [tuple(x) for x in leaves] == [("$.a.b[0]", "0", "x"), ("$.a.b[2].c", "c", "y")]
    leaves = df.limit(1).select(string_leaves(F.lit('{"reference": ["abc"], "user.id": "x", "odd]": "y", "a[b": "z"}'))).first()[0]
    assert [(x.path, x.name) for x in leaves] == [("$.reference[0]", "0"), ("$.user.id", "id"), ("$.odd]", "odd"), ("$.a[b", "b")]


#: (schema, what it holds for, what it doesn't hold for, the keyword that is broken)
ANNOTATED = [
    ({"properties": {"a": {}}, "unevaluatedProperties": False}, {"a": 1}, {"a": 1, "b": 2}, "unevaluatedProperties"),
    ({"properties": {"a": {}}, "unevaluatedProperties": {"type": "string"}}, {"a": 1, "b": "x"}, {"b": 2}, "type"),
    ({"unevaluatedProperties": False, "allOf": [{"properties": {"a": {}}}, {"patternProperties": {"^x": {}}}]}, {"a": 1, "x1": 2}, {"y": 1}, "unevaluatedProperties"),
    # Only schemas that hold have looked at something.
    ({"anyOf": [{"properties": {"a": {"const": 1}}, "required": ["a"]}, {"properties": {"b": {}}, "required": ["b"]}], "unevaluatedProperties": False}, {"a": 1, "b": 2}, {"a": 2, "b": 2}, "unevaluatedProperties"),
    ({"oneOf": [{"required": ["a"], "properties": {"a": {}}}, {"required": ["b"], "properties": {"b": {}}}], "unevaluatedProperties": False}, {"a": 1}, {"a": 1, "c": 1}, "unevaluatedProperties"),
    ({"if": {"properties": {"k": {"const": 1}}, "required": ["k"]}, "then": {"properties": {"a": {}}}, "else": {"properties": {"b": {}}}, "unevaluatedProperties": False}, {"k": 1, "a": 2}, {"k": 1, "b": 2}, "unevaluatedProperties"),
    ({"not": {"properties": {"a": {}}, "required": ["z"]}, "unevaluatedProperties": False}, {}, {"a": 1}, "unevaluatedProperties"),
    ({"$ref": "#/$defs/x", "$defs": {"x": {"properties": {"a": {}}}}, "unevaluatedProperties": False}, {"a": 1}, {"b": 1}, "unevaluatedProperties"),
    ({"dependentSchemas": {"a": {"properties": {"a": {}, "b": {}}}}, "unevaluatedProperties": False}, {"a": 1, "b": 1}, {"b": 1}, "unevaluatedProperties"),
    ({"dependentSchemas": {"a": {"required": ["b"]}}}, {"a": 1, "b": 1}, {"a": 1}, "required"),
    ({"additionalProperties": True, "unevaluatedProperties": False}, {"b": 1}, None, None),
    # What a property's own schema looked at says nothing about the object around it.
    ({"properties": {"a": {"properties": {"b": {}}}}, "unevaluatedProperties": False}, {"a": {"b": 1}}, {"a": {}, "b": 1}, "unevaluatedProperties"),
    ({"prefixItems": [{}], "unevaluatedItems": False}, [1], [1, 2], "unevaluatedItems"),
    ({"prefixItems": [{}], "contains": {"type": "string"}, "unevaluatedItems": False}, [1, "x", "y"], [1, "x", 2], "unevaluatedItems"),
    ({"allOf": [{"prefixItems": [{}, {}]}], "unevaluatedItems": {"type": "null"}}, [1, 2, None], [1, 2, 3], "type"),
    ({"items": {}, "unevaluatedItems": False}, [1, 2], None, None),
    ({"$defs": {"x": {"$anchor": "here", "type": "string"}}, "$ref": "#here"}, "s", 1, "type"),
    ({"$id": "https://h/root", "$defs": {"x": {"$id": "part", "$defs": {"y": {"$anchor": "in", "type": "integer"}}}}, "$ref": "part#in"}, 1, "s", "type"),
    ({"$id": "https://h/root", "$defs": {"x": {"$id": "part", "$defs": {"y": {"const": 3}}}}, "$ref": "https://h/part#/$defs/y"}, 3, 4, "const"),
    # A tree whose nodes are extended: the outermost $dynamicAnchor decides what its children are.
    (
        {
            "$id": "https://h/strict", "$dynamicAnchor": "node", "$ref": "tree", "unevaluatedProperties": False,
            "$defs": {"tree": {"$id": "https://h/tree", "$dynamicAnchor": "node", "properties": {"data": {}, "children": {"items": {"$dynamicRef": "#node"}}}}},
        },
        {"data": 1, "children": [{"data": 2, "children": []}]}, {"children": [{"daat": 2}]}, "unevaluatedProperties",
    ),
    # Numbers are equal by value, and booleans aren't numbers.
    ({"enum": [1]}, 1.0, True, "enum"), ({"const": 1.0}, 1, "1", "const"), ({"const": {"a": [1, 0]}}, {"a": [1.0, 0]}, {"a": [1, False]}, "const"),
    ({"uniqueItems": True}, [1, True, "1", None], [1, 1.0], "uniqueItems"), ({"uniqueItems": True}, [{"a": 1, "b": 2}, {"a": 1}], [{"a": 1, "b": 2}, {"b": 2.0, "a": 1}], "uniqueItems"),
    ({"multipleOf": 0.1}, 0.3, 0.35, "multipleOf"), ({"multipleOf": 0.01}, 1e20, 0.001, "multipleOf"), ({"multipleOf": 3}, 1e300 - 1e300, 10**30 + 1, "multipleOf"),
    # Earlier drafts.
    ({"$schema": "http://json-schema.org/draft-07/schema#", "dependencies": {"a": ["b"]}}, {"a": 1, "b": 1}, {"a": 1}, "dependencies"),
    ({"$schema": "http://json-schema.org/draft-07/schema#", "items": [{"type": "string"}], "additionalItems": False}, ["x"], ["x", 1], "additionalItems"),
    ({"$schema": "http://json-schema.org/draft-07/schema#", "properties": {"a": {"$ref": "#/definitions/x", "type": "string"}}, "definitions": {"x": {"type": "integer"}}}, {"a": 1}, {"a": "x"}, "type"),
    ({"$schema": "http://json-schema.org/draft-04/schema#", "minimum": 2, "exclusiveMinimum": True}, 3, 2, "exclusiveMinimum"),
    ({"dependencies": {"a": ["b"]}}, {"a": 1}, None, None),
]


@pytest.mark.parametrize("case", range(len(ANNOTATED)))
def test_contracts_with_annotations(case):
    schema, good, bad, keyword = ANNOTATED[case]
    assert violations(good, schema) == []
    if keyword:
        assert {k for k, _ in violations(bad, schema)} == {keyword}


def test_remembered_issues_are_bounded(monkeypatch):
    from tracelake.functions import contracts

    monkeypatch.setattr(contracts, "REMEMBERED", 10_000)
    issues = contracts.Issues()
    for i in range(2000):
        assert issues[json.dumps({"a": i, "pad": "x" * (i % 200)}), '{"required": ["b"]}'] == [{"issue": "missing_required_argument", "keyword": "required", "path": "$"}]
        assert issues.size <= 10_000 and sum(len(v) for v, _ in issues) == issues.size


def test_decoders_of_long_codes(spark):
    texts = ["Process exited with code 99999999999999999999", "Process exited with code -007", "Process exited with code 000", "Process exited with code 0000000000000000000001", "process EXITED with code 0\nError: x"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(
        "i", F.lit("t").alias("tool"), F.parse_json(F.to_json(F.struct("t"))).alias("whole"),
    )
    df = df.withColumn("output", F.try_variant_get("whole", "$.t", "variant")).withColumns({"explicit_error": F.lit(None).cast("boolean"), "outcome_marker": F.lit(None).cast("string")})
    assert [r.marker for r in strictly_decoded(df).orderBy("i").collect()] == ["shell_exit_code_99999999999999999999", "shell_exit_code_-7", None, "shell_exit_code_1", None]
    codes = ['{"exit_code": 1e300}', '{"returncode": -1e300}', '{"exit_code": 0.5}', '{"exit_code": 123456789012345678901234567890}', '{"exit_code": 0}', '{"exit_code": true}', '{"exit_code": -1.5}']
    df = spark.createDataFrame(list(enumerate(codes)), "i int, j string").select("i", F.lit("t").alias("tool"), F.parse_json("j").alias("output"), F.lit(None).cast("string").alias("error"))
    wrong = "nonzero_exit_code"
    assert [r.marker for r in widely_decoded(df).orderBy("i").collect()] == [wrong, wrong, None, wrong, None, wrong, wrong]


CANONICAL = [
    '{"b":1,"a":1.0}', '{"a":[1,1.0,1.50,1e2,0.1,12345678901234567890,-0.5,1E5]}', "[1.0,1]", "[1,1.0]", "3", "3.0", '"1.0"', "null", "true", '{"é":"中 \\u2028 \\"q\\" \\\\ \\n"}', "{}", "[]", '{"z":{"y":[{"x":2.0}]}}',
    '{"\\ud83d\\ude00":1,"\\uff5e":2,"a":3}', "123456789012345678901234567890", "0.000001", "1e-7", "1234567.25",
]


def test_canonical_json(spark):
    """Against Python's own reading and writing of the text."""
    df = spark.createDataFrame(list(enumerate([*CANONICAL, None])), "i int, j string").withColumn("v", F.parse_json("j"))
    got = [r.c for r in df.select("i", T.canonical_json(F.col("v")).alias("c")).orderBy("i").collect()]
    assert got == [json.dumps(json.loads(j), ensure_ascii=False, sort_keys=True, separators=(",", ":")) for j in CANONICAL] + [None]


def test_fingerprints_tell_number_forms(spark):
    texts = ['{"a":1}', '{"a":1.0}', '{"a":"1"}', '{"a":[1]}', '{"a":[1.0]}', '{"b":1}', '{"a":1,"b":1.0}', '{"a":1.0,"b":1}', '{"a":1.5}', '{ "a" : 1.50 }']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, j string")
    prints = [r.f for r in df.select("i", T.fingerprint(F.parse_json("j")).alias("f")).orderBy("i").collect()]
    assert len(set(prints)) == len(texts) - 1 and prints[-1] == prints[-2]
