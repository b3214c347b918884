"""Conditions: two-valued for missing, scalar and array fields, negated or not."""

import pytest

from capturelake.plans.predicates import Condition, compile_conditions, field_catalog, like_pattern, match
from capturelake.plans.recipe import Step, run

SCHEMA = "id string, label string, packets long, protocols array<string>, flag boolean, deep struct<x: struct<y: int>>"
ROWS = [("a", "alpha-server", 100, ["DNS", "TCP"], True, ((1,),)), ("b", "BETA-host", 5, ["UDP"], False, None), ("c", None, None, None, None, None), ("d", "", 0, [], None, ((None,),))]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize(
    ("condition", "want"),
    [
        (("packets", ">", 4), "ab"), (("packets", "<", 1), "cd"), (("packets", "!=", 5), "acd"), (("packets", "=", "x"), ""), (("label", "!=", "x"), ""), (("missing", "<=", 0), "abcd"),
        (("deep.x.y", "=", 1), "a"), (("total", ">", -1), "abcd"), (("protocols", "count_gt", 1), "a"), (("protocols", "count_eq", 0), "cd"), (("label", "count_gt", 9), "a"),
        (("protocols", "contains", "DNS"), "a"), (("protocols", "contains_all", ["DNS", "UDP"]), ""), (("protocols", "contains_any", ["DNS", "UDP"]), "ab"), (("label", "contains", "alpha"), ""),
        (("protocols", "is_empty"), "cd"), (("label", "is_empty"), "c"), (("label", "not_empty"), "abd"), (("label", "equals", "beta-HOST"), "b"), (("protocols", "starts_with", "ud"), "b"),
        (("label", "ends_with", "SERVER"), "a"), (("label", "matches", "^al.*r$"), "a"), (("label", "matches", "("), ""), (("label", "like", "BETA%"), "b"), (("label", "like", "beta%"), ""),
        (("label", "like", r"alpha\-serve_"), "a"), (("flag", "is_true"), "a"), (("flag", "is_false"), "bcd"), (("protocols", "is_true"), "ab"), (("label", "is_true"), "ab"), (("packets", "is_false"), "cd"),
    ],
)
def test_conditions(nodes, condition, want):
    ids = {r["id"] for r in match(nodes, [Condition(*condition)]).collect()}
    assert ids == set(want)
    assert {r["id"] for r in match(nodes, [Condition(*condition, negate=True)]).collect()} == set("abcd") - set(want)


def test_like_is_literal_but_for_its_signs(spark):
    df = spark.createDataFrame([("a.c",), ("abc",), ("a\nc",)], "id string")
    assert [r["id"] for r in match(df, [Condition("id", "like", "a.c")]).collect()] == ["a.c"]
    assert {r["id"] for r in match(df, [Condition("id", "like", "a_c")]).collect()} == {"a.c", "abc"}
    assert like_pattern("%") == r"\A(?:.*)\z"


def test_connectives_and_sets(nodes, spark):
    both = [Condition("packets", ">", 4), Condition("flag", "is_false")]
    assert {r["id"] for r in match(nodes, both, "OR").collect()} == set("abcd")
    assert match(nodes, []).count() == 0 and match(nodes, [], empty=True).count() == 4
    members = spark.createDataFrame([("a",), ("d",)], "member string")
    assert {r["id"] for r in match(nodes, [Condition("", "in_set", "@s"), Condition("packets", "=", 0)], sets={"s": members}).collect()} == {"d"}
    assert match(nodes, [Condition("", "in_set", "none")]).count() == 0
    assert {r["id"] for r in nodes.where(compile_conditions(nodes.schema, both)).collect()} == {"b"}


def test_catalog(nodes):
    assert dict(field_catalog(nodes)) == {"id": "string", "label": "string", "packets": "numeric", "protocols": "set", "flag": "boolean", "deep.x.y": "numeric"}


def test_recipe(spark):
    nodes = spark.createDataFrame([("a", 100), ("b", 5), ("c", 50), ("lonely", 1)], "id string, packets long")
    edges = spark.createDataFrame([("ab", "a", "b", "DNS"), ("bc", "b", "c", "UDP"), ("ac", "a", "c", "HTTP")], "id string, src string, dst string, protocol string")
    seen = lambda df: {r["id"] for r in df.where("visible").collect()}
    out = run(nodes, edges, [Step("hide", "edges", [Condition("protocol", "equals", "dns")]), Step("hide", "edges", [Condition("protocol", "equals", "udp")])])
    assert seen(out.edges) == {"ac"} and seen(out.nodes) == {"a", "c", "lonely"}
    out = run(nodes, edges, [Step("show_only", "nodes", [Condition("packets", ">", 10)]), Step("tag", "nodes", [Condition("packets", ">", 60)], group="big"), Step("show_only", "nodes", [Condition("id", "equals", "b")], scope="global"), Step("nonsense"), Step("hide", enabled=False)])
    assert seen(out.nodes) == {"b"} and seen(out.edges) == set() and len(out.warnings) == 1
    assert [r["member"] for r in out.groups["tag", "big"][1].collect()] == ["a"]
