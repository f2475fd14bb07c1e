"""Filters against SQLite, whose storage classes and three-valued logic they follow."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestone.errors import EngineError
from lodestone.operators.filters import check_shape, compile_filter, condition, form, glob_to_regex

VALUES = [5, "5", True, [1, 2], None, "MISSING", {"p": 7}, "ab]c", 1.5, 1, "abc", "", [], ["x", None, True], {"a": "x"}, "[1,2]", -3, 1_000_000]
ROWS = [
    (f"r{i}", None if i == 5 else json.dumps({"x": v, "a.b": v, "id": 9}, separators=(",", ":"))) for i, v in enumerate(VALUES)
] + [("none", "{}")]
ORDER = {"Lt": "<", "Lte": "<=", "Gt": ">", "Gte": ">="}


def literal(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(int(v))
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def sql(tree):
    """The filter as SQLite sees it."""
    head = tree[0]
    if head in ("And", "Or"):
        return "(" + f" {head} ".join(map(sql, tree[1])) + ")"
    if head == "Not":
        return f"(NOT {sql(tree[1])})"
    name, op, v = tree
    col = "id" if name == "id" else f"json_extract(attrs, '$.\"{name}\"')"
    each = f"EXISTS (SELECT 1 FROM json_each(attrs, '$.\"{name}\"') WHERE value"
    values = ", ".join(map(literal, v)) if isinstance(v, list) else ""
    return {
        "Eq": f"{col} IS NULL" if v is None else f"{col} = {literal(v)}" if not isinstance(v, list) else "",
        "NotEq": f"{col} IS NOT NULL" if v is None else f"({col} IS NULL OR {col} <> {literal(v)})" if not isinstance(v, list) else "",
        "In": f"{col} IN ({values})",
        "NotIn": f"({col} IS NULL OR {col} NOT IN ({values}))",
        "Glob": f"{col} GLOB {literal(v)}" if isinstance(v, str) else "",
        "NotGlob": f"({col} IS NULL OR {col} NOT GLOB {literal(v)})" if isinstance(v, str) else "",
        "Contains": f"{each} = {literal(v)})" if not isinstance(v, list) else "",
        "ContainsAny": f"{each} IN ({values}))",
    }.get(op) or f"{col} {ORDER[op]} {literal(v)}"


def trees():
    scalars = [5, "5", True, 1, 1.5, "abc", "[1,2]", -3, "", None, 7, "x"]
    lists = [[5, "abc"], [None], [1, None], ["x", True], [7], ["[1,2]", 1.5]]
    globs = ["*", "?", "5*", "1*", "[a-c]*", "[^a]*", "*]*", "[]]*", "[ab", "ab[]]c", "\\*", "*[*", "[5]", "1.5", ""]
    out = [["x", op, v] for op in ("Eq", "NotEq", *ORDER, "Contains") for v in scalars]
    out += [["x", op, v] for op in ("In", "NotIn", "ContainsAny") for v in lists] + [["x", op, g] for op in ("Glob", "NotGlob") for g in globs]
    out += [["Not", t] for t in out]
    out += [["a.b", "Eq", 5], ["And", [["x", "Gt", 1], ["Not", ["x", "Eq", "abc"]]]], ["Or", [["x", "Eq", None], ["id", "Glob", "r1*"]]], ["id", "In", ["r1", "r2"]],
            ["id", "NotIn", ["r1", None]], ["id", "Gt", "r5"], ["And", [["id", "NotGlob", "r?"], ["x", "NotEq", 5]]], ["id", "Eq", None], ["Not", ["id", "In", ["r1", None]]]]
    return out


def test_against_sqlite(spark):
    df = spark.createDataFrame(ROWS, "id string, attrs string").cache()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE rows (id TEXT, attrs TEXT)")
    db.executemany("INSERT INTO rows VALUES (?, ?)", ROWS)
    every = trees()
    for at in range(0, len(every), 70):
        part = every[at : at + 70]
        got = df.select("id", *[F.coalesce(compile_filter(t), F.lit(False)).alias(str(i)) for i, t in enumerate(part)]).collect()
        for i, t in enumerate(part):
            assert {r.id for r in got if r[str(i)]} == {x for (x,) in db.execute(f"SELECT id FROM rows WHERE {sql(t)}")}, t


@pytest.mark.parametrize("bad", [
    None, "x", [], ["x"], ["x", "Eq"], ["x", "Eq", 1, 2], ["And", []], ["Or", "x"], ["x", "Like", 1], ["x y", "Eq", 1], ["", "Eq", 1], ["x", "Eq", [1]], ["x", "Eq", {}],
    ["x", "In", []], ["x", "In", 5], ["x", "In", [[1]]], ["x", "Glob", 5], ["id", "Contains", "x"], ["id", "ContainsAny", ["x"]], ["x", "In", list(range(10_001))], ["x" * 129, "Eq", 1], [5, "Eq", 1],
])
def test_refusals(spark, bad):
    with pytest.raises(EngineError) as e:
        compile_filter(bad)
    assert e.value.status == 400


def test_depth(spark):
    tree = ["x", "Eq", 1]
    for _ in range(16):
        tree = ["Not", tree]
    compile_filter(tree)
    assert check_shape(tree) is None
    with pytest.raises(EngineError):
        compile_filter(["Not", tree])
    assert "16 levels" in check_shape(["Not", tree])


def test_id_conditions_reach_the_scan(spark, tmp_path):
    spark.createDataFrame(ROWS, "id string, attrs string").write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows")).filter(compile_filter(["And", [["id", "Gte", "r3"], ["x", "Eq", 5]]]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,r3)" in plan
    assert plan.split("PushedFilters")[0].count("try_parse_json") + plan.count("parse_json") <= 3


def test_shape_and_builder():
    assert "single" in check_shape(["Not", ["x", "Eq", 1], 2])
    assert "list" in check_shape(["x", "In", 1]) and check_shape(["And", [["x", "Eq", 1]]]) is None
    assert check_shape([1, "Eq", 1]) and check_shape(None) and check_shape(["x", "Like", 1])
    for test in (["x", "In", [1, "a", True, None]], ["x", "Eq", "5"], ["x", "Eq", 5], ["x", "Glob", "5*"], ["x", "Lt", "a, b"], ["x", "ContainsAny", ["1", 2.5]]):
        assert condition(*form(test)) == test
    with pytest.raises(EngineError):
        form(["x", "In", ["a, b"]])
    assert condition("x", "In", "1, a,, true") == ["x", "In", [1, "a", True]]
    assert condition("x", "Glob", "5*") == ["x", "Glob", "5*"] and condition("x", "Eq", "5") == ["x", "Eq", 5]
    assert glob_to_regex("[ab") == "(?!)" and glob_to_regex("a*") == r"\Aa[\s\S]*\z"
