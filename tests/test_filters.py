import json

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from palimpsest.errors import FilterParse
from palimpsest.plans import expr as E
from palimpsest.plans.compile import compile_filter
from palimpsest.plans.parser import parse, parse_iso

NOW = 1_700_000_000_000

GOOD = [
    'a == 1', 'a.b-c != -2.5', 'a >= 1e3 and b < 2 or c <= 3', 'not (a == 1 or b == 2) and c == 3', '!a == 1 && b == 2 || c == true',
    'exists(a.b) and is_null(c)', 'x in (1, 2.0, "3", true, ts"2024-06-01T00:00:00Z")', 'x contains "q" or x contains 4',
    'k startswith "a" and k endswith "b" and k ~ "*.?"', 'always', 'never', 'not not a == 1', 't > now - 7d', 't < now + 1.5h',
    's == "quote \\" back \\\\ tab \\t line \\n"', 't == ts"0000-02-29T00:00:00Z"', 'n == 99999999999999999999', 'always == 1', 'nowhere == 2',
]
BAD = ["", "a", "a ==", "a == 1 and", "(a == 1", "a == 1)", "a ~ 3", "a in ()", "a in (1", 'a == "x', 'a == "\\q"', "a == now", "a == now - 7y",
       "exists(", "exists()", "1 == a", 'a == ts"nope"', 'a == ts"2024-02-30"', "a == 1e999", "a startswith 1", "a = 1", "." , "a..b == 1"]


@pytest.mark.parametrize("text", GOOD)
def test_round_trips(text):
    node = parse(text, NOW)
    assert parse(str(node)) == node
    assert E.from_json(json.loads(json.dumps(node.to_json()))) == node


@pytest.mark.parametrize("text", BAD)
def test_rejects(text):
    with pytest.raises(FilterParse):
        parse(text, NOW)


def test_error_position_is_in_bytes():
    with pytest.raises(FilterParse) as caught:
        parse('é == "é" and ?')
    assert caught.value.position == len('é == "é" and '.encode())


def test_depth():
    parse("not " * 100 + "a == 1")
    with pytest.raises(FilterParse):
        parse("not " * 200 + "a == 1")
    assert len(parse(" or ".join(f"a == {i}" for i in range(2000))).parts) == 2000


@given(st.text(max_size=60))
@settings(max_examples=300)
def test_parser_only_raises_its_own_error(text):
    try:
        parse(text, NOW)
    except FilterParse:
        pass


def test_iso():
    assert parse_iso("1970-01-01T00:00:00.5Z") == 500
    assert parse_iso("1970-01-01T01:00+01:00") == 0
    assert parse_iso("1970-1-2") == 86_400_000
    assert parse_iso("2024-01-01T24:00:00Z") is None
    assert parse_iso("2024-01-01T00:00:60Z") is None
    assert E.format_ts(parse_iso("0000-01-01T00:00:00Z")) == "0000-01-01T00:00:00.000Z"


def test_empty_lists_print_as_constants():
    assert str(E.And(())) == "always" and str(E.Or(())) == "never" and str(E.In("a", ())) == "never"
    with pytest.raises(FilterParse):
        E.from_json({"and": []})


def test_builder():
    node = (E.field("a") == 1) & (E.field("b") > 2) | ~E.field("c").is_in(1, 1, True)
    assert str(node) == "a == 1 and b > 2 or not c in (1, true)"


ROWS = [
    (1, "k1", '{"a":1,"s":"abc","l":[1,"x",true,null],"n":null,"f":1.5,"b":true,"o":{"p":{"q":"deep"}}}'),
    (2, None, '{"a":"1","s":"a.c","l":[]}'),
    (3, "k3", None),
    (4, "", '{"a":2.0,"big":9007199254740993}'),
    (5, "kx", '"just text"'),
]
#: condition -> rows that it is true for; the fine points of three-valued logic among them.
TRUTH = {
    "a == 1": [1], "not a == 1": [4], "a != 1": [4], "a == 1.0": [1], "a == 2": [4], 'a == "1"': [2], "a in (2)": [4],
    "not a in (7)": [1, 2, 4], 'a in ("1", 2)': [2, 4], 's contains "b"': [1], "s contains 1": [], 'l contains "x"': [1], "l contains true": [1],
    "l contains 9": [], "not l contains 9": [1, 2], "exists(n)": [1], "is_null(n)": [1], "not is_null(n)": [2, 3, 4, 5], "exists(zz)": [],
    "f > 1": [1], "b == true": [1], "b > false": [1], 's ~ "a?c"': [1, 2], 's ~ "a.c"': [2], 's ~ "*"': [1, 2], 'key startswith "k"': [1, 3, 5],
    "exists(key)": [1, 3, 4, 5], "key == 5": [], 'o.p.q == "deep"': [1], "exists(o.p)": [1], 'o.p == "x"': [], "big == 9007199254740993": [4],
    "always": [1, 2, 3, 4, 5], "never": [], "zz == 1 or a == 1": [1], "not (zz == 1 and a == 1)": [4], "created_at > 5": [],
    'created_at > ts"1970-01-01T00:00:00.002Z"': [3, 4, 5], "importance == 0.8": [], "rowid in (1, 3.0)": [1, 3], '__ns == "ns"': [1, 2, 3, 4, 5],
    "access_count == 0": [1, 2, 3, 4, 5], "last_access < now - 1s": [], "not last_access < now - 1s": [],
}


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.createDataFrame(ROWS, "rowid bigint, key string, metadata string")
    return rows.select(
        "*", F.lit("ns").alias("ns"), F.col("rowid").alias("created_at"), F.lit(0.8).cast("float").alias("importance"),
        F.lit(None).cast("bigint").alias("last_access"), F.lit(None).cast("bigint").alias("access_count"),
    ).cache()


@pytest.mark.parametrize("condition", sorted(TRUTH))
def test_truth(table, condition):
    found = table.where(compile_filter(parse(condition, NOW))).select("rowid").collect()
    assert sorted(r.rowid for r in found) == TRUTH[condition]


_VALUES = st.one_of(st.booleans(), st.integers(-3, 3), st.sampled_from([0.5, 1.0, -2.5]), st.sampled_from(["", "a", "ab"]))


def _leaf():
    return st.one_of(
        st.builds(E.Cmp, st.sampled_from("xyz"), st.sampled_from(["==", "!=", "<", ">="]), _VALUES),
        st.builds(lambda f, v: E.In(f, tuple(v)), st.sampled_from("xyz"), st.lists(_VALUES, min_size=1, max_size=3)),
        st.builds(E.Exists, st.sampled_from("xyz")), st.builds(E.IsNull, st.sampled_from("xyz")),
    )


_TREES = st.recursive(
    _leaf(), lambda inner: st.one_of(st.builds(E.Not, inner), st.builds(lambda a: E.And(tuple(a)), st.lists(inner, min_size=2, max_size=3)),
                                     st.builds(lambda a: E.Or(tuple(a)), st.lists(inner, min_size=2, max_size=3))), max_leaves=6)


def _kind(v):
    return "b" if isinstance(v, bool) else "n" if isinstance(v, (int, float)) else "s" if isinstance(v, str) else None


def _judge(node, row):
    """The same logic in plain Python: True, False or None for unknown."""
    if isinstance(node, E.Not):
        inner = _judge(node.part, row)
        return None if inner is None else not inner
    if isinstance(node, (E.And, E.Or)):
        found = [_judge(p, row) for p in node.parts]
        stop = isinstance(node, E.Or)
        return stop if stop in found else None if None in found else not stop
    there, value = node.field in row, row.get(node.field)
    if isinstance(node, E.Exists):
        return there
    if isinstance(node, E.IsNull):
        return there and value is None
    if isinstance(node, E.In):
        return None if _kind(value) is None else any(_kind(v) == _kind(value) and v == value for v in node.values)
    if _kind(value) is None or _kind(value) != _kind(node.value):
        return None
    return {"==": value == node.value, "!=": value != node.value, "<": value < node.value, ">=": value >= node.value}[node.op]


_WORLD = [{}, {"x": 1}, {"x": "a", "y": None}, {"x": True, "y": 0.5, "z": "ab"}, {"x": -2.5, "z": 3}, {"y": [1], "z": ""}, {"x": 1.0, "y": -1}]


@given(st.lists(_TREES, min_size=8, max_size=8))
@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
def test_matches_plain_logic(spark, trees):
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(_WORLD)], "i int, metadata string")
    got = rows.select("i", *(F.coalesce(compile_filter(t), F.lit(False)).alias(f"t{k}") for k, t in enumerate(trees))).collect()
    for row in got:
        assert [row[f"t{k}"] for k in range(len(trees))] == [_judge(t, _WORLD[row.i]) is True for t in trees]
