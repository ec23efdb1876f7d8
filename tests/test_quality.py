import pytest
from pyspark.sql import functions as F

from servista.operators import quality as q, profile
from servista.plans import suites


def results(df, rules):
    return {r.rule: (r.checked, r.good, r.success) for r in q.evaluate(df, rules).collect()}


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(1, "a", 5.0), (1, "b", None), (2, None, 50.0), (None, "z", 7.0)], "k int, s string, x double")


def test_value_rules_skip_nulls(df):
    got = results(df, [q.rule("not_null", "k", mostly=0.75), q.rule("not_null", "s", mostly=0.76), q.rule("one_of", "s", values=["a", "b"], mostly=0.6), q.rule("between", "x", low=5, high=10), q.rule("greater_than", "x", low=4)])
    assert got == {"not_null:k": (4, 3, True), "not_null:s": (4, 3, False), "one_of:s": (3, 2, True), "between:x": (3, 2, False), "greater_than:x": (3, 3, True)}


def test_table_rules(df):
    rules = [q.rule("exists", "k"), q.rule("exists", "nope"), q.rule("not_null", "nope"), q.rule("unique", "k"), q.rule("unique_combination", "k", "s"), q.rule("row_count", low=4, high=4), q.rule("row_count", low=5, name="big"), q.rule("sql", sql="max(x) = 50", name="max")]
    got = results(df, rules)
    assert got["exists:k"][2] and not got["exists:nope"][2] and not got["not_null:nope"][2]
    assert got["unique:k"] == (3, 1, False) and got["unique_combination:k,s"] == (4, 4, True)
    assert got["row_count:"][2] and not got["big"][2] and got["max"][2]


def test_empty_table_passes_values(df):
    got = results(df.limit(0), [q.rule("not_null", "k"), q.rule("unique", "k"), q.rule("row_count", low=1)])
    assert got["not_null:k"][2] and got["unique:k"][2] and not got["row_count:"][2]


def test_actions(df):
    assert q.enforce(df, [q.rule("not_null", "k", action="drop"), q.rule("between", "x", high=10, action="drop"), q.rule("not_null", "s")]).count() == 2
    with pytest.raises(q.RuleViolation, match="unique:k"):
        q.assert_rules(q.evaluate(df, [q.rule("unique", "k", action="fail"), q.rule("not_null", "s")]))
    assert [r.violations for r in q.with_violations(df, [q.rule("not_null", "s")]).orderBy("x").collect()].count(["not_null:s"]) == 1


@pytest.mark.parametrize(("pct", "passed"), [(80.0, True), (79.9, False)])
def test_gate(spark, pct, passed):
    s = spark.createDataFrame([("a", 100.0), ("b", pct)], "layer string, success_pct double")
    assert q.gate(s).first().passed is passed


def test_suite_sizes_and_parsers():
    assert [len(s) for s in (suites.BRONZE, suites.SILVER, suites.GOLD)] == [21, 16, 14]
    suite = {"expectations": [{"expectation_type": "expect_column_values_to_be_between", "kwargs": {"column": "w", "min_value": 1, "max_value": None, "mostly": 0.9}}, {"expectation_type": "expect_compound_columns_to_be_unique", "kwargs": {"column_list": ["a", "b"]}}]}
    a, b = q.from_json_suite(suite)
    assert (a.kind, a.low, a.high, a.mostly) == ("between", 1, None, 0.9) and b.columns == ("a", "b")
    rules = q.from_yaml_rules([{"name": "n", "type": "not_null", "columns": ["a", "b"], "action": "fail"}, {"type": "custom_sql", "sql": "count(*) > 0"}])
    assert [r.kind for r in rules] == ["not_null", "not_null", "sql"]


def test_profile(spark, df):
    assert {r.column: (r.n_values, r.n_distinct, r.recommendation) for r in profile.null_profile(df).collect()} == {"k": (3, 2, "nullable"), "s": (3, 3, "nullable"), "x": (3, 3, "nullable")}
    top = profile.value_counts(df, "k", 1).first()
    assert (top.value, top.n, top.pct) == ("1", 2, 50.0)
    assert {r.k for r in profile.repeated_keys(df.filter("k IS NOT NULL"), "k").collect()} == {1}
    assert q.duplicates(df, "k").count() == 2
    c = profile.coordinates(spark.createDataFrame([("41.8", "-87.6"), ("0", "0"), (None, "x")], "latitude string, longitude string"), (41.6, 42.1), (-87.95, -87.5)).first()
    assert c.inside_share == 0.5 and c.max_latitude == 41.8


def test_report(df):
    s = q.summary(q.evaluate(df, [q.rule("not_null", "s"), q.rule("exists", "k")]), "one")
    assert s.first().success_pct == 50.0 and '"layer":"one"' in q.report(s).first().report
    assert q.failed({"one": q.evaluate(df, [q.rule("not_null", "s")])}).select(F.length("details")).first()[0] <= 200


def test_rule_file(df):
    doc = {"source": {"name": "x"}, "bronze": {"t": {"expectations": [{"name": "n", "type": "between", "column": "x", "min": 5, "max": 50, "allow_null": False}]}}, "monitoring": {"freshness": {"warning_hours": 24}}}
    rules = q.from_yaml(doc)
    assert list(rules) == ["bronze"] and results(df, rules["bronze"]["t"]) == {"n": (4, 3, False)}
    assert [r.success for r in q.ordered(q.evaluate(df, [q.rule("exists", "k"), q.rule("not_null", "s")])).collect()] == [False, True]


def test_dropped_rows_are_counted(df):
    kept, seen = q.enforce_counted(df, [q.rule("not_null", "k", action="drop"), q.rule("between", "x", high=10, action="drop")])
    assert kept.count() == 2 and seen.get == {"rows": 4, "not_null:k": 1, "between:x": 1}
