"""Declarative data-quality rules: compiled to aggregates, run in as few passes as can be, reported as a DataFrame.

Value checks leave nulls out of their denominator (all but not_null); a rule holds where good / checked >= mostly. Every
copy of a repeated value fails uniqueness. A missing column fails its check; a column without values passes.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from servista.plans.session import shuffles_removed

ACTIONS = ("fail", "warn", "drop", "info")


@dataclass(frozen=True)
class Rule:
    """kind: exists, not_null, unique, one_of, between, greater_than, row_count, unique_combination or sql."""

    kind: str
    columns: tuple[str, ...] = ()
    mostly: float = 1.0
    values: tuple = ()
    low: float | None = None
    high: float | None = None
    sql: str = ""
    allow_null: bool = True
    action: str = "warn"
    name: str = ""

    @property
    def column(self) -> str:
        return ",".join(self.columns)

    @property
    def label(self) -> str:
        return self.name or f"{self.kind}:{self.column}"


def rule(kind: str, *columns: str, **more) -> Rule:
    if "values" in more:
        more["values"] = tuple(more["values"])
    if more.get("action", "warn") not in ACTIONS:
        raise ValueError(f"unknown action {more['action']}")
    return Rule(kind, columns, **more)


#: Other names of the same checks, as rule files have them.
KINDS = {
    "column_exists": "exists",
    "expect_column_to_exist": "exists",
    "expect_column_values_to_not_be_null": "not_null",
    "expect_column_values_to_be_unique": "unique",
    "expect_column_values_to_be_in_set": "one_of",
    "expect_column_values_to_be_between": "between",
    "expect_table_row_count_to_be_between": "row_count",
    "expect_compound_columns_to_be_unique": "unique_combination",
    "custom_sql": "sql",
}


def from_yaml_rules(items: list[dict]) -> list[Rule]:
    """Rules from parsed YAML items: name, type, column or columns, mostly, values, min, max, value, sql, allow_null, action.

    Nulls are left out of value checks unless allow_null is false; then they are bad.
    """
    out = []
    for x in items:
        kind = KINDS.get(x["type"], x["type"])
        columns = tuple(x.get("columns") or ([x["column"]] if x.get("column") else []))
        more = {"mostly": x.get("mostly", 1.0), "values": tuple(x.get("values", ())), "low": x.get("min", x.get("value")), "high": x.get("max"), "sql": x.get("sql", ""), "allow_null": x.get("allow_null", True), "action": x.get("action", "info"), "name": x.get("name", "")}
        each = [(c,) for c in columns] if kind == "not_null" else [columns]
        out += [Rule(kind, c, **more) for c in each]
    return out


def from_yaml(doc: dict) -> dict[str, dict[str, list[Rule]]]:
    """Rules by layer and table from a parsed rule file; sections whose entries have no expectations are left out."""
    found = {}
    for layer, tables in doc.items():
        each = {name: from_yaml_rules(t["expectations"]) for name, t in tables.items() if isinstance(t, dict) and "expectations" in t} if isinstance(tables, dict) else {}
        if each:
            found[layer] = each
    return found


def from_json_suite(suite: dict) -> list[Rule]:
    """Rules from a parsed suite with expectations of expectation_type and kwargs."""
    out = []
    for x in suite["expectations"]:
        k = x["kwargs"]
        columns = tuple(k.get("column_list") or ([k["column"]] if "column" in k else []))
        out.append(Rule(KINDS[x["expectation_type"]], columns, k.get("mostly", 1.0), tuple(k.get("value_set", ())), k.get("min_value"), k.get("max_value")))
    return out


def condition(r: Rule) -> Column:
    """Whether a value is good; null where the value isn't checked."""
    c = F.col(r.columns[0])
    if r.kind == "not_null":
        return c.isNotNull()
    if not r.allow_null:
        return F.coalesce(condition(replace(r, allow_null=True)), F.lit(False))
    if r.kind == "one_of":
        return F.when(c.isNotNull(), c.isin(*r.values))
    if r.kind == "greater_than":
        return c > F.lit(r.low)
    if r.kind == "between":
        parts = [p for p, bound in ((c >= F.lit(r.low), r.low), (c <= F.lit(r.high), r.high)) if bound is not None]
        return reduce(lambda a, b: a & b, parts, F.when(c.isNotNull(), F.lit(True)))
    raise ValueError(f"{r.kind} is no check of single values")


_VALUE = ("not_null", "one_of", "greater_than", "between")
RESULT = "rule string, kind string, column string, action string, checked long, good long, success boolean"


def evaluate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row a rule. All value, count and SQL rules share one aggregate; uniqueness rules share two scans while keys are few (see unique_rules)."""
    have = set(df.columns)
    one_pass: list[Column] = [F.count("*").alias("n")]
    for i, r in enumerate(rules):
        if r.kind in _VALUE and set(r.columns) <= have:
            ok = condition(r)
            one_pass += [F.count(ok).alias(f"c{i}"), F.count_if(F.coalesce(ok, F.lit(False))).alias(f"g{i}")]
        elif r.kind == "sql":
            one_pass += [F.lit(1).cast("long").alias(f"c{i}"), F.expr(f"({r.sql})").cast("long").alias(f"g{i}")]
    wide = df.agg(*one_pass)
    rows = []
    for i, r in enumerate(rules):
        base = (F.lit(r.label), F.lit(r.kind), F.lit(r.column), F.lit(r.action))
        zero = F.lit(0).cast("long")
        if r.kind == "exists":
            rows.append((*base, zero + 1, F.lit(int(set(r.columns) <= have)).cast("long"), F.lit(set(r.columns) <= have)))
        elif r.kind == "row_count":
            n = F.col("n")
            ok = (n >= F.lit(r.low if r.low is not None else 0)) & (F.lit(r.high is None) | (n <= F.lit(r.high if r.high is not None else 0)))
            rows.append((*base, n, n, ok))
        elif not set(r.columns) <= have:
            rows.append((*base, zero, zero, F.lit(False)))
        elif r.kind in (*_VALUE, "sql"):
            c, g = F.col(f"c{i}"), F.coalesce(F.col(f"g{i}"), zero)
            rows.append((*base, c, g, F.when(c == 0, F.lit(True)).otherwise(g / c >= r.mostly)))
    names = [f.split()[0] for f in RESULT.split(", ")]
    out = None
    if rows:
        packed = F.explode(F.array(*[F.struct(*[x.alias(k) for x, k in zip(row, names, strict=True)]) for row in rows]))
        out = wide.select(packed.alias("r")).select("r.*")
    keyed = [r for r in rules if r.kind in UNIQUE and set(r.columns) <= have]
    if keyed:
        one = unique_rules(df, keyed)
        out = one if out is None else out.unionByName(one)
    return out


UNIQUE = ("unique", "unique_combination")
#: Keys (rows times rules) that one shuffle of several rules takes, at most.
ENTRIES = 10_000_000


def _totals(df: DataFrame, rules: dict[int, Rule]) -> DataFrame:
    """(rule, checked, good) by the number of each rule, from one scan and one shuffle of the keys themselves, equal ones of a task combined."""
    used = {c: f"c{k}" for k, c in enumerate(dict.fromkeys(c for r in rules.values() for c in r.columns))}
    df = df.select(*[F.col(c).alias(name) for c, name in used.items()])
    kinds = dict(df.dtypes)
    each = []
    for i, r in rules.items():
        own = {used[c] for c in r.columns}
        one = F.struct(F.lit(i).alias("rule"), *[(F.col(c) if c in own else F.lit(None).cast(kinds[c])).alias(c) for c in used.values()])
        each.append(F.when(F.col(used[r.columns[0]]).isNotNull(), one) if r.kind == "unique" else one)
    key = each[0] if len(each) == 1 else F.explode(F.array(*each))
    keys = df.select(key.alias("key")).filter("key IS NOT NULL").select("key.*").groupBy("rule", *used.values()).agg(F.count("*").alias("n"))
    return keys.groupBy("rule").agg(F.sum("n").alias("checked"), F.count_if(F.col("n") == 1).alias("good"))


def unique_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row for each rule of kind unique or unique_combination.

    Keys are compared themselves, not their hashes. Several rules share a scan and a shuffle while their keys, by a count of df
    before it, are at most ENTRIES; so many rows make a round for each rule, over its own columns. A round's shuffle is removed before
    the next: the disk holds the keys of one rule then, not of all. The last round runs with the result.
    """
    each = max(1, ENTRIES // max(1, df.count())) if len(rules) > 1 else 1
    rounds = [dict(list(enumerate(rules))[k : k + each]) for k in range(0, len(rules), each)]
    known = {i: (0, 0) for i in range(len(rules))}
    with shuffles_removed(df.sparkSession):
        for some in rounds[:-1]:
            known |= {r["rule"]: (r["checked"], r["good"]) for r in _totals(df, some).collect()}
    total = _totals(df, rounds[-1])
    before = lambda i: [F.lit(n).cast("long").alias(c) for c, n in zip(("known_checked", "known_good"), known[i], strict=True)]
    named = F.explode(F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(r.label).alias("label"), F.lit(r.kind).alias("kind"), F.lit(r.column).alias("column"), F.lit(r.action).alias("action"), F.lit(float(r.mostly)).alias("mostly"), *before(i)) for i, r in enumerate(rules)]))
    every = df.sparkSession.range(1).select(named.alias("r")).select("r.*").join(F.broadcast(total), "rule", "left")
    checked, ok = (F.coalesce(F.col(c), F.col(f"known_{c}")) for c in ("checked", "good"))
    return every.select(F.col("label").alias("rule"), "kind", "column", "action", checked.alias("checked"), ok.alias("good"), F.when(checked == 0, F.lit(True)).otherwise(ok / checked >= F.col("mostly")).alias("success"))


def enforce(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows that every rule with action drop accepts; unchecked (null) values pass all but not_null."""
    for r in rules:
        if r.action == "drop":
            df = df.filter(F.coalesce(condition(r), F.lit(True)))
    return df


def enforce_counted(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, Observation]:
    """enforce()'s rows, and how many rows break each of its rules: known once an action has run over the rows."""
    drop = [r for r in rules if r.action == "drop"]
    seen = Observation()
    counted = df.observe(seen, F.count("*").alias("rows"), *[F.count_if(~F.coalesce(condition(r), F.lit(True))).alias(r.label) for r in drop])
    return enforce(counted, drop), seen


class RuleViolation(Exception):
    """A rule with action fail doesn't hold."""


def assert_rules(results: DataFrame) -> None:
    """Raise RuleViolation with the failed rules of action fail; results has one row a rule."""
    bad = [r["rule"] for r in results.filter((F.col("action") == "fail") & ~F.col("success")).collect()]
    if bad:
        raise RuleViolation(", ".join(sorted(bad)))


def ordered(results: DataFrame) -> DataFrame:
    """Failed rules first, then by column and rule."""
    return results.orderBy("success", "column", "rule")


def across(spark: SparkSession, rules: list[Rule], tables: dict[str, DataFrame]) -> DataFrame:
    """Rules of kind sql that compare several tables, given by the names that the SQL has for them; one row a rule."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    try:
        each = [spark.sql(f"SELECT CAST(({r.sql}) AS BIGINT) AS good").select(F.lit(r.label).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(r.column).alias("column"), F.lit(r.action).alias("action"), F.lit(1).cast("long").alias("checked"), F.coalesce("good", F.lit(0)).alias("good")) for r in rules]
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)
    return reduce(DataFrame.unionByName, each).withColumn("success", F.col("good") == 1)


def save_report(results: DataFrame, path: str, run: str) -> None:
    """Keep a run's results (or summaries) as a part of a report table; a repeated run replaces its part."""
    results.write.mode("overwrite").parquet(f"{path}/run={run}")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """All runs' results, with the column run."""
    return spark.read.option("basePath", path).parquet(f"{path}/run=*").withColumn("run", F.col("run").cast("string"))


def summary(results: DataFrame, layer: str) -> DataFrame:
    """evaluated, successful, failed and success_pct of one layer."""
    n, good = F.count("*"), F.count_if("success")
    return results.agg(n.alias("evaluated"), good.alias("successful"), (n - good).alias("failed"), F.round(F.try_divide(good * 100.0, n), 2).alias("success_pct")).select(F.lit(layer).alias("layer"), "*")


def failed(layers: dict[str, DataFrame]) -> DataFrame:
    """Failed rules of all layers with at most 200 characters of details."""
    out = None
    for layer, results in layers.items():
        one = results.filter(~F.col("success")).select(F.lit(layer).alias("layer"), "rule", "kind", "column", F.substring(F.to_json(F.struct("checked", "good", "action")), 1, 200).alias("details"))
        out = one if out is None else out.unionByName(one)
    return out


def gate(summaries: DataFrame, least: float = 80.0) -> DataFrame:
    """One row: whether every layer reaches the least success percentage."""
    return summaries.agg(F.min("success_pct").alias("lowest_pct"), F.coalesce(F.min("success_pct") >= least, F.lit(False)).alias("passed"))


def report(summaries: DataFrame) -> DataFrame:
    """All layers' summaries as one row with a JSON text."""
    return summaries.agg(F.to_json(F.sort_array(F.collect_list(F.struct("layer", "evaluated", "successful", "failed", "success_pct")))).alias("report"))


def row_retention(current: DataFrame, staged: DataFrame, least: float = 0.95) -> DataFrame:
    a, b = current.agg(F.count("*").alias("kept")), staged.agg(F.count("*").alias("staged"))
    return a.crossJoin(b).select("kept", "staged", (F.col("kept") >= F.col("staged") * least).alias("success"))


def count_consistency(daily: DataFrame, current: DataFrame, today: Column, days: int = 7, tolerance: int = 100) -> DataFrame:
    """Whether the aggregates' total of the last days is close to the rows they come from."""
    first = F.date_sub(today, days)
    a = daily.filter(F.col("date") >= first).agg(F.coalesce(F.sum("total_requests"), F.lit(0)).alias("aggregated"))
    b = current.filter(F.to_date("created_date") >= first).agg(F.count("*").alias("counted"))
    return a.crossJoin(b).select("aggregated", "counted", (F.abs(F.col("aggregated") - F.col("counted")) < tolerance).alias("success"))


@dataclass(frozen=True)
class RecordLimits:
    """Limits of validate_records."""

    latitude: tuple[float, float] = (41.6, 42.1)
    longitude: tuple[float, float] = (-87.95, -87.5)
    null_share: float = 0.05
    duplicate_share: float = 0.05
    empty: tuple = field(default=("",))


def validate_records(df: DataFrame, key: str = "sr_number", created: str = "created_date", ward: str = "ward", limits: RecordLimits | None = None) -> DataFrame:
    """One row of record quality: empty strings count as missing, coordinates are judged only where both are present."""
    limits = limits or RecordLimits()
    here = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    lat, lon = F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double")
    inside = F.coalesce(lat.between(*limits.latitude) & lon.between(*limits.longitude), F.lit(False))
    out = df.agg(
        F.count("*").alias("total_records"),
        F.count_if(~here(key)).alias("null_sr_number"),
        F.count_if(~here(created)).alias("null_created_date"),
        F.count_if(~here(ward)).alias("null_ward"),
        F.count_if(here("latitude") & here("longitude") & ~inside).alias("invalid_coordinates"),
        (F.count_if(here(key)) - F.countDistinct(F.when(here(key), F.col(key)))).alias("duplicate_keys"),
        F.min(F.when(here(created), F.col(created))).alias("first_date"),
        F.max(F.when(here(created), F.col(created))).alias("last_date"),
    )
    n = F.col("total_records")
    fine = ((F.col("null_sr_number") + F.col("null_created_date")) / n < limits.null_share) & (F.col("duplicate_keys") / n < limits.duplicate_share)
    return out.withColumn("is_valid", F.when(n == 0, F.lit(True)).otherwise(fine))


def with_violations(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """df with the names of the value rules that each row breaks, for quarantine."""
    broken = F.array(*[F.when(~F.coalesce(condition(r), F.lit(True)), r.label) for r in rules if r.kind in _VALUE])
    return df.withColumn("violations", F.filter(broken, lambda x: x.isNotNull()))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """All rows of keys that occur more than once."""
    twice = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
    return df.join(twice, key, "left_semi")
