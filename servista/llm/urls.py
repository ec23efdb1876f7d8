"""URL filter: given rules by longest match, and association rules mined with FP-growth for the rest (operator 6).

Given rules are pairs of host and path with a verdict. A rule fits its host and all subdomains where the url's path
starts with the rule's path; the longest fitting rule decides. They are found by an index: the url's host and its
parent domains are looked up, never every rule for every url.

For urls that no rule decides, token combinations are mined from labelled urls. Without labels of their own these are the
urls that the given rules decide, and no others; each rule's urls, its scope, weigh as much as another's, so that a rule that fits
very many urls doesn't outvote the rest: confidences are counted again with these weights (see weighed). Tokens are the parts of the host and
the path (without bare numbers), each labelled url is a transaction of its tokens and its label, and Spark's FP-growth
gives rules "tokens -> label" of at least MIN_SUPPORT and MIN_CONFIDENCE. A rule goes when a part of it says the same
with no less confidence. An inverted index from a rule's rarest token finds the rules that apply; the most confident
(then best supported, then shortest) decides; with none the url is allowed.

Only tokens of at least MIN_SUPPORT take part (their number is at most the tokens of an average url over MIN_SUPPORT);
all of them do, in all labelled urls. Two steps take out combinations that can't give a rule that stays: a token all of
whose urls have one label is a rule by itself and no part of a longer one, and tokens that occur in the same urls go as
one through FP-growth and are told apart in the rules again. Urls with many frequent tokens beyond these have as many
combinations as there are, and take that much time.

Edge cases: a url that is null or has no `://` has an empty host and path, fits no rule and has no token; host and
path may be empty; rows that repeat stay; with no labelled url nothing is mined; an empty table gives no rows.
Only page_id and url are read.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.6
#: Least confidence of combinations that are mined to be weighed by scope.
BEFORE_WEIGHTS = 0.2
Mined = tuple[tuple[str, ...], str, float, float]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = "://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens of a url: host parts as h:..., path parts as p:..., bare numbers left out."""

    def parts(text: Column, cut: str, mark: str) -> Column:
        return F.transform(F.filter(F.split(text, cut), lambda x: (x != "") & ~x.rlike("^[0-9]+$")), lambda x: F.concat(F.lit(mark), x))

    return F.array_distinct(F.concat(parts(host, "[.:@-]", "h:"), parts(F.lower(path), "[/._~+-]", "p:")))


def given_rule(rules: list[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """The longest fitting rule as a struct (rule, verdict), null if there is none.

    The index is a map from rule host to its rules, looked up for the host and each of its parent domains.
    """
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, at, below in rules:
        by_host.setdefault(at, []).append((below, verdict))
    if not by_host:
        return F.lit(None).cast("struct<rule string, verdict string>")
    index = F.create_map(*[x for h, rest in by_host.items() for x in (F.lit(h), F.array(*[F.struct(F.lit(p).alias("path"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for p, v in rest]))])
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fits = F.filter(F.flatten(F.filter(F.transform(domains, lambda d: F.try_element_at(index, d)), lambda x: x.isNotNull())), lambda r: path.startswith(r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> list[Mined]:
    """Rules (tokens, label, confidence, support) from rows (tokens, label); bounded by 1 / min_support, not by the rows."""
    total = labelled.count()
    if not total:
        return []
    # sums of two hashes of whole rows: tokens with the same sums occur in the same urls
    hashes = [F.xxhash64(*c).cast("decimal(20,0)").alias(k) for k, c in (("h1", ("tokens", "label")), ("h2", ("label", "tokens")))]
    counts = labelled.select("label", *hashes, F.explode("tokens").alias("token")).groupBy("token", "label").agg(F.count("*").alias("n"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2"))
    frequent = counts.groupBy("token").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2")).filter(F.col("n") >= min_support * total)
    count: dict[str, int] = {}
    alike: dict[tuple, list[str]] = {}
    pure: list[Mined] = []
    for r in frequent.collect():  # at most (tokens of a url) / min_support rows
        count[r["token"]] = r["n"]
        if r["most"]["n"] == r["n"]:
            pure.append(((r["token"],), r["most"]["label"], 1.0, r["n"] / total))
        else:
            alike.setdefault((r["n"], r["h1"], r["h2"]), []).append(r["token"])
    members = {min(ts): sorted(ts) for ts in alike.values()}
    if not members:
        return sorted(pure)
    used = F.create_map(*[F.lit(x) for t in members for x in (t, True)])
    items = labelled.select(F.array_append(F.filter("tokens", lambda t: F.map_contains_key(used, t)), F.concat(F.lit("="), F.col("label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    told = model.associationRules.filter(F.element_at("consequent", 1).startswith("=") & ~F.exists("antecedent", lambda x: x.startswith("=")))
    found = sorted(((tuple(sorted(r["antecedent"], key=lambda t: (count[t], t))), r["consequent"][0][1:], r["confidence"], r["support"]) for r in told.collect()), key=lambda r: (len(r[0]), r))
    out = pure
    for tokens, label, confidence, support in _telling(found):
        each = itertools.product(*[members[t] for t in tokens])
        out += [(tuple(sorted(ts, key=lambda t: (count[t], t))), label, confidence, support) for ts in each]
    return sorted(out, key=lambda r: (len(r[0]), r))


def _telling(found: list[Mined]) -> list[Mined]:
    """Rules, shorter ones first, without those of which a part says the same with no less confidence."""
    best: dict[tuple[frozenset, str], float] = {}
    out = []
    for rule in found:
        tokens, label, confidence, _ = rule
        own = frozenset(tokens)
        parts = max((best.get((own - {t}, label), 0.0) for t in own), default=0.0)
        best[own, label] = max(confidence, parts)
        if confidence > parts:
            out.append(rule)
    return out


def weighed(mined: list[Mined], known: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> list[Mined]:
    """The rules with confidences in which every scope of known (tokens, label, scope) weighs the same, without those that fall too low.

    What comes to the driver is a count for each rule, scope and label.
    """
    if not mined:
        return []
    sizes = {r["scope"]: r["n"] for r in known.groupBy("scope").agg(F.count("*").alias("n")).collect()}
    bodies = sorted({r[0] for r in mined}, key=lambda t: (len(t), t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_token: dict[str, list[int]] = {}
        for i, tokens in enumerate(bodies):
            by_token.setdefault(tokens[0], []).append(i)
        seen: Counter[tuple[int, str, str]] = Counter()
        for b in batches:
            for tokens, label, scope in zip(*[c.to_pylist() for c in b.columns], strict=True):
                own = set(tokens)
                seen.update((i, scope, label) for t in own for i in by_token.get(t, ()) if own.issuperset(bodies[i]))
        rows = [[*zip(*seen, strict=True)] if seen else [(), (), ()], [*seen.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(rows[0][0], pa.int32()), pa.array(rows[0][1], pa.string()), pa.array(rows[0][2], pa.string()), pa.array(rows[1], pa.int64())], ["body", "scope", "label", "n"])

    counts = known.select("tokens", "label", "scope").mapInArrow(run, "body int, scope string, label string, n long").groupBy("body", "scope", "label").agg(F.sum("n").alias("n"))
    weight: Counter[tuple[int, str | None]] = Counter()
    for r in counts.collect():
        for label in (r["label"], None):
            weight[r["body"], label] += r["n"] / sizes[r["scope"]]
    number = {t: i for i, t in enumerate(bodies)}
    again = [(t, label, weight[number[t], label] / weight[number[t], None], support) for t, label, _, support in mined]
    return _telling(sorted((r for r in again if r[2] >= min_confidence), key=lambda r: (len(r[0]), r)))


class Index:
    """Mined rules under their rarest token."""

    def __init__(self, rules: list[Mined]):
        self.by_token: dict[str, list[tuple]] = {}
        for tokens, label, confidence, support in rules:
            self.by_token.setdefault(tokens[0], []).append((confidence, support, -len(tokens), tokens, label))

    def verdict(self, tokens: list[str]) -> str | None:
        own = set(tokens)
        fits = [r for t in own for r in self.by_token.get(t, ()) if own.issuperset(r[3])]
        return max(fits)[4] if fits else None


def judge(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]], labelled: DataFrame | None = None, default: str = "allow", **limits) -> DataFrame:
    """page_id, host, path, rule, verdict for each row. labelled has (url, label); without it the rows that the rules decide are
    labelled by them; the default is for urls of which nothing is known."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("given", given_rule(rules, F.col("host"), F.col("path"))).withColumn("tokens", tokens_of(F.col("host"), F.col("path")))
    mined = mine(_transactions(labelled), **limits) if labelled is not None else mine_decided(rows, **limits)
    names = ["page_id", "host", "path", "rule", "verdict"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(mined)
        for b in batches:
            said = [v or index.verdict(t) or default for v, t in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(said, pa.string())], names)

    out = rows.select("page_id", "host", "path", F.col("given.rule").alias("rule"), F.col("given.verdict").alias("verdict"), "tokens")
    return out.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def decided(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """url, label and scope (the rule) of the pages that the given rules decide."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    return pages.select("url", given_rule(rules, host, path).alias("given")).filter("given IS NOT NULL").select("url", F.col("given.verdict").alias("label"), F.col("given.rule").alias("scope"))


def mine_decided(rows: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> list[Mined]:
    """Rules from the rows (tokens, given) that the given rules decide, weighed by scope."""
    known = rows.filter("given IS NOT NULL").select("tokens", F.col("given.verdict").alias("label"), F.col("given.rule").alias("scope"))
    return weighed(mine(known, min_support, min(BEFORE_WEIGHTS, min_confidence)), known, min_confidence)


def _transactions(labelled: DataFrame) -> DataFrame:
    return labelled.filter("label is not null").select(tokens_of(host_of(F.col("url")), path_of(F.col("url"))).alias("tokens"), "label")


def held_out_quality(labelled: DataFrame, default: str = "allow", parts: int = 5, **limits) -> DataFrame:
    """How mined rules do on hosts they weren't mined from: for each label its urls, those judged so, and those rightly.

    One host in `parts` (by hash) of labelled (url, label, and scope if scopes are to weigh the same) is held out.
    """
    out = F.pmod(F.xxhash64(host_of(F.col("url"))), F.lit(parts)) == 0
    seen = labelled.filter(~out)
    if "scope" in labelled.columns:
        tokens = tokens_of(host_of(F.col("url")), path_of(F.col("url")))
        mined = mine_decided(seen.select(tokens.alias("tokens"), F.struct(F.col("label").alias("verdict"), F.col("scope").alias("rule")).alias("given")), **limits)
    else:
        mined = mine(_transactions(seen), **limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(mined)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([index.verdict(t) or default for t in b.column(0).to_pylist()], pa.string())], ["label", "verdict"])

    said = _transactions(labelled.filter(out)).select("tokens", "label").mapInArrow(run, "label string, verdict string")
    each = said.groupBy("label", "verdict").agg(F.count("*").alias("n"))
    one = lambda c: each.groupBy(F.col(c).alias("label")).agg(F.sum("n").alias(f"n_{c}"))
    right = each.filter("label = verdict").select("label", F.col("n").alias("n_right"))
    return one("label").join(one("verdict"), "label", "full").join(right, "label", "left").na.fill(0)
