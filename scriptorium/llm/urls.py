"""URL rules by host-suffix and path-prefix expressions, with DataFrame functions only.

A rule is a host suffix, a path prefix and an action. Each URL is expanded into the expressions that any rule could have:
for every shape of the rule table (number of host labels, length of the path) the suffix of so many labels and the
prefix of so many characters. Expressions are joined to the rules on the first ``prefix_hex`` hex digits of their
SHA-256; the full digests are then compared, and the longest rule (host and path together, then host, then block before
allow) decides.

Scale: the expressions of one URL stand next to each other in one partition, so the aggregate that brings them together
again reduces map-side to one row per URL, by a row number that no two URLs share: no hot host can gather in a task. The
rules are broadcast only below ``broadcast_rules`` rows, by their count; else they join by a shuffle that adaptive
execution can split. Only the distinct shapes are collected: at most the label counts times the path lengths that the rules
have. A URL is expanded into the shapes that fit it and no others; beyond ``inline_shapes`` shapes by lists of the lengths
for each label count instead of one expression each.

Defined results: a null URL, or one without ``://``, has an empty host and path and meets no rule; rules with a null
part are ignored; repeated rules count once; repeated rows give repeated rows; an empty table gives no row, without rules
the default stands; very long URLs are judged whole; ties between rules are decided as above; only the identifier and URL
are read, so no column name clashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import LOWER, UPPER

# The rules that the contract names (host, path, action).
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """The rules as a DataFrame, made of literals."""
    made = [F.struct(*(F.lit(v).cast("string").alias(n) for n, v in zip(("host", "path", "action"), r, strict=True))) for r in rules]
    return spark.range(1).select(F.inline(F.array(*made)))


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _text(host: F.Column, path: F.Column) -> F.Column:
    # a line feed cannot be confused with a part of the other
    return F.concat(host, F.lit("\n"), path)


def _expressions(host: F.Column, path: F.Column, shapes: list[tuple[int, int]], inline_shapes: int) -> F.Column:
    """All (host suffix, path prefix) of the shapes that fit, as texts."""
    if not shapes:
        return F.array().cast("array<string>")
    parts = F.split(host, r"\.")
    if len(shapes) <= inline_shapes:
        made = [F.when((F.size(parts) >= n) & (F.length(path) >= k), _text(F.substring_index(host, ".", -n), F.substring(path, 1, k))) for n, k in shapes]
        return F.array_compact(F.array(*made))
    by_labels: dict[int, list[str]] = {}
    for n, k in shapes:
        by_labels.setdefault(n, []).append(str(k))

    def of(n: int, lengths: list[str]) -> F.Column:
        # the list is a constant, made once
        fits = F.filter(F.split(F.lit(",".join(lengths)), ",").cast("array<int>"), lambda k: k <= F.length(path))
        suffix = F.substring_index(host, ".", -n)
        return F.when(F.size(parts) >= n, F.transform(fits, lambda k: _text(suffix, F.substr(path, F.lit(1), k)))).otherwise(F.array().cast("array<string>"))

    return F.concat(*(of(n, lengths) for n, lengths in by_labels.items()))


def judge(
    pages: DataFrame,
    rules: DataFrame,
    *,
    default: str = "allow",
    prefix_hex: int = 8,
    broadcast_rules: int = 200_000,
    inline_shapes: int = 500,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, the rule that decides (host and path, else null) and the verdict."""
    order = F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), (F.col("action") == "block").alias("block"), F.concat("host", "path").alias("rule"), F.col("action").alias("action"))
    known = rules.where("host is not null and path is not null and action is not null")
    known = known.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "action").distinct()
    found = known.select(F.size(F.split("host", r"\.")).alias("n"), F.length("path").alias("k")).distinct().collect()
    shapes = sorted((r.n, r.k) for r in found)
    by_prefix = (
        known.select(F.sha2(_text(F.col("host"), F.col("path")), 256).alias("digest"), order.alias("order"))
        .groupBy("digest")
        .agg(F.max("order").alias("order"))
        .groupBy(F.substring("digest", 1, prefix_hex).alias("prefix"))
        .agg(F.collect_list(F.struct("digest", "order")).alias("candidates"))
    )
    small = known.count() <= broadcast_rules

    host, path = split_url(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    spread = rows.withColumn("expression", F.explode_outer(_expressions(F.col("host"), F.col("path"), shapes, inline_shapes))).withColumn("full", F.sha2("expression", 256)).drop("expression")
    spread = spread.withColumn("prefix", F.substring("full", 1, prefix_hex))
    met = spread.join(F.broadcast(by_prefix) if small else by_prefix, "prefix", "left")
    confirmed = F.try_element_at(F.filter("candidates", lambda c: c.digest == F.col("full")), F.lit(1)).getField("order")
    best = met.withColumn("order", confirmed).groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("order").alias("order"))
    return best.select("page_id", "host", "path", F.col("order.rule").alias("rule"), F.coalesce("order.action", F.lit(default)).alias("verdict"))


SQL = r"""
WITH r(h, p, action) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
s AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS k FROM s),
m AS (
  SELECT k, arg_max(h || p, len(h || p)) AS rule, arg_max(action, len(h || p)) AS action
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM u LEFT JOIN m USING (k)
"""
