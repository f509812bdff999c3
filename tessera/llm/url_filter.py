"""URL filter: rules first, then a path-template tree whose templates are judged by labelled purity.

For each host, paths are generalised level by level: under a template's prefix, a segment stays literal if it is frequent there (a given
support and share), otherwise it becomes the wildcard ``*``.  The tree is as deep as paths have frequent prefixes; segments beyond ``depth`` count as one, ``**``.
Then, from the deepest level to the first, templates of a host that differ in that level's segment alone are
branches of one node; those whose blocked share among labelled pages does not differ from the node's (a chi-square test) are
merged, and the segment becomes ``~``.  A literal segment that begins with ``*``, ``~`` or ``\\`` is written with a ``\\`` before it, so no literal looks like a
wildcard.  The pages that a rule decides are the labels.  A node is rejected if it has enough labelled pages and its blocked share reaches a threshold, smoothed
towards the share over all labelled pages, which itself starts from pseudo-counts of allowed pages: few labels, or labels of one kind only, reject nothing.

The tree is built over distinct paths with their numbers of pages, so that a page that is met often is one row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scratch import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, its subdomains, and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


@dataclass(frozen=True)
class TemplateSettings:
    depth: int = 8
    support: int = 3
    share: int = 20  # a literal segment has at least one in so many of its parent's pages
    least_labels: int = 5
    chi_square: float = 3.84
    prior: float = 10.0
    purity: float = 0.9


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _first_fit(rules: list[Rule], host: Column, path: Column, value) -> Column:
    longest = sorted(rules, key=lambda r: -len(r.name))
    if not longest:
        return F.lit(None).cast("string")
    whens = reduce(lambda acc, r: acc.when(r.fits(host, path), F.lit(value(r))), longest[1:], F.when(longest[0].fits(host, path), F.lit(value(longest[0]))))
    return whens


def _segments(path: Column) -> Column:
    """Segments of a path, those that look like a wildcard escaped."""
    escaped = lambda x: F.when(x.rlike(r"^[*~\\]"), F.concat(F.lit("\\"), x)).otherwise(x)
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(F.substring(path, 2, 1 << 30), "/", -1), escaped))


def with_templates(paths: DataFrame, settings: TemplateSettings) -> DataFrame:
    """Add ``template`` to distinct rows with ``host``, ``path`` and the number of pages ``_pages``."""
    rows = paths.withColumn("_segments", _segments(F.col("path"))).withColumn("template", F.lit(""))
    deepest = rows.agg(F.max(F.size("_segments"))).first()[0] or 0
    for depth in range(1, min(deepest, settings.depth) + 1):
        here = F.when(F.size("_segments") >= depth, F.get("_segments", F.lit(depth - 1)))
        if depth == settings.depth:
            here = F.when(F.size("_segments") > depth, F.lit("**")).otherwise(here)
        rows = rows.withColumn("_segment", here)
        branches = rows.filter(F.col("_segment").isNotNull()).groupBy("host", "template", "_segment").agg(F.sum("_pages").alias("_n"))
        totals = branches.groupBy("host", "template").agg(F.sum("_n").alias("_total"))
        literal = stage(
            branches.filter(F.col("_n") >= settings.support)
            .join(totals, ["host", "template"])
            .filter(F.col("_n") * settings.share >= F.col("_total"))
            .select("host", "template", "_segment", F.lit(True).alias("_literal")),
            "urls-literals",
        )
        step = F.when(F.col("_literal"), F.col("_segment")).otherwise(F.lit("*"))
        # the written table's size is known: Spark broadcasts it if it is small
        rows = stage(rows.join(literal, ["host", "template", "_segment"], "left").withColumn(
            "template", F.when(F.col("_segment").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), step))
        ).drop("_literal", "_segment"), "urls-templates")
    return rows.drop("_segments")


def judged_templates(rows: DataFrame, labelled: int, blocked: int, settings: TemplateSettings) -> DataFrame:
    """``host, template, node, purity, _rejected`` for each template of ``rows`` (``host, template, _pages, _label``)."""
    pages = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("_pages"))), F.lit(0)).cast("double")
    stats = rows.groupBy("host", "template").agg(pages(F.col("_label").isNotNull()).alias("_labelled"), pages(F.col("_label") == "block").alias("_blocked"))
    segments = F.when(F.col("template") == "", F.array().cast("array<string>")).otherwise(F.split(F.substring("template", 2, 1 << 30), "/", -1))
    nodes = stage(stats.withColumn("_node", segments), "urls-nodes")
    deepest = nodes.agg(F.max(F.size("_node"))).first()[0] or 0
    nodes = nodes.repartition("host")  # a host has at most ``share`` literals under each prefix
    total = lambda column, *by: F.sum(column).over(W.partitionBy("host", *by))
    for depth in range(deepest, 0, -1):
        merged = F.transform("_node", lambda x, i: F.when(i == depth - 1, F.lit("~")).otherwise(x))
        nodes = nodes.withColumn("_shape", merged)
        n, b, N, B = (total(c, by) for by in ("_node", "_shape") for c in ("_labelled", "_blocked"))
        nodes = nodes.withColumns({"_n": n, "_b": b, "_all": N, "_all_blocked": B})
        n, b, N, B = (F.col(c) for c in ("_n", "_b", "_all", "_all_blocked"))
        similar = (n >= settings.least_labels) & (n < N) & ((b * N - n * B) * (b * N - n * B) <= settings.chi_square * n * B * (N - B))
        nodes = nodes.withColumn("_node", F.when(similar, F.col("_shape")).otherwise(F.col("_node"))).drop("_shape", "_n", "_b", "_all", "_all_blocked")
    prior = blocked / (labelled + settings.prior)
    of_node = total("_labelled", "_node")
    purity = (total("_blocked", "_node") + settings.prior * prior) / (of_node + settings.prior)
    name = F.when(F.size("_node") == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join("_node", "/")))
    return nodes.select("host", "template", name.alias("node"), purity.alias("purity"), ((of_node >= settings.least_labels) & (purity >= settings.purity)).alias("_rejected"))


def filter_urls(
    df: DataFrame, rules: list[Rule], settings: TemplateSettings = TemplateSettings(), id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """Judge every row's url: ``<id_col>, host, path, rule, verdict, template, node, purity``.

    The longest rule that fits decides; else the method does: block if the template's node is rejected, else allow.  A null url, or one without
    ``://``, has an empty host and path and is judged like any other.  Rules of equal length keep the given order.  Repeated rows are judged
    one by one; a null id is kept.  An empty table gives no rows.  Other columns are ignored, whatever their names.
    """
    pages = df.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    host, path = F.col("host"), F.col("path")
    pages = stage(
        pages.withColumn("rule", _first_fit(rules, host, path, lambda r: r.name)).withColumn("_label", _first_fit(rules, host, path, lambda r: r.verdict)),
        "urls",
    )
    labelled, blocked = pages.agg(F.count("_label"), F.count(F.when(F.col("_label") == "block", 1))).first()
    # a label follows from host and path
    paths = pages.groupBy("host", "path").agg(F.count(F.lit(1)).alias("_pages"), F.any_value("_label").alias("_label"))
    rows = with_templates(stage(paths, "urls-paths"), settings)
    judged = rows.join(judged_templates(rows, labelled, blocked, settings), ["host", "template"]).drop("_pages", "_label")
    verdict = F.coalesce("_label", F.when(F.col("_rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return pages.join(judged, ["host", "path"]).select(
        F.col("_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", "node", "purity"
    )


def oracle_sql(rules: list[Rule], settings: TemplateSettings = TemplateSettings()) -> str:
    """DuckDB SQL for ``filter_urls`` over ``pages``.

    Templates are lists of ``(kind, text)`` here and become strings in the last step only, so the escapes of the operator are not repeated.
    """
    longest = sorted(rules, key=lambda r: -len(r.name))
    fits = lambda r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{value(r)}'" for r in longest) + " END"
    ctes = [
        r"u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) AS h, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)",
        f"p AS (SELECT page_id, translate(h, '{UPPER}', '{LOWER}') AS host, path FROM u)",
        f"r0 AS MATERIALIZED (SELECT *, {case(lambda r: r.name)} AS rule, {case(lambda r: r.verdict)} AS label,"
        " CASE WHEN path = '' THEN [] ELSE string_split(path[2:], '/') END AS s, CAST([] AS STRUCT(k VARCHAR, v VARCHAR)[]) AS t FROM p)",
    ]
    last = settings.depth
    for d in range(1, last + 1):
        here = f"{{'k': 'one', 'v': s[{d}]}}"
        if d == last:
            here = f"CASE WHEN len(s) > {d} THEN {{'k': 'rest', 'v': ''}} ELSE {here} END"
        ctes += [
            f"a{d} AS (SELECT *, CASE WHEN len(s) >= {d} THEN {here} END AS seg FROM r{d - 1})",
            f"b{d} AS (SELECT host, t, seg, count(*) AS n FROM a{d} WHERE seg IS NOT NULL GROUP BY ALL)",
            f"k{d} AS (SELECT host, t, seg FROM b{d} QUALIFY n >= {settings.support} AND n * {settings.share} >= sum(n) OVER (PARTITION BY host, t))",
            f"r{d} AS MATERIALIZED (SELECT a.* EXCLUDE (t, seg), CASE WHEN a.seg IS NULL THEN a.t WHEN k.seg IS NULL THEN list_append(a.t, {{'k': 'any', 'v': ''}})"
            f" ELSE list_append(a.t, a.seg) END AS t FROM a{d} a LEFT JOIN k{d} k ON k.host = a.host AND k.t = a.t AND k.seg = a.seg)",
        ]
    ctes += [f"n{last} AS MATERIALIZED (SELECT host, t, t AS node, CAST(count(label) AS DOUBLE) AS n, CAST(count(*) FILTER (label = 'block') AS DOUBLE) AS b FROM r{last} GROUP BY host, t)"]
    for d in range(last, 0, -1):
        ctes += [
            f"s{d} AS (SELECT *, list_transform(node, lambda x, i: CASE WHEN i = {d} THEN {{'k': 'merged', 'v': ''}} ELSE x END) AS shape FROM n{d})",
            f"q{d} AS (SELECT *, sum(n) OVER one AS m, sum(b) OVER one AS mb, sum(n) OVER alike AS big, sum(b) OVER alike AS bigb FROM s{d}"
            " WINDOW one AS (PARTITION BY host, node), alike AS (PARTITION BY host, shape))",
            f"n{d - 1} AS MATERIALIZED (SELECT host, t, n, b, CASE WHEN m >= {settings.least_labels} AND m < big"
            f" AND (mb * big - m * bigb) * (mb * big - m * bigb) <= {settings.chi_square}::DOUBLE * m * bigb * (big - bigb) THEN shape ELSE node END AS node FROM q{d})",
        ]
    ctes += [
        f"g AS (SELECT count(*) FILTER (label = 'block')::DOUBLE / (count(label)::DOUBLE + {settings.prior}::DOUBLE) AS prior FROM r{last})",
        f"j AS (SELECT host, t, node, sum(n) OVER w AS labelled, (sum(b) OVER w + {settings.prior}::DOUBLE * prior) / (sum(n) OVER w + {settings.prior}::DOUBLE) AS purity"
        " FROM n0, g WINDOW w AS (PARTITION BY host, node))",
    ]
    verdict = f"coalesce(label, CASE WHEN labelled >= {settings.least_labels} AND purity >= {settings.purity}::DOUBLE THEN 'block' ELSE 'allow' END)"
    sign = "CASE x.k WHEN 'any' THEN '*' WHEN 'rest' THEN '**' WHEN 'merged' THEN '~' ELSE CASE WHEN x.v[1] IN ('*', '~', chr(92)) THEN chr(92) ELSE '' END || x.v END"
    written = lambda column: f"CASE WHEN len({column}) = 0 THEN '' ELSE '/' || array_to_string(list_transform({column}, lambda x: {sign}), '/') END"
    return f"WITH {', '.join(ctes)} SELECT page_id, host, path, rule, {verdict} AS verdict, {written('t')} AS template, {written('node')} AS node, purity FROM r{last} JOIN j USING (host, t)"
