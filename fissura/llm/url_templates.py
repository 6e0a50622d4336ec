"""Verdicts on URLs by rules, and by the purity of path templates beyond them.

Per host the paths form a tree. Digits in a segment are one sign, and where a
node has many children, none with most of the pages, they are variable: one
wildcard.
Children whose share of blocked pages does not differ significantly from that
of their siblings are merged. What was merged is one node: its members' children
count together. What is left along a path is its template. Pages
that a rule judges are the labels; a template whose smoothed share of blocked
pages reaches ``PURITY`` is rejected, and so are its other pages. A template
without labels is never rejected.

Only DataFrame functions are used. Pages are first added up by host and shape,
so the tree is built from far fewer rows than there are pages. A page counts
once however often its row is repeated, and no limit is a number of pages, so
verdicts do not change with the number of rows.

``SQL`` counts the children of each path as it is written, not of merged nodes,
calls them variable by ``PAGES`` for each, and counts repeated rows; both agree
where rows are not repeated and nodes have few children, as in the given tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fissura.llm.shared import stored

#: Host and path a rule is for, and its verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
CHILDREN = 8  # a node with at least so many children,
LARGEST = 0.5  # and no larger share of its pages below any of them, has variable children
PAGES = 20  # in ``SQL`` only: for each child
Z = 1.96  # of the two-sided test that keeps branches apart
STRENGTH = 4.0  # labels that the overall share counts as
PURITY = 0.8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.substr(url, F.instr(url, "://") + 3)
    there = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(there, host).otherwise(""), F.when(there, path).otherwise("")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def templates(shapes: DataFrame) -> DataFrame:
    """``host, shape, template`` of ``shapes (host, shape, n, labelled, blocked)``.

    From the root down, one round a level. The signs of the levels above are the
    node that a shape is in, so all that was merged shares its wildcards. Labels
    are compared among kin, the children of one segment or wildcard. A shape
    alone in its node has nothing to be merged with and ends there.
    """
    left = shapes.withColumns({"node": F.lit(""), "kin": F.lit(""), "rest": F.split("shape", "/")})
    ended, depth = [], 0
    while not ended or not left.isEmpty():
        placed = stored(_next_level(left, depth), "level")
        ended.append(placed.filter("ended").select("host", "shape", F.col("node").alias("template")))
        left, depth = placed.filter("not ended").drop("ended"), depth + 1
    return reduce(DataFrame.union, ended)


def _next_level(left: DataFrame, depth: int) -> DataFrame:
    """``left`` with the sign of the first segment of ``rest`` moved to ``node``."""
    left = left.withColumn("segment", F.col("rest")[0])
    add = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    branches = left.groupBy("host", "node", "kin", "segment").agg(F.count("*").alias("shapes"), *add)
    nodes = branches.groupBy("host", "node", "segment").agg(F.sum("shapes").alias("shapes"), F.sum("n").alias("n"))
    nodes = nodes.groupBy("host", "node").agg(
        F.count("*").alias("children"), F.sum("shapes").alias("all_shapes"),
        F.sum("n").alias("pages"), F.max("n").alias("largest"),
    )
    parents = branches.groupBy("host", "kin").agg(
        F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked")
    )
    variable = (F.col("children") >= CHILDREN) & (F.col("largest") <= LARGEST * F.col("pages"))
    own, rest = F.col("labelled"), F.col("all_labelled") - F.col("labelled")
    share, other = F.col("blocked") / own, (F.col("all_blocked") - F.col("blocked")) / rest
    pooled = F.col("all_blocked") / F.col("all_labelled")
    spread = Z * F.sqrt(pooled * (1 - pooled) * (1 / own + 1 / rest))
    similar = F.when((own > 0) & (rest > 0), F.abs(share - other) <= spread).otherwise(F.lit(False))
    sign = F.when(variable, F.lit("*")).when(similar, F.lit("~")).otherwise(F.col("segment"))
    signs = branches.join(parents, ["host", "kin"]).join(nodes, ["host", "node"]).select(
        "host", "kin", "segment", sign.alias("sign"),
        F.when(variable, F.lit("*")).otherwise(F.col("segment")).alias("kind"),
        (F.col("all_shapes") == 1).alias("alone"),
    )
    below = F.slice("rest", F.lit(2), F.size("rest"))
    signed, kin = (F.concat_ws("/", *pair) if depth else F.col(pair[1]) for pair in (("node", "sign"), ("kin", "kind")))
    return left.join(signs, ["host", "kin", "segment"]).select(
        "host", "shape", "n", "labelled", "blocked",
        F.when(F.col("alone"), F.array_join(F.concat(F.array(signed), below), "/")).otherwise(signed).alias("node"),
        kin.alias("kin"), below.alias("rest"), (F.col("alone") | (F.size("rest") == 1)).alias("ended"),
    )


def judge_urls(
    df: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` of every row of ``df``.

    A null url, or one without ``://``, has an empty host and path; these pages
    share a template like any others, and no rule fits them. Repeated rows and
    null ids are kept, but rows of the same id, host and path are one page to the
    templates; other columns are ignored; an empty table gives no rows.
    ``purity`` is the template's smoothed share of blocked pages, null without labels.
    """
    host, path = host_and_path(F.col(url_col))
    pages = df.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    name, ruled = rule_of(F.col("host"), F.col("path"), rules)
    more = {"rule": name, "ruled": ruled, "shape": F.regexp_replace("path", "[0-9]+", "#")}
    shapes = pages.distinct().withColumns(more).groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.count_if(F.col("ruled") == "block").alias("blocked")
    )
    shapes = stored(shapes, "shapes")
    placed = shapes.join(templates(shapes), ["host", "shape"])
    overall = shapes.agg(
        F.coalesce(F.sum("blocked") / F.nullif(F.sum("labelled"), F.lit(0)), F.lit(0.0)).alias("overall")
    )
    whole = placed.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    base = overall.first()[0]
    purity = F.when(
        F.col("labelled") > 0, F.round((F.col("blocked") + STRENGTH * base) / (F.col("labelled") + STRENGTH), 6)
    )
    pure = whole.select("host", "template", purity.alias("purity"))
    judged = placed.select("host", "shape", "template").join(pure, ["host", "template"])
    verdict = F.coalesce("ruled", F.when(F.col("purity") >= PURITY, F.lit("block")).otherwise(F.lit("allow")))
    return pages.withColumns(more).join(judged, ["host", "shape"]).select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity"
    )


SQL = f"""
WITH parsed AS (
  SELECT page_id,
    CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1),
      '{_UPPER}', '{_LOWER}') ELSE '' END AS host,
    CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1)
      ELSE '' END AS path
  FROM pages
), rules(rule_host, rule_path, what) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
    ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), known AS (
  SELECT host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    max_by(what, length(rule_host || rule_path)) AS ruled
  FROM (SELECT DISTINCT host, path FROM parsed) JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path
), ruled AS (
  SELECT p.page_id, p.host, p.path, k.rule, k.ruled, regexp_replace(p.path, '[0-9]+', '#', 'g') AS shape
  FROM parsed p LEFT JOIN known k ON p.host = k.host AND p.path = k.path
), shapes AS (
  SELECT host, shape, count(*) AS n, count(ruled) AS labelled, count(*) FILTER (ruled = 'block') AS blocked
  FROM ruled GROUP BY host, shape
), nodes AS (
  SELECT host, shape, n, labelled, blocked, d - 1 AS depth, string_split(shape, '/')[d] AS segment,
    array_to_string(string_split(shape, '/')[1:d - 1], '/') AS prefix
  FROM shapes, unnest(range(1, len(string_split(shape, '/')) + 1)) AS t(d)
), branches AS (
  SELECT host, depth, prefix, segment, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked
  FROM nodes GROUP BY ALL
), parents AS (
  SELECT host, depth, prefix, count(*) AS children, sum(n) AS pages, sum(labelled) AS al, sum(blocked) AS ab
  FROM branches GROUP BY ALL
), signs AS (
  SELECT host, depth, prefix, segment,
    CASE WHEN children >= {CHILDREN} AND pages < {PAGES} * children THEN '*'
      WHEN labelled > 0 AND al > labelled AND abs(blocked / labelled - (ab - blocked) / (al - labelled))
        <= {Z} * sqrt((ab / al) * (1 - ab / al) * (1 / labelled + 1 / (al - labelled))) THEN '~'
      ELSE segment END AS sign
  FROM branches JOIN parents USING (host, depth, prefix)
), placed AS (
  SELECT host, shape, string_agg(sign, '/' ORDER BY depth) AS template
  FROM nodes JOIN signs USING (host, depth, prefix, segment) GROUP BY host, shape
), pure AS (
  SELECT host, template, sum(labelled) AS labelled, sum(blocked) AS blocked
  FROM shapes JOIN placed USING (host, shape) GROUP BY host, template
), base AS (
  SELECT coalesce(sum(blocked) / nullif(sum(labelled), 0), 0.0) AS share FROM shapes
), judged AS (
  SELECT host, template,
    CASE WHEN labelled > 0 THEN round((blocked + {STRENGTH} * share) / (labelled + {STRENGTH}), 6) END AS purity
  FROM pure, base
)
SELECT page_id, host, path, rule,
  coalesce(ruled, CASE WHEN purity >= {PURITY} THEN 'block' ELSE 'allow' END) AS verdict, template,
  CAST(purity AS DOUBLE) AS purity
FROM ruled JOIN placed USING (host, shape) JOIN judged USING (host, template)
"""
