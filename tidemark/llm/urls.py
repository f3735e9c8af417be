"""URL filtering by rules and a per-host tree of path templates, native DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import look_up, materialize, read

# The contract's rules (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: A segment stays literal if it has this share of its parent's rows, or enough labelled rows whose rate stands out.
SHARE = 0.02
EVIDENCE = 10
#: Rates are alike within so many standard errors. A branch with fewer labelled rows than LEAST is not split further.
Z = 1.96
LEAST = 2
#: Labelled rows that a host's rate weighs in smoothing, and the least smoothed share of good rows.
PRIOR = 10.0
PURITY = 0.5
# Marks of a template. A path holds no question mark, so they are never segments.
ANY, REST, ALIKE = "?*", "?**", "?~"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. rules become one expression of the plan.

    Of rules of one length the one with the longer host goes first, then the order of verdict, host and path.
    """
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = (F if rule is None else rule).when(fits, h + p)
        verdict = (F if verdict is None else verdict).when(fits, kind)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def shape_of(path: Column) -> Column:
    """The path with long hexadecimal runs and digits generalised."""
    return F.regexp_replace(F.regexp_replace(path, "[0-9a-fA-F]{16,}", "~"), "[0-9]+", "#")


def _sums(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("lab").alias("lab"), F.sum("bad").alias("bad"), F.count("*").alias("rows"))


def _rate(bad: str, lab: str) -> Column:
    return (F.col(bad) + 1.0) / (F.col(lab) + 2.0)


def _far(rate: Column, whole: Column, lab: str, z: float) -> Column:
    return F.abs(rate - whole) >= z * F.sqrt(whole * (1.0 - whole) / F.greatest(F.col(lab), F.lit(1)))


def generalised(rows: DataFrame, share: float = SHARE, z: float = Z, evidence: int = EVIDENCE, least: int = LEAST) -> DataFrame:
    """(host, shape, n, lab, bad, tpl): each path shape's segments from the host down, variable ones as ANY.

    A segment is literal if it has a share of its siblings' rows, or `evidence` labelled rows whose bad rate lies z
    standard errors from its parent's; the children of all variable siblings are one node's children. Below a
    branch with fewer than `least` labelled rows there is nothing to tell apart: the rest is REST. As many levels
    as labelled branches have segments.
    """
    segs = F.split(F.regexp_replace("shape", r"\A/", ""), "/", -1)
    tree = rows.select("host", "shape", "n", "lab", "bad", segs.alias("segs"), F.array().cast("array<string>").alias("tpl"), F.lit(True).alias("open"))
    total, level = rows.count(), 0
    while True:
        live = F.col("open") & (F.size("segs") > level)
        if tree.filter(live).isEmpty():
            return tree.drop("segs", "open")
        tree = tree.withColumn("seg", F.when(live, F.get("segs", F.lit(level))))
        one = _sums(tree.filter("seg is not null"), "host", "tpl", "seg")
        whole = _sums(one.drop("rows"), "host", "tpl")
        met = look_up(one, materialize(whole, "parents"), ["host", "tpl"], "p", total, "rows")
        own = F.col("n") >= share * F.col("p.n")
        told = (F.col("lab") >= evidence) & _far(_rate("bad", "lab"), _rate("p.bad", "p.lab"), "lab", z)
        more = F.col("p.lab") >= least
        to = F.when(~more, REST).when(own | told, F.col("seg")).otherwise(ANY)
        named = materialize(met.select("host", "tpl", "seg", "rows", to.alias("to"), more.alias("more")), "named")
        tree = look_up(tree, named, ["host", "tpl", "seg"], "t", total, "rows")
        tree = tree.select(
            "host", "shape", "n", "lab", "bad", "segs", F.when(F.col("t").isNull(), F.col("tpl")).otherwise(F.array_append("tpl", F.col("t.to"))).alias("tpl"),
            F.coalesce("t.more", "open").alias("open"),
        )
        tree = materialize(tree, "tree")  # a row a shape; else the plan doubles with each level
        level += 1


def merged(leaves: DataFrame, z: float = Z) -> DataFrame:
    """leaves (host, tpl, n, lab, bad) with sfx, the path of their template after merging from the deepest level up.

    Siblings (an end of a path is one too) whose own children have all become one branch are compared: those within
    z standard errors of their common bad rate, and on either side of it those within z standard errors of their
    side's rate, become one branch if there are two or more. A branch whose children differ never merges, so no
    difference further down is lost.
    """
    deepest = leaves.agg(F.max(F.size("tpl"))).first()[0]
    leaves = leaves.withColumn("sfx", F.lit(""))
    for k in range((deepest if deepest is not None else -1) + 1, 0, -1):
        part = F.size("tpl") >= k - 1
        label = F.when(F.size("tpl") >= k, F.concat(F.lit("/"), F.get("tpl", F.lit(k - 1)))).otherwise("")
        leaves = leaves.withColumns({"pre": F.when(part, F.slice("tpl", 1, k - 1)), "label": F.when(part, label)})
        flat = (F.min("sfx") == F.max("sfx")).alias("flat")
        nodes = leaves.filter(part).groupBy("host", "pre", "label").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad"), flat)
        # Siblings are few: each has a share of its parent's rows or evidence of its own.
        of = Window.partitionBy("host", "pre", "flat")
        nodes = nodes.withColumns({"plab": F.sum("lab").over(of), "pbad": F.sum("bad").over(of), "rate": _rate("bad", "lab")})
        apart = (F.col("lab") > 0) & _far(F.col("rate"), _rate("pbad", "plab"), "lab", z)
        nodes = nodes.withColumn("side", F.when(~apart, "").when(F.col("rate") > _rate("pbad", "plab"), "+").otherwise("-"))
        of = Window.partitionBy("host", "pre", "flat", "side")
        nodes = nodes.withColumns({"slab": F.sum("lab").over(of), "sbad": F.sum("bad").over(of)})
        near = F.col("flat") & ((F.col("lab") == 0) | ~_far(F.col("rate"), _rate("sbad", "slab"), "lab", z))
        nodes = nodes.withColumn("near", near).withColumn("alike", F.count(F.when(F.col("near"), 1)).over(of))
        one = F.when(F.col("near") & (F.col("alike") > 1), F.concat(F.lit(f"/{ALIKE}"), F.col("side")))
        named = nodes.select(F.col("host").alias("h"), F.col("pre").alias("p"), F.col("label").alias("l"), one.alias("one"))
        met = leaves.join(named, (F.col("host") == F.col("h")) & (F.col("pre") == F.col("p")) & (F.col("label") == F.col("l")), "left")
        sfx = F.when(F.col("label").isNull(), F.col("sfx")).otherwise(F.coalesce("one", F.concat("label", "sfx")))
        leaves = materialize(met.select("host", "tpl", "n", "lab", "bad", sfx.alias("sfx")), "leaves")
    return leaves


def templates(rows: DataFrame, share: float = SHARE, z: float = Z, prior: float = PRIOR) -> DataFrame:
    """(host, shape, n, template, purity): the template of every path shape of a host and its purity.

    rows is a written table of host, shape, n, lab, bad: rows, labelled rows and bad ones of a path shape. From the
    host down variable segments become wildcards; from the deepest level up statistically similar branches merge.
    purity is the share of good rows of the template, smoothed by the host's, which is smoothed by that of all rows.
    """
    tree = materialize(generalised(rows, share, z), "tree")
    leaves = merged(_sums(tree, "host", "tpl").drop("rows"), z)
    total = rows.agg(F.sum("lab"), F.sum("bad")).first()  # two numbers
    lab, bad = total[0] or 0, total[1] or 0
    overall = (lab - bad + 1.0) / (lab + 2.0)
    host = rows.groupBy("host").agg(((F.sum("lab") - F.sum("bad") + prior * overall) / (F.sum("lab") + prior)).alias("hg"))
    found = _sums(leaves, "host", "sfx").join(host, "host")
    purity = (F.col("lab") - F.col("bad") + prior * F.col("hg")) / (F.col("lab") + prior)
    found = leaves.select("host", "tpl", "sfx").join(found.select("host", "sfx", purity.alias("purity")), ["host", "sfx"])
    return tree.join(found, ["host", "tpl"]).select("host", "shape", "n", F.concat("host", "sfx").alias("template"), "purity")


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, purity: float = PURITY) -> DataFrame:
    """(page_id, host, path, rule, verdict, template): one row per row of pages.

    pages has page_id and url; labelled has url_key long and bad int: labels of urls by the last number in
    their path, repeats allowed (bad if any is). The longest rule that fits decides; elsewhere the verdict
    is block if the smoothed purity of the url's template is under `purity`, else allow. A null url or one
    without ``://`` has empty host and path, which form a template like any other. Whole urls of any length
    count. Rules of one length go by rule_of()'s order. Repeated rows stay repeated, other columns are ignored,
    an empty table gives an empty result, no labels allow everything. The rows of a hot shape stay where they are.
    """
    urls = pages.select(pages["page_id"], host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"))
    urls = urls.withColumn("shape", shape_of(F.col("path")))
    known = labelled.groupBy("url_key").agg(F.max("bad").alias("bad"))
    # Urls are counted by shape and key before they meet the labels.
    key = F.expr(r"try_cast(regexp_extract(path, '([0-9]+)[^0-9/]*/?$', 1) AS bigint)")
    counted = urls.groupBy("host", "shape", key.alias("url_key")).agg(F.count("*").alias("n"))
    met = counted.join(known, "url_key", "left")
    rows = met.groupBy("host", "shape").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("bad").isNotNull(), F.col("n")).otherwise(0)).alias("lab"),
        F.sum(F.when(F.col("bad") == 1, F.col("n")).otherwise(0)).alias("bad"),
    )
    found = materialize(templates(materialize(rows, "shapes")), "templates")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("t.purity") < purity, "block").otherwise("allow")
    return look_up(urls, found, ["host", "shape"], "t", pages.count()).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.col("t.template").alias("template")
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns. A page's path ends in the number of the document it shows, which labels name."""
    labels = read(spark, sf_dir, "labels")
    bad = ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")
    out = judge(read(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("url_key"), bad.alias("bad")))
    return out.drop("template")


#: Levels that the SQL unrolls; the operator goes as deep as the paths.
SQL_LEVELS = 5


def _sql(levels: int = SQL_LEVELS) -> str:
    order = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    case = lambda of: "\n".join(f"    WHEN (u.host = '{r[1]}' OR ends_with(u.host, '.{r[1]}')) AND starts_with(path, '{r[2]}') THEN '{of(r)}'" for r in order)
    rate = lambda bad, lab: f"(({bad} + 1.0::DOUBLE) / ({lab} + 2.0::DOUBLE))"
    far = lambda r, w: f"(abs({r} - {w}) >= {Z}::DOUBLE * sqrt({w} * (1.0::DOUBLE - {w}) / greatest(lab, 1)))"
    down = up = ""
    for k in range(1, levels + 1):
        down += f"""
a{k} AS MATERIALIZED (SELECT *, CASE WHEN open AND len(segs) >= {k} THEN segs[{k}] END AS seg FROM x{k - 1}),
c{k} AS MATERIALIZED (SELECT host, tpl, seg, sum(n) AS n, sum(lab) AS lab, sum(bad) AS bad FROM a{k} WHERE seg IS NOT NULL GROUP BY ALL),
p{k} AS MATERIALIZED (SELECT *, sum(n) OVER w AS pn, sum(lab) OVER w AS plab, sum(bad) OVER w AS pbad FROM c{k} WINDOW w AS (PARTITION BY host, tpl)),
l{k} AS MATERIALIZED (SELECT host, tpl, seg, plab >= {LEAST} AS more, CASE WHEN plab < {LEAST} THEN '{REST}'
  WHEN n >= {SHARE}::DOUBLE * pn OR (lab >= {EVIDENCE} AND {far(rate('bad', 'lab'), rate('pbad', 'plab'))}) THEN seg ELSE '{ANY}' END AS t FROM p{k}),
x{k} AS MATERIALIZED (SELECT a.host, shape, segs, n, lab, bad, CASE WHEN t IS NULL THEN a.tpl ELSE list_append(a.tpl, t) END AS tpl, coalesce(more, open) AS open
  FROM a{k} a LEFT JOIN l{k} l ON a.host = l.host AND a.tpl = l.tpl AND a.seg = l.seg),"""
    for k in range(levels + 1, 0, -1):
        up += f"""
d{k} AS MATERIALIZED (SELECT *, CASE WHEN len(tpl) >= {k - 1} THEN tpl[1:{k - 1}] END AS pre,
  CASE WHEN len(tpl) >= {k} THEN '/' || tpl[{k}] WHEN len(tpl) = {k - 1} THEN '' END AS label FROM y{k + 1}),
e{k} AS MATERIALIZED (SELECT host, pre, label, sum(lab) AS lab, sum(bad) AS bad, min(sfx) = max(sfx) AS flat, {rate('sum(bad)', 'sum(lab)')} AS rate
  FROM d{k} WHERE label IS NOT NULL GROUP BY host, pre, label),
f{k} AS MATERIALIZED (SELECT *, sum(lab) OVER w AS plab, sum(bad) OVER w AS pbad FROM e{k} WINDOW w AS (PARTITION BY host, pre, flat)),
g{k} AS MATERIALIZED (SELECT *, CASE WHEN NOT (lab > 0 AND {far('rate', rate('pbad', 'plab'))}) THEN '' WHEN rate > {rate('pbad', 'plab')} THEN '+' ELSE '-' END AS side FROM f{k}),
h{k} AS MATERIALIZED (SELECT *, sum(lab) OVER w AS slab, sum(bad) OVER w AS sbad FROM g{k} WINDOW w AS (PARTITION BY host, pre, flat, side)),
i{k} AS MATERIALIZED (SELECT *, flat AND (lab = 0 OR NOT {far('rate', rate('sbad', 'slab'))}) AS near FROM h{k}),
j{k} AS MATERIALIZED (SELECT *, count(*) FILTER (WHERE near) OVER (PARTITION BY host, pre, flat, side) AS alike FROM i{k}),
y{k} AS MATERIALIZED (SELECT d.host, tpl, d.n, d.lab, d.bad,
  CASE WHEN d.label IS NULL THEN sfx WHEN j.near AND alike > 1 THEN '/{ALIKE}' || side ELSE d.label || sfx END AS sfx
  FROM d{k} d LEFT JOIN j{k} j ON d.host = j.host AND d.pre = j.pre AND d.label = j.label),"""
    return rf"""
WITH u AS MATERIALIZED (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)\A.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
v AS MATERIALIZED (SELECT *, regexp_replace(regexp_replace(path, '[0-9a-fA-F]{{16,}}', '~', 'g'), '[0-9]+', '#', 'g') AS shape,
         try_cast(regexp_extract(path, '([0-9]+)[^0-9/]*/?$', 1) AS BIGINT) AS url_key FROM u),
k AS MATERIALIZED (SELECT doc_id AS url_key, max((coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1)::INT) AS bad FROM labels GROUP BY doc_id),
s AS MATERIALIZED (SELECT host, shape, count(*) AS n, count(bad) AS lab, coalesce(sum(bad), 0) AS bad FROM v LEFT JOIN k USING (url_key) GROUP BY ALL),
x0 AS MATERIALIZED (SELECT *, string_split(regexp_replace(shape, '^/', ''), '/') AS segs, []::VARCHAR[] AS tpl, true AS open FROM s),{down}
y{levels + 2} AS MATERIALIZED (SELECT host, tpl, sum(n) AS n, sum(lab) AS lab, sum(bad) AS bad, '' AS sfx FROM x{levels} GROUP BY host, tpl),{up}
o AS (SELECT (sum(lab) - sum(bad) + 1.0::DOUBLE) / (sum(lab) + 2.0::DOUBLE) AS overall FROM s),
q AS (SELECT host, (sum(lab) - sum(bad) + {PRIOR}::DOUBLE * (SELECT overall FROM o)) / (sum(lab) + {PRIOR}::DOUBLE) AS hg FROM s GROUP BY host),
z AS MATERIALIZED (SELECT y1.host, tpl, (sum(lab) OVER w - sum(bad) OVER w + {PRIOR}::DOUBLE * hg) / (sum(lab) OVER w + {PRIOR}::DOUBLE) AS purity
      FROM y1 JOIN q ON y1.host = q.host WINDOW w AS (PARTITION BY y1.host, sfx))
SELECT page_id, u.host, path, CASE
{case(lambda r: r[1] + r[2])} END AS rule,
  coalesce(CASE
{case(lambda r: r[0])} END, CASE WHEN purity < {PURITY}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict
FROM v u JOIN x{levels} x ON u.host = x.host AND u.shape = x.shape JOIN z ON x.host = z.host AND x.tpl = z.tpl
"""


SQL = _sql()
