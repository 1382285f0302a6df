"""URL filters: explicit rules first, then a tree of path templates per host.

Only DataFrame functions.  A path's segments are read level by level.  Long hexadecimal runs and digit runs become
``{x}`` and ``{n}``.  At each node a child keeps its literal only if it has ``SUPPORT`` pages and its labelled
share of bad pages differs from its parent's by a chi-square test; rare children and those that do not differ are
merged into ``*``.  The literals that are left are pooled in steps of 1/``STEPS`` of that share and read in its order: a
step joins the branch before it unless the two shares differ by the same test, so siblings that are alike become one
branch ``{least literal|*}`` and are read on as one.  Levels are read until no page has a segment left that could keep its literal.  A template is rejected when its
share of bad pages, smoothed towards its host's and that towards the overall one, reaches ``REJECT``.

Each level sums pages by (host, template, segment) before the shuffle and joins the few literals it keeps, so a
host with a third of all pages costs partial sums, not a group; siblings are compared in arrays of at most
``STEPS`` + 1 entries however many literals a node has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellpanel.llm.storage import staged, table

#: Verdict, host and path of the registered rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
SUPPORT = 20
#: Levels between which pages that are finished leave the work; the SQL form reads so many and holds for such paths.
DEPTH = 3
#: Chi-square quantile (one degree of freedom, 5 %) beyond which a branch differs from its parent.
DIFFERS = 3.84
#: Siblings whose shares of bad pages fall into one of these steps are one branch; between steps the test decides.
STEPS = 256
SMOOTHING, REJECT = 10, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def _general(segment: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(segment, "[0-9a-fA-F]{16,}", "{x}"), "[0-9]+", "{n}")


def templates(pages: DataFrame) -> DataFrame:
    """Adds ``template`` to a stored table with (host, segments, bad); ``bad`` is 1, 0 or null for unlabelled."""
    rows, done, level = pages.withColumn("template", F.lit("")), [], 0
    deepest = pages.agg(F.max(F.size("segments"))).first()[0] or 0
    while True:
        rows = _levels(pages.columns, rows, level)
        level += DEPTH
        if level >= deepest:
            break
        done.append(rows.filter(F.size("segments") <= level))
        rows = staged(rows.filter(F.size("segments") > level), "deeper")
        # below a template with fewer pages than SUPPORT no literal is kept
        wide = staged(rows.groupBy("host", "template").count().filter(F.col("count") >= SUPPORT).select("host", "template"), "wide")
        rest = F.concat("template", F.repeat(F.lit("/*"), F.size("segments") - level))
        done.append(rows.join(wide, ["host", "template"], "left_anti").select(*pages.columns, rest.alias("template")))
        rows = staged(rows.join(wide, ["host", "template"], "left_semi").select(*pages.columns, "template"), "deeper")
        deepest = rows.agg(F.max(F.size("segments"))).first()[0] or 0
    for part in done:
        rows = rows.unionByName(part)
    return rows


def _alike(m: Column, b: Column, other_m: Column, other_b: Column) -> Column:
    """Whether two shares of bad pages, b of m each, agree by a chi-square test."""
    pages, bad, gap = (m + other_m).cast("double"), (b + other_b).cast("double"), (b * other_m - other_b * m).cast("double")
    return gap * gap * pages <= F.lit(DIFFERS) * m.cast("double") * other_m.cast("double") * (bad * (pages - bad))


def merge_siblings(kept: DataFrame) -> DataFrame:
    """``(host, template, segment, literal)`` of stored ``(host, template, segment, m, b)``, siblings that are alike under one name."""
    node = ["host", "template"]
    steps = kept.groupBy(*node, "step").agg(F.sum("m").alias("m"), F.sum("b").alias("b"), F.min("segment").alias("least"), F.count("*").alias("n"))
    ordered = steps.groupBy(*node).agg(F.sort_array(F.collect_list(F.struct("step", "m", "b", "least", "n"))).alias("steps"))
    none = F.expr("cast(array() as array<struct<steps: array<bigint>, m: bigint, b: bigint, least: string, n: bigint>>)")

    def branch(steps: Column, m: Column, b: Column, least: Column, n: Column) -> Column:
        return F.array(F.struct(steps.alias("steps"), m.alias("m"), b.alias("b"), least.alias("least"), n.alias("n")))

    def grown(found: Column, s: Column) -> Column:
        last = F.get(found, F.size(found) - 1)
        joined = branch(
            F.concat(last["steps"], F.array(s["step"])), last["m"] + s["m"], last["b"] + s["b"], F.least(last["least"], s["least"]), last["n"] + s["n"]
        )
        own = branch(F.array(s["step"]), s["m"], s["b"], s["least"], s["n"])
        return F.when((F.size(found) > 0) & _alike(last["m"], last["b"], s["m"], s["b"]), F.concat(F.slice(found, 1, F.size(found) - 1), joined)).otherwise(F.concat(found, own))

    named = F.when(F.col("branch.n") > 1, F.concat(F.lit("{"), F.col("branch.least"), F.lit("|*}"))).otherwise(F.col("branch.least"))
    branches = (
        ordered.select(*node, F.explode(F.aggregate("steps", none, grown)).alias("branch"))
        .select(*node, named.alias("literal"), F.explode("branch.steps").alias("step"))
    )
    return kept.join(branches, [*node, "step"]).select(*node, "segment", "literal")


def _levels(columns: list[str], rows: DataFrame, first: int) -> DataFrame:
    """``rows`` with the branches of DEPTH levels added to their templates."""
    counts = [F.count("*").alias("n"), F.count("bad").alias("m"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b")]
    for level in range(first, first + DEPTH):
        segment = F.get("segments", F.lit(level))
        here = rows.withColumn("segment", segment)
        children = here.filter("segment is not null").groupBy("host", "template", "segment").agg(*counts)
        parents = here.filter("segment is not null").groupBy("host", "template").agg(*counts).toDF("host", "template", "pn", "pm", "pb")
        gap = (F.col("b") * F.col("pm") - F.col("m") * F.col("pb")).cast("double")
        noise = (F.col("m") * F.col("pb")).cast("double") * (F.col("pm") - F.col("pb"))
        apart = staged(
            children.filter(F.col("n") >= SUPPORT).join(parents, ["host", "template"]).filter(gap * gap > F.lit(DIFFERS) * noise)
            .select("host", "template", "segment", "m", "b", F.expr(f"b * {STEPS} div m").alias("step")),
            "apart",
        )
        kept = staged(merge_siblings(apart), "literals")
        branch = F.when(F.col("segment").isNull(), "").otherwise(F.concat(F.lit("/"), F.coalesce("literal", F.lit("*"))))
        rows = (
            here.join(kept, ["host", "template", "segment"], "left")
            .withColumn("template", F.concat("template", branch)).select(*columns, "template")
        )
    return rows


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict, template)`` for every row of ``pages``.

    ``labels(doc_id, quality)`` mark a page through the document number that ends its path; quality 0 is bad, and a
    document labelled twice counts as bad if any label says so.  Null urls and such without ``://`` have an empty
    host and path and form one template.  Hosts without labels get the overall share.  Repeated rows are judged
    each; an empty table gives an empty result; other columns are not read.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    number = F.regexp_extract("path", r"([0-9]+)(\.[a-z]+)?/?$", 1).try_cast("long")
    # rows without a number get keys of their own that no document has, so they do not meet in one task
    key = F.coalesce(number, -F.pmod(F.xxhash64("page_id"), F.lit(1_000_003)) - 1)
    marks = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("key")).agg(F.max((F.col("quality") == 0).cast("int")).alias("bad"))
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    read = staged(
        split.withColumn("key", key).join(marks, "key", "left")
        .select("page_id", "host", "path", F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), _general).alias("segments"), "bad"),
        "urls",
    )
    found = templates(read)
    counts = [F.count("bad").alias("m"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b")]
    leaves = found.groupBy("host", "template").agg(*counts)
    hosts = read.groupBy("host").agg(*counts).toDF("host", "hm", "hb")
    overall = read.agg(*counts).toDF("gm", "gb")
    share = F.when(F.col("gm") > 0, F.col("gb") / F.col("gm")).otherwise(0.0)
    host_share = (F.col("hb") + SMOOTHING * F.col("g")) / (F.col("hm") + SMOOTHING)
    purity = (F.col("b") + SMOOTHING * host_share) / (F.col("m") + SMOOTHING)
    g = overall.select(share.alias("g")).first()["g"]
    rejected = staged(
        leaves.join(hosts, "host").withColumn("g", F.lit(g)).filter(purity >= REJECT).select("host", "template", F.lit("block").alias("learned")), "rejected"
    )
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return found.join(rejected, ["host", "template"], "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "learned", F.lit("allow")).alias("verdict"), "template"
    )


def op2_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def _sql() -> str:
    order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for _, h, p in order]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, order))
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, order))
    levels = ""
    for k in range(DEPTH):
        levels += f"""
h{k} AS (SELECT *, segs[{k + 1}] AS seg FROM t{k}),
c{k} AS (SELECT host, template, seg, count(*) n, count(bad) m, coalesce(sum(bad), 0) b FROM h{k} WHERE seg IS NOT NULL GROUP BY ALL),
p{k} AS (SELECT host, template, sum(m) pm, sum(b) pb FROM c{k} GROUP BY ALL),
q{k} AS (SELECT host, template, seg, m::BIGINT AS m, b::BIGINT AS b, (b::BIGINT * {STEPS}) // m::BIGINT AS step FROM c{k} JOIN p{k} USING (host, template)
  WHERE n >= {SUPPORT} AND (b * pm - m * pb)::DOUBLE * (b * pm - m * pb)::DOUBLE > {DIFFERS}::DOUBLE * ((m * pb)::DOUBLE * (pm - pb)::DOUBLE)),
b{k} AS (SELECT host, template, step, sum(m)::BIGINT AS m, sum(b)::BIGINT AS b, min(seg) AS least_seg, count(*) AS n,
    row_number() OVER (PARTITION BY host, template ORDER BY step) AS place FROM q{k} GROUP BY host, template, step),
w{k} AS (SELECT host, template, step, place, place AS branch, m, b FROM b{k} WHERE place = 1
  UNION ALL SELECT host, template, step, place, CASE WHEN alike THEN branch ELSE place END,
    CASE WHEN alike THEN wm + m ELSE m END, CASE WHEN alike THEN wb + b ELSE b END
  FROM (SELECT x.*, w.branch, w.m AS wm, w.b AS wb,
      (w.b * x.m - x.b * w.m)::DOUBLE * (w.b * x.m - x.b * w.m)::DOUBLE * (w.m + x.m)::DOUBLE
      <= {DIFFERS}::DOUBLE * w.m::DOUBLE * x.m::DOUBLE * ((w.b + x.b)::DOUBLE * ((w.m + x.m)::DOUBLE - (w.b + x.b)::DOUBLE)) AS alike
    FROM w{k} w JOIN b{k} x ON x.host = w.host AND x.template = w.template AND x.place = w.place + 1)),
g{k} AS (SELECT host, template, branch, min(least_seg) AS least_seg, sum(n) AS members
  FROM w{k} JOIN b{k} USING (host, template, step) GROUP BY ALL),
k{k} AS (SELECT host, template, seg, CASE WHEN members > 1 THEN '{{' || least_seg || '|*}}' ELSE seg END AS literal
  FROM q{k} JOIN w{k} USING (host, template, step) JOIN g{k} USING (host, template, branch)),
t{k + 1} AS (SELECT page_id, host, path, segs, bad, template || CASE WHEN seg IS NULL THEN '' ELSE '/' || coalesce(literal, '*') END AS template
  FROM h{k} LEFT JOIN k{k} USING (host, template, seg)),"""
    return rf"""
WITH RECURSIVE u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
marks AS (SELECT doc_id, max((quality = 0)::INT) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
t0 AS (SELECT page_id, host, path, bad, '' AS template,
    list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''),
      lambda x: regexp_replace(regexp_replace(x, '[0-9a-fA-F]{{16,}}', '{{x}}', 'g'), '[0-9]+', '{{n}}', 'g')) AS segs
  FROM s LEFT JOIN marks ON doc_id = TRY_CAST(regexp_extract(path, '([0-9]+)(\.[a-z]+)?/?$', 1) AS BIGINT)),{levels}
g AS (SELECT CASE WHEN count(bad) > 0 THEN sum(bad)::DOUBLE / count(bad) ELSE 0.0 END AS g FROM t0),
hosts AS (SELECT host, (coalesce(sum(bad), 0) + {SMOOTHING} * any_value(g)) / (count(bad) + {SMOOTHING}) AS share FROM t0, g GROUP BY host),
leaves AS (SELECT host, template, (coalesce(sum(bad), 0) + {SMOOTHING} * any_value(share)) / (count(bad) + {SMOOTHING}) AS purity
  FROM t{DEPTH} JOIN hosts USING (host) GROUP BY host, template)
SELECT page_id, host, path, CASE {rule} END AS rule,
  coalesce(CASE {verdict} END, CASE WHEN purity >= {REJECT} THEN 'block' END, 'allow') AS verdict, template
FROM t{DEPTH} JOIN leaves USING (host, template)
"""


SQL = _sql()
