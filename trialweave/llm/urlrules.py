"""URL filter: a path-template tree per host, pruned by labelled purity, under explicit rules.

1. A path's segments are typed: digits become ``{n}``, long hexadecimal runs ``{id}``.
2. The tree of typed segments is walked from the host down.  Of a node's children, those that are statistically like
   the node's other children (a two-proportion test on labelled bad pages) are merged into one wildcard branch ``*``;
   only branches that differ significantly keep their own.  The walk ends where a node holds one typed path only.
3. A template's share of bad labels is smoothed by its host's, and the host's by the whole table's; a template whose
   smoothed share reaches ``REJECT`` is blocked.
4. Explicit rules (host with all its subdomains, path prefix) come first; the longest that fits wins.

Scale: pages are counted once into (host, typed path) rows with map-side partial sums; the tree is built on those by
one small shuffle per level that two paths share; pages meet their template's verdict by one join on (host, typed path) that adaptive
execution splits where a host holds most rows.

Defined results: a null url, or one without ``://``, has an empty host and path (and may still be judged by the
method, under host '').  Pages without a label count for nothing in purity.  A page with several labels is bad if one
says so.  Null page_id has no label.  Repeated rows each get their row.  Empty tables give no rows; with no labels at
all every template is allowed.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stage, table

#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Levels that the SQL spells out, deeper ones being one wildcard ``**`` there; here the tree has no such bound.
DEPTH = 4
#: Two-sided 5 % point of the normal distribution; weight of the parent's share; smoothed bad share that is rejected.
Z, PRIOR, REJECT = 1.96, 5.0, 0.5
#: Rows up to which the template table is broadcast.
MAX_BROADCAST_ROWS = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p).otherwise(name)
        verdict = F.when(fits, says).otherwise(verdict)
    return name, verdict


def typed_path(path: Column) -> Column:
    """Array of all typed segments."""
    p = F.regexp_replace(F.regexp_replace(path, "[0-9a-fA-F]{16,}", "{id}"), "[0-9]+", "{n}")
    return F.filter(F.split(p, "/"), lambda s: s != "")


def templates(counted: DataFrame) -> DataFrame:
    """(host, typed, template, bad_share) from (host, typed, n, labelled, bad)."""
    tree, done = counted.select("host", "typed", "labelled", "bad", F.lit("").alias("node")), []
    for d in itertools.count(1):
        child = F.coalesce(F.get(F.col("typed"), F.lit(d - 1)), F.lit("$"))
        tree = tree.withColumn("child", child)
        kids = tree.groupBy("host", "node", "child").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"), F.count(F.lit(1)).alias("paths"), F.max(F.size("typed")).alias("deep"))
        kids = stage(kids, f"kids-{d}")
        node = kids.groupBy("host", "node").agg(F.sum("l").alias("node_l"), F.sum("b").alias("node_b"), F.count(F.lit(1)).alias("kids"), ((F.sum("paths") == 1) | (F.max("deep") < d)).alias("over"))
        kids = kids.join(small(stage(node, f"nodes-{d}"), MAX_BROADCAST_ROWS), ["host", "node"])  # a node of many children is split here
        rest_l, rest_b = F.col("node_l") - F.col("l"), F.col("node_b") - F.col("b")
        share = F.col("node_b") / F.greatest(F.col("node_l"), F.lit(1))
        spread = F.sqrt(share * (1 - share) * (1 / F.greatest(F.col("l"), F.lit(1)) + 1 / F.greatest(rest_l, F.lit(1))))
        apart = (F.col("l") > 0) & (rest_l > 0) & (F.abs(F.col("b") / F.greatest(F.col("l"), F.lit(1)) - rest_b / F.greatest(rest_l, F.lit(1))) > Z * spread)
        own = apart | (F.col("kids") == 1) | (F.col("child") == "$")
        kids = stage(kids.select("host", "node", "child", F.when(own, F.col("child")).otherwise("*").alias("label"), "over"), f"tree-{d}")
        kids = small(kids, MAX_BROADCAST_ROWS)
        step = F.when(F.col("label") == "$", F.col("node")).otherwise(F.concat("node", F.lit("/"), "label"))
        # of a path alone at its node every deeper segment would keep its own branch
        left = F.filter(F.slice("typed", d, F.greatest(F.size("typed") - (d - 1), F.lit(0))), lambda s: s != "$")
        alone = F.concat("node", F.array_join(F.transform(left, lambda s: F.concat(F.lit("/"), s)), ""))
        tree = tree.join(kids, ["host", "node", "child"]).select("host", "typed", "labelled", "bad", F.when(F.col("over"), alone).otherwise(step).alias("node"), "over")
        tree = stage(tree, f"paths-{d}")
        done.append(tree.where("over").drop("over"))
        tree = tree.where("NOT over").drop("over")
        if tree.isEmpty():
            break
    tree = reduce(DataFrame.unionByName, done)
    leaf = tree.withColumnRenamed("node", "template")
    sums = leaf.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    hosts = sums.groupBy("host").agg(F.sum("l").alias("hl"), F.sum("b").alias("hb"))
    every = hosts.agg(F.sum("hl").alias("al"), F.sum("hb").alias("ab"))
    overall = F.col("ab") / F.greatest(F.col("al"), F.lit(1))
    of_host = (F.col("hb") + PRIOR * overall) / (F.col("hl") + PRIOR)
    share = (F.col("b") + PRIOR * of_host) / (F.col("l") + PRIOR)
    scored = sums.join(hosts, "host").crossJoin(F.broadcast(every)).select("host", "template", F.coalesce(share, F.lit(0.0)).alias("bad_share"))  # every: one row
    return leaf.join(scored, ["host", "template"]).select("host", "typed", "template", "bad_share")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, bad_share.  labels: page_id, bad (0 or 1)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("typed", typed_path(F.col("path")))
    marks = labels.where("page_id IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    counted = rows.join(marks, "page_id", "left").groupBy("host", "typed").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    found = small(stage(templates(stage(counted, "paths")), "templates"), MAX_BROADCAST_ROWS)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_template = F.when(F.col("bad_share") >= REJECT, "block").otherwise("allow")
    return rows.join(found, ["host", "typed"], "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_template).alias("verdict"), "template", F.round("bad_share", 9).alias("bad_share"))


def op5_urls(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), labels.where("bad IS NOT NULL"))


def _oracle() -> str:
    rest = "CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    upper = f"translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}')"
    fit = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{i}}}'" for i, (_, h, p) in enumerate(sorted(RULES, key=lambda r: -len(r[1] + r[2]))))
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    for i, (_, h, p) in enumerate(ordered):
        fit = fit.replace(f"'{{{i}}}'", f"'{h}{p}'")
    says = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in ordered)
    ctes = [f"a AS (SELECT page_id, {rest} AS rest FROM pages)"]
    ctes.append(f"b AS (SELECT page_id, {upper} AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM a)")
    ctes.append("c AS (SELECT *, list_filter(string_split(regexp_replace(regexp_replace(path, '[0-9a-fA-F]{16,}', '{id}', 'g'), '[0-9]+', '{n}', 'g'), '/'), lambda s: s <> '') AS parts FROM b)")
    ctes.append(f"d AS (SELECT page_id, host, path, CASE WHEN len(parts) > {DEPTH} THEN list_concat(parts[1:{DEPTH}], ['**']) ELSE parts END AS typed FROM c)")
    ctes.append("m AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1 OR (quality IS NOT NULL AND toxic IS NOT NULL)) GROUP BY 1)")
    ctes.append("t0 AS (SELECT host, typed, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad, '' AS node FROM d LEFT JOIN m USING (page_id) GROUP BY 1, 2)")
    for i in range(1, DEPTH + 2):
        ctes.append(f"x{i} AS (SELECT *, coalesce(typed[{i}], '$') AS child FROM t{i - 1})")
        ctes.append(f"k{i} AS (SELECT host, node, child, sum(labelled) AS l, sum(bad) AS b FROM x{i} GROUP BY 1, 2, 3)")
        ctes.append(f"w{i} AS (SELECT *, sum(l) OVER p AS tl, sum(b) OVER p AS tb, count(*) OVER p AS kids FROM k{i} WINDOW p AS (PARTITION BY host, node))")
        share = "(tb / greatest(tl, 1)::DOUBLE)"
        apart = f"(l > 0 AND tl - l > 0 AND abs(b / greatest(l, 1)::DOUBLE - (tb - b) / greatest(tl - l, 1)::DOUBLE) > {Z} * sqrt({share} * (1 - {share}) * (1 / greatest(l, 1)::DOUBLE + 1 / greatest(tl - l, 1)::DOUBLE)))"
        ctes.append(f"v{i} AS (SELECT host, node, child, CASE WHEN {apart} OR kids = 1 OR child = '$' THEN child ELSE '*' END AS lab FROM w{i})")
        ctes.append(f"t{i} AS (SELECT x.host, x.typed, x.labelled, x.bad, CASE WHEN lab = '$' THEN x.node ELSE x.node || '/' || lab END AS node FROM x{i} x JOIN v{i} v ON x.host = v.host AND x.node = v.node AND x.child = v.child)")
    last = f"t{DEPTH + 1}"
    ctes.append(f"s AS (SELECT host, node, sum(labelled) AS l, sum(bad) AS b FROM {last} GROUP BY 1, 2)")
    ctes.append("h AS (SELECT host, sum(l) AS hl, sum(b) AS hb FROM s GROUP BY 1)")
    ctes.append("e AS (SELECT sum(hl) AS al, sum(hb) AS ab FROM h)")
    ctes.append(f"z AS (SELECT host, node, coalesce((b + {PRIOR} * ((hb + {PRIOR} * (ab / greatest(al, 1)::DOUBLE)) / (hl + {PRIOR}))) / (l + {PRIOR}), 0) AS bad_share FROM s JOIN h USING (host), e)")
    ctes.append(f"y AS (SELECT host AS yh, typed AS yt, node AS template, bad_share FROM {last} JOIN z USING (host, node))")
    ctes.append(f"r AS (SELECT d.page_id, d.host, d.path, template, bad_share, CASE {fit} END AS rule FROM d JOIN y ON d.host = yh AND d.typed = yt)")
    return f"WITH {', '.join(ctes)} SELECT page_id, host, path, rule, coalesce(CASE rule {says} END, CASE WHEN bad_share >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, template, round(bad_share, 9) AS bad_share FROM r"


QUERIES = {"op5_urls": op5_urls}
SQL = {"op5_urls": _oracle()}
