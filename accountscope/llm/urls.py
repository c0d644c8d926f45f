"""URL filters: a path-template tree per host, pruned by the purity of its labelled urls.

Path segments become template segments: digits and long hexadecimal runs are variable as such; where a node has many
children, those with a small share of it are too. Siblings whose shares of bad urls don't differ significantly are
merged. The same tree is built for every registered domain and for all hosts together. A template's purity is its share
of bad labelled urls, smoothed towards that of the same template one level up, on its domain or on all hosts, and of its
parent on the same host where that has labels. So labels speak for hosts without any through the templates they share.
Templates above the threshold are rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accountscope.session import broadcast_if_small, materialise

# Fixed values: (verdict, host, path) of the rules; a rule holds for its host and all subdomains.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class TreeConfig:
    """depth: levels of the tree, deeper segments share one node; branches: children beyond which a small child (less
    than min_share of its parent) is variable; z: siblings closer than this many standard errors merge; prior: labelled
    urls that a parent's share counts for; reject: smoothed share of bad urls from which a template is blocked."""

    depth: int = 4
    branches: int = 20
    min_share: float = 0.02
    z: float = 1.96
    prior: float = 5.0
    reject: float = 0.8


#: Longer than any host.
MAX_HOST = 1 << 30


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, else NULL."""
    out = None
    for verdict, of, under in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(under)
        value = F.struct(F.lit(of + under).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def segments(path: Column, depth: int) -> Column:
    """Template segments before any statistics: variable runs are ``*``; all beyond ``depth`` are one ``**``."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    shaped = F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, r"[0-9a-fA-F]{16,}|[0-9]+", "*"), r"\*(?:[-_.,:]?\*)+", "*"))
    return F.when(F.size(shaped) > depth, F.concat(F.slice(shaped, 1, depth), F.array(F.lit("**")))).otherwise(shaped)


def templates(patterns: DataFrame, cfg: TreeConfig) -> DataFrame:
    """``host, segs, nodes, n, bad, good``: the nodes of every pattern's way down the tree, root excluded.

    patterns: ``host, segs, n, bad, good``, a row per host and pattern.
    """
    rows = patterns.withColumns({"at": F.lit(""), "nodes": F.array().cast("array<string>")})
    for level in range(cfg.depth + 1):
        seg = F.get("segs", F.lit(level))
        rows = rows.withColumn("seg", seg)
        kids = rows.where(F.col("seg").isNotNull()).groupBy("host", "at", "seg").agg(F.sum("n").alias("kid"))
        parents = kids.groupBy("host", "at").agg(F.count("*").alias("kids"), F.sum("kid").alias("all"))
        small = (F.col("kids") > cfg.branches) & (F.col("kid") < cfg.min_share * F.col("all")) & (F.col("seg") != "**")
        named = kids.join(parents, ["host", "at"]).select("host", "at", "seg", F.when(small, "*").otherwise(F.col("seg")).alias("name"))
        rows = rows.join(named, ["host", "at", "seg"], "left").withColumn(
            "at", F.when(F.col("seg").isNull(), F.col("at")).otherwise(F.concat("at", F.lit("/"), "name")))
        rows = rows.withColumn("nodes", F.when(F.col("seg").isNull(), F.col("nodes")).otherwise(F.array_append("nodes", F.col("at"))))
        rows = materialise(rows.drop("name"), "url-tree")
    return rows.select("host", "segs", "nodes", "n", "bad", "good")


def domain_of(host: Column) -> Column:
    """The last two labels of a host, without its port; numeric addresses and shorter hosts are their own."""
    name = F.regexp_replace(host, r":[0-9]*$", "")
    return F.when(name.rlike(r"^[0-9.]+$|^\["), name).otherwise(F.regexp_extract(name, r"([^.]*\.)?[^.]*$", 0))


def scoped(patterns: DataFrame) -> DataFrame:
    """The patterns of all hosts (``0:``), of every domain (``1:<domain>``) and of every host (``2:<host>``), with the
    name of the scope one level ``up``."""
    domain = F.concat(F.lit("1:"), domain_of(F.col("host")))
    names = F.array(F.struct(F.lit("0:").alias("host"), F.lit(None).cast("string").alias("up")),
                    F.struct(domain.alias("host"), F.lit("0:").alias("up")),
                    F.struct(F.concat(F.lit("2:"), F.col("host")).alias("host"), domain.alias("up")))
    each = patterns.select(F.explode(names).alias("s"), "segs", "n", "bad", "good")
    return each.groupBy("s.host", "s.up", "segs").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "good")])


def _same() -> Column:
    """The group of siblings of a row is that of ``sh, sp, sg``."""
    return F.col("host").eqNullSafe(F.col("sh")) & F.col("parent").eqNullSafe(F.col("sp")) & F.col("group").eqNullSafe(F.col("sg"))


def purities(tree: DataFrame, ups: DataFrame, cfg: TreeConfig) -> DataFrame:
    """``host, node, purity`` for every node of every scope: siblings merged, shares smoothed from the outermost root.

    ``ups`` has ``host, up``, a row per scope.
    """
    at = tree.select("host", F.posexplode("nodes").alias("level", "node"), "bad", "good", "nodes")
    parent = F.when(F.col("level") == 0, "").otherwise(F.get("nodes", F.col("level") - 1))
    nodes = at.withColumn("parent", parent).groupBy("host", "level", "parent", "node").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    labelled = F.col("bad") + F.col("good")

    # Siblings in order of their share; a new group starts where the step to the next labelled one is significant.
    order = Window.partitionBy("host", "parent").orderBy(F.col("bad") / labelled, "node")
    rate = F.col("bad") / labelled
    before_bad, before_n = F.lag("bad").over(order), F.lag(labelled).over(order)
    pooled = (F.col("bad") + before_bad + 1) / (labelled + before_n + 2)
    error = F.sqrt(pooled * (1 - pooled) * (1 / labelled + 1 / before_n))
    step = F.coalesce((rate - before_bad / before_n) > cfg.z * error, F.lit(False))
    known = nodes.where(labelled > 0).withColumn("step", step).withColumn("group", F.sum(F.col("step").cast("int")).over(order).cast("string"))
    # Siblings without labels stay apart: each has the templates of its own one level up.
    grouped = known.drop("step").unionByName(nodes.where(labelled == 0).withColumn("group", F.concat(F.lit("/"), F.col("node"))))
    roots = tree.groupBy("host").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).select(
        "host", F.lit(-1).alias("level"), F.lit(None).cast("string").alias("parent"), F.lit("").alias("node"), "bad", "good", F.lit("0").alias("group"))
    grouped = materialise(grouped.unionByName(roots), "url-nodes")
    merged = grouped.groupBy("host", "level", "parent", "group").agg(F.sum("bad").alias("b"), F.sum("good").alias("g"))

    # What every node is called one level up, weighed by the urls that both hold.
    inner, outer = tree.join(ups, "host"), tree.select(F.col("host").alias("up"), "segs", F.col("nodes").alias("up_nodes"))
    both = inner.join(outer, ["up", "segs"]).select("host", "up", "n", F.explode(F.arrays_zip(
        F.concat(F.array(F.lit("")), "nodes").alias("node"), F.concat(F.array(F.lit("")), "up_nodes").alias("up_node"))).alias("z"))
    links = materialise(both.groupBy("host", "up", "z.node", "z.up_node").agg(F.sum("n").alias("n")), "url-links")

    total = grouped.where("level = -1 AND host = '0:'").agg(F.sum("bad"), F.sum("good")).first()
    base = ((total[0] or 0) + 1) / ((total[0] or 0) + (total[1] or 0) + 2)
    # A share waits for its parent's and for that of the same level one scope up. So nodes whose scope and level add up
    # to the same number are one wave, and a wave needs no more than the one before it.
    wave = F.substring("host", 1, 1).cast("int") + F.col("level") + 1
    above, found = None, None
    for nth in range(cfg.depth + 4):
        own, here = (t.where(wave == nth) for t in (grouped, merged))
        if above is None:
            here = here.withColumns({"wide": F.lit(None).cast("double"), "over": F.lit(float(base)), "labelled": F.lit(0).cast("bigint")})
        else:
            outside = above.select(F.col("host").alias("up"), F.col("node").alias("up_node"), F.col("purity").alias("over"))
            share = links.join(outside, ["up", "up_node"]).groupBy("host", "node").agg(
                F.sum("n").alias("m"), F.sum(F.col("n") * F.col("over")).alias("mo"))
            s = own.join(share, ["host", "node"]).groupBy(
                F.col("host").alias("sh"), F.col("parent").alias("sp"), F.col("group").alias("sg")).agg((F.sum("mo") / F.sum("m")).alias("wide"))
            here = here.join(s, _same(), "left").drop("sh", "sp", "sg")
            parents = above.select("host", F.col("node").alias("parent"), F.col("purity").alias("over"), "labelled")
            here = here.join(parents, ["host", "parent"], "left").withColumns({  # a root has none
                "over": F.coalesce("over", F.lit(float(base))), "labelled": F.coalesce("labelled", F.lit(0))})
        towards = F.when(F.col("wide").isNull(), F.col("over")).when(F.col("labelled") > 0, (F.col("wide") + F.col("over")) / 2).otherwise(F.col("wide"))
        purity = (F.col("b") + cfg.prior * towards) / (F.col("b") + F.col("g") + cfg.prior)
        here = here.select(F.col("host").alias("sh"), F.col("parent").alias("sp"), F.col("group").alias("sg"), purity.alias("purity"))
        out = own.join(here, _same()).select("host", "node", "purity", (F.col("bad") + F.col("good")).alias("labelled"))
        above = materialise(out, "url-purity")
        found = above if found is None else found.unionByName(above)
    return found.select("host", "node", "purity")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, labels: DataFrame | None = None,
          cfg: TreeConfig | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id, host, path, rule, verdict, template, purity`` for every page.

    Urls that a rule decides are the labelled ones; ``labels`` (id, bad) adds others. A url without ``://``, or a NULL
    one, has an empty host and path, like any other host. Repeated rows stay. Other columns are ignored.
    """
    cfg = cfg or TreeConfig()
    rules = RULES if rules is None else rules
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("best", best_rule(F.col("host"), F.col("path"), rules)).withColumn("segs", segments(F.col("path"), cfg.depth))
    if labels is not None:
        one = labels.groupBy(F.col(id_col).alias("label_id")).agg(F.max(F.col("bad").cast("int")).alias("label"))
        rows = rows.join(one, rows["id"] == one["label_id"], "left").drop("label_id")
    else:
        rows = rows.withColumn("label", F.lit(None).cast("int"))
    rows = materialise(rows.select("id", "host", "path", "best.rule", "best.verdict", "segs", "label"), "urls")
    bad = F.coalesce(F.col("label") == 1, F.col("verdict") == "block", F.lit(False)).cast("int")
    good = F.coalesce(F.col("label") == 0, F.col("verdict") == "allow", F.lit(False)).cast("int")
    patterns = rows.groupBy("host", "segs").agg(F.count("*").alias("n"), F.sum(bad).alias("bad"), F.sum(good).alias("good"))
    scopes = materialise(scoped(patterns), "url-patterns")
    tree = templates(scopes.drop("up"), cfg)
    purity = purities(tree, scopes.where("up IS NOT NULL").select("host", "up").distinct(), cfg)
    leaf = tree.where("host LIKE '2:%'").select("host", "segs", F.element_at("nodes", -1).alias("node")).join(purity, ["host", "node"])
    leaf = leaf.withColumn("host", F.substring("host", 3, MAX_HOST))
    leaf = broadcast_if_small(leaf.select(F.col("host").alias("h"), F.col("segs").alias("s"), F.col("node").alias("template"), "purity"))
    judged = rows.join(leaf, (rows["host"] == leaf["h"]) & (rows["segs"] == leaf["s"]), "left")
    method = F.when(F.col("purity") >= cfg.reject, "block").otherwise("allow")
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), "template", "purity")
