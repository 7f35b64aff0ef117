"""URL filter by path-template trees, with DataFrame functions only.

Rules label what they fit. For the rest, every host has a tree of path templates:
a segment stays as it is or becomes a wildcard of its kind (digits, digits with an
ending, long or hex codes). At every level, from the root down, a segment with too few labelled
pages of its own, or whose share of blocked ones does not differ from its siblings' beyond chance,
becomes a wildcard: such siblings are one branch of their parent. How many there are plays no part. A
branch's purity is its smoothed share of blocked pages among labelled ones: pseudo-counts draw
it to its parent's, and so on up to the host's, the host's to its site's, the site's to that
of all. A template whose purity is `REJECT` or more is rejected.

The site of a host is its last two labels. Counting starts with
one partial aggregate over (host, path), so a host that holds a third of all pages
is spread by its paths, and what is joined to pages is one row per template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.llm.common import written
from echofold.llm.registry import query, table

#: (host suffix, path prefix, verdict) with the text that names the rule. Fixed values.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Squared distance in standard errors up to which two siblings count as alike (5 % level).
ALIKE = 3.84
#: Pseudo-counts of a parent, and the purity that rejects.
SMOOTH, REJECT = 4.0, 0.5
#: Labelled pages a segment must have to be told from its siblings; with fewer its parent's pseudo-counts outweigh it.
SUPPORT = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? or # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, NULL where none does."""
    name = verdict = F.lit(None).cast("string")
    for suffix, prefix, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == suffix) | F.endswith(host, F.lit("." + suffix))) & F.startswith(path, F.lit(prefix))
        name = F.when(fits, F.lit(suffix + prefix)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def general(segment: Column) -> Column:
    """A segment, or the wildcard of its kind."""
    return (F.when(segment.rlike(r"^[0-9]+$"), F.lit("{n}"))
            .when(segment.rlike(r"^[0-9]+\.[A-Za-z]+$"), F.concat(F.lit("{n}"), F.regexp_extract(segment, r"(\.[A-Za-z]+)$", 1)))
            .when(segment.rlike(r"^(?=.*[0-9])[0-9A-Fa-f-]{16,}$"), F.lit("{hex}"))
            .when(F.length(segment) > 40, F.lit("{long}")).otherwise(segment))


def segments(path: Column) -> Column:
    """All segments, generalised by kind; a path that ends in / has an empty last one."""
    return F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), general)


def _purity(blocked: Column, labelled: Column, prior: Column) -> Column:
    return (blocked + prior * SMOOTH) / (labelled + SMOOTH)


def _level(rows: DataFrame, d: int) -> DataFrame:
    """Rows (host, node, purity, s, b, l) moved from the node they are at to its branch for segment d.

    done says that all rows of the new node go on in the same way, so that nothing below is left to tell apart.
    """
    tail = F.slice("s", d + 2, F.size("s"))
    h = F.xxhash64(tail, F.size(tail))
    seg = F.coalesce(F.get("s", d), F.lit("/"))  # no segment is a slash: the path ends at the node
    child = rows.groupBy("host", "node", seg.alias("seg")).agg(
        F.sum("b").alias("cb"), F.sum("l").alias("cl"), F.min(h).alias("h0"), F.max(h).alias("h1"), F.first("purity").alias("up"))
    nodes = child.groupBy("host", "node").agg(F.sum("cb").alias("nb"), F.sum("cl").alias("nl"), F.count(F.lit(1)).alias("k"))
    rest_l, rest_b = F.col("nl") - F.col("cl"), F.col("nb") - F.col("cb")
    pooled = F.col("nb") / F.col("nl")
    gap = F.col("cb") / F.col("cl") - rest_b / rest_l
    alike = F.when((F.col("cl") < SUPPORT) | (rest_l <= 0) | (F.col("nb") == 0) | (F.col("nb") == F.col("nl")), F.lit(True)).otherwise(
        gap * gap <= ALIKE * pooled * (1 - pooled) * (1 / F.col("cl") + 1 / rest_l))
    name = F.when((F.col("seg") == "/") | (F.col("k") == 1) | ~alike, F.col("seg")).otherwise(F.lit("{*}"))
    named = child.join(nodes, ["host", "node"]).withColumn("name", name)
    # Siblings of one name become one branch; it pools their counts.
    merged = named.groupBy("host", "node", "name").agg(
        F.sum("cb").alias("mb"), F.sum("cl").alias("ml"), F.min("h0").alias("h0"), F.max("h1").alias("h1"), F.first("up").alias("up"))
    names = merged.groupBy("host", "node").agg(F.count(F.lit(1)).alias("names"))
    # The only branch of a node holds the node's own counts, which its purity has already.
    judged = merged.join(names, ["host", "node"]).select(
        "host", "node", "name", F.when(F.col("names") == 1, F.col("up")).otherwise(_purity(F.col("mb"), F.col("ml"), F.col("up"))).alias("_p"),
        (F.col("h0") == F.col("h1")).alias("done"))
    moves = named.select("host", "node", "seg", "name").join(judged, ["host", "node", "name"])
    moved = rows.withColumn("seg", seg).join(moves, ["host", "node", "seg"])
    below = F.when(F.col("name") == "/", F.col("node")).otherwise(F.concat("node", F.lit("/"), "name"))
    return moved.select("host", below.alias("node"), F.col("_p").alias("purity"), "s", "b", "l", "done")


def templates(pages: DataFrame) -> DataFrame:
    """One row per (host, path): its template and the template's purity.

    `pages` has host, path and verdict (NULL where no rule fits). The tree is grown from the root
    down, one round of jobs per level, over the rows whose template is not settled yet: as many
    levels as the deepest place where paths of one branch part.
    """
    leaf = pages.groupBy("host", "path").agg(F.count(F.when(F.col("verdict") == "block", 1)).alias("b"), F.count("verdict").alias("l"))
    leaf = written(leaf.withColumn("s", segments(F.col("path"))).withColumn("site", F.substring_index("host", ".", -2)), "leaves")
    sizes = leaf.groupBy("host", "site", "s").agg(F.sum("b").alias("b"), F.sum("l").alias("l"))
    hosts = sizes.groupBy("host", "site").agg(F.sum("b").alias("hb"), F.sum("l").alias("hl"))
    sites = hosts.groupBy("site").agg(F.sum("hb").alias("sb"), F.sum("hl").alias("sl"))
    total = sites.agg(F.coalesce(F.sum("sb"), F.lit(0)).alias("ab"), F.coalesce(F.sum("sl"), F.lit(0)).alias("al"))
    overall = F.when(F.col("al") > 0, F.col("ab") / F.col("al")).otherwise(F.lit(0.0))
    root = hosts.join(sites, "site").join(F.broadcast(total), F.lit(True)).select(  # one row
        "host", _purity(F.col("hb"), F.col("hl"), _purity(F.col("sb"), F.col("sl"), overall)).alias("purity"))
    rows = sizes.join(root, "host").select("host", F.lit("").alias("node"), "purity", "s", "b", "l")
    found, d = None, 0
    while True:
        level = written(_level(rows, d), f"level-{d}")
        rest = F.slice("s", d + 2, F.size("s"))
        path = F.concat("node", F.when(F.size(rest) > 0, F.concat(F.lit("/"), F.array_join(rest, "/"))).otherwise(F.lit("")))
        settled = level.where("done").select(F.col("host").alias("_h"), F.col("s").alias("_s"), path.alias("template"), "purity")
        found = settled if found is None else found.unionByName(settled)
        rows = level.where("not done").drop("done")
        if not rows.limit(1).count():
            break
        d += 1
    return leaf.join(found, (F.col("host") == F.col("_h")) & (F.col("s") == F.col("_s"))).select("host", "path", "template", "purity")


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per row: (page_id, host, path, rule, verdict, template, purity).

    verdict is the rule's where one fits, else block for a rejected template and allow for
    any other. A NULL url and one without :// have an empty host and path, which is a template
    like any other. Rows are judged one by one; with no labelled page at all nothing is rejected.
    """
    url = F.col("url")
    rows = pages.select(F.col("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("verdict"))
    known = templates(rows.select("host", "path", "verdict")).withColumnRenamed("host", "_h").withColumnRenamed("path", "_p")
    out = rows.join(known, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    says = F.coalesce("verdict", F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", says.alias("verdict"), "template", F.round("purity", 9).alias("purity"))


@query("op4_url_filter")
def op4_url_filter(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"))
