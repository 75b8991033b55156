"""URL verdicts by a path-template tree, in DataFrame functions only.

Every url is a host and a path. Rules decide what they fit. The rest is judged by its template: per host a tree of path
segments in which numbers, hashes, dates and rare values are wildcards. The branches of a node are compared with one
another in the order of their labelled purity, and those that don't differ significantly are merged into one wildcard; a
branch that differs from all others stays literal. A template's purity is smoothed by its host's, and the host's by that
of all labels; templates below the threshold are blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm.scratch import Scratch

#: Least rows of a branch that is compared by itself (rarer ones are pooled); weight of the prior in rows; z above which
#: branches differ; purity below which a template is blocked; steps of purity within which branches are alike.
LEAST, PRIOR, Z, PURE, BINS = 20, 10.0, 2.58, 0.5, 64

Rule = tuple[str, str]  # verdict, host and path as one string


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty where there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as its string, or null. A rule fits its host and all subdomains and a prefix of the path."""
    out = None
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
        out = F.when(fits, F.lit(rule)) if out is None else out.when(fits, F.lit(rule))
    return out if out is not None else F.lit(None).cast("string")


def general_segment(seg: Column) -> Column:
    """A segment with its variable kinds as wildcards: numbers, hashes and ids, dates, each with its file ending."""
    ending = F.regexp_extract(seg, r"(\.[A-Za-z]{2,5})$", 1)
    stem = F.regexp_replace(seg, r"\.[A-Za-z]{2,5}$", "")
    kind = F.when(stem.rlike(r"^[0-9]+$"), F.lit("{n}")).when(stem.rlike(r"^[0-9]{2,4}-[0-9]{1,2}(-[0-9]{1,2})?$"), F.lit("{d}"))
    kind = kind.when(stem.rlike(r"^(?=.*[0-9])[0-9A-Fa-f-]{8,}$"), F.lit("{h}")).when(stem.rlike(r"^(?=.*[0-9])[0-9A-Za-z_-]{12,}$"), F.lit("{i}"))
    return F.when(seg == "", F.lit("")).otherwise(F.concat(kind.otherwise(stem), ending))


def judge(pages: DataFrame, labels: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", good: str = "good") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, template and its smoothed purity.

    labels has page_id and a boolean column that says whether a page is good; several labels of one id count by their
    mean. Null urls and urls without `://` have an empty host and path and are judged like others, as one host. Null ids
    match no label; repeated rows are judged alike; without labels the purity is 1 and only rules block. Other columns
    are ignored.

    Pages are counted per (host, generalised path) with partial aggregation before anything is joined, so a host of any
    size is a few rows. A node's branches meet as sums of at most BINS steps of purity, however many they are. The tree
    grows until no node has rows enough for another literal branch. The one join back to the pages is an outer equi-join
    that adaptive execution splits where skewed.
    """
    url = F.col(url_col)
    base = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    segs = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), general_segment)
    keyed = base.withColumn("segs", segs).withColumn("key", F.array_join("segs", "/"))
    marked = labels.groupBy("page_id").agg(F.avg(F.col(good).cast("double")).alias("share")).filter("page_id is not null and share is not null")
    counted = keyed.join(marked, "page_id", "left").groupBy("host", "key").agg(F.first("segs").alias("segs"), F.count(F.lit(1)).alias("n"), F.count("share").alias("m"), F.coalesce(F.sum("share"), F.lit(0.0)).alias("good"))
    # each level is a small table of its own: without the cut every level would repeat the work of those before it twice
    work = Scratch(pages.sparkSession, "templates")
    growing = work.table(counted.withColumn("node", F.lit("")), "counted")
    ended, level = [], 0
    while not growing.isEmpty():
        level += 1
        grown = work.table(grow(growing, level), f"level{level}")
        ended.append(grown.filter("last"))
        growing = grown.filter("not last").drop("last")
    tree = growing.select("host", "key", "m", "good", "node")
    for part in ended:
        tree = tree.unionByName(part.select("host", "key", "m", "good", "node"))
    tree = work.table(tree.withColumnRenamed("node", "template"), "tree")
    leaf = tree.groupBy("host", "template").agg(F.sum("m").alias("m"), F.sum("good").alias("good"))
    hosts = leaf.groupBy("host").agg(F.sum("m").alias("hm"), F.sum("good").alias("hg"))
    total = hosts.agg(F.coalesce(F.sum("hg") / F.sum("hm"), F.lit(1.0)).alias("all_pure"))
    prior = hosts.crossJoin(F.broadcast(total)).select("host", ((F.col("hg") + PRIOR * F.coalesce("all_pure", F.lit(1.0))) / (F.col("hm") + PRIOR)).alias("host_pure"))
    pure = leaf.join(prior, "host").select("host", "template", ((F.col("good") + PRIOR * F.col("host_pure")) / (F.col("m") + PRIOR)).alias("purity"))
    judged = tree.select("host", "key", "template").join(pure, ["host", "template"])
    rule = best_rule(F.col("host"), F.col("path"), rules)
    out = keyed.drop("segs").join(judged, ["host", "key"], "left").withColumn("rule", rule)
    verdicts = F.lit(None).cast("string")
    for verdict, text in rules:
        verdicts = F.when(F.col("rule") == text, F.lit(verdict)).otherwise(verdicts)
    method = F.when(F.col("purity") < PURE, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), verdicts).otherwise(method).alias("verdict"), "template", "purity")


def differs(m1: Column, g1: Column, m2: Column, g2: Column) -> Column:
    """Whether two purities, g of m labels each, differ by a two-proportion z test."""
    pool = (g1 + g2) / (m1 + m2)
    spread = F.sqrt(F.greatest(pool * (1 - pool), F.lit(1e-9)) * (1 / m1 + 1 / m2))
    return F.abs(g1 / m1 - g2 / m2) > Z * spread


def grow(rows: DataFrame, level: int) -> DataFrame:
    """rows (host, key, segs, n, m, good, node) with the node one level deeper, and whether it is the last.

    Branches with LEAST rows and a label are taken in the order of their purity; each joins the cluster of those before it
    unless it differs from it, and the pool of all rarer branches takes its place among them, or is `*` if it has no label.
    A cluster of one branch keeps its name where there are several clusters; others are `*`, numbered from the least pure. Nodes of fewer than LEAST rows
    have no branches to tell apart, so all below them is `**`.
    """
    tree = rows.withColumn("seg", F.try_element_at("segs", F.lit(level)))
    child = tree.filter("seg is not null").groupBy("host", "node", "seg").agg(F.sum("n").alias("cn"), F.sum("m").alias("cm"), F.sum("good").alias("cg"))
    child = child.withColumn("own", (F.col("cn") >= LEAST) & (F.col("cm") > 0))
    rare = child.filter("not own").groupBy("host", "node").agg(F.sum("cn").alias("cn"), F.sum("cm").alias("cm"), F.sum("cg").alias("cg"))
    step = F.least(F.floor(F.col("cg") / F.greatest("cm", F.lit(1)) * BINS), F.lit(BINS - 1)).cast("int")
    parts = child.filter("own").select("host", "node", "seg", "cn", "cm", "cg").unionByName(rare.select("host", "node", F.lit(None).cast("string").alias("seg"), "cn", "cm", "cg"))
    binned = parts.filter("cm > 0").withColumn("bin", step).groupBy("host", "node", "bin").agg(F.sum("cn").alias("n"), F.sum("cm").cast("double").alias("m"), F.sum("cg").alias("g"), F.count(F.lit(1)).alias("branches"), F.min("seg").alias("name"), F.max(F.col("seg").isNull()).alias("pool"))
    ordered = binned.groupBy("host", "node").agg(F.array_sort(F.collect_list(F.struct("bin", "n", "m", "g", "branches", "name", "pool"))).alias("bins"))
    blank = F.struct(F.lit(-1).alias("bin"), F.lit(0).alias("cluster"), F.lit(0.0).alias("m"), F.lit(0.0).alias("g"))

    def place(done: Column, x: Column) -> Column:
        last = F.coalesce(F.try_element_at(done, F.lit(-1)), blank)
        fresh = (last["m"] > 0) & differs(F.greatest(last["m"], F.lit(1.0)), last["g"], x["m"], x["g"])
        m, g = F.when(fresh, x["m"]).otherwise(last["m"] + x["m"]), F.when(fresh, x["g"]).otherwise(last["g"] + x["g"])
        return F.concat(done, F.array(F.struct(x["bin"].alias("bin"), (last["cluster"] + fresh.cast("int")).alias("cluster"), m.alias("m"), g.alias("g"))))

    empty = F.array().cast("array<struct<bin:int,cluster:int,m:double,g:double>>")
    placed = ordered.select("host", "node", "bins", F.aggregate("bins", empty, place).alias("placed"))
    clusters = placed.select("host", "node", F.element_at("placed", -1)["cluster"].alias("highest"), F.explode(F.arrays_zip("bins", "placed")).alias("z")).select("host", "node", "highest", F.col("z.bins.*"), F.col("z.placed.cluster").alias("cluster"))
    named = clusters.groupBy("host", "node", "cluster").agg(F.first("highest").alias("highest"), F.sum("n").alias("rows"), F.sum("branches").alias("branches"), F.min("name").alias("name"), F.max("pool").alias("pool"))
    star = F.when(F.col("highest") == 0, F.lit("*")).otherwise(F.concat(F.lit("*"), F.col("cluster").cast("string")))
    named = named.select("host", "node", "cluster", "rows", F.when((F.col("highest") > 0) & (F.col("branches") == 1) & ~F.col("pool"), F.col("name")).otherwise(star).alias("to"))
    where = clusters.select("host", "node", "bin", "cluster")
    of_pool = rare.select("host", "node", F.col("cn").alias("pool_rows")).join(clusters.filter("pool").select("host", "node", F.col("cluster").alias("pool_cluster")), ["host", "node"], "left")
    chosen = child.withColumn("bin", step).join(where.withColumnRenamed("cluster", "own_cluster"), ["host", "node", "bin"], "left").join(of_pool, ["host", "node"], "left")
    chosen = chosen.withColumn("cluster", F.when(F.col("own"), F.col("own_cluster")).otherwise(F.col("pool_cluster"))).join(named, ["host", "node", "cluster"], "left")
    chosen = chosen.select("host", "node", "seg", F.coalesce("to", F.lit("*")).alias("to"), F.coalesce("rows", "pool_rows").alias("rows"))
    deeper = tree.join(chosen, ["host", "node", "seg"], "left")
    more = F.size("segs") > level
    node = F.when(F.col("to").isNull(), F.col("node")).otherwise(F.concat("node", F.lit("/"), "to"))
    last = F.col("seg").isNull() | ~more | (F.col("rows") < LEAST)
    return deeper.select("host", "key", "segs", "n", "m", "good", F.when(last & F.col("seg").isNotNull() & more, F.concat(node, F.lit("/**"))).otherwise(node).alias("node"), last.alias("last"))
