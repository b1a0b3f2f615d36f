"""URL filtering: allow and block rules, then a path-template tree learnt from labels; in DataFrame operations only.

Per host, a path's segments form a tree. Segments that vary by their shape (numbers, hex, long codes) are wildcards of
that shape at once. At every level a node's children whose labelled rates of good pages don't differ significantly from
that of the other children together are merged into one wildcard, also those without labels; one that differs stays apart,
and so do the branches above it, however many siblings they have. What lies below the first `depth` levels of a path is one
leaf with all its segments, judged like any other. A template is rejected where its purity, the share of good among its labelled pages, smoothed towards that of
its host and this towards that of all pages, is below `min_purity`.

Statistics are combined before they are exchanged, and after the shapes a tree has few nodes; only the join
that brings the verdict back to pages has rows of a hot host, and Spark splits it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end; else both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent domain and the start of the path; else nulls.

    rules: (verdict, "host/path/"), a list short enough to be part of the plan.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for judged, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        on, _, rest = rule.partition("/")
        fits = ((host == on) | host.endswith("." + on)) & path.startswith("/" + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(judged)).otherwise(verdict)
    return name, verdict


def shape(path: Column) -> Column:
    """The path's segments with variable ones as wildcards of their shape."""
    # Linear patterns: a segment is a run without slashes, so no pattern backtracks over more than its own segment.
    out = F.regexp_replace(path, "(?<=/)[0-9]++(?=/|$|\\.)", "{num}")
    out = F.regexp_replace(out, "(?<=/)(?=[^/0-9]{0,40}[0-9])[0-9a-fA-F-]{8,}+(?=/|$|\\.)", "{hex}")
    parts = F.transform(F.split(out, "/"), lambda s: F.when(s.contains("{"), s).when(F.char_length(s) > 40, F.lit("{long}")).when(s.rlike("[0-9]"), F.lit("{code}")).otherwise(s))
    return F.array_join(parts, "/")


def with_family(children: DataFrame, z: float) -> DataFrame:
    """children(host, above, good, bad, ...) with `differs`: the z of a child's rate against that of its siblings together is over `z`."""
    family = children.groupBy(F.col("host").alias("f_host"), F.col("above").alias("f_above")).agg(F.count(F.lit(1)).alias("children"), F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))
    n, m = F.col("good") + F.col("bad"), F.col("all_good") + F.col("all_bad")
    rest = F.nullif(m - n, F.lit(0))
    p = F.col("all_good") / F.nullif(m, F.lit(0))
    apart = F.abs(F.col("good") / F.nullif(n, F.lit(0)) - (F.col("all_good") - F.col("good")) / rest)
    differs = apart > z * F.sqrt(p * (1 - p) * (1 / F.nullif(n, F.lit(0)) + 1 / rest))
    joined = children.join(family, (F.col("host") == F.col("f_host")) & (F.col("above") == F.col("f_above")))
    return joined.withColumn("differs", F.coalesce(differs, F.lit(False))).drop("f_host", "f_above", "all_good", "all_bad")


def branches_apart(counts: DataFrame, z: float, depth: int) -> DataFrame:
    """counts(host, shape, good, bad) -> host, above, last: the inner nodes that differ from their siblings, or have such a node or leaf below."""
    parts = F.split("shape", "/", depth + 1)
    levels = F.when(F.size(parts) > 1, F.sequence(F.lit(2), F.size(parts)))
    nodes = counts.select("host", "good", "bad", parts.alias("parts"), F.explode(levels).alias("level"))
    nodes = nodes.select("host", "good", "bad", "level", (F.col("level") < F.size("parts")).alias("inner"), F.slice("parts", F.lit(1), F.col("level")).alias("way"))
    nodes = nodes.groupBy("host", "inner", "way").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    # Leaves have their own families: the mark before the path keeps them from inner siblings.
    nodes = nodes.withColumn("above", F.concat(F.when(F.col("inner"), F.lit("i")).otherwise(F.lit("l")), F.array_join(F.slice("way", F.lit(1), F.size("way") - 1), "/")))
    inner = F.size("way") - F.when(F.col("inner"), F.lit(0)).otherwise(F.lit(1))
    found = with_family(nodes, z).filter("differs").withColumn("deep", inner).filter("deep > 1").select("host", "way", F.explode(F.sequence(F.lit(2), F.col("deep"))).alias("level"))
    return found.select("host", F.array_join(F.slice("way", F.lit(1), F.col("level") - 1), "/").alias("above"), F.element_at("way", F.col("level")).alias("last")).distinct()


def learn_templates(ws: Workspace, counts: DataFrame, depth: int, z: float, prior_weight: float) -> DataFrame:
    """counts(host, shape, pages, good, bad), one row a shape -> host, shape, template, purity."""
    rate = counts.agg((F.sum("good") + 1) / (F.sum("good") + F.sum("bad") + 2)).first()[0]
    rate = 0.5 if rate is None else rate
    split = F.split("shape", "/", depth + 1)
    nodes = counts.withColumn("parent", F.array_join(F.slice(split, F.lit(1), F.greatest(F.size(split) - 1, F.lit(0))), "/")).withColumn("leaf", F.element_at(split, -1))
    # Inner nodes, from the root: children that don't differ become one wildcard. A tree has one row a shape here.
    levels = nodes.agg(F.max(F.size(split))).first()[0] or 0
    nodes = nodes.withColumn("way", F.slice(split, F.lit(1), F.greatest(F.size(split) - 1, F.lit(0))))
    apart = ws.save(branches_apart(counts, z, depth), "apart") if levels > 2 else None
    for level in range(2, levels):
        above, at = F.array_join(F.slice("way", 1, level - 1), "/"), F.try_element_at("way", F.lit(level))
        children = nodes.filter(at.isNotNull()).groupBy("host", above.alias("above"), at.alias("name")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        judged = with_family(ws.save(children, f"children-{level}"), z)
        similar = judged.filter(~F.col("differs") & (F.col("children") > 1))
        similar = similar.join(apart.withColumnRenamed("last", "name"), ["host", "above", "name"], "left_anti")
        similar = ws.save(similar.select(F.col("host").alias("w_host"), F.col("above").alias("w_above"), F.col("name").alias("w_name")), f"similar-{level}")
        if similar.isEmpty():
            continue
        nodes = ws.save(
            nodes.join(similar, (F.col("host") == F.col("w_host")) & (above == F.col("w_above")) & (at == F.col("w_name")), "left")
            .withColumn("way", F.when(F.col("w_host").isNotNull(), F.concat(F.slice("way", F.lit(1), F.lit(level - 1)), F.array(F.lit("*")), F.slice("way", F.lit(level + 1), F.greatest(F.size("way") - level, F.lit(0))))).otherwise(F.col("way")))
            .drop("w_host", "w_above", "w_name"),
            f"nodes-{level}",
        )
    nodes = nodes.withColumn("parent", F.array_join("way", "/"))
    # Leaves: sums first, then each leaf against its siblings by the z of their rates.
    leaves = nodes.groupBy("host", "parent", "leaf").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    hosts = counts.groupBy(F.col("host").alias("h_host")).agg(((F.sum("good") + prior_weight * rate) / (F.sum("good") + F.sum("bad") + prior_weight)).alias("host_rate"))
    leaves, hosts = ws.save(leaves, "leaves"), ws.save(hosts, "hosts")
    judged = with_family(leaves.withColumnRenamed("parent", "above"), z).withColumnRenamed("above", "parent")
    named = judged.withColumn("merged", F.when(F.col("differs"), F.col("leaf")).otherwise(F.lit("*")))
    named = ws.save(named.select("host", "parent", "leaf", "merged", "good", "bad"), "merged")
    templates = named.groupBy("host", "parent", "merged").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).join(hosts, F.col("host") == F.col("h_host"))
    purity = (F.col("good") + prior_weight * F.col("host_rate")) / (F.col("good") + F.col("bad") + prior_weight)
    templates = ws.save(templates.select("host", "parent", "merged", purity.alias("purity")), "templates")
    leaf_purity = ws.save(named.select("host", "parent", "leaf", "merged").join(templates, ["host", "parent", "merged"]), "leaf-purity")
    return nodes.select("host", "shape", "parent", "leaf").join(leaf_purity, ["host", "parent", "leaf"]).select("host", "shape", F.concat_ws("/", F.nullif("parent", F.lit("")), "merged").alias("template"), "purity")


def filter_urls(
    pages: DataFrame, good: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", depth: int = 8, z: float = 2.58, prior_weight: float = 10.0, min_purity: float = 0.5
) -> DataFrame:
    """id_col, host, path, rule, verdict, template, purity; one row per row.

    good(url_id, is_good boolean): labels by the value of id_col; any number a page, nulls count as no label. A url that is
    null or has no :// has an empty host and path, which make a template of their own. Repeated pages are judged, and
    counted, one by one. A page without a rule is allowed if its template's purity is at least min_purity. Other columns are
    ignored. An empty table gives no rows.
    """
    ws = Workspace(pages.sparkSession, "urls")
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).select("id", host.alias("host"), path.alias("path")).withColumn("shape", shape(F.col("path")))
    labels = good.filter("url_id is not null and is_good is not null").groupBy("url_id").agg(F.count_if("is_good").alias("g"), F.count_if(~F.col("is_good")).alias("b"))
    parsed = ws.save(parsed, "pages")
    labels = ws.save(labels, "labels")
    marked = parsed.join(labels, parsed["id"] == labels["url_id"], "left")
    counts = marked.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("g"), F.lit(0)).alias("good"), F.coalesce(F.sum("b"), F.lit(0)).alias("bad"))
    learnt = ws.save(learn_templates(ws, ws.save(counts, "shapes"), depth, z, prior_weight), "verdicts")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = parsed.join(learnt, ["host", "shape"])
    own = F.when(F.col("purity") >= min_purity, "allow").otherwise("block")
    return judged.select(F.col("id").alias(id_col), "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", "purity")


#: Of the contract of op7 (fixed values).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url_id, is_good of the pages whose document (the number at the end of their path) is in labels(doc_id, quality, toxic)."""
    _, path = host_and_path(F.col("url"))
    number = F.try_to_number(F.nullif(F.regexp_extract(path, "/([0-9]{1,18})(?:\\.html)?/?$", 1), F.lit("")), F.lit("9" * 18)).cast("long")
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return pages.select(F.col("page_id").alias("url_id"), number.alias("doc_id")).join(labels, "doc_id").select("url_id", good.alias("is_good"))


def op7_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url; a page is labelled by its document's quality and toxicity."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, page_labels(pages, spark.read.parquet(f"{sf_dir}/labels.parquet")), RULES)
