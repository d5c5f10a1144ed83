"""URL filter by a path-template tree, in built-in functions only.

Explicit rules decide first, and they are the labels: an allowed page is good,
a blocked one bad (callers may label other pages). For all urls each host has
a tree of path templates. A segment becomes a wildcard where the data show that
it varies: many values below one template with few pages each, on the host or,
where the host has too few pages to tell, over all hosts; values with a
noticeable share of the pages stay. Sibling branches whose labelled purity
doesn't differ significantly from their common one are merged. A template's
purity is smoothed step by step: the prior, its host's, its parent's, the same
template's over all hosts (one voice for each host, so a large one outweighs
none), its own with those it is merged with. A template whose smoothed purity is
under the threshold is rejected, with every page that it holds.

Pages are only aggregated, which combines within tasks, and joined by keys of
which the frequent ones are broadcast (see ``spread_join``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, is_small, materialize, spread_join

# The rules.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]

MANY_VALUES, FEW_PAGES = 20, 3  # a segment varies with over so many values and under so many pages for each
LITERAL_PAGES, LITERAL_SHARE = 3, 20  # a value of it stays with so many pages and 1 / so many of all
PRIOR_PURITY, PRIOR_WEIGHT, THRESHOLD, DEVIATIONS = 0.6, 4.0, 0.5, 1.96


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def templates(found: DataFrame) -> DataFrame:
    """``found`` (host, segs, n, good, bad) with the template of each path, to its full depth.

    From the root down, a table for each level. A path ends where its segments
    do, or where nothing else anywhere shares its template so far: then no
    level below has anything to tell about it, and one long path costs no more
    levels than others share with it.
    """
    left, ended, used, d = materialize(found.withColumn("up", F.lit("")).withColumn("alone", F.lit(False)), "templates"), [], [], 0
    while True:
        over = F.col("alone") | (F.size("segs") == d)
        ended.append(left.where(over).select("host", "segs", "n", "good", "bad", F.col("up").alias("template")))
        used.append(left)
        level = left.where(~over).withColumn("seg", F.try_element_at("segs", F.lit(d + 1))).drop("alone")
        values = materialize(level.groupBy("host", "up", "seg").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")), "values")
        if values.isEmpty():
            discard(values)
            break
        d += 1
        small = is_small(values)  # then all that follows from it is, and needs no tables
        kept = []

        def keep(df: DataFrame, name: str, small: bool = small, kept: list = kept) -> DataFrame:
            if small:
                return df
            kept.append(materialize(df, name))
            return kept[-1]

        own = keep(values.groupBy("host", "up").agg(F.count(F.lit(1)).alias("n_values"), F.sum("n").alias("n_own"), F.sum("rows").alias("n_rows")), "own")
        world = values.groupBy("up", "seg").agg(F.sum("n").alias("n")).groupBy("up").agg(F.count(F.lit(1)).alias("all_values"), F.sum("n").alias("all_n"))
        world = keep(world.join(own.groupBy("up").agg(F.count(F.lit(1)).alias("hosts"), F.sum("n_rows").alias("all_rows")), "up"), "world")
        varies = lambda n, values: (values > MANY_VALUES) & (n < FEW_PAGES * values)
        by_host, by_all = varies(F.col("n_own"), F.col("n_values")), varies(F.col("all_n"), F.col("all_values"))
        known = spread_join(own, world, ["up"], "hosts", small or None)
        known = keep(known.select("host", "up", "n_own", "n_values", (by_host | ((F.col("n_values") <= MANY_VALUES) & by_all)).alias("varies"), (F.col("all_rows") == 1).alias("alone")), "known")
        literal = (F.col("n") >= LITERAL_PAGES) & (F.col("n") * LITERAL_SHARE >= F.col("n_own"))
        steps = spread_join(values, known, ["host", "up"], "n_values", small or None)
        steps = keep(steps.select("host", "up", "seg", "rows", "alone", F.when(F.col("varies") & ~literal, "*").otherwise(F.col("seg")).alias("step")), "steps")
        both = spread_join(level, steps, ["host", "up", "seg"], "rows", small or None)
        rest = F.concat("up", F.lit("/"), F.array_join(F.slice("segs", d, F.size("segs")), "/"))
        left = materialize(both.select("host", "segs", "n", "good", "bad", F.when(F.col("alone"), rest).otherwise(F.concat("up", F.lit("/"), "step")).alias("up"), "alone"), "templates")
        discard(values, *kept)
    out = materialize(reduce(DataFrame.unionByName, ended), "tree")
    discard(*used)
    return out


def purities(tree: DataFrame) -> DataFrame:
    """(host, template, paths, purity, level): the smoothed purity of each template, and the nearest level with labels."""
    nodes = tree.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum(F.col("good") + F.col("bad")).alias("m"), F.count(F.lit(1)).alias("paths"))
    nodes = materialize(nodes.withColumn("parent", F.regexp_extract("template", r"(?s)^(.*)/[^/]*$", 1)), "nodes")

    small, kept = is_small(nodes), [nodes]  # if small, all that follows from it is, and needs no tables

    def keep(df: DataFrame, name: str) -> DataFrame:
        if small:
            return df
        kept.append(materialize(df, name))
        return kept[-1]

    def pool(name: str, *keys: str) -> DataFrame:
        return keep(nodes.groupBy(*keys).agg(F.sum("good").alias(f"g_{name}"), F.sum("m").alias(f"m_{name}"), F.count(F.lit(1)).alias(f"n_{name}")), "pool")

    # What all hosts say about a template: a voice for each that has labels for it.
    voice = F.when(F.col("m") > 0, F.expr("good * 1000 DIV greatest(m, 1)"))
    votes = keep(nodes.groupBy("template").agg(F.coalesce(F.sum(voice), F.lit(0)).alias("g_all"), F.count(voice).alias("m_all"), F.count(F.lit(1)).alias("n_all")), "votes")
    known = spread_join(nodes, pool("parent", "host", "parent"), ["host", "parent"], "n_parent", small or None)
    share = F.try_divide("g_parent", "m_parent")
    apart = F.abs(F.try_divide("good", "m") - share) - F.try_divide(F.lit(0.5), "m")
    known = keep(known.withColumn("similar", F.coalesce(apart <= DEVIATIONS * F.sqrt(F.try_divide(share * (1 - share), "m")), F.lit(False))), "known")
    merged = known.groupBy("host", "parent").agg(F.count(F.lit(1)).alias("n_merged"), *(F.sum(F.when(F.col("similar"), F.col(c)).otherwise(0)).alias(f"{c}_merged") for c in ("good", "m")))
    known = spread_join(known, keep(merged, "merged"), ["host", "parent"], "n_merged", small or None)
    known = spread_join(spread_join(known, pool("host", "host"), ["host"], "n_host", small or None), votes, ["template"], "n_all", small or None)
    g, m = (F.when(F.col("similar"), F.col(f"{c}_merged")).otherwise(F.col(c)) for c in ("good", "m"))
    purity = F.lit(PRIOR_PURITY)
    for good, all_ in ((F.col("g_host"), F.col("m_host")), (F.col("g_parent"), F.col("m_parent")), (F.col("g_all") / 1000, F.col("m_all")), (g, m)):
        purity = (good + purity * PRIOR_WEIGHT) / (all_ + PRIOR_WEIGHT)
    level = F.when(F.col("m") > 0, "template").when(F.col("m_all") > 0, "hosts").when(F.col("m_parent") > 0, "parent").when(F.col("m_host") > 0, "host").otherwise("prior")
    out = materialize(known.select("host", "template", "paths", purity.alias("purity"), level.alias("level")), "purities")
    discard(*kept)
    return out


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", good: Column | None = None) -> DataFrame:
    """A verdict for each row of ``pages``.

    A rule's pages are labelled by it; ``good`` (boolean) labels others, null
    ones stay unlabelled. A null url, or one without ``://``, has an empty host
    and path and is judged as the root of the empty host; equal urls have equal
    verdicts; rows that repeat are judged each; an empty table gives no rows;
    other columns are not read; a path's length and depth are not limited. A
    segment that is ``*`` itself counts as a wildcard.

    Returns ``id_col``, host, path, rule (null if none fits), verdict,
    template, purity double, level (the nearest that has labels: template,
    hosts, parent, host, or prior if none has) and by (what decides: rule,
    tree, or prior).
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), (good if good is not None else F.lit(None).cast("boolean")).alias("good"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    label = F.coalesce(verdict == "allow", F.col("good"))
    rows = rows.select("id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), segments(F.col("path")).alias("segs"), label.alias("label"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    found = rows.groupBy("host", "segs").agg(F.count(F.lit(1)).alias("n"), count(F.col("label")).alias("good"), count(~F.col("label")).alias("bad"))
    tree = templates(found)
    nodes = purities(tree)
    judged = materialize(spread_join(tree.select("host", "segs", "template", F.col("n").alias("pages")), nodes, ["host", "template"], "paths"), "judged")
    discard(tree, nodes)
    out = spread_join(rows, judged.select("host", "segs", "template", "pages", "purity", "level"), ["host", "segs"], "pages")
    method = F.when(F.col("purity") < THRESHOLD, "block").otherwise("allow")
    by = F.when(F.col("rule").isNotNull(), "rule").when(F.col("level") == "prior", "prior").otherwise("tree")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), "template", "purity", "level", by.alias("by"))
