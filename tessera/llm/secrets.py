"""Secret scans with corpus-wide ownership frequency, in built-in functions only.

Patterns give candidate spans in each text. Over the whole corpus the hash of
each candidate's value is counted by distinct owners, repositories and texts:
a value that several owners hold, or one owner in many repositories or texts,
is a copied example (documentation, fixtures); any other looks live. Spans of
the base patterns are always returned; looser candidates (long mixed tokens)
only where the counts say that they look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, regex_spans, spread_join, text_or_empty

# Kind, pattern, group that holds the value, least length of it.
BASE_KINDS = [
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
LOOSE_KIND = ("loose", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}", 0, 20)
#: Owners, repositories and texts (of a repository) at most, for a value that looks live; distinct characters at least, for a loose one.
LIVE_OWNERS, LIVE_REPOS, LIVE_TEXTS, LOOSE_CHARACTERS = 1, 2, 4, 10


def spans_of(text: Column, kinds: list[tuple[str, str, int, int]], rank: int = 0) -> Column:
    """Spans of ``kinds`` by start, then kind as listed."""
    def one(at: int, kind: str, pattern: str, group: int, least: int) -> Column:
        kept = F.filter(regex_spans(text, pattern, group), lambda s: F.length(s["value"]) >= least)
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(rank + at).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.sha2(s["value"].cast("binary"), 256).alias("hash"), s["value"].alias("value")))

    return F.array_sort(F.concat(*(one(at, *k) for at, k in enumerate(kinds))))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    owner_col: str = "source",
    repo_cols: tuple[str, ...] = ("source", "lang"),
    live_owners: int = LIVE_OWNERS,
    live_repos: int = LIVE_REPOS,
    live_texts: int = LIVE_TEXTS,
) -> DataFrame:
    """Spans of secrets for each row of ``docs``.

    A null text is empty and has no spans; a null owner or repository part
    counts as an owner of its own; rows that repeat are scanned each, but equal
    texts of a repository count once for a value; an empty table gives no
    rows; other columns are not read. Work grows in proportion to a text's
    length and its number of matches.

    Returns ``id_col``, spans array (start, rank, end, kind, hash; by start,
    then kind), base array (those of the base patterns), n_live and n_example
    long (base spans whose value looks live, or copied), owners and repos long
    (the most that any of the row's values has).
    """
    text = text_or_empty()
    varied = lambda v: v.rlike("[0-9]") & (F.size(F.array_distinct(F.split(v, ""))) >= LOOSE_CHARACTERS)
    loose = F.filter(spans_of(text, [LOOSE_KIND], rank=len(BASE_KINDS)), lambda s: varied(s["value"]))
    bare = lambda spans: F.transform(spans, lambda s: s.dropFields("value"))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo_cols)).alias("repo"),
        F.xxhash64(text).alias("text"),
        bare(spans_of(text, BASE_KINDS)).alias("base"),
        bare(loose).alias("loose"),
    )
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "spans")

    hit = rows.where((F.size("base") > 0) | (F.size("loose") > 0))
    each = hit.select("row", "owner", "repo", "text", F.explode(F.concat("base", "loose")).alias("span")).withColumn("hash", F.col("span.hash"))
    # Level by level, each combined within tasks: a value that is everywhere is never gathered.
    n = lambda what="1": F.sum(what) if what != "1" else F.count(F.lit(1))
    owned = each.groupBy("hash", "owner", "repo", "text").agg(n().alias("n"))
    owned = owned.groupBy("hash", "owner", "repo").agg(n("n").alias("n"), n().alias("texts"))
    owned = owned.groupBy("hash", "owner").agg(n("n").alias("n"), n("texts").alias("texts"), n().alias("repos"))
    owned = materialize(owned.groupBy("hash").agg(n("n").alias("n"), n("texts").alias("texts"), n("repos").alias("repos"), n().alias("owners")), "owned")
    base_rank = len(BASE_KINDS)
    live = (F.col("owners") <= live_owners) & (F.col("repos") <= live_repos) & (F.col("texts") <= live_texts)
    judged = spread_join(each.select("row", "span", "hash"), owned, ["hash"], "n").groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(live & (F.col("span.rank") >= base_rank), F.col("span")))).alias("added"),
        F.sum(F.when(live & (F.col("span.rank") < base_rank), 1).otherwise(0)).alias("n_live"),
        F.sum(F.when(~live & (F.col("span.rank") < base_rank), 1).otherwise(0)).alias("n_example"),
        F.max("owners").alias("owners"),
        F.max("repos").alias("repos"),
    )
    none = F.array().cast(rows.schema["base"].dataType)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.join(judged, "row", "left").select(
        F.col("id").alias(id_col),
        F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans"),
        "base",
        *(zero(c) for c in ("n_live", "n_example", "owners", "repos")),
    )


def secret_report(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of :func:`find_secrets`, as the query returns them."""
    found = find_secrets(docs, id_col=id_col)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        id_col,
        *(count(k[0]) for k in BASE_KINDS),
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        "n_live",
        "n_example",
        "owners",
        "repos",
    )
