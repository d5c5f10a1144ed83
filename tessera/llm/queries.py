"""The operators bound to the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, collocations, exact_dedup, html_extract, mixing, near_dup, packing, periodic_runs, quality, secrets, token_counts, topk, url_filter
from tessera.llm.common import let, table, text_or_empty


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), prompt_chars=packing.first_line(F.col("text")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality")
    return quality.quality_scores(docs, labels)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, levels = mixing.production_tree()
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"), weights, levels)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url"))


def op5_url_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The former name of what is now :func:`op5_url_filter`."""
    return url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.similar_components(table(spark, sf_dir, "documents", "doc_id", "text"), words=3, percent=90)


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return token_counts.count_tokens(docs, token_counts.redactions(text_or_empty()))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents", "doc_id", "text")))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents", "text", "lang"))


def made_periodic(doc_id: Column, text: Column) -> Column:
    """The text that the contract of :func:`op13_periodic_runs` makes of some documents, by their ids' checksums."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def cyclic(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.when(n > 0, F.array_join(F.transform(at, lambda i: F.get(words, i.cast("int"))), " ")).otherwise("")

    return F.when(h % 10 == 0, let(words, cyclic)).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = periodic_runs.repeated_runs(docs.select("doc_id", made_periodic(F.col("doc_id"), text_or_empty()).alias("text")))
    long = lambda r, name: r[name].cast("long")

    def better(a: Column, b: Column) -> Column:
        """Whether a's exponent is greater than b's; of equals the run that comes first holds."""
        return long(a, "length") * long(b, "period") > long(b, "length") * long(a, "period")

    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda acc, r: F.when(better(r, acc), r).otherwise(acc))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    found = found.select("doc_id", "runs", "collapsed", best.alias("best"), lines.alias("lines"))
    milli = F.expr("1000 * CAST(best.length AS LONG) DIV best.period")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").cast("long").alias(c) for c in ("start", "length", "period")),
        milli.alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_exact_dedup, op2_packing, op3_quality, op4_mixing, op5_url_filter, op5_url_tree, op6_secrets, op7_ngram_join, op8_html_extract, op9_topk, op10_token_counts, op11_byte_bpe, op12_collocations, op13_periodic_runs, pipeline)
}

OP1_SQL = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""

OP9_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5"""


def ngram_join_sql(words: int = 3, percent: int = 90) -> str:
    """Sets of texts, pairs by shared shingles, and the least id that a recursion over links reaches."""
    gram = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(words))
    return f"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: {gram})) END AS e FROM d),
x AS MATERIALIZED (SELECT doc_id, len(e) AS n, unnest(e) AS g FROM s),
p AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= {percent} * b.n AND 100 * b.n >= {percent} * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
ways AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
reach AS (SELECT doc_id AS u, doc_id AS v FROM s UNION SELECT reach.u, ways.v FROM reach JOIN ways ON reach.v = ways.u)
SELECT s.doc_id, len(e)::BIGINT AS n_shingles, least AS component_id FROM s JOIN (SELECT u, min(v) AS least FROM reach GROUP BY u) r ON r.u = s.doc_id"""


def collocations_sql() -> str:
    """Counts of each order by itself, then cuts and longer phrases by joins of texts."""
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS m, array_to_string(w[i:i + {k - 1}], ' ') AS phrase, w[i:i + {k - 1}] AS ws FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM pieces)" for k in (1, 2, 3, 4))
    cuts = " UNION ALL ".join(f"SELECT lang, phrase, a, {k} AS k, array_to_string(ws[:{k}], ' ') AS p, array_to_string(ws[{k + 1}:], ' ') AS q FROM c WHERE m > {k}" for k in (1, 2, 3))
    inner = " UNION ALL ".join(f"SELECT lang, array_to_string(ws[{s}:{s + m - 1}], ' ') AS phrase, a FROM c WHERE m > {m} AND m >= {s + m - 1}" for m in (2, 3) for s in range(1, 6 - m))
    return f"""WITH pieces AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
c AS MATERIALIZED (SELECT lang, m, phrase, any_value(ws) AS ws, count(*) AS a FROM ({grams}) GROUP BY lang, m, phrase HAVING count(*) >= 30),
s AS (SELECT x.lang, x.phrase, x.a, x.k, l.a AS l, r.a AS r, (2000000::HUGEINT * x.a // (l.a + r.a))::BIGINT AS score FROM ({cuts}) x JOIN c l ON l.lang = x.lang AND l.phrase = p JOIN c r ON r.lang = x.lang AND r.phrase = q),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, phrase, max(a) AS longer FROM ({inner}) GROUP BY lang, phrase),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 80 * b.a),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000"""


def url_filter_sql() -> str:
    """Templates by a recursion over whole levels with window aggregates, then purities by window sums."""
    u = url_filter
    w, prior = f"{u.PRIOR_WEIGHT}::DOUBLE", f"{u.PRIOR_PURITY}::DOUBLE"
    fit = " UNION ALL ".join(f"SELECT '{what}' AS what, '{text}' AS rule, '{text.partition('/')[0]}' AS domain, '/{text.partition('/')[2]}' AS start" for what, text in u.RULES)
    return f"""WITH RECURSIVE rules AS ({fit}),
address AS (SELECT page_id, row_number() OVER () AS r, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
ruled AS (SELECT a.*, x.rule, x.what, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs FROM address a LEFT JOIN
  (SELECT r, arg_max(rule, len(rule)) AS rule, arg_max(what, len(rule)) AS what FROM address JOIN rules ON (host = domain OR suffix(host, '.' || domain)) AND prefix(path, start) GROUP BY r) x ON x.r = a.r),
found AS (SELECT host, segs, count(*) AS n, count(*) FILTER (what = 'allow') AS good, count(*) FILTER (what = 'block') AS bad FROM ruled GROUP BY host, segs),
walk AS (
  SELECT host, segs, n, good, bad, 0 AS d, '' AS up, len(segs) = 0 AS done FROM found
  UNION ALL
  SELECT host, segs, n, good, bad, d + 1, up || '/' || CASE WHEN alone THEN array_to_string(segs[d + 1:], '/') WHEN varies AND NOT stays THEN '*' ELSE segs[d + 1] END, alone OR len(segs) = d + 1 FROM (
    SELECT *, all_rows = 1 AS alone, n_seg >= {u.LITERAL_PAGES} AND n_seg * {u.LITERAL_SHARE} >= n_own AS stays,
      (vals > {u.MANY_VALUES} AND n_own < {u.FEW_PAGES} * vals) OR (vals <= {u.MANY_VALUES} AND all_vals > {u.MANY_VALUES} AND all_n < {u.FEW_PAGES} * all_vals) AS varies FROM (
      SELECT *, count(*) OVER (PARTITION BY up) AS all_rows, sum(n) OVER (PARTITION BY host, up, segs[d + 1]) AS n_seg, sum(n) OVER (PARTITION BY host, up) AS n_own, sum(n) OVER (PARTITION BY up) AS all_n,
        count(DISTINCT segs[d + 1]) OVER (PARTITION BY host, up) AS vals, count(DISTINCT segs[d + 1]) OVER (PARTITION BY up) AS all_vals FROM walk WHERE NOT done))),
tree AS (SELECT * FROM walk WHERE done),
nodes AS (SELECT host, up AS template, regexp_extract(up, '^(.*)/[^/]*$', 1, 's') AS parent, sum(good)::BIGINT AS g, sum(good + bad)::BIGINT AS m FROM tree GROUP BY host, up),
pooled AS (SELECT *, sum(g) OVER (PARTITION BY host, parent)::BIGINT AS gp, sum(m) OVER (PARTITION BY host, parent)::BIGINT AS mp, sum(g) OVER (PARTITION BY host)::BIGINT AS gh, sum(m) OVER (PARTITION BY host)::BIGINT AS mh,
  coalesce(sum(CASE WHEN m > 0 THEN g * 1000 // m END) OVER (PARTITION BY template), 0)::BIGINT AS ga, count(*) FILTER (m > 0) OVER (PARTITION BY template) AS ma FROM nodes),
alike AS (SELECT *, m > 0 AND abs(g / nullif(m, 0) - gp / nullif(mp, 0)) - 0.5::DOUBLE / nullif(m, 0) <= {u.DEVIATIONS}::DOUBLE * sqrt(gp / nullif(mp, 0) * (1 - gp / nullif(mp, 0)) / nullif(m, 0)) AS same FROM pooled),
joined AS (SELECT *, CASE WHEN same THEN sum(CASE WHEN same THEN g ELSE 0 END) OVER (PARTITION BY host, parent)::BIGINT ELSE g END AS g1, CASE WHEN same THEN sum(CASE WHEN same THEN m ELSE 0 END) OVER (PARTITION BY host, parent)::BIGINT ELSE m END AS m1 FROM alike),
pure AS (SELECT *, (g1 + (ga / 1000 + (gp + (gh + {prior} * {w}) / (mh + {w}) * {w}) / (mp + {w}) * {w}) / (ma + {w}) * {w}) / (m1 + {w}) AS purity,
  CASE WHEN m > 0 THEN 'template' WHEN ma > 0 THEN 'hosts' WHEN mp > 0 THEN 'parent' WHEN mh > 0 THEN 'host' ELSE 'prior' END AS level FROM joined)
SELECT page_id, q.host, path, rule, coalesce(what, CASE WHEN purity < {u.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict, p.template, purity, level, CASE WHEN rule IS NOT NULL THEN 'rule' WHEN level = 'prior' THEN 'prior' ELSE 'tree' END AS by
FROM ruled q JOIN tree t ON t.host = q.host AND t.segs = q.segs JOIN pure p ON p.host = t.host AND p.template = t.up"""


#: The other operators learn, tokenize or need places of matches: they are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op5_url_filter": url_filter_sql(), "op5_url_tree": url_filter_sql(), "op7_ngram_join": ngram_join_sql(), "op9_topk": OP9_SQL, "op12_collocations": collocations_sql()}
