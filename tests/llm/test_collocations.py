"""Collocations against brute force; the SQL comparison is with the other queries."""

import random
import re
from collections import Counter

import oracle
import pytest

from tessera.llm import collocations
from tessera.llm.queries import ORACLE_SQL, op12_collocations

DOCS = "doc_id long, text string, lang string, n long, word string, pair string"


def brute(rows, least, top=2000):
    counts, sizes = {}, Counter()
    for text, lang in rows:
        own = counts.setdefault(lang or "und", Counter())
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = re.findall("[^ \t]+", piece)
            sizes[lang or "und"] += len(words)
            for k in range(1, 5):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in found.items():
            for s in range(len(p)):
                for e in range(s + 2, len(p) + 1):
                    if e - s < len(p):
                        inside[p[s:e]] = max(inside[p[s:e]], a)
        scored = []
        for p, a in found.items():
            if 100 * inside[p] >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["New", "york", "city", "the", "of", "café", "x\x01y", "É", "日本", "z" * 80, "a|b", "\x7f", "in\x85side"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ", ", ".\n", ";", "  "]) for _ in range(rng.randint(0, 60)))
        rows.append((text + " new YORK City hall" * rng.randint(0, 4), rng.choice(["en", "de", None, "und", "x y%\n"])))
    return [*rows, (None, "en"), ("", None), ("one. two", "fr")]


@pytest.mark.parametrize(("most", "heavy", "chunk"), [(1 << 18, 1024, 2_000_000), (4, 1024, 50), (1, 3, 7), (0, 1024, 2_000_000)])
def test_against_brute_force(spark, monkeypatch, most, heavy, chunk):
    """Also with a dictionary that is too small, with heavy pairs that are salted, and with small chunks."""
    monkeypatch.setattr(collocations, "HEAVY", heavy)
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    monkeypatch.setattr(collocations, "DISTINCT", chunk)
    rows = texts(most)
    docs = spark.createDataFrame([(i % 7, t, lang, 1, "w", "p") for i, (t, lang) in enumerate(rows)], DOCS).repartition(3)
    got = collocations.collocations(docs, least=6, most=most)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 6)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_top_and_ties(spark):
    rows = [("b b. a a. c d", "en")] * 8
    docs = spark.createDataFrame([(i, t, lang, 1, "w", "p") for i, (t, lang) in enumerate(rows)], DOCS)
    got = collocations.collocations(docs, least=2, top=2)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 2, 2)


def test_counts_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    big = spark.createDataFrame([(9_000_000_000_000_000, 9_000_000_000_000_000, 9_000_000_000_000_001)], "a long, l long, r long")
    assert big.select(F.expr("CAST(2000000 AS DECIMAL(10, 0)) * a DIV (l + r)")).first()[0] == 2_000_000 * 9_000_000_000_000_000 // 18_000_000_000_000_001


def test_empty(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, 1, "", "")], DOCS)).count() == 0


def test_query_agrees_with_sql_on_more_rows(spark):
    assert oracle.differences(op12_collocations(spark, "/root/testdata/sf0.01"), ORACLE_SQL["op12_collocations"], "/root/testdata/sf0.01") == ""
