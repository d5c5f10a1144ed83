"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from tessera.llm import periodic_runs
from tessera.llm.queries import op13_periodic_runs

DOCS = "doc_id long, text string, row long, period int, n_words string, runs string"


def brute(words):
    """Runs (start, length, period) by the definition."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_like_the_rule(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


@pytest.mark.parametrize("seed", range(60))
def test_tiles_find_every_run(seed):
    rng = random.Random(seed)
    words = []
    while len(words) < rng.choice([3, 20, 90, 400]):
        root = [rng.choice("abc") for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13, 31]))]
        words += (root * rng.randint(1, 9))[: rng.randint(1, 200)]
        words += [rng.choice("abcd") for _ in range(rng.randint(0, 4))]
    codes = periodic_runs.codes_of(words)
    found = [f for k, b, left in periodic_runs.tiles_of(codes) for f in periodic_runs.fragments_of(k, b, left, codes[left : b + (4 << k)].tolist())]
    runs = sorted(((s, e - s, p) for p, s, e in set(periodic_runs.merged(found)) if e - s >= max(6, 4 * p)), key=lambda r: (r[0], r[2]))
    assert runs == brute(words)


def test_rows_against_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", "a", "a a a a a", "a a a a a a", "x " * 4000, "a b " * 3 + "a b", "a b c d " * 4 + "z", "one\x85two " * 9, "a\x0bb\x0cc\td\n" * 5, "same words " * 900 + "end " * 7]
    texts += [" ".join(rng.choice("ab") for _ in range(300)) for _ in range(6)] + ["tie tie tie tie tie tie go go go go go go"] * 2
    rows = [(i, t, 1, 2, "x", "y") for i, t in enumerate(texts)] + [(None, "n n n n n n n", 1, 2, "x", "y")]
    got = periodic_runs.repeated_runs(spark.createDataFrame(rows, DOCS).repartition(3))
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.text, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect())
    want = []
    for i, t, *_ in rows:
        w = words_like_the_rule(t)
        runs = brute(w)
        want.append(((i is None, i or 0), len(w), " ".join(w), runs, kept(w, runs)))
    assert got == sorted(want)
    assert periodic_runs.repeated_runs(spark.createDataFrame([], DOCS)).count() == 0


def test_fragments_of_far_batches_are_stitched(spark, monkeypatch):
    """Tiles that are solved one by one, in other tasks, give the same runs."""
    text = " ".join(["p q r s t"] * 400)
    docs = spark.createDataFrame([(1, text, 0, 0, "", "")], DOCS)
    tiles = periodic_runs.tiles(docs, "doc_id", "text").repartition(7)
    found = periodic_runs.fragments(tiles).where("period IS NOT NULL")
    assert found.count() > 1
    assert [tuple(r)[1:] for r in periodic_runs.stitched(found).collect()] == [(0, 2000, 5)]


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("length(text) < 9000 OR text IS NULL").collect()
    want = {}
    for r in docs:
        w = words_like_the_rule(r.text)
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute(w)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want[r.doc_id] = (len(runs), *top, sha("".join("%d,%d,%d\n" % x for x in runs)), sha(kept(w, runs)))
    got = {r[0]: tuple(r)[1:] for r in op13_periodic_runs(spark, sf_dir).collect()}
    assert set(want) <= set(got)
    assert {k: got[k] for k in want} == want
    assert sum(v[0] for v in want.values()) > 5
