"""Edits, round after round, on kept token trees against counting anew."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import token_counts
from tessera.llm.common import default_tokenizer_path, load_tokenizer

DOCS = "doc_id long, text string, edits array<struct<start:int,end:int,replacement:string>>"


def count(text):
    return len(load_tokenizer(default_tokenizer_path()).encode(text, add_special_tokens=False).ids)


def edited(text, edits):
    out, at = [], 0
    for s, e, new in edits:
        out += [text[at:s], new]
        at = e
    return "".join([*out, text[at:]])


def some(rng, text):
    """Edits that don't meet, by start."""
    places = sorted(rng.randint(0, len(text)) for _ in range(2 * rng.randint(0, 3)))
    return [(a, b, rng.choice(["", "x", " ", "new words here", "\n", "  two", "é"])) for a, b in zip(places[::2], places[1::2], strict=True) if a < b or rng.random() < 0.5][:3]


def test_two_and_more_rounds(spark):
    rng = random.Random(4)
    texts = {i: " ".join(rng.choice(["The", "cat,", "naïve", "it's", "1234", "\n", "zq9"]) for _ in range(rng.randint(0, 30))) for i in range(40)} | {40: "", 41: "one", 42: "end "}
    trees = token_counts.token_trees(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    for _ in range(4):
        edits = {i: some(rng, t) for i, t in texts.items()}
        edits[41] = [(len(texts[41]), len(texts[41]), "tail")]
        kept = {i: [e for k, e in enumerate(es) if k == 0 or es[k - 1][1] <= e[0] and es[k - 1][0] < e[0]] for i, es in edits.items()}
        docs = spark.createDataFrame([(i, texts[i], es) for i, es in kept.items() if es], DOCS)
        trees = token_counts.apply_edits(token_counts.with_regions(trees, docs, F.col("edits"))).drop("n_encoded")
        rows = trees.collect()
        texts = {i: edited(t, kept[i]) for i, t in texts.items()}
        assert {r.doc_id: r.n_tokens_after for r in rows} == {i: count(t) for i, t in texts.items()}
        assert {r.doc_id: sum(r.leaf_chars) for r in rows} == {i: len(t) for i, t in texts.items()}
        trees = spark.createDataFrame([(r.doc_id, r.leaf_chars, r.sums) for r in rows], "doc_id long, leaf_chars array<int>, sums array<int>")


def test_only_what_is_touched_is_encoded(spark):
    text = "some words of a text " * 500
    docs = spark.createDataFrame([(1, text, [(20, 20, "more ")]), (2, "left alone", None)], DOCS)
    trees = token_counts.token_trees(docs.select("doc_id", "text"))
    found = {r.doc_id: r for r in token_counts.apply_edits(token_counts.with_regions(trees, docs, F.col("edits"))).collect()}
    assert found[1].n_tokens_after == count(text[:20] + "more " + text[20:]) and found[1].n_encoded <= 3
    assert (found[2].n_edits, found[2].n_encoded, found[2].n_tokens_after) == (0, 0, found[2].n_tokens)


def test_trees_of_other_texts_are_errors(spark):
    docs = spark.createDataFrame([(1, "another text", [(0, 1, "x")])], DOCS)
    trees = token_counts.token_trees(spark.createDataFrame([(1, "text")], "doc_id long, text string"))
    with pytest.raises(Exception, match="another text"):
        token_counts.with_regions(trees, docs, F.col("edits")).collect()
    assert token_counts.with_regions(trees.where("false"), docs, F.col("edits")).count() == 0
