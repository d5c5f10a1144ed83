"""Byte-level BPE against the vocabulary's own library, and on odd inputs."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import byte_bpe
from tessera.llm.queries import op11_byte_bpe

DOCS = "doc_id long, text string, ids string, decoded string, id string"
ODD = ["", None, " ", "a", "\x00\x01", "<|endoftext|>", "naïve 日本語 \U0001f642!", "can't WE'LL", "\n\n \t x  y", "ab" * 700, "é" * 300, " " * 900 + "x", "१२३ ١٢٣", "zxqj " * 4000]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_exact():
    for keys in ([], [b"one"], [str(i).encode() for i in range(5000)]):
        h = byte_bpe.PerfectHash(keys)
        assert h.find(keys) == list(range(len(keys)))
        assert sorted(h.values) == list(range(len(keys)))
        assert h.find([b"", b"no such key", b"-1"]) == [-1] * 3
    with pytest.raises(ValueError):
        byte_bpe.PerfectHash([b"a", b"a"])


def test_heap_merges_like_the_library(library):
    rng = random.Random(7)
    ranks = {t: i for i, t in enumerate(byte_bpe.read_ranks(byte_bpe.default_ranks_path()))}
    for _ in range(400):
        piece = bytes(rng.choice(b"aabbcde \xc3\xa9\xff") for _ in range(rng.randint(1, 60)))
        assert byte_bpe.merge(piece, ranks) == library._encode_single_piece(piece) if piece not in ranks else True


def test_edges_against_the_library(spark, library):
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(ODD)] + [(0, "twice", "x", "y", "z"), (0, "twice", "x", "y", "z"), (None, "no id", "x", "y", "z")]
    got = byte_bpe.decode(byte_bpe.encode(spark.createDataFrame(rows, DOCS).repartition(3))).collect()
    want = sorted(((i is not None, i or 0), library.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.ids, bytes(r.decoded)) for r in got) == want
    none = spark.createDataFrame([], DOCS)
    assert byte_bpe.decode(byte_bpe.encode(none)).count() == 0


def test_long_texts_by_parts_and_small_memos(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CHARS", 400)
    e = byte_bpe.ByteEncoder(byte_bpe.default_ranks_path(), byte_bpe.default_pattern(), limit=3)
    texts = ["qwzx jkvp  hello\n" * 90, "short", "", "vrrm " * 79, "x" * 401]
    coded = [np.frombuffer(x, dtype="<i4") for x in e.encode(texts)]
    assert [x.tolist() for x in coded] == [library.encode_ordinary(t) for t in texts]
    assert [e.decode(x.astype(np.int64)).decode() for x in coded] == texts


def test_unknown_ids_are_errors(spark):
    for bad in ([60000], [-1], [None]):
        with pytest.raises(Exception, match="token id"):
            byte_bpe.decode(spark.createDataFrame([(1, bad)], "doc_id long, ids array<int>")).collect()


def test_query_against_the_library(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in docs:
        ids = library.encode_ordinary(r.text)
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha(r.text.encode())))
    assert sorted(tuple(r) for r in op11_byte_bpe(spark, sf_dir).collect()) == sorted(want)
