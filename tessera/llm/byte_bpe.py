"""Byte-level BPE: whole texts to token ids and back, by a two-tier lookup.

A text is cut into pre-tokens by the vocabulary's pattern. The first tier is a
minimal perfect hash over the vocabulary: a pre-token that is a token itself
costs one hash, one displacement and one comparison. The second tier merges
the bytes of the others: bytes are a linked list, neighbours that form a token
wait in a heap by rank and place, and the lowest rank is merged first. That is
the order of the vocabulary's merges, so ids are those of its own library.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

from pyspark.sql import DataFrame

from tessera.llm.common import list_column, text_or_empty

#: Keys for each displacement of the hash, seeds that are tried for it, misses in each of a memo's two generations, code points encoded at a time.
BUCKET, SEEDS, MEMO, CHARS = 2, 16, 300_000, 1_000_000
#: Code points of a pre-token that the memo keeps at most.
LONGEST = 64


def default_ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> list[bytes]:
    """Tokens by id, from lines of a token in base 64 and its rank; an id without a token is empty."""
    import base64

    with open(path, "rb") as f:
        ranks = {int(n): base64.b64decode(token) for token, n in (line.split() for line in f if line.strip())}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


class PerfectHash:
    """A minimal perfect hash of byte strings: n keys, n slots, hash and displace.

    Buckets of about BUCKET keys are placed from the largest: a displacement is
    sought that sends all keys of the bucket to free slots. A bucket of one key
    just takes a free slot (a negative displacement). A key's slot is found
    with one 64-bit hash; whether it *is* the key, one comparison tells.
    """

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        if len(set(keys)) < self.n:
            raise ValueError("Keys of a perfect hash must differ")
        for seed in range(SEEDS):
            if self._place(keys, seed):
                return
        raise ValueError("No perfect hash was found")

    def _place(self, keys: list[bytes], seed: int) -> bool:
        from xxhash import xxh3_64_intdigest as digest

        self.seed, n = seed, self.n
        self.buckets = buckets = max(1, -(-n // BUCKET))
        groups: list[list[tuple[int, int]]] = [[] for _ in range(buckets)]
        for i, k in enumerate(keys):
            h = digest(k, seed)
            groups[h % buckets].append((h // buckets, i))
        self.shifts, self.keys, self.values = [0] * buckets, [b""] * n, [0] * n
        taken, free = bytearray(n), None
        for b in sorted(range(buckets), key=lambda b: -len(groups[b])):
            members = groups[b]
            if len(members) > 1:
                for d in range(1 << 20):
                    slots = {self._slot(h, d) for h, _ in members}
                    if len(slots) == len(members) and not any(taken[s] for s in slots):
                        break
                else:
                    return False
                self.shifts[b] = d
                places = [self._slot(h, d) for h, _ in members]
            elif members:
                free = iter([s for s in range(n) if not taken[s]]) if free is None else free
                places = [next(free)]
                self.shifts[b] = -places[0] - 1
            else:
                continue
            for s, (_, i) in zip(places, members, strict=True):
                taken[s], self.keys[s], self.values[s] = 1, keys[i], i
        return True

    def _slot(self, h: int, d: int) -> int:
        return (h + d * ((h >> 20) | 1)) % self.n

    def find(self, keys: Iterable[bytes]) -> list[int]:
        """The number of each key, -1 for those that aren't in the hash."""
        from xxhash import xxh3_64_intdigest as digest

        if not self.n:
            return [-1 for _ in keys]
        seed, buckets, n, shifts, own, values, out = self.seed, self.buckets, self.n, self.shifts, self.keys, self.values, []
        for k in keys:
            h = digest(k, seed)
            d = shifts[h % buckets]
            h //= buckets
            s = -d - 1 if d < 0 else (h + d * ((h >> 20) | 1)) % n
            out.append(values[s] if own[s] == k else -1)
        return out


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: of all neighbours that form a token the one of lowest rank merges, the first of equals."""
    n = len(piece)
    ends, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n  # of the part that starts at each byte
    get = ranks.get
    heap = [(r, i) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = ends[i] if alive[i] else n
        if j >= n or get(piece[i : ends[j]]) != rank:
            continue  # one of the two has merged since
        end = ends[i] = ends[j]
        alive[j] = False
        if end < n:
            before[end] = i
            if (r := get(piece[i : ends[end]])) is not None:
                heapq.heappush(heap, (r, i))
        if (p := before[i]) >= 0 and (r := get(piece[p:end])) is not None:
            heapq.heappush(heap, (r, p))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class ByteEncoder:
    """Ids of texts by a vocabulary of ranks; one for each worker, with a bounded memo of misses."""

    def __init__(self, path: str, pattern: str, limit: int = MEMO):
        import numpy as np
        import regex

        self.tokens = read_ranks(path)
        known = [i for i, t in enumerate(self.tokens) if t]
        self.ranks = {self.tokens[i]: i for i in known}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("A byte-level vocabulary holds every byte")
        self.hash, self.ids = PerfectHash([self.tokens[i] for i in known]), known
        self.pattern, self.limit = regex.compile(pattern), limit
        self.four = [i.to_bytes(4, "little") for i in range(len(self.tokens))]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.flat = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.sizes = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _resolve(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of distinct pre-tokens, as little-endian 32-bit integers."""
        coded = [p.encode("utf-8", "surrogatepass") for p in pieces]
        own, ids, four, ranks, young, old = {}, self.ids, self.four, self.ranks, self.young, self.old
        for p, b, k in zip(pieces, coded, self.hash.find(coded), strict=True):
            if k >= 0:
                own[p] = four[ids[k]]
                continue
            if (x := young.get(p)) is None:
                if (x := old.get(p)) is None:
                    x = b"".join([four[i] for i in merge(b, ranks)])
                if len(p) <= LONGEST:
                    young[p] = x
                    if len(young) >= self.limit:  # what is used again goes into the next generation
                        old, young = young, {}
            own[p] = x
        self.young, self.old = young, old
        return own

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; pre-tokens of all texts together are looked up once each."""
        pieces = [self.pattern.findall(t) for t in texts]
        get = self._resolve(list(set().union(*pieces))).__getitem__
        return [b"".join(map(get, p)) for p in pieces]

    def long(self, text: str) -> bytes:
        """Ids of one long text, whose pre-tokens are held a part at a time."""
        found, out = (m.group() for m in self.pattern.finditer(text)), []
        while part := list(islice(found, CHARS // 4)):
            get = self._resolve(list(set(part))).__getitem__
            out.append(b"".join(map(get, part)))
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        out, at = [], 0
        while at < len(texts):
            if len(texts[at]) > CHARS:
                out.append(self.long(texts[at]))
                at += 1
                continue
            first, size = at, 0
            while at < len(texts) and size + len(texts[at]) <= CHARS:
                size += len(texts[at])
                at += 1
            out += self.many(texts[first:at])
        return out

    def decode(self, ids) -> bytes:
        """Bytes of ids, CHARS ids at a time; an id that the vocabulary lacks is an error."""
        import numpy as np

        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.sizes) and self.sizes[ids].all()):
            raise ValueError("A token id is not in the vocabulary")
        out = []
        for at in range(0, len(ids), CHARS):
            part = ids[at : at + CHARS]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            places = np.repeat(self.starts[part] - (ends - sizes), sizes) + np.arange(ends[-1])
            out.append(self.flat[places].tobytes())
        return b"".join(out)


@lru_cache(maxsize=2)
def byte_encoder(path: str, pattern: str) -> ByteEncoder:
    return ByteEncoder(path, pattern)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(``id_col``, ids array<int>): the token ids of each whole text.

    A null text is empty and an empty one has no ids. Rows that repeat, and
    null ids, are encoded each; an empty table gives no rows; other columns are
    not read. Special tokens' names in a text are ordinary text. Pre-tokens of
    CHARS code points of text are held at a time, and of a longer text's too;
    a pre-token itself takes memory in proportion to its bytes.
    """
    path, cut = ranks or default_ranks_path(), pattern or default_pattern()
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encoder = byte_encoder(path, cut)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = encoder.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), list_column([np.frombuffer(x, dtype="<i4") for x in found], pa.int32())], names=["id", "ids"])

    rows = docs.select(docs[id_col].alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)


def decode(coded: DataFrame, ids_col: str = "ids", to: str = "decoded", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``coded`` with the bytes of its ids as binary column ``to``; null ids are none. An unknown or null id is an error."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    path, cut, at, names = ranks or default_ranks_path(), pattern or default_pattern(), coded.columns.index(ids_col), coded.columns
    schema = StructType([*coded.schema.fields, StructField(to, BinaryType())])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encoder = byte_encoder(path, cut)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                lists = part.column(at)
                if lists.flatten().null_count:
                    raise ValueError("A token id is null")
                found = [encoder.decode(np.asarray(x.values, dtype=np.int64)) if x.is_valid else b"" for x in lists]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], names=[*names, to])

    return coded.mapInArrow(run, schema)
