"""Set-similarity join on word shingles: a size-aware heavy-light join.

Two sets can only link if they lie in one size class or in neighbouring ones
(a class spans sizes up to 1 / threshold times its least, of WIDE_FROM elements
and more up to about CLASS_SPAN times; only sets that can link with one of the
class below take part in that too). For each class a
cost rule chooses between two exact ways to find candidates:

* small sets enumerate their subsets of fixed sizes: linked sets share a
  subset that lacks no more than the elements that may differ;
* large sets are put on inverted lists. A list is keyed by a *block*: the
  elements that one of m hash ranges holds, m exceeding the number of elements
  in which linked sets may differ, so that linked sets agree on some blocks. A
  set whose partners differ from it in d elements at most goes on its first d + 1
  lists, in the order of keys. (A list for each single shingle has a length that
  grows with the square of a common passage's use; a block of several doesn't.)

Each task first links the sets on its own part of a list to one of them, so a
list never has more entries than there are tasks, and then every list's entries
to one of the list. Which one is drawn by a hash, in one of ORDERS ways by the
list's key: so members of a group of copies meet several of the group, one of
which is likely close to them. These links are checked by exact set
intersection. Lists whose members are then still of several components are
each brought to one task, long ones in parts of which every two meet. It
compares members of different components by their *sketches* (one bit for each
of some hash ranges, the parity of the elements in it; the bits that differ are
a lower bound of the elements that differ; their number is a power of two that
grows with the set, a longer one is folded to compare) and returns a forest of
likely links, so no more pairs than members. These are checked exactly. All
other pairs of a list can't link or lie in one component, if all of its forest
is confirmed; the few lists where some of it isn't are compared once more and
all their pairs that can link are checked. Hence components are exact, while
checks grow with a list's members, not with its pairs. A set that takes part in
many checks is dealt to several tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import discard, forget_words, fresh, materialize, spread_join, text_or_empty

#: Costs of one enumerated subset and of one inverted-list entry (which is longer to verify).
SUBSET_COST, LIST_COST = 1.0, 5.0
#: Keys that a task gathers before it links them.
CHUNK_KEYS = 500_000
#: Bits of a sketch: so many at least for each element in which linked sets may differ, within bounds.
SKETCH_FACTOR, SKETCH_LEAST, SKETCH_MOST = 4, 2048, 8192
#: Classes of so many elements and more span about so many times their least size.
WIDE_FROM, CLASS_SPAN = 64, 1.5
ORDERS = 4
BLOOM_BITS = 1 << 23


@dataclass(frozen=True)
class SizeClass:
    """Sizes [low, high) and, for pairs from it and the next class, how to find candidates."""

    index: int
    low: int
    high: int
    differ: int  # most elements in which linked sets of the class and the next differ
    small: bool
    blocks: int
    spare: int  # blocks that linked sets agree on, less one


class Scheme:
    """Size classes for a threshold of percent / 100."""

    def __init__(self, percent: int):
        self.percent = percent
        self.steps = max(1, round(math.log(CLASS_SPAN) / math.log(100 / percent))) if percent < 100 else 1
        self.lows: list[int] = [1]
        self.classes: list[SizeClass] = []

    def top(self, size: int) -> int:
        """The largest size that can link with ``size``."""
        return 100 * size // self.percent

    def most_different(self, a: int, b: int) -> int:
        """Largest symmetric difference of linked sets of at most a and b elements."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def add_class(self) -> None:
        low = self.lows[-1]
        most = low
        for _ in range(self.steps if low >= WIDE_FROM else 1):
            most = self.top(most)
        self.lows.append(most + 1)

    def extend(self, size: int) -> None:
        while self.lows[-1] <= size:
            self.add_class()

    def index(self, size: int) -> int:
        from bisect import bisect_right

        self.extend(size)
        return bisect_right(self.lows, size) - 1

    def get(self, i: int) -> SizeClass:
        while len(self.lows) < i + 3:
            self.add_class()
        while len(self.classes) <= i:
            k = len(self.classes)
            low, high = self.lows[k], self.lows[k + 1]
            differ = self.most_different(high - 1, self.top(high - 1))
            blocks, spare = self.plan(low, differ)
            lacking = (100 - self.percent) * self.top(high - 1) // 100  # of the larger set
            # The boundary between small and large is where subsets start to cost more than entries on lists.
            subsets, j, most = 0, 0, (differ + 1) * LIST_COST / SUBSET_COST
            while j <= lacking and subsets <= most:
                subsets, j = subsets + math.comb(self.top(high - 1), j), j + 1
            self.classes.append(SizeClass(k, low, high, differ, subsets <= most, blocks, spare))
        return self.classes[i]

    @staticmethod
    def plan(low: int, differ: int) -> tuple[int, int]:
        """Blocks, and how many of them may be empty without harm (four deviations above the mean)."""
        spare = 1
        for _ in range(6):
            blocks = differ + 1 + spare
            empty = blocks * math.exp(-low / blocks)
            spare = max(1, min(differ + 2, math.ceil(empty + 4 * math.sqrt(empty))))
        return differ + 1 + spare, spare


@lru_cache(maxsize=8)
def scheme(percent: int) -> Scheme:
    return Scheme(percent)


class Shingler:
    """Sets of 64-bit hashes of word shingles."""

    def __init__(self, words: int, limit: int = 300_000):
        import xxhash

        self.words, self.limit = words, limit
        self.hash = xxhash.xxh3_64_intdigest
        self.memo: dict[bytes, int] = {}

    @staticmethod
    def mix(x):
        import numpy as np

        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))

    def set_of(self, text: str):
        """Sorted distinct hashes; fewer words than a shingle give one element."""
        import numpy as np

        words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and spaces only
        if not words:
            return np.zeros(0, dtype=np.uint64)
        memo = self.memo
        try:
            h = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
        except KeyError:
            missing = set(words).difference(memo)
            own = {w: self.hash(w) for w in missing}
            if len(memo) + len(own) > self.limit:
                memo.clear()
            h = np.fromiter([own[w] if w in own else memo.get(w) or self.hash(w) for w in words], dtype=np.uint64, count=len(words))
            memo.update((w, x) for w, x in own.items() if len(w) <= 64)
        k = min(self.words, len(words))
        n = len(words) - k + 1
        x = np.full(n, k, dtype=np.uint64)
        for j in range(k):
            x = self.mix(x * np.uint64(0x100000001B3) + h[j : j + n])
        return np.unique(x)


def digest(elements) -> tuple[int, int]:
    """128 bits that stand for a set."""
    import numpy as np

    a = int(elements.sum()) if len(elements) else 0
    b = int(Shingler.mix(elements ^ np.uint64(0xD6E8FEB86659FD93)).sum()) if len(elements) else 0
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


def sums_by_block(elements, block, blocks: int):
    """The sum, modulo 2^64, of the elements of each block."""
    import numpy as np

    low = np.bincount(block, (elements & np.uint64(0xFFFFFFFF)).astype(np.float64), blocks)
    high = np.bincount(block, (elements >> np.uint64(32)).astype(np.float64), blocks)
    return low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))


def keys_of(elements, plan: Scheme):
    """The keys of a set: of its own class, and of the one below if it can link with sets of that."""
    import numpy as np

    n, mix = len(elements), Shingler.mix
    i, out = plan.index(n), []
    for c in [plan.get(i)] + ([plan.get(i - 1)] if i and n <= plan.top(plan.get(i - 1).high - 1) else []):
        salt = np.uint64(0x2545F4914F6CDD1D * (c.index + 1) & (2**64 - 1))
        if c.small:
            total = elements.sum()
            lacking = (100 - plan.percent) * n // 100
            # A subset stands for itself by size and sum.
            for j in range(min(lacking, n - 1) + 1):
                less = [sum(s) & (2**64 - 1) for s in combinations(elements.tolist(), j)] if j > 1 else elements if j else [0]
                out.append(mix((total - np.array(less, dtype=np.uint64)) ^ mix(np.array([n - j], dtype=np.uint64) + salt)))
            continue
        block = (mix(elements ^ salt) % np.uint64(c.blocks)).astype(np.int64)
        full = np.bincount(block, minlength=c.blocks)
        sums = sums_by_block(mix(elements + salt), block, c.blocks)
        key = mix(sums ^ mix(np.arange(c.blocks, dtype=np.uint64) + salt))[full > 0]
        # A prefix of the keys in order: a set whose partners differ from it in d elements at most shares one of its first d + 1.
        differ = plan.most_different(n, plan.top(n) if c.index == i else c.high - 1)
        out.append(np.partition(key, differ)[: differ + 1] if len(key) > differ + 1 else key)
        empty = np.flatnonzero(full == 0).astype(np.uint64)
        if len(empty) > c.spare:  # rare: linked sets may agree on empty blocks alone, then on two at least
            a, b = np.triu_indices(len(empty), 1)
            out.append(mix(empty[a] * np.uint64(1 << 20) + empty[b] + (salt << np.uint64(1))))
    return np.unique(np.concatenate(out))


def sketch(elements, plan: Scheme):
    """Parities of the elements in each of a power of two of ranges, as 64-bit integers."""
    import numpy as np

    differ = plan.most_different(len(elements), len(elements))
    bits = min(SKETCH_MOST, max(SKETCH_LEAST, 1 << (SKETCH_FACTOR * differ - 1).bit_length())) if differ else SKETCH_LEAST
    counts = np.bincount((elements >> np.uint64(21)).astype(np.int64) % bits, minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


# Kinds of entries: a set itself (other, more: its digest); a set equal to
# another of the same task; a place on list ``key``; a set linked to another of
# the same task for list ``more``. All but places are dealt by their id. Places
# are by far the most, so they are a key and an id alone (``rest`` is null).
SET, EQUAL, PLACE, NEAR = 0, 1, 2, 3
ENTRY = "key long, id long, rest struct<other: long, more: long, n: int, kind: byte, sketch: array<long>>"


def entries(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Entries for all lists, from one pass over (id, text)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        forget_words()
        shingler, plan = Shingler(words), scheme(percent)
        equal: dict[tuple, int] = {}
        held: list[tuple] = []  # keys, id
        rest_type = pa.struct([("other", pa.int64()), ("more", pa.int64()), ("n", pa.int32()), ("kind", pa.int8()), ("sketch", pa.list_(pa.int64()))])

        def batch_of(kind, ident, other=0, more=0, n=0, sketches=None, key=None) -> pa.RecordBatch:
            size = len(ident)
            wide = lambda x: pa.array(np.broadcast_to(np.asarray(x, dtype=np.int64), size))
            ident = np.asarray(ident, dtype=np.int64)
            key = Shingler.mix(ident.view(np.uint64)).view(np.int64) if key is None else key
            if kind == PLACE:
                rest = pa.nulls(size, rest_type)
            else:
                sketched = pa.array(sketches if sketches is not None else [None] * size, pa.list_(pa.int64()))
                own = [wide(other), wide(more), pa.array(np.broadcast_to(np.asarray(n, dtype=np.int32), size)), pa.array(np.full(size, kind, dtype=np.int8)), sketched]
                rest = pa.StructArray.from_arrays(own, fields=list(rest_type))
            return pa.RecordBatch.from_arrays([wide(key), wide(ident), rest], names=["key", "id", "rest"])

        def lists() -> Iterator:
            """Link the places of this task on each list to the first of them."""
            if not held:
                return
            key = np.concatenate([k for k, _ in held]).view(np.int64)
            ident = np.repeat(np.array([i for _, i in held], dtype=np.int64), [len(k) for k, _ in held])
            way = key.view(np.uint64) % np.uint64(ORDERS)
            order = np.lexsort((Shingler.mix(ident.view(np.uint64) + (way << np.uint64(56))), key))
            key, ident = key[order], ident[order]
            first = np.r_[True, key[1:] != key[:-1]]
            hub = ident[first][np.cumsum(first) - 1]
            held.clear()
            yield batch_of(PLACE, ident[first], key=key[first])
            rest = ~first & (ident != hub)
            if rest.any():
                yield batch_of(NEAR, ident[rest], hub[rest], key[rest])

        for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            sets, same = [], []
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                elements = shingler.set_of(text)
                a, b = digest(elements)
                sets.append((ident, a, b, len(elements), sketch(elements, plan)))
                if not len(elements):
                    continue
                first = equal.setdefault((a, b, len(elements)), ident)
                if first != ident:
                    same.append((ident, first))
                    continue
                held.append((keys_of(elements, plan), ident))
            if sets:
                yield batch_of(SET, *zip(*sets, strict=True))
            if same:
                yield batch_of(EQUAL, *zip(*same, strict=True))
            if sum(len(k) for k, _ in held) >= CHUNK_KEYS:
                yield from lists()
            if len(equal) > 500_000:
                equal.clear()
        yield from lists()

    return docs.select("id", "text").mapInArrow(run, ENTRY)


def bloom_place(ident: Column) -> Column:
    return F.pmod(F.xxhash64(ident), F.lit(BLOOM_BITS)).cast("int")


def bloom_words(ids: DataFrame) -> DataFrame:
    """A Bloom filter of the ids: (word, bits), of BLOOM_BITS / 32 rows at most however many ids there are."""
    words = ids.select(bloom_place(F.col("id")).alias("at")).selectExpr("CAST(at DIV 32 AS int) AS word", "shiftleft(1L, at % 32) AS bit")
    return words.groupBy("word").agg(F.bit_or("bit").alias("bits"))


def bloom(ids: DataFrame) -> bytes:
    import numpy as np

    got = bloom_words(ids).toPandas()
    out = np.zeros(BLOOM_BITS // 32, dtype=np.uint32)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().astype(np.uint32)
    return out.tobytes()


def sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, set array) of the documents with these ids; texts are not shuffled."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(bloom(ids))  # BLOOM_BITS / 8 bytes

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        forget_words()
        shingler, table = Shingler(words), np.frombuffer(bits.value, dtype=np.uint32)
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array(table[at // 32] >> (at % 32).astype(np.uint32) & 1 == 1))
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets = [shingler.set_of(t).view(np.int64) for t in part.column(1).to_pylist()]
                offsets = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                values = np.concatenate(sets)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["id", "set"])

    some = docs.select("id", "text", bloom_place(F.col("id")).alias("at"))
    found = some.mapInArrow(run, "id long, set array<long>")
    return found.join(ids, "id", "left_semi")


#: Pairs that a copy of a set is sent to.
SPREAD = 64
#: Pairs of members of a list that a task compares in a round; longer lists are cut into parts.
ROUND_PAIRS = 1 << 22


def verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) with ``linked`` boolean, by exact intersection, as a table.

    A set in many pairs is copied once for about SPREAD of them, so that no
    task gets all pairs of one set.
    """
    each = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    ids = materialize(each.groupBy("id").agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("parts")), "ids")
    sets = sets_of(docs, ids, words).join(ids, "id")
    sets = sets.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    many = lambda c: ids.where("parts > 1").select(F.col("id").alias(c), F.col("parts").alias(f"parts_{c}"))
    dealt = pairs
    for c, other in (("a", "b"), ("b", "a")):
        dealt = dealt.join(many(c), c, "left").withColumn(f"part_{c}", F.pmod(F.xxhash64(other), F.coalesce(F.col(f"parts_{c}"), F.lit(1))).cast("int")).drop(f"parts_{c}")
    left = dealt.join(sets.select(F.col("id").alias("a"), F.col("part").alias("part_a"), F.col("set").alias("x")), ["a", "part_a"])
    both = left.join(sets.select(F.col("id").alias("b"), F.col("part").alias("part_b"), F.col("set").alias("y")), ["b", "part_b"])
    shared = F.size(F.array_intersect("x", "y"))
    out = materialize(both.select("a", "b", (100 * shared >= percent * (F.size("x") + F.size("y") - shared)).alias("linked")), "checked")
    discard(ids)
    return out


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): the least id reachable, for each id on an edge (a, b).

    Every round links each id's larger neighbours to its least one and then
    each id to its least neighbour; each halves the depth, roughly. An edge
    stays one edge, so a round needs two shuffles; it's done when none moves.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").withColumn("moved", F.lit(True))
    edges, by_end = materialize(edges, "edges"), Window.partitionBy("u")
    for _ in range(most_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.repartition("u").distinct().withColumn("m", F.least(F.min("v").over(by_end), "u")).where("v > u")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") != F.col("u")).alias("moved"))
        small = large.repartition("u").groupBy("u", "v").agg(F.max("moved").alias("moved")).withColumn("m", F.min("v").over(by_end))
        kept = F.col("v") == F.col("m")
        after = materialize(small.select(F.when(kept, F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), (F.col("moved") | ~kept).alias("moved")), "edges")
        discard(edges)
        edges = after
        if edges.where("moved").isEmpty():
            break
    else:
        raise RuntimeError("components didn't settle")
    labels = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    labels = materialize(labels.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct(), "labels")
    discard(edges)
    return labels


def similar_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id") -> DataFrame:
    """The class of near copies of each document.

    A document's set is its distinct shingles of ``words`` words (separated by
    ASCII white space, A-Z lower-cased); one with fewer words is a single
    element; one without words is empty and links with nothing, like a null
    text. Two link when 100 * intersection >= percent * union. Texts of any length
    are read whole; a task holds the keys of CHUNK_KEYS shingles or of one
    text. Rows with equal ids count as one document if their texts have equal sets and else as linked
    by their id; null ids give no row. Other columns are not read; an empty
    table gives no rows.

    Returns ``id_col``, n_shingles long, component_id long (the least id
    reachable by links).
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_or_empty().alias("text"))
    # A list has one place for each chunk of a task at most. They are dealt before what is drawn by is computed, which would be shuffled too.
    by_list, place = Window.partitionBy("key"), F.col("rest").isNull()
    drawn = F.when(place, F.struct(F.xxhash64("id", F.pmod("key", F.lit(ORDERS))), "id"))
    dealt = entries(rows, words, percent).repartition("key").withColumns({"hub": F.min(drawn).over(by_list)["id"], "n_places": F.count(drawn).over(by_list)})
    kept = dealt.where(~place | (F.col("n_places") > 1))
    kind = F.coalesce(F.col("rest.kind"), F.lit(PLACE).cast("byte")).alias("kind")
    found = materialize(kept.select("id", F.when(place, F.col("hub")).otherwise(F.col("rest.other")).alias("other"), F.when(place, F.col("key")).otherwise(F.col("rest.more")).alias("key"), "rest.n", kind, "rest.sketch"), "places")

    sets = found.where(F.col("kind") == SET)
    # Equal sets across tasks: linked to the least id, counted by partial sums.
    same = sets.where("n > 0").groupBy("other", "key", "n").agg(F.min("id").alias("least"), F.max("id").alias("last"), F.count(F.lit(1)).alias("rows")).where("least < last")
    same = materialize(same.drop("last"), "same")
    equal = spread_join(sets, same, ["other", "key", "n"], "rows").where("id != least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    equal = equal.union(found.where(F.col("kind") == EQUAL).select(F.col("id").alias("a"), F.col("other").alias("b")))
    equal = materialize(equal.distinct(), "equal")

    on_lists = found.where(F.col("kind").isin(PLACE, NEAR))
    pairs = on_lists.where("id != other").select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b")).distinct()
    known = equal.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = materialize(pairs.join(known, ["a", "b"], "left_anti"), "pairs")
    brief = sets.select("id", "n", "sketch")
    likely = plausible(pairs, brief, percent)
    checked = verified(likely, rows, words, percent)
    linked = checked.where("linked").select("a", "b").distinct()
    label = across(on_lists, equal.union(linked), brief, rows, words, percent)
    once = materialize(sets.groupBy("id").agg(F.max("n").cast("long").alias("n_shingles")), "once")
    discard(found, same, equal, pairs, likely, checked)
    return once.join(label, "id", "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))


def plausible(pairs: DataFrame, brief: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link; a set in many pairs is dealt to several tasks."""
    counts = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("rows"))
    side = brief.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")).join(counts, "b")
    met = pairs.join(brief.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    side = materialize(side, "hubs")
    out = materialize(spread_join(met, side, ["b"], "rows").where(can_link(percent)).select("a", "b").distinct(), "plausible")
    discard(side)
    return out


def can_link(percent: int) -> Column:
    """Whether sizes na, nb and sketches sa, sb allow a link; never false for a pair that links."""
    na, nb, sa, sb = F.col("na"), F.col("nb"), F.col("sa"), F.col("sb")

    def bits_apart(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda t, v: t + v)

    def folded(x: Column, size: Column) -> Column:
        return F.zip_with(F.slice(x, F.lit(1), size), F.slice(x, size + 1, size), lambda v, w: v.bitwiseXOR(w))

    ka, kb = F.size(sa), F.size(sb)
    apart = F.when(ka == kb, bits_apart(sa, sb)).when(ka == 2 * kb, bits_apart(folded(sa, kb), sb)).when(kb == 2 * ka, bits_apart(sa, folded(sb, ka))).otherwise(0)
    sized = (100 * na >= percent * nb) & (100 * nb >= percent * na)
    return sized & ((100 + percent) * apart <= (100 - percent) * (na + nb))


def across(on_lists: DataFrame, edges: DataFrame, brief: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, component) by ``edges`` and by the links between different components of these on all lists.

    Members of lists are compared by their sketches first, which yields a
    forest of likely links. Where one of these fails its check, the list is
    compared once more, and all its pairs that can link are checked.
    """
    both = on_lists.select("key", "id").union(on_lists.where("id != other").select("key", F.col("other").alias("id")))
    lists, label = materialize(both.distinct(), "lists"), components(edges)
    for every in (False, True):
        members = materialize(lists.join(label, "id", "left").withColumn("component", F.coalesce("component", "id")), "members")
        several = members.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64("id")).alias("first"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("second")).where("least < most")
        # Of two members the one pair has been checked; of lists with equal members one will do.
        several = materialize(several.where("rows > 2").groupBy("rows", "first", "second").agg(F.min("key").alias("key")).select("key", "rows"), "several")
        some = spread_join(members, several, ["key"], "rows").join(brief, "id")
        near = materialize(likely_links(some, percent, every), "near")
        checked = verified(near.select("a", "b").distinct(), rows, words, percent)
        linked = checked.where("linked").select("a", "b")
        before, doubtful = lists, near.join(checked.groupBy("a", "b").agg(F.max("linked").alias("linked")).where("NOT linked"), ["a", "b"], "left_semi")
        lists = materialize(lists.join(doubtful.select("key").distinct(), "key", "left_semi"), "lists") if not every else None
        if not linked.isEmpty():
            old, label = label, components(label.select(F.col("id").alias("a"), F.col("component").alias("b")).union(linked))
            discard(old)
        discard(before, members, several, near, checked)
        if every or lists.isEmpty():
            break
    if lists is not None:
        discard(lists)
    return label


def likely_links(members: DataFrame, percent: int, every: bool) -> DataFrame:
    """Pairs (key, a, b) of members of different components on a list that their sizes and sketches allow to link.

    ``members``: key, id, component, rows (members of the list), n, sketch.
    A task compares all members of a list, or those of two parts of one with more
    than ROUND_PAIRS pairs. It returns ``every`` such pair, or only those that join what
    no pair before has joined, closest pairs first.
    """
    most_rows = max(1, math.isqrt(ROUND_PAIRS))
    long = members.where(F.col("rows") > most_rows).withColumn("parts", F.ceil(F.col("rows") / most_rows).cast("int"))
    long = long.withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    long = long.withColumn("at", F.least("part", "with") * F.col("parts") + F.greatest("part", "with"))
    columns = ["key", "at", "part", "id", "component", "n", "sketch"]
    dealt = members.where(F.col("rows") <= most_rows).withColumns({"at": F.lit(0), "part": F.lit(0)}).select(columns).union(long.select(columns))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def ready(table: pa.Table) -> pa.RecordBatch:
            key, at, part, ident, component, n = (table.column(c).to_numpy() for c in columns[:-1])
            group = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (at[1:] != at[:-1])])
            i, j = compare(group, part, component, n.astype(np.int64), Sketches(table.column("sketch").combine_chunks()), percent, every)
            return pa.RecordBatch.from_arrays([pa.array(key[i]), pa.array(np.maximum(ident[i], ident[j])), pa.array(np.minimum(ident[i], ident[j]))], names=["key", "a", "b"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < 2 * most_rows:
                continue
            table = pa.Table.from_batches(held)
            key, at = table.column("key").to_numpy(), table.column("at").to_numpy()
            whole = int(np.flatnonzero((key != key[-1]) | (at != at[-1])).max(initial=-1)) + 1  # the last list may go on
            if whole:
                yield ready(table.slice(0, whole))
            held = table.slice(whole).to_batches()
            n -= whole
        if n:
            yield ready(pa.Table.from_batches(held))

    return dealt.repartition("key", "at").sortWithinPartitions("key", "at").mapInArrow(run, "key long, a long, b long")


class Sketches:
    """A column of sketches, each with a length of its own."""

    def __init__(self, column):
        import numpy as np

        bounds = column.offsets.to_numpy()
        self.values = column.values.to_numpy().view(np.uint64)
        self.first, self.width = bounds[:-1].astype(np.int64), np.diff(bounds)

    def folded(self, rows, width: int):
        """Those of ``rows``, folded to ``width`` integers."""
        import numpy as np

        out = np.empty((len(rows), width), dtype=np.uint64)
        for w in np.unique(self.width[rows]).tolist():
            own = self.width[rows] == w
            got = self.values[self.first[rows[own]][:, None] + np.arange(w)]
            while got.shape[1] > width:
                half = got.shape[1] // 2
                got = got[:, :half] ^ got[:, half:]
            out[own] = got
        return out


def compare(group, part, component, n, sketches: Sketches, percent: int, every: bool):
    """Rows i, j of one group, but of different components and (if it has several) parts, that can link.

    Every such pair, or a forest of them over the components.
    """
    import numpy as np

    size = np.bincount(group)
    order = np.argsort(-size[group], kind="stable")  # groups of more than r rows are the first ones
    group, part, comp, n = group[order], part[order], component[order].copy(), n[order]
    size = size[group]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], len(group)]
    of = np.repeat(np.arange(len(starts)), ends - starts)
    apart_only = (np.minimum.reduceat(part, starts) != np.maximum.reduceat(part, starts))[of]
    coarse = sketches.folded(order, max(1, int(sketches.width.min()) // 4))
    out_i, out_j, late = [], [], []

    def joined(i: int, j: int) -> None:
        """Make the components of rows i and j one."""
        own = comp[starts[of[i]] : ends[of[i]]]
        own[own == comp[i]] = comp[j]
        out_i.append(i)
        out_j.append(j)

    for r in range(1, int(size[0])):
        end = int(np.searchsorted(-size, -r))
        x, y = slice(0, end - r), slice(r, end)
        i = np.flatnonzero((group[x] == group[y]) & (comp[x] != comp[y]) & (~apart_only[x] | (part[x] != part[y])))
        i = i[(100 * n[i] >= percent * n[i + r]) & (100 * n[i + r] >= percent * n[i])]
        most = (100 - percent) * (n[i] + n[i + r]) // (100 + percent)
        can = np.bitwise_count(coarse[i] ^ coarse[i + r]).sum(axis=1, dtype=np.int64) <= most
        i, most = i[can], most[can]
        if not len(i):
            continue
        apart, width = np.empty(len(i), dtype=np.int64), np.minimum(sketches.width[order[i]], sketches.width[order[i + r]])
        for w in np.unique(width).tolist():
            own = width == w
            apart[own] = np.bitwise_count(sketches.folded(order[i[own]], w) ^ sketches.folded(order[i[own] + r], w)).sum(axis=1)
        can = apart <= most
        i, apart, most = i[can], apart[can], most[can]
        if every:
            out_i += i.tolist()
            out_j += (i + r).tolist()
            continue
        sure = 5 * apart <= 4 * most  # a sketch tells too few differences, not too many
        for k in i[sure].tolist():
            if comp[k] != comp[k + r]:
                joined(k, k + r)
        late.append((i[~sure], i[~sure] + r, apart[~sure] / most[~sure]))
    if late:
        i, j, ratio = (np.concatenate(z) for z in zip(*late, strict=True))
        nearest = np.argsort(ratio, kind="stable")
        i, j = i[nearest], j[nearest]
        for at in range(0, len(i), 1000):
            a, b = i[at : at + 1000], j[at : at + 1000]
            open_ = comp[a] != comp[b]
            for k, m in zip(a[open_].tolist(), b[open_].tolist(), strict=True):
                if comp[k] != comp[m]:
                    joined(k, m)
    return order[np.array(out_i, dtype=np.int64)], order[np.array(out_j, dtype=np.int64)]


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is the least of its class; rows without id stay."""
    found = similar_components(docs, words, percent, id_col)
    gone = materialize(found.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("id")), "gone")
    # Only rows that a Bloom filter can't tell from those that go are shuffled; it has a fixed size and is broadcast.
    gone_id, word, bits = (fresh(docs, name) for name in ("gone_id", "gone_word", "gone_bits"))
    ident = F.col(f"`{id_col}`")
    at = bloom_place(ident.cast("long"))
    marks = F.broadcast(bloom_words(gone).select(F.col("word").alias(word), F.col("bits").alias(bits)))
    marked = docs.join(marks, F.floor(at / 32).cast("int") == F.col(word), "left")
    hit = F.coalesce(F.bit_get(F.col(bits), at % 32) == 1, F.lit(False))
    stay = marked.where(~hit).drop(word, bits)
    unsure = marked.where(hit).drop(word, bits)
    return stay.union(unsure.join(gone.select(F.col("id").alias(gone_id)), ident == F.col(gone_id), "left_anti"))
