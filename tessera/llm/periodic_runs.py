"""Runs of repeated words by tiles of scale: octaves of periods, boundary Z-functions, stitched fragments.

A *run* is a stretch of words of smallest period q, 4 q words long at least
(and MIN_WORDS), that no neighbour extends. Periods are taken by octaves: those
from B = 2^k to 2 B - 1 share tiles of 5 B words, one for each boundary b that
is a multiple of B, from b - B to b + 4 B. Three steps:

1. *Tiles.* A document is cut into the tiles of every octave. Only tiles whose
   B words from b occur again at b + p for a p of the octave can see a run;
   fingerprints of all stretches of B words, doubled from octave to octave,
   tell that, so that all others are left out unseen. No run is lost: every
   run has such a boundary within B words of its start, and one after the
   other up to its end.
2. *Fragments.* Each tile is solved alone. The Z-function of the words from b
   and that of the words before b, backwards, give for every p at once how far
   the words stay p-periodic to either side. Powers of shorter words are left
   out: their period isn't the smallest.
3. *Stitching.* Fragments are shuffled by document and period. Neighbouring
   tiles overlap by p words at least, and fragments that do so are one run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.llm.common import materialize, text_or_empty

MIN_WORDS, MIN_EXPONENT = 6, 4
#: White space to Python's split() beyond the words' own separators.
MORE_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
WORD = re.compile("[^ \t-\r]+")
#: Parts of a document's row that a batch holds, in bytes of words.
BATCH_BYTES = 2_000_000
#: Fragments of a document's tiles that are joined at a time.
MERGE = 5_000
TILE = "octave int, boundary int, left int, words array<int>"
FRAGMENT = "period int, start int, end int"
RUNS = "array<struct<start:int,length:int,period:int>>"


def words_of(text: str) -> list[str]:
    """Words between blanks, tabs and line ends."""
    return WORD.findall(text) if MORE_SPACE.search(text) else text.split()


def codes_of(words: list[str]):
    """Words as small integers, equal for equal words."""
    import numpy as np

    own = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(own.__getitem__, words), dtype=np.int32, count=len(words))


def z_function(s: list[int]) -> list[int]:
    """For each place how many elements from there agree with those from the start; the first is the length."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    if n:
        z[0] = n
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def tiles_of(codes) -> list[tuple[int, int, int]]:
    """(octave, boundary, left end) of every tile that can see a run."""
    import numpy as np

    n, out = len(codes), []
    if n < MIN_WORDS:
        return out
    prints, size, octave = codes.astype(np.uint64), 1, 0
    while MIN_EXPONENT * size <= n:
        # prints[i] stands for the words i to i + size - 1; a row has those that may follow a boundary by an octave's period.
        rows = (len(prints) - size) // size
        later = prints[size : size + rows * size].reshape(rows, size)
        rest = prints[size + rows * size :]
        hits = np.flatnonzero((later == prints[: rows * size : size, None]).any(1)) * size
        if len(rest) and (rest == prints[rows * size]).any():
            hits = np.append(hits, rows * size)
        for b in hits.tolist():
            out.append((octave, b, max(0, b - size)))
        with np.errstate(over="ignore"):
            prints = _mixed(prints[:-size] * np.uint64(0x9E3779B97F4A7C15) + _mixed(prints[size:]))
        size, octave = 2 * size, octave + 1
    return out


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def fragments_of(octave: int, boundary: int, left: int, words: list[int], least: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(period, start, end) of what a tile sees of runs of its octave's periods.

    ``words`` are those from ``left``. A stretch that ends within the tile on
    both sides is whole, so one that is too short then is left out.
    """
    size, at, n = 1 << octave, boundary - left, len(words)
    after = z_function(words[at:])
    back = words[: min(n, at + 2 * size)][::-1]
    m = len(back)
    before = z_function([*words[:at][::-1], -1, *back])[at + 1 :]
    last = min(2 * size, n - at)
    powers = set()  # periods whose words repeat a shorter word
    for d in range(1, (last - 1) // 2 + 1):
        if after[d] >= d and d not in powers:
            powers.update(range(2 * d, min(last, d + after[d] + 1), d))
    out = []
    for p in range(size, last):
        right = after[p]
        if right < size or p in powers:
            continue
        # The words before the boundary against those before boundary + p.
        back_at = m - (at + p)
        agree = before[back_at] if 0 <= back_at < m else 0
        start, end = at - agree, at + p + right
        if (0 < start and end < n) and end - start < least * p:
            continue
        out.append((p, left + start, left + end))
    return out


def merged(fragments: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Fragments of one document, those of a period joined where they overlap by it."""
    out: list[list[int]] = []
    for p, start, end in sorted(fragments):
        if out and out[-1][0] == p and start <= out[-1][2] - p:
            out[-1][2] = max(out[-1][2], end)
        else:
            out.append([p, start, end])
    return [tuple(x) for x in out]


def tiles(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Tiles, and after those of a document its own row.

    A document's row has n_words, n_tiles and its words joined by blanks as
    ``text``; its octave is null. Tiles carry the row's number and id only.
    """
    id_type = dict(docs.dtypes)[id_col]
    rows = docs.select(docs[id_col].alias("id"), text_or_empty(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64(), None, pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
        names = ["row", "id", "n_words", "n_tiles", "text", "octave", "boundary", "left", "words"]
        batch_of = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            kinds[1], out, held = batch.schema.field(0).type, [], 0
            for key, text, row in zip(*batch.columns, strict=True):
                key, row = key.as_py(), row.as_py()
                words = words_of(text.as_py())
                codes = codes_of(words)
                found = tiles_of(codes)
                text = " ".join(words)
                for octave, b, left in found:
                    out.append((row, key, None, None, None, octave, b, left, codes[left : b + (4 << octave)]))
                    held += 4 * len(out[-1][-1])
                    if held > BATCH_BYTES:
                        yield batch_of(out)
                        out, held = [], 0
                out.append((row, key, len(words), len(found), text, None, None, None, None))
                held += len(text)
                if held > BATCH_BYTES:
                    yield batch_of(out)
                    out, held = [], 0
            if out:
                yield batch_of(out)

    return rows.mapInArrow(run, f"row long, id {id_type}, n_words long, n_tiles long, text string, {TILE}")


def fragments(tiled: DataFrame) -> DataFrame:
    """Fragments in the place of tiles, those of a batch joined already, and the rows of documents.

    A document's row gets ``open``: whether there may be fragments of it. It is
    false only if this task has solved all of its tiles, as it has where tiles
    come straight from their document; dealt anew, they may lie anywhere.
    """
    id_type = dict(tiled.dtypes)["id"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        seen: dict[int, list[int]] = {}  # tiles and fragments of documents whose rows haven't come
        for batch in batches:
            part = batch.filter(pc.is_valid(batch.column(5)))
            found: dict[int, tuple[int, list]] = {}
            keys, lists = part.column(1), part.column(8)
            for i, (row, octave, boundary, left) in enumerate(zip(*(part.column(k).to_pylist() for k in (0, 5, 6, 7)), strict=True)):
                own = found.setdefault(row, (i, []))[1]
                new = fragments_of(octave, boundary, left, lists[i].values.to_numpy(zero_copy_only=False).tolist())
                counts = seen.setdefault(row, [0, 0])
                counts[0], counts[1] = counts[0] + 1, counts[1] + len(new)
                own += new
                if len(own) > MERGE and len(own) & 1023 < len(new):
                    own[:] = merged(own)
            out = [(row, i, *f) for row, (i, some) in found.items() for f in merged(some)]
            whole = batch.filter(pc.is_valid(batch.column(2)))
            may = []
            for row, n in zip(whole.column(0).to_pylist(), whole.column(3).to_pylist(), strict=True):
                own_tiles, own_fragments = seen.pop(row, (0, 0))
                may.append(own_tiles < n or own_fragments > 0)
            a, b, n = whole.num_rows, len(out), pa.int32()
            rows, places, periods, starts, ends = zip(*out, strict=True) if out else ([],) * 5
            none = pa.nulls(a, n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([whole.column(0), pa.array(rows, pa.int64())]),
                    pa.concat_arrays([whole.column(1), keys.take(pa.array(places, pa.int64()))]),
                    pa.concat_arrays([whole.column(2), pa.nulls(b, pa.int64())]),
                    pa.concat_arrays([pa.array(may, pa.bool_()), pa.nulls(b, pa.bool_())]),
                    pa.concat_arrays([whole.column(4), pa.nulls(b, pa.string())]),
                    *(pa.concat_arrays([none, pa.array(x, n)]) for x in (periods, starts, ends)),
                ],
                names=["row", "id", "n_words", "open", "text", "period", "start", "end"],
            )

    return tiled.mapInArrow(run, f"row long, id {id_type}, n_words long, open boolean, text string, {FRAGMENT}")


def stitched(found: DataFrame, least_words: int = MIN_WORDS, least: int = MIN_EXPONENT) -> DataFrame:
    """(row, start, length, period) of runs, from fragments shuffled by document and period.

    A group is what is left of one document's one period after the joining of
    batches; it sorts by start, so a window over all before tells a new run.
    """
    group = Window.partitionBy("row", "period").orderBy("start", "end")
    before = F.max("end").over(group.rowsBetween(Window.unboundedPreceding, -1))
    parts = found.withColumn("first", F.coalesce((F.col("start") > before - F.col("period")).cast("int"), F.lit(1)))
    parts = parts.withColumn("run", F.sum("first").over(group.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = parts.groupBy("row", "period", "run").agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("length"))
    return runs.where(F.col("length") >= F.greatest(F.lit(least_words), least * F.col("period"))).select("row", "start", "length", "period")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its words, the runs in them, and the words without repeats.

    Returns ``id_col``, n_words long, text (the words joined by blanks), runs,
    an array of structs (start, length, period) by start, then period (word
    numbers from 0), and collapsed, the text without the words that a run holds
    after its first period. A null text has no words; a text without runs has
    an empty array. Rows that repeat, and null ids, are a document each; an
    empty table gives no rows; other columns are not read. One task holds a
    document's words, and later its runs; texts without a fragment are not
    shuffled.
    """
    found = materialize(fragments(tiles(docs, id_col, text_col)), "fragments", compression="zstd")
    rows = found.where("n_words IS NOT NULL").select("row", "open", F.col("id").alias(id_col), "n_words", "text")
    runs = stitched(found.where("period IS NOT NULL").select("row", "period", "start", "end"))
    runs = runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))  # of one document
    none = F.array().cast(RUNS)
    tiled = rows.where("open").join(runs, "row", "left")
    tiled = tiled.select(id_col, "n_words", "text", F.coalesce(F.transform("runs", lambda r: F.struct(r["start"], r["length"], r["period"])), none).alias("runs"))
    plain = rows.where("NOT open").select(id_col, "n_words", "text", none.alias("runs"), F.col("text").alias("collapsed"))
    return collapsed(tiled).unionByName(plain)


def collapsed(found: DataFrame) -> DataFrame:
    """Rows (id, n_words, text, runs) with the words that stay as ``collapsed``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            kept = []
            for text, runs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words, parts, at = text.split(" ") if runs else [], [], 0
                for first, last in sorted((r["start"] + r["period"], r["start"] + r["length"]) for r in runs):
                    if last > at:
                        parts += words[at : max(at, first)]
                        at = last
                kept.append(" ".join(parts + words[at:]) if runs else text)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.string())], names=[*batch.schema.names, "collapsed"])

    return found.mapInArrow(run, StructType([*found.schema.fields, StructField("collapsed", StringType())]))
