"""Edit-aware token counts by a segment tree over each document's pre-tokens.

A leaf is a word with the white space after it; the nodes above hold the sums
of FANOUT nodes each, up to the root, whose sum is the document's count. Trees
are columns of a table: code points of each leaf, and sums level by level. No
token crosses the start of a leaf, so an edit concerns a *region*: the leaves
that it touches, and those that follow while the edited text doesn't end in
white space. To apply edits to a kept tree only the regions' new texts are
encoded; the sums on the paths from their leaves to the root follow. The
document's other text is neither read nor encoded again.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm.common import OTHER_SPACE, default_tokenizer_path, discard, list_column, materialize, regex_spans, release, text_or_empty, word_encoder

SPACE = " \t\n\r"
FANOUT = 16
#: What the query's edits replace, and by what.
REDACTIONS = [
    (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>"),
    (r"AKIA[A-Z0-9]{14,}", "<key>"),
    (r"[0-9a-f]{16,}", "<hex>"),
]
EDITS = "array<struct<start:int,end:int,replacement:string>>"
REGIONS = "array<struct<first:int,last:int,text:string>>"


def leaf_lengths(text: str):
    """Code points of each leaf; an empty text has one leaf without any."""
    import numpy as np

    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(codes):
        return np.zeros(1, dtype=np.int32)
    space = (codes == 32) | (codes == 10) | (codes == 9) | (codes == 13)
    starts = np.flatnonzero(np.r_[True, space[:-1] & ~space[1:]])
    return np.diff(np.r_[starts, len(codes)]).astype(np.int32)


def leaf_words(text: str) -> list[str]:
    """The word of each leaf, without its white space; '' for one that is all white space."""
    words = text.split() if not OTHER_SPACE.search(text) else [w for w in re.split(r"[ \t\n\r]+", text) if w]
    return ["", *words] if not text or text[0] in SPACE else words


def sums_of(tokens):
    """Sums of all levels: the leaves', then those of FANOUT nodes each, the root's last."""
    import numpy as np

    levels = [tokens]
    while len(levels[-1]) > 1:
        levels.append(np.add.reduceat(levels[-1], np.arange(0, len(levels[-1]), FANOUT)))
    return np.concatenate(levels)


def add_to(sums, leaves: int, leaf: int, change: int) -> None:
    """Add to a leaf's sum and to those on its path to the root."""
    first, size = 0, leaves
    sums[leaf] += change
    while size > 1:
        first, size, leaf = first + size, -(-size // FANOUT), leaf // FANOUT
        sums[first + leaf] += change


def in_order(edits: list, length: int) -> list[tuple[int, int, str]]:
    """The edits that hold, by start: within the text, and none into the one before; of those that start together the longest."""
    kept, last = [], 0
    for e in sorted(edits, key=lambda e: (e["start"], -e["end"])):
        if last <= e["start"] <= e["end"] <= length:
            kept.append((e["start"], e["end"], e["replacement"] or ""))
            last = e["end"]
    return kept


def regions_of(text: str, lengths, edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(first leaf, last leaf, new text) for ``edits`` in order; regions don't overlap."""
    starts, at = [], 0
    for n in lengths:
        starts.append(at)
        at += int(n)
    starts.append(at)
    leaves = len(lengths)
    leaf = lambda place: min(bisect_right(starts, place, hi=leaves) - 1, leaves - 1)
    out, k = [], 0
    while k < len(edits):
        first = last = leaf(edits[k][0])
        pieces, place, end = [], starts[first], ""
        while True:
            while k < len(edits) and leaf(edits[k][0]) <= last:
                start, stop, new = edits[k]
                pieces += [text[place:start], new]
                end = new[-1:] or text[max(place, start - 1) : start] or end
                place, last, k = stop, max(last, leaf(max(start, stop - 1))), k + 1
            ends_with = text[starts[last + 1] - 1] if starts[last + 1] > place else end
            if not ends_with or ends_with in SPACE or last + 1 == leaves:
                break
            last += 1
        pieces.append(text[place : starts[last + 1]])
        out.append((first, last, "".join(pieces)))
    return out


def token_trees(docs: DataFrame, edits: Column | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """A tree for each row of ``docs``: its id, leaf_chars and sums, and the regions of its edits.

    ``edits`` as in :func:`count_tokens`. A null text is empty. A tree takes
    about two numbers for each word, whatever the text's length; a task holds
    64 texts with their trees at a time.
    """
    path = tokenizer or default_tokenizer_path()
    edits = F.coalesce(edits.cast(EDITS), F.array().cast(EDITS)) if edits is not None else F.array().cast(EDITS)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), edits.alias("edits"))
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = word_encoder(path)
        region = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("text", pa.string())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = part.column(1).to_pylist()
                lengths = [leaf_lengths(t) for t in texts]
                sums = [sums_of(n) for n in encoder.counts([leaf_words(t) for t in texts])]
                kept = [in_order(c, len(t)) for c, t in zip(part.column(2).to_pylist(), texts, strict=True)]
                found = [[{"first": a, "last": b, "text": new} for a, b, new in regions_of(t, n, c)] if c else [] for t, n, c in zip(texts, lengths, kept, strict=True)]
                counts = [len(c) for c in kept]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), list_column(lengths, pa.int32()), list_column(sums, pa.int32()), pa.array(found, region), pa.array(counts, pa.int64())],
                    names=["id", "leaf_chars", "sums", "regions", "n_edits"],
                )

    return rows.mapInArrow(run, f"id {id_type}, leaf_chars array<int>, sums array<int>, regions {REGIONS}, n_edits long").withColumnRenamed("id", id_col)


def apply_edits(trees: DataFrame, id_col: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """Apply each tree's ``regions`` to it; no text but theirs is encoded.

    Returns ``id_col``, n_tokens (the root before), n_edits, n_tokens_after
    (the root after), n_encoded, leaf_chars and sums (the tree after; the
    leaves that an edit joined to the one before are left empty).
    """
    path = tokenizer or default_tokenizer_path()
    id_type = dict(trees.dtypes)[id_col]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encoder = word_encoder(path)
        for batch in batches:
            before = [int(s[-1]) for s in (x.values.to_numpy(zero_copy_only=False) for x in batch.column(2))]
            after, encoded, changed = list(before), [0] * len(before), {}
            touched = np.flatnonzero(np.asarray(batch.column(3).value_lengths()) > 0).tolist()
            for row in touched:
                sums = np.array(batch.column(2)[row].values.to_numpy(zero_copy_only=False))
                lengths = np.array(batch.column(1)[row].values.to_numpy(zero_copy_only=False))
                regions = batch.column(3)[row].as_py()
                for r, ids in zip(regions, encoder.many([r["text"] for r in regions]), strict=True):
                    n = len(ids) // 4
                    encoded[row] += n
                    for leaf in range(r["first"], r["last"] + 1):
                        add_to(sums, len(lengths), leaf, (n if leaf == r["first"] else 0) - int(sums[leaf]))
                        lengths[leaf] = len(r["text"]) if leaf == r["first"] else 0
                after[row], changed[row] = int(sums[-1]), (lengths, sums)
            own = [c if not touched else list_column([changed[i][k] if i in changed else c[i].values.to_numpy(zero_copy_only=False) for i in range(len(before))], pa.int32()) for k, c in enumerate(batch.columns[1:3])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(before, pa.int64()), batch.column(4), pa.array(after, pa.int64()), pa.array(encoded, pa.int64()), *own], names=[id_col, "n_tokens", "n_edits", "n_tokens_after", "n_encoded", "leaf_chars", "sums"])

    return trees.select(id_col, "leaf_chars", "sums", "regions", "n_edits").mapInArrow(run, f"`{id_col}` {id_type}, n_tokens long, n_edits long, n_tokens_after long, n_encoded long, leaf_chars array<int>, sums array<int>")


def with_regions(trees: DataFrame, docs: DataFrame, edits: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Kept trees with the regions of new edits, for :func:`apply_edits`.

    ``trees`` are those of :func:`token_trees` or what :func:`apply_edits`
    left of them; ``docs`` has the texts as the trees know them, of those that
    ``edits`` (as in :func:`count_tokens`) touch, with an id that is unique and
    not null. Nothing is tokenized: a region's place follows from the leaves'
    lengths, and of the text only the region is taken on. A document without a
    tree is left out, one without edits keeps its tree and has no regions.
    """
    id_type = dict(trees.dtypes)[id_col]
    asked = docs.select(docs[id_col].alias("_id"), text_or_empty(text_col).alias("_text"), F.coalesce(edits.cast(EDITS), F.array().cast(EDITS)).alias("_edits")).where("size(_edits) > 0")
    met = trees.select(F.col(id_col).alias("id"), "leaf_chars", "sums").join(asked, F.col("id") == F.col("_id"), "left").select("id", "leaf_chars", "sums", "_text", "_edits")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        region = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("text", pa.string())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found, counts = [], []
                for lengths, text, asked in zip(part.column(1), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                    kept = in_order(asked, len(text)) if asked else []
                    counts.append(len(kept))
                    lengths = lengths.values.to_numpy(zero_copy_only=False)
                    if kept and lengths.sum() != len(text):
                        raise ValueError("A tree belongs to another text")
                    # Leaves that earlier edits left empty stand for no place in the text.
                    own = np.flatnonzero(lengths) if lengths.any() else np.zeros(1, dtype=np.int64)
                    found.append([{"first": int(own[a]), "last": int(own[b]), "text": new} for a, b, new in regions_of(text, lengths[own], kept)] if kept else [])
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(found, region), pa.array(counts, pa.int64())], names=["id", "leaf_chars", "sums", "regions", "n_edits"])

    return met.mapInArrow(run, f"id {id_type}, leaf_chars array<int>, sums array<int>, regions {REGIONS}, n_edits long").withColumnRenamed("id", id_col)


def count_tokens(docs: DataFrame, edits: Column | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, with_tree: bool = False) -> DataFrame:
    """Token counts of each text before and after its edits, from kept trees.

    ``edits`` is an array of structs (start, end, replacement): code points of
    the text, end exclusive. They are applied together; one that starts before
    the end of another, or ends after the text, is left out, and of those that
    start together the longest holds. A null text is empty, a null array has
    no edits, a null replacement deletes. Rows that repeat are counted each;
    an empty table gives no rows; very long texts take memory in proportion to
    their words. The trees are kept as a table, and the edits applied to it.

    Returns ``id_col``, n_tokens, n_edits, n_tokens_after, n_encoded (tokens
    that were encoded again) and, if asked for, the tree after the edits
    (leaf_chars, sums).
    """
    trees = materialize(token_trees(docs, edits, id_col, text_col, tokenizer), "trees")
    found = apply_edits(trees, id_col, tokenizer)
    if with_tree:
        return found
    counts = materialize(found.drop("leaf_chars", "sums"), "counts")
    discard(trees)
    return counts


def with_token_counts(docs: DataFrame, name: str, text_col: str = "text", tokenizer: str | None = None, drop_text: bool = False) -> DataFrame:
    """``docs``, without its text if so asked, with the number of tokens of each text (a null one has 0) as column ``name``."""
    path = tokenizer or default_tokenizer_path()
    at = docs.columns.index(text_col)
    kept = [i for i in range(len(docs.columns)) if not (drop_text and i == at)]
    fields = [docs.schema.fields[i] for i in kept]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = word_encoder(path)
        encoder.forget_ids()
        release()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [t or "" for t in part.column(at).to_pylist()]
                counts = encoder.totals(texts)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), pa.array(counts, pa.int64())], names=[*(f.name for f in fields), name])

    return docs.mapInArrow(run, StructType([*fields, StructField(name, LongType())]))


def redactions(text: Column, kinds: list[tuple[str, str]] = REDACTIONS) -> Column:
    """Edits that replace every match of the patterns."""

    def one(pattern: str, new: str) -> Column:
        return F.transform(regex_spans(text, pattern), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(new).alias("replacement")))

    return F.concat(*(one(*k) for k in kinds))
