"""Exact dedup by a heavy-hitter split.

Equal texts share a SHA-256 digest. Digests that fill a noticeable share of
the table are found by Misra-Gries summaries (one for each task, merged by
addition) and counted exactly; those whose count is verified to be over
``n / (counters + 1)`` of the n rows are the winners. There are at most
``counters`` of them and they are broadcast, so their rows never take part in
a shuffle. All other digests are grouped by an ordinary shuffle; by the
summary's guarantee none of them holds over ``2 / (counters + 1)`` of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, materialize, text_or_empty

COUNTERS = 1024


def misra_gries(counts: dict, more: dict, counters: int) -> dict:
    """Merge two summaries and keep at most ``counters`` entries.

    Each entry's count is too small by at most total / (counters + 1).
    """
    for k, n in more.items():
        counts[k] = counts.get(k, 0) + n
    if len(counts) > counters:
        cut = sorted(counts.values(), reverse=True)[counters]
        counts = {k: n - cut for k, n in counts.items() if n > cut}
    return counts


def frequent(df: DataFrame, key: str, counters: int = COUNTERS) -> DataFrame:
    """Candidates for the frequent values of binary column ``key``.

    Holds every value with at least 2 n / (counters + 1) of the n rows and at
    most counters + 1 values; ``lower`` is a lower bound of the count.
    """

    def summarise(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        counts: dict = {}
        for batch in batches:
            found = pc.value_counts(batch.column(0))
            counts = misra_gries(counts, dict(zip(found.field(0).to_pylist(), found.field(1).to_pylist(), strict=True)), counters)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=[key, "lower"])

    n = df.count()
    parts = df.select(key).mapInArrow(summarise, f"{key} binary, lower long")
    return parts.groupBy(key).agg(F.sum("lower").alias("lower")).where(F.col("lower") * (counters + 1) >= n)


def duplicate_groups(docs: DataFrame, text: Column | None = None, id_col: str = "doc_id", counters: int = COUNTERS) -> DataFrame:
    """One row for each row of ``docs``, with the group of equal texts it is in.

    ``text`` is the text that must be equal (default: column ``text``); a null
    text counts as empty. The row with the largest id stays; null ids are the
    smallest, and of rows that agree in id and text one stays. An empty table
    gives no rows; other columns of ``docs`` are not read. A text of any length
    is read once and only its digest is kept.

    Returns ``id_col``, keep_id, group_size long, kept boolean, text_sha256.
    """
    text = text_or_empty() if text is None else F.coalesce(text, F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    last = [F.max(F.struct("id", "row")).alias("last"), F.count(F.lit(1)).alias("group_size")]

    heavy = F.broadcast(frequent(rows, "digest", counters).select("digest"))
    winners = rows.join(heavy, "digest").groupBy("digest").agg(*last)
    winners = materialize(winners.where(F.col("group_size") * (counters + 1) > rows.count()), "winners")
    winners = F.broadcast(winners)  # at most counters rows
    light = rows.join(winners.select("digest"), "digest", "left_anti")
    found = rows.join(winners, "digest").unionByName(light.join(light.groupBy("digest").agg(*last), "digest"))
    return found.select(
        F.col("id").alias(id_col),
        F.col("last.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("last.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs`` whatever their names.

    Rows are told apart by id and digest, so ids may repeat with other texts;
    of rows that agree in both any one stays. Otherwise as in
    :func:`duplicate_groups`.
    """
    digest, stay_id, stay_digest = (fresh(docs, c) for c in ("digest", "stay_id", "stay_digest"))
    keyed = docs.withColumn(digest, F.sha2(text_or_empty().cast("binary"), 256))
    groups = duplicate_groups(docs, id_col=id_col, counters=counters)
    stay = groups.where("kept").select(F.col(id_col).alias(stay_id), F.col("text_sha256").alias(stay_digest))
    left = keyed.join(stay, F.col(f"`{id_col}`").eqNullSafe(F.col(stay_id)) & (F.col(digest) == F.col(stay_digest)), "left_semi")
    again = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(id_col).alias(stay_id))
    if again.isEmpty():
        return left.drop(digest)
    # Rows that agree in id and text: the join keeps all of them.
    once = left.join(again, F.col(f"`{id_col}`").eqNullSafe(F.col(stay_id)), "left_anti")
    some = left.join(again, F.col(f"`{id_col}`").eqNullSafe(F.col(stay_id)), "left_semi").dropDuplicates([id_col, digest])
    return once.unionByName(some).drop(digest)
