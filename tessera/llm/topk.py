"""Exact top-k inner products by distributed selection over score histograms.

Queries are taken in blocks. For each block every row is scored in each pass
and no score is kept: a task gives, for each query, the counts of its scores
in equal bins of the range that still holds the query's k-th value, and only
the bins that can still matter (down to its own k-th score). Their sums locate
the bin with the k-th value; the range shrinks to it until few scores lie in
or above it, or until it holds one value. Then the scores at or above the
range's start are kept, and ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize

BINS = 512
BLOCK = 4096  # queries scored against a batch of rows at a time
ENOUGH = 8  # times k: so many scores are few enough to sort
MOST = 2**62 - 1  # scores beyond it, either way, count as it
RESULT = "query_id long, vec_id long, score long"


def integer_rows(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(id, x array<long>) with floor(scale * component); rows with a null or non-finite component are left out."""
    x = F.col(vector_col)
    fine = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("x")
    )


def matrix(column):
    """An Arrow list column as a matrix, by length of the lists: (length, rows, matrix)."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield int(size), rows, flat[starts[rows][:, None] + np.arange(size)].astype(np.int64)


def inner(x, y):
    """Exact integer products, kept within MOST; by floats where no sum can reach 2^53."""
    import numpy as np

    most = float(np.abs(x.astype(np.float64)).max(initial=0)) * float(np.abs(y.astype(np.float64)).max(initial=0)) * max(1, x.shape[1])
    if most < 2**53:
        return (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return x @ y.T
    # Rare: rows that can overflow are multiplied as Python's integers.
    out = np.empty((len(x), len(y)), dtype=np.int64)
    large = np.abs(y.astype(np.float64)).max(axis=1, initial=0) > 2.0**61 / max(1.0, float(np.abs(x.astype(np.float64)).sum(axis=1).max(initial=0)))
    out[:, ~large] = x @ y[~large].T
    exact = x.astype(object) @ y[large].T.astype(object)
    out[:, large] = np.clip(exact, -MOST, MOST).astype(np.int64) if large.any() else 0
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", bins: int = BINS, block: int = BLOCK) -> DataFrame:
    """The k rows of ``vectors`` with the highest inner product, for each query.

    Components become floor(256 * x), so scores are exact integers. A query's
    own id is no candidate; ties go to the smaller id. Vectors that are null
    or hold null or non-finite components take no part, nor do null ids; a
    query only meets vectors of its length. Rows that repeat are candidates
    each; of rows that repeat a query's id the least vector asks. With fewer
    than k candidates all are returned; empty tables give no rows. Other
    columns are not read. Components beyond the range of a long count as its
    end, scores beyond MOST as MOST.

    Returns query_id, rank int from 1, vec_id, score long.
    """
    spark = vectors.sparkSession
    rows = materialize(integer_rows(vectors, id_col, vector_col), "vectors")
    asked = integer_rows(queries, id_col, vector_col).groupBy("id").agg(F.min("x").alias("x"))
    n, top = asked.count(), rows.select(F.max(F.array_max(F.transform("x", lambda v: F.greatest(v, F.lit(0) - F.greatest(v, F.lit(-MOST)))))).alias("m")).first()["m"] or 0
    blocks = max(1, -(-n // block))
    asked = materialize(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))), "asked")
    found = None
    for b in range(blocks):
        got = asked.where(F.col("block") == b).drop("block").toArrow()  # about ``block`` vectors
        if got.num_rows:
            part = block_top_k(spark, rows, got, k, bins, top)
            # A block's candidates are few; kept, they need no block's passes again.
            part = materialize(part, "candidates") if blocks > 1 else part
            found = part if found is None else found.unionByName(part)
    discard(asked)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def block_top_k(spark, rows: DataFrame, got, k: int, bins: int, top: int) -> DataFrame:
    """The candidates of one block that can be among the first k."""
    import numpy as np

    ids = got.column("id").to_numpy()
    sized = {size: (at, x) for size, at, x in matrix(got.column("x").combine_chunks())}
    # Bounds of the scores: the sum of |q_i| times the largest component ``top`` there is.
    reach = np.zeros(len(ids), dtype=object)
    for at, x in sized.values():
        reach[at] = [min(MOST, int(v) * int(top)) for v in np.abs(x.astype(object)).sum(axis=1)] if x.shape[1] else 0
    low = np.array([-int(r) for r in reach], dtype=np.int64)
    width = np.array([max(1, -(-(2 * int(r) + 1) // bins)) for r in reach], dtype=np.int64)
    open_ = np.ones(len(ids), dtype=bool)
    shared = spark.sparkContext.broadcast((ids, sized))  # one block of queries

    def scored(batch):
        """(rows of queries, scores, ids of candidates), lists of one length at a time."""
        own, (idents, by_size) = batch.column(0).to_numpy(), shared.value
        for size, at, y in matrix(batch.column(1)):
            if size in by_size:
                q, x = by_size[size]
                for start in range(0, len(at), 1024):
                    some = slice(start, start + 1024)
                    yield q, inner(x, y[some]), own[at[some]], idents[q][:, None] != own[at[some]][None, :]

    while open_.any():
        state = spark.sparkContext.broadcast((low, width, open_))

        def counts(batches: Iterator) -> Iterator:
            import pyarrow as pa

            lows, widths, opened = state.value
            total = np.zeros((len(lows), bins + 1), dtype=np.int64)  # the last: over the range
            for batch in batches:
                for q, s, _, other in scored(batch):
                    on = opened[q]
                    if not on.any():
                        continue
                    q, s, other = q[on], s[on], other[on]
                    at = np.minimum((s - lows[q][:, None]) // widths[q][:, None], bins)
                    row, col = np.nonzero(other & (at >= 0))
                    flat = np.bincount(row * (bins + 1) + at[row, col], minlength=len(q) * (bins + 1))
                    total[q] += flat.reshape(len(q), bins + 1)
            # Bins below the task's own k-th score cannot hold the k-th of all.
            down = np.cumsum(total[:, ::-1], axis=1)[:, ::-1]
            row, col = np.nonzero((total > 0) & (down - total < k))
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(col, pa.int32()), pa.array(total[row, col], pa.int64())], names=["q", "bin", "n"])

        by_bin = rows.mapInArrow(counts, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        ahead = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")))
        kth = by_bin.withColumn("ahead", ahead).where((F.col("ahead") >= k) & (F.col("ahead") - F.col("n") < k)).toPandas()  # a row for each query at most
        hit = dict(zip(kth["q"].tolist(), zip(kth["bin"].tolist(), kth["ahead"].tolist(), strict=True), strict=True))
        for q in np.flatnonzero(open_):
            if q not in hit:  # fewer than k candidates: all of them
                open_[q] = False
                continue
            at, ahead_n = hit[q]
            low[q] += at * width[q]
            if ahead_n <= ENOUGH * k or width[q] == 1:
                open_[q] = False
            else:
                width[q] = -(-width[q] // bins)
    limits = spark.sparkContext.broadcast(low)

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            held = [np.zeros(0, dtype=np.int64)] * 3
            for q, s, own, other in scored(batch):
                row, col = np.nonzero(other & (s >= limits.value[q][:, None]))
                held = [np.concatenate(x) for x in zip(held, (ids[q[row]], own[col], s[row, col]), strict=True)]
            # Of many ties, no batch has to give more than its first k of a query.
            held = [x[np.lexsort((held[1], -held[2], held[0]))] for x in held]
            first = np.searchsorted(held[0], held[0])
            some = np.arange(len(first)) - first < k
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in held], names=["query_id", "vec_id", "score"])

    found = rows.mapInArrow(keep, RESULT)
    return found
