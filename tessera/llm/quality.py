"""Quality classifier: Bradley-Terry scores learnt from preference pairs.

Each labelled document of label 1 is preferred to one of label 0. The model
gives a document the strength w.x; the loss is logistic on the difference of
the features of a pair. The threshold between accepting and rejecting is a
quantile of the training strengths (the share of label 0), and a logistic
curve around it makes strengths into scores from 0 to 1.

Features are figures of the whole text alone (shares of kinds of characters,
repetition of words, pairs and lines, lengths); every text is read once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, fresh, materialize, text_or_empty

#: Bounds of what is gathered on the driver to fit: rows of each label, and pairs.
MAX_ROWS, MAX_PAIRS = 5_000, 60_000
MARKS = "!?.,;:*#$%&<>{}|\\/=+-_@\"'()[]"


def features(text: str) -> list[float]:
    """Figures of one text; all 0 for one without characters other than white space."""
    import numpy as np

    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * FEATURES
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    marks = counts[MARK_CODES]
    lower_words = raw.lower().split()
    distinct = len(set(lower_words)) / len(words)
    pairs = len(set(zip(lower_words, lower_words[1:], strict=False))) / max(1, len(words) - 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words))
    p = counts[counts > 0] / n
    ends = sum(w[-1] in b".!?,;:" for w in words) / len(words)
    odd_ends = sum(w[-1] in b"*#$%&!|+=/<>" for w in words) / len(words)
    return [
        1.0,
        np.log1p(len(words)),
        upper / max(1, upper + lower),
        digits / n,
        marks.sum() / n,
        *np.sqrt(marks / n),
        counts[128:].sum() / n,
        distinct,
        distinct * np.log1p(len(words)),
        pairs,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))),
        lengths.mean(),
        lengths.std(),
        np.log1p(lengths.max()),
        -(p * np.log(p)).sum(),
        ends,
        odd_ends,
        sum(w.isupper() for w in words) / len(words),
        max(0.0, 1 - len(words) / 40),
    ]


MARK_CODES = [ord(c) for c in MARKS]
FEATURES = 5 + len(MARKS) + 14


def feature_table(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, empty boolean, x array) for each row; a null text is empty."""
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float32()))], names=["id", "x"])

    return docs.select(F.col(id_col).alias("id"), text_or_empty().alias("text")).mapInArrow(run, f"id {id_type}, x array<float>")


@dataclass(frozen=True)
class BradleyTerry:
    """Strength of x: weights.(x - mean) / scale; score: logistic around ``threshold``."""

    weights: tuple
    mean: tuple
    scale: tuple
    threshold: float
    slope: float

    def scores(self, x):
        import numpy as np

        z = np.clip((x - np.array(self.mean)) / np.array(self.scale), -8, 8)
        return 1 / (1 + np.exp(-np.clip(self.slope * (z @ np.array(self.weights) - self.threshold), -50, 50)))


def fit(x, y, max_pairs: int = MAX_PAIRS, penalty: float = 0.3, seed: int = 7) -> BradleyTerry:
    """Fit on rows x with labels y (0 or 1); without both labels every score is 0.5."""
    import numpy as np

    x, y = np.asarray(x, dtype=np.float64), np.asarray(y)
    if not len(x) or len(set(y.tolist())) < 2:
        return BradleyTerry((0.0,) * FEATURES, (0.0,) * FEATURES, (1.0,) * FEATURES, 0.0, 1.0)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    z = np.clip((x - mean) / scale, -8, 8)
    good, bad, rng = np.flatnonzero(y == 1), np.flatnonzero(y == 0), np.random.default_rng(seed)
    n = min(max_pairs, 20 * max(len(good), len(bad)))
    # Every document takes part: the lists are dealt in shuffled rounds.
    deal = lambda rows: np.concatenate([rng.permutation(rows) for _ in range(-(-n // len(rows)))])[:n]
    d = z[deal(good)] - z[deal(bad)]
    w = np.zeros(z.shape[1])
    for _ in range(30):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (p - 1) + penalty * n / 1000 * w
        hess = (d * (p * (1 - p))[:, None]).T @ d + (penalty * n / 1000 + 1e-6) * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    threshold = best_quantile(s, y)
    slope = 4 / max(1e-6, np.median(s[y == 1]) - np.median(s[y == 0])) if np.median(s[y == 1]) > np.median(s[y == 0]) else 1.0
    return BradleyTerry(tuple(w), tuple(mean), tuple(scale), float(threshold), float(slope))


def best_quantile(strengths, y) -> float:
    """The quantile of the strengths that parts the labels best.

    Quantiles around the share of label 0 are tried, for labels can be wrong;
    the one with the highest mean of both labels' shares of right calls holds.
    """
    import numpy as np

    share = (y == 0).mean()
    tried = np.quantile(strengths, np.clip(share * np.linspace(0.2, 1.3, 45), 0, 1))
    right = [((strengths >= t) & (y == 1)).sum() / (y == 1).sum() + ((strengths < t) & (y == 0)).sum() / (y == 0).sum() for t in tried]
    best = np.flatnonzero(np.array(right) >= max(right) - 1e-9)
    return float(tried[best].mean())


def train(x: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_ROWS) -> BradleyTerry:
    """Fit on labelled feature rows, at most ``max_rows`` of each label.

    The rows are chosen by a hash of the id, so the choice doesn't depend on
    the order of the table. Only rows with an id and a label of 0 or 1 count;
    where an id has several labels, the largest; where it has several texts, the
    one whose figures come first in order.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).groupBy("doc_id").agg(F.max(label_col).alias("y"))
    order = [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")]
    some = [known.where(F.col("y") == y).orderBy(*order).limit(max_rows) for y in (0, 1)]
    chosen = some[0].unionByName(some[1])  # bounded by 2 max_rows
    rows = x.join(F.broadcast(chosen), x["id"] == chosen["doc_id"]).groupBy("id").agg(F.min("x").alias("x"), F.first("y").alias("y"))
    got = rows.orderBy(F.md5(F.col("id").cast("string")), "id").collect()
    return fit([r["x"] for r in got], [r["y"] for r in got])


def score(x: DataFrame, model: BradleyTerry) -> DataFrame:
    """(id, score double) for each row of a feature table."""
    id_type = dict(x.dtypes)["id"]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(flat.astype(np.float64)))], names=["id", "score"])

    return x.select("id", "x").mapInArrow(run, f"id {id_type}, score double")


def held_out(id_col: str) -> "F.Column":
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Scores of every row, from a model fitted on rows that are not held out.

    A null or empty text has all features 0 and is scored like any other; a
    row with a null id is scored and not held out; rows that repeat are scored
    each; an empty table gives no rows; without labels every score is 0.5.
    Other columns are not read. Equal texts have equal scores. A text of any
    length is read whole, in time and memory in proportion to it.

    Returns ``id_col``, held_out boolean, score double, predicted int.
    """
    x = materialize(feature_table(docs, id_col), "features")
    model = train(x, labels.where(~held_out("doc_id")))
    return score(x, model).select(
        F.col("id").alias(id_col),
        held_out("id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, in one pass over the texts.

    The model is fitted first, on the labelled rows' texts; then each row is
    scored where it is read, so no text is shuffled. Null texts are empty, rows
    that repeat are judged each, an empty table stays empty, and the columns
    are those of ``docs`` whatever their names.
    """
    known = labels.where(~held_out("doc_id") & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")]
    some = [known.where(F.col("quality") == y).orderBy(*order).limit(MAX_ROWS) for y in (0, 1)]
    chosen = materialize(some[0].unionByName(some[1]), "chosen")  # bounded by 2 MAX_ROWS
    known_id = fresh(docs, "known_id")
    labelled = docs.join(F.broadcast(chosen.select(F.col("doc_id").alias(known_id))), docs[id_col] == F.col(known_id), "left_semi")
    model = train(feature_table(labelled, id_col), chosen)
    discard(chosen)
    text_at = docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x = np.array([features(t or "") for t in batch.column(text_at).to_pylist()], dtype=np.float32).astype(np.float64)
                yield batch.filter(pa.array(model.scores(x) >= least))

    return docs.mapInArrow(run, docs.schema)
