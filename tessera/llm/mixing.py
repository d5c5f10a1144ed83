"""Mixing sources to target weights by hierarchical budgeting.

A tree (domain, language, source) carries weights at every level. A budget of
tokens flows down it in proportion to the weights. What a node cannot supply is
shared among its siblings that still can, in proportion to theirs, before any
of it goes back to the ancestors: each level is filled like connected vessels,
from the root. A leaf's share is a prefix of its documents, in an order drawn
for each epoch from a seed: whole epochs first, then the prefix of the next.

The tree is small (its leaves are the sources), so budgets are figured on the
driver from one aggregated row for each leaf. The prefix of a leaf, however
large, is found by narrowing histograms of the drawn order, not by sorting the
leaf in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import driver_table, fresh, materialize, text_or_empty
from tessera.llm.token_counts import with_token_counts

BITS = 10  # of the drawn order in each histogram
FEW = 2_000  # rows of a leaf that one task may sort
MAX_LEAVES = 100_000
#: Columns that place a leaf's rows, and their bits: drawn by id, drawn by id and text, a running number.
ORDER = [("place", 60), ("tie", 60), ("row", 70)]


@dataclass
class Node:
    """A node of the tree: supply and budget in tokens."""

    name: tuple
    weight: float = 1.0
    supply: int = 0
    budget: int = 0
    children: list["Node"] = field(default_factory=list)


def fill(budget: int, nodes: list[Node]) -> None:
    """Share ``budget`` among ``nodes`` by weight, none over its supply.

    Whole tokens: what rounding leaves goes to the largest fractions, ties to
    the smaller name. Nodes of weight 0 get tokens only when all others are
    full.
    """
    for group in (True, False):
        open_ = sorted((n for n in nodes if (n.weight > 0) == group and n.supply > 0), key=lambda n: n.name)
        left = budget - sum(n.budget for n in nodes)
        while open_ and left > 0:
            total = sum(n.weight for n in open_) if group else len(open_)
            share = {n.name: left * (n.weight if group else 1) / total for n in open_}
            full = [n for n in open_ if n.supply <= share[n.name]]
            if full:
                for n in full:
                    n.budget = n.supply
                    left -= n.supply
                done = {n.name for n in full}
                open_ = [n for n in open_ if n.name not in done]
                continue
            for n in open_:
                n.budget = int(share[n.name])
            rest = left - sum(n.budget for n in open_)
            for n in sorted(open_, key=lambda n: (n.budget - share[n.name], n.name))[:rest]:
                n.budget += 1
            break


def budgets(supply: dict[tuple, int], weights: dict[tuple, float], total: int, default: float = 1.0) -> dict[tuple, int]:
    """Tokens for each leaf. Keys of ``weights`` are prefixes of leaf names, one for each node."""
    root = Node((), children=[])
    at = {(): root}
    for leaf in sorted(supply):
        for d in range(1, len(leaf) + 1):
            if leaf[:d] not in at:
                at[leaf[:d]] = Node(leaf[:d], float(weights.get(leaf[:d], default)))
                at[leaf[: d - 1]].children.append(at[leaf[:d]])
            at[leaf[:d]].supply += supply[leaf]
    root.supply, root.budget = sum(supply.values()), min(total, sum(supply.values()))
    level = [root]
    while level:
        for node in level:
            fill(node.budget, node.children)
        level = [c for n in level for c in n.children]
    return {leaf: at[leaf].budget for leaf in supply}


def whole_budget(own: dict[tuple, int], weights: dict[tuple, float], max_epochs: int) -> int:
    """The least budget at which every leaf gives each of its documents, if short ones are repeated ``max_epochs`` times at most."""
    supply = {leaf: n * max_epochs for leaf, n in own.items()}
    low, high = sum(own.values()), sum(supply.values())
    while low < high:
        middle = (low + high) // 2
        got = budgets(supply, weights, middle)
        if all(got[leaf] >= n for leaf, n in own.items()):
            high = middle
        else:
            low = middle + 1
    return high


def drawn(seed: int, epoch: Column, id_col: Column) -> Column:
    """A document's place in an epoch: 60 bits of a digest of seed, epoch and id."""
    text = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    weights: dict[tuple, float],
    levels: dict[str, Column],
    budget: int | None = None,
    share: float | None = 0.5,
    max_epochs: int = 4,
    seed: int = 17,
    id_col: str = "doc_id",
    tokens: Column | None = None,
    with_row: bool = False,
) -> DataFrame:
    """How often each document is taken, for the mix to meet ``weights``.

    ``levels`` names the levels of the tree and says how to get them; a null
    level is the empty name. ``budget`` is in tokens (default: ``share`` of all
    tokens there are, or :func:`whole_budget` if that is None); ``tokens``
    counts a document's (default: the tokenizer's ids of the whole text,
    however long; a null text has 0). A leaf supplies its tokens
    ``max_epochs`` times at most. A document is taken in its last epoch if the
    tokens before it are short of the leaf's budget; so a leaf exceeds its
    budget by less than one document. Documents without tokens are taken with
    the place they were drawn. Rows with equal or null ids are separate rows,
    in an order drawn from their text as well; of equal rows any may be first.
    An empty table gives no rows. Levels may have any names but those of the
    other columns returned.

    Returns ``id_col``, the levels, n_tokens long, leaf_tokens long,
    leaf_budget long, copies int and, if asked for, row (a struct of the
    columns of ``docs``).
    """
    names = [f"level{i}" for i in range(len(levels))]
    digest = F.md5(text_or_empty()) if "text" in docs.columns else F.lit("")
    parts = [F.col(f"`{id_col}`").alias("id"), digest.alias("digest"), *(F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(names, levels.values(), strict=True))]
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    if tokens is not None:
        rows = docs.select(*parts, F.coalesce(tokens, F.lit(0)).cast("long").alias("n_tokens"), *([whole] if with_row else []))
    elif with_row:
        n_tokens = fresh(docs, "n_tokens")
        rows = with_token_counts(docs, n_tokens).select(*parts, F.col(n_tokens).alias("n_tokens"), whole)
    else:
        rows = with_token_counts(docs.select(*parts, "text"), "n_tokens", drop_text=True)
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "mixing")
    leaves = rows.groupBy(*names).agg(F.sum("n_tokens").alias("leaf_tokens")).limit(MAX_LEAVES + 1).collect()
    if len(leaves) > MAX_LEAVES:
        raise ValueError(f"over {MAX_LEAVES} leaves: the last level of the tree must be a source, not a document")
    own = {tuple(r[n] for n in names): r["leaf_tokens"] for r in leaves}
    if budget is None:
        budget = whole_budget(own, weights, max_epochs) if share is None else int(sum(own.values()) * share)
    wanted = budgets({leaf: n * max_epochs for leaf, n in own.items()}, weights, budget)
    spark = docs.sparkSession
    plan = [(*leaf, n, wanted[leaf], wanted[leaf] // n if n else 0, wanted[leaf] % n if n else 0) for leaf, n in own.items()]
    schema = ", ".join(f"{n} string" for n in names) + ", leaf_tokens long, leaf_budget long, epochs long, rest long"
    plan = driver_table(spark, plan, schema)  # MAX_LEAVES rows at most
    rows = rows.join(F.broadcast(plan), names).withColumn("place", drawn(seed, F.col("epochs"), F.col("id")))
    rows = rows.withColumn("tie", drawn(seed, F.col("epochs"), F.concat_ws("|", F.col("id").cast("string"), "digest")))
    taken = prefix(rows, names)
    again = F.when(F.col("taken"), 1).otherwise(0)
    out = [F.col("id").alias(id_col), *(F.col(n).alias(given) for n, given in zip(names, levels, strict=True))]
    whole = [F.col("whole").alias("row")] if with_row else []
    return taken.select(*out, "n_tokens", "leaf_tokens", "leaf_budget", (F.col("epochs") + again).cast("int").alias("copies"), *whole)


def words() -> Column:
    """The number of words between white space of column ``text``, for ``tokens`` of :func:`mix`."""
    return F.size(F.filter(F.split(text_or_empty(), r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))


def prefix(rows: DataFrame, names: list[str], few: int = FEW) -> DataFrame:
    """``rows`` with taken: the tokens of the leaf's rows placed before are under ``rest``.

    Rows are placed by ORDER. Each round counts the tokens of the rows in the
    leaf's open range of places in 2^BITS bins and opens the bin where the sum
    reaches ``rest``; where a range is down to one place, the next column of
    ORDER parts its rows. The last range, of few rows, is summed in order.
    """
    spark = rows.sparkSession
    leaf = ", ".join(f"`{n}` string" for n in names)
    parts: list[Column] = []  # what places a row in this round's ranges
    edges: dict[tuple, tuple] = {}  # for each leaf its open range, a value for each of parts
    sums: dict[tuple, int] = {}  # and the tokens before it

    def judged(how: str) -> tuple[DataFrame, Column, Column]:
        """``rows`` with their leaf's open range (null without one), their place and the range's."""
        fields = "".join(f", edge{i} long" for i in range(len(parts)))
        state = driver_table(spark, [(*k, *e, sums[k]) for k, e in edges.items()], f"{leaf}{fields}, before long")  # MAX_LEAVES rows at most
        at = F.struct(*(c.alias(f"p{i}") for i, c in enumerate(parts)))
        edge = F.struct(*(F.col(f"edge{i}").alias(f"p{i}") for i in range(len(parts))))
        return rows.join(F.broadcast(state), names, how), at, edge

    for column, bits in ORDER:
        for shift in range(bits - BITS, -1, -BITS):
            open_rows = rows.withColumn("before", F.lit(0).cast("long"))
            if parts:
                found, at, edge = judged("inner")
                open_rows = found.where(at == edge)
            bins = open_rows.withColumn("bin", F.shiftright(column, shift)).groupBy(*names, "bin").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.first("rest").alias("rest"), F.first("before").alias("b"))
            order = Window.partitionBy(*names).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
            bins = bins.withColumn("before", F.col("b") + F.coalesce(F.sum("t").over(order), F.lit(0)))
            # The last bin that starts under the rest: for each leaf one row.
            hit = bins.where(F.col("before") < F.col("rest")).groupBy(*names).agg(F.max(F.struct("bin", "before", "n")).alias("m"))
            got = hit.select(*names, F.col("m.bin").alias("range"), F.col("m.before").alias("before"), F.col("m.n").alias("n")).collect()
            first = shift == bits - BITS
            keys = {r: tuple(r[n] for n in names) for r in got}
            edges = {k: (*(edges.get(k, ()) if first else edges[k][:-1]), r["range"]) for r, k in keys.items()}
            sums = {k: r["before"] for r, k in keys.items()}
            parts = [*(parts if first else parts[:-1]), F.shiftright(column, shift)]
            most = max((r["n"] for r in got), default=0)
            if most <= few:
                break
        if most <= few:
            break
    found, at, edge = judged("left")
    clear = found.where(F.col("before").isNull() | (at != edge)).withColumn("taken", F.coalesce(F.col("before").isNotNull() & (at < edge), F.lit(False)))
    order = Window.partitionBy(*names).orderBy(*(c for c, _ in ORDER)).rowsBetween(Window.unboundedPreceding, -1)
    last = found.where(F.col("before").isNotNull() & (at == edge)).withColumn("taken", F.col("before") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0)) < F.col("rest"))
    return clear.unionByName(last)


# The query's tree. Weights of the nodes that differ from 1.
DOMAIN_OF_SOURCE = {"web": range(0, 8), "books": range(8, 12), "code": range(12, 15)}
WEIGHTS = {("web",): 0.5, ("books",): 0.2, ("code",): 0.1, ("other",): 0.2}
LANGUAGE_WEIGHTS = {"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1}


def domain(source: str = "source") -> Column:
    """The domain of a source: by its number, others by default."""
    out = F.lit("other")
    for name, numbers in DOMAIN_OF_SOURCE.items():
        out = F.when(F.col(source).isin(*(f"src{i}" for i in numbers)), name).otherwise(out)
    return out


def production_tree() -> tuple[dict[tuple, float], dict[str, Column]]:
    weights = dict(WEIGHTS)
    for d in (*DOMAIN_OF_SOURCE, "other"):
        weights |= {(d, lang): w for lang, w in LANGUAGE_WEIGHTS.items()}
    return weights, {"domain": domain(), "lang": F.col("lang"), "source": F.col("source")}


def take(docs: DataFrame, share: float | None = None, seed: int = 17, id_col: str = "doc_id", max_epochs: int = 4, tokens: Column | None = None) -> DataFrame:
    """The documents of the production mix, each as often as it is taken, with the columns of ``docs``.

    Without ``share`` the budget follows from the supplies: no document is
    left out, and leaves that are short are repeated. A leaf without tokens has
    no budget; its documents are kept once.
    """
    weights, levels = production_tree()
    mixed = mix(docs, weights, levels, share=share, max_epochs=max_epochs, seed=seed, id_col=id_col, tokens=tokens, with_row=True)
    copies = F.when(F.col("leaf_tokens") == 0, 1).otherwise(F.col("copies"))
    return mixed.select("row", F.explode(F.array_repeat(F.lit(0), copies))).select("row.*")
