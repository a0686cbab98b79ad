"""Mixing sources to target weights by hierarchical budgeting.

A token budget runs down a tree of domains, languages and sources by weight. What a node cannot supply goes to its
siblings first and reaches its parent's siblings only if the whole family is short. Each leaf takes its budget as a
prefix of its documents, in an order that a seed draws anew for every epoch.
"""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkyard.llm.common import written

#: The tree's levels, from the root.
LEVELS = ("domain", "language", "source")
#: Weight of a child that the weights don't name.
DEFAULT_WEIGHT = 1.0


def word_count(text: Column) -> Column:
    """Words between white space (space, tab, line feed, vertical tab, form feed, carriage return); null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def shared_out(budget: int, capacity: Mapping, weight: Mapping) -> dict:
    """Whole tokens for each child: by weight, none above its capacity, shortages to siblings by weight again.

    All of ``budget`` is shared out if the children can hold it. A child of weight 0 gets what the others can't hold.
    Remainders of rounding go to the largest fractions, then to the first names.
    """
    got = {c: 0 for c in capacity}
    open_, left = [c for c in sorted(capacity) if capacity[c] > 0], min(budget, sum(capacity.values()))
    while left and open_:
        total = sum(weight[c] for c in open_)
        share = {c: left * weight[c] / total if total else left / len(open_) for c in open_}
        full = {c for c in open_ if share[c] >= capacity[c] - got[c]}
        if not full:
            whole = {c: int(share[c]) for c in open_}
            rest = left - sum(whole.values())
            for c in sorted(open_, key=lambda c: (whole[c] - share[c], c)):
                extra = max(0, min(rest, 1, capacity[c] - got[c] - whole[c]))
                got[c] += whole[c] + extra
                rest -= extra
            return got
        for c in full:
            left -= capacity[c] - got[c]
            got[c] = capacity[c]
        open_ = [c for c in open_ if c not in full]
    return got


def leaf_budgets(stats: DataFrame, own: list[str], weights: Mapping, budget: int, max_epochs: int) -> DataFrame:
    """(names of the levels, n, budget) for every leaf of ``stats`` (names of the levels, n), level by level.

    ``weights`` maps a path prefix (a tuple) to its weight among its siblings; missing ones weigh :data:`DEFAULT_WEIGHT`.
    A leaf can supply its tokens ``max_epochs`` times. A task holds the names of one node's children, never a whole level.
    """
    given = None
    for depth in range(1, len(own) + 1):
        path, parent = own[:depth], own[: depth - 1]
        children = stats.groupBy(*path).agg((F.sum("n") * max_epochs).alias("__capacity"))
        family = children.join(given, parent) if parent else children.withColumn("__amount", F.lit(budget).cast("long"))

        def share(children: pa.Table) -> pa.Table:
            names = list(zip(*(children.column(c).to_pylist() for c in children.column_names[:-2]), strict=True))
            capacity = dict(zip(names, children.column("__capacity").to_pylist(), strict=True))
            got = shared_out(children.column("__amount")[0].as_py(), capacity, {c: weights.get(c, DEFAULT_WEIGHT) for c in names})
            columns = [*children.columns[:-2], pa.array([got[c] for c in names], pa.int64())]
            return pa.table(dict(zip([*children.column_names[:-2], "__amount"], columns, strict=True)))

        fields = ", ".join(f"{c} string" for c in path)
        given = written(family.select(*path, "__capacity", "__amount").groupBy(*parent).applyInArrow(share, f"{fields}, __amount long"), "budgets")
    return stats.join(given.withColumnRenamed("__amount", "budget"), own)


def mix_sources(
    df: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping,
    budget_share: float = 1.0,
    max_epochs: int = 4,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``df``'s rows as the mixture takes them, with its columns first, then one column a level, ``n_tokens`` and ``epoch``.

    ``levels`` gives the tree's levels in order as columns of ``df``; null counts as the name "". The budget is
    ``budget_share`` of all tokens (:func:`word_count`). A document appears once for each epoch (from 0) that takes it: in
    full epochs all of a leaf, in the last the shortest prefix of the seeded order that reaches the budget, so a leaf
    exceeds its budget by less than one document. Documents without words ride along: with their leaf's full epochs, or inside
    the prefix. Whole texts are counted, however long. Documents that draw equal keys are taken together. Rows repeated with id and text share one place in the order and are taken together. No rows in, no rows out. Columns
    of ``df`` that are named like one of those added are replaced. Texts shuffle only if a corpus has too many leaves to be
    sent to every task.
    """
    named = [F.coalesce(c.cast("string"), F.lit("")).alias(f"__l{i}") for i, c in enumerate(levels.values())]
    own = [f"__l{i}" for i in range(len(named))]
    mark = F.xxhash64(F.col(id_col), F.col(text_col))
    light = written(df.select(*named, mark.alias("__mark"), word_count(F.col(text_col)).alias("n")), "tokens")
    stats = written(light.groupBy(*own).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")), "leaves")
    whole = stats.agg(F.sum("n").alias("n"), F.max("rows").alias("rows")).first()
    tokens, most = whole["n"] or 0, whole["rows"] or 0
    budgets = leaf_budgets(stats, own, weights, int(budget_share * tokens), max_epochs)
    some = F.col("n") > 0
    epochs = F.when(some, F.expr("budget div n")).otherwise(F.lit(int(tokens == 0)))
    leaves = written(budgets.select(*own, epochs.cast("long").alias("__epochs"), F.when(some, F.col("budget") % F.col("n")).otherwise(0).cast("long").alias("__rest")), "plan")
    # a leaf's cut is looked for among about as many bins as a bin of the largest leaf holds documents
    bits = (most.bit_length() + 1) // 2
    drawn = lambda d: d.withColumn("__key", F.xxhash64(F.lit(seed), F.col("__epochs"), F.col("__mark")))
    bin_of = F.shiftrightunsigned(F.col("__key").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits) if bits else F.lit(0).cast("long")

    # the bin in which each leaf's prefix ends, then the last key within it
    placed = drawn(light.join(leaves, own)).where("__rest > 0").withColumn("__bin", bin_of)
    upto = Window.partitionBy(*own).orderBy("__bin")
    bins = placed.groupBy(*own, "__rest", "__bin").agg(F.sum("n").alias("n"))
    bins = bins.withColumn("__before", F.sum("n").over(upto) - F.col("n")).where("__before < __rest AND __before + n >= __rest")
    ends = written(bins.select(*own, F.col("__bin").alias("__end"), "__before"), "bins")  # a row a leaf
    inside = placed.join(ends, own).where("__bin = __end")
    keys = inside.groupBy(*own, "__rest", "__before", "__key").agg(F.sum("n").alias("n"))
    running = F.col("__before") + F.sum("n").over(Window.partitionBy(*own).orderBy("__key")) - F.col("n")
    cuts = keys.withColumn("__run", running).where("__run < __rest").groupBy(*own).agg(F.max("__key").alias("__cut"))
    cuts = written(cuts, "cuts")

    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), *named, mark.alias("__mark"), word_count(F.col(text_col)).alias("__n"))
    taken = drawn(rows.join(leaves, own)).join(cuts, own, "left")
    copies = (F.col("__epochs") + F.coalesce((F.col("__key") <= F.col("__cut")).cast("long"), F.lit(0))).cast("int")
    taken = taken.withColumn("__copies", copies).where("__copies > 0").withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    added = {*levels, "n_tokens", "epoch"}
    kept = [F.col(f"__row.`{c}`") for c in df.columns if c not in added]
    return taken.select(*kept, *[F.col(c).alias(name) for c, name in zip(own, levels, strict=True)], F.col("__n").alias("n_tokens"), F.col("__epoch").alias("epoch"))
