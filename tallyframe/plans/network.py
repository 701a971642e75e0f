"""Strong correlations as a network: its components, and the strongest links that hold each together.

The maximum spanning forest comes by Borůvka's rounds: every component takes its
strongest link outwards, and components so linked become one; at least half
of those that have a link go per round. Links are told apart by a strict order (weight, then
ends), so no round can close a ring. Everything is joins and aggregates over
the links; a component that holds a third of all nodes is one row of partial maxima.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import numeric_columns

from .correlation import correlation_matrix, strong_pairs
from .storage import checkpointed


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``node, component`` after every component has followed its link to the end.

    ``links`` has one ``component, onto`` row per component with a way out. Two
    components that chose each other are the only rings, and the lesser of them stays.
    Pointers are then doubled until none moves.
    """
    back = links.select(F.col("component").alias("_c"), F.col("onto").alias("_back"))
    root = (F.col("_back") == F.col("component")) & (F.col("component") < F.col("onto"))
    parents = links.join(back, F.col("onto") == F.col("_c"), "left").select(
        "component", F.when(root, F.col("component")).otherwise(F.col("onto")).alias("onto")
    )
    while True:
        parents = checkpointed(parents)
        step = parents.select(F.col("component").alias("_c"), F.col("onto").alias("_next"))
        moved = parents.join(step, F.col("onto") == F.col("_c"), "left").select(
            "component", F.coalesce("_next", "onto").alias("further"), "onto"
        )
        moved = checkpointed(moved)
        parents = moved.select("component", F.col("further").alias("onto"))
        if not moved.where(F.col("further") != F.col("onto")).limit(1).count():
            break
    ends = parents.select(F.col("component").alias("_c"), F.col("onto").alias("_root"))
    return labels.join(ends, F.col("component") == F.col("_c"), "left").select("node", F.coalesce("_root", "component").alias("component"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """``a, b, weight, in_forest, component`` for links ``a, b, weight``; the component is named after its least node.

    Links from a node to itself and without a weight are left out; of repeated links the
    heaviest counts. Equal weights are ordered by the ends.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    clean = edges.where((F.col("a") != F.col("b")) & F.col("weight").isNotNull()).groupBy(low.alias("a"), high.alias("b")).agg(F.max("weight").alias("weight"))
    clean = checkpointed(clean)
    labels = clean.select("a").union(clean.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("component"))
    forest = None
    while True:
        labels = checkpointed(labels)
        at_a = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        at_b = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        outward = clean.join(at_a, "a").join(at_b, "b").where("ca <> cb")
        # The greatest (weight, ends) of each component; ends in a fixed order make equal weights strict.
        rank = F.struct("weight", "a", "b")
        sides = F.array(F.struct(F.col("ca").alias("component"), F.col("cb").alias("onto")), F.struct(F.col("cb").alias("component"), F.col("ca").alias("onto")))
        chosen = outward.select(rank.alias("rank"), F.inline(sides)).groupBy("component").agg(F.max(F.struct("rank", "onto")).alias("best"))
        chosen = checkpointed(chosen.select("component", "best.onto", "best.rank.*"))
        if not chosen.limit(1).count():
            break
        taken = chosen.select("a", "b").distinct()
        forest = taken if forest is None else checkpointed(forest.union(taken).distinct())
        labels = _relabelled(labels, chosen.select("component", "onto"))
    least = labels.groupBy("component").agg(F.min("node").alias("name"))
    named = labels.join(least, "component").select(F.col("node").alias("a"), F.col("name").alias("component"))
    out = clean.join(named, "a")
    if forest is None:  # no links at all
        return out.select("a", "b", "weight", F.lit(False).alias("in_forest"), "component")
    marked = forest.select("a", "b", F.lit(True).alias("_in"))
    return out.join(marked, ["a", "b"], "left").select("a", "b", "weight", F.coalesce("_in", F.lit(False)).alias("in_forest"), "component")


def correlation_network(
    df: DataFrame, method: str = "pearson", threshold: float = 0.7, columns: Sequence[str] | None = None, digits: int | None = None
) -> DataFrame:
    """``col_a, col_b, r, in_forest, component`` of all pairs with ``|r|`` at or over the threshold, the strength being ``|r|``.

    ``digits`` rounds r first, so that strengths which differ by rounding only count as equal.
    """
    names = numeric_columns(df, columns)
    matrix = correlation_matrix(df, method, names)
    if digits is not None:
        matrix = matrix.withColumn("r", F.round("r", digits))
    pairs = checkpointed(strong_pairs(matrix, names, threshold).select("col_a", "col_b", "r"))
    forest = spanning_forest(pairs.select(F.col("col_a").alias("a"), F.col("col_b").alias("b"), F.abs("r").alias("weight")))
    ends = (F.least("col_a", "col_b") == F.col("a")) & (F.greatest("col_a", "col_b") == F.col("b"))
    return pairs.join(forest.select("a", "b", "in_forest", "component"), ends).select("col_a", "col_b", "r", "in_forest", "component")
