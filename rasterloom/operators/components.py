"""Connected components by repeated contraction.

Each round, every node points at the neighbour (or itself) that comes first in a fixed random order, and the edges are
rewritten to the nodes pointed at. A random order makes the graph shrink by a constant share each round whatever the ids
look like, so long chains of consecutive ids take O(log n) rounds. Each round is aggregations and equi-joins only: a node
with very many edges is combined before the shuffle, and its join rows are split by AQE. Once at most LAST edges are left, as
comes sooner or later at any size, one task finishes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.plans.scale import Written

#: Edges that one task finishes.
LAST = 10_000


def roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(v, p) for each node v of the edges (a, b): p is one node of its component, the same for all of them."""
    parts = list(batches)
    if not parts:
        return
    edges = pd.concat(parts, ignore_index=True)
    codes, nodes = pd.factorize(pd.concat([edges["a"], edges["b"]], ignore_index=True))
    i, j = codes[: len(edges)], codes[len(edges) :]
    label = np.arange(len(nodes))
    while (label[i] != label[j]).any():
        x, y = label[i], label[j]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    yield pd.DataFrame({"v": nodes, "p": nodes[label]})


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges; component is the smallest node of its component.

    Loops and repeated edges are allowed; rows with a null end are ignored; an empty table gives an empty table.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    current = Written(ends.distinct(), "cc-edges")
    maps: list[Written] = []
    kind = current.schema["a"].dataType.simpleString()
    for _ in range(max_rounds):
        e = current.df
        left_over = e.limit(LAST + 1).count()
        if left_over <= LAST:
            if left_over or not maps:
                maps.append(Written(e.coalesce(1).mapInPandas(roots, f"v {kind}, p {kind}"), "cc-map"))
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(
            e.select("a", F.col("a").alias("b"))
        ).unionByName(e.select(F.col("b").alias("a"), "b"))
        pointer = both.groupBy(F.col("a").alias("v")).agg(
            F.min(F.struct(F.xxhash64("b").alias("order"), F.col("b").alias("p"))).alias("m")
        )
        step = Written(pointer.select("v", F.col("m.p").alias("p")), "cc-map")
        maps.append(step)
        left = step.df.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        right = step.df.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        rest = e.where("a <> b").join(left, "a").join(right, "b").where("pa <> pb")
        rest = rest.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        following = Written(rest, "cc-edges")
        current.drop()
        current = following
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    current.drop()
    root = maps[-1].df
    for earlier in reversed(maps[:-1]):
        later = root.select(F.col("v").alias("p"), F.col("p").alias("q"))
        root = earlier.df.join(later, "p", "left").select("v", F.coalesce("q", "p").alias("p"))
    named = Written(root, "cc-root")
    for m in maps:
        m.drop()
    least = named.df.groupBy("p").agg(F.min("v").alias("component"))
    found = Written(named.df.join(least, "p").select(F.col("v").alias("node"), "component"), "components")
    named.drop()
    return found.df
