"""Shards by a hierarchical weighted hash tree.

A document descends from the root to a region, a rack and a shard. At each level every child draws from a hash of the
document's key and the child's place, exponentially with the weight below the child as its rate; the least draw wins, so a
child is taken with probability in proportion to its weight. A changed weight changes the draws of the nodes above it only:
at each level rows move into or out of the one child whose weight changed, and rows whose path doesn't meet it stay.

Shards 0 to planned - 1 fill `regions` regions of `racks` racks. Any further shard is a region of its own: it changes no
other node's weight or draw, so it takes rows only into itself.

Slots number the rows of a shard from 0 without gaps. Rows are numbered within hash buckets of a shard, as many as its rows
ask for, and shifted by the bucket's offset; rows that agree in all columns are numbered together. So no task holds a shard.

Defined results: a null key is hashed like a value, so all its rows share a shard; a null text has size 8 and CRC 0;
repeated rows share a shard and get different slots; an empty table gives an empty table; other columns are kept by
`assign` and `number`, whose own columns replace any of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.ranks import repeated, running_start
from rasterloom.llm.text import uniform
from rasterloom.plans.scale import written

REGIONS, RACKS, PLANNED = 3, 2, 24

Tree = list[list[list[tuple[int, float]]]]


def place(shard: int, regions: int = REGIONS, racks: int = RACKS, planned: int = PLANNED) -> tuple[int, int]:
    """Region and rack of a shard; more shards don't move it."""
    return (shard % regions, shard // regions % racks) if shard < planned else (regions + shard - planned, 0)


def tree(weights: Sequence[float], regions: int = REGIONS, racks: int = RACKS, planned: int = PLANNED) -> Tree:
    """(shard, weight) by region and rack; weights are by shard, and those of 0 take no rows."""
    out: Tree = [[[] for _ in range(racks)] for _ in range(regions)] + [[[]] for _ in range(max(0, len(weights) - planned))]
    for shard, weight in enumerate(weights):
        region, rack = place(shard, regions, racks, planned)
        out[region][rack].append((shard, float(weight)))
    return out


def below(node) -> float:
    return node[1] if isinstance(node, tuple) else sum(map(below, node))


def draws(key: Column, path: list[Column], weights: list[Column]) -> list[Column]:
    """A struct (draw, at) per child that has a weight; null for the others."""
    return [F.when(w > 0, F.struct((-F.log(uniform(key, *path, F.lit(i))) / w).alias("draw"), F.lit(i).alias("at"))) for i, w in enumerate(weights)]


def least(nodes: Sequence[Column]) -> Column:
    return nodes[0] if len(nodes) == 1 else F.least(*nodes)


def table(values: list) -> Column:
    """Nested lists as an array literal."""
    return F.array(*[table(v) if isinstance(v, list) else F.lit(v) for v in values])


def descend(docs: DataFrame, key: Column, nodes: Tree) -> DataFrame:
    """docs with __region, __rack and __shard: 3 + 2 + 4 draws for 24 shards, each level's within the node taken above."""
    n_racks, n_leaves = max(map(len, nodes)), max(len(rack) for region in nodes for rack in region)

    def padded(of) -> list:
        return [[[of(rack, k) for k in range(n_leaves)] for rack in region + [[]] * (n_racks - len(region))] for region in nodes]

    weight = table(padded(lambda rack, k: rack[k][1] if k < len(rack) else 0.0))
    shard = table(padded(lambda rack, k: rack[k][0] if k < len(rack) else -1))
    racks = table([[below(region[j]) if j < len(region) else 0.0 for j in range(n_racks)] for region in nodes])
    region, rack = F.col("__region"), F.col("__rack")
    out = docs.withColumn("__region", least(draws(key, [], [F.lit(below(x)) for x in nodes])).getField("at"))
    out = out.withColumn("__rack", least(draws(key, [region], [racks[region][j] for j in range(n_racks)])).getField("at"))
    out = out.withColumn("__leaf", least(draws(key, [region, rack], [weight[region][rack][k] for k in range(n_leaves)])).getField("at"))
    return out.withColumn("__shard", shard[region][rack][F.col("__leaf")]).drop("__leaf")


def assign(
    docs: DataFrame, n_shards: int = 24, key: str = "doc_id", weights: Sequence[float] | None = None, added_weight: float = 1.0, regions: int = REGIONS, racks: int = RACKS, planned: int | None = None
) -> DataFrame:
    """docs with region, rack, shard, and grown_shard: its shard if one more shard of added_weight is there. No shuffle.

    planned: the shards that the hierarchy was laid out for, 24 or fewer if there are fewer; the others are regions of their own.
    """
    weights = list(weights or [1.0] * n_shards)
    planned = min(n_shards, PLANNED) if planned is None else planned
    hashed = F.xxhash64(F.col(key))
    nodes = tree(weights, regions, racks, planned)
    out = descend(docs, hashed, nodes)
    # the further shard only adds a draw at the root
    best = least(draws(hashed, [], [F.lit(below(x)) for x in nodes] + [F.lit(float(added_weight))])).getField("at")
    grown = F.when(best == len(nodes), F.lit(n_shards)).otherwise(F.col("__shard"))
    out = out.withColumn("__grown", grown)
    return out.withColumns({"region": F.col("__region"), "rack": F.col("__rack"), "shard": F.col("__shard"), "grown_shard": F.col("__grown")}).drop("__region", "__rack", "__shard", "__grown")


def number(assigned: DataFrame, order: Sequence[str]) -> DataFrame:
    """assigned with slot, 0 to the shard's rows - 1. order: columns that tell rows apart; assigned should be a written table."""
    numbered = running_start(assigned.withColumn("__one", F.lit(1).cast("long")), ["shard"], list(order), "__one")
    return numbered.withColumn("slot", F.col("__start").cast("long")).drop("__start", "__one")


def digest(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """The query's columns: sizes and checksums instead of texts, which are then left out of every shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    small = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    same = ["doc_id", "size", "text_crc32", "shard", "grown_shard", "region", "rack"]
    placed = written(assign(small, n_shards).groupBy(*same).agg(F.count("*").alias("__rows")), "shards")
    started = written(running_start(placed, ["shard"], ["doc_id", "text_crc32", "size"], "__rows"), "shards-started")
    out = repeated(started, "__rows", "__i").withColumn("slot", (F.col("__start") + F.col("__i") - 1).cast("long"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, files_per_shard: int = 8) -> None:
    """Writes whole rows below path/shard=N, in several files per shard so that no task writes a whole shard.

    A row's file depends on its own columns, so a task that runs again deals its rows alike.
    """
    columns = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    placed = assign(docs.withColumn("__part", F.pmod(F.xxhash64(*columns), F.lit(files_per_shard))), n_shards)
    placed.repartition("shard", "__part").drop("__part").write.partitionBy("shard").parquet(path)
