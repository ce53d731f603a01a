import math
import re
import zlib

import pandas as pd
from pyspark.sql import functions as F

from rasterloom.llm import mixing, sharding


def test_key_law_and_slots(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got, rows = sharding.digest(docs, 24).toPandas().set_index("doc_id"), docs.toPandas().set_index("doc_id")
    assert len(got) == len(rows) and got.shard.between(0, 23).all()
    assert ((got.grown_shard == got.shard) | (got.grown_shard == 24)).all()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    for d, t in rows.text.items():
        assert got.loc[d, "size"] == len(t.encode()) + 8 and got.loc[d, "text_crc32"] == zlib.crc32(t.encode())
    # one more shard is the same as a tree with that shard
    more = sharding.digest(docs, 25).toPandas().set_index("doc_id")
    assert (more.shard.loc[got.index] == got.grown_shard).all()


def test_shares_follow_weights(spark):
    weights = [1.0, 2.0, 3.0, 0.0, 2.0]
    ids = spark.range(40_000).withColumnRenamed("id", "doc_id")
    n = {r["shard"]: r["count"] for r in sharding.assign(ids, 5, weights=weights).groupBy("shard").count().collect()}
    assert 3 not in n
    for s, w in enumerate(weights):
        if w:
            assert abs(n[s] / 40_000 - w / 8) < 0.01


def test_a_changed_weight_moves_rows_on_its_path_only(spark):
    """A heavier shard draws rows into its region; in there, into its rack; in there, into itself. All others stay."""
    ids = spark.range(40_000).withColumnRenamed("id", "doc_id")
    old = sharding.assign(ids, 24).drop("grown_shard").toPandas().set_index("doc_id")
    new = sharding.assign(ids, 24, weights=[4.0 if s == 7 else 1.0 for s in range(24)]).toPandas().set_index("doc_id").loc[old.index]
    region, rack = sharding.place(7)
    moved = old.shard != new.shard
    assert moved.any()
    left = old.region != new.region
    assert (new.region[left] == region).all()
    inside = moved & ~left
    assert (old.region[inside] == region).all()
    racks = inside & (old["rack"] != new["rack"])
    assert (new["rack"][racks] == rack).all() and (new.shard[inside & ~racks] == 7).all()
    assert abs((new.shard == 7).mean() - 4 / 27) < 0.01


def test_the_tree_decides(spark):
    """Rows follow the places of shards: the same weights in another tree place them otherwise, with the same shares."""
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    a, b = (sharding.assign(ids, 24, regions=r, racks=k).select("doc_id", "shard").toPandas().set_index("doc_id").shard for r, k in ((3, 2), (2, 4)))
    assert 0.5 < (a != b.loc[a.index]).mean() < 1 and a.value_counts().min() > 700 and b.value_counts().min() > 700


def test_slots_of_many_equal_rows(docs, monkeypatch):
    from rasterloom.llm import ranks

    monkeypatch.setattr(ranks, "CHUNK", 7)
    got = sharding.digest(docs([(1, "same")] * 100 + [(i, "t") for i in range(2, 300)])).toPandas()
    assert len(got) == 398 and (got.doc_id == 1).sum() == 100
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_slots_over_several_buckets(spark):
    from rasterloom.llm.ranks import running_start

    rows = spark.range(5000).selectExpr("id", "id % 3 as shard", "id % 5 as n")
    got = running_start(rows, ["shard"], ["id"], "n", per_bucket=100).toPandas()
    for _, g in got.groupby("shard"):
        g = g.sort_values(["__start", "n"])
        assert (g["__start"] == g.n.cumsum() - g.n).all()


def test_sharding_hard_rows(docs, hard, clash, tmp_path, spark):
    got = sharding.digest(docs(hard, clash)).toPandas()
    assert len(got) == len(hard)
    assert got.loc[got.doc_id == 2, "size"].item() == 8 and got.loc[got.doc_id == 2, "text_crc32"].item() == 0
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert sharding.digest(docs([])).count() == 0
    sharding.write_shards(docs(hard), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(hard)


def brute_targets(sizes, share=1.5, cap=2.0, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        per = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if per * weight[s] > cap * sizes[s]]
        if not over:
            return target | {s: per * weight[s] for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def test_mix_targets_and_taken_words(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.toPandas().set_index("doc_id")
    got = mixing.taken(docs).toPandas().set_index("doc_id")
    size = rows.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)))
    assert (got["size"] == size.loc[got.index]).all()
    expected = brute_targets(size.groupby(rows.source).sum().to_dict())
    for s, g in got.groupby("source"):
        assert math.isclose(g.target.iloc[0], expected[s], rel_tol=1e-9)
        biggest = g["size"].max()
        assert abs(g.taken.sum() - g.target.iloc[0]) <= max(0.05 * g.target.iloc[0], biggest / 2)
    assert (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    again = mixing.taken(docs.repartition(7)).toPandas().set_index("doc_id")
    assert (again.taken.loc[got.index] == got.taken).all()


def test_pareto_rates_are_unequal(spark):
    """Inclusion follows the expected copies of the size class."""
    rows = [(i, "w " * (3 if i % 2 else 300), "a") for i in range(4000)] + [(10_000 + i, "w " * 20, "b") for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    p = mixing.plan(docs, share=0.6).where("source = 'a'").groupBy("size").agg(F.avg(F.col("whole") + F.col("more")).alias("rate"), F.first(F.col("whole") + F.col("p")).alias("e")).toPandas()
    assert (abs(p.rate - p.e) < 0.04).all() and p.e.nunique() == 2


def test_mixing_hard_rows(docs, hard, clash):
    table = docs(hard + [(8, "a b c d", "é"), (9, "a b", "z")], clash)
    got = mixing.taken(table).toPandas()
    assert len(got) == len(hard) + 2 and (got.loc[got["size"] == 0, "taken"] == 0).all() and (got.taken <= 2 * got["size"]).all()
    sizes = {None: 0} | {k: int(v) for k, v in got.groupby("source")["size"].sum().items()}
    expected = brute_targets(sizes)
    for x in got.itertuples():
        assert math.isclose(x.target, expected[None if pd.isna(x.source) else x.source], rel_tol=1e-9, abs_tol=1e-9)
    mixed = mixing.mix(table)
    assert mixed.columns == table.columns
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in mixed.select("text").collect())
    assert words == got.taken.sum()
    assert mixing.taken(docs([])).count() == 0 and mixing.mix(docs([])).count() == 0


def test_hot_repeated_row(docs):
    rows = [(1, "same text here", "a")] * 500 + [(i, f"other text {i}", "a") for i in range(2, 500)] + [(i, "x y z", "b") for i in range(1000, 3000)]
    got = mixing.taken(docs(rows)).toPandas()
    assert len(got) == len(rows)
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 3


def brute_taken(rows, share=1.5, cap=2.0, seed=1, rounds=4):
    """Words taken by key, from the definition: every rank sorted. rows: (source, doc_id, size, rows, u)."""
    sizes = {}
    for s, _, size, n, _ in rows:
        sizes[s] = sizes.get(s, 0) + size * n
    target = brute_targets(sizes, share, cap)
    out = {}
    for source in sizes:
        own = [dict(d=d, size=z, n=n, u=u, k=int(math.log2(z + 1)), more=0) for s, d, z, n, u in rows if s == source]
        words = {}
        for x in own:
            words[x["k"]] = words.get(x["k"], 0) + x["size"] * x["n"]
        words = {k: w for k, w in words.items() if w}
        lo, hi = 0.0, 1e9
        for _ in range(200):
            c = (lo + hi) / 2
            lo, hi = (c, hi) if sum(w * min(cap, c * (1 + k / 16)) for k, w in words.items()) < target[source] else (lo, c)
        for x in own:
            e = min(cap, hi * (1 + x["k"] / 16)) if x["size"] else 0.0
            e = round(e) if abs(e - round(e)) < 1e-9 else e
            x["whole"], p = math.floor(e), e - math.floor(e)
            odds = x["u"] / (1 - x["u"]) * (1 - p) / p if p > 0 else None
            x["rank"] = odds / (1 + odds) if p > 0 else None
        for r in range(rounds):
            left = target[source] - sum(x["size"] * (x["n"] * x["whole"] + x["more"]) for x in own)
            before = 0
            for x in sorted((x for x in own if x["rank"] is not None and not x["more"] and x["size"] and x["size"] * (1.0 if r < rounds - 1 else 0.5) <= left), key=lambda x: x["rank"]):
                room = (left - before) / x["size"]
                x["more"] = max(0, min(x["n"], math.floor(room) if r < rounds - 1 else round(room)))
                before += x["size"] * x["n"]
        for x in own:
            out[source, x["d"]] = x["size"] * (x["n"] * x["whole"] + x["more"])
    return out


def test_taken_is_brute_force(docs):
    """Which documents are taken, with repeated rows and a boundary bucket that is cut several times."""
    from rasterloom.llm.text import uniform

    rows = [(i, "w " * (1 + i * 7919 % 97), "ab"[i % 3 == 0]) for i in range(400)] + [(1000, "r " * 11, "a")] * 40 + [(2000 + i, "w " * (3 + i % 40), "c") for i in range(300)] + [(3000, "", "c")]
    table = docs(rows)
    of = table.select("source", "doc_id", uniform(F.col("doc_id"), F.xxhash64("text"), F.col("source"), F.lit(1)).alias("u"), F.size(F.split(F.trim("text"), " ")).alias("z"), "text").toPandas()
    keys = {}
    for x in of.itertuples():
        z = x.z if x.text.strip() else 0
        n = keys.get((x.source, x.doc_id), (0, 0, 0))[1]
        keys[x.source, x.doc_id] = (z, n + 1, x.u)
    expected = brute_taken([(s, d, z, n, u) for (s, d), (z, n, u) in keys.items()])
    for options in ({}, {"buckets": 4, "most": 3}):
        got = mixing.taken(table, **options).toPandas().groupby(["source", "doc_id"]).taken.sum().to_dict()
        assert got == expected
    mixed = mixing.mix(table).groupBy("source", "doc_id").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).toPandas()
    assert {(x.source, x.doc_id): x.n for x in mixed.itertuples()} == {k: v for k, v in expected.items() if v}


def test_rows_that_differ_elsewhere_are_each_mixed(docs, spark):
    """Rows with one source, id and text: each stays with its own columns, and some of them get one more copy."""
    table = docs([(1, "a b c d e", "a")] * 60 + [(2, "x y", "b")] * 500).withColumn("url", F.concat(F.lit("u"), (F.monotonically_increasing_id() % 7).cast("string")))
    table = spark.createDataFrame(table.collect(), table.schema)
    mixed = mixing.mix(table)
    got = mixed.groupBy("doc_id", "url").count().toPandas()
    there = table.groupBy("doc_id", "url").count().toPandas()
    both = got.merge(there, on=["doc_id", "url"], how="outer", suffixes=("", "_old")).fillna(0)
    taken = mixing.taken(table).toPandas()
    assert mixed.columns == table.columns
    assert both.groupby("doc_id")["count"].sum().loc[1] * 5 == taken.taken[taken.doc_id == 1].sum()
    whole = taken.groupby("doc_id").apply(lambda g: g.taken.min() // g["size"].iloc[0])
    assert all(w.count_old * whole[w.doc_id] <= w["count"] <= w.count_old * (whole[w.doc_id] + 1) for _, w in both.iterrows())
