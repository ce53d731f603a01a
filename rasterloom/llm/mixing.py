"""Mixing sources to target word counts by Pareto order sampling, native throughout.

Targets: sources, in code point order with null last, weigh 5, 2, 1, repeating, and share `share` times all words; no
target exceeds `cap` times its source's words, and what is cut goes to the others by weight. That is target =
min(cap * size, level * weight) with one level for all, found in closed form from running sums over the sources.

Expected copies of a document are min(cap, c * measure), c chosen per source so that expected words equal the target;
the measure depends on the size class (powers of two), at most 64 per source, so c has a closed form too. Whole copies
are certain. The rest is an unequal-probability sample: documents are ranked by u / (1 - u) over p / (1 - p), u random
from a hash, p the remaining share of a copy, and taken in that order until the target's words are reached. A document
that no longer fits is passed over, and the next rounds go on with those that do; the last round takes the document at
the boundary if that comes nearer.

Ranks are never sorted whole: words are summed per rank bucket, running sums find the bucket in which the target falls,
that bucket is cut into finer ones until few enough rows are left, and only those are ordered. Rows that agree in source,
doc_id and text are one key with a count, so a hot group of them is one row; in `mix` each of them is copied as often as
its key is taken, and where one more copy goes to some of them only, to the first by a hash of all columns.

Defined results: null texts have size 0; documents of size 0 are taken 0 times; a null source is a source; repeated rows
are rows; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.ranks import repeated, running_start
from rasterloom.llm.text import n_words, uniform
from rasterloom.plans.scale import Written, broadcast_if_small, written


def water_level(table: DataFrame, by: list[str], total: Column, limit: Column, rate: Column) -> DataFrame:
    """table with `level`: x such that the sum of min(limit, x * rate) is total, over all rows that share `by`.

    The sum is the least of the linear functions that count the first j rows, by limit / rate, at their limit; so x is
    the greatest of their solutions. Rows with rate 0 must have limit 0. The level is null if all rows are at their limit.
    """
    t = table.withColumns({"__t": total, "__l": limit, "__r": rate})
    group = Window.partitionBy(*by)
    order = group.orderBy(F.when(F.col("__r") > 0, F.col("__l") / F.col("__r")).otherwise(F.lit(0.0))).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({"__p": F.coalesce(F.sum("__l").over(order), F.lit(0.0)), "__q": F.coalesce(F.sum("__r").over(order), F.lit(0.0)), "__all": F.sum("__r").over(group)})
    rest = F.col("__all") - F.col("__q")
    t = t.withColumn("level", F.max(F.when(rest > 0, (F.col("__t") - F.col("__p")) / rest)).over(group))
    return t.drop("__t", "__l", "__r", "__p", "__q", "__all")


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """(source, source_size) -> with weight and target. One row per source, in one task."""
    one = Window.partitionBy(F.lit(0))
    ordered = sizes.withColumn("n", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())))
    ordered = ordered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1).cast("int")))
    ordered = ordered.withColumns({"one": F.lit(0), "all": F.sum("source_size").over(one).cast("double")})
    limit = F.col("source_size") * F.lit(cap)
    levelled = water_level(ordered, ["one"], F.col("all") * F.lit(share), limit, F.col("weight"))
    return levelled.select("source", "source_size", "weight", F.least(limit, F.col("level") * F.col("weight")).alias("target"))


def measure(size_class: Column) -> Column:
    """The relative number of copies by size class: long documents somewhat more often."""
    return F.lit(1.0) + size_class / F.lit(16.0)


def boundary(joined: DataFrame, buckets: int, most: int) -> DataFrame:
    """joined (source, rank, size, rows, left, open) with `start`, words of earlier ranks, and `whole_bucket`: true where the row's
    bucket lies below the source's `left`, false in the bucket in which it falls, null beyond and where a row isn't open.

    That bucket is cut into `buckets` finer ones until no source has more than `most` rows in it.
    """
    marked = written(joined.withColumns({"start": F.lit(0).cast("long"), "whole_bucket": F.when(F.col("open"), F.lit(False))}), "mix-open")
    scale = buckets
    while True:
        falls = F.col("whole_bucket").isNotNull() & ~F.col("whole_bucket")
        bucket = F.least(F.floor(F.col("rank") * scale), F.lit(scale - 1))
        sums = marked.where(falls).groupBy("source", bucket.alias("bucket"), "left", "start").agg(F.sum(F.col("size") * F.col("rows")).alias("words"), F.count("*").alias("n"))
        w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("upto", F.col("start") + F.sum("words").over(w)).withColumn("from", F.col("upto") - F.col("words"))
        meets = sums.where(F.col("from") <= F.col("left")).select(F.col("source").alias("s"), F.col("bucket").alias("k"), "from", (F.col("upto") <= F.col("left")).alias("below"), "n")
        meets = written(meets, "mix-meets")
        marked = marked.join(broadcast_if_small(meets.drop("n")), falls & F.col("source").eqNullSafe(F.col("s")) & (bucket == F.col("k")), "left")
        marked = marked.withColumns({"start": F.coalesce("from", "start"), "whole_bucket": F.when(falls, F.col("below")).otherwise(F.col("whole_bucket"))}).drop("s", "k", "from", "below")
        largest = meets.where("not below").agg(F.max("n")).first()[0]
        if largest is None or largest <= most or scale >= 1 << 50:
            return marked
        marked = written(marked, "mix-open")
        scale *= buckets


def plan(docs: DataFrame, share: float = 1.5, cap: float = 2.0, seed: int = 1, rounds: int = 4, buckets: int = 1024, most: int = 1 << 16) -> DataFrame:
    """One row per different (source, doc_id, text): size, rows (how many such rows), source_size, target, whole (certain
    copies of each), more (how many of the rows get one more copy). Column __h is the text's hash."""
    sized = docs.select("source", "doc_id", F.xxhash64("text").alias("__h"), n_words(F.col("text")).alias("size"))
    keys = sized.groupBy("source", "doc_id", "__h", "size").agg(F.count("*").alias("rows"))
    keys = written(keys.withColumn("class", F.floor(F.log2(F.col("size") + 1)).cast("int")), "mix-keys")
    classes = written(keys.groupBy("source", "class").agg(F.sum(F.col("size") * F.col("rows")).alias("words")), "mix-classes")
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), share, cap)
    per_class = classes.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.col("words") * measure(F.col("class"))
    levelled = water_level(per_class, ["source"], F.col("target"), F.col("words") * F.lit(cap), rate)
    each = F.least(F.lit(cap), F.coalesce(F.col("level"), F.lit(0.0)) * measure(F.col("class")))
    each = F.when(F.abs(each - F.round(each)) < 1e-9, F.round(each)).otherwise(each)
    each = F.when(F.col("words") > 0, each).otherwise(F.lit(0.0))
    copies = written(levelled.select("source", "class", "words", "source_size", "target", F.floor(each).alias("whole"), (each - F.floor(each)).alias("p")), "mix-copies")
    renamed = copies.select(F.col("source").alias("s"), F.col("class").alias("k"), "source_size", "target", "whole", "p")
    odds = F.col("u") / (1 - F.col("u")) * (1 - F.col("p")) / F.col("p")
    ranked = (
        keys.join(broadcast_if_small(renamed), F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("k"))).drop("s", "k")
        .withColumn("u", uniform(F.col("doc_id"), F.col("__h"), F.col("source"), F.lit(seed)))
        .withColumn("rank", F.when(F.col("p") > 0, odds / (1 + odds)))
        .withColumn("more", F.lit(0).cast("long"))
    )
    state = Written(ranked.drop("u", "class"), "mix-state")
    budget = copies.groupBy("source").agg((F.first("target") - F.sum(F.col("words") * F.col("whole"))).alias("left"))
    for n in range(rounds):
        now = state.df
        left = written(budget, "mix-left").withColumnRenamed("source", "s")
        # documents not yet taken that fit by themselves; in the last round also those that nearly do
        fits = F.col("size") * F.lit(1.0 if n < rounds - 1 else 0.5) <= F.col("left")
        joined = now.join(broadcast_if_small(left), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        joined = joined.withColumn("open", F.col("rank").isNotNull() & (F.col("more") == 0) & (F.col("size") > 0) & fits)
        marked = boundary(joined, buckets, most)
        # only the bucket in which the target falls is put in order
        last = F.col("whole_bucket").isNotNull() & ~F.col("whole_bucket")
        inside = marked.where(last)
        order = Window.partitionBy("source").orderBy("rank", "doc_id", "__h", "size").rowsBetween(Window.unboundedPreceding, -1)
        before = F.col("start") + F.coalesce(F.sum(F.col("size") * F.col("rows")).over(order), F.lit(0))
        room = (F.col("left") - before) / F.col("size")
        count = F.floor(room) if n < rounds - 1 else F.round(room)
        inside = inside.withColumn("more", F.greatest(F.lit(0), F.least(F.col("rows"), count)).cast("long"))
        outside = marked.where(~last).withColumn("more", F.when(F.col("whole_bucket"), F.col("rows")).otherwise(F.col("more")))
        following = Written(inside.unionByName(outside).select(*now.columns), "mix-state")
        state.drop()
        state = following
        budget = state.df.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * (F.col("rows") * F.col("whole") + F.col("more")))).alias("left"))
    return state.df


def taken(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source): one row per row of docs; taken is the words that the mix takes of it."""
    rows = repeated(plan(docs, **options), "rows", "i")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + (F.col("i") <= F.col("more")).cast("long"))).alias("taken"), "source")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows: each row of docs as often as the mix takes it; a row that is taken once keeps its place among others."""
    p = plan(docs, **options)
    key = F.struct(F.col("source").alias("s"), F.col("doc_id").alias("d"), F.col("__h").alias("h")).alias("__key")
    copies = written(p.select(key, (F.col("whole") + (F.col("more") == F.col("rows")).cast("long")).alias("__copies")).where("__copies > 0"), "mix-copies")
    keyed = docs.withColumn("__key", F.struct(F.col("source").alias("s"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("h")))
    out = keyed.join(copies, "__key").withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(docs.columns)
    # keys of which some rows get one more copy and others don't: one per source and round at most
    partial = written(p.where("more > 0 and more < rows").select(key, "more"), "mix-partial")
    if partial.isEmpty():
        return out
    columns = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    equal = keyed.withColumn("__row", F.xxhash64(*columns)).join(broadcast_if_small(partial), "__key")
    equal = written(equal.groupBy("__key", "more", "__row").agg(F.count("*").alias("__rows"), F.first(F.struct(*docs.columns)).alias("__one")), "mix-equal")
    started = running_start(equal.drop("__one"), ["__key"], ["__row"], "__rows")
    extra = F.greatest(F.lit(0).cast("long"), F.least(F.col("__rows"), F.col("more") - F.col("__start"))).alias("__extra")
    chosen = written(started.select("__key", "__row", extra).where("__extra > 0").join(equal.select("__key", "__row", "__one"), ["__key", "__row"]), "mix-extra")
    return out.unionByName(repeated(chosen, "__extra", "__i").select("__one.*"))
