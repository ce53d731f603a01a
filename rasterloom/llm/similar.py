"""Links of near-duplicates by exact similarity: Jaccard >= 0.8 between the sets of 5-word shingles, linked transitively.

Words are those of op1 (A-Z lower-cased, split at ASCII white space); a shingle counts as its XXH64 (seed 42), fewer words
than five are one shingle, and texts without words have an empty set and are alike. Texts are known by their xxhash64.

`links` takes pairs that another operator proposes (the trie self-join of fingerprints), checks them on the whole sets, and
adds what bits don't show by a prefix filter, which loses nothing: with any one order of all shingles, two sets of
similarity >= t share a shingle among the first n - ceil(t * n) + 1 of each. The order puts shingles last that are common
in a sample of the texts, which bounds the work and doesn't change the result. Texts that share such a shingle form a
group. A group's texts are compared with the one that has the fewest shingles of its own; groups that then lie in one
component are done, so a large group of near copies takes about one comparison a text. A text with `own` shingles that no
other has can't be similar to sets larger than (1 + t) / t * (n - own) - n, which spares most of the comparisons that
would fail. In groups with more than LARGE texts outside their largest component, up to TURNS times further texts are
compared with all. What is left are the texts outside a group's largest component; they meet the group's others in blocks
of BLOCK, in numpy, where a pair passes only if its bitmaps allow it: bit h mod 1024 of a text's bitmap is set if an odd
number of its shingles h have that remainder, so two bitmaps differ in no more bits than the sets in shingles. Only pairs
that pass are returned, and whole sets decide about them. No group is ever expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.components import connected_components
from rasterloom.plans.scale import Written, broadcast_if_small

#: One text in so many is counted to find common shingles, and those seen so often there are put last.
SAMPLE, OFTEN, MOST_COMMON = 16, 4, 200_000
#: Texts outside a group's largest component beyond which it is compared with one more of its texts first, so many times at most.
LARGE, TURNS = 20_000, 4
#: Texts of a block, pairs that are compared at once, and bits of a bitmap.
BLOCK, PAIRS, BITS = 512, 1 << 15, 1024


def hashes(text: str | None, words: int = 5) -> np.ndarray:
    """The shingle hashes of a text in order, repeats included."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    parts = map(b" ".join, zip(*(tokens[i:] for i in range(words)))) if len(tokens) >= words else [b" ".join(tokens)]
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The sorted different shingle hashes of a text."""
    return np.unique(hashes(text, words))


def bitmap(found: np.ndarray) -> bytes:
    """The parities of the numbers of different shingles with each remainder."""
    odd = np.bincount((found & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def needed(n: int, percent: int) -> int:
    return -(-n * percent // 100)


Common = tuple[np.ndarray, np.ndarray]


def prefix(found: np.ndarray, common: Common, percent: int) -> np.ndarray:
    """The first n - ceil(t * n) + 1 shingles: first those that aren't common, then by their count. An empty set has the one value 0."""
    if not len(found):
        return np.zeros(1, np.uint64)
    known, counts = common
    if len(known):
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        found = found[np.argsort(np.where(known[at] == found, counts[at], 0), kind="stable")]
    return found[: len(found) - needed(len(found), percent) + 1]


def common_shingles(texts: DataFrame, words: int) -> Common:
    """The most common shingles of a sample of the texts (t, text), sorted, and their counts; at most MOST_COMMON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(1):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py(), words).view(np.int64))], names=["s"])

    counted = texts.where(F.pmod("t", F.lit(SAMPLE)) == 0).mapInArrow(run, "s long").groupBy("s").count().where(F.col("count") >= OFTEN)
    got = counted.orderBy(F.desc("count"), "s").limit(MOST_COMMON).toArrow()
    known = got["s"].to_numpy().view(np.uint64)
    order = np.argsort(known)
    return known[order], got["count"].to_numpy()[order]


def possible(pairs: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the prefixes allow, from (t, n, shared), the prefix shingles that a text shares with others.

    The set whose prefix ends first in the order has all its common shingles of the prefix in the other's prefix too, so
    both have at most the prefixes' common ones and its rest, ceil(t * n) - 1, in common.
    """

    def rest(n: str) -> Column:
        return F.ceil(F.col(n) * percent / 100) - 1

    of = shared.select("t", "n", "shared")
    both = pairs.join(of.toDF("a", "na", "sa"), "a").join(of.toDF("b", "nb", "sb"), "b")
    most = F.size(F.array_intersect("sa", "sb")) + F.greatest(rest("na"), rest("nb"))
    alike = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return both.where(alike & (most * (100 + percent) >= percent * (F.col("na") + F.col("nb")))).select("a", "b")


def checked(pairs: DataFrame, shared: DataFrame, texts: DataFrame, words: int, percent: int) -> Written:
    """The pairs (a, b) whose sets are similar enough. Whole sets are made of the texts of possible pairs only."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows = [i for i, t in enumerate(batch.column(0).to_pylist()) if not (t in seen or seen.add(t))]  # copies once a task
            new = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([new.column(0), pa.array([shingles(x.as_py(), words).astype("<u8").tobytes() for x in new.column(1)], pa.binary())], names=["t", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = (np.frombuffer(v.as_py(), "<u8") for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    near = Written(possible(pairs, shared, percent), "similar-near")
    wanted = broadcast_if_small(near.df.select(F.explode(F.array("a", "b")).alias("t")).distinct(), 1_000_000)
    sets = Written(texts.join(wanted, "t", "left_semi").mapInArrow(whole, "t long, h binary").dropDuplicates(["t"]), "similar-sets")
    narrow = broadcast_if_small(near.df, 1_000_000)
    x, y = (sets.df.toDF(c, f"h{c}").join(narrow, c) for c in "ab")
    out = Written(x.join(y, ["a", "b"]).select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long"), "similar-checked")
    near.drop()
    sets.drop()
    return out


def blocks(alive: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components whose sizes, reaches and bitmaps allow them, of each text outside its group's largest
    component with all of the group, from (s, t, n, reach, component, bits, outside, n_outside, n_all); a pair may come repeatedly."""

    def cut(n: str) -> Column:
        return F.ceil(F.col(n) / BLOCK)

    def part(n: str, seed: int) -> Column:
        return F.pmod(F.xxhash64("t", F.lit(seed)), cut(n))

    plain = ["t", "n", "reach", "component", "outside", "bits"]
    first = alive.where("outside").select("s", part("n_outside", 1).alias("i"), F.explode(F.sequence(F.lit(0), cut("n_all") - 1)).alias("j"), F.lit(0).alias("side"), *plain)
    second = alive.select("s", F.explode(F.sequence(F.lit(0), cut("n_outside") - 1)).alias("i"), part("n_all", 2).alias("j"), F.lit(1).alias("side"), *plain)
    dealt = first.unionByName(second).withColumn("grp", F.xxhash64("s", "i", "j")).drop("s", "i", "j")

    def met(rows: pa.Table) -> pa.RecordBatch:
        grp, side, t, n, reach, component, outside = (rows[c].to_numpy() for c in ("grp", "side", "t", "n", "reach", "component", "outside"))
        bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint64).reshape(len(grp), BITS // 64)
        head = np.flatnonzero(np.concatenate([[True], np.diff(grp) != 0]))
        tail = np.append(head[1:], len(grp))
        turn = np.concatenate([[0], np.cumsum(side)])
        mid = tail - (turn[tail] - turn[head])
        # one row of side 0 with all of side 1 of its block
        xs = np.flatnonzero(side == 0)
        of = np.searchsorted(head, xs, side="right") - 1
        start, size = mid[of], (tail - mid)[of]
        ends = np.cumsum(size)
        out = []
        at = 0
        while at < len(xs):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            each = size[at:to]
            i = np.repeat(xs[at:to], each)
            j = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(start[at:to], each)
            ok = (component[i] != component[j]) & (n[i] <= reach[j]) & (n[j] <= reach[i]) & (~outside[j] | (t[i] < t[j]))
            i, j = i[ok], j[ok]
            both = n[i] + n[j]
            apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
            ok = (both - apart) * (100 + percent) >= 2 * percent * both
            out.append(np.column_stack([t[i[ok]], t[j[ok]]]))
            at = to
        pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= 20_000:  # whole blocks only; the last one may go on in the next batch
                rows = pa.Table.from_batches(held)
                grp = rows["grp"].to_numpy()
                whole = int(np.searchsorted(grp, grp[-1]))
                held, n = rows.slice(whole).to_batches(), len(grp) - whole
                if whole:
                    yield met(rows.slice(0, whole))
        if n:
            yield met(pa.Table.from_batches(held))

    return dealt.repartition("grp").sortWithinPartitions("grp", "side").mapInArrow(run, "a long, b long")


def links(texts: DataFrame, prefixes: DataFrame, proposed: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(node, component) over text hashes that are linked to others.

    texts: (t, text); prefixes: (t, n, prefix, bits), the set's size, the prefix shingles and the bitmap of every text; proposed:
    pairs (a, b) that may be similar.
    """
    each = prefixes.select("t", "n", F.explode("prefix").alias("s"))
    # shingles of several texts, by a combining aggregation, so that a very common one isn't gathered in one task
    several = Written(each.groupBy("s").agg(F.min("t").alias("x"), F.max("t").alias("y")).where("x <> y").select("s"), "similar-several")
    members = Written(each.join(broadcast_if_small(several.df, 1_000_000), "s", "left_semi").distinct(), "similar-members")
    gathered = members.df.groupBy("t", "n").agg(F.collect_list("s").alias("shared"))  # one text's prefix at most
    # own: prefix shingles that no other text has; reach: the largest set that can be similar, (1 + t) / t * (n - own) - n
    own = F.when(F.col("n") == 0, 1).otherwise(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1) - F.size("shared")
    reach = F.floor((F.col("n") - F.col("own")) * (100 + percent) / percent) - F.col("n")
    shared = Written(gathered.withColumn("own", own).withColumn("reach", reach), "similar-shared")
    several.drop()
    members.drop()
    rows = shared.df.select(F.explode("shared").alias("s"), "t", "n", "own", "reach")
    once = shared.df.select("t").join(prefixes.select("t", "bits"), "t").groupBy("t").agg(F.min("bits").alias("bits"))  # copies have equal ones

    def against(members: DataFrame, order: Column) -> DataFrame:
        """Each text with its group's first by the order."""
        pivots = members.groupBy("s").agg(F.min(F.struct(order.alias("o"), F.struct("t", "n", "reach").alias("p"))).getField("p").alias("p"))
        apart = members.join(pivots, "s").where((F.col("t") != F.col("p.t")) & (F.col("p.n") <= F.col("reach")) & (F.col("n") <= F.col("p.reach")))
        return apart.select(F.least("t", "p.t").alias("a"), F.greatest("t", "p.t").alias("b"))

    # the first is the one with the smallest share of shingles of its own, to which most near copies are close
    central = against(rows, F.col("own") / F.greatest(F.col("n"), F.lit(1)))
    linked = checked(proposed.unionByName(central).distinct(), shared.df, texts, words, percent)
    turn = 0
    while True:
        found = Written(connected_components(linked.df), "similar-found")
        tagged = rows.join(found.df.withColumnRenamed("node", "t"), "t", "left").withColumn("component", F.coalesce("component", "t"))
        # texts too far from all others of the group, by size, leave; so do groups inside one component
        limits = tagged.groupBy("s").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("n").alias("least"), F.max("reach").alias("most")).where("x <> y")
        near = Written(tagged.join(limits.drop("x", "y"), "s").where("reach >= least and n <= most").select(*tagged.columns), "similar-near-by-size")
        # texts outside a group's largest component: all that is left to compare is each of them with the others
        parts = near.df.groupBy("s", "component").agg(F.count("*").alias("k"))
        groups = parts.groupBy("s").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.sum("k").alias("n_all"), F.max("k").alias("most")).where("n_all > most")
        groups = groups.select("s", "main", (F.col("n_all") - F.col("most")).alias("n_outside"), "n_all")
        alive = Written(near.df.join(groups, "s").withColumn("outside", F.col("component") != F.col("main")).drop("main"), "similar-alive")
        near.drop()
        large = alive.df.where(F.col("n_outside") > LARGE)
        again = turn < TURNS and not large.isEmpty()
        if again:
            pairs = against(large, F.struct((~F.col("outside")).alias("m"), F.xxhash64("t", F.lit(turn)).alias("h")))
        else:
            pairs = blocks(alive.df.join(once, "t"), percent)
        more = checked(pairs.distinct(), shared.df, texts, words, percent)
        alive.drop()
        found.drop()
        both = Written(linked.df.unionByName(more.df), "similar-links")
        linked.drop()
        more.drop()
        linked = both
        turn += 1
        if not again:
            break
    out = connected_components(linked.df)
    linked.drop()
    shared.drop()
    return out
