"""SimHash near-duplicates by a binary trie self-join.

Fingerprints: whole texts, A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, every 3-word shingle counted as often as it
occurs; a bit is set if more than half of the shingles' XXH64 values (seed 42) have it.

The self-join walks pairs of nodes of a binary trie over the distinct fingerprints from the root down. A pair carries the
bits in which its two prefixes differ and is dropped as soon as they exceed the error budget of its depth. With budget e
and e + 1 blocks of bits, some rotation of the blocks has at most floor(e * i / (e + 1)) errors in its first i blocks
(cycle lemma), so the trie is walked once per rotation with that budget by depth. The first block then has no errors and
is the key by which the trie's top is dealt to tasks. Node pairs with too many fingerprints below them are opened further
in Spark, level by level, until each fits a task, so that one large group of near copies doesn't land in one task.

Exact copies share one leaf. Distinct fingerprints bound the work in a dense group: a fingerprint has at most 43,744
others within 3 bits. Tasks return a spanning forest of their links, and components come from contraction.

Defined results: a null text counts as empty; texts without words have fingerprint zero and link like others; fewer than
three words are one shingle; null ids are kept, a component's id is its smallest id that isn't null (null if there is
none); repeated rows are kept; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import similar
from rasterloom.operators.components import connected_components
from rasterloom.plans.scale import Written, written

BITS = 64
#: Hashes of a text that are counted at once.
PIECE = 1 << 16


def majority(pieces: Iterable[np.ndarray]) -> int:
    """The bits that are set in more than half of the hashes; the pieces end with the first empty one."""
    total, n = np.zeros(BITS, np.int64), 0
    for piece in pieces:
        if not len(piece):
            break
        n += len(piece)
        total += np.unpackbits(piece.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)))) if len(tokens) >= words else [b" ".join(tokens)]
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(42))
    return majority(np.fromiter(islice(hashes, PIECE), np.uint64) for _ in repeat(0))  # in pieces, for very long texts


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, fp long")


def rotate(x: np.ndarray, by: int) -> np.ndarray:
    """uint64 values rotated to the left."""
    return x if by == 0 else (x << np.uint64(by)) | (x >> np.uint64(BITS - by))


def budgets(errors: int) -> np.ndarray:
    """Most differing bits in the first d bits of a rotation, for d = 0..64."""
    width = BITS // (errors + 1)
    return np.array([min(errors, errors * -(-d // width) // (errors + 1)) for d in range(BITS + 1)], np.int64)


def trie_pairs(keys: np.ndarray, pairs: np.ndarray, depth: int, budget: np.ndarray, leaf: int = 6) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of keys that differ in at most budget[64] bits.

    pairs: rows (lo1, hi1, lo2, hi2, differing bits so far); each range of keys is sorted and shares its first `depth`
    bits, and a range paired with itself stands for its self-join. Pairs are walked in blocks, depth first over blocks,
    so that the pairs held at once stay bounded.
    """
    stack = [(depth, pairs)]
    block = 1 << 15
    while stack:
        d, now = stack.pop()
        if len(now) > block:
            stack += [(d, now[i : i + block]) for i in range(0, len(now), block)]
            continue
        size1, size2 = now[:, 1] - now[:, 0], now[:, 3] - now[:, 2]
        small = (size1 * size2 <= leaf * leaf) | (d == BITS)
        done = now[small]
        if len(done):  # verify every pair of leaves below
            n1, n2 = done[:, 1] - done[:, 0], done[:, 3] - done[:, 2]
            each = n1 * n2
            of = np.repeat(np.arange(len(done)), each)
            k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            i, j = done[of, 0] + k // n2[of], done[of, 2] + k % n2[of]
            ok = ((done[of, 0] != done[of, 2]) | (i < j)) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget[BITS])
            if ok.any():
                yield i[ok], j[ok]
        now = now[~small]
        if not len(now):
            continue
        # the split of each range by bit d
        bit = np.uint64(1 << (BITS - 1 - d))
        low = np.uint64((1 << (BITS - 1 - d)) - 1)

        def split(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            first = (keys[lo] & ~(low | bit)) | bit
            a, b = lo.copy(), hi.copy()
            while True:  # one binary search for all ranges
                open_ = a < b
                if not open_.any():
                    return a
                m = (a + b) // 2
                less = open_ & (keys[np.minimum(m, len(keys) - 1)] < first)
                a, b = np.where(less, m + 1, a), np.where(open_ & ~less, m, b)

        m1, m2 = split(now[:, 0], now[:, 1]), split(now[:, 2], now[:, 3])
        same = now[:, 0] == now[:, 2]
        lo1, hi1, lo2, hi2, acc = now.T
        children = [
            np.column_stack([lo1, m1, lo2, m2, acc]),
            np.column_stack([m1, hi1, m2, hi2, acc]),
            np.column_stack([lo1, m1, m2, hi2, acc + 1]),
            np.column_stack([m1, hi1, lo2, m2, acc + 1])[~same],
        ]
        nxt = np.concatenate(children)
        nxt = nxt[(nxt[:, 0] < nxt[:, 1]) & (nxt[:, 2] < nxt[:, 3]) & (nxt[:, 4] <= budget[d + 1])]
        if len(nxt):
            stack.append((d + 1, nxt))


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index of each index's component."""
    label = np.arange(n)
    for i, j in links:
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label


def node_links(distinct: DataFrame, errors: int = 3, step: int = 8, cap: int = 4096) -> DataFrame:
    """(a, b): a spanning forest, per task, of the links between distinct fingerprints (column fp, signed long)."""
    width = BITS // (errors + 1)
    budget = budgets(errors)

    def turned(by: int):
        return F.col("fp") if by == 0 else F.shiftleft("fp", by).bitwiseOR(F.shiftrightunsigned("fp", BITS - by))

    rows = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(r).alias("rot"), turned(r * width).alias("key")) for r in range(errors + 1)])).alias("x"))
    rows = rows.select("x.rot", "x.key", F.shiftrightunsigned("x.key", BITS - width).alias("u"))
    # a node pair: rotation, prefixes u <= v of `depth` bits; side 0 rows are below u, side 1 rows below v
    rows = rows.select("rot", "u", F.col("u").alias("v"), F.lit(0).alias("acc"), F.lit(0).alias("side"), "key")
    parts: list[DataFrame] = []
    depth = width
    drop: list[Written] = []
    while True:
        pair = ["rot", "u", "v"]
        if depth >= BITS:
            parts.append(rows.withColumn("depth", F.lit(depth)))
            break
        sizes = rows.groupBy(*pair).agg(F.count(F.when(F.col("side") == 0, 1)).alias("n0"), F.count(F.when(F.col("side") == 1, 1)).alias("n1"))
        live = sizes.where(((F.col("u") == F.col("v")) & (F.col("n0") > 1)) | ((F.col("n0") > 0) & (F.col("n1") > 0)))
        live = Written(live.select(*pair, F.when(F.col("n0") + F.col("n1") > cap, True).alias("big")).where("big" if depth == width else "true"), "trie-live")
        drop.append(live)
        if live.df.where("big").isEmpty():
            # copies made for a partner that isn't there are left out
            parts.append((rows if depth == width else rows.join(live.df.drop("big"), pair, "left_semi")).withColumn("depth", F.lit(depth)))
            break
        flagged = rows.join(live.df, pair, "left" if depth == width else "inner")
        parts.append(flagged.where("big is null").drop("big").withColumn("depth", F.lit(depth)))
        wide = min(step, BITS - depth)
        most = int(budget[depth + wide])
        masks = [m for m in range(1 << wide) if bin(m).count("1") <= most]
        opened = Written(flagged.where("big").drop("big"), "trie-open")
        drop.append(opened)
        sub = F.shiftrightunsigned("key", BITS - depth - wide)
        child = opened.df.withColumn("w", sub).withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])))
        # the partner node's prefix: the other side's prefix with the next bits changed by the mask
        other = F.when(F.col("side") == 0, F.col("v")).otherwise(F.col("u"))
        partner = F.shiftleft(other, wide).bitwiseOR(F.col("w").bitwiseAND(F.lit((1 << wide) - 1)).bitwiseXOR(F.col("mask")))
        child = child.withColumn("p", partner).withColumn("acc", F.col("acc") + F.bit_count("mask")).where(F.col("acc") <= most)
        own = F.col("u") == F.col("v")
        rows = child.select(
            "rot",
            F.when(own, F.least("w", "p")).otherwise(F.when(F.col("side") == 0, F.col("w")).otherwise(F.col("p"))).alias("u2"),
            F.when(own, F.greatest("w", "p")).otherwise(F.when(F.col("side") == 0, F.col("p")).otherwise(F.col("w"))).alias("v2"),
            "acc",
            F.when(own, (F.col("w") > F.col("p")).cast("int")).otherwise(F.col("side")).alias("side"),
            "key",
        ).withColumnsRenamed({"u2": "u", "v2": "v"})
        depth += wide
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.withColumn("grp", F.xxhash64("rot", "u", "v", "depth"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def links(t: pd.DataFrame) -> pd.DataFrame:
            keys = t["key"].to_numpy().view(np.uint64)
            head = np.flatnonzero(np.concatenate([[True], (np.diff(t["grp"].to_numpy()) != 0) | (np.diff(t["depth"].to_numpy()) != 0)]))
            tail = np.concatenate([head[1:], [len(t)]])
            side = t["side"].to_numpy()
            turn = np.concatenate([[0], np.cumsum(side)])
            mid = tail - (turn[tail] - turn[head])
            own = (t["u"].to_numpy() == t["v"].to_numpy())[head]
            roots = np.column_stack([head, np.where(own, tail, mid), np.where(own, head, mid), tail, t["acc"].to_numpy()[head]])
            roots = roots[(roots[:, 0] < roots[:, 1]) & (roots[:, 2] < roots[:, 3])]
            roots = roots[(roots[:, 1] - roots[:, 0] > 1) | (roots[:, 0] != roots[:, 2])]
            of = t["depth"].to_numpy()
            label = forest(len(t), ((i, j) for d in np.unique(of[roots[:, 0]]) for i, j in trie_pairs(keys, roots[of[roots[:, 0]] == d].astype(np.int64), int(d), budget)))
            hit = np.flatnonzero(label != np.arange(len(t)))
            rot = t["rot"].to_numpy()
            fp = np.empty(len(t), np.uint64)
            for r in np.unique(rot):
                fp[rot == r] = rotate(keys[rot == r], int((BITS - r * width) % BITS))
            return pd.DataFrame({"a": fp[hit].view(np.int64), "b": fp[label[hit]].view(np.int64)})

        held: list[pd.DataFrame] = []
        n = 0
        for t in batches:
            held.append(t)
            n += len(t)
            if n >= 200_000:  # whole groups only; the last one may go on in the next batch
                t = pd.concat(held, ignore_index=True)
                whole = int(np.flatnonzero(t["grp"].to_numpy() != t["grp"].iat[-1])[-1]) + 1 if t["grp"].iat[0] != t["grp"].iat[-1] else 0
                held, n = [t.iloc[whole:]], len(t) - whole
                if whole:
                    yield links(t.iloc[:whole].reset_index(drop=True))
        if n:
            yield links(pd.concat(held, ignore_index=True))

    # node pairs whole in a partition; within a pair, side 0 first and keys in unsigned order
    dealt = rows.repartition("grp").sortWithinPartitions("grp", "depth", "side", F.col("key").bitwiseXOR(F.lit(-(1 << 63))))
    out = written(dealt.mapInPandas(run, "a long, b long"), "trie-links")
    for table in drop:
        table.drop()
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", errors: int = 3, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, links_to): component_id is the smallest doc_id reachable over fingerprints at `errors` or fewer
    differing bits; links_to is the component's smallest fingerprint (signed), which is never null."""
    fps = Written(fingerprints(docs, id_col, text_col, words), "simhash").df
    distinct = Written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct").df
    found = connected_components(node_links(distinct.select("fp"), errors))
    named = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("links_to"))
    named = Written(named, "simhash-named").df
    least = named.groupBy("links_to").agg(F.min("first_id").alias("component_id"))
    members = Written(named.join(least, "links_to").select("fp", "links_to", "component_id"), "simhash-members").df
    return fps.join(members, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "links_to"
    )


def row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A struct that orders rows by (id, text hash, hash of all columns), null ids last."""
    plain = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    return F.struct(F.col(id_col).isNull().alias("i"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("t"), F.xxhash64(*plain).alias("row"))


def digests(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(t, fp, n, prefix, bits) of rows (t, text), one scan: the fingerprint, the set's size, the shingles that the prefix filter looks at, and the bitmap."""
    common = texts.sparkSession.sparkContext.broadcast(similar.common_shingles(texts, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes, parts, bits = [], [], [], []
            for x in batch.column(1):
                found = similar.hashes(x.as_py(), words)
                fps.append(majority(found[i : i + PIECE] for i in range(0, len(found), PIECE)))
                different = np.unique(found)
                sizes.append(len(different))
                parts.append(similar.prefix(different, common.value, percent).view(np.int64))
                bits.append(similar.bitmap(different))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(parts, pa.list_(pa.int64())), pa.array(bits, pa.binary())], names=["t", "fp", "n", "prefix", "bits"])

    return texts.mapInArrow(run, "t long, fp long, n long, prefix array<long>, bits binary")


def similar_texts(texts: DataFrame, errors: int = 3, words: int = 5, percent: int = 80) -> DataFrame:
    """(node, component) over the hashes t of rows (t, text): texts linked at Jaccard >= percent of their sets of shingles.

    The trie self-join links fingerprints at `errors` or fewer differing bits; every such link is checked on the whole sets.
    Sets of similarity 0.8 differ in about 10 of 64 bits, which no such budget covers, so `similar.links` adds the others.
    """
    found = Written(digests(texts, words, percent), "simhash-digests")
    first = Written(found.df.groupBy("fp").agg(F.min("t").alias("first")), "simhash-first")
    same = found.df.select("fp", "t").join(first.df, "fp").where("t <> first").select(F.col("first").alias("a"), F.col("t").alias("b")).distinct()
    near = node_links(first.df.select("fp"), errors).join(first.df.toDF("a", "x"), "a").join(first.df.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    proposed = Written(same.unionByName(near), "simhash-proposed")
    out = similar.links(texts, found.df.select("t", "n", "prefix", "bits"), proposed.df, words, percent)
    for table in (found, first, proposed):
        table.drop()
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", errors: int = 3, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stand for their group of `similar_texts`: the first by (id, text hash, hash of all columns), null ids
    last. Rows that are equal in all columns are one. A null text is an empty one. All columns are kept."""
    key = row_key(docs, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = similar_texts(docs.select(F.xxhash64(text).alias("t"), text.alias("text")), errors, words, percent)
    counted = docs.select(key.alias("k")).groupBy(F.col("k.t").alias("node")).agg(F.min("k").alias("k"))
    first = counted.join(found, "node", "left").groupBy(F.coalesce("component", "node").alias("g")).agg(F.min("k").alias("k"))
    chosen = Written(first.select(F.col("k").alias("__key")), "simhash-chosen")
    keyed = docs.withColumn("__key", key)
    kept = keyed.join(chosen.df, "__key", "left_semi")
    times = docs.select(key.alias("__key")).join(chosen.df, "__key", "left_semi").groupBy("__key").count().where("count > 1")
    if not times.isEmpty():  # rows that are equal in all columns
        twice = Written(times.select("__key"), "simhash-twice").df
        kept = kept.join(twice, "__key", "left_anti").unionByName(keyed.join(twice, "__key", "left_semi").dropDuplicates(["__key"]))
    return kept.drop("__key")
