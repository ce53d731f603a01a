"""Exact top-k search in Hamming space by incremental multi-index hashing.

Vectors become binary codes by the signs of all their values, in words of 64 bits. Codes are cut into segments, and every distinct code stands in
one bucket per segment. A query probes the buckets at radius 0, 1, 2, ... of each of its segments. After radius r in all m
segments, every code within m * (r + 1) - 1 bits has been met (pigeonhole), so a query is done once k verified codes lie
within that distance; others go on to the next radius. A code is verified in the first segment, at the first radius, that
meets it, and counted there only, so nothing has to be deduplicated.

Equal codes are searched once. A code keeps its k + 1 smallest ids, which is all that the order by (distance, id) can use;
Spark limits groups before the shuffle, so a code that a third of all rows share sends k + 1 rows per task. Queries that
share a code are searched once too.

Queries: rows whose id is divisible by `every`, against all rows but themselves. Exact: recall against brute force over the
codes is 1. Ties are broken by the smaller id. Defined results: rows with a null id or vector are left out, null and NaN
values count as not positive, and so do values that a vector lacks beside the longest one; repeated rows with the same id and code are one; fewer than k other rows give fewer results; an empty table
gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.plans.scale import Written, broadcast_if_small, written

BITS = 64


def sign_code(vector: Column, words: int = 1) -> Column:
    """Longs whose bit i is set if value i of the word's 64 is positive."""

    def word(n: int) -> Column:
        total = F.lit(0).cast("long")
        for i in range(BITS):
            x = F.get(vector, F.lit(n * BITS + i))
            total = total.bitwiseOR(F.when((x > 0) & ~F.isnan(x), F.lit(-(1 << 63) if i == 63 else 1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
        return total

    return F.array(*[word(n) for n in range(words)])


def segments_for(n_codes: int) -> int:
    """Segments a word of about log2(n) bits, at least 3, so that a bucket holds a few codes at any size; fewer bits below 2^16 codes."""
    return max(3, min(8, math.ceil(BITS / max(8, math.log2(max(2, n_codes)) - 2))))


def cuts(m: int, words: int = 1) -> list[tuple[int, int, int]]:
    """(word, first bit, width) of each segment, m a word."""
    width = [BITS // m + (i < BITS % m) for i in range(m)]
    return [(n, sum(width[:i]), w) for n in range(words) for i, w in enumerate(width)]


def segment(code: Column, word: int, start: int, width: int) -> Column:
    return F.shiftrightunsigned(F.get(code, F.lit(word)), start).bitwiseAND(F.lit((1 << width) - 1))


def masks(width: int, radius: int) -> Column:
    """All values of `width` bits with `radius` bits set, as an array that Spark folds to a literal."""
    if math.comb(width, radius) > 50_000:
        return F.filter(F.sequence(F.lit(0).cast("long"), F.lit((1 << width) - 1).cast("long")), lambda x: F.bit_count(x) == radius)
    values = [0]
    for _ in range(radius):
        values = [v | (1 << b) for v in values for b in range(v.bit_length(), width)]
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def probed(j: int, part: tuple[int, int, int], radius: int) -> Column:
    """The buckets (j, v) of segment j at `radius` bits from the query q."""
    own, width = segment(F.col("q"), *part), part[2]
    return F.transform(masks(width, radius), lambda x: F.struct(F.lit(j).alias("j"), x.bitwiseXOR(own).alias("v")))


def search(queries: DataFrame, rows: DataFrame, k: int = 10, m: int | None = None, words: int = 1) -> DataFrame:
    """(query_id, rank, neighbor_id, distance). queries, rows: (id, code), codes as arrays of `words` longs; a query's own id
    isn't its neighbour. m: segments a word."""
    one = rows.where("id is not null and code is not null").select("id", "code").distinct()
    ranked = one.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k + 1)
    members = Written(ranked.drop("n"), "mih-members").df
    codes = Written(members.groupBy("code").agg(F.min("id").alias("least"), F.count("*").alias("ids")), "mih-codes").df
    asked = Written(queries.where("id is not null and code is not null").select("id", "code").distinct(), "mih-queries").df
    m = m or segments_for(codes.count())
    parts = cuts(m, words)
    m = len(parts)
    seg = lambda c: F.array(*[F.struct(F.lit(j).alias("j"), segment(F.col(c), *parts[j]).alias("v")) for j in range(m)])
    index = codes.withColumn("s", F.explode(seg("code"))).select("code", "least", "ids", "s.j", "s.v")
    index = written(index, "mih-index")
    active = written(asked.select(F.col("code").alias("q")).distinct().withColumn("bound", F.lit(words * BITS)), "mih-active")
    found: DataFrame | None = None
    best = Window.partitionBy("q").orderBy("distance", "least")
    for radius in range(max(w for *_, w in parts) + 1):
        probe = [probed(j, p, radius) for j, p in enumerate(parts) if radius <= p[2]]
        probes = active.withColumn("p", F.explode(F.concat(*probe))).select("q", "bound", "p.j", "p.v")
        bits = [F.bit_count(segment(F.col("q"), *p).bitwiseXOR(segment(F.col("code"), *p))) for p in parts]
        distance = sum((F.bit_count(F.get("q", F.lit(n)).bitwiseXOR(F.get("code", F.lit(n)))) for n in range(1, words)), F.bit_count(F.get("q", F.lit(0)).bitwiseXOR(F.get("code", F.lit(0)))))
        # in the first segment with the fewest differing bits, which is the first that meets the code
        first = F.lit(True)
        for i in range(m):
            first = first & F.when(F.lit(i) < F.col("j"), bits[i] > radius).otherwise(bits[i] >= radius)
        # sorted join: Spark's estimate doesn't see what explode adds to the probes, and would broadcast them
        met = probes.hint("merge").join(index, ["j", "v"]).withColumn("distance", distance).where(first & (F.col("distance") <= F.col("bound")))
        met = met.select("q", "code", "distance", "least", "ids")
        every = met if found is None else met.unionByName(found)
        found = written(every.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n"), "mih-found")
        covered = m * (radius + 1) - 1
        # the bound: the distance of the k-th row so far, itself left out, which later rows can't be beyond
        order = best.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = found.withColumn("upto", F.sum("ids").over(order)).where(F.col("upto") >= k + 1).groupBy("q").agg(F.min("distance").alias("kth"))
        following = active.join(broadcast_if_small(sums), "q", "left").where(F.col("kth").isNull() | (F.col("kth") > covered))
        active = written(following.select("q", F.coalesce("kth", "bound").alias("bound")), "mih-active")
        if covered >= words * BITS or active.isEmpty():
            break
    # from codes back to ids
    near = found.join(members.withColumnRenamed("id", "neighbor_id"), "code").select("q", "distance", "neighbor_id")
    w = Window.partitionBy("q").orderBy("distance", "neighbor_id")
    near = near.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1).drop("n")
    out = asked.withColumnsRenamed({"id": "query_id", "code": "q"}).join(near, "q").where("query_id <> neighbor_id")
    own = Window.partitionBy("query_id", "q").orderBy("distance", "neighbor_id")
    out = out.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "neighbor_id", F.col("distance").cast("int").alias("distance"))


def coded(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", words: int = 1) -> DataFrame:
    return vectors.select(F.col(id_col).alias("id"), F.when(F.col(vector_col).isNotNull(), sign_code(F.col(vector_col), words)).alias("code"))


def self_search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 10) -> DataFrame:
    longest = vectors.agg(F.max(F.size(vector_col))).first()[0] or 1
    words = max(1, -(-longest // BITS))
    rows = Written(coded(vectors, id_col, vector_col, words), "mih-rows").df
    return search(rows.where(F.pmod("id", F.lit(every)) == 0), rows, k, words=words)


def sql(every: int = 50, k: int = 10) -> str:
    """The query op8 in DuckDB's SQL, by brute force."""
    code = " || ".join(f"case when embedding[{i + 1}] > 0 then '1' else '0' end" for i in range(BITS))
    return f"""
with coded as (select vec_id as id, cast(({code}) as bit) as code from embeddings),
pairs as (
  select q.id as query_id, r.id as neighbor_id, cast(bit_count(xor(q.code, r.code)) as integer) as distance
  from coded q join coded r on q.id <> r.id where q.id % {every} = 0),
ranked as (select *, cast(row_number() over (partition by query_id order by distance, neighbor_id) as integer) as rank from pairs)
select query_id, rank, neighbor_id, distance from ranked where rank <= {k}
"""
