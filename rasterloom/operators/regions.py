"""Statistics of regions, and what region merging computes from them. seg: (r, c, segment_id); null labels are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.bands import block, squared_distance
from rasterloom.operators.adjacency import region_adjacency, shared_boundary
from rasterloom.operators.components import connected_components


def labelled(px: DataFrame, seg: DataFrame) -> DataFrame:
    """Pixels with their labels."""
    return px.join(seg.where("segment_id is not null").select("r", "c", "segment_id"), ["r", "c"])


def segment_sizes(seg: DataFrame) -> DataFrame:
    return seg.where("segment_id is not null").groupBy("segment_id").agg(F.count("*").alias("n"))


def segment_summary(seg: DataFrame) -> DataFrame:
    """n_segments, and the pixels (labelled or not) per segment."""
    sums = seg.agg(F.countDistinct("segment_id").alias("n_segments"), F.count("*").alias("n_pixels"))
    return sums.withColumn("avg_size", F.col("n_pixels") / F.greatest(F.lit(1), "n_segments"))


def max_label(seg: DataFrame) -> DataFrame:
    return seg.agg(F.coalesce(F.max(F.when(F.col("segment_id") > 0, F.col("segment_id"))), F.lit(0)).cast("long").alias("max_label"))


def segment_means(px: DataFrame, seg: DataFrame, n: int, ids: DataFrame | None = None) -> DataFrame:
    """(segment_id, mean): band means; a band with a missing value in any pixel of a segment is null. ids: (segment_id) wanted; those without pixels are null."""
    return means_of(labelled(px, seg), n, ids)


def means_of(t: DataFrame, n: int, ids: DataFrame | None = None) -> DataFrame:
    """segment_means of pixels that have their labels, (segment_id, bands)."""
    mean = [F.when(F.count(F.get("bands", F.lit(i))) == F.count("*"), F.avg(F.get("bands", F.lit(i)))) for i in range(n)]
    if ids is not None:
        t = t.join(ids, "segment_id", "left_semi")
    means = t.groupBy("segment_id").agg(F.array(*mean).alias("mean"))
    return means if ids is None else ids.join(means, "segment_id", "left")


def region_stats(px: DataFrame, seg: DataFrame, n: int) -> DataFrame:
    """n, sum, sumsq, mean, population sd by band, bounding box and centroid of each segment."""
    x = [F.get("bands", F.lit(i)) for i in range(n)]
    t = labelled(px, seg).groupBy("segment_id").agg(
        F.count("*").alias("n"),
        F.array(*[F.sum(b) for b in x]).alias("sum"),
        F.array(*[F.sum(b * b) for b in x]).alias("sumsq"),
        F.min("r").alias("min_r"), F.max("r").alias("max_r"), F.min("c").alias("min_c"), F.max("c").alias("max_c"),
        F.avg("r").alias("row"), F.avg("c").alias("col"),
    )
    t = t.withColumn("mean", F.transform("sum", lambda s: s / F.col("n")))
    return t.withColumn("sd", spread("n", "sum", "sumsq"))


def spread(n: str, total: str, squares: str) -> Column:
    """Population standard deviations from sums and sums of squares; a variance below 0 counts as 0."""
    return F.zip_with(total, squares, lambda s, q: F.sqrt(F.greatest(F.lit(0.0), q / F.col(n) - (s / F.col(n)) * (s / F.col(n)))))


def region_bbox_perimeter(seg: DataFrame) -> DataFrame:
    t = seg.where("segment_id is not null").groupBy("segment_id").agg(((F.max("r") - F.min("r") + F.max("c") - F.min("c") + 2) * 2).cast("long").alias("bbox_perimeter"))
    return t


def region_perimeter(seg: DataFrame) -> DataFrame:
    """Pixel sides that face another region, an unlabelled pixel or the outside: 4 n - 2 x the sides between own pixels."""
    t = seg.where("segment_id is not null").select("r", "c", "segment_id")
    along, down = Window.partitionBy("segment_id", "r").orderBy("c"), Window.partitionBy("segment_id", "c").orderBy("r")
    inner = (F.lead("c").over(along) == F.col("c") + 1).cast("int")
    t = t.withColumn("x", F.coalesce(inner, F.lit(0)))
    t = t.withColumn("y", F.coalesce((F.lead("r").over(down) == F.col("r") + 1).cast("int"), F.lit(0)))
    return t.groupBy("segment_id").agg((4 * F.count("*") - 2 * F.sum(F.col("x") + F.col("y"))).cast("long").alias("perimeter"))


def baatz_regions(px: DataFrame, seg: DataFrame, n: int) -> DataFrame:
    stats = region_stats(px, seg, n).select("segment_id", "n", "sum", "sumsq", "min_r", "max_r", "min_c", "max_c")
    return stats.join(region_perimeter(seg), "segment_id")


def region_pairs(regions: DataFrame, rag: DataFrame) -> DataFrame:
    """rag (a, b, shared) with the regions at both ends as structs x, y and their union z."""
    cols = [c for c in regions.columns if c != "segment_id"]
    x = regions.select(F.col("segment_id").alias("a"), F.struct(*cols).alias("x"))
    y = regions.select(F.col("segment_id").alias("b"), F.struct(*cols).alias("y"))
    t = rag.join(x, "a").join(y, "b")
    add = lambda k: F.zip_with(f"x.{k}", f"y.{k}", lambda p, q: p + q).alias(k)
    union = F.struct(
        (F.col("x.n") + F.col("y.n")).alias("n"), add("sum"), add("sumsq"),
        F.least("x.min_r", "y.min_r").alias("min_r"), F.greatest("x.max_r", "y.max_r").alias("max_r"),
        F.least("x.min_c", "y.min_c").alias("min_c"), F.greatest("x.max_c", "y.max_c").alias("max_c"),
        (F.col("x.perimeter") + F.col("y.perimeter") - 2 * F.col("shared")).alias("perimeter"),
    )
    return t.withColumn("z", union)


def spectral_heterogeneity(weights: list[float]) -> Column:
    """Over region_pairs: the weighted growth of n x sd by merging."""
    w = F.array(*map(F.lit, weights))
    total = lambda k: F.aggregate(F.zip_with(spread(f"{k}.n", f"{k}.sum", f"{k}.sumsq"), w, lambda s, v: s * v), F.lit(0.0), lambda a, s: a + s) * F.col(f"{k}.n")
    return total("z") - total("x") - total("y")


def shape_heterogeneity(compactness: float) -> Column:
    """Over region_pairs: the growth of compactness (sqrt(n) x perimeter) and smoothness (n x perimeter / box perimeter) by merging."""

    def of(k: str) -> tuple[Column, Column]:
        n, p = F.col(f"{k}.n"), F.col(f"{k}.perimeter")
        box = 2 * (F.col(f"{k}.max_r") - F.col(f"{k}.min_r") + F.col(f"{k}.max_c") - F.col(f"{k}.min_c") + 2)
        return n * p / F.sqrt(n), n * p / box

    (cx, sx), (cy, sy), (cz, sz) = of("x"), of("y"), of("z")
    return compactness * (cz - cx - cy) + (1 - compactness) * (sz - sx - sy)


def fusion_factor(pairs: DataFrame, weights: list[float], color_weight: float = 0.9, compactness: float = 0.5) -> DataFrame:
    """(a, b, shared, h_color, h_shape, ff) of neighbouring regions."""
    t = pairs.withColumns({"h_color": spectral_heterogeneity(weights), "h_shape": shape_heterogeneity(compactness)})
    return t.select("a", "b", "shared", "h_color", "h_shape", (color_weight * F.col("h_color") + (1 - color_weight) * F.col("h_shape")).alias("ff"))


def best_neighbor(ff: DataFrame) -> DataFrame:
    """(segment_id, neighbor, ff): each region's neighbour with the least fusion factor; the smaller id settles ties."""
    both = ff.select(F.col("a").alias("segment_id"), F.col("b").alias("neighbor"), "ff").unionByName(ff.select(F.col("b").alias("segment_id"), F.col("a").alias("neighbor"), "ff"))
    return both.groupBy("segment_id").agg(F.min(F.struct("ff", "neighbor")).alias("m")).select("segment_id", "m.neighbor", "m.ff")


def merge_regions(regions: DataFrame, mapping: DataFrame) -> DataFrame:
    """regions (segment_id, n, sum, sumsq, box) summed by new_id of mapping (old_id, new_id)."""
    t = regions.join(mapping, regions["segment_id"] == mapping["old_id"], "left").withColumn("id", F.coalesce("new_id", "segment_id"))
    flat = t.select("id", "n", "min_r", "max_r", "min_c", "max_c", F.posexplode(F.arrays_zip("sum", "sumsq")).alias("i", "v"))
    sums = flat.groupBy("id", "i").agg(F.sum("v.sum").alias("sum"), F.sum("v.sumsq").alias("sumsq"), F.sum("n").alias("n"), F.min("min_r").alias("min_r"), F.max("max_r").alias("max_r"), F.min("min_c").alias("min_c"), F.max("max_c").alias("max_c"))
    bands = F.sort_array(F.collect_list(F.struct("i", "sum", "sumsq")))
    return sums.groupBy(F.col("id").alias("segment_id")).agg(F.max("n").alias("n"), bands.alias("v"), F.min("min_r").alias("min_r"), F.max("max_r").alias("max_r"), F.min("min_c").alias("min_c"), F.max("max_c").alias("max_c")).withColumn("sum", F.col("v.sum")).withColumn("sumsq", F.col("v.sumsq")).drop("v")


def label_histogram(qpx: DataFrame, label: str = "label0") -> DataFrame:
    """(label, band, bin, n) over pixels with qbins."""
    t = qpx.select(F.col(label).alias("label"), F.posexplode("qbins").alias("band", "bin")).where("bin is not null")
    return t.groupBy("label", "band", "bin").agg(F.count("*").alias("n"))


def block_histogram(qpx: DataFrame, size: int) -> DataFrame:
    """(br, bc, band, bin, n) of aligned size x size blocks."""
    t = qpx.select(block(F.col("r"), size).alias("br"), block(F.col("c"), size).alias("bc"), F.posexplode("qbins").alias("band", "bin")).where("bin is not null")
    return t.groupBy("br", "bc", "band", "bin").agg(F.count("*").alias("n"))


def block_score(qpx: DataFrame, size: int, bins: int, n: int, alpha: float = 1.0, label: str = "label0") -> DataFrame:
    """(br, bc, label, score): how well each block fits each label that it has pixels of."""
    sizes = qpx.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("size"))
    met = qpx.select(block(F.col("r"), size).alias("br"), block(F.col("c"), size).alias("bc"), F.col(label).alias("label")).distinct()
    hist = label_histogram(qpx, label).withColumnRenamed("n", "h")
    t = met.join(block_histogram(qpx, size), ["br", "bc"]).join(hist, ["label", "band", "bin"], "left").join(sizes, "label")
    p = (F.coalesce("h", F.lit(0)) + F.lit(alpha)) / (F.col("size") + F.lit(alpha * n * bins))
    return t.groupBy("br", "bc", "label").agg(F.sum(F.col("n") * p).alias("score"))


def region_features(px: DataFrame, seg: DataFrame, n: int, ms_dim: int = 0, ranger: float = 0.15, hs: float = 12.0) -> DataFrame:
    """(segment_id, n, z): band means over ranger (the first ms_dim bands, 0: up to 3), then mean row and column over hs."""
    dim = min(n, ms_dim or 3)
    mean = [F.avg(F.get("bands", F.lit(i))) / ranger for i in range(dim)]
    return labelled(px, seg).groupBy("segment_id").agg(F.count("*").alias("n"), F.array(*mean, F.avg("r") / hs, F.avg("c") / hs).alias("z"))


def cell_key(z: Column, dim: int, cell: float = 1.0) -> Column:
    return F.array(*[F.floor(F.get(z, F.lit(i)) / cell).cast("long") for i in range(dim)])


def around(key: Column, dim: int) -> Column:
    """The 3^dim keys around a key, itself among them. Joins on them ask for a sorted join, as size estimates don't see these copies."""
    steps = [[]]
    for _ in range(dim):
        steps = [[*s, d] for s in steps for d in (-1, 0, 1)]
    offsets = F.array(*[F.array(*[F.lit(d).cast("long") for d in s]) for s in steps])
    return F.explode(F.transform(offsets, lambda o: F.zip_with(key, o, lambda a, b: a + b)))


def region_meanshift_step(features: DataFrame, dim: int, at: DataFrame | None = None) -> DataFrame:
    """(segment_id, y): one step from y (z at first) to the weighted mean of the z within 3 units in the neighbouring unit cells."""
    at = features.select("segment_id", F.col("z").alias("y")) if at is None else at
    grid = features.select(F.col("n"), "z", cell_key(F.col("z"), dim).alias("key"))
    probes = at.withColumn("key", around(cell_key(F.col("y"), dim), dim))
    d2 = squared_distance(F.col("z"), F.col("y"))
    met = probes.hint("merge").join(grid, "key").withColumn("d2", d2).where("d2 <= 9").withColumn("w", F.exp(-F.col("d2") / 2) * F.col("n"))
    sums = met.groupBy("segment_id").agg(*[(F.sum(F.col("w") * F.get("z", F.lit(i))) / F.sum("w")).alias(f"y{i}") for i in range(dim)])
    return sums.select("segment_id", F.array(*[F.col(f"y{i}") for i in range(dim)]).alias("y"))


def mode_pair_join(modes: DataFrame, dim: int, merge: float = 0.6) -> DataFrame:
    """(a, b): pairs of regions whose modes y are within `merge`, found over cells of that size."""
    grid = modes.select(F.col("segment_id").alias("b"), F.col("y").alias("z"), cell_key(F.col("y"), dim, merge).alias("key"))
    probes = modes.select(F.col("segment_id").alias("a"), "y", around(cell_key(F.col("y"), dim, merge), dim).alias("key"))
    met = probes.hint("merge").join(grid, "key").where("a < b").where(squared_distance(F.col("y"), F.col("z")) <= merge * merge)
    return met.select("a", "b")


def mode_clusters(modes: DataFrame, dim: int, merge: float = 0.6) -> DataFrame:
    """(segment_id, mode): regions joined over mode_pair_join; mode is the smallest region of each."""
    found = connected_components(mode_pair_join(modes, dim, merge))
    return modes.select("segment_id").join(found, F.col("segment_id") == F.col("node"), "left").select("segment_id", F.coalesce("component", "segment_id").alias("mode"))


def mode_sizes(features: DataFrame, clusters: DataFrame) -> DataFrame:
    return features.join(clusters, "segment_id").groupBy("mode").agg(F.sum("n").alias("n"))


def mode_edges(rag: DataFrame, clusters: DataFrame, modes: DataFrame) -> DataFrame:
    """(ma, mb, d2): region adjacency lifted to modes, with the squared distance of the two regions' modes."""
    t = clusters.join(modes, "segment_id")
    a = t.select(F.col("segment_id").alias("a"), F.col("mode").alias("ma"), F.col("y").alias("ya"))
    b = t.select(F.col("segment_id").alias("b"), F.col("mode").alias("mb"), F.col("y").alias("yb"))
    met = rag.join(a, "a").join(b, "b").where("ma <> mb")
    return met.select("ma", "mb", squared_distance(F.col("ya"), F.col("yb")).alias("d2"))


def disconnected_segments(seg: DataFrame, eight: bool = True) -> DataFrame:
    """(segment_id, parts): segments whose pixels don't hang together."""
    parts = connected_parts(seg, eight)
    return parts.groupBy("segment_id").agg(F.countDistinct("part").alias("parts")).where("parts > 1")


def connected_parts(seg: DataFrame, eight: bool = True) -> DataFrame:
    """(r, c, segment_id, part): part is (r << 32) + c of the first pixel that hangs together with this one inside its segment."""
    from rasterloom.operators.adjacency import FORWARD, shifted

    t = seg.where("segment_id is not null").select("r", "c", "segment_id")
    cell = lambda r, c: F.shiftleft(F.col(r).cast("long"), 32) + F.col(c)
    pairs = shifted(t.withColumnRenamed("segment_id", "x"), FORWARD[: 4 if eight else 2], [F.col("x")]).join(t, ["r", "c"]).where("x = segment_id")
    found = connected_components(pairs.select(cell("ar", "ac").alias("a"), cell("r", "c").alias("b")))
    t = t.withColumn("cell", cell("r", "c"))
    return t.join(found, F.col("cell") == F.col("node"), "left").select("r", "c", "segment_id", F.coalesce("component", "cell").alias("part"))


def rag(seg: DataFrame, eight: bool = False) -> DataFrame:
    """Region adjacency: with shared sides for 4 neighbours, without for 8."""
    return region_adjacency(seg, True) if eight else shared_boundary(seg)
