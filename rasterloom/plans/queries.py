"""One query per operator on the fixtures, and DuckDB SQL for all that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import adjacency, labels, prepare, regions, segment, tiles
from rasterloom.operators.components import connected_components
from rasterloom.plans import fixtures as fx
from rasterloom.plans.scale import Written, shared_dir
from rasterloom.sources import geotiff, tables

NCOL = 100
TILE, BUFFER = 40, 4
WEIGHTS = [1.0, 1.0, 1.0]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *uses: str):
    """Registers a query under its function's name; sql may read the fixtures named in uses."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ctes = [f"{name} as ({fx.SQL[name]})" for name in uses]
            ORACLE_SQL[f.__name__] = ("with recursive " + ",\n".join(ctes) + (",\n" + sql[5:] if sql.startswith("with ") else "\n" + sql)) if ctes else sql
        return f

    return add


def px(spark: SparkSession, d: str, name: str = "px_events") -> DataFrame:
    return fx.raster(spark, d, name)


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def spread_out(df: DataFrame, column: str, n: int, prefix: str, places: int | None = 6) -> DataFrame:
    """An array column as n columns."""
    one = lambda i: F.get(column, F.lit(i)) if places is None else F.round(F.get(column, F.lit(i)), places)
    return df.select(*[c for c in df.columns if c != column], *[one(i).alias(f"{prefix}{i + 1}") for i in range(n)])


# scans and preparation


@query("select cast(l_partkey % 50 as int) as r, cast(l_suppkey % 40 as int) as c, round(avg(l_quantity), 6) as b1, round(avg(l_discount), 6) as b2, count(*) as n from lineitem group by 1, 2")
def rasterize_points(spark, d):
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    return prepare.to_columns(prepare.rasterize(items, F.col("l_partkey") % 50, F.col("l_suppkey") % 40, ["l_quantity", "l_discount"]), 2, places=6)


@query("select r, c, b1, b2, b3 from px_events where r >= 2 and r < 40 and c >= 20 and c < 60", "px_events")
def scan_window(spark, d):
    return prepare.to_columns(prepare.scan_window(px(spark, d), 2, 40, 20, 60), 3)


@query("select r, c, b1 is not null and b2 is not null and b3 is not null as valid from px_events_na", "px_events_na")
def valid_mask(spark, d):
    return prepare.valid_mask(px(spark, d, "px_events_na")).drop("bands")


@query("select count(*) as n_pixels, cast(sum(case when b1 is null then 1 else 0 end) as bigint) as n_na from px_events_na", "px_events_na")
def na_count(spark, d):
    return prepare.na_count(px(spark, d, "px_events_na"))


@query("""with long as (select 1 as band, b1 as x from px_events_na union all select 2, b2 from px_events_na union all select 3, b3 from px_events_na)
select band, count(x) as n, round(avg(x), 6) as mean, round(stddev_samp(x), 6) as sd, min(x) as min, max(x) as max from long group by band""", "px_events_na")
def band_stats(spark, d):
    return rounded(prepare.band_stats(px(spark, d, "px_events_na")), "mean", "sd")


@query("""select a.r, a.c, round(case when a.b1 is not null and count(b.b1) = 9 then avg(b.b1) end, 6) as b1,
 round(case when count(b.b2) = 9 then avg(b.b2) end, 6) as b2, round(case when count(b.b3) = 9 then avg(b.b3) end, 6) as b3
 from px_events_na a join px_events_na b on b.r between a.r - 1 and a.r + 1 and b.c between a.c - 1 and a.c + 1 group by a.r, a.c, a.b1""", "px_events_na")
def smooth_mean_3(spark, d):
    return prepare.to_columns(prepare.smooth_mean(px(spark, d, "px_events_na"), 3), 3, places=6)


@query("""with s as (select avg(b1) m1, stddev_samp(b1) s1, avg(b2) m2, stddev_samp(b2) s2, avg(b3) m3, stddev_samp(b3) s3 from px_events_na)
select r, c, round((b1 - m1) / s1, 6) as b1, round((b2 - m2) / s2, 6) as b2, round((b3 - m3) / s3, 6) as b3 from px_events_na, s""", "px_events_na")
def zscore_bands(spark, d):
    return prepare.to_columns(prepare.zscore_bands(px(spark, d, "px_events_na"), 3), 3, places=6)


@query("""with s as (select avg(b1) m1 from px_events_na)
select r, c, round(coalesce(b1, m1), 6) as b1, round(b2, 6) as b2, round(b3, 6) as b3 from px_events_na, s""", "px_events_na")
def fill_na_band_mean(spark, d):
    return prepare.to_columns(prepare.fill_na_band_mean(px(spark, d, "px_events_na"), 3), 3, places=6)


@query("select r, c, b1, b2 from px_events", "px_events")
def band_subset(spark, d):
    return prepare.to_columns(prepare.band_subset(px(spark, d), 2), 2)


def bin_sql(x: str, i: int, n: int = 20) -> str:
    t = f"(({x} - lo{i}) / (hi{i} - lo{i}))"
    return f"cast(case when {x} is null then null when {t} <= 0 then 0 when {t} >= 1 then {n - 1} else least({n - 1}, floor({t} * {n})) end as int)"


LIMITS = "select " + ", ".join(f"min(b{i}) as lo{i}, max(b{i}) as hi{i}" for i in (1, 2, 3)) + " from px_events_na"
QUANTIZED = f"select r, c, {bin_sql('b1', 1)} as q1, {bin_sql('b2', 2)} as q2, {bin_sql('b3', 3)} as q3 from px_events_na, ({LIMITS}) l"


@query(QUANTIZED, "px_events_na")
def quantize_bins(spark, d):
    return spread_out(prepare.quantize_bins(px(spark, d, "px_events_na"), 20, 3).drop("bands"), "qbins", 3, "q", None)


@query("select r, c, cast((r // 10) * 10 + c // 10 as bigint) as label0 from px_events", "px_events")
def grid_init_labels(spark, d):
    return prepare.grid_init_labels(px(spark, d), 10, NCOL).drop("bands")


@query("""with size as (select (max(r) + 1) // 2 as h from px_orders),
t as (select r, c, (r + 0.5) * 2 - 0.5 as y, (c + 0.5) * 2 - 0.5 as x from (select distinct r // 2 as r, c // 2 as c from px_orders) q, size where r < h),
k as (select t.r, t.c, cast(floor(y) as int) + i as sr, cast(floor(x) as int) + j as sc,
  (case when i = 1 then y - floor(y) else 1 - (y - floor(y)) end) * (case when j = 1 then x - floor(x) else 1 - (x - floor(x)) end) as w
  from t, (values (0, 0), (0, 1), (1, 0), (1, 1)) v(i, j))
select k.r, k.c, round(sum(w * b1) / sum(w), 6) as b1, round(sum(w * b2) / sum(w), 6) as b2 from k join px_orders p on p.r = k.sr and p.c = k.sc where w > 0 group by k.r, k.c""", "px_orders")
def align_resample(spark, d):
    p = px(spark, d, "px_orders")
    return prepare.to_columns(prepare.align_resample(p, fx.n_rows(p) // 2, NCOL // 2, 2.0, 2.0, 2), 2, places=6)


@query("select r, c, b1, b2 from px_orders", "px_orders")
def geotiff_roundtrip(spark, d):
    """Written as GeoTIFF blocks of 32 rows to the shared folder and read again."""
    p = px(spark, d, "px_orders")
    folder = f"{shared_dir(spark)}/tif-{uuid.uuid4().hex}"
    geotiff.write_geotiff(geotiff.encode_bands(p, fx.n_rows(p), NCOL, 32), folder)
    back = geotiff.read_geotiff(spark, f"{folder}/*.tif")
    return prepare.to_columns(back.select((F.col("r") + 32 * F.regexp_extract("path", r"_(\d+)\.tif", 1).cast("int")).alias("r"), "c", "bands"), 2)


@query(f"select tile_id, count(*) as n, min(r) as r0, max(r) as r1 from (select cast(r // {TILE} * 3 + c // {TILE} as bigint) as tile_id, r from px_events) t group by tile_id", "px_events")
def tile_files(spark, d):
    """Buffered tiles written by tile and read again; pixels that a tile owns."""
    p = px(spark, d)
    folder = f"{shared_dir(spark)}/tiles-{uuid.uuid4().hex}"
    tables.write_tiles(tiles.assign_pixels(p, fx.n_rows(p), NCOL, TILE, BUFFER), folder)
    back = spark.read.parquet(folder).where("inner")
    return back.groupBy(F.col("tile_id").cast("long").alias("tile_id")).agg(F.count("*").alias("n"), F.min("r").alias("r0"), F.max("r").alias("r1"))


# adjacency

STEPS4, STEPS8 = "(values (0, 1, 0), (1, 0, 1)) o(dr, dc, dir)", "(values (0, 1, 0), (1, 0, 1), (1, 1, 2), (1, -1, 3)) o(dr, dc, dir)"


def edge_sql(steps: str, table: str = "px_events_na") -> str:
    d = lambda i: f"(a.b{i} - b.b{i}) * (a.b{i} - b.b{i})"
    return f"""select cast(a.r * 100 + a.c as bigint) as a, cast(b.r * 100 + b.c as bigint) as b, cast(dir as tinyint) as dir,
 cast(cast(sqrt({d(1)} + {d(2)} + {d(3)}) as float) as double) as w
 from {table} a cross join {steps} join {table} b on b.r = a.r + dr and b.c = a.c + dc where a.b1 is not null and b.b1 is not null"""


@query(f"with e as ({edge_sql(STEPS4)}) select a, b, dir from e", "px_events_na")
def edges4(spark, d):
    return adjacency.adjacency_edges(px(spark, d, "px_events_na"), NCOL, False)


@query(f"with e as ({edge_sql(STEPS8)}) select a, b, dir from e", "px_events_na")
def edges8(spark, d):
    return adjacency.adjacency_edges(px(spark, d, "px_events_na"), NCOL, True)


@query(f"with e as ({edge_sql(STEPS8)}) select a, b, dir, round(w, 4) as w from e", "px_events_na")
def edge_weights8(spark, d):
    e = adjacency.edge_weights(px(spark, d, "px_events_na"), NCOL, True)
    return e.withColumn("w", F.round(F.col("w").cast("double"), 4))


@query(f"with e as ({edge_sql(STEPS8)}) select a, b, round(w, 4) as w from e order by e.w, a, b limit 200", "px_events_na")
def sort_edges_topk(spark, d):
    e = adjacency.sort_edges(adjacency.edge_weights(px(spark, d, "px_events_na"), NCOL, True), 200)
    return e.select("a", "b", F.round(F.col("w").cast("double"), 4).alias("w"))


def touch_sql(steps: str, table: str = "seg_blocks") -> str:
    return f"""select least(a.segment_id, b.segment_id) as a, greatest(a.segment_id, b.segment_id) as b
 from {table} a cross join {steps} join {table} b on b.r = a.r + dr and b.c = a.c + dc where a.segment_id <> b.segment_id"""


@query(f"select distinct a, b from ({touch_sql(STEPS8, 'seg_embed')}) t", "seg_embed")
def region_adjacency8(spark, d):
    return adjacency.region_adjacency(fx.labels(spark, d, "seg_embed"), True)


@query(f"select a, b, count(*) as shared from ({touch_sql(STEPS4)}) t group by a, b", "seg_blocks")
def shared_boundary(spark, d):
    return adjacency.shared_boundary(fx.labels(spark, d, "seg_blocks"))


@query("""select s.r, s.c, s.segment_id, coalesce(nullif(x.segment_id, s.segment_id), nullif(w.segment_id, s.segment_id), nullif(y.segment_id, s.segment_id), nullif(n.segment_id, s.segment_id)) as other
 from seg_embed s left join seg_embed x on x.r = s.r and x.c = s.c + 1 left join seg_embed w on w.r = s.r and w.c = s.c - 1
 left join seg_embed y on y.r = s.r + 1 and y.c = s.c left join seg_embed n on n.r = s.r - 1 and n.c = s.c""", "seg_embed")
def neighbor_label(spark, d):
    return adjacency.first_differing_neighbor(fx.labels(spark, d, "seg_embed"))


def ms_step_sql(ranger: float) -> str:
    d2 = " + ".join(f"power(q.b{i} - p.b{i}, 2)" for i in (1, 2, 3))
    sums = ", ".join(f"sum(w * b{i}) as s{i}" for i in (1, 2, 3))
    new = ", ".join(f"round((p.b{i} + coalesce(s{i}, 0)) / (1 + coalesce(w, 0)), 6) as b{i}" for i in (1, 2, 3))
    return f"""with m as (select p.r, p.c, q.b1, q.b2, q.b3, exp(-(power(q.r - p.r, 2) + power(q.c - p.c, 2)) / 2) * exp(-({d2}) / {2 * ranger * ranger}) as w
 from px_events_na p join px_events_na q on q.r between p.r - 1 and p.r + 1 and q.c between p.c - 1 and p.c + 1 and (q.r <> p.r or q.c <> p.c)
 where p.b1 is not null and q.b1 is not null),
s as (select r, c, sum(w) as w, {sums} from m where w >= 1e-6 group by r, c)
select p.r, p.c, {new} from px_events_na p left join s on s.r = p.r and s.c = p.c where p.b1 is not null"""


@query(ms_step_sql(200.0), "px_events_na")
def ms_filter_step(spark, d):
    return prepare.to_columns(adjacency.ms_filter_step(px(spark, d, "px_events_na"), 1, 200.0, True, 3), 3, places=6)


# regions

JOINED = "select p.r, p.c, b1, b2, b3, segment_id from px_events p join seg_blocks s on s.r = p.r and s.c = p.c"


def region_sql() -> str:
    bands = ", ".join(f"sum(b{i}) as sum{i}, sum(b{i} * b{i}) as sq{i}, avg(b{i}) as mean{i}, sqrt(greatest(0, sum(b{i} * b{i}) / count(*) - (sum(b{i}) / count(*)) * (sum(b{i}) / count(*)))) as sd{i}" for i in (1, 2, 3))
    return f"select segment_id, count(*) as n, {bands}, min(r) as min_r, max(r) as max_r, min(c) as min_c, max(c) as max_c, avg(r) as row, avg(c) as col from ({JOINED}) j group by segment_id"


def merged_sql() -> str:
    """Region pairs: CTEs reg, per, tch, pair."""
    return f"""with reg as ({region_sql()}),
per as (select segment_id, cast(4 * count(*) - 2 * coalesce(max(i.k), 0) as bigint) as perimeter from seg_blocks left join
  (select a.segment_id as s, count(*) as k from seg_blocks a cross join {STEPS4} join seg_blocks b on b.r = a.r + dr and b.c = a.c + dc and a.segment_id = b.segment_id group by 1) i on i.s = segment_id group by segment_id),
tch as (select a, b, count(*) as shared from ({touch_sql(STEPS4)}) t group by a, b),
full_reg as (select reg.*, perimeter from reg join per on per.segment_id = reg.segment_id),
pair as (select t.a, t.b, t.shared, {", ".join(f"x.{k} as x_{k}, y.{k} as y_{k}" for k in ("n", "perimeter", "sum1", "sum2", "sum3", "sq1", "sq2", "sq3", "sd1", "sd2", "sd3"))},
  2 * (x.max_r - x.min_r + x.max_c - x.min_c + 2) as x_box, 2 * (y.max_r - y.min_r + y.max_c - y.min_c + 2) as y_box,
  2 * (greatest(x.max_r, y.max_r) - least(x.min_r, y.min_r) + greatest(x.max_c, y.max_c) - least(x.min_c, y.min_c) + 2) as z_box
  from tch t join full_reg x on x.segment_id = t.a join full_reg y on y.segment_id = t.b)"""


def het_sql() -> tuple[str, str]:
    z = lambda i: f"sqrt(greatest(0, (x_sq{i} + y_sq{i}) / (x_n + y_n) - power((x_sum{i} + y_sum{i}) / (x_n + y_n), 2)))"
    color = " + ".join(f"(x_n + y_n) * {z(i)} - x_n * x_sd{i} - y_n * y_sd{i}" for i in (1, 2, 3))
    zp, zn = "(x_perimeter + y_perimeter - 2 * shared)", "(x_n + y_n)"
    compact = f"({zn} * {zp} / sqrt({zn}) - x_n * x_perimeter / sqrt(x_n) - y_n * y_perimeter / sqrt(y_n))"
    smooth = f"({zn} * {zp} / z_box - x_n * x_perimeter / x_box - y_n * y_perimeter / y_box)"
    return f"({color})", f"(0.5 * {compact} + 0.5 * {smooth})"


COLOR, SHAPE = het_sql()


@query(f"select segment_id, n, round(sum1, 4) as sum1, round(sq1, 2) as sq1, round(mean1, 6) as mean1, round(sd1, 4) as sd1, min_r, max_r, min_c, max_c, round(row, 6) as row, round(col, 6) as col from ({region_sql()}) t", "px_events", "seg_blocks")
def region_stats(spark, d):
    t = regions.region_stats(px(spark, d), fx.labels(spark, d, "seg_blocks"), 3)
    one = lambda k, p: F.round(F.get(k, F.lit(0)), p)
    return t.select("segment_id", "n", one("sum", 4).alias("sum1"), one("sumsq", 2).alias("sq1"), one("mean", 6).alias("mean1"), one("sd", 4).alias("sd1"), "min_r", "max_r", "min_c", "max_c", F.round("row", 6).alias("row"), F.round("col", 6).alias("col"))


@query("select segment_id, cast(2 * (max(r) - min(r) + max(c) - min(c) + 2) as bigint) as bbox_perimeter from seg_embed group by segment_id", "seg_embed")
def region_bbox_perimeter(spark, d):
    return regions.region_bbox_perimeter(fx.labels(spark, d, "seg_embed"))


@query(f"""with i as (select a.segment_id as s, count(*) as k from seg_embed a cross join {STEPS4} join seg_embed b on b.r = a.r + dr and b.c = a.c + dc and a.segment_id = b.segment_id group by 1)
select segment_id, cast(4 * count(*) - 2 * coalesce(max(i.k), 0) as bigint) as perimeter from seg_embed left join i on i.s = segment_id group by segment_id""", "seg_embed")
def region_perimeter(spark, d):
    return regions.region_perimeter(fx.labels(spark, d, "seg_embed"))


@query("""select segment_id, round(case when count(b1) = count(*) then avg(b1) end, 6) as mean1, round(avg(b2), 6) as mean2, round(avg(b3), 6) as mean3
 from px_events_na p join seg_blocks s on s.r = p.r and s.c = p.c group by segment_id""", "px_events_na", "seg_blocks")
def segment_means(spark, d):
    return spread_out(regions.segment_means(px(spark, d, "px_events_na"), fx.labels(spark, d, "seg_blocks"), 3), "mean", 3, "mean")


@query("""with ids as (select segment_id from seg_blocks where segment_id % 5 = 0 union select 1000000)
select i.segment_id, round(avg(b1), 6) as mean1, round(avg(b2), 6) as mean2, round(avg(b3), 6) as mean3 from ids i left join seg_blocks s on s.segment_id = i.segment_id left join px_events p on s.r = p.r and s.c = p.c group by i.segment_id""", "px_events", "seg_blocks")
def segment_means_of_ids(spark, d):
    seg = fx.labels(spark, d, "seg_blocks")
    ids = seg.where("segment_id % 5 = 0").select("segment_id").unionByName(spark.range(1_000_000, 1_000_001).select(F.col("id").alias("segment_id"))).distinct()
    return spread_out(regions.segment_means(px(spark, d), seg, 3, ids), "mean", 3, "mean")


@query("select segment_id, count(*) as n from seg_embed group by segment_id", "seg_embed")
def segment_sizes(spark, d):
    return regions.segment_sizes(fx.labels(spark, d, "seg_embed"))


@query("select count(distinct segment_id) as n_segments, count(*) as n_pixels, count(*) / greatest(1, count(distinct segment_id)) as avg_size from seg_embed", "seg_embed")
def n_segments(spark, d):
    return regions.segment_summary(fx.labels(spark, d, "seg_embed"))


@query("select coalesce(max(case when segment_id > 0 then segment_id end), 0) as max_label from seg_blocks", "seg_blocks")
def max_label(spark, d):
    return regions.max_label(fx.labels(spark, d, "seg_blocks"))


def binned(spark, d):
    q = prepare.quantize_bins(px(spark, d, "px_events_na"), 20, 3)
    return prepare.grid_init_labels(q, 10, NCOL)


LONG_BINS = f"""with q as ({QUANTIZED}), long as (
 select r, c, 0 as band, q1 as bin from q union all select r, c, 1, q2 from q union all select r, c, 2, q3 from q)"""


@query(LONG_BINS + " select cast((r // 10) * 10 + c // 10 as bigint) as label, band, bin, count(*) as n from long where bin is not null group by 1, 2, 3", "px_events_na")
def label_histogram(spark, d):
    return regions.label_histogram(binned(spark, d))


@query(LONG_BINS + " select cast(r // 8 as int) as br, cast(c // 8 as int) as bc, band, bin, count(*) as n from long where bin is not null group by 1, 2, 3, 4", "px_events_na")
def block_histogram(spark, d):
    return regions.block_histogram(binned(spark, d), 8)


@query(LONG_BINS + """, lab as (select distinct r, c, cast((r // 10) * 10 + c // 10 as bigint) as label from q),
h as (select label, band, bin, count(*) as h from long join lab on lab.r = long.r and lab.c = long.c where bin is not null group by 1, 2, 3),
size as (select label, count(*) as size from lab group by 1),
met as (select distinct cast(r // 8 as int) as br, cast(c // 8 as int) as bc, label from lab),
blk as (select cast(r // 8 as int) as br, cast(c // 8 as int) as bc, band, bin, count(*) as n from long where bin is not null group by 1, 2, 3, 4)
select met.br, met.bc, met.label, round(sum(n * (coalesce(h, 0) + 1.0) / (size + 60.0)), 6) as score from met join blk on blk.br = met.br and blk.bc = met.bc
 left join h on h.label = met.label and h.band = blk.band and h.bin = blk.bin join size on size.label = met.label group by 1, 2, 3""", "px_events_na")
def block_score(spark, d):
    return rounded(regions.block_score(binned(spark, d), 8, 20, 3), "score")


def pairs(spark, d):
    seg = fx.labels(spark, d, "seg_blocks")
    return regions.region_pairs(regions.baatz_regions(px(spark, d), seg, 3), adjacency.shared_boundary(seg))


@query(merged_sql() + f" select a, b, round({COLOR}, 3) as h_color from pair", "px_events", "seg_blocks")
def spectral_heterogeneity(spark, d):
    return pairs(spark, d).select("a", "b", F.round(regions.spectral_heterogeneity(WEIGHTS), 3).alias("h_color"))


@query(merged_sql() + f" select a, b, round({SHAPE}, 6) as h_shape from pair", "px_events", "seg_blocks")
def shape_heterogeneity(spark, d):
    return pairs(spark, d).select("a", "b", F.round(regions.shape_heterogeneity(0.5), 6).alias("h_shape"))


@query(merged_sql() + f" select a, b, shared, round(0.9 * {COLOR} + 0.1 * {SHAPE}, 3) as ff from pair", "px_events", "seg_blocks")
def fusion_factor(spark, d):
    return regions.fusion_factor(pairs(spark, d), WEIGHTS, 0.9, 0.5).select("a", "b", "shared", F.round("ff", 3).alias("ff"))


@query(merged_sql() + f""", ff as (select a, b, 0.9 * {COLOR} + 0.1 * {SHAPE} as ff from pair), both_ways as (select a as segment_id, b as neighbor, ff from ff union all select b, a, ff from ff),
ranked as (select *, row_number() over (partition by segment_id order by ff, neighbor) as k from both_ways) select segment_id, neighbor, round(ff, 3) as ff from ranked where k = 1""", "px_events", "seg_blocks")
def best_neighbor(spark, d):
    return rounded(regions.best_neighbor(regions.fusion_factor(pairs(spark, d), WEIGHTS, 0.9, 0.5)), "ff", places=3)


@query(f"""with j as (select (segment_id - 1) // 2 + 1 as segment_id, r, c, b1 from ({JOINED}) j)
select segment_id, count(*) as n, round(sum(b1), 4) as sum1, min(r) as min_r, max(r) as max_r, min(c) as min_c, max(c) as max_c from j group by segment_id""", "px_events", "seg_blocks")
def merge_regions(spark, d):
    seg = fx.labels(spark, d, "seg_blocks")
    mapping = seg.select(F.col("segment_id").alias("old_id"), F.floor((F.col("segment_id") - 1) / 2 + 1).alias("new_id")).distinct()
    t = regions.merge_regions(regions.region_stats(px(spark, d), seg, 3), mapping)
    return t.select("segment_id", "n", F.round(F.get("sum", F.lit(0)), 4).alias("sum1"), "min_r", "max_r", "min_c", "max_c")


FEATURES = f"""select segment_id, count(*) as n, avg(b1) / 50 as z1, avg(b2) / 50 as z2, avg(b3) / 50 as z3, avg(r) / 12 as z4, avg(c) / 12 as z5 from ({JOINED}) j group by segment_id"""


def features(spark, d):
    return regions.region_features(px(spark, d), fx.labels(spark, d, "seg_blocks"), 3, 3, 50.0, 12.0)


@query(f"select segment_id, n, {', '.join(f'round(z{i}, 6) as z{i}' for i in range(1, 6))} from ({FEATURES}) f", "px_events", "seg_blocks")
def region_features(spark, d):
    return spread_out(features(spark, d), "z", 5, "z")


D2 = " + ".join(f"power(q.z{i} - p.z{i}, 2)" for i in range(1, 6))
NEAR = " and ".join(f"abs(floor(q.z{i}) - floor(p.z{i})) <= 1" for i in range(1, 6))
SHIFTED = f"""select p.segment_id, {", ".join(f"sum(w * q{i}) / sum(w) as y{i}" for i in range(1, 6))} from (
 select p.segment_id, exp(-({D2}) / 2) * q.n as w, {", ".join(f"q.z{i} as q{i}" for i in range(1, 6))} from f p join f q on {NEAR} where {D2} <= 9) p group by p.segment_id"""


@query(f"with f as ({FEATURES}) select segment_id, {', '.join(f'round(y{i}, 6) as y{i}' for i in range(1, 6))} from ({SHIFTED}) s", "px_events", "seg_blocks")
def region_meanshift_step(spark, d):
    return spread_out(regions.region_meanshift_step(features(spark, d), 5), "y", 5, "y")


YD2 = " + ".join(f"power(q.y{i} - p.y{i}, 2)" for i in range(1, 6))
MODES = f"with f as ({FEATURES}), s as ({SHIFTED}), close as (select p.segment_id as a, q.segment_id as b from s p join s q on p.segment_id < q.segment_id where {YD2} <= 0.36)"


def modes(spark, d):
    return Written(regions.region_meanshift_step(features(spark, d), 5), "modes").df


@query(MODES + " select a, b from close", "px_events", "seg_blocks")
def mode_pair_join(spark, d):
    return regions.mode_pair_join(modes(spark, d), 5, 0.6)


REACH = """sym as (select a, b from close union select b, a from close), reach as (select a as x, b as y from sym union select r.x, s.b from reach r join sym s on s.a = r.y)"""
CLUSTERS = MODES + f", {REACH}, cl as (select s.segment_id, least(s.segment_id, coalesce(min(r.y), s.segment_id)) as mode from s left join reach r on r.x = s.segment_id group by s.segment_id)"


@query(CLUSTERS + " select segment_id, mode from cl", "px_events", "seg_blocks")
def mode_clusters(spark, d):
    return regions.mode_clusters(modes(spark, d), 5, 0.6)


@query(CLUSTERS + " select mode, cast(sum(n) as bigint) as n from cl join f on f.segment_id = cl.segment_id group by mode", "px_events", "seg_blocks")
def mode_sizes(spark, d):
    return regions.mode_sizes(features(spark, d), regions.mode_clusters(modes(spark, d), 5, 0.6))


@query(CLUSTERS + f""", e as (select distinct a, b from ({touch_sql(STEPS8)}) t)
select ca.mode as ma, cb.mode as mb, round({YD2}, 5) as d2 from e join cl ca on ca.segment_id = e.a join cl cb on cb.segment_id = e.b join s p on p.segment_id = e.a join s q on q.segment_id = e.b where ca.mode <> cb.mode""", "px_events", "seg_blocks")
def mode_edges(spark, d):
    m = modes(spark, d)
    rag = adjacency.region_adjacency(fx.labels(spark, d, "seg_blocks"), True)
    return rounded(regions.mode_edges(rag, regions.mode_clusters(m, 5, 0.6), m), "d2", places=5)


# labels


@query("select r, c, case when segment_id % 3 = 0 then segment_id - 1 else segment_id end as segment_id from seg_blocks", "seg_blocks")
def apply_merge_map(spark, d):
    seg = fx.labels(spark, d, "seg_blocks")
    mapping = seg.where("segment_id % 3 = 0").select(F.col("segment_id").alias("old_id"), (F.col("segment_id") - 1).alias("new_id")).distinct()
    return labels.apply_merge_map(seg, mapping)


@query("select r, c, nullif(segment_id % 4, 0) as segment_id from seg_blocks", "seg_blocks")
def invalid_to_null(spark, d):
    return labels.invalid_to_null(fx.labels(spark, d, "seg_blocks").withColumn("segment_id", F.col("segment_id") % 4))


@query("select r, c, dense_rank() over (order by segment_id * 7 % 101 + segment_id * 1000) as segment_id from seg_blocks", "seg_blocks")
def relabel_global(spark, d):
    return labels.relabel_global(fx.labels(spark, d, "seg_blocks").withColumn("segment_id", F.col("segment_id") * 7 % 101 + F.col("segment_id") * 1000))


@query("""with first_cell as (select segment_id, min(r * 25 + c) as cell from seg_embed group by segment_id), k as (select segment_id, row_number() over (order by cell) as n from first_cell)
select r, c, n as segment_id from seg_embed s join k on k.segment_id = s.segment_id""", "seg_embed")
def relabel_first_seen(spark, d):
    return labels.relabel_first_seen(fx.labels(spark, d, "seg_embed"), 25)


def component_sql(close: str, ids: str) -> str:
    """Component of every id, as (old_id, new_id)."""
    return f"""close as ({close}), {REACH}, ids as ({ids}),
found as (select i.id as old_id, least(i.id, coalesce(min(r.y), i.id)) as new_id from ids i left join reach r on r.x = i.id group by i.id)"""


@query()  # recursive SQL takes too long on the whole raster; tested against union-find
def connected_components_edges(spark, d):
    e = adjacency.edge_weights(px(spark, d, "px_events_na"), NCOL, True)
    return connected_components(e.where("cast(w as double) <= 60"))


@query(f"""with tch as (select distinct a, b from ({touch_sql(STEPS8)}) t), m as (select segment_id, avg(b1) as m1, avg(b2) as m2, avg(b3) as m3 from ({JOINED}) j group by segment_id),
{component_sql("select a, b from tch join m x on x.segment_id = a join m y on y.segment_id = b where sqrt(power(x.m1 - y.m1, 2) + power(x.m2 - y.m2, 2) + power(x.m3 - y.m3, 2)) < 12", "select a as id from tch union select b from tch")}
select old_id, new_id from found""", "px_events", "seg_blocks")
def merge_by_adjacency(spark, d):
    seg = fx.labels(spark, d, "seg_blocks")
    return labels.merge_by_adjacency(adjacency.region_adjacency(seg, True), regions.segment_means(px(spark, d), seg, 3), 12.0)


# the step of mean-shift clustering: components over close neighbours, every valid pixel
@query()  # as above
def ms_cluster(spark, d):
    p = px(spark, d, "px_events_na")
    found = connected_components(adjacency.edge_weights(p, NCOL, True).where("cast(w as double) <= 60"))
    cells = p.where("forall(bands, x -> x is not null)").select("r", "c", (F.col("r").cast("long") * NCOL + F.col("c")).alias("cell"))
    return cells.join(found, F.col("cell") == F.col("node"), "left").select("r", "c", F.coalesce("component", "cell").alias("segment_id"))


@query(f"""with near as (select a.r * 25 + a.c as a, b.r * 25 + b.c as b from seg_embed a cross join {STEPS8} join seg_embed b on b.r = a.r + dr and b.c = a.c + dc and a.segment_id = b.segment_id),
{component_sql("select a, b from near", "select r * 25 + c as id from seg_embed")}
select segment_id, count(distinct new_id) as parts from seg_embed s join found on old_id = s.r * 25 + s.c group by segment_id having count(distinct new_id) > 1""", "seg_embed")
def disconnected_segments(spark, d):
    return regions.disconnected_segments(fx.labels(spark, d, "seg_embed"), True)


@query(f"""with near as (select a.r * 25 + a.c as a, b.r * 25 + b.c as b from seg_embed a cross join {STEPS8} join seg_embed b on b.r = a.r + dr and b.c = a.c + dc and a.segment_id = b.segment_id),
{component_sql("select a, b from near", "select r * 25 + c as id from seg_embed")}
select r, c, dense_rank() over (order by new_id) as segment_id from seg_embed s join found on old_id = s.r * 25 + s.c""", "seg_embed")
def enforce_connectivity(spark, d):
    return labels.enforce_connectivity(fx.labels(spark, d, "seg_embed"), 25, True)


# tiles

GRID = f"""with size as (select max(r) + 1 as nrow from px_events), grid as (
 select cast(i * 3 + j as bigint) as tile_id, i * {TILE} as r0_in, least((i + 1) * {TILE}, nrow) as r1_in, j * {TILE} as c0_in, least((j + 1) * {TILE}, 100) as c1_in, nrow
 from size, (select unnest(range(100000)) as i) a, (values (0), (1), (2)) b(j) where i * {TILE} < nrow),
tile as (select tile_id, cast(r0_in as int) as r0_in, cast(r1_in as int) as r1_in, cast(c0_in as int) as c0_in, cast(c1_in as int) as c1_in, cast(greatest(r0_in - {BUFFER}, 0) as int) as r0_buf, cast(least(r1_in + {BUFFER}, nrow) as int) as r1_buf,
 cast(greatest(c0_in - {BUFFER}, 0) as int) as c0_buf, cast(least(c1_in + {BUFFER}, 100) as int) as c1_buf, {BUFFER} as buffer from grid),
tiled as (select tile_id, r, c, r >= r0_in and r < r1_in and c >= c0_in and c < c1_in as inner_px, r0_in, r1_in, c0_in, c1_in from px_events join tile on r >= r0_buf and r < r1_buf and c >= c0_buf and c < c1_buf),
lab as (select t.*, cast((r // 6) * 20 + c // 6 + 1 as bigint) as segment_id from tiled t)"""


def tiled(spark, d):
    """Buffered tiles with labels that depend on the pixel alone."""
    p = px(spark, d).select("r", "c")
    t = tiles.assign_pixels(p, fx.n_rows(p), NCOL, TILE, BUFFER)
    return t.withColumn("segment_id", (F.floor(F.col("r") / 6) * 20 + F.floor(F.col("c") / 6) + 1).cast("long"))


@query(GRID + " select * from tile", "px_events")
def make_tiles(spark, d):
    return tiles.make_tiles(spark, fx.n_rows(px(spark, d)), NCOL, TILE, BUFFER)


@query(GRID + " select tile_id, r, c, inner_px as inner from tiled", "px_events")
def assign_pixels(spark, d):
    p = px(spark, d).select("r", "c")
    return tiles.assign_pixels(p, fx.n_rows(p), NCOL, TILE, BUFFER).select("tile_id", "r", "c", "inner")


MASK = f"""masked as (select lab.*, case when least(r1_in - r0_in, c1_in - c0_in) // 2 - 1 < 1 then true else
  r < r0_in + b and r >= r0_in or r >= r1_in - b and r < r1_in or c < c0_in + b and c >= c0_in or c >= c1_in - b and c < c1_in end as seam
  from (select lab.*, least({BUFFER}, least(r1_in - r0_in, c1_in - c0_in) // 2 - 1) as b from lab) lab)"""


def masked(spark, d):
    t = tiled(spark, d)
    return tiles.seam_mask(t, tiles.make_tiles(spark, fx.n_rows(px(spark, d)), NCOL, TILE, BUFFER), BUFFER)


@query(GRID + f", {MASK} select tile_id, r, c, seam from masked", "px_events")
def seam_mask(spark, d):
    return masked(spark, d).select("tile_id", "r", "c", "seam")


@query(GRID + f", {MASK} select distinct least(a.segment_id, b.segment_id) as a, greatest(a.segment_id, b.segment_id) as b from masked a cross join {STEPS8} join masked b on b.tile_id = a.tile_id and b.r = a.r + dr and b.c = a.c + dc where a.segment_id <> b.segment_id and (a.seam or b.seam)", "px_events")
def seam_pairs(spark, d):
    return tiles.seam_pairs(masked(spark, d), True)


@query(GRID + f" select distinct least(a.segment_id, b.segment_id) as a, greatest(a.segment_id, b.segment_id) as b from lab a cross join {STEPS8} join lab b on b.r = a.r + dr and b.c = a.c + dc where a.inner_px and b.inner_px and a.tile_id <> b.tile_id and a.segment_id <> b.segment_id", "px_events")
def cross_tile_pairs(spark, d):
    n = fx.n_rows(px(spark, d))
    return tiles.cross_tile_pairs(tiles.mosaic(tiled(spark, d)), n, NCOL, TILE, True)


@query(GRID + ", top as (select tile_id, max(segment_id) as max_label from lab group by tile_id) select tile_id, max_label, cast(coalesce(sum(max_label) over (order by tile_id rows between unbounded preceding and 1 preceding), 0) as bigint) as offset from top", "px_events")
def global_id_offset(spark, d):
    return tiles.global_id_offset(tiled(spark, d))


@query(GRID + " select r, c, segment_id + tile_id * 100000 as segment_id from lab where inner_px", "px_events")
def mosaic_inner(spark, d):
    return tiles.mosaic(tiled(spark, d).withColumn("segment_id", F.col("segment_id") + F.col("tile_id") * 100000), "inner")


@query(GRID + " select r, c, max(tile_id) * 100000 + max(segment_id) as segment_id from lab group by r, c", "px_events")
def mosaic_last_wins(spark, d):
    return tiles.mosaic(tiled(spark, d).withColumn("segment_id", F.col("segment_id") + F.col("tile_id") * 100000), "last_wins")


# kernels: labels can't be had from SQL, what must hold for them can

KERNELS = {
    "fh_segments": lambda p, h: segment.fh_segmenter(p, h, NCOL),
    "hybrid_segments": lambda p, h: segment.hybrid_segmenter(p, h, NCOL, smooth=0),
    "meanshift_segments": lambda p, h: segment.meanshift_segmenter(p, h, NCOL, spatialr=3),
    "baatz_segments": lambda p, h: segment.baatz_segmenter(p, h, NCOL, scale_param=20, color_weight=0.5),
    "baatz_fast_segments": lambda p, h: segment.baatz_fast_segmenter(p, h, NCOL, scale_param=20, color_weight=0.5),
    "seeds_segments": lambda p, h: segment.seeds_segmenter(p, h, NCOL),
    "tile_engine_fh": lambda p, h: segment.fh_segmenter_tile(p, h, NCOL, tile_size=64, buffer=8, seam_thr=10.0),
    "tile_engine_hybrid": lambda p, h: segment.hybrid_segmenter_tile(p, h, NCOL, tile_size=64, buffer=8, seam_thr=10.0, smooth=0),
    "custom_segment_fun": lambda p, h: segment.segment_tiles(p, h, NCOL, halves, {"band": 1}, tile_size=50, buffer=2, keep_buffer=False).select("tile_id", "r", "c", "segment_id"),
}
FILLS = ("baatz_segments", "baatz_fast_segments", "seeds_segments", "custom_segment_fun")


def halves(block, band=0):
    """A user's segmenter: above and below the band's mean."""
    import numpy as np

    return 1 + (block[band] > np.nanmean(block[band])).astype(int)


def unlabelled(p: DataFrame, seg: DataFrame, fills: bool) -> DataFrame:
    """Pixels that should have a label and have none, or the reverse; 0 for a right segmentation."""
    t = p.withColumn("ok", F.lit(True) if fills else F.forall("bands", lambda x: x.isNotNull())).join(seg, ["r", "c"], "left")
    return t.agg(F.coalesce(F.sum((F.col("ok") != F.col("segment_id").isNotNull()).cast("long")), F.lit(0)).alias("n_wrong"), F.count("*").alias("n_pixels"))


def add_kernel(name: str, run) -> None:
    def labels_of(spark, d):
        p = px(spark, d, "px_shapes")
        return run(p, fx.n_rows(p))

    def invariant(spark, d):
        p = px(spark, d, "px_events_na")
        return unlabelled(p, run(p, fx.n_rows(p)), name in FILLS)

    QUERIES[name] = labels_of
    QUERIES[f"{name}_invariant"] = invariant
    ORACLE_SQL[f"{name}_invariant"] = "select cast(0 as bigint) as n_wrong, count(*) as n_pixels from events"


for _name, _run in KERNELS.items():
    add_kernel(_name, _run)


# flat blocks without noise have one right answer, numbered by first pixel, which SQL builds

FLAT = {
    "fh_flat_blocks": lambda p, h: segment.fh_segmenter(p, h, NCOL, k=10.0, min_size=5, scale_bands=False),
    "hybrid_flat_blocks": lambda p, h: segment.hybrid_segmenter(p, h, NCOL, scale_bands=False, smooth=0, fh_k=10.0, ms_ranger=1.0, ms_hs=4.0, final_min_size=20),
    "meanshift_flat_blocks": lambda p, h: segment.meanshift_segmenter(p, h, NCOL, spatialr=2, ranger=1.0, scale_bands=False, min_size=5),
    "baatz_flat_blocks": lambda p, h: segment.baatz_segmenter(p, h, NCOL, scale_param=20, color_weight=0.9),
    "baatz_fast_flat_blocks": lambda p, h: segment.baatz_fast_segmenter(p, h, NCOL, scale_param=20, color_weight=0.9),
    "tile_engine_flat_blocks": lambda p, h: segment.fh_segmenter_tile(p, h, NCOL, tile_size=36, buffer=4, seam_thr=1.0, k=10.0, min_size=1, scale_bands=False),
    "tile_engine_hybrid_flat_blocks": lambda p, h: segment.hybrid_segmenter_tile(p, h, NCOL, tile_size=36, buffer=4, seam_thr=1.0, scale_bands=False, smooth=0, fh_k=10.0, fh_min_size=1, ms_ranger=1.0, ms_hs=2.0, mode_merge=0.3, final_min_size=1),
}
FLAT_SQL = """with f as (select segment_id, min(r * 100 + c) as cell from seg_blocks group by segment_id), k as (select segment_id, row_number() over (order by cell) as n from f)
select r, c, n as segment_id from seg_blocks s join k on k.segment_id = s.segment_id"""


def flat_pixels(spark, d) -> DataFrame:
    """Blocks of 10 x 10 pixels, each flat, and far from its eight neighbours in every band."""
    t = fx.labels(spark, d, "seg_blocks")
    i, j = F.floor(F.col("r") / 10), F.floor(F.col("c") / 10)
    bands = F.array((100 * (i % 3) + 300 * (j % 3)).cast("double"), (100 * (j % 3) + 300 * (i % 3)).cast("double"), (150 * ((i + 2 * j) % 5)).cast("double"))
    return t.select("r", "c", bands.alias("bands"))


def add_flat(name: str, run) -> None:
    def labels_of(spark, d):
        p = flat_pixels(spark, d)
        found = run(p, fx.n_rows(p))
        return labels.relabel_first_seen(found, NCOL) if name.startswith("tile_engine") else found

    labels_of.__name__ = name
    query(FLAT_SQL, "seg_blocks")(labels_of)


for _name, _run in FLAT.items():
    add_flat(_name, _run)


def upper_rows_only(block):
    """A user's segmenter that gives up on tiles of fewer rows."""
    import numpy as np

    if block.shape[1] < TILE + BUFFER:
        raise RuntimeError("too few rows")
    return np.ones(block.shape[1:], int)


@query(GRID + f" select tile_id, 'RuntimeError: too few rows' as error from tile where r1_buf - r0_buf < {TILE + BUFFER}", "px_events")
def failed_tiles(spark, d):
    p = px(spark, d)
    return segment.failed_tiles(segment.segment_tiles(p, fx.n_rows(p), NCOL, upper_rows_only, None, TILE, BUFFER))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Scaled bands, tiles, graph-based segments merged over seams, then band means per segment."""
    p = px(spark, d)
    seg = Written(segment.fh_segmenter_tile(p, fx.n_rows(p), NCOL, tile_size=64, buffer=8, seam_thr=25.0), "flagship").df
    means = regions.segment_means(p, seg, 3).join(regions.segment_sizes(seg), "segment_id")
    return spread_out(means, "mean", 3, "mean")


QUERIES["flagship_tiled_segmentation"] = flagship
