"""Pixel tables: cleaning, masks, composites, statistics, zones."""

from pyspark.sql import functions as F

from fieldspark.functions.numbers import fixed
from fieldspark.functions import ring as R
from fieldspark.functions import spectral as S
from fieldspark.operators import irrigation as I
from fieldspark.operators import raster as RA
from fieldspark.operators import series as SE
from fieldspark.operators import spatial as SP
from fieldspark.operators import zones as Z
from fieldspark.operators.quantiles import exact_quantiles
from fieldspark.plans.registry import query
from fieldspark.plans.views import with_ring

TARGET = "1998-03-10"

# acquisition date of a scene: five days apart
_DATE = "DATE '2024-06-01' + CAST((scene % 4) * 5 AS INT)"
_BAD = "scl IN (0, 1, 3, 8, 9, 10, 11)"
_PX = f"""px AS (SELECT *, {_DATE} AS fecha, CASE WHEN red > 0 AND red <= 10000 THEN red / 10000.0::DOUBLE END AS rr, CASE WHEN nir > 0 AND nir <= 10000 THEN nir / 10000.0::DOUBLE END AS nn FROM v_pixel),
  nd AS (SELECT *, CASE WHEN NOT ({_BAD}) AND nn + rr <> 0 THEN (nn - rr) / (nn + rr) END AS ndvi FROM px)"""


def pixels(t):
    day = F.date_add(F.lit("2024-06-01").cast("date"), ((F.col("scene") % 4) * 5).cast("int"))
    return RA.with_ndvi(t.v_pixel.withColumn("fecha", day))


@query(
    "search_scenes",
    f"""WITH c AS (SELECT * FROM v_scene WHERE cloud <= 25), d AS (SELECT fecha FROM c ORDER BY abs(fecha - DATE '{TARGET}'), fecha LIMIT 1)
    SELECT scene, tile, fecha, cloud FROM c WHERE fecha = (SELECT fecha FROM d)""",
)
def search_scenes(t):
    return RA.search_scenes(t.v_scene, F.lit(TARGET).cast("date"), 25.0)


@query("best_scene", f"SELECT scene, tile, fecha, cloud FROM v_scene WHERE cloud <= 25 ORDER BY cloud, abs(fecha - DATE '{TARGET}'), scene LIMIT 1")
def best_scene(t):
    return RA.best_scene(t.v_scene, F.lit(TARGET).cast("date"), 25.0)


@query(
    "recent_scene_dates",
    """WITH c AS (SELECT * FROM v_scene WHERE cloud <= 40) SELECT scene, tile, fecha, cloud FROM (SELECT *, dense_rank() OVER (ORDER BY fecha DESC) AS r FROM c) WHERE r <= 30""",
)
def recent_scene_dates(t):
    return RA.recent_scene_dates(t.v_scene, 40.0, 30)


@query(
    "pick_scenes_per_tile",
    """SELECT scene, tile, fecha, cloud, CAST(pos AS INT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY cloud, fecha DESC, scene) AS pos FROM v_scene WHERE cloud <= 40)
       WHERE pos <= 5 ORDER BY tile, pos LIMIT 30""",
)
def pick_scenes_per_tile(t):
    return RA.pick_scenes_per_tile(t.v_scene, 40.0, 5, 30)


@query(
    "target_grid",
    """WITH e AS (SELECT min(x0) AS minx, min(y0) AS miny, max(x0 + w) AS maxx, max(y0 + h) AS maxy FROM v_plot),
    z AS (SELECT *, CAST(ceil((maxx - minx) / 1.5) AS BIGINT) AS nc, CAST(ceil((maxy - miny) / 1.5) AS BIGINT) AS nr FROM e),
    l AS (SELECT *, unnest(range(nr)) AS r FROM z), g AS (SELECT *, unnest(range(nc)) AS c FROM l)
    SELECT r, c, round(minx + (c + 0.5) * ((maxx - minx) / nc), 6) AS x, round(maxy - (r + 0.5) * ((maxy - miny) / nr), 6) AS y FROM g""",
)
def target_grid(t):
    # the extent is one row: the grid is sized from it on the driver, its cells are made by the tasks
    e = with_ring(t.v_plot).agg(F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy")).first()
    g = RA.target_grid(t.spark, *e, res=1.5)
    return g.select("r", "c", fixed("x", 6).alias("x"), fixed("y", 6).alias("y"))


@query("reflectance_clean", f"WITH {_PX} SELECT scene, tile, r, c, rr AS red, nn AS nir FROM px")
def reflectance_clean(t):
    return t.v_pixel.select("scene", "tile", "r", "c", S.reflectance(F.col("red")).alias("red"), S.reflectance(F.col("nir")).alias("nir"))


@query(
    "ndvi",
    f"""WITH {_PX} SELECT scene, tile, r, c, round(CASE WHEN nn + rr <> 0 THEN (nn - rr) / (nn + rr) END, 6) AS ndvi, round((nn - rr) / (nn + rr + 0.000001::DOUBLE), 6) AS ndvi_eps FROM px""",
)
def ndvi(t):
    red, nir = S.reflectance(F.col("red")), S.reflectance(F.col("nir"))
    return t.v_pixel.select("scene", "tile", "r", "c", fixed(S.ndvi(red, nir), 6).alias("ndvi"), fixed(S.ndvi(red, nir, 1e-6), 6).alias("ndvi_eps"))


@query(
    "exg",
    """WITH e AS (SELECT scene, tile, r, c, 2 * (nir / 6000.0::DOUBLE) - red / 3000.0::DOUBLE - scl / 12.0::DOUBLE AS exg FROM v_pixel), l AS (SELECT scene, tile, min(exg) AS lo, max(exg) AS hi FROM e GROUP BY 1, 2)
    SELECT e.scene, e.tile, r, c, round(exg, 6) AS exg, CAST(CASE WHEN hi > lo THEN floor((exg - lo) / (hi - lo) * 255) END AS INT) AS byte FROM e JOIN l ON l.scene = e.scene AND l.tile = e.tile""",
)
def exg(t):
    value = S.excess_green(F.col("red") / F.lit(3000.0), F.col("nir") / F.lit(6000.0), F.col("scl") / F.lit(12.0))
    rows = t.v_pixel.select("scene", "tile", "r", "c", value.alias("exg"))
    return RA.scale_to_byte(rows, "exg", ["scene", "tile"]).select("scene", "tile", "r", "c", fixed("exg", 6).alias("exg"), "byte")


@query(
    "cloud_mask",
    f"SELECT scene, tile, r, c, {_BAD} AS invalido, scl IN (0, 1, 3, 7, 8, 9, 10, 11) AS estricto, ((red & 1024) <> 0 OR (red & 2048) <> 0) AS qa FROM v_pixel",
)
def cloud_mask(t):
    scl = F.col("scl")
    return t.v_pixel.select(
        "scene", "tile", "r", "c", S.invalid_class(scl).alias("invalido"), S.invalid_class(scl, S.INVALID_CLASSES_STRICT).alias("estricto"), S.quality_band_cloud(F.col("red")).alias("qa")
    )


def _buffer_sql(bad, n):
    return f"""WITH b AS (SELECT *, {bad} AS bad FROM v_pixel), o AS (SELECT a AS dr, b AS dc FROM range(-{n}, {n + 1}) x(a), range(-{n}, {n + 1}) y(b)),
    m AS (SELECT DISTINCT scene, tile, r + dr AS r, c + dc AS c FROM b, o WHERE bad)
    SELECT b.scene, b.tile, b.r, b.c, m.r IS NOT NULL AS masked FROM b LEFT JOIN m ON m.scene = b.scene AND m.tile = b.tile AND m.r = b.r AND m.c = b.c"""


@query("cloud_buffer", _buffer_sql("scl = 9", 2))
def cloud_buffer(t):
    return RA.cloud_buffer(t.v_pixel, F.col("scl") == 9, 2, ["scene", "tile"]).select("scene", "tile", "r", "c", "masked")


@query(
    "cloud_buffer_water_aware",
    _buffer_sql("scl = 10", 3).replace("m.r IS NOT NULL AS masked", f"(m.r IS NOT NULL OR {_BAD.replace('scl', 'b.scl')}) AS masked"),
)
def cloud_buffer_water_aware(t):
    """Only clouds grow; the other invalid classes stay as they are."""
    grown = RA.cloud_buffer(t.v_pixel, F.col("scl") == 10, 3, ["scene", "tile"])
    return grown.select("scene", "tile", "r", "c", (F.col("masked") | S.invalid_class(F.col("scl"))).alias("masked"))


def _weight_sql(table):
    weights, default = table
    return "CASE scl " + " ".join(f"WHEN {k} THEN {v}::DOUBLE" for k, v in weights.items()) + f" ELSE {default}::DOUBLE END"


@query(
    "quality_weights",
    f"SELECT scene, tile, r, c, {_weight_sql(S.MOSAIC_WEIGHTS)} AS mosaico, {_weight_sql(S.TEMPORAL_WEIGHTS)} AS temporal, {_weight_sql(S.BEST_PIXEL_WEIGHTS)} AS mejor FROM v_pixel",
)
def quality_weights(t):
    scl = F.col("scl")
    tables = {"mosaico": S.MOSAIC_WEIGHTS, "temporal": S.TEMPORAL_WEIGHTS, "mejor": S.BEST_PIXEL_WEIGHTS}
    return t.v_pixel.select("scene", "tile", "r", "c", *[S.quality_weight(scl, w).alias(n) for n, w in tables.items()])


_MOSAIC = f"""ok AS (SELECT scene FROM nd GROUP BY 1 HAVING count(ndvi) / count(*)::DOUBLE >= 0.05),
  mo AS (SELECT tile, r, c, sum(w * ndvi) / sum(w) AS ndvi, count(*) AS n_obs FROM (SELECT *, {_weight_sql(S.MOSAIC_WEIGHTS)} AS w FROM nd WHERE ndvi IS NOT NULL AND scene IN (SELECT scene FROM ok)) GROUP BY 1, 2, 3)"""


def mosaic(t):
    return RA.weighted_composite(pixels(t))


@query("mosaic_weighted", f"WITH {_PX}, {_MOSAIC} SELECT tile, r, c, round(ndvi, 6) AS ndvi, n_obs FROM mo")
def mosaic_weighted(t):
    return mosaic(t).withColumn("ndvi", fixed("ndvi", 6))


@query(
    "composite_temporal",
    f"""WITH {_PX} SELECT tile, r, c, round(CASE WHEN sum(w) > 0 THEN sum(w * ndvi) / sum(w) END, 6) AS ndvi, count(*) AS n_obs FROM (SELECT *, {_weight_sql(S.TEMPORAL_WEIGHTS)} AS w FROM nd WHERE ndvi IS NOT NULL) GROUP BY 1, 2, 3""",
)
def composite_temporal(t):
    return RA.weighted_composite(pixels(t), S.TEMPORAL_WEIGHTS, min_share=0.0).withColumn("ndvi", fixed("ndvi", 6))


_DAYS = f"""dy AS (SELECT fecha, tile, r, c, ndvi, q AS quality, scene FROM (SELECT *, row_number() OVER (PARTITION BY fecha, tile, r, c ORDER BY q DESC, scene) AS rn FROM
    (SELECT *, {_weight_sql(S.BEST_PIXEL_WEIGHTS)} AS q FROM nd WHERE ndvi IS NOT NULL)) WHERE rn = 1)"""


@query("merge_day_best", f"WITH {_PX}, {_DAYS} SELECT fecha, tile, r, c, round(ndvi, 6) AS ndvi, quality, scene FROM dy")
def merge_day_best(t):
    return RA.merge_day_best(pixels(t)).withColumn("ndvi", fixed("ndvi", 6))


@query(
    "composite_best_pixel",
    f"""WITH {_PX}, {_DAYS}, k AS (SELECT fecha, row_number() OVER (ORDER BY fecha DESC) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT fecha FROM dy)),
    s AS (SELECT dy.*, i, quality * (1.0::DOUBLE - i / n::DOUBLE * 0.3::DOUBLE) AS score FROM dy JOIN k ON k.fecha = dy.fecha)
    SELECT tile, r, c, round(ndvi, 6) AS ndvi, round(score, 6) AS score, fecha FROM (SELECT *, row_number() OVER (PARTITION BY tile, r, c ORDER BY score DESC, i) AS rn FROM s WHERE score > 0) WHERE rn = 1""",
)
def composite_best_pixel(t):
    return RA.composite_best_pixel(RA.merge_day_best(pixels(t))).withColumns({"ndvi": fixed("ndvi", 6), "score": fixed("score", 6)})


@query(
    "composite_max_median",
    f"""WITH {_PX}, ok AS (SELECT scene FROM nd GROUP BY 1 HAVING count(ndvi) / count(*)::DOUBLE >= 0.02)
    SELECT tile, r, c, round(max(ndvi), 6) AS ndvi_max, round(quantile_cont(ndvi, 0.5), 6) AS ndvi_median FROM nd WHERE ndvi IS NOT NULL AND scene IN (SELECT scene FROM ok) GROUP BY 1, 2, 3""",
)
def composite_max_median(t):
    return RA.composite_max_median(pixels(t)).withColumns({"ndvi_max": fixed("ndvi_max", 6), "ndvi_median": fixed("ndvi_median", 6)})


@query(
    "observations_per_pixel",
    f"""WITH {_PX}, n AS (SELECT tile, r, c, count(ndvi) AS n FROM nd GROUP BY 1, 2, 3) SELECT round(avg(n), 6) AS promedio, max(n) AS maximo FROM n WHERE n > 0""",
)
def observations_per_pixel(t):
    n = pixels(t).filter("ndvi IS NOT NULL").groupBy(*RA.PIXEL).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(fixed(F.avg("n"), 6).alias("promedio"), F.max("n").alias("maximo"))


@query(
    "raster_global_stats",
    f"""WITH {_PX} SELECT scene, round(min(ndvi), 6) AS min, round(max(ndvi), 6) AS max, round(avg(ndvi), 6) AS mean, round(stddev_pop(ndvi), 6) AS std, count(ndvi) AS n_valid,
      round(100.0 * count(ndvi) / count(*), 6) AS coverage, round(quantile_cont(ndvi, 0.5), 6) AS median FROM nd GROUP BY 1""",
)
def raster_global_stats(t):
    out = RA.global_stats(pixels(t), "ndvi", ["scene"])
    return out.select("scene", "n_valid", *[fixed(c, 6).alias(c) for c in ("min", "max", "mean", "std", "coverage", "median")])


@query(
    "raster_percentiles",
    f"""WITH {_PX} SELECT count(ndvi) AS n, round(quantile_cont(ndvi, 0.0), 6) AS p0, round(quantile_cont(ndvi, 0.01), 6) AS p1, round(quantile_cont(ndvi, 0.5), 6) AS p50,
      round(quantile_cont(ndvi, 0.99), 6) AS p99, round(quantile_cont(ndvi, 1.0), 6) AS p100 FROM nd""",
)
def raster_percentiles(t):
    out = exact_quantiles(pixels(t), [], "ndvi", {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p99": 0.99, "p100": 1.0})
    return out.select("n", *[fixed(c, 6).alias(c) for c in ("p0", "p1", "p50", "p99", "p100")])


@query(
    "raster_histogram",
    f"""WITH {_PX} SELECT CAST(CASE WHEN ndvi = 1 THEN 49 ELSE floor((ndvi - (-0.2)::DOUBLE) / 1.2::DOUBLE * 50) END AS INT) AS bin, count(*) AS n FROM nd WHERE ndvi BETWEEN -0.2::DOUBLE AND 1 GROUP BY 1""",
)
def raster_histogram(t):
    return RA.histogram(pixels(t), "ndvi", -0.2, 1.0, 50)


def _class_sql(v):
    return "CASE WHEN " + v + " IS NULL THEN NULL " + " ".join(f"WHEN {v} < {u}::DOUBLE THEN {i}" for i, (u, _) in enumerate(S.INDEX_COLORS)) + f" ELSE {len(S.INDEX_COLORS)} END"


def _rgb_sql(v):
    text = "CASE WHEN " + v + " IS NULL THEN '0,0,0,0' "
    return text + " ".join(f"WHEN {v} < {u}::DOUBLE THEN '{r},{g},{b},255'" for u, (r, g, b) in S.INDEX_COLORS) + " ELSE '{},{},{},255' END".format(*S.TOP_COLOR)


@query("ndvi_classes", f"WITH {_PX} SELECT scene, tile, r, c, CAST({_class_sql('ndvi')} AS INT) AS clase, {_rgb_sql('ndvi')} AS rgba FROM nd")
def ndvi_classes(t):
    v = F.col("ndvi")
    return pixels(t).select("scene", "tile", "r", "c", S.index_class(v).alias("clase"), F.concat_ws(",", *[S.index_rgba(v)[k] for k in "rgba"]).alias("rgba"))


@query(
    "stretch_2_98",
    f"""WITH {_PX}, q AS (SELECT quantile_cont(ndvi, 0.02) AS lo, quantile_cont(ndvi, 0.98) AS hi FROM nd)
    SELECT scene, tile, r, c, round((greatest(lo, least(hi, ndvi)) - lo) / (hi - lo), 6) AS stretched FROM nd, q WHERE ndvi IS NOT NULL""",
)
def stretch_2_98(t):
    out = RA.stretch(pixels(t).filter("ndvi IS NOT NULL"))
    return out.select("scene", "tile", "r", "c", fixed("stretched", 6).alias("stretched"))


@query("window_clip", "SELECT scene, tile, r, c, red, nir FROM v_pixel WHERE r BETWEEN 10 AND 29 AND c BETWEEN 20 AND 49")
def window_clip(t):
    return t.v_pixel.filter("r BETWEEN 10 AND 29 AND c BETWEEN 20 AND 49").select("scene", "tile", "r", "c", "red", "nir")


# --- zones -----------------------------------------------------------------------------------------------------------

_CENTRE = "m AS (SELECT tile * 64 + c + 0.5 AS x, r + 0.5 AS y, ndvi FROM mo)"


def centred(t):
    """Mosaic with pixel centres in the plane of the plots: tiles stand side by side."""
    return mosaic(t).withColumns({"x": F.col("tile") * 64 + F.col("c") + 0.5, "y": F.col("r") + 0.5})


def zones(t):
    return with_ring(t.v_plot).select("id_recinto", "ring", "minx", "miny", "maxx", "maxy")


@query(
    "zonal_stats",
    f"""WITH {_PX}, {_MOSAIC}, {_CENTRE} SELECT p.id_recinto, round(avg(ndvi), 6) AS mean, round(min(ndvi), 6) AS min, round(max(ndvi), 6) AS max, round(stddev_pop(ndvi), 6) AS std, count(*) AS n
    FROM v_plot p JOIN m ON m.x > p.x0 AND m.x < p.x0 + p.w AND m.y > p.y0 AND m.y < p.y0 + p.h WHERE ndvi IS NOT NULL GROUP BY 1""",
)
def zonal_stats(t):
    out = RA.zonal_stats(centred(t), zones(t), "id_recinto", 4.0)
    return out.select("id_recinto", "n", *[fixed(c, 6).alias(c) for c in ("mean", "min", "max", "std")])


_TOUCH = "m.x + 0.5 >= p.x0 AND m.x - 0.5 <= p.x0 + p.w AND m.y + 0.5 >= p.y0 AND m.y - 0.5 <= p.y0 + p.h"


@query(
    "zonal_all_touched",
    f"""WITH {_PX}, {_MOSAIC}, {_CENTRE} SELECT p.id_recinto, round(max(ndvi), 6) AS max, round(min(ndvi), 6) AS min, round(avg(ndvi), 6) AS mean, count(*) AS n
    FROM v_plot p JOIN m ON {_TOUCH} WHERE ndvi BETWEEN -1 AND 1 GROUP BY 1""",
)
def zonal_all_touched(t):
    out = Z.touch_stats(Z.zone_totals(Z.pixel_pyramid(centred(t), 1.0), zones(t), "id_recinto"), "id_recinto")
    return out.select("id_recinto", "n", *[fixed(c, 6).alias(c) for c in ("max", "min", "mean")])


def districts(t):
    """Zones of any size: a slanted four-sided piece of land around each plot, up to a good part of the region wide."""
    x, y, k = F.col("x0"), F.col("y0"), F.col("id_recinto") % 5
    reach = F.when(k == 0, 60.0).when(k == 1, 25.0).otherwise(9.0) + F.col("w")
    ring = F.array(R.point(x - reach, y + 0.25), R.point(x + 0.25, y - reach), R.point(x + reach, y + 0.25), R.point(x + 0.25, y + reach))
    return R.with_bounds(t.v_plot.select("id_recinto", reach.alias("reach"), ring.alias("ring")))


def parted(t):
    """Plots blown up, by id: with a hole, or of two parts of which one has a hole."""
    x, y, w, h = F.col("x0"), F.col("y0"), F.col("w") * 4, F.col("h") * 4
    at = lambda u, v: R.point(x + w * u, y + h * v)
    box = lambda a, b, c, d: F.array(at(a, b), at(c, b), at(c, d), at(a, d))
    holed = F.array(box(0, 0, 1, 1), F.reverse(box(0.25, 0.25, 0.75, 0.75)))
    parts = F.when(F.col("id_recinto") % 2 == 0, F.array(holed)).otherwise(F.array(holed, F.array(box(1.5, 0, 2, 1))))
    z = t.v_plot.select("id_recinto", parts.alias("parts"))
    return R.with_bounds(z.withColumn("ring", R.parts_outline(F.col("parts")))).drop("ring")


_PARTED = """pz AS (SELECT id_recinto, x0, y0, 4 * w AS w, 4 * h AS h, id_recinto % 2 = 1 AS dos FROM v_plot)"""
_IN_PARTED = """(({x} > z.x0 AND {x} < z.x0 + z.w AND {y} > z.y0 AND {y} < z.y0 + z.h AND NOT ({x} > z.x0 + z.w / 4 AND {x} < z.x0 + z.w * 3 / 4 AND {y} > z.y0 + z.h / 4 AND {y} < z.y0 + z.h * 3 / 4))
      OR (z.dos AND {x} > z.x0 + z.w * 1.5 AND {x} < z.x0 + z.w * 2 AND {y} > z.y0 AND {y} < z.y0 + z.h))"""


@query(
    "zonal_parts",
    f"""WITH {_PX}, {_MOSAIC}, {_CENTRE}, {_PARTED} SELECT id_recinto, round(avg(ndvi), 6) AS mean, round(min(ndvi), 6) AS min, round(max(ndvi), 6) AS max, count(*) AS n
    FROM pz z JOIN m ON {_IN_PARTED.format(x='m.x', y='m.y')} WHERE ndvi IS NOT NULL GROUP BY 1""",
)
def zonal_parts(t):
    """Zones with holes and of several parts."""
    out = Z.centre_stats(Z.zone_totals(Z.pixel_pyramid(centred(t), 1.0), parted(t), "id_recinto", touch=False), "id_recinto")
    return out.select("id_recinto", "n", *[fixed(c, 6).alias(c) for c in ("mean", "min", "max")])


@query(
    "points_in_parts",
    f"""WITH {_PARTED} SELECT id_recinto, count(*) AS n, CAST(sum(estacion_id) AS BIGINT) AS suma FROM pz z JOIN v_station s ON {_IN_PARTED.format(x='(s.x + 0.125)', y='(s.y + 0.125)')} GROUP BY 1""",
)
def points_in_parts(t):
    points = t.v_station.select("estacion_id", (F.col("x") + 0.125).alias("x"), (F.col("y") + 0.125).alias("y"))
    pairs = SP.join_points_polygons(points, parted(t), 16.0, boundary="half_open", keep=["id_recinto", "estacion_id"])
    return pairs.groupBy("id_recinto").agg(F.count(F.lit(1)).alias("n"), F.sum("estacion_id").alias("suma"))


@query(
    "zonal_pyramid",
    f"""WITH {_PX}, {_MOSAIC}, {_CENTRE}, z AS (SELECT id_recinto, x0 + 0.25 AS cx, y0 + 0.25 AS cy, CASE id_recinto % 5 WHEN 0 THEN 60.0::DOUBLE WHEN 1 THEN 25.0::DOUBLE ELSE 9.0::DOUBLE END + w AS a FROM v_plot)
    SELECT id_recinto, round(avg(ndvi), 6) AS mean, round(min(ndvi), 6) AS min, round(max(ndvi), 6) AS max, round(stddev_pop(ndvi), 6) AS std, count(*) AS n
    FROM z JOIN m ON CASE WHEN m.x < cx THEN (cx - m.x) / (a + 0.25) ELSE (m.x - cx) / (a - 0.25) END + CASE WHEN m.y < cy THEN (cy - m.y) / (a + 0.25) ELSE (m.y - cy) / (a - 0.25) END < 1
    WHERE ndvi IS NOT NULL GROUP BY 1""",
)
def zonal_pyramid(t):
    """Large and small slanted zones: whole blocks from their sums, pixels along the borders."""
    out = Z.centre_stats(Z.zone_totals(Z.pixel_pyramid(centred(t), 1.0), districts(t), "id_recinto", touch=False), "id_recinto")
    return out.select("id_recinto", "n", *[fixed(c, 6).alias(c) for c in ("mean", "min", "max", "std")])


# small zones: plots shrunk so that many hold no pixel centre
_SMALL = "sp AS (SELECT id_recinto, x0 + 0.6 AS x0, y0 + 0.6 AS y0, CASE WHEN id_recinto % 2 = 0 THEN 0.3 ELSE w - 0.2 END AS w, CASE WHEN id_recinto % 2 = 0 THEN 0.3 ELSE h - 0.2 END AS h FROM v_plot)"


def small_zones(t):
    small = F.col("id_recinto") % 2 == 0
    p = t.v_plot.select(
        "id_recinto", (F.col("x0") + 0.6).alias("x0"), (F.col("y0") + 0.6).alias("y0"),
        F.when(small, F.lit(0.3)).otherwise(F.col("w") - 0.2).alias("w"), F.when(small, F.lit(0.3)).otherwise(F.col("h") - 0.2).alias("h"),
    )
    return with_ring(p).select("id_recinto", "ring", "minx", "miny", "maxx", "maxy")


@query(
    "zonal_mean_fallback",
    f"""WITH {_PX}, {_MOSAIC}, {_CENTRE}, {_SMALL},
    a AS (SELECT p.id_recinto, avg(ndvi) AS v FROM sp p JOIN m ON m.x > p.x0 AND m.x < p.x0 + p.w AND m.y > p.y0 AND m.y < p.y0 + p.h WHERE ndvi IS NOT NULL GROUP BY 1),
    b AS (SELECT p.id_recinto, avg(ndvi) AS v FROM sp p JOIN m ON {_TOUCH} WHERE ndvi BETWEEN -1 AND 1 GROUP BY 1)
    SELECT sp.id_recinto, round(coalesce(a.v, b.v), 6) AS ndvi, CASE WHEN a.v IS NOT NULL THEN 'validos' WHEN b.v IS NOT NULL THEN 'pequenos' ELSE 'vacios' END AS outcome
    FROM sp LEFT JOIN a ON a.id_recinto = sp.id_recinto LEFT JOIN b ON b.id_recinto = sp.id_recinto""",
)
def zonal_mean_fallback(t):
    totals = Z.zone_totals(Z.pixel_pyramid(centred(t), 1.0), small_zones(t), "id_recinto")
    return Z.mean_or_touched(totals, small_zones(t), "id_recinto").withColumn("ndvi", fixed("ndvi", 6))


@query(
    "sample_at_centroid",
    f"""WITH {_PX}, {_MOSAIC}, {_CENTRE} SELECT p.id_recinto, round(m.ndvi, 6) AS ndvi FROM v_plot p LEFT JOIN m ON floor(p.x0 + p.w / 2) = floor(m.x) AND floor(p.y0 + p.h / 2) = floor(m.y)""",
)
def sample_at_centroid(t):
    return RA.sample_at(centroids(t), gridded(t), 1.0, "id_recinto").withColumn("ndvi", fixed("ndvi", 6))


def centroids(t):
    return with_ring(t.v_plot).withColumn("_c", R.centroid(F.col("ring"))).select("id_recinto", F.col("_c.x").alias("x"), F.col("_c.y").alias("y"))


def gridded(t):
    return mosaic(t).select((F.col("tile").cast("long") * 64 + F.col("c")).alias("gx"), F.col("r").alias("gy"), "ndvi")


@query(
    "ndvi_fallback_chain",
    f"""WITH {_PX}, {_MOSAIC}, {_CENTRE},
    a AS (SELECT p.id_recinto, m.ndvi AS v FROM v_plot p JOIN m ON floor(p.x0 + p.w / 2) = floor(m.x) AND floor(p.y0 + p.h / 2) = floor(m.y) WHERE m.ndvi IS NOT NULL),
    b AS (SELECT p.id_recinto, avg(ndvi) AS v FROM v_plot p JOIN m ON m.x > p.x0 AND m.x < p.x0 + p.w AND m.y > p.y0 AND m.y < p.y0 + p.h WHERE ndvi IS NOT NULL GROUP BY 1),
    ln AS (SELECT id_recinto, valor_medio AS v FROM (SELECT *, row_number() OVER (PARTITION BY id_recinto ORDER BY fecha_ndvi DESC NULLS LAST, id_indice DESC) AS rn FROM v_ndvi WHERE valor_medio IS NOT NULL) WHERE rn = 1),
    c AS (SELECT p.id_recinto, avg(ln.v) AS v FROM v_plot p JOIN v_plot q ON p.x0 <= q.x0 + q.w AND p.x0 + p.w >= q.x0 AND p.y0 <= q.y0 + q.h AND p.y0 + p.h >= q.y0 AND q.id_recinto <> p.id_recinto JOIN ln ON ln.id_recinto = q.id_recinto GROUP BY 1)
    SELECT p.id_recinto, round(coalesce(a.v, b.v, c.v), 6) AS ndvi, CASE WHEN a.v IS NOT NULL THEN 'centroide' WHEN b.v IS NOT NULL THEN 'zonal' WHEN c.v IS NOT NULL THEN 'recintos' ELSE 'rango' END AS fuente_ndvi
    FROM v_plot p LEFT JOIN a ON a.id_recinto = p.id_recinto LEFT JOIN b ON b.id_recinto = p.id_recinto LEFT JOIN c ON c.id_recinto = p.id_recinto""",
)
def ndvi_fallback_chain(t):
    centre = RA.sample_at(centroids(t), gridded(t), 1.0, "id_recinto").filter("ndvi IS NOT NULL")
    zonal = RA.zonal_stats(centred(t), zones(t), "id_recinto", 4.0).select("id_recinto", F.col("mean").alias("ndvi"))
    return I.ndvi_fallback_chain(t.v_plot.select("id_recinto"), centre, zonal, neighbour_mean(t), "id_recinto").withColumn("ndvi", fixed("ndvi", 6))


def neighbour_mean(t):
    """Mean of the last index of the other plots that intersect each plot."""
    # plots of one shape have the same neighbours: shapes meet, with sums; what a plot's own rows add is taken off again
    box = ["ring", "minx", "miny", "maxx", "maxy"]
    last = SE.latest_ndvi(t.v_ndvi).select("id_recinto", "ndvi")
    right = zones(t).join(last, "id_recinto")
    shapes = right.groupBy(*box).agg(F.sum("ndvi").alias("_s"), F.count("ndvi").alias("_n"))
    around = SP.join_polygons(zones(t).select(*box).distinct(), shapes, 4.0).groupBy("ring").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    same = zones(t).select("id_recinto", "ring").distinct().join(right.select("id_recinto", F.col("ring").alias("ring_r"), "ndvi"), "id_recinto")
    own = same.filter(R.polygons_intersect(F.col("ring"), F.col("ring_r"))).groupBy("id_recinto", "ring").agg(F.sum("ndvi").alias("_os"), F.count("ndvi").alias("_on"))
    rows = zones(t).select("id_recinto", "ring").join(around, "ring").join(own, ["id_recinto", "ring"], "left")
    others = rows.withColumns({"_s": F.col("_s") - F.coalesce("_os", F.lit(0.0)), "_n": F.col("_n") - F.coalesce("_on", F.lit(0))}).filter("_n > 0 AND id_recinto IS NOT NULL")
    return others.groupBy("id_recinto").agg((F.sum("_s") / F.sum("_n")).alias("ndvi"))


@query(
    "thumbnail_outcomes",
    f"""WITH {_PX}, q AS (SELECT p.id_recinto, m.scene, count(*) AS n, count(ndvi) AS nv FROM v_plot p JOIN nd m ON m.tile * 64 + m.c + 1 > p.x0 AND m.tile * 64 + m.c < p.x0 + p.w AND m.r + 1 > p.y0 AND m.r < p.y0 + p.h GROUP BY 1, 2)
    SELECT p.id_recinto, q.scene, CASE WHEN p.id_recinto % 7 = 0 THEN 'skipped' WHEN q.n IS NULL THEN 'no_overlap' WHEN 100.0 * q.nv / q.n < 5 THEN 'insufficient_data' ELSE 'success' END AS outcome
    FROM v_plot p LEFT JOIN q ON q.id_recinto = p.id_recinto AND p.id_recinto % 7 <> 0""",
)
def thumbnail_outcomes(t):
    """Every scene that meets a plot; a plot that no scene meets, or that is drawn already, has one row without a scene."""
    shown = pixels(t).withColumns({"x": F.col("tile") * 64 + F.col("c") + 0.5, "y": F.col("r") + 0.5})
    done = t.v_plot.filter("id_recinto % 7 = 0").select("id_recinto")  # already drawn in an earlier run
    return RA.thumbnail_outcomes(zones(t), shown, done, "id_recinto", 1.0, by=["scene"])


@query(
    "image_metadata",
    f"""WITH {_PX}, {_MOSAIC}, i AS (SELECT tile, count(DISTINCT scene) AS n_scenes, min(fecha) AS first_date, max(fecha) AS last_date, min(c) AS minx, min(r) AS miny, max(c) + 1 AS maxx, max(r) + 1 AS maxy FROM nd GROUP BY 1),
    s AS (SELECT tile, min(ndvi) AS a, max(ndvi) AS b, avg(ndvi) AS m, count(ndvi) AS n_valid FROM mo GROUP BY 1)
    SELECT i.tile, n_scenes, first_date, last_date, maxx - minx AS width, maxy - miny AS height, round(a, 6) AS ndvi_min, round(b, 6) AS ndvi_max, round(m, 6) AS ndvi_mean, n_valid, true AS has_record FROM i LEFT JOIN s ON s.tile = i.tile""",
)
def image_metadata(t):
    out = RA.image_metadata(pixels(t), mosaic(t))
    return out.select(
        "tile", "n_scenes", "first_date", "last_date", "width", "height", *[fixed(c, 6).alias(c) for c in ("ndvi_min", "ndvi_max", "ndvi_mean")], "n_valid",
        F.col("record").startswith('{"tile":').alias("has_record"),
    )


def rectangle_of(t):
    """Mosaic over whole tiles: every pixel of the 64 × 64 grid, missing ones with null."""
    grid = t.v_pixel.select("tile").distinct()
    full = grid.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(63)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(63))))
    # strict classes and sparse scenes leave holes
    value = F.when(F.col("n_obs") >= 2, F.col("ndvi")).alias("ndvi")
    shown = mosaic(t).select("tile", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), value)
    return full.join(shown, ["tile", "r", "c"], "left")


@query("fill_gaps")
def fill_gaps(t):
    return RA.fill_gaps(rectangle_of(t)).withColumn("ndvi", fixed("ndvi", 6))


@query(
    "fill_mean_smooth",
    f"""WITH {_PX}, {_MOSAIC}, g AS (SELECT tile, a.r, b.c FROM (SELECT DISTINCT tile FROM v_pixel), range(64) a(r), range(64) b(c)),
    f AS (SELECT g.tile, g.r, g.c, CASE WHEN n_obs >= 2 THEN ndvi END AS v FROM g LEFT JOIN mo ON mo.tile = g.tile AND mo.r = g.r AND mo.c = g.c),
    s AS (SELECT tile, avg(v) AS m, 100.0 * count(v) / count(*) AS pct, count(v) < count(*) AS gaps FROM f GROUP BY 1),
    u AS (SELECT f.tile, r, c, coalesce(v, m) AS v, gaps FROM f JOIN s ON s.tile = f.tile WHERE pct >= 5),
    k AS (SELECT d, exp(-0.5 * d * d) / sum(exp(-0.5 * d * d)) OVER () AS w FROM range(-4, 5) o(d)),
    h AS (SELECT u.tile, u.r, u.c, sum(n.v * w) AS v FROM u, k JOIN u AS n ON n.tile = u.tile AND n.r = u.r
      AND n.c = CASE WHEN u.c + d < 0 THEN -1 - u.c - d WHEN u.c + d > 63 THEN 127 - u.c - d ELSE u.c + d END WHERE u.gaps GROUP BY 1, 2, 3),
    z AS (SELECT h.tile, h.r, h.c, sum(n.v * w) AS v FROM h, k JOIN h AS n ON n.tile = h.tile AND n.c = h.c
      AND n.r = CASE WHEN h.r + d < 0 THEN -1 - h.r - d WHEN h.r + d > 63 THEN 127 - h.r - d ELSE h.r + d END GROUP BY 1, 2, 3)
    SELECT tile, CAST(r AS INT) AS r, CAST(c AS INT) AS c, round(v, 6) AS v FROM (SELECT * FROM z UNION ALL SELECT tile, r, c, v FROM u WHERE NOT gaps)""",
)
def fill_mean_smooth(t):
    return RA.fill_mean_smooth(rectangle_of(t), ["tile"]).withColumn("v", fixed("v", 6))


@query(
    "regrid",
    f"""WITH {_PX}, {_MOSAIC}, g AS (SELECT tile, r AS tr, c AS tc, r * 0.8 + 0.3 AS fr, c * 0.8 + 0.1 AS fc FROM mo),
    k AS (SELECT g.*, floor(fr) + i AS r, floor(fc) + j AS c, (CASE WHEN i = 1 THEN fr - floor(fr) ELSE 1 - (fr - floor(fr)) END) * (CASE WHEN j = 1 THEN fc - floor(fc) ELSE 1 - (fc - floor(fc)) END) AS w FROM g, range(2) a(i), range(2) b(j))
    SELECT k.tile, k.tr, k.tc, round(sum(w * mo.ndvi) / sum(w), 6) AS ndvi FROM k JOIN mo ON mo.tile = k.tile AND mo.r = k.r AND mo.c = k.c WHERE w > 0 GROUP BY 1, 2, 3""",
)
def regrid(t):
    m = mosaic(t)
    return RA.regrid(m, regrid_targets(m), "ndvi", ["tile", "tr", "tc"]).withColumn("ndvi", fixed("ndvi", 6))


def regrid_targets(m):
    return m.select("tile", F.col("r").alias("tr"), F.col("c").alias("tc"), (F.col("r") * 0.8 + 0.3).alias("fr"), (F.col("c") * 0.8 + 0.1).alias("fc"))


@query(
    "regrid_nearest",
    f"""WITH {_PX}, {_MOSAIC} SELECT g.tile, g.r AS tr, g.c AS tc, m.n_obs FROM mo g LEFT JOIN mo m ON m.tile = g.tile AND m.r = floor(g.r * 0.8 + 0.3 + 0.5) AND m.c = floor(g.c * 0.8 + 0.1 + 0.5)""",
)
def regrid_nearest(t):
    m = mosaic(t)
    return RA.regrid(m, regrid_targets(m), "n_obs", ["tile", "tr", "tc"], method="nearest")


@query(
    "vegetation_index",
    f"""WITH {_PX}, bm AS ({_buffer_sql("scl IN (8, 9, 10)", 1)}),
    nm AS (SELECT px.*, CASE WHEN NOT (masked OR {_BAD}) AND nn + rr <> 0 THEN (nn - rr) / (nn + rr) END AS ndvi FROM px JOIN bm ON bm.scene = px.scene AND bm.tile = px.tile AND bm.r = px.r AND bm.c = px.c),
    mo AS (SELECT tile, r, c, sum(w * ndvi) / sum(w) AS ndvi FROM (SELECT *, {_weight_sql(S.MOSAIC_WEIGHTS)} AS w FROM nm WHERE ndvi IS NOT NULL) GROUP BY 1, 2, 3), {_CENTRE},
    fresh AS (SELECT p.id_recinto, DATE '2024-06-20' AS fecha_ndvi, round(avg(ndvi), 4) AS valor_medio, round(min(ndvi), 4) AS valor_min, round(max(ndvi), 4) AS valor_max
      FROM v_plot p JOIN m ON m.x > p.x0 AND m.x < p.x0 + p.w AND m.y > p.y0 AND m.y < p.y0 + p.h WHERE ndvi IS NOT NULL GROUP BY 1),
    old AS (SELECT id_recinto, fecha_ndvi, max(valor_medio) AS valor_medio, max(valor_min) AS valor_min, max(valor_max) AS valor_max FROM v_ndvi GROUP BY 1, 2)
    SELECT * FROM fresh UNION ALL SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.id_recinto = old.id_recinto AND f.fecha_ndvi = old.fecha_ndvi)""",
)
def vegetation_index(t):
    """Pixels to one index record per plot: clean, mask with a buffer, mosaic, zones, upsert into the stored series."""
    from fieldspark.operators import merge as M

    grown = RA.cloud_buffer(t.v_pixel, S.invalid_class(F.col("scl"), S.CLOUD_CLASSES), 1, ["scene", "tile"])
    clean = RA.with_ndvi(grown, F.col("masked") | S.invalid_class(F.col("scl")))
    shown = RA.weighted_composite(clean, min_share=0.0).withColumns({"x": F.col("tile") * 64 + F.col("c") + 0.5, "y": F.col("r") + 0.5})
    stats = RA.zonal_stats(shown, zones(t), "id_recinto", 4.0)
    day = F.lit("2024-06-20").cast("date")
    fresh = stats.select("id_recinto", day.alias("fecha_ndvi"), fixed("mean", 4).alias("valor_medio"), fixed("min", 4).alias("valor_min"), fixed("max", 4).alias("valor_max"))
    stored = t.v_ndvi.groupBy("id_recinto", "fecha_ndvi").agg(*[F.max(c).alias(c) for c in ("valor_medio", "valor_min", "valor_max")])
    return M.upsert(stored, fresh, ["id_recinto", "fecha_ndvi"])


