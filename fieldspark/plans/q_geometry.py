"""Geometry functions, spatial joins and polygon editing."""

import math

from pyspark.sql import functions as F

from fieldspark.functions import projection as P
from fieldspark.functions import ring as R
from fieldspark.functions.numbers import fixed
from fieldspark.operators import merge as M
from fieldspark.operators import overlay as O
from fieldspark.operators import polygons as G
from fieldspark.operators import simplify as SI
from fieldspark.operators import spatial as SP
from fieldspark.plans.q_raster import _PARTED, centroids, neighbour_mean, parted, zones
from fieldspark.plans.registry import query
from fieldspark.plans.views import with_ring
from fieldspark.session import spread

BOX = ["ring", "minx", "miny", "maxx", "maxy"]


def cells(t):
    return with_ring(t.v_cell).select("celda", *BOX)


def degrees(t):
    """Plots as small rectangles in degrees around 42° N, 4° W."""
    x, y = F.col("x0") / 100 - 6, F.col("y0") / 100 + 40.5
    p = t.v_plot.select("id_recinto", x.alias("x0"), y.alias("y0"), (F.col("w") / 1000).alias("w"), (F.col("h") / 1000).alias("h"))
    return with_ring(p).select("id_recinto", *BOX)


_DEG = "dg AS (SELECT id_recinto, x0 / 100 - 6 AS lon, y0 / 100 + 40.5 AS lat, x0 / 100 - 6 + w / 1000 AS lon2, y0 / 100 + 40.5 + h / 1000 AS lat2 FROM v_plot)"


@query("centroid", "SELECT id_recinto, round(x0 + w / 2, 6) AS cx, round(y0 + h / 2, 6) AS cy FROM v_plot")
def centroid(t):
    return centroids(t).select("id_recinto", fixed("x", 6).alias("cx"), fixed("y", 6).alias("cy"))


def _tm_sql(lon, lat, zone="30"):
    """Transverse Mercator of a zone as SQL, from the same series coefficients."""
    e, scale = P._E, P.UTM_SCALE * P._RECTIFYING
    at = lambda v: f"(0.5 * ln((1 + {v}) / (1 - {v})))"
    s = f"sin(radians({lat}))"
    q = f"({at(s)} - {e!r}::DOUBLE * {at(f'({e!r}::DOUBLE * {s})')})"
    t = f"((exp({q}) - exp(-{q})) / 2)"
    lam = f"radians({lon} + 183 - 6 * {zone})"
    return t, lam, scale


def _project_sql(source, lon="lon", lat="lat", out=("x", "y"), zone="30"):
    t, lam, scale = _tm_sql(lon, lat, zone)
    east = " + ".join(f"{a!r}::DOUBLE * cos({2 * j} * xi) * ((exp({2 * j} * eta) - exp(-{2 * j} * eta)) / 2)" for j, a in enumerate(P._FORWARD, 1))
    north = " + ".join(f"{a!r}::DOUBLE * sin({2 * j} * xi) * ((exp({2 * j} * eta) + exp(-{2 * j} * eta)) / 2)" for j, a in enumerate(P._FORWARD, 1))
    inner = f"SELECT *, atan2(tt, cos(lam)) AS xi, 0.5 * ln((1 + sin(lam) / sqrt(1 + tt * tt)) / (1 - sin(lam) / sqrt(1 + tt * tt))) AS eta FROM (SELECT *, {t} AS tt, {lam} AS lam FROM {source})"
    return f"SELECT *, 500000 + {scale!r}::DOUBLE * (eta + {east}) AS {out[0]}, {scale!r}::DOUBLE * (xi + {north}) AS {out[1]} FROM ({inner})"


#: Plots spread over ten zones of both hemispheres.
_WIDE = "wd AS (SELECT *, CAST(floor((lon + 180) / 6) + 1 AS INT) AS zona FROM (SELECT id_recinto, x0 / 8 - 12 AS lon, y0 / 4 - 30 AS lat FROM v_plot))"


@query(
    "project_points",
    f"""WITH {_WIDE} SELECT id_recinto, round(x, 3) AS x, round(y + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END, 3) AS y, zona, CAST(CASE WHEN lat < 0 THEN 32700 ELSE 32600 END + zona AS INT) AS epsg
    FROM ({_project_sql('wd', zone='zona')})""",
)
def project_points(t):
    lon, lat = F.col("x0") / 8 - 12, F.col("y0") / 4 - 30
    d = t.v_plot.select("id_recinto", lon.alias("lon"), lat.alias("lat"), P.utm_zone(lon).alias("zona"))
    d = d.withColumn("_p", P.to_utm(F.col("lon"), F.col("lat"), F.col("zona")))
    return d.select("id_recinto", fixed("_p.x", 3).alias("x"), fixed("_p.y", 3).alias("y"), "zona", P.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"))


@query("project_points_back", f"WITH {_DEG} SELECT id_recinto, round(lon, 7) AS lon, round(lat, 7) AS lat FROM dg")
def project_points_back(t):
    """There and back in zone 30, and through Web Mercator, gives the same position."""
    there = degrees(t).withColumn("_p", P.to_utm(F.col("minx"), F.col("miny"), F.lit(30)))
    back = there.withColumn("_g", P.from_utm(F.col("_p.x"), F.col("_p.y"), F.lit(30)))
    web = back.withColumn("_w", P.to_web_mercator(F.col("_g.x"), F.col("_g.y"))).withColumn("_g", P.from_web_mercator(F.col("_w.x"), F.col("_w.y")))
    return web.select("id_recinto", fixed("_g.x", 7).alias("lon"), fixed("_g.y", 7).alias("lat"))


@query(
    "project_zone_of_set",
    f"""WITH {_DEG} SELECT CAST(floor((quantile_cont(lon, 0.5) + 180) / 6) + 1 AS INT) AS zona, CAST(32600 + floor((quantile_cont(lon, 0.5) + 180) / 6) + 1 AS INT) AS epsg FROM dg""",
)
def project_zone_of_set(t):
    from fieldspark.operators.quantiles import exact_quantiles

    d = degrees(t)
    mid = exact_quantiles(d, [], "minx", {"lon": 0.5}).drop("n")
    return mid.select(P.utm_zone(F.col("lon")).alias("zona"), P.utm_epsg(F.col("lon"), F.lit(42.0)).alias("epsg"))


@query(
    "area_planar",
    f"""WITH {_DEG}, c AS (SELECT id_recinto, k, CASE WHEN k IN (0, 3) THEN lon ELSE lon2 END AS lon, CASE WHEN k < 2 THEN lat ELSE lat2 END AS lat FROM dg, range(4) r(k)),
    p AS ({_project_sql('c')}), w AS (SELECT id_recinto, max(CASE WHEN k = 0 THEN x END) x0, max(CASE WHEN k = 0 THEN y END) y0, max(CASE WHEN k = 1 THEN x END) x1, max(CASE WHEN k = 1 THEN y END) y1,
      max(CASE WHEN k = 2 THEN x END) x2, max(CASE WHEN k = 2 THEN y END) y2, max(CASE WHEN k = 3 THEN x END) x3, max(CASE WHEN k = 3 THEN y END) y3 FROM p GROUP BY 1)
    SELECT id_recinto, round(abs((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0) + (x2 - x0) * (y3 - y0) - (x3 - x0) * (y2 - y0)) / 2 / 10000, 3) AS ha FROM w""",
)
def area_planar(t):
    return degrees(t).select("id_recinto", fixed(R.area(P.ring_to_utm(F.col("ring"), F.lit(30))) / 10000, 3).alias("ha"))


_R, _E = P.AUTHALIC_RADIUS, P._E
_POLE = (1 - _E**2) * (1 / (1 - _E**2) + math.atanh(_E) / _E)


def _authalic_sql(lat):
    s = f"sin(radians({lat}))"
    es = f"({_E!r}::DOUBLE * {s})"
    return f"({1 - _E**2!r}::DOUBLE * ({s} / (1 - {_E**2!r}::DOUBLE * {s} * {s}) + 0.5 * ln((1 + {es}) / (1 - {es})) / {_E!r}::DOUBLE) / {_POLE!r}::DOUBLE)"


@query(
    "area_geography",
    f"WITH {_DEG} SELECT id_recinto, round({_R * _R!r}::DOUBLE * radians(lon2 - lon) * ({_authalic_sql('lat2')} - {_authalic_sql('lat')}) / 10000, 3) AS ha FROM dg",
)
def area_geography(t):
    return degrees(t).select("id_recinto", fixed(P.area_geography(F.col("ring")) / 10000, 3).alias("ha"))


@query("area_degrees_approx", f"WITH {_DEG} SELECT id_recinto, round((lon2 - lon) * (lat2 - lat) * 111320 * 111320, 2) AS m2 FROM dg")
def area_degrees_approx(t):
    return degrees(t).select("id_recinto", fixed(P.area_degrees_approx(F.col("ring")), 2).alias("m2"))


@query(
    "area_web_mercator",
    f"WITH {_DEG} SELECT id_recinto, round(6378137.0::DOUBLE * 6378137.0::DOUBLE * radians(lon2 - lon) * (ln(tan(pi() / 4 + radians(lat2) / 2)) - ln(tan(pi() / 4 + radians(lat) / 2))) / 10000, 3) AS ha FROM dg",
)
def area_web_mercator(t):
    return degrees(t).select("id_recinto", fixed(P.area_web_mercator(F.col("ring")) / 10000, 3).alias("ha"))


def _bbox_sql():
    side = "SELECT id_recinto, lon + (lon2 - lon) * k / 22.0 AS lon, {lat} AS lat FROM dg, range(23) r(k)"
    up = "SELECT id_recinto, {lon} AS lon, lat + (lat2 - lat) * k / 22.0 AS lat FROM dg, range(23) r(k)"
    return " UNION ALL ".join([side.format(lat="lat"), side.format(lat="lat2"), up.format(lon="lon"), up.format(lon="lon2")])


@query(
    "bbox_reproject",
    f"WITH {_DEG}, b AS ({_bbox_sql()}) SELECT id_recinto, round(min(x), 2) AS minx, round(min(y), 2) AS miny, round(max(x), 2) AS maxx, round(max(y), 2) AS maxy FROM ({_project_sql('b')}) GROUP BY 1",
)
def bbox_reproject(t):
    d = spread(degrees(t).select("id_recinto", "minx", "miny", "maxx", "maxy"))
    out = P.bbox_reproject(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")], F.lit(30))
    return d.select("id_recinto", out.alias("_b")).select("id_recinto", *[fixed(f"_b.{n}", 2).alias(n) for n in ("minx", "miny", "maxx", "maxy")])


_IN = "c.x0 + c.w / 2 {lt} p.x0 + p.w AND c.x0 + c.w / 2 {gt} p.x0 AND c.y0 + c.h / 2 {lt} p.y0 + p.h AND c.y0 + c.h / 2 {gt} p.y0"
_WITHIN, _HITS = _IN.format(lt="<", gt=">"), _IN.format(lt="<=", gt=">=")


def cell_points(t):
    c = with_ring(t.v_cell).withColumn("_c", R.centroid(F.col("ring")))
    return c.select("celda", F.col("_c.x").alias("x"), F.col("_c.y").alias("y"))


@query("point_in_polygon", f"SELECT c.celda, p.id_recinto, {_WITHIN} AS dentro FROM v_cell c JOIN v_plot p ON {_HITS}")
def point_in_polygon(t):
    pairs = SP.join_points_polygons(cell_points(t), zones(t), 4.0)
    return pairs.select("celda", "id_recinto", R.contains_point(F.col("ring"), F.col("x"), F.col("y"), "exclude").alias("dentro"))


@query("spatial_join_point_in_polygon", f"SELECT c.celda, min(p.id_recinto) AS id_recinto FROM v_cell c LEFT JOIN v_plot p ON {_WITHIN} GROUP BY 1")
def spatial_join_point_in_polygon(t):
    return SP.point_in_polygon_first(cell_points(t), zones(t), 4.0, "celda", "id_recinto").select("celda", "id_recinto")


@query(
    "spatial_join_smallest_containing",
    f"""SELECT celda, id_recinto, area FROM (SELECT c.celda, p.id_recinto, p.w * p.h AS area, row_number() OVER (PARTITION BY c.celda ORDER BY p.w * p.h, p.id_recinto) AS rn FROM v_cell c JOIN v_plot p ON {_HITS}) WHERE rn = 1""",
)
def spatial_join_smallest_containing(t):
    return SP.smallest_containing(cell_points(t), zones(t), 4.0, "celda", "id_recinto")


_MEET = "p.x0 <= c.x0 + c.w AND p.x0 + p.w >= c.x0 AND p.y0 <= c.y0 + c.h AND p.y0 + p.h >= c.y0"


@query("polygons_intersect", f"SELECT p.id_recinto, c.celda FROM v_plot p JOIN v_cell c ON {_MEET}")
def polygons_intersect(t):
    return SP.join_polygons(zones(t), cells(t), 4.0).select("id_recinto", "celda")


@query(
    "spatial_join_intersects_mean",
    """WITH ln AS (SELECT id_recinto, valor_medio AS v FROM (SELECT *, row_number() OVER (PARTITION BY id_recinto ORDER BY fecha_ndvi DESC NULLS LAST, id_indice DESC) AS rn FROM v_ndvi WHERE valor_medio IS NOT NULL) WHERE rn = 1)
    SELECT p.id_recinto, round(avg(ln.v), 6) AS ndvi FROM v_plot p JOIN v_plot q ON p.x0 <= q.x0 + q.w AND p.x0 + p.w >= q.x0 AND p.y0 <= q.y0 + q.h AND p.y0 + p.h >= q.y0 AND q.id_recinto <> p.id_recinto
    JOIN ln ON ln.id_recinto = q.id_recinto GROUP BY 1""",
)
def spatial_join_intersects_mean(t):
    return neighbour_mean(t).select("id_recinto", fixed("ndvi", 6).alias("ndvi"))


_OVER = "greatest(0, least(p.x0 + p.w, c.x0 + c.w) - greatest(p.x0, c.x0)) * greatest(0, least(p.y0 + p.h, c.y0 + c.h) - greatest(p.y0, c.y0))"


@query("intersection_area", f"SELECT p.id_recinto, c.celda, round({_OVER}, 6) AS overlap FROM v_plot p JOIN v_cell c ON {_MEET}")
def intersection_area(t):
    pairs = SP.join_polygons(zones(t), cells(t), 4.0).select("id_recinto", "celda", "ring", "ring_r")
    return G.intersection_area(pairs, convex=True).withColumn("overlap", fixed("overlap", 6))


def _common(x0, x1, y0, y1):
    return f"greatest(0, least({x1}, c.x0 + c.w) - greatest({x0}, c.x0)) * greatest(0, least({y1}, c.y0 + c.h) - greatest({y0}, c.y0))"


_PARTS_OVER = (
    _common("z.x0", "z.x0 + z.w", "z.y0", "z.y0 + z.h") + " - " + _common("z.x0 + z.w / 4", "z.x0 + z.w * 3 / 4", "z.y0 + z.h / 4", "z.y0 + z.h * 3 / 4")
    + " + CASE WHEN z.dos THEN " + _common("z.x0 + z.w * 1.5", "z.x0 + z.w * 2", "z.y0", "z.y0 + z.h") + " ELSE 0 END"
)


@query(
    "intersection_area_parts",
    f"""WITH {_PARTED} SELECT z.id_recinto, c.celda, round({_PARTS_OVER}, 6) AS overlap FROM pz z JOIN v_cell c
    ON z.x0 <= c.x0 + c.w AND z.x0 + CASE WHEN z.dos THEN 2 ELSE 1 END * z.w >= c.x0 AND z.y0 <= c.y0 + c.h AND z.y0 + z.h >= c.y0""",
)
def intersection_area_parts(t):
    """Common area of cells with geometries that have holes and several parts."""
    left = parted(t).withColumn("ring", R.rectangle(*[F.col(c) for c in BOX[1:]]))
    right = with_ring(t.v_cell).select("celda", *BOX, F.array(F.array("ring")).alias("parts_r"))
    left, right = left.withColumn("boxes", G.lone_boxes("id_recinto", "parts")), right.withColumn("boxes_r", G.lone_boxes("celda", "parts_r"))
    pairs = SP.join_polygons(left, right, 16.0, touching=False).select("id_recinto", "celda", "parts", "parts_r", "boxes", "boxes_r")
    return G.parts_intersection_area(pairs, ["id_recinto", "celda"], convex=True, boxes=("boxes", "boxes_r")).withColumn("overlap", fixed("overlap", 6))


@query(
    "spatial_join_max_overlap",
    f"""SELECT id_recinto, celda, overlap FROM (SELECT p.id_recinto, c.celda, round({_OVER}, 6) AS overlap, row_number() OVER (PARTITION BY p.id_recinto ORDER BY {_OVER} DESC, c.celda) AS rn
    FROM v_plot p JOIN v_cell c ON {_MEET}) WHERE rn = 1""",
)
def spatial_join_max_overlap(t):
    return G.max_overlap(zones(t), cells(t), "id_recinto", "celda", 4.0, convex=True).withColumn("overlap", fixed("overlap", 6))


_RECT_D = "sqrt(pow(greatest(p.x0 - qx, 0, qx - p.x0 - p.w), 2) + pow(greatest(p.y0 - qy, 0, qy - p.y0 - p.h), 2))"


@query(
    "pick_best_feature",
    f"""WITH f AS (SELECT p.id_recinto % 200 AS consulta, p.id_recinto AS pos, {_RECT_D} AS d, p.id_recinto % 17 = 0 AS sin_geom FROM (SELECT *, CAST((id_recinto % 200 * 7) % 400 AS DOUBLE) + 0.25 AS qx, CAST((id_recinto % 200 * 5) % 300 AS DOUBLE) + 0.25 AS qy FROM v_plot) p),
    g AS (SELECT *, CASE WHEN sin_geom THEN NULL ELSE d END AS dd FROM f)
    SELECT consulta, pos, round(coalesce(dd, -1), 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY consulta ORDER BY NOT coalesce(dd <= 0.00005, false), CASE WHEN dd <= 0.00005 THEN 0 ELSE coalesce(dd, 1e300) END, pos) AS rn FROM g) WHERE rn = 1""",
)
def pick_best_feature(t):
    """Answers of a map service: each query point has several features, some without geometry."""
    q = F.col("id_recinto") % 200
    feats = with_ring(t.v_plot).select(
        q.alias("consulta"), F.col("id_recinto").alias("pos"), (((q * 7) % 400).cast("double") + 0.25).alias("x"), (((q * 5) % 300).cast("double") + 0.25).alias("y"),
        F.when(F.col("id_recinto") % 17 == 0, None).otherwise(F.col("ring")).alias("ring"),
    )
    return SP.pick_best_feature(feats, "consulta").select("consulta", "pos", fixed("distance", 6).alias("distance"))


@query(
    "covered_by_tolerance",
    f"""SELECT c.celda, p.id_recinto, c.x0 >= p.x0 - 1.0001 AND c.x0 + c.w <= p.x0 + p.w + 1.0001 AND c.y0 >= p.y0 AND c.y0 + c.h <= p.y0 + p.h AS estricto_xy,
      greatest({', '.join('sqrt(pow(greatest(p.x0 - (' + x + '), 0, (' + x + ') - p.x0 - p.w), 2) + pow(greatest(p.y0 - (' + y + '), 0, (' + y + ') - p.y0 - p.h), 2))' for x in ('c.x0', 'c.x0 + c.w') for y in ('c.y0', 'c.y0 + c.h'))}) <= 1.0001 AS cubierta
    FROM v_plot p JOIN v_cell c ON {_MEET}""".replace("c.x0 >= p.x0 - 1.0001 AND c.x0 + c.w <= p.x0 + p.w + 1.0001 AND c.y0 >= p.y0 AND c.y0 + c.h <= p.y0 + p.h AS estricto_xy,", ""),
)
def covered_by_tolerance(t):
    box = R.is_box(F.col("ring"))
    pairs = SP.join_polygons(zones(t).withColumn("caja", box), cells(t).withColumn("caja_r", box), 4.0)
    inside = R.covered_by_tolerance(F.col("ring_r"), F.col("ring"), 1.0001, F.col("caja") & F.col("caja_r"))
    return pairs.select("celda", "id_recinto", inside.alias("cubierta"))


def pieces(t):
    """Three strips per plot; in every fifth plot the second strip is wider and overlaps, in every seventh it sticks out."""
    third = F.col("w") / 4
    pos = F.col("pos")
    wide = F.when((pos == 2) & (F.col("id_recinto") % 5 == 0), third * 1.5).when(pos == 3, third * 2).otherwise(third)
    out = F.when((pos == 2) & (F.col("id_recinto") % 7 == 0), F.lit(0.5)).otherwise(F.lit(0.0))
    p = t.v_plot.withColumn("pos", F.explode(F.sequence(F.lit(1), F.lit(3)))).select(
        "id_recinto", "pos", (F.col("id_recinto") * 10 + pos).alias("id_subparcela"),
        F.when(pos == 1, F.lit("norte")).otherwise(F.lit(" ")).alias("nombre"),
        (F.col("x0") + (pos - 1) * third).alias("x0"), F.col("y0"), wide.alias("w"), (F.col("h") + out).alias("h"),
    )
    return with_ring(p).select("id_recinto", "pos", "id_subparcela", "nombre", *BOX)


def strips(t):
    """The same three strips without overlap."""
    third = F.col("w") / 4
    pos = F.col("pos")
    p = t.v_plot.withColumn("pos", F.explode(F.sequence(F.lit(1), F.lit(3)))).select(
        "id_recinto", "pos", (F.col("id_recinto") * 10 + pos).alias("id_subparcela"), F.concat(F.lit("P"), pos.cast("string")).alias("nombre"),
        (F.col("x0") + (pos - 1) * third).alias("x0"), "y0", F.when(pos == 3, third * 2).otherwise(third).alias("w"), "h",
    )
    return with_ring(p).select("id_recinto", "pos", "id_subparcela", "nombre", *BOX)


@query(
    "validate_subparcels",
    """SELECT id_recinto, CAST(k AS INT) AS pos, CASE WHEN k = 1 THEN 'norte' ELSE 'Subparcela ' || CAST(k AS VARCHAR) END AS nombre, true AS ok_valida, true AS ok_simple,
      NOT (k = 2 AND id_recinto % 7 = 0) AS ok_dentro, NOT (k IN (2, 3) AND id_recinto % 5 = 0) AS ok_sin_solape,
      round(w / 4 * CASE WHEN k = 2 AND id_recinto % 5 = 0 THEN 1.5 WHEN k = 3 THEN 2 ELSE 1 END * (h + CASE WHEN k = 2 AND id_recinto % 7 = 0 THEN 0.5 ELSE 0 END) / 10000, 2) AS superficie_ha
    FROM v_plot, range(1, 4) r(k)""",
)
def validate_subparcels(t):
    return G.validate_subplots(pieces(t).select("id_recinto", "pos", "nombre", "ring"), zones(t), 4.0)


@query(
    "replace_subparcels",
    """WITH s AS (SELECT o_custkey AS id_recinto, o_orderkey AS id FROM orders), n AS (SELECT 2 * c_custkey AS id_recinto, -c_custkey AS id FROM customer)
    SELECT * FROM s WHERE id_recinto NOT IN (SELECT id_recinto FROM n) UNION ALL SELECT * FROM n""",
)
def replace_subparcels(t):
    """All stored pieces; new ones come for every second plot, and for some that had none."""
    stored = t.orders.select(F.col("o_custkey").alias("id_recinto"), F.col("o_orderkey").alias("id"))
    fresh = t.customer.select((2 * F.col("c_custkey")).alias("id_recinto"), (-F.col("c_custkey")).alias("id"))
    return M.replace_groups(stored, fresh, "id_recinto")


@query(
    "clean_rings",
    "SELECT id_recinto, CAST(5 AS INT) AS vertices, w * h AS area_con_signo, true AS cerrado, true AS simple FROM v_plot",
)
def clean_rings(t):
    """Clockwise, open rings with a repeated vertex become closed, anticlockwise and clean."""
    broken = F.concat(F.reverse("ring"), F.slice(F.reverse("ring"), -1, 1))
    rows = zones(t).select("id_recinto", R.make_valid(broken).alias("ring"))
    return rows.select(
        "id_recinto", F.size("ring").alias("vertices"), R.signed_area(F.col("ring")).alias("area_con_signo"),
        (F.element_at("ring", 1) == F.element_at("ring", -1)).alias("cerrado"), R.is_simple(F.col("ring")).alias("simple"),
    )


def broken_rings(t):
    """Plots drawn badly, by id: a bow-tie with unequal lobes, a side that goes out and back, a loop inside a loop, two triangles that touch."""
    x, y, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    at = lambda *points: F.array(*[R.point(x + w * p, y + h * q) for p, q in points])
    outer = ((0, 0), (1, 0), (1, 1), (0, 1))
    inner = ((0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75))
    k = F.col("id_recinto") % 4
    ring = (
        F.when(k == 0, at((0, 0), (1, 1), (1, 0), (0, 0.5)))
        .when(k == 1, at((0, 0), (1, 0), (2, 0), (1, 0), (1, 1), (0, 1)))
        .when(k == 2, at(*outer, (0, 0), *inner, (0.25, 0.25)))
        .otherwise(at((0, 0), (1, 0), (0.5, 0.5), (1, 1), (0, 1), (0.5, 0.5), (0.5, 0.5)))
    )
    return spread(t.v_plot.select("id_recinto", "x0", "y0", "w", "h")).select("id_recinto", "w", "h", ring.alias("ring"))


_LOBES = "CASE id_recinto % 4 WHEN 0 THEN w * h / 3 WHEN 1 THEN w * h WHEN 2 THEN w * h * 0.75 ELSE w * h / 4 END"


@query(
    "make_valid",
    f"""SELECT id_recinto, round({_LOBES} + CASE id_recinto % 4 WHEN 0 THEN w * h / 12 WHEN 3 THEN w * h / 4 ELSE 0 END, 4) AS area,
      CAST(CASE id_recinto % 4 WHEN 0 THEN 2 WHEN 3 THEN 2 ELSE 1 END AS INT) AS partes, CAST(CASE id_recinto % 4 WHEN 2 THEN 1 ELSE 0 END AS INT) AS huecos, true AS simple FROM v_plot""",
)
def make_valid(t):
    """Self-crossings become vertices of separate parts, loops holes, spikes nothing; every ring is simple."""
    out = O.repair(broken_rings(t).select("id_recinto", "ring"))
    simple = F.forall("parts", lambda part: F.forall(part, R.is_simple))
    holes = F.aggregate("parts", F.lit(0), lambda n, part: n + F.size(part) - 1)
    return out.select("id_recinto", fixed("area", 4).alias("area"), F.col("n_parts").alias("partes"), holes.alias("huecos"), simple.alias("simple"))


@query("largest_part", f"SELECT id_recinto, round({_LOBES}, 4) AS area, CAST(CASE id_recinto % 4 WHEN 2 THEN 2 ELSE 1 END AS INT) AS anillos FROM v_plot")
def largest_part(t):
    """Largest part of what each badly drawn plot comes to, with its holes."""
    first = F.get("parts", F.lit(0))
    out = O.repair(broken_rings(t).select("id_recinto", "ring"))
    return out.select("id_recinto", F.round(R.parts_area(F.array(first)), 4).alias("area"), F.size(first).alias("anillos"))


@query("clip_polygons", f"SELECT p.id_recinto, c.celda, round({_OVER}, 6) AS area, {_OVER} > 0 AS recortado FROM v_plot p JOIN v_cell c ON {_MEET} WHERE {_OVER} > 0")
def clip_polygons(t):
    pairs = SP.join_polygons(zones(t), cells(t), 4.0).select("id_recinto", "celda", "ring", "ring_r")
    out = G.clip_polygons(pairs).filter("clipped")
    return out.select("id_recinto", "celda", fixed(R.area(F.col("ring")), 6).alias("area"), F.col("clipped").alias("recortado"))


def cut_lines(t):
    """One upright line through every plot, drawn over its middle half."""
    p = t.v_plot
    x = F.col("x0") + F.col("w") / 4
    return p.select(
        F.col("id_recinto").alias("line_id"), x.alias("ax"), (F.col("y0") + F.col("h") / 4).alias("ay"), x.alias("bx"), (F.col("y0") + F.col("h") * 3 / 4).alias("by")
    )


@query(
    "split_polygons_by_lines",
    """WITH ln AS (SELECT x0 + w / 4 AS lx, y0 + h / 4 AS ly0, y0 + h * 3 / 4 AS ly1 FROM v_plot),
    ht AS (SELECT p.id_recinto, ln.lx FROM v_plot p JOIN ln ON ln.lx > p.x0 AND ln.lx < p.x0 + p.w JOIN range(21) r(k) ON ln.ly0 + (ln.ly1 - ln.ly0) * k / 20.0 > p.y0 AND ln.ly0 + (ln.ly1 - ln.ly0) * k / 20.0 < p.y0 + p.h
      GROUP BY p.id_recinto, p.x0, p.y0, ln.lx, ln.ly0, ln.ly1 HAVING count(*) >= 2)
    SELECT p.id_recinto, 1 + coalesce(h.n, 0) AS partes, p.w * p.h AS area FROM v_plot p LEFT JOIN (SELECT id_recinto, count(DISTINCT lx) AS n FROM ht GROUP BY 1) h ON h.id_recinto = p.id_recinto""",
)
def split_polygons_by_lines(t):
    parts = G.split_by_lines(zones(t), cut_lines(t), "id_recinto", 4.0, min_area=0.0001)
    return parts.groupBy("id_recinto").agg(F.count(F.lit(1)).alias("partes"), fixed(F.sum("area"), 6).alias("area"))


@query(
    "dissolve_adjacent",
    "SELECT id_recinto, 'P1 + P2 + P3' AS nombre, w * h AS area, 3 AS n_piezas, CAST(1 AS INT) AS n_rings, 'ok' AS status FROM v_plot",
)
def dissolve_adjacent(t):
    out = G.dissolve_adjacent(strips(t).select("id_recinto", "pos", "nombre", "ring"), "id_recinto")
    return out.select("id_recinto", "nombre", fixed("area", 6).alias("area"), F.col("n_piezas").cast("int").alias("n_piezas"), "n_rings", "status")


@query("dissolve_strips", "SELECT id_recinto, w * h AS area, 3::BIGINT AS n_partes, x0 AS minx, y0 AS miny, x0 + w AS maxx, y0 + h AS maxy FROM v_plot")
def dissolve_strips(t):
    """Parts that are known not to overlap."""
    out = G.dissolve_union(strips(t).select("id_recinto", "ring"), ["id_recinto"])
    return out.withColumn("area", fixed("area", 9))


def border_length(parts):
    length = lambda r: F.aggregate(R.edges(r), F.lit(0.0), lambda s, e: s + F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]))
    return F.aggregate(F.flatten(parts), F.lit(0.0), lambda s, r: s + length(r))


@query(
    "dissolve_union",
    """WITH px AS (SELECT DISTINCT municipio, x, y FROM (SELECT municipio, y0, h, unnest(range(CAST(x0 AS BIGINT), CAST(x0 + w AS BIGINT))) AS x FROM v_plot), LATERAL (SELECT unnest(range(CAST(y0 AS BIGINT), CAST(y0 + h AS BIGINT))) AS y)),
    nb AS (SELECT p.municipio, count(*) AS n FROM px p JOIN px q ON p.municipio = q.municipio AND ((q.x = p.x + 1 AND q.y = p.y) OR (q.x = p.x AND q.y = p.y + 1)) GROUP BY 1)
    SELECT p.municipio, CAST(count(*) AS DOUBLE) AS area, CAST(4 * count(*) - 2 * coalesce(min(nb.n), 0) AS DOUBLE) AS perimetro, CAST(0 AS INT) AS abiertos FROM px p LEFT JOIN nb ON nb.municipio = p.municipio GROUP BY 1""",
)
def dissolve_union(t):
    """Plots of each municipality, which overlap anyhow: area and border of the union geometry, holes included, against a count of unit squares."""
    out = O.dissolve(zones(t).join(t.v_plot.select("id_recinto", "municipio"), "id_recinto").select("municipio", F.array("ring").alias("rings")), ["municipio"], 16.0)
    return out.select("municipio", fixed("area", 6).alias("area"), F.round(border_length(F.col("parts")), 6).alias("perimetro"), F.col("n_open").alias("abiertos"))


@query(
    "dissolve_overlapping",
    """SELECT id_recinto, round(w * h + CASE WHEN id_recinto % 7 = 0 THEN 0.5 * w / 4 * CASE WHEN id_recinto % 5 = 0 THEN 1.5 ELSE 1 END ELSE 0 END, 6) AS area, CAST(1 AS INT) AS partes,
      CAST(CASE WHEN id_recinto % 7 = 0 THEN 8 ELSE 4 END AS INT) AS vertices FROM v_plot""",
)
def dissolve_overlapping(t):
    """Strips of a plot of which some overlap and some stick out."""
    out = O.dissolve(pieces(t).select("id_recinto", F.array("ring").alias("rings")), ["id_recinto"], 4.0)
    return out.select("id_recinto", fixed("area", 6).alias("area"), F.col("n_parts").alias("partes"), F.size(F.get(F.get("parts", F.lit(0)), F.lit(0))).alias("vertices"))


@query(
    "dissolve_with_gaps",
    """SELECT id_recinto, 'P1 + P2' AS nombre, CASE id_recinto % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'closed' ELSE 'rejected' END AS status, CAST(CASE id_recinto % 3 WHEN 2 THEN 2 ELSE 1 END AS INT) AS partes,
      CASE id_recinto % 3 WHEN 1 THEN true ELSE false END AS rellena FROM v_plot""",
)
def dissolve_with_gaps(t):
    """Two pieces of each plot, drawn in metres, that touch, or lie 2 m or 7 m apart: gaps below 6 m are closed."""
    p = t.v_plot.withColumn("pos", F.explode(F.array(F.lit(1), F.lit(2))))
    gap = F.when(F.col("id_recinto") % 3 == 0, 0.0).when(F.col("id_recinto") % 3 == 1, 2.0).otherwise(7.0)
    side = F.col("w") * 10
    two = with_ring(p.select(
        "id_recinto", "pos", F.concat(F.lit("P"), F.col("pos").cast("string")).alias("nombre"), side.alias("lado"),
        (F.col("x0") * 40 + F.when(F.col("pos") == 2, side + gap).otherwise(0.0)).alias("x0"), (F.col("y0") * 40).alias("y0"), side.alias("w"), (F.col("h") * 10).alias("h"),
    ))
    out = O.merge_pieces(two.select("id_recinto", "pos", "nombre", "ring"), "id_recinto", 64.0)
    whole = two.groupBy("id_recinto").agg(F.sum(F.col("w") * F.col("h")).alias("suma"))
    return out.join(whole, "id_recinto").select("id_recinto", "nombre", "status", F.size("parts").alias("partes"), (F.col("area") > F.col("suma") + 1e-6).alias("rellena"))


@query(
    "simplify_polygons",
    "SELECT id_recinto, w * h AS area, CAST(8 AS INT) AS n_before, CAST(4 AS INT) AS n_after FROM v_plot",
)
def simplify_polygons(t):
    """Rectangles with a vertex in the middle of every side lose it again."""
    mid = lambda e: F.array(e["a"], R.point((e["a"]["x"] + e["b"]["x"]) / 2, (e["a"]["y"] + e["b"]["y"]) / 2))
    dense = zones(t).select("id_recinto", F.flatten(F.transform(R.edges(F.col("ring")), mid)).alias("ring"))
    out = G.simplify_polygons(dense)
    return out.select("id_recinto", fixed(R.area(F.col("ring")), 9).alias("area"), "n_before", "n_after")


@query(
    "simplify_shared_borders",
    """SELECT 2 * id_recinto + k AS pieza, round(w * h / 2, 6) AS area, CAST(7 AS INT) AS n_before, CAST(4 AS INT) AS n_after FROM v_plot, range(2) r(k)""",
)
def simplify_shared_borders(t):
    """Each plot, moved to a place of its own, as two pieces with a crooked border between them, which both draw in their own direction."""
    k = F.col("id_recinto")
    x, y = (k % 1000) * 10.0, F.floor(k / 1000) * 10.0
    w, h = F.col("w"), F.col("h")
    at = lambda p, q, off=0.0: R.point(x + w * p + off, y + h * q)
    crooked = [at(0.5, 0.25, 0.0078125), at(0.5, 0.5, -0.0078125), at(0.5, 0.75, 0.0078125)]
    left = F.array(at(0, 0), at(0.5, 0), *crooked, at(0.5, 1), at(0, 1))
    right = F.array(at(0.5, 1), *reversed(crooked), at(0.5, 0), at(1, 0), at(1, 1))
    both = t.v_plot.select(F.posexplode(F.array(left, right)).alias("k", "ring"), "id_recinto").select((2 * F.col("id_recinto") + F.col("k")).alias("pieza"), "ring")
    out = SI.simplify_together(both, 0.05, 2.0)
    return out.select("pieza", fixed(R.area(F.col("ring")), 6).alias("area"), "n_before", "n_after")


@query(
    "best_neighbor",
    "SELECT id_recinto * 10 + k AS id_subparcela, id_recinto * 10 + CASE k WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 2 END AS vecino, h AS borde FROM v_plot, range(1, 4) r(k)",
)
def best_neighbor(t):
    out = G.best_neighbor(strips(t).select("id_subparcela", "id_recinto", *BOX), "id_subparcela", 4.0, "id_recinto")
    return out.withColumn("borde", fixed("borde", 6))
