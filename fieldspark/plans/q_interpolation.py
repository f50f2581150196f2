"""Neighbour search and interpolation."""

from pyspark.sql import functions as F

from fieldspark.functions.numbers import fixed
from fieldspark.operators import interpolation as I
from fieldspark.operators import surfaces as SF
from fieldspark.plans.registry import query
from fieldspark.plans.views import with_ring

RUN_DATE = "1998-06-15"
_RUN = f"DATE '{RUN_DATE}'"


def plot_points(t):
    """Plot centroids in the station plane (km)."""
    return t.v_plot.select("id_recinto", (F.col("x0") + F.col("w") / 2).alias("x"), (F.col("y0") + F.col("h") / 2).alias("y"))


def placed_daily(t):
    return t.v_daily.join(t.v_station.select("estacion_id", "x", "y"), "estacion_id")


_PT = "pt AS (SELECT id_recinto, x0 + w / 2 AS x, y0 + h / 2 AS y FROM v_plot)"


@query(
    "knn_join",
    f"""WITH {_PT}, d AS (SELECT p.id_recinto, s.estacion_id, (s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y) AS d2 FROM pt p, v_station s),
    r AS (SELECT *, row_number() OVER (PARTITION BY id_recinto ORDER BY d2, estacion_id) AS rank FROM d)
    SELECT id_recinto, estacion_id, round(sqrt(d2), 9) AS distance, CAST(rank AS INT) AS rank FROM r WHERE rank <= 6""",
)
def knn_join(t):
    out = I.knn_join(plot_points(t), t.v_station, 6, "id_recinto", "estacion_id", cell=16.0)
    return out.withColumn("distance", fixed("distance", 9))


@query(
    "nearest_distance",
    f"""WITH {_PT} SELECT s.estacion_id, round(sqrt(min((s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y))), 9) AS distance FROM v_station s, pt p GROUP BY 1""",
)
def nearest_distance(t):
    out = I.knn_join(t.v_station.select("estacion_id", "x", "y"), plot_points(t), 1, "estacion_id", "id_recinto", cell=4.0)
    return out.select("estacion_id", fixed("distance", 9).alias("distance"))


_IDW = """r AS (SELECT *, row_number() OVER (PARTITION BY id_recinto, variable, fecha ORDER BY d, estacion_id) AS rn FROM near),
  k AS (SELECT *, max(CASE WHEN rn = 4 THEN d END) OVER (PARTITION BY id_recinto, variable, fecha) AS d4 FROM r WHERE rn <= 6),
  q AS (SELECT *, CASE WHEN d4 <= 80 THEN 80 WHEN d4 <= 110 THEN 110 WHEN d4 <= 140 THEN 140 WHEN d4 <= 170 THEN 170 END AS radio,
        1 / pow(greatest(d, 1e-12), CASE variable WHEN 'tempmedia' THEN 2.0 ELSE 2.5 END) AS wt FROM k),
  idw AS (SELECT id_recinto, variable, fecha, CASE WHEN max(radio) IS NOT NULL THEN sum(CASE WHEN d <= radio THEN wt * valor END) / sum(CASE WHEN d <= radio THEN wt END) END AS valor FROM q GROUP BY 1, 2, 3)"""

_LONG = """lg AS (SELECT estacion_id, fecha, 'tempmedia' AS variable, tempmedia AS valor FROM v_daily
  UNION ALL SELECT estacion_id, fecha, 'humedadmedia', humedadmedia FROM v_daily UNION ALL SELECT estacion_id, fecha, 'etpmon', etpmon FROM v_daily WHERE etpmon > 0)"""

_NEAR = """near AS (SELECT p.id_recinto, l.variable, l.fecha, l.estacion_id, l.valor, sqrt((s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y)) AS d
  FROM lg l JOIN v_station s ON s.estacion_id = l.estacion_id, pt p WHERE {where})"""


@query(
    "idw_adaptive",
    f"""WITH {_PT}, {_LONG}, {_NEAR.format(where=f"l.fecha = {_RUN}")}, {_IDW}
    SELECT p.id_recinto, v.variable, round(valor, 6) AS valor
    FROM pt p, (SELECT DISTINCT variable FROM lg WHERE fecha = {_RUN}) v LEFT JOIN idw i ON i.id_recinto = p.id_recinto AND i.variable = v.variable""",
)
def idw_adaptive(t):
    day = t.v_daily.filter(F.col("fecha") == F.lit(RUN_DATE).cast("date"))
    values = I.usable_values(day, list(I.LAG_PREFIX)).join(t.v_station.select("estacion_id", "x", "y"), "estacion_id")
    out = I.idw_adaptive(plot_points(t), values, "id_recinto", "estacion_id", ["variable"], I.power_of(F.col("variable")))
    return out.select("id_recinto", "variable", fixed("valor", 6).alias("valor"))


def lag_frame(t):
    return I.lag_features(plot_points(t), placed_daily(t), F.lit(RUN_DATE).cast("date"), "id_recinto")


def _lag_cols():
    return [(v, p, d) for v, p in I.LAG_PREFIX.items() for d in range(14, -1, -1)]


def _safe(name):
    return name.replace("-", "m")


@query(
    "lag_features",
    f"""WITH {_PT}, {_LONG}, {_NEAR.format(where=f"l.fecha BETWEEN {_RUN} - 14 AND {_RUN}")}, {_IDW}
    SELECT p.id_recinto, {', '.join(f"round(max(CASE WHEN variable = '{v}' AND fecha = {_RUN} - {d} THEN valor END), 3) AS {p}_t{'m' + str(d) if d else ''}" for v, p, d in _lag_cols())}
    FROM pt p LEFT JOIN idw i ON i.id_recinto = p.id_recinto GROUP BY 1""",
)
def lag_features(t):
    out = lag_frame(t)
    return out.select(*[F.col(f"`{c}`").alias(_safe(c)) for c in out.columns])


@query(
    "eto_history",
    f"""WITH {_PT}, {_LONG}, {_NEAR.format(where=f"l.variable = 'etpmon' AND l.fecha BETWEEN {_RUN} - 12 AND {_RUN}")}, {_IDW},
    n2 AS (SELECT p.id_recinto, l.estacion_id, l.valor, l.variable, l.fecha, sqrt((s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y)) AS d
      FROM lg l JOIN v_station s ON s.estacion_id = l.estacion_id, pt p WHERE l.variable <> 'etpmon' AND l.fecha = {_RUN}),
    r2 AS (SELECT *, row_number() OVER (PARTITION BY id_recinto, variable ORDER BY d, estacion_id) AS rn FROM n2),
    k2 AS (SELECT *, max(CASE WHEN rn = 4 THEN d END) OVER (PARTITION BY id_recinto, variable) AS d4 FROM r2 WHERE rn <= 6),
    q2 AS (SELECT *, CASE WHEN d4 <= 80 THEN 80 WHEN d4 <= 110 THEN 110 WHEN d4 <= 140 THEN 140 WHEN d4 <= 170 THEN 170 END AS radio,
        1 / pow(greatest(d, 1e-12), CASE variable WHEN 'tempmedia' THEN 2.0 ELSE 2.5 END) AS wt FROM k2),
    dia AS (SELECT id_recinto, variable, CASE WHEN max(radio) IS NOT NULL THEN sum(CASE WHEN d <= radio THEN wt * valor END) / sum(CASE WHEN d <= radio THEN wt END) END AS valor FROM q2 GROUP BY 1, 2),
    a AS (SELECT id_recinto, {', '.join(f"round(max(CASE WHEN fecha = {_RUN} - {d} THEN valor END), 3) AS eto_{d}" for d in range(13))} FROM idw GROUP BY 1),
    b AS (SELECT id_recinto, round(max(CASE WHEN variable = 'tempmedia' THEN valor END), 3) AS tempmedia, round(max(CASE WHEN variable = 'humedadmedia' THEN valor END), 3) AS humedadmedia FROM dia GROUP BY 1)
    SELECT p.id_recinto, {', '.join(f"a.eto_{d}" for d in range(13))}, b.tempmedia, b.humedadmedia FROM pt p LEFT JOIN a ON a.id_recinto = p.id_recinto LEFT JOIN b ON b.id_recinto = p.id_recinto""",
)
def eto_history(t):
    out = I.eto_history(plot_points(t), placed_daily(t), F.lit(RUN_DATE).cast("date"), "id_recinto", ["tempmedia", "humedadmedia"])
    return out


@query(
    "idw_grid",
    f"""WITH st AS (SELECT s.estacion_id, s.x, s.y, d.tempmedia AS valor FROM v_daily d JOIN v_station s ON s.estacion_id = d.estacion_id WHERE d.fecha = {_RUN} AND d.tempmedia <> 0),
    e AS (SELECT min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM v_station),
    z AS (SELECT *, CAST(floor((maxx - minx) / 8) AS INT) AS nc, CAST(floor((maxy - miny) / 8) AS INT) AS nr FROM e),
    g AS (SELECT r * nc + c AS cell, minx + (c + 0.5) * 8 AS x, miny + nr * 8 - (r + 0.5) * 8 AS y FROM z, range(10000) a(r), range(10000) b(c) WHERE r < nr AND c < nc),
    d AS (SELECT g.cell, st.valor, greatest(sqrt((st.x - g.x) * (st.x - g.x) + (st.y - g.y) * (st.y - g.y)), 1e-12) AS d FROM g, st)
    SELECT cell, round(sum(valor / pow(d, 2)) / sum(1 / pow(d, 2)), 6) AS valor, round(min(d), 6) AS distancia FROM d GROUP BY 1""",
)
def idw_grid(t):
    stations = placed_daily(t).filter((F.col("fecha") == F.lit(RUN_DATE).cast("date")) & (F.col("tempmedia") != 0)).withColumn(
        "valor", F.col("tempmedia")
    )
    out = I.weighted_surface(station_grid(t), stations, "cell", "estacion_id")
    return out.select("cell", fixed("valor", 6).alias("valor"), fixed("distancia", 6).alias("distancia"))


def station_grid(t, res=8.0):
    extent = t.v_station.agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"))
    return I.grid_over(extent, res, res)


@query(
    "make_grid",
    """WITH e AS (SELECT min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM v_station),
    z AS (SELECT *, CAST(floor((maxx - minx) / 8) AS INT) AS nc, CAST(floor((maxy - miny) / 8) AS INT) AS nr FROM e)
    SELECT r * nc + c AS cell, round(minx + (c + 0.5) * 8, 6) AS x, round(miny + nr * 8 - (r + 0.5) * 8, 6) AS y FROM z, range(10000) a(r), range(10000) b(c) WHERE r < nr AND c < nc""",
)
def make_grid(t):
    return station_grid(t).select("cell", fixed("x", 6).alias("x"), fixed("y", 6).alias("y"))


@query(
    "validate_interpolation",
    f"""WITH {_PT}, {_LONG}, {_NEAR.format(where=f"l.fecha = {_RUN}")}, {_IDW},
    sv AS (SELECT l.estacion_id, l.variable, l.valor, s.x, s.y FROM lg l JOIN v_station s ON s.estacion_id = l.estacion_id WHERE l.fecha = {_RUN}),
    dd AS (SELECT s.estacion_id, p.id_recinto, (s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y) AS d2 FROM v_station s, pt p),
    n1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY estacion_id ORDER BY d2, id_recinto) AS rn FROM dd) WHERE rn = 1),
    j AS (SELECT sv.*, n1.id_recinto, sqrt(d2) * 111 AS km, i.valor AS ival FROM sv JOIN n1 ON n1.estacion_id = sv.estacion_id LEFT JOIN idw i ON i.id_recinto = n1.id_recinto AND i.variable = sv.variable)
    SELECT estacion_id, variable, id_recinto, round(ival, 6) AS interpolado, round(abs(valor - ival), 6) AS diff, round(km, 6) AS dist_km,
      coalesce(abs(valor - ival) > CASE variable WHEN 'tempmedia' THEN 1.5 WHEN 'humedadmedia' THEN 10.0 WHEN 'etpmon' THEN 0.4 ELSE 3.0 END, false) AS alerta FROM j""",
)
def validate_interpolation(t):
    day = t.v_daily.filter(F.col("fecha") == F.lit(RUN_DATE).cast("date"))
    stations = I.usable_values(day, list(I.LAG_PREFIX)).join(t.v_station.select("estacion_id", "x", "y"), "estacion_id")
    plots = plot_points(t)
    values = I.idw_adaptive(plots, stations, "id_recinto", "estacion_id", ["variable"], I.power_of(F.col("variable")))
    out = I.validate_against_stations(stations, plots, values, "id_recinto", "estacion_id", 4.0, I.threshold_of(F.col("variable")))
    return out.select(
        "estacion_id", "variable", "id_recinto", fixed("interpolado", 6).alias("interpolado"), fixed("diff", 6).alias("diff"),
        fixed("dist_km", 6).alias("dist_km"), "alerta",
    )


def day_values(t):
    """Values of the three variables on the last fifteen days of the run, by station."""
    days = placed_daily(t).filter(
        (F.col("fecha") <= F.lit(RUN_DATE).cast("date")) & (F.col("fecha") > F.date_sub(F.lit(RUN_DATE).cast("date"), 15))
    )
    return days.unpivot(["estacion_id", "x", "y", "fecha"], list(I.LAG_PREFIX), "variable", "valor").filter("valor <> 0")


GROUP = ["variable", "fecha"]


@query("rbf_surface")
def rbf_surface(t):
    fitted = SF.rbf_fit(day_values(t), GROUP)
    return SF.evaluate(station_grid(t), fitted, GROUP, "rbf").withColumn("valor", fixed("valor", 4))


@query("kriging_surface")
def kriging_surface(t):
    fitted = SF.kriging_fit(day_values(t), GROUP)
    return SF.evaluate(station_grid(t), fitted, GROUP, "gp").withColumn("valor", fixed("valor", 4))


@query("tin_surface")
def tin_surface(t):
    return SF.tin_surface(station_grid(t), day_values(t), GROUP, 32.0).withColumn("valor", fixed("valor", 6))


@query("tin_surface_filled")
def tin_surface_filled(t):
    return SF.tin_surface(station_grid(t), day_values(t), GROUP, 32.0, extrapolate=True).withColumn("valor", fixed("valor", 6))
