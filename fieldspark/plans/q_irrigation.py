"""Crop coefficients, irrigation need, dose, forecast."""

from pyspark.sql import functions as F

from fieldspark.functions.numbers import fixed
from fieldspark.functions import dates as D
from fieldspark.functions import ring as R
from fieldspark.functions import rules
from fieldspark.operators import forecasting as FC
from fieldspark.operators import irrigation as I
from fieldspark.operators import polygons as G
from fieldspark.operators import series as S
from fieldspark.operators import spatial as SP
from fieldspark.plans.q_interpolation import _IDW, _LONG, _NEAR, _PT, _RUN, lag_frame
from fieldspark.plans.q_joins import DECLARED_SQL, PLOT_KEY, declared
from fieldspark.plans.registry import query
from fieldspark.plans.views import with_ring
from fieldspark.sources.kc_catalog import KC_CATALOG, kc_catalog

# mixed case and accents, two names outside the catalogue
NAMES = ("maíz", "Trigo blando", " ALFALFA", "Viña", "patata ", "BARBECHO TRADICIONAL", "Girasol", "Kiwi", "cebada", "")


def name_of(key):
    return F.element_at(F.array(*[F.lit(n) for n in NAMES]), (key % len(NAMES) + 1).cast("int"))


def _name_sql(key):
    return f"list_extract([{', '.join(repr(n) for n in NAMES)}], CAST({key} % {len(NAMES)} + 1 AS INT))"


_KC = "kc AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', '{f}', {float(a)}::DOUBLE, {float(b)}::DOUBLE, '{t}')" for c, _, f, a, b, t in KC_CATALOG
) + ") k(cultivo, formula_code, kc_min, kc_max, confianza))"

_LAST = """ln AS (SELECT id_recinto, valor_medio AS ndvi FROM (SELECT *, row_number() OVER (PARTITION BY id_recinto ORDER BY fecha_ndvi DESC NULLS LAST, id_indice DESC) AS rn
  FROM v_ndvi WHERE valor_medio IS NOT NULL) WHERE rn = 1)"""

_FORMULA = """CASE {code} WHEN 'KC_HERBACEO_COBERTURA_RAPIDA' THEN 1.25::DOUBLE * {n} + 0.1::DOUBLE WHEN 'KC_ANUAL_SUELO_VISIBLE' THEN 0.85::DOUBLE * {n} + 0.47::DOUBLE
  WHEN 'KCB_GENERAL' THEN 1.44::DOUBLE * {n} + (-0.1)::DOUBLE WHEN 'KC_FIJO_BAJO' THEN 0::DOUBLE * {n} + 0.1::DOUBLE ELSE 1.0::DOUBLE END"""

_KC_OF = f"CASE WHEN ndvi IS NOT NULL THEN greatest(kc_min, least(kc_max, {_FORMULA.format(code='formula_code', n='ndvi')})) ELSE (kc_min + kc_max) / 2 END"

_WITH_KC = f"""{_KC}, {_LAST},
  pk AS (SELECT p.id_recinto, {_name_sql('p.id_recinto')} AS cultivo FROM v_plot p),
  pc AS (SELECT pk.id_recinto, pk.cultivo, ln.ndvi, coalesce(k.formula_code, 'KCB_GENERAL') AS formula_code, coalesce(k.kc_min, 0.15) AS kc_min, coalesce(k.kc_max, 1.0) AS kc_max
     FROM pk LEFT JOIN kc k ON strip_accents(upper(trim(k.cultivo))) = strip_accents(upper(trim(pk.cultivo))) LEFT JOIN ln ON ln.id_recinto = pk.id_recinto),
  pkc AS (SELECT *, {_KC_OF} AS kc FROM pc)"""


def plots_with_kc(t):
    plots = t.v_plot.withColumn("cultivo", name_of(F.col("id_recinto")))
    latest = S.latest_ndvi(t.v_ndvi).select("id_recinto", "ndvi")
    return I.with_kc(I.with_kc_entry(plots, kc_catalog(t.spark)).join(latest, "id_recinto", "left"))


_CODES = ("KC_HERBACEO_COBERTURA_RAPIDA", "kc_anual_suelo_visible ", "KCB_GENERAL", "KC_FIJO_BAJO", "OTRA")


@query(
    "kc_formula",
    f"""SELECT id_indice, round({_FORMULA.format(code=f"upper(trim(list_extract([{', '.join(repr(c) for c in _CODES)}], CAST(id_indice % 5 + 1 AS INT))))", n='valor_medio')}, 6) AS kc FROM v_ndvi WHERE valor_medio IS NOT NULL""",
)
def kc_formula(t):
    code = F.element_at(F.array(*[F.lit(c) for c in _CODES]), (F.col("id_indice") % 5 + 1).cast("int"))
    return t.v_ndvi.filter("valor_medio IS NOT NULL").select("id_indice", fixed(rules.kc_formula(code, F.col("valor_medio")), 6).alias("kc"))


@query("kc_from_ndvi", f"WITH {_WITH_KC} SELECT id_recinto, formula_code, ndvi, round(kc, 6) AS kc FROM pkc")
def kc_from_ndvi(t):
    return plots_with_kc(t).select("id_recinto", "formula_code", "ndvi", fixed("kc", 6).alias("kc"))


_ETP = "CAST((id_recinto * 37) % 95 AS DOUBLE) / 10"
_NEED = f"""nd AS (SELECT k.id_recinto, {_ETP.replace('id_recinto', 'k.id_recinto')} AS etp, kc, CAST((k.id_recinto * 53) % 80 AS DOUBLE) / 10 AS ev_t, CASE WHEN p.id_recinto % 41 = 0 THEN 0 ELSE p.w * p.h * 1000 END AS area_m2
    FROM pkc k JOIN v_plot p ON p.id_recinto = k.id_recinto),
  n1 AS (SELECT *, round(etp * kc, 3) AS riego_mm FROM nd), n2 AS (SELECT *, greatest(0.0, riego_mm) AS deficit_mm FROM n1),
  need AS (SELECT id_recinto, etp, kc, ev_t, riego_mm, deficit_mm, round(deficit_mm * 10, 2) AS m3_ha, round(area_m2 / 10000, 4) AS superficie_ha, CAST(round(deficit_mm * area_m2) AS BIGINT) AS litros_dia,
    CASE WHEN deficit_mm <= 0 THEN '' WHEN deficit_mm * 10 >= 100 THEN printf('%d m³/ha', CAST(round(deficit_mm * 10) AS BIGINT)) ELSE printf('%.1f m³/ha', round(deficit_mm * 10, 1)) END AS litros_txt,
    CASE WHEN etp > ev_t THEN 'red' ELSE 'blue' END AS color FROM n2)"""


def plots_with_need(t):
    k = F.col("id_recinto")
    plots = plots_with_kc(t).withColumns(
        {
            "etp": ((k * 37) % 95).cast("double") / 10,
            "ev_t": ((k * 53) % 80).cast("double") / 10,
            "area_m2": F.when(k % 41 == 0, F.lit(0.0)).otherwise(F.col("w") * F.col("h") * 1000),
        }
    )
    return I.irrigation_need(plots)


_NEED_COLS = ["id_recinto", "riego_mm", "deficit_mm", "m3_ha", "superficie_ha", "litros_dia", "litros_txt", "color"]


@query("irrigation_need", f"WITH {_WITH_KC}, {_NEED} SELECT {', '.join(_NEED_COLS)} FROM need")
def irrigation_need(t):
    return plots_with_need(t).select(*_NEED_COLS)


@query(
    "irrigation_dose",
    f"""WITH {_WITH_KC}, {_NEED}, {DECLARED_SQL},
    b AS (SELECT r.id_recinto, r.id_propietario, c.parc_sistexp, n.riego_mm, CASE WHEN r.id_recinto % 2 = 0 THEN 0 ELSE n.deficit_mm + 0.25 END AS def, CASE WHEN r.id_recinto % 3 = 0 THEN 0 ELSE n.m3_ha END AS m3,
      round(coalesce(r.superficie_ha, 0), 2) AS ha, n.color, coalesce(d.descripcion, k.cultivo) AS cultivo
      FROM v_plot r JOIN need n ON n.id_recinto = r.id_recinto JOIN pkc k ON k.id_recinto = r.id_recinto
      LEFT JOIN dec c ON r.provincia = c.provincia AND r.municipio = c.municipio AND coalesce(r.agregado, 0) = coalesce(c.agregado, 0) AND coalesce(r.zona, 0) = coalesce(c.zona, 0)
        AND r.poligono = c.poligono AND r.parcela = c.parcela AND r.recinto = c.recinto
      LEFT JOIN v_product d ON d.codigo = c.parc_producto
      WHERE coalesce(r.activa, true) AND trim(coalesce(c.parc_sistexp, '')) = 'R'),
    e AS (SELECT *, greatest(coalesce(riego_mm, 0), coalesce(nullif(def, 0), riego_mm, 0)) AS demanda_mm FROM b WHERE riego_mm IS NOT NULL),
    f AS (SELECT *, CASE WHEN m3 <= 0 AND demanda_mm > 0 THEN round(demanda_mm * 10, 1) ELSE m3 END AS m3_ha, CAST(round(demanda_mm * (ha * 10000)) AS BIGINT) AS litros_netos FROM e),
    g AS (SELECT *, CASE WHEN litros_netos > 0 THEN CAST(round(litros_netos / 0.92::DOUBLE) AS BIGINT) ELSE 0 END AS litros_brutos FROM f)
    SELECT id_recinto, id_propietario, coalesce(nullif(trim(cultivo), ''), '—') AS cultivo, demanda_mm, m3_ha, litros_netos, round(litros_netos / 1000::DOUBLE, 1) AS m3_total_neto, litros_brutos,
      round(litros_brutos / 1000::DOUBLE, 1) AS m3_total_bruto, CAST(92 AS INT) AS eficiencia_pct, 'Regadío' AS sistexp, CASE color WHEN 'red' THEN 'Riego recomendado' ELSE 'Sin recomendación' END AS estado FROM g""",
)
def irrigation_dose(t):
    """Gross litres per irrigated plot, for every owner at once; one owner is a filter on the result."""
    k = F.col("id_recinto")
    need = plots_with_need(t).select("id_recinto", "cultivo", "riego_mm", "deficit_mm", "m3_ha", "color")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("agregado", "zona")}
    decl = declared(t).withColumns(zero).select(*PLOT_KEY, "parc_producto", "parc_sistexp")
    plots = t.v_plot.filter(F.coalesce("activa", F.lit(True))).withColumns(zero).select("id_recinto", "id_propietario", "superficie_ha", *PLOT_KEY)
    joined = (
        plots.join(decl, PLOT_KEY, "left")
        .filter(F.trim(F.coalesce("parc_sistexp", F.lit(""))) == "R")
        .join(t.v_product, F.col("parc_producto") == F.col("codigo"), "left")
        .join(need, "id_recinto")
        .select(
            "id_recinto", "id_propietario", F.col("parc_sistexp").alias("sistexp_cod"), "riego_mm", "color",
            F.when(k % 2 == 0, F.lit(0.0)).otherwise(F.col("deficit_mm") + 0.25).alias("deficit_mm"),
            F.when(k % 3 == 0, F.lit(0.0)).otherwise(F.col("m3_ha")).alias("m3_ha"),
            fixed(F.coalesce("superficie_ha", F.lit(0.0)), 2).alias("superficie_ha"),
            F.coalesce(F.nullif(F.trim(F.coalesce("descripcion", "cultivo")), F.lit("")), F.lit("—")).alias("cultivo"),
        )
    )
    return I.irrigation_dose(joined).select(
        "id_recinto", "id_propietario", "cultivo", "demanda_mm", "m3_ha", "litros_netos", "m3_total_neto", "litros_brutos", "m3_total_bruto", "eficiencia_pct", "sistexp", "estado",
    )


@query(
    "alert_counts",
    f"""WITH {_WITH_KC}, {_NEED} SELECT count(*) FILTER (color = 'red') AS urgentes, count(*) FILTER (color = 'orange') AS recomendados, count(*) FILTER (color = 'blue') AS sin FROM need""",
)
def alert_counts(t):
    badge = rules.irrigation_badge(F.col("color"))
    return plots_with_need(t).agg(
        F.count_if(badge == "danger").alias("urgentes"), F.count_if(badge == "warning").alias("recomendados"), F.count_if(badge == "primary").alias("sin")
    )


def cells_with_kc(t):
    """Forecast cells with coefficient: computed once per cell, before the days unfold."""
    cells = with_ring(t.v_cell).withColumns({"cultivo": name_of(F.col("celda")), "ndvi": F.when(F.col("celda") % 6 == 0, None).otherwise((F.col("celda") % 100).cast("double") / 100)})
    return I.with_kc(I.with_kc_entry(cells, kc_catalog(t.spark)))


_CELLS = f"""{_KC}, cc AS (SELECT c.*, CASE WHEN c.celda % 6 = 0 THEN NULL ELSE CAST(c.celda % 100 AS DOUBLE) / 100 END AS ndvi, coalesce(k.formula_code, 'KCB_GENERAL') AS formula_code,
    coalesce(k.kc_min, 0.15) AS kc_min, coalesce(k.kc_max, 1.0) AS kc_max FROM v_cell c LEFT JOIN kc k ON strip_accents(upper(trim(k.cultivo))) = strip_accents(upper(trim({_name_sql('c.celda')})))),
  ck AS (SELECT *, {_KC_OF} AS kc FROM cc),
  fu AS ({' UNION ALL '.join(f"SELECT celda, CAST({k} AS INT) AS off, et_{k} AS etp, ev_t, kc, rg, x0, y0, w, h FROM ck" for k in range(4))})"""


def unfolded(t):
    cells = cells_with_kc(t)
    return I.forecast_unpivot(cells, ["celda", "ev_t", "kc", "rg", "ring", "minx", "miny", "maxx", "maxy"], [f"et_{k}" for k in range(4)])


@query("forecast_unpivot", f"WITH {_CELLS} SELECT celda, off AS \"offset\", etp, round(etp * kc, 3) AS riego_mm FROM fu")
def forecast_unpivot(t):
    return unfolded(t).select("celda", "offset", "etp", fixed(F.col("etp") * F.col("kc"), 3).alias("riego_mm"))


@query(
    "etp_map",
    f"""WITH {_CELLS}, o AS (SELECT c.celda, min(p.id_recinto) AS id_recinto FROM v_cell c JOIN v_plot p ON c.x0 + c.w / 2 > p.x0 AND c.x0 + c.w / 2 < p.x0 + p.w AND c.y0 + c.h / 2 > p.y0 AND c.y0 + c.h / 2 < p.y0 + p.h GROUP BY 1)
    SELECT fu.celda, off AS "offset", etp, CASE WHEN etp > ev_t THEN 'red' ELSE 'blue' END AS color, p.id_propietario FROM fu LEFT JOIN o ON o.celda = fu.celda LEFT JOIN v_plot p ON p.id_recinto = o.id_recinto""",
)
def etp_map(t):
    cells = with_ring(t.v_cell).withColumn("_c", R.centroid(F.col("ring"))).select("celda", F.col("_c.x").alias("x"), F.col("_c.y").alias("y"))
    plots = with_ring(t.v_plot).select("id_recinto", "ring", "minx", "miny", "maxx", "maxy")
    owner = SP.point_in_polygon_first(cells, plots, 4.0, "celda", "id_recinto").select("celda", "id_recinto")
    owner = owner.join(t.v_plot.select("id_recinto", "id_propietario"), "id_recinto", "left").select("celda", "id_propietario")
    days = unfolded(t).select("celda", "offset", "etp", rules.reference_color(F.col("etp"), F.col("ev_t")).alias("color"))
    return days.join(owner, "celda", "left").select("celda", "offset", "etp", "color", "id_propietario")


@query(
    "irrigation_alerts",
    f"""WITH {_CELLS}, n AS (SELECT celda, x0, y0, w, h, round(et_0 * kc, 3) AS riego_mm, CASE WHEN et_0 > ev_t THEN 'red' ELSE 'blue' END AS color FROM ck),
    ov AS (SELECT p.id_recinto, n.celda, n.riego_mm, n.color, greatest(0, least(p.x0 + p.w, n.x0 + n.w) - greatest(p.x0, n.x0)) * greatest(0, least(p.y0 + p.h, n.y0 + n.h) - greatest(p.y0, n.y0)) AS a
      FROM v_plot p JOIN n ON n.x0 <= p.x0 + p.w AND n.x0 + n.w >= p.x0 AND n.y0 <= p.y0 + p.h AND n.y0 + n.h >= p.y0 WHERE coalesce(p.activa, true) AND p.sistexp = 'R'),
    b AS (SELECT *, row_number() OVER (PARTITION BY id_recinto ORDER BY a DESC, celda) AS rn FROM ov)
    SELECT id_recinto, celda, riego_mm, color FROM b WHERE rn = 1 AND color IN ('red', 'orange') ORDER BY riego_mm DESC, id_recinto LIMIT 8""",
)
def irrigation_alerts(t):
    today = cells_with_kc(t).select(
        "celda", fixed(F.col("et_0") * F.col("kc"), 3).alias("riego_mm"), rules.reference_color(F.col("et_0"), F.col("ev_t")).alias("color"), "ring", "minx", "miny", "maxx", "maxy"
    )
    plots = with_ring(t.v_plot).filter(F.coalesce("activa", F.lit(True)) & (F.col("sistexp") == "R"))
    best = G.max_overlap(
        plots.select("id_recinto", "ring", "minx", "miny", "maxx", "maxy"), today.select("celda", "ring", "minx", "miny", "maxx", "maxy"), "id_recinto", "celda", 4.0,
        convex=True,
    )
    rows = best.join(today.select("celda", "riego_mm", "color"), "celda").withColumn("sistexp_cod", F.lit("R"))
    return I.irrigation_alerts(rows).select("id_recinto", "celda", "riego_mm", "color")


@query(
    "fix_deficit",
    f"""WITH {_CELLS}, n AS (SELECT celda, off, round(etp * kc, 3) AS riego_mm, w * h / 10 AS ha FROM fu)
    SELECT celda, off AS "offset", riego_mm AS deficit_mm, round(riego_mm * 10, 2) AS m3_ha, CAST(round(riego_mm * ha * 10000) AS BIGINT) AS litros_dia,
      CASE WHEN riego_mm <= 0 THEN '' WHEN riego_mm * 10 >= 100 THEN printf('%d m³/ha', CAST(round(riego_mm * 10) AS BIGINT)) ELSE printf('%.1f m³/ha', round(riego_mm * 10, 1)) END AS litros_txt,
      CASE WHEN riego_mm <= 2.0 THEN 'blue' WHEN off <= 1 THEN 'red' ELSE 'orange' END AS color FROM n""",
)
def fix_deficit(t):
    rows = forecast_rows(t)
    return I.fix_deficit(rows).select("celda", "offset", "deficit_mm", "m3_ha", "litros_dia", "litros_txt", "color")


def forecast_rows(t):
    return unfolded(t).select(
        "celda", "offset", fixed(F.col("etp") * F.col("kc"), 3).alias("riego_mm"),
        ((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")) / 10).alias("superficie_ha"), rules.reference_color(F.col("etp"), F.col("ev_t")).alias("color"),
    )


@query(
    "litres_fallback",
    f"""WITH {_CELLS}, n AS (SELECT celda, off, round(etp * kc, 3) AS d, w * h / 10 AS ha, CASE WHEN celda % 3 = 0 THEN NULL ELSE celda END AS l, CASE WHEN etp > ev_t THEN 'red' ELSE 'blue' END AS color FROM fu)
    SELECT celda, off AS "offset", coalesce(l, CAST(round(d * ha * 10000) AS BIGINT)) AS litros, coalesce(l, CAST(round(d * ha * 10000) AS BIGINT)) > 0 AS tiene_litros,
    CASE WHEN color = 'red' THEN 'Riego recomendado' ELSE 'Sin recomendación' END AS urgencia FROM n""",
)
def litres_fallback(t):
    rows = forecast_rows(t).withColumns({"deficit_mm": F.col("riego_mm"), "litros_dia": F.when(F.col("celda") % 3 == 0, None).otherwise(F.col("celda"))})
    return I.litres_fallback(rows).select("celda", "offset", "litros", "tiene_litros", "urgencia")


@query(
    "irrigation_diagnostics",
    f"""WITH {_CELLS}, n AS (SELECT off, round(etp * kc, 3) AS r, etp > ev_t AS red FROM fu)
    SELECT off AS "offset", count(*) AS filas, count(*) FILTER (red) AS rojos, count(*) FILTER (r IS NULL) AS sin_riego, max(r) AS riego_max FROM n GROUP BY 1""",
)
def irrigation_diagnostics(t):
    return I.irrigation_diagnostics(forecast_rows(t))


@query(
    "sort_date_columns",
    """SELECT o_orderkey AS id, CAST(k AS INT) AS "offset", CAST(o_orderdate AS DATE) + CAST(k + 1 AS INT) AS fecha, strftime(CAST(o_orderdate AS DATE) + CAST(k + 1 AS INT), '%d/%m') AS etiqueta
       FROM orders, range(4) r(k) ORDER BY 1, 3""",
)
def sort_date_columns(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("offset"))
    return I.plot_forecast(rows, F.col("d")).select("id", "offset", "fecha", "etiqueta").orderBy("id", "fecha")


def features(t):
    """Lag features of every plot with crop and system."""
    plots = t.v_plot.select("id_recinto", name_of(F.col("id_recinto") % 8).alias("Cl"), F.col("sistexp").alias("Rg"))
    return lag_frame(t).join(plots, "id_recinto")


@query("train_per_crop")
def train_per_crop(t):
    models = FC.train_per_crop(features(t))
    return models.select("Cl", "n", F.posexplode("coef").alias("pos", "coef")).withColumn("coef", fixed("coef", 4))


def forecasts(t):
    # features feed both the fit and the prediction: kept once, off the lineage
    from fieldspark.session import cut_lineage

    f = cut_lineage(features(t))
    models = FC.train_per_crop(f)
    return f, models, FC.predict_per_crop(f, models, ["id_recinto", "Rg", "Ev_t"])


@query("predict_per_crop")
def predict_per_crop(t):
    _, _, out = forecasts(t)
    return out.select("id_recinto", "Cl", "Rg", "Ev_t", *[fixed(c, 4).alias(c) for c in FC.OUTPUTS])


@query(
    "predict_outcomes",
    f"""WITH {_PT}, {_LONG}, {_NEAR.format(where=f"l.fecha BETWEEN {_RUN} - 14 AND {_RUN}")}, {_IDW},
    kk AS (SELECT id_recinto, count(valor) FILTER (lag >= 4 OR variable = 'etpmon') = 37 AS entrena, count(valor) FILTER (lag <= 10) = 33 AS lista FROM (SELECT *, {_RUN} - fecha AS lag FROM idw) GROUP BY 1),
    c AS (SELECT {_name_sql('(pt.id_recinto % 8)')} AS cl, count(*) AS n, count(*) FILTER (entrena) AS n_entrena, count(*) FILTER (lista) AS n_lista FROM pt LEFT JOIN kk ON kk.id_recinto = pt.id_recinto GROUP BY 1)
    SELECT CASE WHEN n_entrena < 6 THEN 'sin_modelo' WHEN n_lista = 0 THEN 'sin_filas' ELSE 'ok' END AS resultado, count(*) AS cultivos, CAST(sum(n) AS BIGINT) AS filas FROM c GROUP BY 1""",
)
def predict_outcomes(t):
    f, models, _ = forecasts(t)
    return FC.prediction_outcomes(f, models)


@query("irrigation_forecast")
def irrigation_forecast(t):
    """The nightly job: interpolation, lags, fit, forecast, coefficient and need per plot and day."""
    _, _, predicted = forecasts(t)
    kc = plots_with_kc(t).select("id_recinto", "kc", (F.col("w") * F.col("h") * 10000).alias("area_m2"))
    ids = ["id_recinto", "Cl", "Ev_t"]
    days = I.forecast_unpivot(predicted, ids, FC.OUTPUTS).withColumnRenamed("Ev_t", "ev_t")
    need = I.irrigation_need(days.join(kc, "id_recinto"))
    return I.plot_forecast(need, F.lit("1998-06-15").cast("date")).select(
        "id_recinto", "Cl", "offset", "fecha", fixed("etp", 3).alias("etp"), fixed("riego_mm", 2).alias("riego_mm"), "color"
    )
