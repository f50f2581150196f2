"""Relational joins and set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldspark.functions.numbers import fixed
from fieldspark.functions.text import norm_text
from fieldspark.operators import crops as C
from fieldspark.operators import merge as M
from fieldspark.operators import series as S
from fieldspark.plans.registry import query


@query(
    "join_inner",
    "SELECT s.estacion_id, s.nombre, d.fecha, d.tempmedia FROM v_station s JOIN v_daily d ON d.estacion_id = s.estacion_id",
)
def join_inner(t):
    return t.v_station.select("estacion_id", "nombre").join(t.v_daily.select("estacion_id", "fecha", "tempmedia"), "estacion_id")


@query(
    "join_left",
    """SELECT p.id_recinto, coalesce(n.n_name, 'N/A') AS usuario FROM v_plot p LEFT JOIN nation n ON n.n_nationkey = p.id_propietario""",
)
def join_left(t):
    owners = t.nation.select(F.col("n_nationkey").alias("id_propietario"), F.col("n_name").alias("_u"))
    return t.v_plot.join(owners, "id_propietario", "left").select("id_recinto", F.coalesce("_u", F.lit("N/A")).alias("usuario"))


PLOT_KEY = ["provincia", "municipio", "agregado", "zona", "poligono", "parcela", "recinto"]


def declared(t):
    """Declared crops: one per plot number, with the missing key parts written as 0 or left out the other way round."""
    return t.v_plot.select(
        F.col("id_recinto").alias("dn_oid"),
        *[F.when(F.col(c).isNull(), F.lit(0)).when(F.col(c) == 0, None).otherwise(F.col(c)).alias(c) if c in ("agregado", "zona") else F.col(c) for c in PLOT_KEY],
        (F.col("id_recinto") * 3).alias("parc_producto"),
        F.col("sistexp").alias("parc_sistexp"),
    )


DECLARED_SQL = """dec AS (SELECT id_recinto AS dn_oid, provincia, municipio, CASE WHEN agregado IS NULL THEN 0 WHEN agregado = 0 THEN NULL ELSE agregado END AS agregado,
    CASE WHEN zona IS NULL THEN 0 WHEN zona = 0 THEN NULL ELSE zona END AS zona, poligono, parcela, recinto, id_recinto * 3 AS parc_producto, sistexp AS parc_sistexp FROM v_plot)"""


@query(
    "join_null_as_zero_key",
    f"""WITH {DECLARED_SQL} SELECT r.id_recinto, c.dn_oid, c.parc_producto FROM v_plot r LEFT JOIN dec c ON r.provincia = c.provincia AND r.municipio = c.municipio
    AND coalesce(r.agregado, 0) = coalesce(c.agregado, 0) AND coalesce(r.zona, 0) = coalesce(c.zona, 0) AND r.poligono = c.poligono AND r.parcela = c.parcela AND r.recinto = c.recinto""",
)
def join_null_as_zero_key(t):
    def keyed(df):
        return df.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("agregado", "zona")})

    return keyed(t.v_plot).join(keyed(declared(t)), PLOT_KEY, "left").select("id_recinto", "dn_oid", "parc_producto")


@query(
    "join_null_safe",
    """SELECT a.id_recinto AS id_a, b.id_recinto AS id_b FROM v_plot a JOIN v_plot b ON a.agregado IS NOT DISTINCT FROM b.agregado AND a.zona IS NOT DISTINCT FROM b.zona
    AND a.provincia = b.provincia AND a.municipio = b.municipio AND a.parcela = b.parcela""",
)
def join_null_safe(t):
    a = t.v_plot.select(F.col("id_recinto").alias("id_a"), *PLOT_KEY)
    b = t.v_plot.select(F.col("id_recinto").alias("id_b"), *[F.col(c).alias(f"{c}_b") for c in PLOT_KEY])
    on = F.lit(True)
    for c in ("agregado", "zona"):
        on = on & F.col(c).eqNullSafe(F.col(f"{c}_b"))
    for c in ("provincia", "municipio", "parcela"):
        on = on & (F.col(c) == F.col(f"{c}_b"))
    return a.join(b, on).select("id_a", "id_b")


@query(
    "join_cast_key",
    """SELECT o.o_orderkey AS id, d.descripcion FROM (SELECT o_orderkey, CAST((o_orderkey * 7) % 2600 AS VARCHAR) AS cod FROM orders) o LEFT JOIN v_product d ON CAST(d.codigo AS VARCHAR) = o.cod""",
)
def join_cast_key(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") * 7) % 2600).cast("double").alias("cod"))
    # the text and number keys meet as integers, so the join stays a plain equi-join on one type
    return rows.join(t.v_product, F.col("cod").cast("long") == F.col("codigo").cast("long"), "left").select("id", "descripcion")


@query(
    "join_normalized_text",
    """WITH cat AS (SELECT strip_accents(upper(trim(c_mktsegment))) AS k, min(c_custkey) AS c FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1)
    SELECT c.c_custkey AS id, coalesce('F' || CAST(cat.c AS VARCHAR), 'KCB_GENERAL') AS formula, CASE WHEN cat.c IS NULL THEN 0.15 ELSE 0.2 END::DOUBLE AS kc_min,
      CASE WHEN cat.c IS NULL THEN 1.0 ELSE 1.2 END::DOUBLE AS kc_max, CASE WHEN cat.c IS NULL THEN 'baja' ELSE 'alta' END AS confianza
    FROM customer c LEFT JOIN cat ON cat.k = strip_accents(upper(trim(c.c_mktsegment)))""",
)
def join_normalized_text(t):
    from fieldspark.operators.irrigation import with_kc_entry

    catalog = (
        t.customer.filter("c_mktsegment <> 'BUILDING'")
        .groupBy(F.initcap("c_mktsegment").alias("cultivo"))
        .agg(F.concat(F.lit("f"), F.min("c_custkey").cast("string")).alias("formula_code"))
        .withColumns({"kc_min": F.lit(0.2), "kc_max": F.lit(1.2), "confianza": F.lit("alta")})
    )
    plots = t.customer.select(F.col("c_custkey").alias("id"), F.concat(F.lit(" "), F.lower("c_mktsegment")).alias("cultivo"))
    return with_kc_entry(plots, catalog).select("id", F.col("formula_code").alias("formula"), "kc_min", "kc_max", "confianza")


@query(
    "anti_join",
    "SELECT id_recinto FROM v_plot p WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = p.id_recinto AND o.o_orderpriority = '1-URGENT')",
)
def anti_join(t):
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id_recinto"))
    return t.v_plot.select("id_recinto").join(urgent, "id_recinto", "left_anti")


@query(
    "semi_join",
    "SELECT id_recinto, id_propietario FROM v_plot p WHERE EXISTS (SELECT 1 FROM v_crop c WHERE c.id_recinto = p.id_recinto AND c.estado = 'cerrado')",
)
def semi_join(t):
    closed = t.v_crop.filter("estado = 'cerrado'").select("id_recinto")
    return t.v_plot.select("id_recinto", "id_propietario").join(closed, "id_recinto", "left_semi")


@query(
    "lateral_top1",
    """SELECT p.id_recinto, (SELECT coalesce(nullif(trim(d.descripcion), ''), nullif(trim(c.tipo_cultivo), '')) FROM (
        SELECT * FROM v_crop c WHERE c.id_padre IS NOT NULL AND coalesce(estado, '') NOT IN ('eliminado', 'cerrado')) c
        LEFT JOIN v_product d ON d.codigo = c.cod_producto WHERE c.id_recinto = p.id_recinto
        ORDER BY coalesce(c.fecha_siembra, c.fecha_implantacion) DESC NULLS LAST, c.id_cultivo DESC LIMIT 1) AS cultivo FROM v_plot p""",
)
def lateral_top1(t):
    return C.current_crop_lateral(t.v_plot, t.v_crop, t.v_product)


@query(
    "join_cross_scalar",
    "SELECT id_recinto, round(superficie_ha / (SELECT sum(superficie_ha) FROM v_plot), 9) AS cuota FROM v_plot",
)
def join_cross_scalar(t):
    total = t.v_plot.agg(F.sum("superficie_ha")).scalar()
    return t.v_plot.select("id_recinto", fixed(F.col("superficie_ha") / total, 9).alias("cuota"))


@query(
    "join_asof_nearest_date",
    """WITH tg AS (SELECT id_indice AS objetivo_id, id_recinto, fecha_ndvi + 3 AS objetivo,
        CASE WHEN month(fecha_ndvi) >= 9 THEN make_date(year(fecha_ndvi), 9, 1) ELSE make_date(year(fecha_ndvi) - 1, 9, 1) END AS desde,
        CASE WHEN month(fecha_ndvi) >= 9 THEN make_date(year(fecha_ndvi) + 1, 8, 31) ELSE make_date(year(fecha_ndvi), 8, 31) END AS hasta FROM v_ndvi),
    p AS (SELECT tg.objetivo_id, i.id_indice, i.fecha_ndvi, abs(i.fecha_ndvi - tg.objetivo) AS dias FROM tg JOIN v_ndvi i ON i.id_recinto = tg.id_recinto
        AND i.ruta_ndvi IS NOT NULL AND abs(i.fecha_ndvi - tg.objetivo) <= 10 AND i.fecha_ndvi BETWEEN tg.desde AND tg.hasta)
    SELECT objetivo_id, id_indice, fecha_ndvi, CAST(dias AS INT) AS dias FROM (SELECT *, row_number() OVER (PARTITION BY objetivo_id ORDER BY dias, id_indice) AS rn FROM p) WHERE rn = 1""",
)
def join_asof_nearest_date(t):
    from fieldspark.functions import dates as D

    y = D.campaign_year(F.col("fecha_ndvi"))
    targets = t.v_ndvi.select(
        F.col("id_indice").alias("objetivo_id"), "id_recinto", F.date_add("fecha_ndvi", 3).alias("objetivo"),
        D.campaign_start(y).alias("desde"), D.campaign_end(y).alias("hasta"),
    )
    return S.nearest_dated(targets, t.v_ndvi, ["objetivo_id"])


@query(
    "union_catalog",
    """SELECT codigo, descripcion FROM v_product UNION ALL SELECT * FROM (VALUES (CAST(-1 AS BIGINT), 'HUERTO'), (CAST(-2 AS BIGINT), 'OTRO')) c(codigo, descripcion)""",
)
def union_catalog(t):
    # two custom crops beside the official catalogue
    custom = t.spark.createDataFrame([(-1, "HUERTO"), (-2, "OTRO")], "codigo bigint, descripcion string")
    return t.v_product.unionByName(custom)


@query(
    "union_crop_sources",
    f"""WITH {DECLARED_SQL} SELECT dn_oid AS id, CAST(parc_producto AS VARCHAR) AS cultivo, parc_sistexp AS sistexp, 'declarado' AS fuente FROM dec
    UNION ALL SELECT c_custkey, c_mktsegment, NULL, 'anterior' FROM customer
    UNION ALL SELECT o_orderkey, o_orderpriority, NULL, 'historico' FROM orders""",
)
def union_crop_sources(t):
    now = declared(t).select(F.col("dn_oid").alias("id"), F.col("parc_producto").cast("string").alias("cultivo"), F.col("parc_sistexp").alias("sistexp"))
    before = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("cultivo"))
    history = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("cultivo"))
    return C.union_crop_sources(declarado=now, anterior=before, ausente=None, historico=history)


@query(
    "distinct_products_by_use",
    """SELECT DISTINCT c.uso_sigpac AS uso, d.codigo, d.descripcion FROM v_crop c JOIN v_product d ON d.codigo = c.cod_producto WHERE c.uso_sigpac IS NOT NULL""",
)
def distinct_products_by_use(t):
    # distinct codes first: the join then moves one row per use and code
    codes = t.v_crop.filter("uso_sigpac IS NOT NULL").select(F.col("uso_sigpac").alias("uso"), F.col("cod_producto").alias("codigo")).distinct()
    return codes.join(t.v_product, "codigo").select("uso", "codigo", "descripcion").distinct()


@query(
    "dedup_keep_first",
    """SELECT p_name, p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1""",
)
def dedup_keep_first(t):
    return M.dedup_keep_first(t.part, ["p_name", "p_brand", "no_such_column"], [F.col("p_partkey")], allow_missing=True).select("p_name", "p_brand", "p_partkey")


@query(
    "set_difference_dates",
    """WITH r AS (SELECT min(fecha) AS a, max(fecha) AS b FROM v_daily),
    w AS (SELECT s.estacion_id, CAST(d AS DATE) AS fecha FROM v_station s, r, unnest(generate_series(r.a, r.b, INTERVAL 1 DAY)) g(d))
    SELECT w.estacion_id, w.fecha FROM w ANTI JOIN v_daily d ON d.estacion_id = w.estacion_id AND d.fecha = w.fecha""",
)
def set_difference_dates(t):
    days = F.sequence(t.v_daily.agg(F.min("fecha")).scalar(), t.v_daily.agg(F.max("fecha")).scalar())
    wanted = t.v_station.select("estacion_id", F.explode(days).alias("fecha"))
    return M.missing_dates(wanted, t.v_daily, ["estacion_id", "fecha"])
