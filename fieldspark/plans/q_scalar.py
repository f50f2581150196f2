"""Text, date, number and JSON functions on whole tables."""

from pyspark.sql import functions as F

from fieldspark.functions.numbers import fixed
from fieldspark.functions import dates as D
from fieldspark.functions import rules
from fieldspark.functions import text as T
from fieldspark.operators import listing as L
from fieldspark.operators import operations as O
from fieldspark.plans.registry import query
from fieldspark.sources import landing


@query(
    "norm_text",
    """SELECT doc_id, md5(strip_accents(upper(replace(trim(text, E' \\t\\n\\r\\f'), 'ß', 'ss')))) AS normal,
              length(text) AS n FROM documents""",
)
def norm_text(t):
    # a digest of the whole normalised text keeps the result narrow
    return t.documents.select("doc_id", F.md5(T.norm_text(F.col("text"))).alias("normal"), F.length("text").cast("long").alias("n"))


@query(
    "place_names",
    """WITH m AS (SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 37 AS VARCHAR), 3, '0') AS k,
                     arg_min(c_name, c_custkey) AS nombre FROM customer WHERE c_custkey % 37 <> 5 GROUP BY 1)
    SELECT p.id_recinto, n.n_name AS provincia, m.nombre AS municipio
    FROM v_plot p LEFT JOIN nation n ON n.n_nationkey = p.provincia
    LEFT JOIN m ON m.k = lpad(CAST(p.provincia AS VARCHAR), 2, '0') || lpad(CAST(p.municipio AS VARCHAR), 3, '0')""",
)
def place_names(t):
    def key(p, m):
        return F.concat(T.pad_code(p, 2), T.pad_code(m, 3))

    # the official list has one row per code, the first one of the file; municipality 5 is missing from it
    towns = (
        t.customer.filter(F.col("c_custkey") % 37 != 5)
        .groupBy(key(F.col("c_nationkey"), F.col("c_custkey") % 37).alias("_k"))
        .agg(F.min_by("c_name", "c_custkey").alias("municipio"))
    )
    provinces = t.nation.select(F.col("n_nationkey").alias("_p"), F.col("n_name").alias("nombre_provincia"))
    plots = t.v_plot.select("id_recinto", F.col("provincia").alias("_p"), key(F.col("provincia"), F.col("municipio")).alias("_k"))
    return plots.join(provinces, "_p", "left").join(towns, "_k", "left").select(
        "id_recinto", F.col("nombre_provincia").alias("provincia"), "municipio"
    )


_PHONE_SQL = """CASE c_custkey % 6 WHEN 0 THEN '+34 ' || d WHEN 1 THEN '34' || d WHEN 2 THEN substr(d, 1, 3) || ' ' || substr(d, 4, 3) || '-' || substr(d, 7)
      WHEN 3 THEN substr(d, 1, 7) WHEN 4 THEN '+34' || substr(d, 2) ELSE 'tel. ' || d END"""


@query(
    "contact_quality",
    f"""WITH c AS (SELECT c_custkey, CAST(600000000 + (c_custkey * 7919) % 99999999 AS VARCHAR) AS d FROM customer),
    r AS (SELECT c_custkey AS id_usuario, {_PHONE_SQL} AS raw, d, c_custkey % 6 AS k FROM c)
    SELECT id_usuario, raw, CASE WHEN k IN (0, 1, 2, 5) THEN '+34' || d END AS telefono, k IN (0, 1, 2, 5) AS ok FROM r""",
)
def contact_quality(t):
    d = (F.lit(600000000) + (F.col("c_custkey") * 7919) % 99999999).cast("string")
    k = F.col("c_custkey") % 6
    raw = (
        F.when(k == 0, F.concat(F.lit("+34 "), d))
        .when(k == 1, F.concat(F.lit("34"), d))
        .when(k == 2, F.concat(F.substring(d, 1, 3), F.lit(" "), F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 9)))
        .when(k == 3, F.substring(d, 1, 7))
        .when(k == 4, F.concat(F.lit("+34"), F.substring(d, 2, 9)))
        .otherwise(F.concat(F.lit("tel. "), d))
    )
    users = t.customer.select(F.col("c_custkey").alias("id_usuario"), raw.alias("raw"))
    return users.withColumn("telefono", T.phone_es(F.col("raw"))).withColumn("ok", F.col("telefono").isNotNull())


@query(
    "contact_quality_count",
    "SELECT count(*) AS usuarios, count(*) FILTER (c_custkey % 6 IN (3, 4)) AS invalidos FROM customer",
)
def contact_quality_count(t):
    rows = contact_quality(t)
    return rows.agg(F.count(F.lit(1)).alias("usuarios"), F.count_if(~F.col("ok")).alias("invalidos"))


@query(
    "standardize_dates",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 = 7 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS fecha, o_orderkey % 8 = 7 AS rechazada
       FROM orders""",
)
def standardize_dates(t):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 8
    text = (
        F.when(k == 0, F.date_format(d, "yyyyMMdd"))
        .when(k == 1, F.date_format(d, "dd-MM-yyyy"))
        .when(k == 2, F.date_format(d, "d/M/yyyy"))
        .when(k == 3, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(k == 4, F.date_format(d, "d MMM yyyy"))
        .when(k == 5, F.concat(F.date_format(d, "d MMM"), F.lit(". "), F.date_format(d, "yyyy")))
        .when(k == 6, (F.datediff(d, F.lit("1970-01-01")).cast("long") * 86400000).cast("string"))
        .otherwise(F.lit("sin fecha"))
    )
    ms = F.when(F.col("texto").rlike(r"^\d{11,}$"), F.col("texto").try_cast("long"))
    rows = t.orders.select(F.col("o_orderkey").alias("id"), text.alias("texto"))
    fecha = F.coalesce(D.epoch_ms_local_date(ms), D.parse_any_date(F.col("texto")))
    return rows.select("id", fecha.alias("fecha")).withColumn("rechazada", F.col("fecha").isNull())


_TEXT_SQL = "CASE WHEN o_orderkey % 4 = 0 THEN 'Regadío ' || o_orderpriority ELSE 'Girasól ñu ' || o_orderpriority END"


@query(
    "fix_mojibake",
    f"SELECT o_orderkey AS id, {_TEXT_SQL} || CASE WHEN o_orderkey % 5 = 0 THEN ' €' ELSE '' END AS texto FROM orders",
)
def fix_mojibake(t):
    k = F.col("o_orderkey")
    good = F.concat(F.when(k % 4 == 0, "Regadío ").otherwise("Girasól ñu "), "o_orderpriority")
    # UTF-8 bytes read as Latin-1; every third row and those with a sign outside Latin-1 are sound already
    broken = F.decode(F.encode(good, "UTF-8"), "ISO-8859-1")
    text = F.when(k % 5 == 0, F.concat(good, F.lit(" €"))).when(k % 3 == 0, good).otherwise(broken)
    return t.orders.select(k.alias("id"), T.fix_mojibake(text).alias("texto"))


@query(
    "strip_irrigation_suffix",
    "SELECT o_orderkey AS id, o_orderpriority AS cultivo FROM orders",
)
def strip_irrigation_suffix(t):
    suffixes = [" (Regadío)", " [Secano]", " regadio", " SECANO ", " ( riego )", ""]
    chosen = F.element_at(F.array(*[F.lit(s) for s in suffixes]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return t.orders.select(F.col("o_orderkey").alias("id"), T.strip_irrigation_suffix(F.concat("o_orderpriority", chosen)).alias("cultivo"))


@query(
    "forecast_dates",
    """SELECT o_orderkey AS id, CAST(k AS INT) AS dia, strftime(CAST(o_orderdate AS DATE) + CAST(k + 1 AS INT), '%d/%m') AS etiqueta
       FROM orders, range(4) r(k)""",
)
def forecast_dates(t):
    day = t.orders.select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("dia"))
    return day.select("id", "dia", D.forecast_label(F.col("d"), F.col("dia")).alias("etiqueta"))


@query(
    "campaign_of_date",
    """SELECT id_indice, y AS campania, CAST(y - 1 AS VARCHAR) || '/' || CAST(y AS VARCHAR) AS nombre,
              make_date(y - 1, 9, 1) AS inicio, make_date(y, 8, 31) AS fin
       FROM (SELECT id_indice, CAST(CASE WHEN month(fecha_ndvi) >= 9 THEN year(fecha_ndvi) + 1 ELSE year(fecha_ndvi) END AS INT) AS y FROM v_ndvi)""",
)
def campaign_of_date(t):
    y = F.col("campania")
    return t.v_ndvi.select("id_indice", D.campaign_year(F.col("fecha_ndvi")).alias("campania")).withColumns(
        {"nombre": D.campaign_name(y), "inicio": D.campaign_start(y), "fin": D.campaign_end(y)}
    )


_BEFORE = "CASE month(f) WHEN 1 THEN 0 WHEN 2 THEN 31 WHEN 3 THEN 59 WHEN 4 THEN 90 WHEN 5 THEN 120 WHEN 6 THEN 151 WHEN 7 THEN 181 WHEN 8 THEN 212 WHEN 9 THEN 243 WHEN 10 THEN 273 WHEN 11 THEN 304 ELSE 334 END"


@query(
    "campaign_day",
    f"""SELECT id_indice, CAST(CASE WHEN month(f) >= 9 THEN b - 243 + day(f) - 1 ELSE b + day(f) - 1 + 122 END AS INT) AS dia,
               CAST(CASE WHEN month(f) >= 9 THEN b - 243 + day(f) - 1 ELSE b + day(f) - 1 + 121 END AS INT) AS dia_web
        FROM (SELECT id_indice, fecha_ndvi AS f, CASE month(fecha_ndvi) WHEN 1 THEN 0 ELSE 0 END AS z, {_BEFORE.replace('(f)', '(fecha_ndvi)')} AS b FROM v_ndvi)""",
)
def campaign_day(t):
    f = F.col("fecha_ndvi")
    return t.v_ndvi.select("id_indice", D.campaign_day(f).alias("dia"), D.campaign_day(f, shared_new_year=True).alias("dia_web"))


@query(
    "campaign_day_to_date",
    """SELECT id_indice, CASE WHEN d <= 121 THEN make_date(y - 1, 9, 1) + d ELSE make_date(y, 1, 1) + (d - 122) END AS fecha
       FROM (SELECT id_indice, CAST(id_indice % 365 AS INT) AS d, CAST(CASE WHEN month(fecha_ndvi) >= 9 THEN year(fecha_ndvi) + 1 ELSE year(fecha_ndvi) END AS INT) AS y FROM v_ndvi)""",
)
def campaign_day_to_date(t):
    day = (F.col("id_indice") % 365).cast("int")
    return t.v_ndvi.select("id_indice", D.campaign_day_to_date(day, D.campaign_year(F.col("fecha_ndvi"))).alias("fecha"))


# names with accents and mixed case that reach every branch of the rules
CROP_NAMES = (
    "Trigo blando", "maíz", "Garbanzo", "PATATA", "Tomate", "Ajo", "Alfalfa", "Lavanda", "Viña", "Olivar", "Almendro",
    "Manzano", "Limón", "Chopo", "Remolacha", "Girasol", "Colza", "Barbecho", "",
)


def named_crops(t):
    names = F.array(*[F.lit(n) for n in CROP_NAMES])
    k = F.col("o_orderkey")
    return t.orders.select(
        k.alias("id"),
        F.element_at(names, (k % len(CROP_NAMES) + 1).cast("int")).alias("cultivo"),
        F.when(k % 3 == 0, "IMPLANTACION").otherwise("CAMPANA").alias("tipo"),
        F.when(k % 29 == 0, None).otherwise(F.to_date("o_orderdate")).alias("inicio"),
        ((k % 40).cast("double") / 4).alias("ha"),
    )


_CROPS_SQL = f"""c AS (SELECT o_orderkey AS id, list_extract([{', '.join("'" + n + "'" for n in CROP_NAMES)}], CAST(o_orderkey % {len(CROP_NAMES)} + 1 AS INT)) AS cultivo,
    CASE WHEN o_orderkey % 3 = 0 THEN 'IMPLANTACION' ELSE 'CAMPANA' END AS tipo,
    CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS inicio, CAST(o_orderkey % 40 AS DOUBLE) / 4 AS ha FROM orders),
    n AS (SELECT *, strip_accents(upper(cultivo)) AS n FROM c)"""


def _case_sql(rules_of, value, default):
    whens = " ".join(f"WHEN regexp_matches(n, '{p}') THEN {value(*v)}" for p, *v in rules_of)
    return f"CASE {whens} ELSE {default} END"


def _next_sql(m, d):
    return (
        f"(CASE WHEN make_date(year(r), {m}, {d}) > r THEN make_date(year(r), {m}, {d}) ELSE make_date(year(r) + 1, {m}, {d}) END)"
    )


@query(
    "estimate_harvest_date",
    f"""WITH {_CROPS_SQL}, q AS (SELECT *, greatest(inicio, DATE '1998-10-01') AS r FROM n)
    SELECT id, cultivo, tipo, CASE WHEN inicio IS NULL THEN NULL WHEN tipo = 'IMPLANTACION' THEN {_case_sql(rules.PERMANENT_HARVEST, _next_sql, 'NULL')}
      ELSE inicio + {_case_sql(rules.ANNUAL_DAYS, lambda v: v, rules.DEFAULT_ANNUAL_DAYS)} END AS cosecha FROM q""",
)
def estimate_harvest_date(t):
    today = F.lit("1998-10-01").cast("date")
    date = rules.estimate_harvest_date(F.col("cultivo"), F.col("tipo"), F.col("inicio"), today)
    return named_crops(t).select("id", "cultivo", "tipo", date.alias("cosecha"))


@query(
    "estimate_yield",
    f"""WITH {_CROPS_SQL}, y AS (SELECT *, CASE WHEN n = '' THEN NULL WHEN tipo = 'IMPLANTACION' THEN {_case_sql(rules.PERMANENT_YIELD, lambda v: f'{v}::DOUBLE', 'NULL')}
      ELSE {_case_sql(rules.ANNUAL_YIELD, lambda v: f'{v}::DOUBLE', '3000.0::DOUBLE')} END AS est FROM n),
    z AS (SELECT *, CASE WHEN id % 13 = 0 THEN 1234.5::DOUBLE ELSE est END AS kg_ha FROM y)
    SELECT id, cultivo, kg_ha, round(kg_ha * ha, 0) AS kg_total FROM z""",
)
def estimate_yield(t):
    rows = named_crops(t).withColumn("prevision", F.when(F.col("id") % 13 == 0, F.lit(1234.5)))
    kg = F.coalesce("prevision", rules.estimate_yield_kg_ha(F.col("cultivo"), F.col("tipo")))
    return rows.select("id", "cultivo", kg.alias("kg_ha"), fixed(kg * F.col("ha"), 0).alias("kg_total"))


def catalogue_of(t):
    """Parts as catalogue entries: code, name, parent, end date."""
    k = F.col("p_partkey")
    return t.part.select(
        F.when(k % 5 == 0, F.concat(F.lit("A"), k.cast("string"))).otherwise(k.cast("string")).alias("codigo"),
        F.col("p_brand").alias("codigo_padre"),
        F.when(k % 11 == 0, " ").otherwise(F.col("p_name")).alias("nombre"),
        F.when(k % 7 == 0, None).otherwise(F.col("p_type")).alias("descripcion"),
        F.when(k % 4 == 0, F.date_add(F.lit("2024-01-01").cast("date"), (k % 700).cast("int"))).alias("fecha_baja"),
    )


CATALOG_SQL = """cat AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'A' || CAST(p_partkey AS VARCHAR) ELSE CAST(p_partkey AS VARCHAR) END AS codigo,
    p_brand AS codigo_padre, CASE WHEN p_partkey % 11 = 0 THEN ' ' ELSE p_name END AS nombre,
    CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS descripcion,
    CASE WHEN p_partkey % 4 = 0 THEN DATE '2024-01-01' + CAST(p_partkey % 700 AS INT) END AS fecha_baja FROM part)"""


@query(
    "typeahead_search",
    f"""WITH {CATALOG_SQL} SELECT codigo, nombre, descripcion FROM cat
    WHERE (fecha_baja IS NULL OR fecha_baja > DATE '2025-01-01') AND (nombre ILIKE '%ring%' OR codigo ILIKE '%ring%' OR descripcion ILIKE '%ring%')
    ORDER BY CASE WHEN regexp_matches(codigo, '^[0-9]+$') THEN CAST(codigo AS INT) ELSE 999999 END, nombre, codigo LIMIT 50""",
)
def typeahead_search(t):
    found = L.typeahead(catalogue_of(t), "ring", F.lit("2025-01-01").cast("date"), ["nombre", "codigo", "descripcion"])
    return found.select("codigo", "nombre", "descripcion")


@query(
    "catalog_item",
    f"""WITH {CATALOG_SQL} SELECT o.o_orderkey AS id, coalesce(nullif(trim(c.nombre), ''), nullif(trim(c.descripcion), ''), c.codigo) AS etiqueta
    FROM orders o LEFT JOIN cat c ON c.codigo = CAST((o.o_orderkey * 3) % 2300 AS VARCHAR)""",
)
def catalog_item(t):
    cat = catalogue_of(t)
    label = L.catalog_label(F.col("nombre"), F.col("descripcion"), F.col("codigo"))
    return t.orders.select(F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") * 3) % 2300).cast("string").alias("codigo")).join(
        cat, "codigo", "left"
    ).select("id", F.when(F.col("nombre").isNotNull(), label).alias("etiqueta"))


def legends(t):
    """Legends of four header styles, one per year group, from the catalogue of parts."""
    k = F.col("p_partkey")
    code, name = k.cast("string"), F.col("p_name")
    red, green, blue = [((k * m) % 300 - 20).cast("string") for m in (7, 11, 13)]

    def style(year, rest, *headers):
        cols = [code, name, red, green, blue]
        return landing.legend_rows(
            t.part.filter(k % 4 == rest).select(*[c.alias(h) for c, h in zip(cols, headers)]), F.lit(year)
        )

    return (
        style(2014, 0, "COD", "Cubierta", "R", "G", "B")
        .unionByName(style(2019, 1, "Cod", "Cubierta", "R", "G", "B"))
        .unionByName(style(2024, 2, "﻿Cod\nCultivo", "Descripción \ncultivo".replace(" \n", "\n"), "R", "G", "B"))
        .unionByName(style(2025, 3, "code", "label", "red", "green", "blue"))
    )


_CLAMP = "greatest(0, least(255, (p_partkey * {m}) % 300 - 20))"
_LEGEND_SQL = f"""leg AS (SELECT CAST(CASE p_partkey % 4 WHEN 0 THEN 2014 WHEN 1 THEN 2019 WHEN 2 THEN 2024 ELSE 2025 END AS INT) AS anio, CAST(p_partkey AS INT) AS code, p_name AS label,
    CAST((p_partkey * 7) % 300 - 20 AS INT) AS r, CAST((p_partkey * 11) % 300 - 20 AS INT) AS g, CAST((p_partkey * 13) % 300 - 20 AS INT) AS b,
    printf('#%02X%02X%02X', {_CLAMP.format(m=7)}, {_CLAMP.format(m=11)}, {_CLAMP.format(m=13)}) AS hex FROM part)"""


@query("legend_load", f"WITH {_LEGEND_SQL} SELECT * FROM leg")
def legend_load(t):
    return legends(t)


@query(
    "fill_from_legend",
    f"""WITH {_LEGEND_SQL}, h AS (SELECT o_orderkey AS id, CAST(CASE o_orderkey % 4 WHEN 0 THEN 2014 WHEN 1 THEN 2019 WHEN 2 THEN 2024 ELSE 2025 END AS INT) AS anio,
      CAST(o_orderkey % 2500 AS VARCHAR) AS c, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS d FROM orders)
    SELECT h.id, h.anio, coalesce(h.d, leg.label) AS uso_descripcion FROM h LEFT JOIN leg ON leg.anio = h.anio AND CAST(leg.code AS VARCHAR) = h.c""",
)
def fill_from_legend(t):
    k = F.col("o_orderkey")
    years = F.array(*[F.lit(y) for y in (2014, 2019, 2024, 2025)])
    history = t.orders.select(
        k.alias("id"),
        F.element_at(years, (k % 4 + 1).cast("int")).alias("anio"),
        F.concat((k % 2500).cast("string"), F.lit(" ")).alias("uso_codigo"),
        F.when(k % 3 == 0, F.col("o_orderpriority")).alias("uso_descripcion"),
    )
    return landing.fill_from_legend(history, legends(t)).select("id", "anio", "uso_descripcion")


OP_TYPES = ("RIEGO", "FERTILIZACION", "FITOSANITARIO", "OTRAS", "SIEMBRA", "RIEGO")


def operations(t):
    """Events as field operations with nested JSON in several spellings."""
    k = F.col("event_id")
    v = F.format_string("%d", k % 900)
    riego = F.when(
        k % 12 == 0,
        F.concat(F.lit('{"volumen_m3": '), v, F.lit(', "sistema_riego": {"label": "Goteo"}, "procedencia_agua": [{"label": "Pozo"}, {"codigo": "RIO"}], "observaciones": "noche"}')),
    ).otherwise(F.concat(F.lit('{"volumen": "'), v, F.lit('", "sistema_riego": {"codigo": "ASP"}, "procedencia_agua": {"label": "Canal"}}')))
    fert = F.concat(F.lit('{"producto": {"label": "Urea"}, "cantidad": '), v, F.lit(', "unidad": "kg", "tipo_fertilizacion": {"codigo": "F1"}}'))
    fito = (
        F.when(k % 18 == 2, F.concat(F.lit('{"productos": [{"producto": {"label": "Cobre", "codigo": "C-1"}, "dosis": '), v, F.lit(', "unidad": {"label": "l/ha"}}, {"nombre": "Otro"}]}')))
        .when(k % 18 == 8, F.concat(F.lit('{"producto": {"nombre": "Azufre", "num_registro": "R9", "dosis": "'), v, F.lit('", "unidad": "kg/ha"}}')))
        .otherwise(F.lit('{"productos": []}'))
    )
    otras = F.lit('{"catalogo": "LABOR", "label": "Arado"}')
    body = F.when(k % 6 == 1, fert).when(k % 6 == 2, fito).when(k % 6 == 3, otras).when(k % 6 == 4, F.lit("{broken")).otherwise(riego)
    return t.events.select(
        k.alias("id_operacion"),
        F.col("user_id").alias("id_recinto"),
        F.element_at(F.array(*[F.lit(o) for o in OP_TYPES]), (k % 6 + 1).cast("int")).alias("tipo"),
        F.to_date("ts").alias("fecha"),
        F.col("event_type").alias("descripcion"),
        body.alias("detalle"),
    )


_FLAT_SQL = """f AS (SELECT event_id AS k, user_id, CAST(ts AS DATE) AS fecha, event_type, CAST(event_id % 900 AS VARCHAR) AS v,
    CASE event_id % 6 WHEN 0 THEN 'RIEGO' WHEN 1 THEN 'FERTILIZACION' WHEN 2 THEN 'FITOSANITARIO' WHEN 3 THEN 'OTRAS' WHEN 4 THEN 'SIEMBRA' ELSE 'RIEGO' END AS tipo FROM events)"""


@query(
    "flatten_operations",
    f"""WITH {_FLAT_SQL} SELECT k AS id_operacion, tipo,
      CASE WHEN tipo = 'RIEGO' THEN CAST(v AS DOUBLE) END AS volumen_m3,
      CASE WHEN tipo = 'FERTILIZACION' THEN 'Urea' WHEN k % 18 = 2 THEN 'Cobre' WHEN k % 18 = 8 THEN 'Azufre' END AS producto,
      CASE WHEN tipo = 'FERTILIZACION' OR k % 18 IN (2, 8) THEN v END AS dosis,
      CASE WHEN tipo = 'FERTILIZACION' THEN 'kg' WHEN k % 18 = 2 THEN 'l/ha' WHEN k % 18 = 8 THEN 'kg/ha' END AS unidad,
      CAST(CASE WHEN k % 18 = 2 THEN 2 WHEN k % 18 = 8 THEN 1 ELSE 0 END AS INT) AS n_productos,
      CASE WHEN tipo = 'RIEGO' AND k % 12 = 0 THEN v || ' m³ · Goteo · Pozo, RIO — noche'
           WHEN tipo = 'RIEGO' THEN v || ' m³ · ASP · Canal'
           WHEN tipo = 'FERTILIZACION' THEN v || ' kg · Urea · F1'
           WHEN k % 18 = 2 THEN 'Cobre (C-1) · ' || v || ' l/ha (+1 más)'
           WHEN k % 18 = 8 THEN 'Azufre (R9) · ' || v || ' kg/ha'
           WHEN tipo = 'OTRAS' THEN 'LABOR · Arado' ELSE event_type END AS resumen FROM f""",
)
def flatten_operations(t):
    return O.flatten_operations(operations(t)).select(
        "id_operacion", "tipo", "volumen_m3", "producto", "dosis", "unidad", "n_productos", "resumen"
    )


@query(
    "flatten_operations_totals",
    f"""WITH {_FLAT_SQL} SELECT user_id AS id_recinto, count(*) AS n_ops, sum(CASE WHEN tipo = 'RIEGO' THEN CAST(v AS DOUBLE) ELSE 0 END) AS volumen_m3,
      CAST(sum(CASE WHEN k % 18 = 2 THEN 2 WHEN k % 18 = 8 THEN 1 ELSE 0 END) AS BIGINT) AS n_productos, max(fecha) AS ultima FROM f GROUP BY 1""",
)
def flatten_operations_totals(t):
    return O.totals_by_plot(O.flatten_operations(operations(t)))
