"""Filters, projections and data-quality rules."""

from pyspark.sql import functions as F

from fieldspark.functions.numbers import fixed
from fieldspark.functions import ring as R
from fieldspark.functions.text import first_nonblank, norm_text
from fieldspark.operators import crops as C
from fieldspark.operators import listing as L
from fieldspark.operators import merge as M
from fieldspark.operators import quality as Q
from fieldspark.plans.registry import query
from fieldspark.plans.views import with_ring


@query(
    "filter_owner_active",
    "SELECT id_recinto, id_propietario FROM v_plot WHERE id_propietario = 7 AND (activa IS TRUE OR activa IS NULL)",
)
def filter_owner_active(t):
    return C.active(t.v_plot.filter("id_propietario = 7")).select("id_recinto", "id_propietario")


@query(
    "filter_not_false",
    """SELECT id_recinto, id_propietario IS NOT NULL AND id_propietario = 7 AS del_usuario, id_propietario <> 0 AS con_propietario
       FROM v_plot WHERE activa IS NOT FALSE""",
)
def filter_not_false(t):
    owner = F.col("id_propietario")
    return C.active(t.v_plot).select(
        "id_recinto", F.coalesce(owner == 7, F.lit(False)).alias("del_usuario"), (owner != 0).alias("con_propietario")
    )


@query(
    "filter_bbox",
    "SELECT id_recinto, x0 AS minx, y0 AS miny FROM v_plot WHERE x0 <= 150 AND x0 + w >= 100 AND y0 <= 120 AND y0 + h >= 50",
)
def filter_bbox(t):
    boxed = with_ring(t.v_plot)
    return boxed.filter("minx <= 150 AND maxx >= 100 AND miny <= 120 AND maxy >= 50").select("id_recinto", "minx", "miny")


@query(
    "filter_zero_as_missing",
    """SELECT estacion_id, fecha, etpmon, tempmedia FROM v_daily WHERE etpmon > 0 AND tempmedia <> 0""",
)
def filter_zero_as_missing(t):
    return t.v_daily.filter((F.col("etpmon") > 0) & (F.col("tempmedia") != 0)).select("estacion_id", "fecha", "etpmon", "tempmedia")


@query(
    "filter_exists_in_catalog",
    """WITH c AS (SELECT DISTINCT strip_accents(upper(trim(p_brand))) AS k FROM part WHERE p_size > 25)
    SELECT p_partkey, p_name FROM part p WHERE EXISTS (SELECT 1 FROM c WHERE c.k = strip_accents(upper(trim(p.p_brand))))""",
)
def filter_exists_in_catalog(t):
    known = t.part.filter("p_size > 25").select(norm_text(F.col("p_brand")).alias("_k")).distinct()
    return t.part.withColumn("_k", norm_text(F.col("p_brand"))).join(known, "_k", "left_semi").select("p_partkey", "p_name")


@query(
    "filter_exists_counts",
    """WITH c AS (SELECT DISTINCT p_name AS k FROM part WHERE p_size > 45)
    SELECT count(*) FILTER (k IS NOT NULL) AS guardadas, count(*) FILTER (k IS NULL) AS descartadas FROM part LEFT JOIN c ON c.k = p_name""",
)
def filter_exists_counts(t):
    known = t.part.filter("p_size > 45").select(F.col("p_name").alias("k")).distinct()
    # counted per name first, so the join moves one row per name
    names = t.part.groupBy(F.col("p_name").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    joined = names.join(known.withColumn("_ok", F.lit(True)), "k", "left")
    return joined.agg(
        F.sum(F.when(F.col("_ok").isNotNull(), F.col("n")).otherwise(0)).alias("guardadas"),
        F.sum(F.when(F.col("_ok").isNull(), F.col("n")).otherwise(0)).alias("descartadas"),
    )


def _nb(c):
    return f"nullif(trim({c}), '')"


@query(
    "first_nonblank",
    f"""SELECT id_cultivo, coalesce({_nb('tipo_cultivo')}, {_nb('cultivo_custom')}, {_nb('descripcion')}, {_nb('uso_sigpac')}) AS por_tipo,
      coalesce({_nb('descripcion')}, {_nb('tipo_cultivo')}, {_nb('cultivo_custom')}, {_nb('uso_sigpac')}) AS por_producto,
      coalesce({_nb('descripcion')}, {_nb('tipo_cultivo')}, {_nb('cultivo_custom')}) AS sin_uso
    FROM v_crop LEFT JOIN v_product ON codigo = cod_producto""",
)
def first_nonblank_orders(t):
    kind, custom, product, use = (F.col(c) for c in ("tipo_cultivo", "cultivo_custom", "descripcion", "uso_sigpac"))
    return C.with_product(t.v_crop, t.v_product).select(
        "id_cultivo",
        first_nonblank(kind, custom, product, use).alias("por_tipo"),
        first_nonblank(product, kind, custom, use).alias("por_producto"),
        first_nonblank(product, kind, custom).alias("sin_uso"),
    )


@query(
    "alias_coalesce",
    """SELECT p_partkey AS muestra_key, coalesce(nullif(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END, ''), nullif(p_brand, '')) AS id_muestra,
      coalesce(nullif(CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_type END, ''), p_name) AS ph, CAST(p_size AS VARCHAR) AS textura,
      CAST(NULL AS VARCHAR) AS calcio FROM part""",
)
def alias_coalesce(t):
    k = F.col("p_partkey")
    raw = t.part.select(
        k.alias("muestra_key"),
        F.when(k % 3 == 0, "").otherwise(F.col("p_name")).alias("ID_MUESTRA"),
        F.col("p_brand").alias("ID_Muestra"),
        F.when(k % 2 == 0, None).otherwise(F.col("p_type")).alias("pH"),
        F.col("p_name").alias("ph"),
        F.col("p_size").alias("Textura"),
    )
    wanted = {n: v for n, v in C.SOIL_ALIASES.items() if n in ("id_muestra", "ph", "textura", "calcio")}
    return C.resolve_aliases(raw, wanted)


@query(
    "normalize_crop_payload",
    """WITH k AS (SELECT *, coalesce(nullif(trim(upper(tipo_registro)), ''), 'CAMPANA') AS tr FROM v_crop)
    SELECT id_cultivo, tr AS tipo_registro, coalesce(fecha_siembra, fecha_implantacion) AS fecha_siembra,
      coalesce(fecha_implantacion, fecha_siembra) AS fecha_implantacion,
      CAST(CASE WHEN tr = 'CAMPANA' AND coalesce(campana, 0) = 0 THEN coalesce(year(coalesce(fecha_siembra, fecha_implantacion)), campana) ELSE campana END AS INT) AS campana FROM k""",
)
def normalize_crop_payload(t):
    return C.normalize_payload(t.v_crop).select("id_cultivo", "tipo_registro", "fecha_siembra", "fecha_implantacion", "campana")


@query(
    "normalize_advanced_json",
    """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN o_orderpriority WHEN 3 THEN o_orderpriority ELSE NULL END AS detalle,
      o_orderkey % 5 IN (2, 3) AS tiene FROM orders""",
)
def normalize_advanced_json(t):
    k = F.col("o_orderkey") % 5
    text = (
        F.when(k == 0, F.lit("{}"))
        .when(k == 1, F.lit('{"destino": {"codigo": " ", "label": ""}, "material_vegetal": {"tipo": null, "detalle": {"codigo": ""}}}'))
        .when(k == 2, F.concat(F.lit('{"destino": {"codigo": "'), "o_orderpriority", F.lit('"}}')))
        .when(k == 3, F.concat(F.lit('{"material_vegetal": {"tipo": null, "detalle": {"label": "'), "o_orderpriority", F.lit('"}}}')))
    )
    leaf = "struct<codigo:string,label:string>"
    doc = F.from_json(text, f"destino {leaf}, sistema {leaf}, material_vegetal struct<tipo:{leaf},detalle:{leaf}>")
    rows = t.orders.select(F.col("o_orderkey").alias("id"), doc.alias("d"))
    leaves = F.array("d.destino", "d.sistema", "d.material_vegetal.tipo", "d.material_vegetal.detalle")
    filled = lambda v: first_nonblank(v["codigo"], v["label"])
    detail = F.get(F.filter(F.transform(leaves, filled), lambda v: v.isNotNull()), F.lit(0))
    return rows.select("id", detail.alias("detalle")).withColumn("tiene", F.col("detalle").isNotNull())


def dosed_operations(t):
    k = F.col("event_id")
    some = lambda m, div, off: F.when(k % m == 0, None).otherwise(((k * m) % 90 - off).cast("double") / div)
    return t.events.select(
        k.alias("id_operacion"),
        F.to_date("ts").alias("fecha_inicio"),
        F.when(k % 9 == 0, None).otherwise(F.date_add(F.to_date("ts"), ((k % 7) - 1).cast("int"))).alias("fecha_fin"),
        some(11, 2, 3).alias("volumen"),
        some(13, 4, 2).alias("horas"),
        some(17, 8, 1).alias("dosis"),
        some(19, 1, 1).alias("n"),
        some(23, 1, 1).alias("p"),
        some(29, 1, 1).alias("k"),
        (((k * 31) % 160).cast("double") - 60).alias("temperatura"),
    )


def _some_sql(m, div, off):
    return f"CASE WHEN event_id % {m} = 0 THEN NULL ELSE CAST((event_id * {m}) % 90 - {off} AS DOUBLE) / {div} END"


_DOSED_SQL = f"""d AS (SELECT event_id AS id_operacion, CAST(ts AS DATE) AS fi, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(ts AS DATE) + CAST(event_id % 7 - 1 AS INT) END AS ff,
    {_some_sql(11, 2, 3)} AS volumen, {_some_sql(13, 4, 2)} AS horas, {_some_sql(17, 8, 1)} AS dosis, {_some_sql(19, 1, 1)} AS n, {_some_sql(23, 1, 1)} AS p, {_some_sql(29, 1, 1)} AS k,
    CAST((event_id * 31) % 160 AS DOUBLE) - 60 AS tt FROM events),
    ck AS (SELECT id_operacion, coalesce(ff >= fi, true) AS ok_fechas, coalesce(volumen >= 0, true) AS ok_volumen, coalesce(horas >= 0, true) AS ok_horas,
      coalesce(dosis >= 0, true) AS ok_dosis, coalesce(n >= 0 AND p >= 0 AND k >= 0, true) AS ok_npk, coalesce(tt > -50 AND tt < 80, true) AS ok_temperatura FROM d)"""


@query(
    "dq_operations",
    f"""WITH {_DOSED_SQL} SELECT *, ok_fechas AND ok_volumen AND ok_horas AND ok_dosis AND ok_npk AND ok_temperatura AS ok FROM ck
    WHERE NOT (ok_fechas AND ok_volumen AND ok_horas AND ok_dosis AND ok_npk AND ok_temperatura)""",
)
def dq_operations(t):
    rules = Q.operation_rules()
    return Q.rejects(dosed_operations(t), rules).select("id_operacion", *rules, "ok")


@query(
    "dq_operations_counts",
    f"""WITH {_DOSED_SQL} SELECT count(*) AS filas, count(*) FILTER (NOT ok_fechas) AS mal_fechas, count(*) FILTER (NOT ok_volumen) AS mal_volumen,
    count(*) FILTER (NOT ok_horas) AS mal_horas, count(*) FILTER (NOT ok_dosis) AS mal_dosis, count(*) FILTER (NOT ok_npk) AS mal_npk,
    count(*) FILTER (NOT ok_temperatura) AS mal_temperatura FROM ck""",
)
def dq_operations_counts(t):
    return Q.rule_counts(dosed_operations(t), Q.operation_rules())


@query(
    "dq_crops",
    """WITH k AS (SELECT *, upper(tipo_registro) AS tr, upper(origen_cultivo) AS oc, CASE WHEN id_cultivo % 12 = 0 THEN 'X' WHEN id_cultivo % 2 = 0 THEN 'S' ELSE 'R' END AS se,
      CASE WHEN id_cultivo % 15 = 0 THEN NULL ELSE fecha_implantacion + CAST(id_cultivo % 50 - 3 AS INT) END AS fce, id_cultivo % 6 = 0 AS auto FROM v_crop),
    c AS (SELECT id_cultivo, coalesce(se IN ('S', 'R'), true) AS ok_sistema, coalesce(tr IN ('CAMPANA', 'IMPLANTACION'), true) AS ok_tipo,
      coalesce((oc = 'F' AND cod_producto IS NOT NULL AND cultivo_custom IS NULL) OR (oc = 'C' AND cod_producto IS NULL AND cultivo_custom IS NOT NULL), true) AS ok_origen,
      coalesce((tr = 'IMPLANTACION' AND fecha_implantacion IS NOT NULL AND campana IS NULL) OR (tr = 'CAMPANA' AND campana IS NOT NULL), true) AS ok_fechas_tipo,
      coalesce(campana BETWEEN 2000 AND 2100, true) AS ok_campana, coalesce(fce >= coalesce(fecha_siembra, fecha_implantacion), true) AS ok_orden,
      coalesce(NOT auto OR fce IS NOT NULL, true) AS ok_auto FROM k)
    SELECT *, ok_sistema AND ok_tipo AND ok_origen AND ok_fechas_tipo AND ok_campana AND ok_orden AND ok_auto AS ok FROM c""",
)
def dq_crops(t):
    k = F.col("id_cultivo")
    rows = t.v_crop.withColumns(
        {
            "tipo_registro": F.upper("tipo_registro"),
            "origen_cultivo": F.upper("origen_cultivo"),
            "sistema_explotacion": F.when(k % 12 == 0, "X").when(k % 2 == 0, "S").otherwise("R"),
            "fecha_cosecha_estimada": F.when(k % 15 == 0, None).otherwise(F.date_add("fecha_implantacion", (k % 50 - 3).cast("int"))),
            "cosecha_estimada_auto": k % 6 == 0,
        }
    )
    rules = Q.crop_rules()
    return Q.check(rows, rules).select("id_cultivo", *rules, "ok")


@query(
    "dq_unique_keys",
    """SELECT l_suppkey AS estacion_id, CAST(l_shipdate AS DATE) AS fecha, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
)
def dq_unique_keys(t):
    raw = t.lineitem.select(F.col("l_suppkey").alias("estacion_id"), F.to_date("l_shipdate").alias("fecha"))
    return M.duplicate_keys(raw, ["estacion_id", "fecha"])


@query(
    "fill_crop_type",
    """WITH j AS (SELECT c.*, d.descripcion, upper(origen_cultivo) AS oc, nullif(trim(cultivo_custom), '') AS cc FROM v_crop c LEFT JOIN v_product d ON d.codigo = c.cod_producto),
    e AS (SELECT *, CASE WHEN oc = 'F' AND cod_producto IS NULL THEN 'F sin producto' WHEN oc = 'F' AND descripcion IS NULL THEN 'producto inexistente'
      WHEN oc = 'C' AND cc IS NULL THEN 'C sin nombre' WHEN oc IN ('F', 'C') THEN NULL ELSE 'origen no valido' END AS error FROM j)
    SELECT id_cultivo, oc AS origen_cultivo, CASE WHEN oc = 'F' THEN descripcion WHEN oc = 'C' THEN cc END AS tipo_cultivo,
      CASE WHEN oc = 'C' AND error IS NULL THEN NULL ELSE cod_producto END AS cod_producto,
      CASE WHEN oc = 'F' AND error IS NULL THEN NULL ELSE cultivo_custom END AS cultivo_custom, error FROM e""",
)
def fill_crop_type(t):
    return C.fill_crop_type(t.v_crop, t.v_product).select(
        "id_cultivo", "origen_cultivo", "tipo_cultivo", "cod_producto", "cultivo_custom", "error"
    )


@query(
    "touch_updated_at",
    """SELECT coalesce(s.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.v ELSE s.v END AS v,
      CASE WHEN n.id IS NOT NULL AND (s.id IS NULL OR s.v IS DISTINCT FROM n.v) THEN DATE '2025-01-02' ELSE s.ts END AS updated
    FROM (SELECT p_partkey AS id, p_size AS v, DATE '2024-01-01' AS ts FROM part WHERE p_size < 40) s
    FULL JOIN (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS v FROM part WHERE p_size > 20) n ON n.id = s.id""",
)
def touch_updated_at(t):
    base = t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("v"))
    stored = base.filter("v < 40").withColumn("updated", F.lit("2024-01-01").cast("date"))
    fresh = base.filter("v > 20").withColumn("v", F.when(F.col("id") % 3 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return M.touch_changed(stored, fresh, ["id"], "updated", F.lit("2025-01-02").cast("date"))


@query(
    "owner_check",
    "SELECT c.id_cultivo, c.id_recinto FROM v_crop c JOIN v_plot p ON p.id_recinto = c.id_recinto WHERE p.id_propietario = 3",
)
def owner_check(t):
    owned = t.v_plot.filter("id_propietario = 3").select("id_recinto")
    return t.v_crop.join(owned, "id_recinto", "left_semi").select("id_cultivo", "id_recinto")


@query(
    "plots_of_owner_bbox",
    """SELECT p.id_recinto, coalesce(u.c_name, 'N/A') AS propietario, n.n_name AS provincia, p.superficie_ha
    FROM v_plot p LEFT JOIN customer u ON u.c_custkey = p.id_propietario LEFT JOIN nation n ON n.n_nationkey = p.provincia
    WHERE p.id_propietario < 10 AND x0 <= 250 AND x0 + w >= 100 AND y0 <= 220 AND y0 + h >= 50""",
)
def plots_of_owner_bbox(t):
    box = R.rectangle(F.lit(100), F.lit(50), F.lit(250), F.lit(220))
    near = with_ring(t.v_plot).filter("id_propietario < 10 AND minx <= 250 AND maxx >= 100 AND miny <= 220 AND maxy >= 50")
    hits = near.filter(R.polygons_intersect(F.col("ring"), box))
    users = t.customer.select(F.col("c_custkey").alias("id_propietario"), F.col("c_name").alias("_u"))
    names = t.nation.select(F.col("n_nationkey").alias("provincia"), F.col("n_name").alias("_p"))
    return (
        hits.join(users, "id_propietario", "left")
        .join(names, "provincia", "left")
        .select("id_recinto", F.coalesce("_u", F.lit("N/A")).alias("propietario"), F.col("_p").alias("provincia"), "superficie_ha")
    )


@query(
    "plot_detail",
    """SELECT id_recinto, provincia, municipio, x0 + w / 2 AS cx, y0 + h / 2 AS cy, w * h AS area_mapa, coalesce(superficie_ha, w * h) AS superficie_ha FROM v_plot""",
)
def plot_detail(t):
    rows = with_ring(t.v_plot).withColumns({"_c": R.centroid(F.col("ring")), "area_mapa": R.area(F.col("ring"))})
    return rows.select(
        "id_recinto", "provincia", "municipio", fixed("_c.x", 9).alias("cx"), fixed("_c.y", 9).alias("cy"), "area_mapa",
        F.coalesce("superficie_ha", "area_mapa").alias("superficie_ha"),
    )


@query(
    "declared_label",
    """SELECT p.id_recinto, round(CAST(p.id_recinto * 137 AS DOUBLE) / 10000, 4) AS ha, CASE WHEN p.sistexp = 'R' THEN 'Regadío' ELSE 'Secano' END AS sistema,
      coalesce(d.descripcion, CAST(k.cod AS VARCHAR)) AS producto
    FROM v_plot p JOIN (SELECT id_recinto, id_recinto * 3 AS cod FROM v_plot) k ON k.id_recinto = p.id_recinto LEFT JOIN v_product d ON d.codigo = k.cod""",
)
def declared_label(t):
    rows = t.v_plot.select("id_recinto", "sistexp", (F.col("id_recinto") * 3).alias("cod_producto"))
    return C.with_product(rows, t.v_product).select(
        "id_recinto",
        fixed((F.col("id_recinto") * 137).cast("double") / 10000, 4).alias("ha"),
        F.when(F.trim("sistexp") == "R", "Regadío").otherwise("Secano").alias("sistema"),
        F.coalesce("descripcion", F.col("cod_producto").cast("string")).alias("producto"),
    )


@query(
    "cap_quota",
    """WITH held AS (SELECT o_custkey AS u, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
    r AS (SELECT o_orderkey, o_custkey AS u, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderstatus <> 'F')
    SELECT r.o_orderkey AS id, r.u AS id_usuario FROM r LEFT JOIN held h ON h.u = r.u WHERE r.rn + coalesce(h.n, 0) <= 10""",
)
def cap_quota(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("id_usuario"), "o_orderstatus")
    return L.quota(
        rows.filter("o_orderstatus <> 'F'"), rows.filter("o_orderstatus = 'F'"), "id_usuario", [F.col("id")]
    ).select("id", "id_usuario")
