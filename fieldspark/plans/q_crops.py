"""Crop versions, plans, aggregates and listings."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldspark.functions.numbers import fixed
from fieldspark.functions.text import first_nonblank, pad_code
from fieldspark.operators import crops as C
from fieldspark.operators import listing as L
from fieldspark.plans.registry import query
from fieldspark.plans.views import with_ring

CURRENT = """
    cur AS (
      SELECT * EXCLUDE (rn) FROM (
        SELECT c.*, row_number() OVER (PARTITION BY id_recinto
               ORDER BY coalesce(fecha_siembra, fecha_implantacion) DESC NULLS LAST, id_cultivo DESC) AS rn
        FROM v_crop c WHERE id_padre IS NOT NULL AND coalesce(estado, '') <> 'eliminado') WHERE rn = 1)
"""


def NB(c):
    return f"nullif(trim({c}), '')"


@query(
    "current_crop",
    f"WITH {CURRENT} SELECT id_recinto, id_cultivo, estado, coalesce(fecha_siembra, fecha_implantacion) AS inicio FROM cur",
)
def current_crop(t):
    return C.current_crop(t.v_crop).select("id_recinto", "id_cultivo", "estado", C.start_date().alias("inicio"))


@query(
    "main_crop_by_area",
    f"""WITH {CURRENT}, s AS (
      SELECT p.id_propietario, coalesce({NB('c.tipo_cultivo')}, {NB('d.descripcion')}) AS cultivo,
             sum(coalesce(p.superficie_ha, 0)) AS ha
      FROM cur c JOIN v_plot p ON p.id_recinto = c.id_recinto AND coalesce(p.activa, true)
      LEFT JOIN v_product d ON d.codigo = c.cod_producto GROUP BY 1, 2)
    SELECT id_propietario, cultivo, ha FROM (
      SELECT *, row_number() OVER (PARTITION BY id_propietario ORDER BY ha DESC NULLS LAST, cultivo ASC NULLS LAST) AS rn FROM s)
    WHERE rn = 1""",
)
def main_crop_by_area(t):
    return C.main_crop_by_area(t.v_plot, t.v_crop, t.v_product)


@query(
    "start_view",
    """WITH g AS (
      SELECT id_propietario, provincia, municipio, count(*) AS n, sum(coalesce(superficie_ha, 0)) AS ha, max(id_recinto) AS last_id,
             min(x0) AS minx, min(y0) AS miny, max(x0 + w) AS maxx, max(y0 + h) AS maxy
      FROM v_plot GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY id_propietario ORDER BY n DESC, ha DESC, last_id DESC) AS rn FROM g)
    SELECT id_propietario, provincia, municipio, n, (minx + maxx) / 2 AS lng, (miny + maxy) / 2 AS lat, minx, miny, maxx, maxy
    FROM r WHERE rn = 1""",
)
def start_view(t):
    # extent and ranking come from one aggregation: a municipality is grouped once
    g = with_ring(t.v_plot).groupBy("id_propietario", "provincia", "municipio").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce("superficie_ha", F.lit(0.0))).alias("ha"),
        F.max("id_recinto").alias("last_id"),
        F.min("minx").alias("minx"),
        F.min("miny").alias("miny"),
        F.max("maxx").alias("maxx"),
        F.max("maxy").alias("maxy"),
    )
    best = g.groupBy("id_propietario").agg(
        F.max_by(
            F.struct("provincia", "municipio", "n", "minx", "miny", "maxx", "maxy"), F.struct("n", "ha", "last_id")
        ).alias("b")
    )
    return best.select("id_propietario", "b.*").withColumns(
        {"lng": (F.col("minx") + F.col("maxx")) / 2, "lat": (F.col("miny") + F.col("maxy")) / 2}
    )


@query(
    "top_municipality_code",
    """WITH k AS (
      SELECT id_propietario, lpad(CAST(provincia AS VARCHAR), 2, '0') || lpad(CAST(municipio AS VARCHAR), 3, '0') AS code, count(*) AS n
      FROM v_plot GROUP BY 1, 2),
    best AS (SELECT id_propietario, code FROM (
      SELECT *, row_number() OVER (PARTITION BY id_propietario ORDER BY n DESC, code) AS rn FROM k) WHERE rn = 1)
    SELECT c.c_custkey AS id_usuario, coalesce(b.code, '34900') AS codigo
    FROM customer c LEFT JOIN best b ON b.id_propietario = c.c_custkey""",
)
def top_municipality_code(t):
    code = F.concat(pad_code(F.col("provincia"), 2), pad_code(F.col("municipio"), 3))
    best = (
        t.v_plot.groupBy("id_propietario", code.alias("code"))
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("id_propietario")
        .agg(F.min_by("code", F.struct(-F.col("n"), F.col("code"))).alias("code"))
    )
    users = t.customer.select(F.col("c_custkey").alias("id_usuario"))
    return users.join(best, F.col("id_usuario") == F.col("id_propietario"), "left").select(
        "id_usuario", F.coalesce("code", F.lit("34900")).alias("codigo")
    )


@query(
    "extent_all",
    "SELECT min(x0) AS minx, min(y0) AS miny, max(x0 + w) AS maxx, max(y0 + h) AS maxy FROM v_plot",
)
def extent_all(t):
    # constants of a fallback view when there is no plot at all
    fallback = {"minx": -7.0, "miny": 40.0, "maxx": -1.7, "maxy": 43.3}
    e = with_ring(t.v_plot).agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))
    return e.select(*[F.coalesce(c, F.lit(v)).alias(c) for c, v in fallback.items()])


@query(
    "having_no_current",
    """SELECT id_recinto, count(*) AS n_registros FROM v_crop GROUP BY id_recinto
       HAVING sum(CASE WHEN id_padre IS NOT NULL THEN 1 ELSE 0 END) = 0""",
)
def having_no_current(t):
    return C.plots_without_current(t.v_crop)


@query(
    "having_no_current_count",
    """SELECT count(*) AS n FROM (SELECT id_recinto FROM v_crop GROUP BY id_recinto
       HAVING sum(CASE WHEN id_padre IS NOT NULL THEN 1 ELSE 0 END) = 0)""",
)
def having_no_current_count(t):
    return C.plots_without_current(t.v_crop).agg(F.count(F.lit(1)).alias("n"))


@query(
    "count_pending",
    """SELECT count(*) FILTER (o_orderstatus = 'P') AS pendientes,
              count(*) FILTER (o_orderstatus = 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH')) AS pendientes_lista FROM orders""",
)
def count_pending(t):
    pending = F.col("o_orderstatus") == "P"
    return t.orders.agg(
        F.count_if(pending).alias("pendientes"),
        F.count_if(pending & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("pendientes_lista"),
    )


@query(
    "count_distinct_crops",
    """SELECT count(DISTINCT nullif(trim(tipo_cultivo), '')) AS cultivos, count(DISTINCT id_recinto) AS recintos FROM v_crop""",
)
def count_distinct_crops(t):
    return t.v_crop.agg(
        F.count_distinct(first_nonblank(F.col("tipo_cultivo"))).alias("cultivos"), F.count_distinct("id_recinto").alias("recintos")
    )


@query(
    "group_size_sorted",
    """WITH v AS (SELECT DISTINCT p_brand AS cultivo, lower(p_name) AS variedad FROM part),
    n AS (SELECT cultivo, count(*) AS n FROM v GROUP BY 1),
    top AS (SELECT * FROM n ORDER BY n DESC, cultivo LIMIT 5),
    s AS (SELECT v.*, row_number() OVER (PARTITION BY cultivo ORDER BY variedad) AS rn FROM v)
    SELECT t.cultivo, t.n, string_agg(s.variedad, ', ' ORDER BY s.variedad) AS ejemplos
    FROM top t JOIN s ON s.cultivo = t.cultivo AND s.rn <= 3 GROUP BY 1, 2""",
)
def group_size_sorted(t):
    v = t.part.select(F.col("p_brand").alias("cultivo"), F.lower("p_name").alias("variedad")).distinct()
    top = v.groupBy("cultivo").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cultivo").limit(5)
    # three samples per crop, limited before the shuffle: never the whole list
    w = Window.partitionBy("cultivo").orderBy("variedad")
    samples = (
        v.withColumn("rn", F.row_number().over(w))
        .filter("rn <= 3")
        .groupBy("cultivo")
        .agg(F.concat_ws(", ", F.array_sort(F.collect_list("variedad"))).alias("ejemplos"))
    )
    return top.join(samples, "cultivo").select("cultivo", "n", "ejemplos")


@query(
    "dedup_groups",
    "SELECT lower(p_name) AS variedad, p_brand AS cultivo, count(*) AS n FROM part GROUP BY 1, 2",
)
def dedup_groups(t):
    return t.part.groupBy(F.lower("p_name").alias("variedad"), F.col("p_brand").alias("cultivo")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "sum_total_area",
    """SELECT sum(ha) AS total_ha, CAST(sum(n) AS BIGINT) AS n_subparcelas FROM (
      SELECT round(coalesce(w * h, p.superficie_ha, 0), 4) AS ha,
             (SELECT count(*) FROM nation s WHERE s.n_nationkey = p.provincia) AS n FROM v_plot p)""",
)
def sum_total_area(t):
    subs = t.nation.groupBy(F.col("n_nationkey").alias("provincia")).agg(F.count(F.lit(1)).alias("n"))
    area = fixed(F.coalesce(F.col("w") * F.col("h"), F.col("superficie_ha"), F.lit(0.0)), 4)
    return t.v_plot.join(subs, "provincia", "left").agg(
        F.sum(area).alias("total_ha"), F.sum(F.coalesce("n", F.lit(0))).alias("n_subparcelas")
    )


@query(
    "promote_current",
    """WITH k AS (SELECT id_recinto, count(id_padre) AS n FROM v_crop GROUP BY 1),
    r AS (SELECT c.*, row_number() OVER (PARTITION BY c.id_recinto
          ORDER BY coalesce(fecha_siembra, fecha_implantacion) DESC NULLS LAST, id_cultivo DESC) AS rn FROM v_crop c)
    SELECT r.id_cultivo, r.id_recinto, CASE WHEN k.n = 0 AND rn = 1 THEN r.id_cultivo ELSE r.id_padre END AS id_padre
    FROM r JOIN k ON k.id_recinto = r.id_recinto""",
)
def promote_current(t):
    return C.promote_current(t.v_crop).select("id_cultivo", "id_recinto", "id_padre")


@query(
    "top_n_ops_per_plot",
    """SELECT id_recinto, id_operacion, tipo, fecha, CAST(pos AS INT) AS pos FROM (
      SELECT *, row_number() OVER (PARTITION BY id_recinto ORDER BY fecha DESC, id_operacion DESC) AS pos
      FROM v_op WHERE fecha >= (SELECT max(fecha) FROM v_op) - 60) WHERE pos <= 5""",
)
def top_n_ops_per_plot(t):
    since = F.date_sub(t.v_op.agg(F.max("fecha")).scalar(), 60)
    return C.top_operations(t.v_op, since, 5).select("id_recinto", "id_operacion", "tipo", "fecha", "pos")


@query(
    "version_chain",
    """SELECT id_recinto, id_cultivo, s AS valid_from, lead(s) OVER w AS valid_to, CAST(row_number() OVER w AS INT) AS version,
              lag(id_cultivo) OVER w AS previous_id, lead(id_cultivo) OVER w IS NULL AS is_last
       FROM (SELECT *, coalesce(fecha_siembra, fecha_implantacion) AS s FROM v_crop)
       WINDOW w AS (PARTITION BY id_recinto ORDER BY s ASC NULLS FIRST, id_cultivo)""",
)
def version_chain(t):
    return C.version_chain(t.v_crop)


@query(
    "apply_edits",
    f"""WITH {CURRENT}, e AS (SELECT c_custkey AS id_recinto, c_mktsegment AS tipo_cultivo FROM customer)
    SELECT cur.id_cultivo + 1000000000 AS id_cultivo, cur.id_recinto, cur.id_cultivo AS id_padre, e.tipo_cultivo, cur.estado
    FROM cur JOIN e ON e.id_recinto = cur.id_recinto""",
)
def apply_edits(t):
    edits = t.customer.select(F.col("c_custkey").alias("id_recinto"), F.col("c_mktsegment").alias("tipo_cultivo"))
    rows = C.apply_edits(t.v_crop, edits, F.col("id_cultivo") + F.lit(1000000000))
    return rows.select("id_cultivo", "id_recinto", "id_padre", "tipo_cultivo", "estado")


@query(
    "order_numeric_text",
    """SELECT codigo, nombre, CASE WHEN regexp_matches(codigo, '^[0-9]+$') THEN CAST(codigo AS INT) ELSE 999999 END AS orden
       FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE CAST(p_partkey AS VARCHAR) END AS codigo, p_name AS nombre FROM part)""",
)
def order_numeric_text(t):
    from fieldspark.functions.text import numeric_text_rank

    rows = t.part.select(
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_partkey").cast("string")).alias("codigo"),
        F.col("p_name").alias("nombre"),
    )
    return rows.withColumn("orden", numeric_text_rank(F.col("codigo"))).orderBy("orden", "nombre", "codigo")


@query(
    "ordered_listings",
    "SELECT id_recinto, provincia, municipio, poligono, parcela FROM v_plot ORDER BY provincia, municipio, poligono, parcela, id_recinto",
)
def ordered_listings(t):
    cols = ["provincia", "municipio", "poligono", "parcela", "id_recinto"]
    return t.v_plot.select(*cols).orderBy(*cols)


@query(
    "order_nulls_last",
    "SELECT id_recinto, nullif(trim(nombre), '') AS nombre FROM v_plot ORDER BY nombre NULLS LAST, id_recinto",
)
def order_nulls_last(t):
    return t.v_plot.select("id_recinto", first_nonblank(F.col("nombre")).alias("nombre")).orderBy(
        F.col("nombre").asc_nulls_last(), "id_recinto"
    )


@query(
    "topk_alerts",
    "SELECT id_indice, id_recinto, valor_medio FROM v_ndvi WHERE valor_medio IS NOT NULL ORDER BY valor_medio DESC, id_indice LIMIT 8",
)
def topk_alerts(t):
    return t.v_ndvi.select("id_indice", "id_recinto", "valor_medio").filter("valor_medio IS NOT NULL").orderBy(
        F.desc("valor_medio"), "id_indice"
    ).limit(8)


@query(
    "page_table",
    """WITH f AS (SELECT * FROM part WHERE p_name ILIKE '%ring%' OR p_brand ILIKE '%ring%' OR p_type ILIKE '%ring%')
    SELECT p_partkey, p_name, p_brand, p_retailprice, (SELECT count(*) FROM part) AS total, (SELECT count(*) FROM f) AS filtrados
    FROM f ORDER BY p_retailprice DESC, p_partkey LIMIT 25 OFFSET 10""",
)
def page_table(t):
    out = L.page(t.part, "ring", ["p_name", "p_brand", "p_type"], [F.desc("p_retailprice"), F.col("p_partkey")], 10, 25)
    return out.select("p_partkey", "p_name", "p_brand", "p_retailprice", "total", "filtrados")


@query(
    "ops_history",
    "SELECT id_operacion, id_recinto, tipo, fecha FROM v_op ORDER BY fecha DESC, id_operacion DESC LIMIT 50",
)
def ops_history(t):
    return t.v_op.select("id_operacion", "id_recinto", "tipo", "fecha").orderBy(F.desc("fecha"), F.desc("id_operacion")).limit(50)


@query(
    "summary_sort",
    """SELECT o.id_recinto, coalesce(nullif(trim(p.nombre), ''), 'Recinto ' || CAST(o.id_recinto AS VARCHAR)) AS nombre, o.n_ops
       FROM (SELECT id_recinto, count(*) AS n_ops FROM v_op GROUP BY 1) o JOIN v_plot p ON p.id_recinto = o.id_recinto
       ORDER BY 3 DESC, 1""",
)
def summary_sort(t):
    # operations are counted before the names are joined
    counts = t.v_op.groupBy("id_recinto").agg(F.count(F.lit(1)).alias("n_ops"))
    label = F.coalesce(first_nonblank(F.col("nombre")), F.concat(F.lit("Recinto "), F.col("id_recinto").cast("string")))
    return counts.join(t.v_plot.select("id_recinto", label.alias("nombre")), "id_recinto").orderBy(
        F.desc("n_ops"), F.lower("nombre"), "id_recinto"
    )


@query(
    "union_all_plan",
    f"""WITH sub AS (SELECT o_orderkey AS id_subparcela, o_custkey AS id_recinto,
        CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE o_orderpriority END AS nombre,
        CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 9 AS DOUBLE) END AS superficie_ha,
        (o_orderkey * 3) % 2600 AS cod_producto FROM orders),
    cur AS (SELECT * EXCLUDE (rn) FROM (
        SELECT c.*, row_number() OVER (PARTITION BY id_recinto
               ORDER BY coalesce(fecha_siembra, fecha_implantacion) DESC NULLS LAST, id_cultivo DESC) AS rn
        FROM v_crop c WHERE id_padre IS NOT NULL AND coalesce(estado, '') NOT IN ('eliminado', 'cerrado')) WHERE rn = 1),
    pc AS (SELECT c.id_recinto, coalesce({NB('d.descripcion')}, {NB('c.tipo_cultivo')}) AS cultivo
           FROM cur c LEFT JOIN v_product d ON d.codigo = c.cod_producto)
    SELECT p.id_recinto, s.id_subparcela,
           coalesce({NB('s.nombre')}, p.nombre, 'Recinto ' || CAST(p.id_recinto AS VARCHAR)) AS nombre,
           coalesce(d.descripcion, pc.cultivo, '') AS cultivo,
           round(coalesce(s.superficie_ha, p.superficie_ha, 0), 4) AS ha, 'subparcela' AS tipo
    FROM v_plot p JOIN sub s ON s.id_recinto = p.id_recinto LEFT JOIN v_product d ON d.codigo = s.cod_producto
    LEFT JOIN pc ON pc.id_recinto = p.id_recinto
    UNION ALL
    SELECT p.id_recinto, NULL, coalesce({NB('p.nombre')}, 'Recinto ' || CAST(p.id_recinto AS VARCHAR)),
           coalesce(pc.cultivo, ''), round(coalesce(p.superficie_ha, 0), 4), 'recinto'
    FROM v_plot p LEFT JOIN pc ON pc.id_recinto = p.id_recinto
    WHERE NOT EXISTS (SELECT 1 FROM sub x WHERE x.id_recinto = p.id_recinto)""",
)
def union_all_plan(t):
    return C.plan_rows(t.v_plot, subplots(t), t.v_crop, t.v_product)


def subplots(t):
    k = F.col("o_orderkey")
    return t.orders.select(
        k.alias("id_subparcela"),
        F.col("o_custkey").alias("id_recinto"),
        F.when(k % 5 == 0, " ").otherwise(F.col("o_orderpriority")).alias("nombre"),
        F.when(k % 4 == 0, None).otherwise((k % 9).cast("double")).alias("superficie_ha"),
        ((k * 3) % 2600).alias("cod_producto"),
    )


@query(
    "crop_plan",
    f"""WITH sub AS (SELECT o_orderkey AS id_subparcela, o_custkey AS id_recinto,
        CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE o_orderpriority END AS nombre,
        CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 9 AS DOUBLE) END AS superficie_ha,
        (o_orderkey * 3) % 2600 AS cod_producto FROM orders), {CURRENT},
    s AS (SELECT id_recinto, count(*) AS n FROM sub GROUP BY 1)
    SELECT p.id_recinto, coalesce({NB('p.nombre')}, 'Recinto ' || CAST(p.id_recinto AS VARCHAR)) AS nombre,
           round(p.w * p.h, 4) AS superficie_ha,
           coalesce({NB('d.descripcion')}, {NB('c.tipo_cultivo')}, '') AS cultivo,
           coalesce(s.n, 0) AS n_subparcelas, u.id_subparcela,
           CASE WHEN u.id_subparcela IS NOT NULL THEN trim(u.nombre) END AS sub_nombre,
           CASE WHEN u.id_subparcela IS NOT NULL THEN coalesce(u.superficie_ha, 0) END AS sub_ha,
           CASE WHEN u.id_subparcela IS NOT NULL THEN trim(coalesce(e.descripcion, '')) END AS sub_cultivo
    FROM v_plot p LEFT JOIN cur c ON c.id_recinto = p.id_recinto LEFT JOIN v_product d ON d.codigo = c.cod_producto
    LEFT JOIN s ON s.id_recinto = p.id_recinto LEFT JOIN sub u ON u.id_recinto = p.id_recinto
    LEFT JOIN v_product e ON e.codigo = u.cod_producto""",
)
def crop_plan(t):
    plots = t.v_plot.withColumn("geom_ha", F.col("w") * F.col("h"))
    return C.crop_plan(plots, subplots(t), t.v_crop, t.v_product)


@query(
    "farm_notebook",
    f"""WITH {CURRENT}, ops AS (
      SELECT id_recinto, count(*) AS n, string_agg(tipo, '|' ORDER BY pos) AS tipos FROM (
        SELECT *, row_number() OVER (PARTITION BY id_recinto ORDER BY fecha DESC, id_operacion DESC) AS pos
        FROM v_op WHERE fecha >= (SELECT max(fecha) FROM v_op) - 60) WHERE pos <= 5 GROUP BY 1),
    x AS (SELECT c.id_recinto, c.id_cultivo, coalesce(fecha_siembra, fecha_implantacion) AS fecha_inicio,
        coalesce({NB('c.tipo_cultivo')}, {NB('d.descripcion')}, 'Sin cultivo') AS cultivo,
        coalesce(upper({NB('c.tipo_registro')}), 'CAMPANA') AS tr, coalesce(p.superficie_ha, 0) AS ha
      FROM cur c JOIN v_plot p ON p.id_recinto = c.id_recinto AND coalesce(p.activa, true)
      LEFT JOIN v_product d ON d.codigo = c.cod_producto),
    y AS (SELECT *, CASE WHEN tr = 'CAMPANA' THEN 3000.0::DOUBLE ELSE NULL END AS kg_ha FROM x)
    SELECT y.id_recinto, id_cultivo, cultivo, fecha_inicio, kg_ha, round(kg_ha * ha, 0) AS kg_total,
           CAST(coalesce(o.n, 0) AS INT) AS n_ops, coalesce(o.tipos, '') AS tipos
    FROM y LEFT JOIN ops o ON o.id_recinto = y.id_recinto""",
)
def farm_notebook(t):
    since = F.date_sub(t.v_op.agg(F.max("fecha")).scalar(), 60)
    out = C.farm_notebook(t.v_plot, t.v_crop, t.v_product, t.v_op, since)
    return out.withColumn("tipos", F.concat_ws("|", F.transform("operaciones", lambda o: o["tipo"]))).drop("operaciones")


@query(
    "ops_last_30_days",
    """WITH s AS (SELECT *, row_number() OVER (PARTITION BY id_recinto ORDER BY fecha DESC, id_operacion DESC) AS pos
      FROM v_op WHERE fecha >= (SELECT max(fecha) FROM v_op) - 30)
    SELECT id_recinto, count(*) AS n_ops, string_agg(tipo, '|' ORDER BY pos) FILTER (pos <= 5) AS tipos FROM s GROUP BY 1""",
)
def ops_last_30_days(t):
    since = F.date_sub(t.v_op.agg(F.max("fecha")).scalar(), 30)
    out = C.operations_by_plot(t.v_op, since)
    return out.select("id_recinto", "n_ops", F.concat_ws("|", F.transform("ops", lambda o: o["tipo"])).alias("tipos"))


@query(
    "row_numbering",
    """SELECT row_number() OVER (ORDER BY cultivo NULLS LAST, sistexp NULLS LAST, id_recinto) AS rf, id_recinto, cultivo, sistexp
       FROM (SELECT c_custkey AS id_recinto, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS cultivo,
             CASE WHEN c_custkey % 3 = 0 THEN 'R' ELSE 'S' END AS sistexp FROM customer)""",
)
def row_numbering(t):
    from fieldspark.session import number_rows

    k = F.col("c_custkey")
    rows = t.customer.select(
        k.alias("id_recinto"),
        F.when(k % 7 == 0, None).otherwise(F.col("c_mktsegment")).alias("cultivo"),
        F.when(k % 3 == 0, "R").otherwise("S").alias("sistexp"),
    )
    order = [F.col("cultivo").asc_nulls_last(), F.col("sistexp").asc_nulls_last(), F.col("id_recinto").asc()]
    return number_rows(rows, order, "rf")
