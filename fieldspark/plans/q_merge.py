"""Merges, change handling and identifiers."""

from pyspark.sql import functions as F

from fieldspark.operators import crops as C
from fieldspark.operators import merge as M
from fieldspark.plans.registry import query
from fieldspark.sources import files, landing

KEY = ["estacion_id", "fecha"]


def stored_and_incoming(t):
    """Daily rows: what is stored covers the days before June 2000, what arrives the days from 2000 on, with other values."""
    stored = t.v_daily.filter(F.col("fecha") < F.lit("2000-06-01").cast("date"))
    incoming = t.v_daily.filter(F.col("fecha") >= F.lit("2000-01-01").cast("date")).withColumn("tempmedia", F.col("tempmedia") + 1)
    return stored, incoming


@query(
    "insert_if_absent",
    "SELECT estacion_id, fecha, CASE WHEN fecha < DATE '2000-06-01' THEN tempmedia ELSE tempmedia + 1 END AS tempmedia FROM v_daily",
)
def insert_if_absent(t):
    return M.insert_if_absent(*stored_and_incoming(t), KEY, [F.col("tempmedia")]).select(*KEY, "tempmedia")


@query(
    "insert_if_absent_counts",
    """SELECT count(*) AS leidos, count(*) FILTER (fecha >= DATE '2000-06-01') AS insertados, count(*) FILTER (fecha < DATE '2000-06-01') AS omitidos
       FROM v_daily WHERE fecha >= DATE '2000-01-01'""",
)
def insert_if_absent_counts(t):
    return M.insert_counts(*stored_and_incoming(t), KEY)


@query(
    "backfill_window",
    "SELECT estacion_id, fecha, tempmedia FROM v_daily WHERE fecha > (SELECT max(fecha) FROM v_daily) - 15",
)
def backfill_window(t):
    return M.backfill(t.v_daily, t.v_daily.agg(F.max("fecha")).scalar()).select(*KEY, "tempmedia")


@query(
    "upsert_update",
    """SELECT estacion_id, fecha, CASE WHEN fecha < DATE '2000-01-01' THEN tempmedia ELSE tempmedia + 1 END AS tempmedia,
       CASE WHEN fecha < DATE '2000-06-01' THEN 'vieja' ELSE 'nueva' END AS capa FROM v_daily""",
)
def upsert_update(t):
    stored, incoming = stored_and_incoming(t)
    cols = [*KEY, "tempmedia", "capa"]
    return M.upsert(
        stored.withColumn("capa", F.lit("vieja")).select(*cols), incoming.withColumn("capa", F.lit("nueva")).select(*cols), KEY, keep=("capa",)
    )


@query(
    "update_from_join",
    """SELECT a.id_recinto, m.parcela_id FROM v_plot a LEFT JOIN (SELECT provincia, municipio, agregado, zona, min(id_recinto) AS parcela_id FROM v_plot WHERE parcela <> 3 GROUP BY 1, 2, 3, 4) m
       ON m.provincia IS NOT DISTINCT FROM a.provincia AND m.municipio IS NOT DISTINCT FROM a.municipio AND m.agregado IS NOT DISTINCT FROM a.agregado AND m.zona IS NOT DISTINCT FROM a.zona""",
)
def update_from_join(t):
    keys = ["provincia", "municipio", "agregado", "zona"]
    lookup = t.v_plot.filter("parcela <> 3").groupBy(*keys).agg(F.min("id_recinto").alias("parcela_id"))
    return M.update_from_join(t.v_plot.select("id_recinto", *keys), lookup, keys, "parcela_id").select("id_recinto", "parcela_id")


@query(
    "update_from_join_orphans",
    """SELECT count(*) AS huerfanos FROM v_plot a ANTI JOIN (SELECT DISTINCT provincia, municipio, agregado, zona FROM v_plot WHERE parcela <> 3) m
       ON m.provincia IS NOT DISTINCT FROM a.provincia AND m.municipio IS NOT DISTINCT FROM a.municipio AND m.agregado IS NOT DISTINCT FROM a.agregado AND m.zona IS NOT DISTINCT FROM a.zona""",
)
def update_from_join_orphans(t):
    return update_from_join(t).agg(F.count_if(F.col("parcela_id").isNull()).alias("huerfanos"))


@query("update_stats_default", "SELECT id_cultivo, coalesce(nullif(estado, ''), 'planificado') AS estado FROM v_crop")
def update_stats_default(t):
    return t.v_crop.select("id_cultivo", F.coalesce(F.nullif("estado", F.lit("")), F.lit("planificado")).alias("estado"))


@query(
    "delete_using",
    "SELECT c.id_cultivo, c.id_recinto FROM v_crop c WHERE NOT EXISTS (SELECT 1 FROM v_plot p WHERE p.id_recinto = c.id_recinto AND p.id_propietario = 3)",
)
def delete_using(t):
    return M.delete_using(t.v_crop.select("id_cultivo", "id_recinto"), t.v_plot.filter("id_propietario = 3"), ["id_recinto"])


@query(
    "delete_current_crop",
    """WITH cur AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY id_recinto ORDER BY coalesce(fecha_siembra, fecha_implantacion) DESC NULLS LAST, id_cultivo DESC) AS rn
        FROM v_crop c WHERE id_padre IS NOT NULL AND coalesce(estado, '') <> 'eliminado') WHERE rn = 1),
    g AS (SELECT cur.id_cultivo, cur.id_recinto FROM cur JOIN v_plot p ON p.id_recinto = cur.id_recinto AND p.id_propietario = 3)
    SELECT c.id_cultivo, c.id_recinto, CASE WHEN c.id_recinto IN (SELECT id_recinto FROM g) THEN NULL ELSE c.id_padre END AS id_padre
    FROM v_crop c WHERE c.id_cultivo NOT IN (SELECT id_cultivo FROM g)""",
)
def delete_current_crop(t):
    return C.delete_current(t.v_crop, t.v_plot.filter("id_propietario = 3")).select("id_cultivo", "id_recinto", "id_padre")


@query(
    "add_history_crop",
    """WITH cur AS (SELECT id_recinto, max(coalesce(fecha_siembra, fecha_implantacion)) AS s FROM v_crop WHERE id_padre IS NOT NULL AND coalesce(estado, '') <> 'eliminado' GROUP BY 1),
    cand AS (SELECT c_custkey AS id_recinto, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE DATE '1998-01-01' + CAST(c_custkey % 1200 AS INT) END AS inicio FROM customer)
    SELECT cand.id_recinto, inicio, CASE WHEN inicio IS NULL THEN 'sin_fecha' WHEN inicio >= cur.s THEN 'no_anterior' ELSE 'ok' END AS resultado FROM cand LEFT JOIN cur ON cur.id_recinto = cand.id_recinto""",
)
def add_history_crop(t):
    k = F.col("c_custkey")
    candidates = t.customer.select(
        k.alias("id_recinto"), F.when(k % 9 == 0, None).otherwise(F.date_add(F.lit("1998-01-01").cast("date"), (k % 1200).cast("int"))).alias("inicio")
    )
    return C.accept_history(t.v_crop, candidates)


@query(
    "upsert_variety",
    """WITH s AS (SELECT DISTINCT lower(p_name || ' ' || p_brand) AS n FROM part WHERE p_size > 25), i AS (SELECT lower(p_name || ' ' || p_brand) AS n, min(p_partkey) AS k FROM part WHERE p_size <= 25 GROUP BY 1)
    SELECT i.n AS nombre, i.k AS primera FROM i WHERE i.n NOT IN (SELECT n FROM s)""",
)
def upsert_variety(t):
    named = t.part.select(F.lower(F.concat_ws(" ", "p_name", "p_brand")).alias("nombre"), "p_partkey", "p_size")
    stored = named.filter("p_size > 25")
    return M.new_rows(stored, named.filter("p_size <= 25"), ["nombre"], [F.col("p_partkey")]).select("nombre", F.col("p_partkey").alias("primera"))


@query(
    "next_surrogate_id",
    """SELECT (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY c_name, c_custkey) AS id, c_custkey, c_name FROM customer""",
)
def next_surrogate_id(t):
    stored = t.part.select(F.col("p_partkey").alias("id"))
    return M.next_ids(stored, t.customer.select("c_custkey", "c_name"), "id", [F.col("c_name").asc(), F.col("c_custkey").asc()]).select("id", "c_custkey", "c_name")


def requests(t):
    k = F.col("o_orderkey")
    return t.orders.select(
        k.alias("id_solicitud"),
        F.col("o_custkey").alias("id_recinto"),
        (k % 50).alias("id_usuario"),
        F.when(F.col("o_orderstatus") == "F", "aprobada").otherwise("pendiente").alias("estado"),
        F.when(k % 4 == 0, "eliminacion").when(k % 4 == 1, None).otherwise("Aceptacion ").alias("tipo_solicitud"),
        F.when(k % 8 == 0, "venta").otherwise(" ").alias("motivo_solicitud"),
    )


@query(
    "request_resolution",
    """WITH r AS (SELECT o_orderkey AS id, o_custkey AS rec, o_orderkey % 50 AS u, CASE WHEN o_orderstatus = 'F' THEN 'aprobada' ELSE 'pendiente' END AS st,
        CASE WHEN o_orderkey % 4 = 0 THEN 'eliminacion' ELSE 'aceptacion' END AS tipo, CASE WHEN o_orderkey % 8 = 0 THEN 'venta' ELSE '' END AS m FROM orders),
    p AS (SELECT c_custkey AS rec, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 50 END AS o FROM customer),
    w AS (SELECT r.rec, min(r.id) AS id FROM r JOIN p ON p.rec = r.rec WHERE r.st = 'pendiente' AND tipo = 'aceptacion' AND p.o IS NULL GROUP BY 1),
    j AS (SELECT r.*, p.o, coalesce((p.o IS NOT NULL AND p.o <> r.u) OR (p.o IS NULL AND w.id <> r.id), false) AS lost FROM r LEFT JOIN p ON p.rec = r.rec LEFT JOIN w ON w.rec = r.rec)
    SELECT id AS id_solicitud, rec AS id_recinto, u AS id_usuario, CASE WHEN st <> 'pendiente' THEN st WHEN tipo = 'eliminacion' AND m = '' THEN 'pendiente' WHEN tipo = 'eliminacion' THEN 'aprobada'
      WHEN lost THEN 'rechazada' ELSE 'aprobada' END AS estado, CASE WHEN st = 'pendiente' AND tipo <> 'eliminacion' AND lost THEN 'El recinto ya tiene propietario.' END AS motivo_rechazo FROM j""",
)
def request_resolution(t):
    k = F.col("c_custkey")
    plots = t.customer.select(k.alias("id_recinto"), F.when(k % 3 == 0, None).otherwise(k % 50).alias("id_propietario"))
    return M.resolve_requests(requests(t), plots)


def sheets(t):
    """Two flat catalogues and one with parents and children, all from parts."""
    k = F.col("p_partkey")
    base = t.part.withColumn("_pos", k)
    flat = base.select("_pos", F.when(k % 9 == 0, " ").otherwise((k % 700).cast("string")).alias("cod"), F.col("p_name").alias("nom"), F.col("p_type").alias("d"), F.col("p_brand").alias("b"))
    desc = landing.joined_description(F.col("d"), F.when(F.col("_pos") % 2 == 0, F.lit(" ")).otherwise(F.col("b")))
    tree = base.select("_pos", F.col("p_brand").alias("tipo"), (k % 300).cast("string").alias("cod"), F.col("p_name").alias("nom"))
    return [
        landing.catalog_rows(flat, "APROVECHAMIENTO", F.col("cod"), F.col("nom"), description=desc),
        landing.catalog_rows(tree, "MVR_TIPO", F.col("tipo"), F.col("tipo")),
        landing.catalog_rows(tree, "MVR_DETALLE", F.col("cod"), F.col("nom"), parent=F.col("tipo")),
    ]


@query(
    "catalog_unify",
    """WITH a AS (SELECT 'APROVECHAMIENTO' AS catalogo, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE CAST(p_partkey % 700 AS VARCHAR) END AS codigo, '' AS codigo_padre, p_name AS nombre,
        CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_type || ' · ' || p_brand END AS descripcion, p_partkey AS pos FROM part
      UNION ALL SELECT 'MVR_TIPO', p_brand, '', p_brand, NULL, p_partkey FROM part
      UNION ALL SELECT 'MVR_DETALLE', CAST(p_partkey % 300 AS VARCHAR), p_brand, p_name, NULL, p_partkey FROM part)
    SELECT catalogo, codigo, codigo_padre, nombre, descripcion FROM (SELECT *, row_number() OVER (PARTITION BY catalogo, codigo, codigo_padre ORDER BY pos) AS rn FROM a WHERE codigo <> '') WHERE rn = 1""",
)
def catalog_unify(t):
    return landing.catalog_unify(sheets(t)).select("catalogo", "codigo", "codigo_padre", "nombre", "descripcion")


@query(
    "scan_catalog_xlsx",
    """SELECT 'APROVECHAMIENTO' AS catalogo, CAST(p_partkey AS VARCHAR) AS codigo, p_name AS nombre, p_type AS descripcion, CASE WHEN p_partkey % 4 = 0 THEN DATE '2024-01-01' + CAST(p_partkey % 700 AS INT) END AS fecha_baja FROM part
    UNION ALL SELECT 'TIPO_LABOR', CAST(p_partkey AS VARCHAR), p_brand, NULL, NULL FROM part""",
)
def scan_catalog_xlsx(t):
    """Sheets exported as CSV files, written and read back under the shared folder."""
    from fieldspark.session import scratch_path

    k = F.col("p_partkey")
    end = F.when(k % 4 == 0, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 700).cast("int")), "dd/MM/yyyy"))
    root = scratch_path(t.spark, "sheets")
    exports = {
        "APROVECHAMIENTO": t.part.select(k.alias("Código SIEX"), F.col("p_name").alias("Aprovechamiento"), F.col("p_type").alias("Descripción"), end.alias("Fecha de baja")),
        "TIPO_LABOR": t.part.select(k.alias("Código SIEX"), F.col("p_brand").alias("Descripción")),
    }
    for name, df in exports.items():
        df.write.option("header", True).csv(f"{root}/{name}")
    rows = landing.catalog_sheets(lambda name: files.read_csv(t.spark, f"{root}/{name}") if name in exports else None)
    out = rows[0].unionByName(rows[1])
    return out.select("catalogo", "codigo", "nombre", "descripcion", "fecha_baja")


def exported(t, name):
    """A sheet with the columns of the catalogues it feeds, all from parts."""
    k = F.col("p_partkey")
    day = lambda every: F.when(k % every == 0, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 700).cast("int")), "dd/MM/yyyy"))
    values = {"_pos": k}
    for _, sheet, code, label, description, parent in landing.CATALOG_COLUMNS:
        if sheet == name:
            for column, value in ((code, F.when(k % 9 == 0, " ").otherwise((k % 500).cast("string"))), (label, F.col("p_name")), (description, F.col("p_type")), (parent, F.col("p_brand"))):
                if column:
                    values[column] = value
    values[landing.END_DATE] = day(4)
    if name == "FERT_DETALLE_MATERIAL":
        values["Nombre producto"] = F.when(k % 6 == 0, " ").otherwise(F.col("p_name"))
    if name == "FITOS_PRODUCTOS":
        values |= {"Formulado": F.when(k % 5 != 0, F.col("p_type")), "Titular": F.col("p_brand"), "Estado": F.when(k % 2 == 0, " ").otherwise("Vigente"), "FechaCaducidad": day(3), "FechaLimiteVenta": day(2)}
    return t.part.select(*[v.alias(c) for c, v in values.items()])


_SHEETS = ", ".join(f"('{c}', {d is not None}, {p is not None})" for c, _, _, _, d, p in landing.CATALOG_COLUMNS)


@query(
    "catalog_all_sheets",
    f"""WITH spec(catalogo, d, p) AS (VALUES {_SHEETS}), k AS (SELECT *, p_partkey AS n, DATE '2024-01-01' + CAST(p_partkey % 700 AS INT) AS dia FROM part),
    a AS (SELECT catalogo, n, CASE WHEN catalogo = 'MVR_TIPO' THEN p_brand WHEN n % 9 = 0 THEN '' ELSE CAST(n % 500 AS VARCHAR) END AS codigo, CASE WHEN p THEN p_brand ELSE '' END AS codigo_padre,
        CASE WHEN catalogo = 'FERT_PRODUCTO' AND n % 6 = 0 THEN 'Fertilizante ' || CAST(n % 500 AS VARCHAR) ELSE p_name END AS nombre,
        CASE WHEN catalogo = 'FITOS_PRODUCTOS' THEN CASE WHEN n % 5 <> 0 THEN p_type || ' · ' ELSE '' END || 'Titular: ' || p_brand || CASE WHEN n % 2 = 1 THEN ' · Estado: Vigente' ELSE '' END WHEN d THEN p_type END AS descripcion,
        CASE WHEN catalogo = 'FERT_PRODUCTO' THEN NULL WHEN catalogo = 'FITOS_PRODUCTOS' THEN CASE WHEN n % 3 = 0 OR n % 2 = 0 THEN dia END WHEN n % 4 = 0 THEN dia END AS fecha_baja FROM k, spec)
    SELECT catalogo, codigo, codigo_padre, nombre, descripcion, fecha_baja FROM (SELECT *, row_number() OVER (PARTITION BY catalogo, codigo, codigo_padre ORDER BY n) AS rn FROM a WHERE codigo <> '') WHERE rn = 1""",
)
def catalog_all_sheets(t):
    """All 33 catalogues of the 32 sheets, parents, children and registered products included."""
    rows = landing.catalog_unify(landing.catalog_sheets(lambda name: exported(t, name)))
    return rows.select("catalogo", "codigo", "codigo_padre", "nombre", "descripcion", "fecha_baja")


@query(
    "crop_popup_view",
    "SELECT c.id_cultivo, c.cod_producto, d.descripcion AS cultivo FROM v_crop c LEFT JOIN v_product d ON CAST(d.codigo AS DOUBLE) = CAST(c.cod_producto AS DOUBLE)",
)
def crop_popup_view(t):
    C.with_product(t.v_crop, t.v_product).select("id_cultivo", "cod_producto", F.col("descripcion").alias("cultivo")).createOrReplaceTempView("crop_popup")
    return t.spark.table("crop_popup")


@query(
    "keep_newest_versions",
    """WITH v AS (SELECT o_orderstatus AS conjunto, CAST(o_orderdate AS DATE) AS version, o_orderkey AS id FROM orders),
    k AS (SELECT *, dense_rank() OVER (PARTITION BY conjunto ORDER BY version DESC) AS r FROM v) SELECT conjunto, version, id FROM k WHERE r <= 2""",
)
def keep_newest_versions(t):
    snaps = t.orders.select(F.col("o_orderstatus").alias("conjunto"), F.to_date("o_orderdate").alias("version"), F.col("o_orderkey").alias("id"))
    return files.keep_newest_versions(snaps, 2, ["conjunto"])
