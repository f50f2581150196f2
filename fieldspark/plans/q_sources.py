"""Scans, landed feeds and sinks. Files are written under the shared folder from the given tables and read back."""

from pyspark.sql import functions as F

from fieldspark.functions import projection as P
from fieldspark.functions import ring as R
from fieldspark.functions.numbers import fixed
from fieldspark.functions.text import blank_to_null, capped
from fieldspark.operators import crops as C
from fieldspark.plans.q_geometry import degrees
from fieldspark.plans.registry import query
from fieldspark.plans.views import with_ring
from fieldspark.session import scratch_path, spread
from fieldspark.sources import files, landing


@query(
    "scan_crops",
    """SELECT c.celda, x0 + w / 2 AS lon, y0 + h / 2 AS lat, d.descripcion AS cultivo, c.rg AS sistema FROM v_cell c LEFT JOIN v_product d ON d.codigo = c.celda * 2
       WHERE d.descripcion IS NOT NULL AND trim(d.descripcion) <> ''""",
)
def scan_crops(t):
    rows = with_ring(t.v_cell).withColumn("cod_producto", F.col("celda") * 2)
    named = C.with_product(rows, t.v_product).filter("ring IS NOT NULL").filter(blank_to_null(F.col("descripcion")).isNotNull())
    out = named.select("celda", R.centroid(F.col("ring")).alias("_c"), R.ring_to_wkt(F.col("ring")).alias("wkt"), F.col("descripcion").alias("cultivo"), F.col("rg").alias("sistema"))
    return out.select("celda", F.col("_c.x").alias("lon"), F.col("_c.y").alias("lat"), "cultivo", "sistema")


@query(
    "scan_station_values",
    """SELECT s.nombre, s.codigo, s.x, s.y, d.etpmon AS valor FROM v_station s JOIN v_daily d ON d.estacion_id = s.estacion_id
       WHERE d.fecha = DATE '1998-06-15' AND d.etpmon IS NOT NULL AND s.codigo NOT IN ('ST1', 'ST7') ORDER BY s.codigo""",
)
def scan_station_values(t):
    day = t.v_daily.filter((F.col("fecha") == F.lit("1998-06-15").cast("date")) & F.col("etpmon").isNotNull())
    stations = t.v_station.filter(~F.col("codigo").isin("ST1", "ST7"))
    return stations.join(day, "estacion_id").select("nombre", "codigo", "x", "y", F.col("etpmon").alias("valor")).orderBy("codigo")


@query(
    "scan_csv",
    """SELECT p_partkey AS id, p_name || ';ñ "' || p_brand || '"' AS nombre, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b FROM part""",
)
def scan_csv(t):
    """Semicolons, windows-1252, quotes and a byte-order mark; then whitespace columns without header."""
    root = scratch_path(t.spark, "csv")
    name = F.concat("p_name", F.lit(';ñ "'), "p_brand", F.lit('"'))
    text = t.part.select(F.col("p_partkey").alias("id"), name.alias("nombre"))
    text.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").option("escape", '"').csv(f"{root}/a")
    plain = t.part.select(F.concat_ws("   ", F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.col("p_retailprice").cast("string")).alias("value"))
    plain.write.text(f"{root}/b")
    left = files.read_csv(t.spark, f"{root}/a", "id bigint, nombre string", sep=";", encoding="windows-1252")
    right = files.read_columns(t.spark, f"{root}/b", ["id", "a", "b"]).withColumn("id", F.col("id").cast("long"))
    return left.join(right, "id").select("id", "nombre", "a", "b")


def station_collection(t):
    """Stations as GeoJSON documents of at most 250 features, one per page."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.col("estacion_id").alias("idestacion"), "nombre", "codigo", (F.col("estacion_id") % 2 == 0).alias("activa")).alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates")).alias("geometry"),
    )
    pages = t.v_station.groupBy(F.floor(F.col("estacion_id") / 250).alias("page")).agg(F.collect_list(feature).alias("features"))
    return pages.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value"))


@query("scan_geojson_features", "SELECT estacion_id AS idestacion, nombre, codigo, estacion_id % 2 = 0 AS activa, x, y FROM v_station")
def scan_geojson_features(t):
    path = scratch_path(t.spark, "stations")
    station_collection(t).write.text(path)
    return files.read_geojson(t.spark, path, "idestacion:bigint,nombre:string,codigo:string,activa:boolean", multi_line=False)


@query("scan_paged_tiles", "SELECT estacion_id AS idestacion, nombre FROM v_station")
def scan_paged_tiles(t):
    """The same pages land for two neighbouring tiles; each feature is kept once."""
    root = scratch_path(t.spark, "tiles")
    pages = station_collection(t)
    for tile in ("t0", "t1"):
        pages.write.text(f"{root}/{tile}")
    landed = [files.read_geojson(t.spark, f"{root}/{tile}", "idestacion:bigint,nombre:string", multi_line=False).withColumn("_tile", F.lit(tile)) for tile in ("t0", "t1")]
    return landing.merge_pages(landed, ["idestacion"], [F.col("_tile")]).select("idestacion", "nombre")


@query(
    "tile_grid",
    """WITH b AS (SELECT id_recinto, x0, y0, x0 + w AS x1, y0 + h AS y1, CAST(ceil(w / 0.75) AS INT) AS nx, CAST(ceil(h / 0.75) AS INT) AS ny FROM v_plot)
    SELECT id_recinto, CAST(i AS INT) AS i, CAST(j AS INT) AS j, x0 + i * 0.75 AS x0, y0 + j * 0.75 AS y0, least(x0 + (i + 1) * 0.75, x1) AS x1, least(y0 + (j + 1) * 0.75, y1) AS y1
    FROM b, range(10) a(i), range(10) c(j) WHERE i < nx AND j < ny""",
)
def tile_grid(t):
    return landing.tile_grid(with_ring(t.v_plot).select("id_recinto", "minx", "miny", "maxx", "maxy"), 0.75)


@query("read_latest_snapshot", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey >= 5")
def read_latest_snapshot(t):
    root = scratch_path(t.spark, "snapshots")
    files.write_snapshot(t.customer, f"{root}/a")
    files.write_snapshot(t.customer.filter("c_nationkey >= 5"), f"{root}/b", ["c_mktsegment"])
    t.customer.limit(1).write.parquet(f"{root}/c")  # not finished: no manifest
    return files.read_latest_snapshot(t.spark, f"{root}/*").select("c_custkey", "c_name")


def geometry_texts(t):
    """Polygons with a hole and of two parts as well-known text, plain ones as JSON, points, and broken text."""
    k = F.col("id_recinto") % 6
    w, h = F.col("w"), F.col("h")
    inner = lambda wkt: F.regexp_extract(wkt, r"POLYGON\((.*)\)", 1)

    def box(x0, y0, x1, y1):
        corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
        return F.concat(F.lit("("), F.concat_ws(", ", *[F.concat_ws(" ", a.cast("string"), b.cast("string")) for a, b in corners]), F.lit(")"))

    ring = F.col("ring")
    x, y = F.col("x0"), F.col("y0")
    num = lambda c: c.cast("string")
    dms = F.concat(F.floor(y / 10).cast("int").cast("string"), F.lit("°30'36\"N "), F.floor(x / 10).cast("int").cast("string"), F.lit("°15'0.0\"W"))
    text = (
        F.when(k == 0, F.concat(F.lit("POLYGON("), inner(R.ring_to_wkt(ring)), F.lit(","), box(x + w / 4, y + h / 4, x + w * 0.75, y + h * 0.75), F.lit(")")))
        .when(k == 1, F.concat(F.lit("MULTIPOLYGON(("), inner(R.ring_to_wkt(ring)), F.lit("),("), box(x + w * 2, y, x + w * 3, y + h), F.lit("))")))
        .when(k == 2, F.to_json(R.ring_to_geojson(ring)))
        .when(k == 3, F.concat(F.lit("POINT("), num(x), F.lit(" "), num(y), F.lit(")")))
        .when(k == 4, dms)
        .otherwise(F.lit("POLYGON((1 2, x y))"))
    )
    return with_ring(spread(t.v_plot.select("id_recinto", "x0", "y0", "w", "h"))).select("id_recinto", text.alias("geom"))


@query(
    "load_geometries",
    """SELECT id_recinto, CASE WHEN k < 3 THEN 'polygon' WHEN k < 5 THEN 'point' END AS kind,
      round(CASE WHEN k < 3 THEN x0 WHEN k = 3 THEN x0 WHEN k = 4 THEN -(floor(x0 / 10) + 0.25) END, 9) AS minx, round(CASE WHEN k < 4 THEN y0 WHEN k = 4 THEN floor(y0 / 10) + 0.51 END, 9) AS miny,
      round(CASE WHEN k = 1 THEN x0 + 3 * w WHEN k < 3 THEN x0 + w WHEN k = 3 THEN x0 WHEN k = 4 THEN -(floor(x0 / 10) + 0.25) END, 9) AS maxx, round(CASE WHEN k < 3 THEN y0 + h WHEN k = 3 THEN y0 WHEN k = 4 THEN floor(y0 / 10) + 0.51 END, 9) AS maxy,
      round(CASE k WHEN 0 THEN w * h * 0.75 WHEN 1 THEN 2 * w * h WHEN 2 THEN w * h END, 6) AS area
    FROM (SELECT *, id_recinto % 6 AS k FROM v_plot)""",
)
def load_geometries(t):
    out = landing.load_geometries(geometry_texts(t))
    return out.select("id_recinto", "kind", *[fixed(c, 9).alias(c) for c in ("minx", "miny", "maxx", "maxy")], fixed("area", 6).alias("area"))


@query("load_geometries_rejects", "SELECT id_recinto FROM v_plot WHERE id_recinto % 6 = 5")
def load_geometries_rejects(t):
    return landing.split_rejects(landing.load_geometries(geometry_texts(t)))[1].select("id_recinto")


def feature_answers(t):
    """Answers of a map service in every format, one per customer."""
    k = F.col("c_custkey") % 8
    name, code = F.col("c_mktsegment"), F.col("c_nationkey").cast("string")
    w = F.concat
    body = (
        F.when(k == 0, w(F.lit('{"features": [{"properties": {"COD_USO": "'), code, F.lit('", "CULTIVO": "'), name, F.lit('"}}]}')))
        .when(k == 1, w(F.lit("<html><table><tr><th>OID</th><th>Pixel Value</th><th>Cobertura</th></tr><tr><td>1</td><td>"), code, F.lit("</td><td><b>"), name, F.lit("</b></td></tr></table></html>")))
        .when(k == 2, w(F.lit("Results\nUSO = "), code, F.lit("\nDESC_USO = "), name, F.lit("\n")))
        .when(k == 3, w(F.lit('<?xml version="1.0"?><gml:r><ms:codigo>'), code, F.lit("</ms:codigo><ms:descripcion>"), name, F.lit("</ms:descripcion></gml:r>")))
        .when(k == 4, w(F.lit("<html><table><tr><th>descripcion</th> <td>"), name, F.lit("</td></tr></table></html>")))
        .when(k == 5, F.lit('{"features": []}'))
        .when(k == 6, w(F.lit("a="), code, F.lit("\nb="), name))
        .otherwise(F.lit(""))
    )
    kinds = ["application/json", "text/html", "text/plain", "application/vnd.ogc.gml", "text/html", "application/json", "text/plain", "text/plain"]
    kind = F.element_at(F.array(*[F.lit(v) for v in kinds]), (k + 1).cast("int"))
    customers = spread(t.customer.select("c_custkey", "c_mktsegment", "c_nationkey"))
    return customers.select(F.col("c_custkey").alias("id"), body.alias("body"), kind.alias("content_type"))


@query(
    "land_feature_info",
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 8 IN (0, 1, 2, 3, 6) THEN CAST(c_nationkey AS VARCHAR) END AS codigo, CASE WHEN c_custkey % 8 IN (0, 1, 2, 3, 4, 6) THEN c_mktsegment END AS descripcion,
      CAST(CASE c_custkey % 8 WHEN 1 THEN 3 WHEN 4 THEN 1 WHEN 5 THEN 0 WHEN 7 THEN 0 ELSE 2 END AS INT) AS n_atributos FROM customer""",
)
def land_feature_info(t):
    return landing.land_feature_info(feature_answers(t)).select("id", "codigo", "descripcion", "n_atributos")


@query(
    "land_feature_info_links",
    r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<a\b[^>]*>(.*?)</a>', '\1', 'g'), '(?i)<a\b[^>]*>', '', 'g'), '(?i)</a>', '', 'g'),
      '(?is)\s+onclick\s*=\s*(?:"[^"]*"|''[^'']*'')', '', 'g')) AS limpio FROM pages""",
)
def land_feature_info_links(t):
    return t.pages.select("page_id", F.md5(landing.strip_links(F.col("html"))).alias("limpio"))


def forecast_docs(t):
    """Two forecast days per plot, the second only for even plots; some hours are missing."""
    k = F.col("id_recinto")

    def day(date, shift):
        hours = F.sequence(F.lit(0), F.lit(23))
        two = lambda h: F.lpad(h.cast("string"), 2, "0")
        temp = F.transform(hours, lambda h: F.struct(two(h).alias("periodo"), ((k * 7 + h * shift) % 40).cast("string").alias("value")))
        sky = F.transform(hours, lambda h: F.struct(two(h).alias("periodo"), F.when(h < 7, "11n").otherwise("11").alias("value"), F.lit(" Despejado ").alias("descripcion")))
        humid = F.transform(F.filter(hours, lambda h: h % 2 == 0), lambda h: F.struct(two(h).alias("periodo"), ((k + h) % 100).cast("string").alias("value")))
        wind = F.transform(hours, lambda h: F.struct(two(h).alias("periodo"), F.array(((k + h) % 60).cast("string")).alias("velocidad"), F.array(F.when(h % 2 == 0, "SO").otherwise("C")).alias("direccion")))
        rain = F.array(*[F.struct(F.lit(p).alias("periodo"), ((k + i) % 100).cast("string").alias("value")) for i, p in enumerate(("0006", "0612", "1218", "1800"))])
        return F.struct(F.lit(date).alias("fecha"), temp.alias("temperatura"), sky.alias("estadoCielo"), humid.alias("humedadRelativa"), wind.alias("vientoAndRachaMax"), rain.alias("probPrecipitacion"))

    days = F.when(k % 2 == 0, F.array(day("2024-06-01T00:00:00", 1), day("2024-06-02T00:00:00", 3))).otherwise(F.array(day("2024-06-01T00:00:00", 1)))
    return spread(t.v_plot.select("id_recinto")).select("id_recinto", F.to_json(F.struct(days.alias("dia"))).alias("doc"))


@query(
    "flatten_hourly_forecast",
    """SELECT id_recinto, CASE WHEN id_recinto % 2 = 0 THEN '2024-06-02' ELSE '2024-06-01' END AS fecha, CAST(r.h AS INT) AS hora, CAST((id_recinto * 7 + r.h * CASE WHEN id_recinto % 2 = 0 THEN 3 ELSE 1 END) % 40 AS INT) AS temperatura,
      'Despejado' AS cielo, r.h < 7 AS noche, CAST(CASE WHEN r.h % 2 = 0 THEN (id_recinto + r.h) % 100 END AS INT) AS humedad, CAST((id_recinto + r.h) % 60 AS INT) AS viento, CAST(CASE WHEN r.h % 2 = 0 THEN 225 ELSE 0 END AS INT) AS viento_grados,
      CAST((id_recinto + CASE WHEN r.h < 6 THEN 0 WHEN r.h < 12 THEN 1 WHEN r.h < 18 THEN 2 ELSE 3 END) % 100 AS INT) AS prob_lluvia FROM v_plot, range(24) r(h)""",
)
def flatten_hourly_forecast(t):
    return landing.flatten_hourly_forecast(forecast_docs(t), ["id_recinto"], "doc", F.lit("2024-06-02").cast("date"))


@query(
    "scan_stations_feed",
    """SELECT id_recinto AS idestacion, round(x0 / 100 - 6, 6) AS lon, round(y0 / 100 + 40.5, 6) AS lat, id_recinto % 3 <> 0 AS activa FROM v_plot WHERE id_recinto % 8 <> 0""",
)
def scan_stations_feed(t):
    k = F.col("id_recinto")
    xy = P.to_utm(F.col("minx"), F.col("miny"), F.lit(30))
    feed = degrees(t).select(
        k.alias("idestacion"), F.when(k % 8 != 0, xy["x"]).alias("x"), xy["y"].alias("y"), F.when(k % 3 == 0, F.lit("2020-01-01")).alias("fecha_fin")
    )
    return landing.stations_feed(feed).select("idestacion", fixed("lon", 6).alias("lon"), fixed("lat", 6).alias("lat"), "activa")


@query(
    "sink_csv_features",
    """SELECT row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS "Rf", c_mktsegment AS "Cl", c_custkey AS id, round(c_acctbal / 7, 3) AS v FROM customer""",
)
def sink_csv_features(t):
    path = scratch_path(t.spark, "features")
    rows = t.customer.select(F.col("c_mktsegment").alias("Cl"), F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 7).alias("v"))
    files.write_feature_csv(rows, path, [F.col("Cl").asc(), F.col("id").asc()])
    return files.read_csv(t.spark, path, "Rf bigint, Cl string, id bigint, v double")


@query("sink_replace_table", "SELECT p_partkey, p_name FROM part WHERE p_size > 10")
def sink_replace_table(t):
    path = scratch_path(t.spark, "table")
    files.replace_table(t.part.select("p_partkey", "p_name"), path)
    files.replace_table(t.part.filter("p_size > 10").select("p_partkey", "p_name"), path)
    return t.spark.read.parquet(path)


@query("sink_atomic_swap", "SELECT id_recinto, provincia FROM v_plot WHERE provincia < 20")
def sink_atomic_swap(t):
    """The second snapshot has orphans and is not published, so readers still see the first."""
    root = scratch_path(t.spark, "swap")
    rows = t.v_plot.select("id_recinto", "provincia")
    files.atomic_swap(rows.filter("provincia < 20"), root, "v1", F.col("provincia") >= 20)
    try:
        files.atomic_swap(rows, root, "v2", F.col("provincia") >= 20)
    except ValueError:
        pass
    return files.read_current(t.spark, root)


@query(
    "concat_training_days",
    """SELECT row_number() OVER (ORDER BY dia, estacion_id) AS "Rf", dia, estacion_id, tempmedia FROM (SELECT fecha AS dia, estacion_id, tempmedia FROM v_daily WHERE fecha BETWEEN DATE '1998-06-13' AND DATE '1998-06-15')""",
)
def concat_training_days(t):
    days = [
        t.v_daily.filter(F.col("fecha") == F.lit(f"1998-06-{d}").cast("date")).select(F.lit(0).alias("Rf"), F.col("fecha").alias("dia"), "estacion_id", "tempmedia")
        for d in (13, 14, 15)
    ]
    return files.concat_training_days(days, [F.col("dia").asc(), F.col("estacion_id").asc()])


@query(
    "export_geojson",
    """SELECT id_recinto AS id_rec, CASE WHEN id_recinto % 2 = 0 THEN id_recinto ELSE -1 END AS id_sub, coalesce(substr(nombre, 1, 254), '') AS nombre, 'Polygon' AS tipo, CAST(5 AS INT) AS n FROM v_plot""",
)
def export_geojson(t):
    path = scratch_path(t.spark, "geojson")
    k = F.col("id_recinto")
    props = [k.alias("id_rec"), F.coalesce(F.when(k % 2 == 0, k), F.lit(-1)).alias("id_sub"), capped(F.col("nombre"), 254).alias("nombre")]
    files.geojson_features(with_ring(t.v_plot), R.ring_to_geojson(F.col("ring")), props).write.text(path)
    back = t.spark.read.schema(
        "type string, properties struct<id_rec:bigint,id_sub:bigint,nombre:string>, geometry struct<type:string,coordinates:array<array<array<double>>>>"
    ).json(path)
    return back.select("properties.*", F.col("geometry.type").alias("tipo"), F.size(F.get("geometry.coordinates", F.lit(0))).alias("n"))


@query(
    "stream_sensor_dedup",
    "SELECT DISTINCT user_id AS id_sensor, event_type AS id_variable, strftime(ts, '%Y-%m-%d %H:%M') AS minuto FROM events",
)
def stream_sensor_dedup(t):
    """Events as sensor readings, landed twice as files, read as a stream into a table keyed by sensor, variable, time."""
    from fieldspark.streaming import sensors as SS

    root = scratch_path(t.spark, "sensors")
    rows = t.events.select(
        F.col("event_id").alias("id_medicion"), F.col("user_id").alias("id_sensor"), F.col("event_type").alias("id_variable"),
        F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("fecha_hora"), F.col("value").alias("valor"), F.col("props").alias("otros_datos"),
    )
    rows.write.parquet(f"{root}/in")
    rows.write.mode("append").parquet(f"{root}/in")
    run = SS.start(SS.readings(t.spark, f"{root}/in", files_per_batch=2), f"{root}/out", f"{root}/state", once=True)
    run.awaitTermination()
    return t.spark.read.parquet(f"{root}/out").select(
        "id_sensor", "id_variable", F.date_format("fecha_hora", "yyyy-MM-dd HH:mm").alias("minuto")
    )
