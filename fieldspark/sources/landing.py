"""Landed feeds: stations, tiles, geometry text, feature-info answers, hourly forecasts, legends."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import projection as P
from fieldspark.functions import ring as R
from fieldspark.functions.text import blank_to_null
from fieldspark.operators.merge import dedup_keep_first


# --- stations and tiles ----------------------------------------------------------------------------------------------


def stations_feed(raw: DataFrame, zone: int = 30) -> DataFrame:
    """Stations with coordinates, in degrees; active while they have no end date."""
    ll = P.from_utm(F.col("x").cast("double"), F.col("y").cast("double"), F.lit(zone))
    return (
        raw.dropna(subset=["x", "y"])
        .withColumn("_p", ll)
        .withColumns({"lon": F.col("_p.x"), "lat": F.col("_p.y"), "activa": F.col("fecha_fin").isNull()})
        .drop("_p", "x", "y")
    )


def merge_pages(pages: list[DataFrame], keys: list[str], order: list[Column]) -> DataFrame:
    """Union of landed page files, then the first row per key."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pages)
    return dedup_keep_first(rows, keys, order)


def tile_grid(boxes: DataFrame, step: float) -> DataFrame:
    """Tiles that cover each box; the last ones are clipped to its edge."""

    def starts(lo: str, hi: str) -> Column:
        n = F.greatest(F.lit(1), F.ceil((F.col(hi) - F.col(lo)) / step).cast("int"))
        return F.sequence(F.lit(0), n - 1)

    return (
        boxes.withColumn("i", F.explode(starts("minx", "maxx")))
        .withColumn("j", F.explode(starts("miny", "maxy")))
        .select(
            *[c for c in boxes.columns if c not in ("minx", "miny", "maxx", "maxy")],
            "i",
            "j",
            (F.col("minx") + F.col("i") * step).alias("x0"),
            (F.col("miny") + F.col("j") * step).alias("y0"),
            F.least(F.col("minx") + (F.col("i") + 1) * step, F.col("maxx")).alias("x1"),
            F.least(F.col("miny") + (F.col("j") + 1) * step, F.col("maxy")).alias("y1"),
        )
    )


# --- geometry text ---------------------------------------------------------------------------------------------------


def load_geometries(raw: DataFrame, text: str = "geom") -> DataFrame:
    """Parts, area, point and bounds from WKT, GeoJSON or degree/minute/second text; ``kind`` is null for unreadable rows.

    ``parts`` holds every part with its outer ring and holes, ``ring`` the outer ring where there is just one ring, else null.
    """
    col = F.col(text)
    found = F.coalesce(R.parse_wkt_parts(col), R.parse_geojson_parts(F.when(col.startswith("{"), col)))
    wkt_point = R.parse_wkt_point(col)
    dms = r"^\s*(\d+)°(\d+)'([\d.]+)\"([NS])[ ,]+(\d+)°(\d+)'([\d.]+)\"([EWO])\s*$"

    def part(i: int) -> Column:
        return F.regexp_extract(col, dms, i)

    def axis(i: int) -> Column:
        numbers = [part(i + k).try_cast("double") for k in range(3)]
        return R.dms_to_degrees(*numbers, part(i + 3))

    dms_point = F.when(part(1) != "", R.point(axis(5), axis(1)))
    broken = lambda ring: (F.size(ring) < 3) | F.exists(ring, lambda p: p["x"].isNull() | p["y"].isNull())
    whole = F.size("_found").cast("int") > 0
    whole = whole & ~F.exists("_found", lambda part: (F.size(part) == 0) | F.exists(part, broken))
    point = F.coalesce(wkt_point, dms_point)
    loaded = raw.withColumns({"_found": found, "_p": point}).withColumn("parts", F.when(whole, F.col("_found"))).drop("_found")
    one = (F.size("parts") == 1) & (F.size(F.get("parts", F.lit(0))) == 1)
    loaded = loaded.withColumns({"ring": F.when(one, F.get(F.get("parts", F.lit(0)), F.lit(0))), "area": R.parts_area(F.col("parts"))})
    kind = F.when(F.col("parts").isNotNull(), "polygon").when(F.col("_p").isNotNull(), "point")
    bounds = R.bounds(R.parts_outline(F.col("parts")))
    return (
        loaded.withColumn("kind", kind)
        .withColumns({"x": F.col("_p.x"), "y": F.col("_p.y")})
        .withColumns(
            {name: F.coalesce(value, F.col("x" if name.endswith("x") else "y")) for name, value in bounds.items()}
        )
        .drop("_p")
    )


def split_rejects(loaded: DataFrame) -> tuple[DataFrame, DataFrame]:
    return loaded.filter("kind IS NOT NULL"), loaded.filter("kind IS NULL")


# --- feature-info answers --------------------------------------------------------------------------------------------

# Attribute names of use codes and descriptions, best first.
CODE_NAMES = ("USO", "COD_USO", "CODIGO", "COD", "Uso", "uso", "codigo")
DESCRIPTION_NAMES = ("DESC_USO", "DESCRIPCION", "CULTIVO", "Descripcion", "descripcion")
DESCRIPTION_ONLY_NAMES = DESCRIPTION_NAMES + ("cultivo",)
IGNORED_NAMES = ("OID", "Count", "count")

_CELL = r"(?is)<t{tag}[^>]*>(.*?)</t{tag}>"


def _strip_tags(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"(?s)<[^>]+>", ""))


def strip_links(html: Column) -> Column:
    """Text with anchors unwrapped and click handlers gone: the markup is cut into tags and text, and each tag is judged on its own."""
    pieces = F.regexp_extract_all(html, F.lit(r"(?s)(<[^>]*>|[^<]+|<)"), F.lit(1))

    def kept(piece: Column) -> Column:
        handler = r"(?is)\s+onclick\s*=\s*(?:\"[^\"]*\"|'[^']*')"
        return F.when(piece.startswith("<"), F.regexp_replace(piece, handler, "")).otherwise(piece)

    anchor = lambda piece: piece.rlike(r"(?i)^</?a(?:[\s/>]|$)")
    return F.array_join(F.transform(F.filter(pieces, lambda p: ~anchor(p)), kept), "")


def _entries_to_map(entries: Column) -> Column:
    """Map of ``array<struct<k,v>>``; the last value of a repeated key wins, empty keys are dropped."""
    named = F.filter(entries, lambda e: e["k"] != "")
    last = F.filter(
        F.transform(named, lambda e, i: F.struct(e["k"].alias("k"), e["v"].alias("v"), i.alias("i"))),
        lambda e: ~F.exists(F.slice(named, e["i"] + 2, F.greatest(F.size(named), F.lit(1))), lambda later: later["k"] == e["k"]),
    )
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))


def attributes_of(body: Column, content_type: Column) -> Column:
    """Attribute map of a JSON, HTML-table, ``k=v`` or XML answer; null when it holds none."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    doc = F.from_json(body, "features array<struct<properties:map<string,string>>>")
    from_json = F.get(doc["features"], F.lit(0))["properties"]

    rows = F.regexp_extract_all(body, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)
    heads = lambda r: F.transform(F.regexp_extract_all(r, F.lit(_CELL.replace("{tag}", "h")), 1), _strip_tags)
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(_CELL.replace("{tag}", "d")), 1), _strip_tags)
    parsed = F.transform(rows, lambda r, i: F.struct(heads(r).alias("h"), cells(r).alias("d"), i.alias("i")))
    head_rows = F.filter(parsed, lambda r: (F.size(r["h"]) > 0) & (F.size(r["d"]) == 0))
    first_head = F.get(head_rows, F.lit(0))["i"]
    data = F.get(F.filter(parsed, lambda r: (F.size(r["d"]) > 0) & (r["i"] > first_head)), F.lit(0))
    head = F.get(F.reverse(F.filter(head_rows, lambda r: r["i"] < data["i"])), F.lit(0))
    width = F.least(F.size(head["h"]), F.size(data["d"]))
    zipped = F.zip_with(
        F.slice(head["h"], F.lit(1), width), F.slice(data["d"], F.lit(1), width), lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    )
    pair = r"(?is)<th[^>]*>(.*?)</th>\s*<td[^>]*>(.*?)</td>"
    inline = F.zip_with(
        F.transform(F.regexp_extract_all(body, F.lit(pair), 1), _strip_tags),
        F.transform(F.regexp_extract_all(body, F.lit(pair), 2), _strip_tags),
        lambda k, v: F.struct(k.alias("k"), v.alias("v")),
    )
    from_table = F.when(F.size(zipped) > 0, _entries_to_map(zipped)).when(F.size(inline) > 0, _entries_to_map(inline))

    lines = F.filter(F.split(body, r"\r\n|\r|\n"), lambda s: s.contains("="))
    pairs = F.transform(
        lines,
        lambda s: F.struct(
            F.trim(F.substring_index(s, "=", 1)).alias("k"),
            F.trim(F.regexp_replace(s, r"(?s)^[^=]*=", "")).alias("v"),
        ),
    )
    from_text = F.when(F.size(lines) > 0, _entries_to_map(pairs))

    leaf = r"<(?:[\w.-]+:)?([\w.-]+)(?:\s[^<>]*)?>\s*([^<>]*[^<>\s])\s*</"
    leaves = F.filter(
        F.zip_with(
            F.regexp_extract_all(body, F.lit(leaf), 1),
            F.regexp_extract_all(body, F.lit(leaf), 2),
            lambda k, v: F.struct(k.alias("k"), v.alias("v")),
        ),
        lambda e: F.lower(e["k"]) != "serviceexception",
    )
    from_xml = F.when(F.size(leaves) > 0, _entries_to_map(leaves))
    is_html = kind.contains("html") | F.lower(F.substring(body, 1, 200)).contains("<html")
    return (
        F.when(F.length(F.trim(body)) < 1, None)
        .when(kind.contains("json"), from_json)
        .when(is_html, from_table)
        .when(kind.contains("xml") | kind.contains("gml"), from_xml)
        .when(kind.contains("text"), from_text)
    )


def use_of(attributes: Column) -> dict[str, Column]:
    """``codigo`` and ``descripcion`` by the priority of attribute names."""

    def first_of(names: tuple[str, ...]) -> Column:
        return F.coalesce(*[F.try_element_at(attributes, F.lit(n)) for n in names])

    cover = F.try_element_at(attributes, F.lit("Cobertura"))
    pixel = F.coalesce(
        blank_to_null(F.try_element_at(attributes, F.lit("Pixel Value"))), blank_to_null(F.try_element_at(attributes, F.lit("OID")))
    )
    code = first_of(CODE_NAMES)
    only = first_of(DESCRIPTION_ONLY_NAMES)
    rest = F.filter(F.map_entries(attributes), lambda e: ~e["key"].isin(*IGNORED_NAMES))
    first, second = F.get(rest, F.lit(0))["value"], F.get(rest, F.lit(1))["value"]
    return {
        "codigo": F.when(cover.isNotNull(), pixel)
        .when(code.isNotNull(), code)
        .when(only.isNotNull(), None)
        .otherwise(first),
        "descripcion": F.when(cover.isNotNull(), cover)
        .when(code.isNotNull(), first_of(DESCRIPTION_NAMES))
        .when(only.isNotNull(), only)
        .otherwise(second),
    }


def land_feature_info(raw: DataFrame) -> DataFrame:
    """Code and description per answer (``body``, ``content_type``), with the attribute count; 0 marks empty answers."""
    landed = raw.withColumn("atributos", attributes_of(F.col("body"), F.col("content_type")))
    return landed.withColumns(use_of(F.col("atributos"))).withColumn(
        "n_atributos", F.coalesce(F.size("atributos"), F.lit(0))
    )


# --- hourly forecast -------------------------------------------------------------------------------------------------

FORECAST_SCHEMA = (
    "dia array<struct<fecha:string,"
    "temperatura:array<struct<periodo:string,value:string>>,"
    "estadoCielo:array<struct<periodo:string,value:string,descripcion:string>>,"
    "humedadRelativa:array<struct<periodo:string,value:string>>,"
    "vientoAndRachaMax:array<struct<periodo:string,velocidad:array<string>,direccion:array<string>>>,"
    "probPrecipitacion:array<struct<periodo:string,value:string>>>>"
)

# Degrees of the wind directions.
WIND_DEGREES = {"N": 0, "NE": 45, "E": 90, "SE": 135, "S": 180, "SO": 225, "O": 270, "NO": 315}


def interval_holds(period: Column, hour: Column) -> Column:
    """Hour inside ``HHhh``; an interval that ends at 00 or wraps midnight holds every hour."""
    start, end = F.substring(period, 1, 2).try_cast("int"), F.substring(period, 3, 2).try_cast("int")
    wraps = (end == 0) | (end < start)
    return (F.length(period) == 4) & F.when(wraps, F.lit(True)).otherwise((hour >= start) & (hour < end))


def flatten_hourly_forecast(raw: DataFrame, keys: list[str], doc: str, today: Column) -> DataFrame:
    """One row per place and hour of the chosen day: today's, else the first one."""
    days = raw.select(*keys, F.from_json(F.col(doc), FORECAST_SCHEMA)["dia"].alias("_d"))
    same = F.filter("_d", lambda d: F.substring(d["fecha"], 1, 10) == F.date_format(today, "yyyy-MM-dd"))
    chosen = days.select(*keys, F.coalesce(F.get(same, F.lit(0)), F.get("_d", F.lit(0))).alias("d")).filter("d IS NOT NULL")
    hourly = chosen.withColumn("hora", F.explode(F.sequence(F.lit(0), F.lit(23))))

    def at_hour(field: str) -> Column:
        return F.get(F.filter(F.col(f"d.{field}"), lambda v: v["periodo"].try_cast("int") == F.col("hora")), F.lit(0))

    wind = at_hour("vientoAndRachaMax")
    rain = F.get(F.filter("d.probPrecipitacion", lambda v: interval_holds(v["periodo"], F.col("hora"))), F.lit(0))
    heading = F.get(wind["direccion"], F.lit(0))
    degrees = F.create_map(*[F.lit(v) for kv in WIND_DEGREES.items() for v in kv])
    sky = at_hour("estadoCielo")
    return hourly.select(
        *keys,
        F.substring("d.fecha", 1, 10).alias("fecha"),
        "hora",
        at_hour("temperatura")["value"].try_cast("int").alias("temperatura"),
        F.coalesce(F.trim(sky["descripcion"]), F.lit("Desconocido")).alias("cielo"),
        F.coalesce(sky["value"].contains("n"), F.lit(False)).alias("noche"),
        at_hour("humedadRelativa")["value"].try_cast("int").alias("humedad"),
        F.get(wind["velocidad"], F.lit(0)).try_cast("int").alias("viento"),
        F.when(heading.isNotNull(), F.coalesce(F.try_element_at(degrees, heading), F.lit(0))).alias("viento_grados"),
        rain["value"].try_cast("int").alias("prob_lluvia"),
    ).filter("temperatura IS NOT NULL OR humedad IS NOT NULL OR viento IS NOT NULL OR prob_lluvia IS NOT NULL")


# --- legends and catalogues ------------------------------------------------------------------------------------------

# Header spellings of legend files.
LEGEND_HEADERS = {
    "code": ("cod cultivo", "codcultivo", "cod", "code"),
    "label": ("descripción cultivo", "descripcion cultivo", "cubierta", "label", "name"),
    "r": ("r", "red"),
    "g": ("g", "green"),
    "b": ("b", "blue"),
}


def _hex(col: Column) -> Column:
    return F.lpad(F.hex(F.least(F.lit(255), F.greatest(F.lit(0), col))), 2, "0")


def legend_rows(raw: DataFrame, year: Column) -> DataFrame:
    """Year, code, label, colours and ``#RRGGBB`` of one legend table, whatever its headers; invalid rows dropped."""
    # headers come with byte-order marks, quotes and line breaks: compared as plain lower-case words
    found = {" ".join(re.findall(r'[^\s"\ufeff]+', c)).lower(): c for c in raw.columns}

    def pick(field: str) -> Column:
        names = [found[n] for n in LEGEND_HEADERS[field] if n in found]
        return F.trim(F.col(f"`{names[0]}`").cast("string")) if names else F.lit(None).cast("string")

    color = {k: F.coalesce(pick(k).try_cast("int"), F.lit(0)) for k in "rgb"}
    return (
        raw.select(
            year.cast("int").alias("anio"),
            pick("code").try_cast("int").alias("code"),
            pick("label").alias("label"),
            *[v.alias(k) for k, v in color.items()],
        )
        .filter("code IS NOT NULL AND code <> -1 AND label IS NOT NULL AND label <> ''")
        .withColumn("hex", F.concat(F.lit("#"), _hex(F.col("r")), _hex(F.col("g")), _hex(F.col("b"))))
    )


def fill_from_legend(history: DataFrame, legend: DataFrame) -> DataFrame:
    """Missing descriptions from the legend of the same year."""
    known = legend.select("anio", F.col("code").cast("string").alias("_c"), F.col("label").alias("_l")).dropDuplicates(["anio", "_c"])
    return (
        history.withColumn("_c", F.trim("uso_codigo"))
        .join(known, ["anio", "_c"], "left")
        .withColumn("uso_descripcion", F.coalesce("uso_descripcion", "_l"))
        .drop("_c", "_l")
    )


def catalog_rows(
    sheet: DataFrame,
    catalog: str,
    code: Column,
    name: Column,
    parent: Column | None = None,
    description: Column | None = None,
    end_date: Column | None = None,
    source: str = "SIEX",
) -> DataFrame:
    """One sheet in the common shape, with the whole row kept as JSON (nulls left out)."""
    return sheet.select(
        F.lit(catalog).alias("catalogo"),
        F.trim(code.cast("string")).alias("codigo"),
        F.trim(F.coalesce(parent.cast("string"), F.lit(""))).alias("codigo_padre") if parent is not None else F.lit("").alias("codigo_padre"),
        F.trim(F.coalesce(name.cast("string"), F.lit(""))).alias("nombre"),
        (F.trim(description.cast("string")) if description is not None else F.lit(None).cast("string")).alias("descripcion"),
        (end_date if end_date is not None else F.lit(None).cast("date")).alias("fecha_baja"),
        F.lit(source).alias("fuente"),
        F.to_json(F.struct(*sheet.columns)).alias("extra"),
        *([F.col("_pos")] if "_pos" in sheet.columns else [F.lit(0).cast("long").alias("_pos")]),
    )


def joined_description(*parts: Column) -> Column:
    """Non-empty parts joined by `` · ``; null when all are empty."""
    text = F.concat_ws(" · ", *[blank_to_null(p.cast("string")) for p in parts])
    return F.when(text != "", text)


def catalog_unify(sheets: list[DataFrame]) -> DataFrame:
    """All sheets in one table; blank codes are left out and the first row of a key wins."""
    rows = reduce(lambda a, b: a.unionByName(b), sheets).filter("codigo IS NOT NULL AND codigo <> ''")
    keys = ["catalogo", "codigo", "codigo_padre"]
    return dedup_keep_first(rows, keys, [F.col("_pos"), F.col("extra")]).drop("_pos")


def catalog_sheets(sheet_of, pos: Column | None = None) -> list[DataFrame]:
    """The known catalogues from exported sheets; ``sheet_of(sheet name)`` gives a sheet as a DataFrame or null. Missing columns count as empty."""
    out = []
    for catalog, name, *columns in CATALOG_COLUMNS:
        sheet = sheet_of(name)
        if sheet is None:
            continue
        code, label, description, parent = (_column(sheet, c) for c in columns)
        end = _date_of(sheet, END_DATE)
        if catalog == "FERT_PRODUCTO":
            label, end = F.coalesce(blank_to_null(label), F.concat(F.lit("Fertilizante "), code)), None
        elif catalog == "FITOS_PRODUCTOS":
            texts = [(head, blank_to_null(_column(sheet, c))) for head, c in PRODUCT_TEXTS]
            description = joined_description(*[F.concat(F.lit(head), text) for head, text in texts])
            end = F.coalesce(*[_date_of(sheet, c) for c in PRODUCT_DATES])
        rows = catalog_rows(sheet, catalog, code, label, parent=parent, description=description, end_date=end)
        if catalog == "MVR_TIPO":  # a parent keeps its own columns, not those of one of its children
            own = sheet.select(*[c for c in PARENT_EXTRA if c in sheet.columns])
            rows = rows.withColumn("extra", F.to_json(F.from_json("extra", own.schema)))
        out.append(rows)
    return out


def _column(sheet: DataFrame, name: str | None) -> Column:
    return F.col(f"`{name}`").cast("string") if name and name in sheet.columns else F.lit(None).cast("string")


def _date_of(sheet: DataFrame, name: str) -> Column:
    return _end_date(_column(sheet, name))


def _end_date(col: Column) -> Column:
    from fieldspark.functions.dates import parse_any_date

    return parse_any_date(col.cast("string"))


# Catalogue, exported sheet, and its columns of code, name, description and parent.
CATALOG_COLUMNS = (
    ("ACTIVIDAD_AGRARIA", "ACTIVIDAD_AGRARIA", "Código SIEX", "Actividad agraria", None, None),
    ("ACTIVIDAD_CUBIERTA", "ACTIVIDAD_CUBIERTA", "Código SIEX", "Actividad sobre la cubierta", None, None),
    ("APROVECHAMIENTO", "APROVECHAMIENTO", "Código SIEX", "Aprovechamiento", "Descripción", None),
    ("TIPO_COBERTURA_SUELO", "TIPO_COBERTURA_SUELO", "Código SIEX", "Tipo de cobertura del suelo", None, None),
    ("DESTINO_CULTIVO", "DESTINO_CULTIVO", "Código SIEX", "Destino del cultivo", "Observaciones", None),
    ("MVR_TIPO", "MATERIAL_VEGETAL", "Código del tipo", "Tipo de material vegetal de reproducción", None, None),
    ("MVR_DETALLE", "MATERIAL_VEGETAL", "Código", "Detalle del tipo", None, "Código del tipo"),
    ("SISTEMA_CULTIVO", "SISTEMA_CULTIVO", "Código SIEX", "Sistema de cultivo", None, None),
    ("TIPO_LABOR", "TIPO_LABOR", "Código SIEX", "Descripción", None, None),
    ("MVR_PROCEDENCIA", "MVR_PROCEDENCIA", "Código SIEX", "Procedencia del material vegetal", None, None),
    ("SENP", "SENP", "Código SIEX", "Tipo", "Observaciones", None),
    ("RIEGO_SISTEMA", "RIEGO_SISTEMA", "Código SIEX", "Sistema de riego", None, None),
    ("RIEGO_PROCEDENCIA", "RIEGO_PROCEDENCIA", "Código SIEX", "Procedencia del agua de riego", "Observaciones", None),
    ("FERT_TIPO", "FERT_TIPO", "Código SIEX", "Tipo de fertilización", None, None),
    ("FERT_METODO", "FERT_METODO", "Código SIEX", "Método de fertilización", None, None),
    ("FERT_MATERIAL", "FERT_MATERIAL", "Código SIEX", "Tipo de material", "Campos a registrar (información disponible según tipo de producto o material)", None),
    ("FERT_TRAT_ESTIERCOL", "FERT_TRAT_ESTIERCOL", "Código SIEX", "Tratamiento de estiércoles", None, None),
    ("FERT_MACRO", "FERT_MACRO", "Código SIEX", "Descripción", None, None),
    ("FERT_MICRO", "FERT_MICRO", "Código SIEX", "Descripción", None, None),
    ("FERT_METALES", "FERT_METALES", "Código SIEX", "Descripción", None, None),
    ("FERT_PRODUCTO", "FERT_DETALLE_MATERIAL", "C_FERTILIZANTE", "Nombre producto", "Fabricante", "Código SIEX"),
    ("FITOS_TIPO_MEDIDA", "FITOS_TIPO_MEDIDA", "Código SIEX", "Tipo de medida fitosanitaria", None, None),
    ("FITOS_TIPO_PRODUCTO", "FITOS_TIPO_PRODUCTO", "Código SIEX", "Tipo de producto fitosanitario", None, None),
    ("FITOS_ESTADO_FENO", "FITOS_ESTADO_FENO", "Código SIEX", "Estado fenológico", None, None),
    ("FITOS_MALAS_HIERBAS", "FITOS_MALAS_HIERBAS", "Código SIEX", "Nombre científico", "Observaciones", "Categoría"),
    ("FITOS_ENFERMEDADES", "FITOS_ENFERMEDADES", "Código SIEX", "Nombre científico", "Observaciones", "Categoría"),
    ("FITOS_PLAGAS", "FITOS_PLAGAS", "Código SIEX", "Nombre científico", "Observaciones", "Categoría"),
    ("FITOS_REGULADORES_OTROS", "FITOS_REGULADORES_OTROS", "Código SIEX", "Nombre científico / Denominación en inglés", "Observaciones", "Categoría"),
    ("FITOS_MEDIDA_PREV", "FITOS_MEDIDA_PREV", "Código SIEX", "Medida", "Observaciones", None),
    ("FITOS_EFICACIA", "FITOS_EFICACIA", "Código SIEX", "Eficacia del tratamiento", None, None),
    ("FITOS_AUT_EXCEP", "FITOS_AUT_EXCEP", "Código SIEX", "Producto comercial", "Sustancia activa o formulado", None),
    ("FITOS_JUSTIFICACION", "FITOS_JUSTIFICACION", "Código SIEX", "Justificación de la actuación", None, None),
    ("FITOS_PRODUCTOS", "FITOS_PRODUCTOS", "NumRegistro", "Nombre", None, None),
)
# The column of the end date, the columns of a parent, and what the description and the end date of a registered product come from.
END_DATE = "Fecha de baja"
PARENT_EXTRA = ("Código del tipo", "Tipo de material vegetal de reproducción")
PRODUCT_TEXTS = (("", "Formulado"), ("Titular: ", "Titular"), ("Fabricante: ", "Fabricante"), ("Estado: ", "Estado"), ("Obs: ", "Observaciones"))
PRODUCT_DATES = ("FechaCaducidad", "FechaLimiteVenta")
