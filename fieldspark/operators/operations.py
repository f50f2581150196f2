"""Field operations: nested JSON detail to typed columns and a one-line summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.numbers import fixed
from fieldspark.functions.text import blank_to_null

DASH = "—"
DOT = " · "


def _text(doc: Column, *paths: str) -> Column:
    """First filled text among JSON paths; objects and lists do not count as text."""
    found = []
    for path in paths:
        value = F.try_variant_get(doc, path, "string")
        plain = F.when(~value.startswith("{") & ~value.startswith("["), value)
        found.append(blank_to_null(plain))
    return F.coalesce(*found)


def _number(doc: Column, *paths: str) -> Column:
    return F.coalesce(*[F.try_variant_get(doc, path, "double") for path in paths])


def _labelled(doc: Column, field: str) -> Column:
    return _text(doc, f"$.{field}.label", f"$.{field}.codigo")


def _join(sep: str, *parts: Column) -> Column:
    return F.concat_ws(sep, *parts)


def flatten_operations(ops: DataFrame, detail: str = "detalle") -> DataFrame:
    """Typed columns per operation: volume, product, dose, unit, number of products, notes, and ``resumen``.

    Alternative key names are accepted; the first product stands for the list. Broken JSON counts as empty.
    """
    parsed = ops.withColumn("_d", F.try_parse_json(detail))
    doc = F.col("_d")
    many = F.try_variant_get(doc, "$.productos", "array<variant>")
    single_list = F.try_variant_get(doc, "$.producto", "array<variant>")
    single = F.try_variant_get(doc, "$.producto", "variant")
    treats = F.upper(F.trim(F.coalesce("tipo", F.lit("")))) == "FITOSANITARIO"
    products = F.coalesce(many, single_list, F.when(single.isNotNull(), F.array(single)))
    parsed = parsed.withColumns({"_p": F.get(products, F.lit(0)), "_n": F.coalesce(F.size(products), F.lit(0))})
    p = F.col("_p")
    kind = F.upper(F.trim(F.coalesce("tipo", F.lit(""))))
    name = F.when(
        treats, _text(p, "$.producto.label", "$.producto_nombre", "$.nombre", "$.formulado")
    ).otherwise(_labelled(doc, "producto"))
    code = F.when(
        treats, _text(p, "$.producto.codigo", "$.producto_codigo", "$.num_registro", "$.numero_registro")
    )
    dose = F.when(treats, _text(p, "$.dosis")).when(
        kind == "RECOLECCION", _text(doc, "$.dosis_kg_ha", "$.dosis")
    ).otherwise(_text(doc, "$.cantidad", "$.dosis"))
    unit = F.when(treats, _text(p, "$.unidad.label", "$.unidad.codigo", "$.unidad")).otherwise(_text(doc, "$.unidad"))
    flat = parsed.withColumns(
        {
            "volumen_m3": F.when(kind == "RIEGO", _number(doc, "$.volumen_m3", "$.volumen")),
            "sistema": F.when(kind == "RIEGO", _labelled(doc, "sistema_riego")),
            "procedencia": F.when(kind == "RIEGO", _origins(doc)),
            "producto": name,
            "producto_codigo": code,
            "dosis": dose,
            "unidad": unit,
            "n_productos": F.when(treats, F.col("_n")).otherwise(F.lit(0)),
            "tipo_fert": F.when(kind == "FERTILIZACION", _labelled(doc, "tipo_fertilizacion")),
            "catalogo": F.when(kind == "OTRAS", _text(doc, "$.catalogo")),
            "etiqueta": F.when(kind == "OTRAS", _text(doc, "$.label", "$.codigo")),
            "observaciones": _text(doc, "$.observaciones"),
            "_bare": F.when(treats, _bare(p)),
        }
    )
    return flat.withColumn("resumen", _summary(kind)).drop("_d", "_p", "_n", "_bare")


def _bare(p: Column) -> Column:
    """A product given as plain text."""
    value = F.try_variant_get(p, "$", "string")
    return blank_to_null(F.when(~value.startswith("{") & ~value.startswith("["), value))


def _origins(doc: Column) -> Column:
    listed = F.try_variant_get(doc, "$.procedencia_agua", "array<struct<label:string,codigo:string>>")
    one = F.try_variant_get(doc, "$.procedencia_agua", "struct<label:string,codigo:string>")
    labels = F.transform(
        F.coalesce(listed, F.when(one.isNotNull(), F.array(one))),
        lambda o: F.coalesce(blank_to_null(o["label"]), blank_to_null(o["codigo"])),
    )
    text = F.array_join(labels, ", ")
    return F.when(text != "", text)


def _summary(kind: Column) -> Column:
    notes = F.when(F.col("observaciones").isNotNull(), F.concat(F.lit(" — "), "observaciones")).otherwise(F.lit(""))
    volume = F.coalesce(F.concat(fixed("volumen_m3", 0).cast("long").cast("string"), F.lit(" m³")), F.lit(DASH))
    amount = F.coalesce(F.concat_ws(" ", F.when(F.col("dosis").isNotNull(), F.col("dosis")), F.when(F.col("dosis").isNotNull(), F.col("unidad"))), F.lit(""))
    amount = F.when(amount != "", amount)
    head = F.when(
        F.col("producto").isNotNull() & F.col("producto_codigo").isNotNull(),
        F.concat("producto", F.lit(" ("), "producto_codigo", F.lit(")")),
    ).otherwise(F.coalesce("producto", "producto_codigo", "_bare", F.lit(DASH)))
    more = F.when(F.col("n_productos") > 1, F.concat(F.lit(" (+"), (F.col("n_productos") - 1).cast("string"), F.lit(" más)"))).otherwise(F.lit(""))
    described = F.coalesce(blank_to_null(F.col("descripcion")), F.lit(DASH))
    other = _join(DOT, F.col("catalogo"), F.col("etiqueta"))
    return (
        F.when(kind == "RIEGO", F.concat(_join(DOT, volume, F.col("sistema"), F.col("procedencia")), notes))
        .when(
            kind == "FERTILIZACION",
            F.concat(_join(DOT, F.coalesce(amount, F.lit(DASH)), F.col("producto"), F.col("tipo_fert")), notes),
        )
        .when(
            (kind == "FITOSANITARIO") & (F.col("n_productos") > 0),
            F.concat(_join(DOT, head, amount), more),
        )
        .when(kind == "OTRAS", F.concat(F.when(other == "", F.lit(DASH)).otherwise(other), notes))
        .otherwise(described)
    )


def totals_by_plot(flat: DataFrame) -> DataFrame:
    return flat.groupBy("id_recinto").agg(
        F.count(F.lit(1)).alias("n_ops"),
        F.sum(F.coalesce("volumen_m3", F.lit(0.0))).alias("volumen_m3"),
        F.sum("n_productos").alias("n_productos"),
        F.max("fecha").alias("ultima"),
    )
