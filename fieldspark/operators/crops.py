"""Crop records: current crop, versions, plans and field notebook."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions.numbers import fixed
from fieldspark.functions import rules
from fieldspark.functions.text import blank_to_null, first_filled, first_nonblank

CLOSED_STATES = ("eliminado", "cerrado")


def start_date() -> Column:
    return F.coalesce("fecha_siembra", "fecha_implantacion")


def latest_first() -> list[Column]:
    return [start_date().desc_nulls_last(), F.col("id_cultivo").desc()]


def live(crops: DataFrame, states: tuple[str, ...] = ("eliminado",)) -> DataFrame:
    """Records that belong to a chain and are not in one of the given states."""
    return crops.filter(F.col("id_padre").isNotNull() & ~F.coalesce("estado", F.lit("")).isin(*states))


def current_crop(crops: DataFrame, states: tuple[str, ...] = ("eliminado",)) -> DataFrame:
    """Latest live record per plot."""
    w = Window.partitionBy("id_recinto").orderBy(*latest_first())
    return live(crops, states).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def current_crop_lateral(plots: DataFrame, crops: DataFrame, products: DataFrame) -> DataFrame:
    """Current crop name per plot as a lateral top-1, with closed records left out and product name first."""
    named = live(crops, CLOSED_STATES).join(products, F.col("cod_producto") == F.col("codigo"), "left")
    name = first_nonblank(F.col("descripcion"), F.col("tipo_cultivo"))
    inner = (
        named.select("id_recinto", "id_cultivo", name.alias("cultivo"), start_date().alias("_start"))
        .alias("c")
        .where(F.col("c.id_recinto") == F.col("p.id_recinto").outer())
        .orderBy(F.col("c._start").desc_nulls_last(), F.col("c.id_cultivo").desc())
        .limit(1)
        .select(F.col("c.cultivo").alias("cultivo"))
    )
    return plots.alias("p").lateralJoin(inner, how="left").select("p.id_recinto", "cultivo")


def with_product(crops: DataFrame, products: DataFrame) -> DataFrame:
    return crops.join(products, F.col("cod_producto") == F.col("codigo"), "left")


def active(plots: DataFrame) -> DataFrame:
    """A missing flag counts as active."""
    return plots.filter(F.coalesce("activa", F.lit(True)))


def main_crop_by_area(plots: DataFrame, crops: DataFrame, products: DataFrame) -> DataFrame:
    """Per owner the crop with most hectares among current crops of active plots; ties by name."""
    owned = active(plots).select("id_recinto", "id_propietario", "superficie_ha")
    named = with_product(current_crop(crops), products).select(
        "id_recinto", first_nonblank(F.col("tipo_cultivo"), F.col("descripcion")).alias("cultivo")
    )
    sums = owned.join(named, "id_recinto").groupBy("id_propietario", "cultivo").agg(
        F.sum(F.coalesce("superficie_ha", F.lit(0.0))).alias("ha")
    )
    w = Window.partitionBy("id_propietario").orderBy(F.desc_nulls_last("ha"), F.asc_nulls_last("cultivo"))
    return sums.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def plots_without_current(crops: DataFrame) -> DataFrame:
    """Plots none of whose records belongs to a chain."""
    return (
        crops.groupBy("id_recinto")
        .agg(F.count_if(F.col("id_padre").isNotNull()).alias("_n"), F.count(F.lit(1)).alias("n_registros"))
        .filter("_n = 0")
        .drop("_n")
    )


def promote_current(crops: DataFrame) -> DataFrame:
    """In plots without a chain the newest record becomes its own parent; all records come back."""
    newest = crops.groupBy("id_recinto").agg(
        F.count("id_padre").alias("_n"),
        F.max_by(
            "id_cultivo", F.struct(F.coalesce(start_date(), F.to_date(F.lit("0001-01-01"))), F.col("id_cultivo"))
        ).alias("_newest"),
    )
    flag = (F.col("_n") == 0) & (F.col("id_cultivo") == F.col("_newest"))
    return crops.join(newest, "id_recinto").withColumn(
        "id_padre", F.when(flag, F.col("id_cultivo")).otherwise(F.col("id_padre"))
    ).drop("_n", "_newest")


def apply_edits(crops: DataFrame, edits: DataFrame, next_id: Column) -> DataFrame:
    """New version rows for the edited plots: fields of the edit over those of the current record, parent = current."""
    now = current_crop(crops)
    changed = [c for c in edits.columns if c in crops.columns and c != "id_recinto"]
    merged = now.join(edits.withColumnsRenamed({c: f"_new_{c}" for c in changed}), "id_recinto")
    out = []
    for c in crops.columns:
        if c == "id_cultivo":
            out.append(next_id.alias(c))
        elif c == "id_padre":
            out.append(F.col("id_cultivo").alias(c))
        elif c in changed:
            out.append(F.coalesce(f"_new_{c}", c).alias(c))
        else:
            out.append(F.col(c))
    return merged.select(*out)


def version_chain(crops: DataFrame) -> DataFrame:
    """Validity of every version: from its own start to the start of the next one in its plot."""
    w = Window.partitionBy("id_recinto").orderBy(start_date().asc_nulls_first(), F.col("id_cultivo"))
    return crops.select(
        "id_recinto",
        "id_cultivo",
        start_date().alias("valid_from"),
        F.lead(start_date()).over(w).alias("valid_to"),
        F.row_number().over(w).alias("version"),
        F.lag("id_cultivo").over(w).alias("previous_id"),
        F.lead("id_cultivo").over(w).isNull().alias("is_last"),
    )


def delete_current(crops: DataFrame, plots: DataFrame) -> DataFrame:
    """Crops after the current record of the given plots is deleted; other records of those plots leave the chain."""
    gone = current_crop(crops).join(plots.select("id_recinto"), "id_recinto", "left_semi").select("id_cultivo", "id_recinto")
    kept = crops.join(gone, "id_cultivo", "left_anti")
    touched = gone.select("id_recinto").withColumn("_t", F.lit(True))
    return kept.join(touched, "id_recinto", "left").withColumn(
        "id_padre", F.when(F.col("_t").isNull(), F.col("id_padre"))
    ).drop("_t")


def accept_history(crops: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates with the rule for history: a start date, earlier than that of the plot's current crop."""
    now = current_crop(crops).select("id_recinto", start_date().alias("_current"))
    reason = (
        F.when(F.col("inicio").isNull(), "sin_fecha")
        .when(F.col("inicio") >= F.col("_current"), "no_anterior")
        .otherwise("ok")
    )
    return candidates.join(now, "id_recinto", "left").withColumn("resultado", reason).drop("_current")


def fill_crop_type(crops: DataFrame, products: DataFrame) -> DataFrame:
    """Name and code rules by origin; rows that break a rule carry the reason in ``error``."""
    origin = F.upper("origen_cultivo")
    custom = blank_to_null(F.col("cultivo_custom"))
    joined = with_product(crops, products)
    error = (
        F.when((origin == "F") & F.col("cod_producto").isNull(), "F sin producto")
        .when((origin == "F") & F.col("descripcion").isNull(), "producto inexistente")
        .when((origin == "C") & custom.isNull(), "C sin nombre")
        .when(origin.isin("F", "C"), None)
        .otherwise("origen no valido")
    )
    return joined.select(
        *[c for c in crops.columns if c not in ("origen_cultivo", "cod_producto", "cultivo_custom", "tipo_cultivo")],
        origin.alias("origen_cultivo"),
        F.when(origin == "F", F.col("descripcion")).when(origin == "C", custom).alias("tipo_cultivo"),
        F.when((origin == "C") & error.isNull(), None).otherwise(F.col("cod_producto")).alias("cod_producto"),
        F.when((origin == "F") & error.isNull(), None).otherwise(F.col("cultivo_custom")).alias("cultivo_custom"),
        error.alias("error"),
    )


def normalize_payload(crops: DataFrame) -> DataFrame:
    """Default type, both dates from each other, campaign from the start year where it is missing."""
    kind = F.coalesce(blank_to_null(F.upper("tipo_registro")), F.lit("CAMPANA"))
    known = kind.isin("CAMPANA", "IMPLANTACION")
    sown = F.when(known, F.coalesce("fecha_siembra", "fecha_implantacion")).otherwise(F.col("fecha_siembra"))
    planted = F.when(known, F.coalesce("fecha_implantacion", "fecha_siembra")).otherwise(F.col("fecha_implantacion"))
    missing = F.coalesce("campana", F.lit(0)) == 0
    campaign = F.when((kind == "CAMPANA") & missing, F.coalesce(F.year(sown), F.col("campana"))).otherwise(F.col("campana"))
    return crops.withColumns(
        {"tipo_registro": kind, "fecha_siembra": sown, "fecha_implantacion": planted, "campana": campaign}
    )


def crop_plan(plots: DataFrame, subplots: DataFrame, crops: DataFrame, products: DataFrame) -> DataFrame:
    """Plot, name, crop, area and number of subplots, with one row per subplot (one row for plots without any).

    Subplots stay rows: a plot with very many of them never becomes one value.
    """
    parts = with_product(subplots, products).select(
        "id_recinto",
        "id_subparcela",
        F.trim(F.coalesce("nombre", F.lit(""))).alias("sub_nombre"),
        F.coalesce("superficie_ha", F.lit(0.0)).alias("sub_ha"),
        F.trim(F.coalesce("descripcion", F.lit(""))).alias("sub_cultivo"),
    )
    counts = subplots.groupBy("id_recinto").agg(F.count(F.lit(1)).alias("n_subparcelas"))
    named = with_product(current_crop(crops), products).select(
        "id_recinto", first_nonblank(F.col("descripcion"), F.col("tipo_cultivo")).alias("cultivo")
    )
    label = F.coalesce(blank_to_null(F.col("nombre")), F.concat(F.lit("Recinto "), F.col("id_recinto").cast("string")))
    plan = (
        plots.join(named, "id_recinto", "left")
        .join(counts, "id_recinto", "left")
        .select(
            "id_recinto",
            label.alias("nombre"),
            fixed(F.coalesce("geom_ha", "superficie_ha", F.lit(0.0)), 4).alias("superficie_ha"),
            F.coalesce("cultivo", F.lit("")).alias("cultivo"),
            F.coalesce("n_subparcelas", F.lit(0)).alias("n_subparcelas"),
        )
    )
    return plan.join(parts, "id_recinto", "left")


def plan_rows(plots: DataFrame, subplots: DataFrame, crops: DataFrame, products: DataFrame) -> DataFrame:
    """Export rows: every subplot, and every plot that has none."""
    current = with_product(current_crop(crops, CLOSED_STATES), products).select(
        "id_recinto", first_nonblank(F.col("descripcion"), F.col("tipo_cultivo")).alias("_pc")
    )
    base = plots.select(
        "id_recinto", F.col("nombre").alias("_plot_name"), F.col("superficie_ha").alias("_plot_ha")
    ).join(current, "id_recinto", "left")
    fallback = F.concat(F.lit("Recinto "), F.col("id_recinto").cast("string"))
    subs = with_product(subplots, products).select(
        "id_recinto", "id_subparcela", "nombre", "superficie_ha", F.col("descripcion").alias("_desc")
    )
    with_parts = base.join(subs, "id_recinto").select(
        "id_recinto",
        F.col("id_subparcela").cast("long").alias("id_subparcela"),
        F.coalesce(blank_to_null(F.col("nombre")), F.col("_plot_name"), fallback).alias("nombre"),
        F.coalesce("_desc", "_pc", F.lit("")).alias("cultivo"),
        fixed(F.coalesce("superficie_ha", "_plot_ha", F.lit(0.0)), 4).alias("ha"),
        F.lit("subparcela").alias("tipo"),
    )
    without = base.join(subplots.select("id_recinto"), "id_recinto", "left_anti").select(
        "id_recinto",
        F.lit(None).cast("long").alias("id_subparcela"),
        F.coalesce(blank_to_null(F.col("_plot_name")), fallback).alias("nombre"),
        F.coalesce("_pc", F.lit("")).alias("cultivo"),
        fixed(F.coalesce("_plot_ha", F.lit(0.0)), 4).alias("ha"),
        F.lit("recinto").alias("tipo"),
    )
    return with_parts.unionByName(without)


def top_operations(ops: DataFrame, since: Column, n: int) -> DataFrame:
    """The newest ``n`` operations per plot from a date on; the limit runs before the shuffle as well."""
    w = Window.partitionBy("id_recinto").orderBy(F.desc("fecha"), F.desc("id_operacion"))
    return (
        ops.filter(F.col("fecha") >= since).withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n)
    )


def farm_notebook(
    plots: DataFrame, crops: DataFrame, products: DataFrame, ops: DataFrame, since: Column, n_ops: int = 5
) -> DataFrame:
    """Current crop of every active plot with yield forecast and its last operations."""
    name = F.coalesce(first_nonblank(F.col("tipo_cultivo"), F.col("descripcion")), F.lit("Sin cultivo"))
    recent = (
        top_operations(ops, since, n_ops)
        .groupBy("id_recinto")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "tipo", "fecha"))).alias("operaciones"))
    )
    rows = (
        active(plots)
        .select("id_recinto", "superficie_ha")
        .join(with_product(current_crop(crops), products), "id_recinto")
        .join(recent, "id_recinto", "left")
    )
    kind = F.coalesce(blank_to_null(F.upper("tipo_registro")), F.lit("CAMPANA"))
    kg_ha = rules.estimate_yield_kg_ha(name, kind)
    return rows.select(
        "id_recinto",
        "id_cultivo",
        name.alias("cultivo"),
        start_date().alias("fecha_inicio"),
        kg_ha.alias("kg_ha"),
        fixed(kg_ha * F.coalesce("superficie_ha", F.lit(0.0)), 0).alias("kg_total"),
        F.coalesce("operaciones", F.array()).alias("operaciones"),
        F.coalesce(F.size("operaciones"), F.lit(0)).alias("n_ops"),
    )


def operations_by_plot(ops: DataFrame, since: Column, preview: int = 5) -> DataFrame:
    """Operations since a date per plot: the whole count, and the newest ones as a short preview."""
    counts = ops.filter(F.col("fecha") >= since).groupBy("id_recinto").agg(F.count(F.lit(1)).alias("n_ops"))
    shown = (
        top_operations(ops, since, preview)
        .groupBy("id_recinto")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "tipo", "fecha"))).alias("ops"))
    )
    return counts.join(shown, "id_recinto")


def union_crop_sources(**sources: DataFrame | None) -> DataFrame:
    """Declared, previous and historical crops under one schema, tagged with their source; absent tables are skipped."""
    tagged = [df.withColumn("fuente", F.lit(tag)) for tag, df in sources.items() if df is not None]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def resolve_aliases(df: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Output fields from the first filled spelling variant among the columns present.

    Columns are taken by position, so names may differ in case only.
    """
    at = {name: f"_c{i}" for i, name in enumerate(df.columns)}
    out = []
    for field, names in aliases.items():
        found = [F.col(at[n]).cast("string") for n in names if n in at]
        out.append((first_filled(*found) if found else F.lit(None).cast("string")).alias(field))
    return df.toDF(*at.values()).select(*[F.col(at[c]).alias(c) for c in at if c.endswith("_key")], *out)


# Output soil fields and the spelling variants they are read from.
SOIL_ALIASES = {
    "id_muestra": ("ID_MUESTRA", "ID_Muestra", "id_muestra"),
    "origen": ("Origen", "origen"),
    "campana": ("Campaña", "Campanya", "campana"),
    "laboratori": ("Laboratori", "laboratori"),
    "ph": ("pH", "ph", "PH"),
    "acidez_basi": ("AcidezBasi", "Acidez_Basi", "acidez_basi"),
    "conductivi": ("Conductivi", "conductividad", "CE"),
    "mo_porc": ("MO_Porc", "mo_porc", "MO_%"),
    "materia_org": ("MateriaOrg", "Materia_Org", "materia_org"),
    "arena_porc": ("Arena_Porc", "arena_porc", "Arena_%"),
    "limo_porc": ("Limo_Porc", "limo_porc", "Limo_%"),
    "arcilla_po": ("Arcilla_Po", "Arcilla_Porc", "arcilla_porc", "Arcilla_%"),
    "textura": ("Textura", "textura"),
    "text_calcu": ("TextCalcu", "Text_Calcu", "text_calcu"),
    "grupo_textu": ("GrupoTextu", "Grupo_Textu", "grupo_textu"),
    "valoracion": ("Valoracion", "valoracion"),
    "p_olsen_pp": ("P_Olsen_pp", "P_Olsen_ppm", "p_olsen_ppm", "P_ppm"),
    "p_olsen": ("P_Olsen", "p_olsen", "POlsen"),
    "potasio_pp": ("Potasio_pp", "Potasio_ppm", "potasio_ppm", "K_ppm"),
    "potasio": ("Potasio", "potasio"),
    "nitrogeno_": ("Nitrogeno_", "nitrogeno", "N", "Nitrogeno"),
    "calcio_ppm": ("Calcio_ppm", "calcio_ppm", "Ca_ppm"),
    "calcio": ("Calcio", "calcio"),
    "magnesio_p": ("Magnesio_p", "Magnesio_ppm", "magnesio_ppm", "Mg_ppm"),
    "magnesio": ("Magnesio", "magnesio"),
    "coor_x_etr": ("COOR_X_ETR", "Coor_X_Etr", "coor_x", "X_ETRS89"),
    "coor_y_etr": ("COOR_Y_ETR", "Coor_Y_Etr", "coor_y", "Y_ETRS89"),
}
