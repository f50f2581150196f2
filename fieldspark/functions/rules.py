"""Agronomic rules as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldspark.functions.numbers import fixed, whole
from fieldspark.functions.text import norm_text

# Crop-name patterns and month/day of the next harvest of permanent crops.
PERMANENT_HARVEST = (
    ("OLIVO|OLIVAR", 11, 15),
    ("VI[NÑ]A|VID|UVA", 9, 30),
    ("ALMENDRO|AVELLANO|NOGAL|PISTACHO", 8, 31),
    ("MANZANO|PERAL|MELOCOTO|CEREZO|CIRUELO|FRUTALES?", 9, 15),
    ("NARANJA|LIMON|MANDARINA|CITRICO", 12, 15),
)

# Crop-name patterns and days from sowing to harvest; 150 otherwise.
ANNUAL_DAYS = (
    ("TRIGO|CEBADA|AVENA|CENTENO|TRITICALE|ESPELTA|COLZA|MOSTAZA|CAMELINA", 220),
    ("MAIZ|GIRASOL|CARTAMO|MIJO|SORGO|TEFF|QUINOA", 140),
    ("GARBANZO|LENTEJA|VEZA|GUISANTE|HABA|ALUBIA|ALVERJON|ALMORTA|YEROS|TITARROS|ESPARCETA", 160),
    ("PATATA|REMOLACHA", 140),
    ("TOMATE|PEPINO|PIMIENTO|CALABAZA|MELON|SANDIA", 110),
    ("AJO|CEBOLLA|ZANAHORIA", 130),
    ("ALFALFA|FESTUCA|RAYGRASS|PRADERA|PASTOS|CULTIVOS MIXTOS", 90),
    ("LAVANDA|LAVANDIN|ANIS", 120),
)
DEFAULT_ANNUAL_DAYS = 150

# Crop-name patterns and kg/ha of permanent crops (none otherwise).
PERMANENT_YIELD = (
    ("OLIVO|OLIVAR", 3500.0),
    ("VI[NÑ]A|VID|UVA", 8000.0),
    ("ALMENDRO|AVELLANO|NOGAL|PISTACHO", 2000.0),
    ("MANZANO|PERAL|MELOCOTO|CEREZO|CIRUELO|FRUTALES?", 25000.0),
    ("NARANJA|LIMON|MANDARINA|CITRICO", 30000.0),
)

# Crop-name patterns and kg/ha of annual crops; 3000 otherwise.
ANNUAL_YIELD = (
    ("TRIGO|CEBADA|CENTENO|TRITICALE|ESPELTA", 3800.0),
    ("MAIZ", 11000.0),
    ("GIRASOL|CARTAMO", 2200.0),
    ("GARBANZO|LENTEJA|VEZA|GUISANTE|HABA|ALUBIA", 1800.0),
    ("PATATA", 35000.0),
    ("REMOLACHA", 60000.0),
    ("COLZA|MOSTAZA|CAMELINA", 2500.0),
    ("TOMATE|PIMIENTO|PEPINO", 70000.0),
    ("ALFALFA|RAYGRASS|PRADERA|PASTOS", 12000.0),
)
DEFAULT_ANNUAL_YIELD = 3000.0

# Coefficient formulas (slope, intercept) by code; 1.0 for an unknown code.
KC_FORMULAS = {
    "KC_HERBACEO_COBERTURA_RAPIDA": (1.25, 0.10),
    "KC_ANUAL_SUELO_VISIBLE": (0.85, 0.47),
    "KCB_GENERAL": (1.44, -0.10),
    "KC_FIJO_BAJO": (0.0, 0.10),
}
DEFAULT_KC = ("KCB_GENERAL", 0.15, 1.00, "baja")

# Share of the water that reaches the crop.
EFFICIENCY_IRRIGATED = 0.92
EFFICIENCY_OTHER = 0.85

PERMANENT_TYPES = ("PLANTACION", "IMPLANTACION")


def _case(rules: list[tuple[Column, Column]], default: Column | None) -> Column:
    chain = reduce(lambda acc, rule: acc.when(*rule), rules[1:], F.when(*rules[0]))
    return chain.otherwise(default) if default is not None else chain


def is_permanent(kind: Column) -> Column:
    return F.upper(F.trim(F.coalesce(kind, F.lit("")))).isin(*PERMANENT_TYPES)


def estimate_harvest_date(crop: Column, kind: Column, start: Column, today: Column) -> Column:
    name = norm_text(crop)
    reference = F.greatest(start, today)

    def next_on(month: int, day: int) -> Column:
        this_year = F.make_date(F.year(reference), F.lit(month), F.lit(day))
        next_year = F.make_date(F.year(reference) + 1, F.lit(month), F.lit(day))
        return F.when(this_year > reference, this_year).otherwise(next_year)

    permanent = _case([(name.rlike(p), next_on(m, d)) for p, m, d in PERMANENT_HARVEST], None)
    days = _case([(name.rlike(p), F.lit(n)) for p, n in ANNUAL_DAYS], F.lit(DEFAULT_ANNUAL_DAYS))
    return F.when(start.isNull(), None).when(is_permanent(kind), permanent).otherwise(F.date_add(start, days))


def estimate_yield_kg_ha(crop: Column, kind: Column) -> Column:
    name = norm_text(crop)
    permanent = _case([(name.rlike(p), F.lit(v)) for p, v in PERMANENT_YIELD], None)
    annual = _case([(name.rlike(p), F.lit(v)) for p, v in ANNUAL_YIELD], F.lit(DEFAULT_ANNUAL_YIELD))
    return F.when(name == "", None).when(is_permanent(kind), permanent).otherwise(annual)


def kc_formula(code: Column, ndvi: Column) -> Column:
    key = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    rules = [(key == name, F.lit(slope) * ndvi + F.lit(base)) for name, (slope, base) in KC_FORMULAS.items()]
    return _case(rules, F.lit(1.0))


def kc_from_ndvi(ndvi: Column, code: Column, kc_min: Column, kc_max: Column) -> Column:
    """Coefficient inside its range; the middle of the range when there is no index value."""
    usable = F.when(~F.isnan(ndvi), ndvi)
    return F.when(usable.isNotNull(), F.greatest(kc_min, F.least(kc_max, kc_formula(code, usable)))).otherwise(
        (kc_min + kc_max) / 2.0
    )


def volume_label(need_mm: Column) -> Column:
    """Compact m³/ha text: one decimal below 100, none from 100 on, empty without need."""
    per_ha = need_mm * 10
    return (
        F.when(need_mm <= 0, F.lit(""))
        .when(per_ha >= 100, F.concat(whole(per_ha).cast("string"), F.lit(" m³/ha")))
        .otherwise(F.concat(F.format_string("%.1f", fixed(per_ha, 1)), F.lit(" m³/ha")))
    )


def reference_color(et0: Column, reference: Column) -> Column:
    return F.when(et0 > reference, "red").otherwise("blue")


def need_color(need_mm: Column, offset: Column) -> Column:
    """Second colour rule: by need over 2 mm, urgent on the first two days."""
    return F.when(need_mm <= 2.0, "blue").when(offset <= 1, "red").otherwise("orange")


def irrigation_state(color: Column) -> Column:
    key = F.lower(F.trim(F.coalesce(color, F.lit(""))))
    return (
        F.when(key.isin("red", "orange"), "Riego recomendado")
        .when(key.isin("blue", "none"), "Sin recomendación")
        .otherwise("Sin datos de predicción")
    )


def irrigation_badge(color: Column) -> Column:
    key = F.lower(F.trim(F.coalesce(color, F.lit(""))))
    return F.when(key.isin("red", "orange"), "danger").when(key.isin("blue", "none"), "primary").otherwise("secondary")
