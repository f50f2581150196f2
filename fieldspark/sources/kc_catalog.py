"""Crop-coefficient catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Crop, group, formula, lower and upper coefficient, confidence.
KC_CATALOG = (
    ("ABETO", "forestal_perenne", "KCB_GENERAL", 0.15, 0.75, "media"),
    ("ADORMIDERA", "anual_suelo_visible", "KC_ANUAL_SUELO_VISIBLE", 0.25, 1.10, "media"),
    ("AJO", "horticola_raiz_bulbo", "KC_ANUAL_SUELO_VISIBLE", 0.35, 1.15, "alta"),
    ("ALBERJÓN", "leguminosa_grano", "KC_HERBACEO_COBERTURA_RAPIDA", 0.20, 1.15, "alta"),
    ("ALFALFA", "forrajera_cortes", "KC_HERBACEO_COBERTURA_RAPIDA", 0.40, 1.25, "alta"),
    ("ALMENDRO", "fruto_seco", "KCB_GENERAL", 0.20, 0.90, "media"),
    ("ALMORTA", "leguminosa_grano", "KC_HERBACEO_COBERTURA_RAPIDA", 0.20, 1.15, "alta"),
    ("ALUBIA", "leguminosa_grano", "KC_HERBACEO_COBERTURA_RAPIDA", 0.20, 1.15, "alta"),
    ("ANÍS DULCE", "aromatica", "KC_HERBACEO_COBERTURA_RAPIDA", 0.15, 0.80, "media"),
    ("ANÍS ESTRELLADO", "aromatica", "KC_HERBACEO_COBERTURA_RAPIDA", 0.15, 0.80, "baja"),
    ("AVELLANO", "fruto_seco", "KCB_GENERAL", 0.20, 0.90, "media"),
    ("AVENA", "cereal_invierno", "KC_HERBACEO_COBERTURA_RAPIDA", 0.20, 1.20, "alta"),
    ("BARBECHO DE BIODIVERSIDAD (INCLUYE MELÍFERAS)", "barbecho_cubierta", "KC_FIJO_BAJO", 0.00, 0.30, "media"),
    ("BARBECHO MEDIOAMBIENTAL", "barbecho_cubierta", "KC_FIJO_BAJO", 0.00, 0.25, "media"),
    ("BARBECHO TRADICIONAL", "barbecho_suelo", "KC_FIJO_BAJO", 0.00, 0.20, "media"),
    ("CABECERA Y CONTORNOS DE CULTIVO PERMANENTE", "contorno_cabecera", "KC_FIJO_BAJO", 0.00, 0.25, "baja"),
    ("CALABAZA", "horticola_fruto", "KC_ANUAL_SUELO_VISIBLE", 0.35, 1.20, "alta"),
    ("CAMELINA", "oleaginosa_invierno", "KC_HERBACEO_COBERTURA_RAPIDA", 0.20, 1.15, "media"),
    ("CEBADA", "cereal_invierno", "KC_HERBACEO_COBERTURA_RAPIDA", 0.20, 1.20, "alta"),
    ("CEBOLLA", "horticola_raiz_bulbo", "KC_ANUAL_SUELO_VISIBLE", 0.35, 1.15, "alta"),
    ("CENTENO", "cereal_invierno", "KC_HERBACEO_COBERTURA_RAPIDA", 0.20, 1.20, "alta"),
    ("CEREZO", "frutal_caducifolio", "KCB_GENERAL", 0.20, 0.95, "media"),
    ("CHOPO", "forestal_caducifolio", "KCB_GENERAL", 0.10, 0.90, "media"),
    ("CIRUELO", "frutal_caducifolio", "KCB_GENERAL", 0.20, 0.95, "media"),
    ("COLZA", "oleaginosa_invierno", "KC_HERBACEO_COBERTURA_RAPIDA", 0.20, 1.15, "media"),
    ("CULTIVOS MIXTOS DE ESPECIES PRATENSES", "pradera_mixta", "KC_HERBACEO_COBERTURA_RAPIDA", 0.30, 1.15, "alta"),
    ("CÁRTAMO", "oleaginosa_primavera", "KC_ANUAL_SUELO_VISIBLE", 0.25, 1.10, "media"),
    ("ENCINA", "forestal_perenne", "KCB_GENERAL", 0.15, 0.65, "media"),
    ("ESPARCETA", "leguminosa_forrajera", "KC_HERBACEO_COBERTURA_RAPIDA", 0.20, 1.10, "alta"),
    ("ESPELTA", "cereal_invierno", "KC_HERBACEO_COBERTURA_RAPIDA", 0.20, 1.20, "alta"),
    ("ESPÁRRAGO", "horticola_perenne", "KC_ANUAL_SUELO_VISIBLE", 0.30, 1.05, "media"),
    ("FESTUCA", "pradera", "KC_HERBACEO_COBERTURA_RAPIDA", 0.25, 1.05, "alta"),
    ("GARBANZO", "leguminosa_grano", "KC_HERBACEO_COBERTURA_RAPIDA", 0.20, 1.10, "alta"),
    ("GIRASOL", "oleaginosa_primavera", "KC_ANUAL_SUELO_VISIBLE", 0.25, 1.10, "alta"),
    ("GUISANTE", "leguminosa_grano", "KC_HERBACEO_COBERTURA_RAPIDA", 0.20, 1.15, "alta"),
    ("HABA", "leguminosa_grano", "KC_HERBACEO_COBERTURA_RAPIDA", 0.20, 1.15, "alta"),
    ("HUERTA", "horticola_mixta", "KC_ANUAL_SUELO_VISIBLE", 0.35, 1.20, "media"),
    ("LAVANDA", "aromatica", "KCB_GENERAL", 0.15, 0.75, "media"),
    ("LAVANDÍN", "aromatica", "KCB_GENERAL", 0.15, 0.75, "media"),
    ("LENTEJA", "leguminosa_grano", "KC_HERBACEO_COBERTURA_RAPIDA", 0.20, 1.10, "alta"),
    ("MANZANO", "frutal_caducifolio", "KCB_GENERAL", 0.20, 0.95, "media"),
    ("MAÍZ", "cultivo_verano", "KC_ANUAL_SUELO_VISIBLE", 0.30, 1.25, "alta"),
    ("MELOCOTONERO", "frutal_caducifolio", "KCB_GENERAL", 0.20, 0.95, "media"),
    ("MEZCLA AVENA-CEBADA", "cereal_invierno", "KC_HERBACEO_COBERTURA_RAPIDA", 0.20, 1.20, "alta"),
    ("MEZCLA AVENA-VEZA", "mezcla_cereal_leguminosa", "KC_HERBACEO_COBERTURA_RAPIDA", 0.20, 1.15, "alta"),
    ("MEZCLA CEBADA-TRIGO", "cereal_invierno", "KC_HERBACEO_COBERTURA_RAPIDA", 0.20, 1.20, "alta"),
    ("MEZCLA CEREAL-RAYGRASS", "pradera_mixta", "KC_HERBACEO_COBERTURA_RAPIDA", 0.30, 1.15, "alta"),
    ("MEZCLA DE FORESTALES", "forestal_mixto", "KCB_GENERAL", 0.15, 0.75, "media"),
    ("MEZCLA RAYGRASS", "pradera_mixta", "KC_HERBACEO_COBERTURA_RAPIDA", 0.30, 1.15, "alta"),
    ("MEZCLA RAYGRASS-TREBOL", "pradera_mixta", "KC_HERBACEO_COBERTURA_RAPIDA", 0.30, 1.15, "alta"),
    ("MEZCLA TRIGO-VEZA", "mezcla_cereal_leguminosa", "KC_HERBACEO_COBERTURA_RAPIDA", 0.20, 1.15, "alta"),
    ("MIJO", "cultivo_verano", "KC_ANUAL_SUELO_VISIBLE", 0.25, 1.10, "media"),
    ("MOSTAZA", "oleaginosa_invierno", "KC_HERBACEO_COBERTURA_RAPIDA", 0.20, 1.15, "media"),
    ("NOGAL", "fruto_seco", "KCB_GENERAL", 0.20, 0.95, "media"),
    ("OLIVO", "olivar", "KCB_GENERAL", 0.20, 0.75, "media"),
    ("OTROS FRUTALES", "frutal_caducifolio", "KCB_GENERAL", 0.20, 0.95, "media"),
    ("PASTOS DE MENOS DE 5 AÑOS", "pradera", "KC_HERBACEO_COBERTURA_RAPIDA", 0.25, 1.05, "alta"),
    ("PASTOS PERMANENTES DE 5 O MÁS AÑOS", "pradera", "KC_HERBACEO_COBERTURA_RAPIDA", 0.20, 1.00, "alta"),
    ("PATATA", "tuberculo", "KC_ANUAL_SUELO_VISIBLE", 0.35, 1.15, "alta"),
    ("PEPINO", "horticola_fruto", "KC_ANUAL_SUELO_VISIBLE", 0.35, 1.20, "alta"),
    ("PERAL", "frutal_caducifolio", "KCB_GENERAL", 0.20, 0.95, "media"),
    ("PIMIENTO", "horticola_fruto", "KC_ANUAL_SUELO_VISIBLE", 0.35, 1.20, "alta"),
    ("PINO", "forestal_perenne", "KCB_GENERAL", 0.15, 0.70, "media"),
    ("PISTACHO", "fruto_seco", "KCB_GENERAL", 0.20, 0.90, "media"),
    ("PLANTAS ORNAMENTALES", "vivero_ornamental", "KC_ANUAL_SUELO_VISIBLE", 0.30, 1.10, "baja"),
    ("QUINOA", "cultivo_verano", "KC_ANUAL_SUELO_VISIBLE", 0.25, 1.10, "media"),
    ("RAYGRASS ANUAL", "pradera", "KC_HERBACEO_COBERTURA_RAPIDA", 0.30, 1.15, "alta"),
    ("RAYGRASS PERENNE", "pradera", "KC_HERBACEO_COBERTURA_RAPIDA", 0.30, 1.15, "alta"),
    ("REMOLACHA", "raiz_industrial", "KC_ANUAL_SUELO_VISIBLE", 0.40, 1.20, "alta"),
    ("REPOLLO", "horticola_hoja", "KC_ANUAL_SUELO_VISIBLE", 0.35, 1.20, "alta"),
    ("ROBLE", "forestal_caducifolio", "KCB_GENERAL", 0.10, 0.80, "media"),
    ("TEFF", "cultivo_verano", "KC_ANUAL_SUELO_VISIBLE", 0.25, 1.10, "media"),
    ("TITARROS", "leguminosa_grano", "KC_HERBACEO_COBERTURA_RAPIDA", 0.20, 1.10, "alta"),
    ("TOMATE", "horticola_fruto", "KC_ANUAL_SUELO_VISIBLE", 0.35, 1.20, "alta"),
    ("TRIGO BLANDO", "cereal_invierno", "KC_HERBACEO_COBERTURA_RAPIDA", 0.20, 1.20, "alta"),
    ("TRIGO DURO", "cereal_invierno", "KC_HERBACEO_COBERTURA_RAPIDA", 0.20, 1.20, "alta"),
    ("TRITICALE", "cereal_invierno", "KC_HERBACEO_COBERTURA_RAPIDA", 0.20, 1.20, "alta"),
    ("VEZA", "leguminosa_grano", "KC_HERBACEO_COBERTURA_RAPIDA", 0.20, 1.15, "alta"),
    ("VEZA VELLOSA", "leguminosa_grano", "KC_HERBACEO_COBERTURA_RAPIDA", 0.20, 1.15, "alta"),
    ("VIVERO - PRODUCTOR MVR", "vivero_ornamental", "KC_ANUAL_SUELO_VISIBLE", 0.30, 1.10, "baja"),
    ("VIÑA", "viñedo", "KCB_GENERAL", 0.15, 0.85, "media"),
    ("YEROS", "leguminosa_grano", "KC_HERBACEO_COBERTURA_RAPIDA", 0.20, 1.10, "alta"),
    ("ZANAHORIA", "horticola_raiz_bulbo", "KC_ANUAL_SUELO_VISIBLE", 0.35, 1.15, "alta"),
)


def kc_catalog(spark: SparkSession) -> DataFrame:
    """The built-in catalogue; ``read_csv`` loads another one of the same columns."""
    schema = "cultivo string, grupo string, formula_code string, kc_min double, kc_max double, confianza string"
    return spark.createDataFrame([(c, g, f, float(a), float(b), t) for c, g, f, a, b, t in KC_CATALOG], schema)
