"""Vegetation-index series."""

from pyspark.sql import functions as F

from fieldspark.functions import dates as D
from fieldspark.operators import series as S
from fieldspark.plans.registry import query

_YEAR = "CASE WHEN month(fecha_ndvi) >= 9 THEN year(fecha_ndvi) + 1 ELSE year(fecha_ndvi) END"
_LAST = f"(SELECT max({_YEAR}) FROM v_ndvi)"


def last_campaign(t):
    return t.v_ndvi.agg(F.max(D.campaign_year(F.col("fecha_ndvi")))).scalar()


@query(
    "latest_ndvi",
    """SELECT id_recinto, valor_medio AS ndvi, fecha_ndvi FROM (SELECT *, row_number() OVER (PARTITION BY id_recinto ORDER BY fecha_ndvi DESC NULLS LAST, id_indice DESC) AS rn
       FROM v_ndvi WHERE valor_medio IS NOT NULL) WHERE rn = 1""",
)
def latest_ndvi(t):
    return S.latest_ndvi(t.v_ndvi)


@query(
    "ndvi_series",
    """SELECT id_recinto, id_indice, fecha_ndvi, round(valor_medio, 2) AS valor, strftime(fecha_ndvi, '%d/%m/%Y') AS etiqueta FROM v_ndvi
       WHERE fecha_ndvi IS NOT NULL AND valor_medio IS NOT NULL""",
)
def ndvi_series(t):
    return S.ndvi_series(t.v_ndvi).orderBy("id_recinto", "fecha_ndvi", "id_indice")


_CLEAN = """s AS (SELECT *, coalesce(valor_medio, 0) AS m FROM v_ndvi),
  c AS (SELECT id_recinto, id_indice, fecha_ndvi, m AS valor_medio, least(coalesce(valor_min, 0), m) AS valor_min, greatest(coalesce(valor_max, 0), m) AS valor_max FROM s)"""


@query("ndvi_sanitize", f"WITH {_CLEAN} SELECT id_indice, valor_medio, valor_min, valor_max FROM c")
def ndvi_sanitize(t):
    return S.sanitize(t.v_ndvi).select("id_indice", "valor_medio", "valor_min", "valor_max")


@query(
    "ndvi_compare_plots",
    f"""WITH {_CLEAN} SELECT c.* FROM c WHERE id_recinto IN (SELECT id_recinto FROM v_plot WHERE id_propietario = 7 ORDER BY id_recinto LIMIT 10)""",
)
def ndvi_compare_plots(t):
    wanted = t.v_plot.filter("id_propietario = 7").select("id_recinto").orderBy("id_recinto").limit(10)
    return S.compare_plots(t.v_ndvi, wanted)


@query(
    "ndvi_campaigns",
    f"""SELECT id_recinto, id_indice, fecha_ndvi, valor_medio, CAST({_YEAR} AS INT) AS campania, CAST({_YEAR} - 1 AS VARCHAR) || '/' || CAST({_YEAR} AS VARCHAR) AS nombre
    FROM v_ndvi WHERE {_YEAR} BETWEEN {_LAST} - 2 AND {_LAST}""",
)
def ndvi_campaigns(t):
    return S.campaigns(t.v_ndvi, last_campaign(t)).select("id_recinto", "id_indice", "fecha_ndvi", "valor_medio", "campania", "nombre")


@query(
    "campaign_stats",
    f"""SELECT id_recinto, CAST({_YEAR} AS INT) AS campania, round(CAST(sum(CAST(valor_medio AS DECIMAL(10, 4))) AS DOUBLE) / count(valor_medio), 3) AS promedio, round(max(valor_medio), 3) AS maximo, round(min(valor_medio), 3) AS minimo
    FROM v_ndvi WHERE valor_medio IS NOT NULL AND {_YEAR} BETWEEN {_LAST} - 2 AND {_LAST} GROUP BY 1, 2""",
)
def campaign_stats(t):
    return S.campaign_stats(S.campaigns(t.v_ndvi, last_campaign(t)), ["id_recinto", "campania"])


@query(
    "station_days",
    "SELECT DISTINCT estacion_id, fecha FROM v_daily WHERE fecha < DATE '2001-06-01' ORDER BY estacion_id, fecha DESC",
)
def station_days(t):
    return S.station_days(t.v_daily, F.lit("2001-06-01").cast("date"))
