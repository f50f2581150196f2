"""Farm tables derived from the given tables, once as DataFrame and once as SQL from the same expressions.

Only integer arithmetic and single roundings, so both sides hold equal values. No view drops rows of its table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.functions import ring as R
from fieldspark.sources.files import table


@dataclass
class View:
    source: str
    columns: dict[str, str]
    group: list[str] = field(default_factory=list)  # names of the columns to group by

    def sql(self) -> str:
        body = ", ".join(f"{e} AS {n}" for n, e in self.columns.items())
        tail = f" GROUP BY {', '.join(self.columns[g] for g in self.group)}" if self.group else ""
        return f"SELECT {body} FROM {self.source}{tail}"

    def frame(self, source: DataFrame) -> DataFrame:
        if not self.group:
            return source.selectExpr(*[f"{e} AS {n}" for n, e in self.columns.items()])
        keys = [F.expr(self.columns[g]).alias(g) for g in self.group]
        values = [F.expr(e).alias(n) for n, e in self.columns.items() if n not in self.group]
        return (source.groupBy(*keys).agg(*values) if values else source.select(*keys).distinct()).select(*self.columns)


VIEWS: dict[str, View] = {
    "v_station": View(
        "supplier",
        {
            "estacion_id": "s_suppkey",
            "nombre": "s_name",
            "codigo": "concat('ST', CAST(s_suppkey % 1000 AS VARCHAR(20)))",
            "x": "CAST((s_suppkey * 7919) % 1009 AS DOUBLE) * 0.4",
            "y": "CAST((s_suppkey * 10473) % 1013 AS DOUBLE) * 0.3",
        },
    ),
    "v_daily": View(
        "lineitem",
        {
            "estacion_id": "l_suppkey",
            "fecha": "CAST(l_shipdate AS DATE)",
            "tempmedia": "CAST(MIN((l_orderkey * 13 + l_partkey) % 350) AS DOUBLE) / 10",
            "humedadmedia": "CAST(MIN((l_orderkey * 7 + l_partkey) % 1000) AS DOUBLE) / 10",
            "etpmon": "CAST(MIN((l_orderkey * 3 + l_partkey) % 80) AS DOUBLE) / 10",
        },
        ["estacion_id", "fecha"],
    ),
    "v_plot": View(
        "customer",
        {
            "id_recinto": "c_custkey",
            "nombre": "CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 6 = 1 THEN '  ' ELSE c_name END",
            "provincia": "c_nationkey",
            "municipio": "c_custkey % 37",
            "agregado": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 2 END",
            "zona": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 0 END",
            "poligono": "c_custkey % 11",
            "parcela": "c_custkey % 101",
            "recinto": "c_custkey % 7",
            "id_propietario": "c_custkey % 50",
            "activa": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 5 <> 1 END",
            "sistexp": "CASE WHEN c_custkey % 3 = 0 THEN 'R' ELSE 'S' END",
            "x0": "CAST((c_custkey * 31) % 400 AS DOUBLE)",
            "y0": "CAST((c_custkey * 17) % 300 AS DOUBLE)",
            "w": "CAST(1 + c_custkey % 4 AS DOUBLE)",
            "h": "CAST(1 + c_custkey % 3 AS DOUBLE)",
            "superficie_ha": "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST((1 + c_custkey % 4) * (1 + c_custkey % 3) AS DOUBLE) END",
        },
    ),
    "v_crop": View(
        "orders",
        {
            "id_cultivo": "o_orderkey",
            "id_recinto": "o_custkey",
            "fecha_siembra": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END",
            "fecha_implantacion": "CASE WHEN o_orderkey % 77 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END",
            "estado": "CASE WHEN o_orderstatus = 'F' THEN 'eliminado' WHEN o_orderkey % 9 = 0 THEN 'cerrado' WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'en_curso' END",
            "id_padre": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey END",
            "cod_producto": "(o_orderkey * 7) % 2600",
            "tipo_cultivo": "CASE WHEN o_orderkey % 7 = 0 THEN '  ' ELSE o_orderpriority END",
            "cultivo_custom": "CASE WHEN o_orderkey % 3 = 0 THEN ' huerto ' WHEN o_orderkey % 3 = 1 THEN ' ' ELSE NULL END",
            "uso_sigpac": "CASE WHEN o_orderkey % 2 = 0 THEN 'TA' ELSE NULL END",
            "tipo_registro": "CASE WHEN o_orderkey % 5 = 0 THEN 'IMPLANTACION' WHEN o_orderkey % 5 = 1 THEN NULL ELSE 'campana' END",
            "campana": "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(1995 + o_orderkey % 8 AS INT) END",
            "origen_cultivo": "CASE WHEN o_orderkey % 8 = 0 THEN 'x' WHEN o_orderkey % 2 = 0 THEN 'f' ELSE 'C' END",
        },
    ),
    "v_product": View("part", {"codigo": "p_partkey", "descripcion": "CASE WHEN p_partkey % 17 = 0 THEN ' ' ELSE p_name END"}),
    "v_ndvi": View(
        "orders",
        {
            "id_indice": "o_orderkey",
            "id_recinto": "o_custkey",
            "fecha_ndvi": "CAST(o_orderdate AS DATE)",
            "valor_medio": "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST((o_orderkey * 13) % 1000 AS DOUBLE) / 1000 END",
            "valor_min": "CAST((o_orderkey * 29) % 700 AS DOUBLE) / 1000",
            "valor_max": "CAST((o_orderkey * 17) % 1000 AS DOUBLE) / 1000",
            "ruta_ndvi": "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE concat('ndvi/', CAST(o_orderkey AS VARCHAR(20))) END",
        },
    ),
    "v_op": View(
        "events",
        {
            "id_operacion": "event_id",
            "id_recinto": "user_id",
            "tipo": "event_type",
            "fecha": "CAST(ts AS DATE)",
            "valor": "value",
            "detalle": "props",
        },
    ),
    "v_pixel": View(
        "lineitem",
        {
            "scene": "l_linenumber",
            "tile": "CAST((l_suppkey - l_suppkey % 100) / 100 AS INT)",
            "r": "l_orderkey % 64",
            "c": "l_partkey % 64",
            "red": "MIN((l_orderkey * 37 + l_partkey) % 3000)",
            "nir": "MIN((l_orderkey * 91 + l_partkey * 7) % 6000)",
            "scl": "MIN((l_orderkey * 5 + l_partkey * 3) % 12)",
        },
        ["scene", "tile", "r", "c"],
    ),
    "v_cell": View(
        "part",
        {
            "celda": "p_partkey",
            "nombre": "p_name",
            "x0": "CAST((p_partkey * 29) % 400 AS DOUBLE)",
            "y0": "CAST((p_partkey * 13) % 300 AS DOUBLE)",
            "w": "CAST(2 + p_partkey % 3 AS DOUBLE)",
            "h": "CAST(2 + p_partkey % 2 AS DOUBLE)",
            "rg": "CASE WHEN p_partkey % 2 = 0 THEN 'R' ELSE 'S' END",
            "ev_t": "CAST((p_partkey * 7) % 80 AS DOUBLE) / 10",
            "et_0": "CAST((p_partkey * 7 + 11) % 90 AS DOUBLE) / 10",
            "et_1": "CAST((p_partkey * 7 + 22) % 90 AS DOUBLE) / 10",
            "et_2": "CAST((p_partkey * 7 + 33) % 90 AS DOUBLE) / 10",
            "et_3": "CAST((p_partkey * 7 + 44) % 90 AS DOUBLE) / 10",
        },
    ),
    "v_scene": View(
        "orders",
        {
            "scene": "o_orderkey",
            "tile": "concat('T', CAST(o_custkey % 13 AS VARCHAR(20)))",
            "fecha": "CAST(o_orderdate AS DATE)",
            "cloud": "CAST((o_orderkey * 7) % 101 AS DOUBLE)",
        },
    ),
}


def with_ring(plots: DataFrame) -> DataFrame:
    """Plot rectangles as rings with their box."""
    x0, y0 = F.col("x0"), F.col("y0")
    x1, y1 = x0 + F.col("w"), y0 + F.col("h")
    return plots.withColumns({"ring": R.rectangle(x0, y0, x1, y1), "minx": x0, "miny": y0, "maxx": x1, "maxy": y1})


def spark_view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if name in VIEWS:
        view = VIEWS[name]
        return view.frame(table(spark, folder, view.source))
    return table(spark, folder, name)
