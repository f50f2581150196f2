"""Hand-computed values of formulas, text, dates and projection."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldspark.functions import dates as D
from fieldspark.functions import projection as P
from fieldspark.functions import ring as R
from fieldspark.functions import rules
from fieldspark.functions import text as T
from fieldspark.functions.numbers import fixed, whole
from fieldspark.operators import irrigation as I
from fieldspark.sources import landing


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def lit(v, kind="double"):
    return F.lit(v).cast(kind)


@pytest.mark.parametrize(
    "code,ndvi,low,high,want",
    [
        ("KCB_GENERAL", 0.6, 0.15, 1.0, 0.764),
        ("KC_HERBACEO_COBERTURA_RAPIDA", 0.6, 0.2, 1.2, 0.85),
        ("KC_ANUAL_SUELO_VISIBLE", 0.6, 0.3, 1.25, 0.98),
        ("KC_FIJO_BAJO", 0.9, 0.0, 0.2, 0.10),
        ("other", 0.5, 0.2, 0.9, 0.9),
        ("KCB_GENERAL", None, 0.15, 1.0, 0.575),
        ("KCB_GENERAL", float("nan"), 0.15, 1.0, 0.575),
        ("KCB_GENERAL", float("inf"), 0.15, 1.0, 1.0),
        ("KCB_GENERAL", -1.0, 0.15, 1.0, 0.15),
    ],
)
def test_kc(spark, code, ndvi, low, high, want):
    assert one(spark, rules.kc_from_ndvi(lit(ndvi), F.lit(code), lit(low), lit(high)))[0] == pytest.approx(want)


def test_need_and_dose(spark):
    df = spark.createDataFrame([(1, 4.0, 0.85, 5.0, 10000.0)], "id int, etp double, kc double, ev_t double, area_m2 double")
    row = I.irrigation_need(df).first()
    assert (row.riego_mm, row.m3_ha, row.litros_txt, row.litros_dia, row.color) == (3.4, 34.0, "34.0 m³/ha", 34000, "blue")
    dose = I.irrigation_dose(I.irrigation_need(df).withColumn("sistexp_cod", F.lit("R"))).first()
    assert (dose.litros_netos, dose.litros_brutos, dose.m3_total_bruto, dose.eficiencia_pct) == (34000, 36957, 37.0, 92)


def test_volume_label(spark):
    assert list(one(spark, *[rules.volume_label(lit(v)) for v in (0.0, -1.0, 2.24, 12.0)])) == ["", "", "22.4 m³/ha", "120 m³/ha"]


def test_fixed(spark):
    assert list(one(spark, fixed(lit(0.145), 2), fixed(lit(2.5), 0), fixed(lit(-2.5), 0), whole(lit(7.5)), fixed(lit(None), 2))) == [0.14, 3.0, -3.0, 8, None]


def test_text(spark):
    got = one(
        spark,
        T.norm_text(F.lit("  Viña año \n")),
        T.first_nonblank(F.lit(None).cast("string"), F.lit("  "), F.lit(" a ")),
        T.fix_mojibake(F.lit("RegadÃ­o")),
        T.fix_mojibake(F.lit("ya está €")),
        T.strip_irrigation_suffix(F.lit("Maíz (Regadío)")),
        T.strip_irrigation_suffix(F.lit("Trigo SECANO ")),
        T.phone_es(F.lit("+34 666 76 86 33")),
        T.phone_es(F.lit("34666768633")),
        T.phone_es(F.lit("123")),
        T.pad_code(F.lit(5), 3),
        T.pad_code(F.lit(12345), 3),
    )
    assert list(got) == ["VINA ANO", "a", "Regadío", "ya está €", "Maíz", "Trigo", "+34666768633", "+34666768633", None, "005", "12345"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("20250306", dt.date(2025, 3, 6)),
        ("06-03-2025", dt.date(2025, 3, 6)),
        ("6/3/2025", dt.date(2025, 3, 6)),
        ("2025-03-06T10:00:00", dt.date(2025, 3, 6)),
        ("6 Mar 2025", dt.date(2025, 3, 6)),
        ("6 Mar. 2025", dt.date(2025, 3, 6)),
        ("29/02/2023", None),
        ("nada", None),
    ],
)
def test_dates(spark, text, want):
    assert one(spark, D.parse_any_date(F.lit(text)))[0] == want


def test_local_day(spark):
    # 2025-03-06 23:00 UTC is already the next day in Madrid
    assert one(spark, D.epoch_ms_local_date(F.lit(1741302000000)))[0] == dt.date(2025, 3, 7)


def test_campaign(spark):
    day = lambda s: F.lit(s).cast("date")
    got = one(
        spark,
        D.campaign_year(day("2024-08-31")),
        D.campaign_year(day("2024-09-01")),
        D.campaign_day(day("2024-09-01")),
        D.campaign_day(day("2024-12-31")),
        D.campaign_day(day("2025-01-01")),
        D.campaign_day(day("2025-01-01"), shared_new_year=True),
        D.campaign_day_to_date(F.lit(122), F.lit(2025)),
        D.campaign_day_to_date(F.lit(121), F.lit(2025)),
        D.forecast_label(day("2024-12-30"), F.lit(1)),
    )
    assert list(got) == [2024, 2025, 0, 121, 122, 121, dt.date(2025, 1, 1), dt.date(2024, 12, 31), "01/01"]


def test_projection(spark):
    # on the central meridian the northing is the meridian arc (4984944.378 m at 45°) times the scale
    p = one(spark, P.to_utm(lit(-3.0), lit(45.0), F.lit(30)))[0]
    assert p.x == pytest.approx(500000.0, abs=1e-6) and p.y == pytest.approx(0.9996 * 4984944.378, abs=0.01)
    q = one(spark, P.to_utm(lit(-4.7), lit(41.6), F.lit(30)))[0]
    back = one(spark, P.from_utm(lit(q.x), lit(q.y), F.lit(30)))[0]
    assert back.x == pytest.approx(-4.7, abs=1e-9) and back.y == pytest.approx(41.6, abs=1e-9)


def test_areas_agree(spark):
    box = R.rectangle(lit(-4.0), lit(42.0), lit(-3.99), lit(42.01))
    geo, flat, web = one(spark, P.area_geography(box), R.area(P.ring_to_utm(box, F.lit(30))), P.area_web_mercator(box))
    assert geo == pytest.approx(flat, rel=2e-3)
    assert web / geo == pytest.approx(1.81, rel=0.02)


def test_rings(spark):
    ell = R.parse_wkt_ring(F.lit("POLYGON((0 0,4 0,4 2,2 2,2 4,0 4,0 0))"))
    got = one(
        spark,
        R.area(ell),
        R.contains_point(ell, lit(3.0), lit(3.0)),
        R.contains_point(ell, lit(1.0), lit(3.0)),
        R.contains_point(ell, lit(4.0), lit(1.0)),
        R.contains_point(ell, lit(4.0), lit(1.0), "exclude"),
        R.is_simple(R.parse_wkt_ring(F.lit("POLYGON((0 0,2 2,2 0,0 2,0 0))"))),
        R.is_simple(ell),
        F.size(R.make_valid(ell)),
        R.polygons_intersect(ell, R.rectangle(lit(3.0), lit(3.0), lit(5.0), lit(5.0))),
        R.polygons_intersect(ell, R.rectangle(lit(4.0), lit(0.0), lit(5.0), lit(1.0))),
        R.polygons_intersect(ell, R.rectangle(lit(0.5), lit(0.5), lit(0.6), lit(0.6))),
    )
    assert list(got) == [12.0, False, True, True, False, False, True, 7, False, True, True]


def test_feature_info_formats(spark):
    rows = [
        ('{"features":[{"properties":{"CULTIVO":"MAIZ","USO":"TA"}}]}', "application/json", "TA", "MAIZ"),
        ("<table><tr><th>Pixel Value</th><th>Cobertura</th></tr><tr><td>7</td><td>Trigo</td></tr></table>", "text/html", "7", "Trigo"),
        ("<tr><th>descripcion</th><td>Olivo</td></tr>", "text/html", None, "Olivo"),
        ("COD = 5\nDESCRIPCION = Vid", "text/plain", "5", "Vid"),
        ("<r><x:uso>9</x:uso></r>", "application/xml", "9", None),
        ("no hay nada", "text/plain", None, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, body string, content_type string, code string, description string")
    for r in landing.land_feature_info(df).collect():
        assert (r.codigo, r.descripcion) == (r.code, r.description), r.body


def test_legend_headers(spark):
    raw = spark.createDataFrame(
        [("3", "Vid", "300", "-4", "16"), ("x", "no", "1", "1", "1")], ["\ufeffCod Cultivo", "Descripción cultivo", "R", "G", "B"]
    )
    assert [tuple(r) for r in landing.legend_rows(raw, F.lit(2024)).collect()] == [(2024, 3, "Vid", 300, -4, 16, "#FF0010")]


def test_interval_wraps(spark):
    got = one(spark, *[landing.interval_holds(F.lit(p), F.lit(h)) for p, h in (("0612", 6), ("0612", 12), ("2206", 3), ("1800", 2), ("06", 6))])
    assert list(got) == [True, False, True, True, False]


def test_all_parts_and_holes(spark):
    one = R.parse_wkt_parts(F.lit("POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 8 2, 8 8, 2 8, 2 2))"))
    two = R.parse_wkt_parts(F.lit("MULTIPOLYGON(((0 0,4 0,4 4,0 4,0 0),(1 1,2 1,2 2,1 2,1 1)),((10 0,12 0,12 2,10 2,10 0)))"))
    json = R.parse_geojson_parts(F.lit('{"type": "MultiPolygon", "coordinates": [[[[0,0],[4,0],[4,4],[0,4],[0,0]]],[[[10,0],[12,0],[12,2],[10,2],[10,0]]]]}'))
    row = spark.range(1).select(
        R.parts_area(one), R.parts_area(two), R.parts_area(json), F.size(two), F.size(two[0]),
        R.parts_contain(one, F.lit(5.0), F.lit(5.0)), R.parts_contain(one, F.lit(1.0), F.lit(5.0)), R.parts_contain(two, F.lit(11.0), F.lit(1.0)),
        R.parse_wkt_parts(F.lit("POINT(1 2)")),
    ).first()
    assert tuple(row) == (64.0, 19.0, 20.0, 2, 2, False, True, True, None)


def test_dissolve_keeps_holes_and_pieces(spark):
    from fieldspark.operators import polygons as G

    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    around = [box(0, 0, 3, 1), box(2, 1, 3, 3), box(0, 2, 2, 3), box(0, 1, 1, 2)]
    apart = [box(0, 0, 1, 1), box(5, 5, 7, 7)]
    rows = [(k, i, f"P{i}", [(float(x), float(y)) for x, y in r]) for k, v in ((1, around), (2, apart)) for i, r in enumerate(v)]
    pieces = spark.createDataFrame(rows, "k int, pos int, nombre string, ring array<struct<x:double,y:double>>")
    got = {r["k"]: r for r in G.dissolve_adjacent(pieces, "k").collect()}
    assert got[1]["area"] == pytest.approx(8.0) and got[1]["n_rings"] == 2 and len(got[1]["rings"]) == 2 and got[1]["status"] == "needs_closing"
    assert got[2]["area"] == pytest.approx(5.0) and got[2]["n_rings"] == 2 and got[2]["n_open"] == 0
