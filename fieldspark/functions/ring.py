"""Polygon rings as ``array<struct<x,y>>`` columns: area, centroid, tests. Rings may be open or closed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RING_TYPE = "array<struct<x:double,y:double>>"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rectangle(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    return F.array(point(minx, miny), point(maxx, miny), point(maxx, maxy), point(minx, maxy))


def is_box(ring: Column) -> Column:
    """Whether a ring, open or closed, is an upright rectangle: such rings are compared by their corners alone."""
    a, b, c, d, e = (F.get(ring, F.lit(i)) for i in range(5))
    four = (F.size(ring) == 4) | ((F.size(ring) == 5) & (a["x"] == e["x"]) & (a["y"] == e["y"]))
    along = (a["y"] == b["y"]) & (b["x"] == c["x"]) & (c["y"] == d["y"]) & (d["x"] == a["x"])
    upward = (a["x"] == b["x"]) & (b["y"] == c["y"]) & (c["x"] == d["x"]) & (d["y"] == a["y"])
    return F.coalesce(four & (along | upward) & (a["x"] != c["x"]) & (a["y"] != c["y"]), F.lit(False))


def _box(ring: Column) -> tuple[Column, Column, Column, Column]:
    """Lower and upper corner of a ring that ``is_box``."""
    a, c = F.get(ring, F.lit(0)), F.get(ring, F.lit(2))
    return F.least(a["x"], c["x"]), F.least(a["y"], c["y"]), F.greatest(a["x"], c["x"]), F.greatest(a["y"], c["y"])


def common_box(a: Column, b: Column) -> tuple[Column, Column, Column, Column]:
    """Corners of what two boxes have in common; they have none where an upper one is below a lower one."""
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = _box(a), _box(b)
    return F.greatest(ax0, bx0), F.greatest(ay0, by0), F.least(ax1, bx1), F.least(ay1, by1)


def is_own_box(ring: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Whether a ring is an upright rectangle with these corners, so that what holds for its box holds for itself."""
    same = [a == b for a, b in zip(_box(ring), (minx, miny, maxx, maxy))]
    return F.coalesce(is_box(ring) & same[0] & same[1] & same[2] & same[3], F.lit(False))


def open_ring(ring: Column) -> Column:
    """Ring without its closing vertex."""

    def opened(r: Column) -> Column:
        n = F.size(r)
        closed = (n > 1) & (F.get(r, F.lit(0)) == F.get(r, n - 1))
        return F.when(closed, F.slice(r, F.lit(1), n - 1)).otherwise(r)

    return let(ring, opened)


def edges(ring: Column) -> Column:
    """``array<struct<a,b>>`` of consecutive vertices, including the closing edge."""

    def paired(o: Column) -> Column:
        shifted = F.concat(F.slice(o, F.lit(2), F.greatest(F.size(o) - 1, F.lit(0))), F.slice(o, 1, 1))
        return F.zip_with(o, shifted, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    return let(open_ring(ring), paired)


def _total(values: Column, term) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + term(v))


def signed_area(ring: Column) -> Column:
    """Shoelace relative to the first vertex, which keeps precision for large coordinates."""

    def total(es: Column) -> Column:
        def summed(first: Column) -> Column:
            def term(e: Column) -> Column:
                ax, ay = e["a"]["x"] - first["x"], e["a"]["y"] - first["y"]
                bx, by = e["b"]["x"] - first["x"], e["b"]["y"] - first["y"]
                return ax * by - bx * ay

            return _total(es, term) / 2.0

        return let(F.get(es, F.lit(0))["a"], summed)

    return let(edges(ring), total)


def area(ring: Column) -> Column:
    a, c = F.get(ring, F.lit(0)), F.get(ring, F.lit(2))
    return F.when(is_box(ring), F.abs((c["x"] - a["x"]) * (c["y"] - a["y"]))).otherwise(F.abs(signed_area(ring)))


def centroid(ring: Column) -> Column:
    """Area centroid; the vertex mean for rings without area."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def around(es: Column) -> Column:
        def of(first: Column) -> Column:
            def step(acc: Column, e: Column) -> Column:
                ax, ay = e["a"]["x"] - first["x"], e["a"]["y"] - first["y"]
                bx, by = e["b"]["x"] - first["x"], e["b"]["y"] - first["y"]
                cross = ax * by - bx * ay
                return F.struct(
                    (acc["s"] + cross).alias("s"),
                    (acc["x"] + (ax + bx) * cross).alias("x"),
                    (acc["y"] + (ay + by) * cross).alias("y"),
                )

            def finish(acc: Column) -> Column:
                n = F.size(es)
                mean = point(_total(es, lambda e: e["a"]["x"]) / n, _total(es, lambda e: e["a"]["y"]) / n)
                exact = point(first["x"] + acc["x"] / (3 * acc["s"]), first["y"] + acc["y"] / (3 * acc["s"]))
                return F.when(acc["s"] != 0, exact).otherwise(mean)

            return F.aggregate(es, zero, step, finish)

        return let(F.get(es, F.lit(0))["a"], of)

    return let(edges(ring), around)


def bounds(ring: Column) -> dict[str, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)}


def with_bounds(df, ring: str = "ring"):
    return df.withColumns(bounds(F.col(ring)))


def _on_edges(es: Column, x: Column, y: Column) -> Column:
    def hit(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        collinear = (bx - ax) * (y - ay) == (by - ay) * (x - ax)
        within = (
            (x >= F.least(ax, bx)) & (x <= F.greatest(ax, bx)) & (y >= F.least(ay, by)) & (y <= F.greatest(ay, by))
        )
        return collinear & within

    return F.exists(es, hit)


def on_boundary(ring: Column, x: Column, y: Column) -> Column:
    return _on_edges(edges(ring), x, y)


def _crossings_odd(es: Column, x: Column, y: Column) -> Column:
    def crosses(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        straddles = (ay > y) != (by > y)
        return straddles & (x < (bx - ax) * (y - ay) / F.when(by != ay, by - ay) + ax)

    count = F.aggregate(es, F.lit(0), lambda acc, e: acc + F.when(crosses(e), 1).otherwise(0))
    return count % 2 == 1


def edges_hold(es: Column, x: Column, y: Column, boundary: str = "include") -> Column:
    """``contains_point`` on edges that were made before."""
    inside = _crossings_odd(es, x, y)
    if boundary == "half_open":
        return inside
    if boundary == "exclude":
        return inside & ~_on_edges(es, x, y)
    return inside | _on_edges(es, x, y)


def contains_point(ring: Column, x: Column, y: Column, boundary: str = "include") -> Column:
    """Point in polygon. ``boundary``: ``include`` (intersects), ``exclude`` (within) or ``half_open``.

    ``half_open`` gives a point on a shared edge to exactly one neighbour, as raster masks do.
    """
    x0, y0, x1, y1 = _box(ring)
    if boundary == "exclude":
        held = (x > x0) & (x < x1) & (y > y0) & (y < y1)
    elif boundary == "half_open":
        held = (x >= x0) & (x < x1) & (y >= y0) & (y < y1)
    else:
        held = (x >= x0) & (x <= x1) & (y >= y0) & (y <= y1)
    return F.when(is_box(ring), held).otherwise(let(edges(ring), lambda es: edges_hold(es, x, y, boundary)))


def _segments_meet(p: Column, q: Column) -> Column:
    """Closed segments share a point. The cheap box test comes first; orientations are computed once."""

    def side(a: Column, b: Column, c: Column) -> Column:
        return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))

    boxes = F.lit(True)
    for v in "xy":
        boxes = (
            boxes
            & (F.least(p["a"][v], p["b"][v]) <= F.greatest(q["a"][v], q["b"][v]))
            & (F.greatest(p["a"][v], p["b"][v]) >= F.least(q["a"][v], q["b"][v]))
        )
    # with overlapping boxes, two segments meet unless one lies strictly on one side of the other
    across = side(p["a"], p["b"], q["a"]) * side(p["a"], p["b"], q["b"]) <= 0
    back = side(q["a"], q["b"], p["a"]) * side(q["a"], q["b"], p["b"]) <= 0
    return boxes & across & back


def polygons_intersect(a: Column, b: Column) -> Column:
    """True when the closed polygons share at least one point."""

    def test(ea: Column) -> Column:
        def against(eb: Column) -> Column:
            pa, pb = F.get(ea, F.lit(0))["a"], F.get(eb, F.lit(0))["a"]
            inside = _crossings_odd(ea, pb["x"], pb["y"]) | _crossings_odd(eb, pa["x"], pa["y"])
            return inside | F.exists(ea, lambda p: F.exists(eb, lambda q: _segments_meet(p, q)))

        return let(edges(b), against)

    x0, y0, x1, y1 = common_box(a, b)
    return F.when(is_box(a) & is_box(b), (x0 <= x1) & (y0 <= y1)).otherwise(let(edges(a), test))


def _distance_to_edges(es: Column, x: Column, y: Column) -> Column:
    def one(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        dx, dy = bx - ax, by - ay
        length2 = dx * dx + dy * dy
        share = F.when(length2 > 0, ((x - ax) * dx + (y - ay) * dy) / length2).otherwise(F.lit(0.0))

        def at(t: Column) -> Column:
            px, py = ax + t * dx - x, ay + t * dy - y
            return F.sqrt(px * px + py * py)

        return let(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)), at)

    return F.array_min(F.transform(es, one))


def distance_to_polygon(ring: Column, x: Column, y: Column) -> Column:
    """0 inside and on the border."""
    return let(
        edges(ring), lambda es: F.when(_crossings_odd(es, x, y), F.lit(0.0)).otherwise(_distance_to_edges(es, x, y))
    )


def covered_by_tolerance(inner: Column, outer: Column, tolerance: float = 0.0001, boxes: Column | None = None) -> Column:
    """Every vertex of ``inner`` lies in ``outer`` or no further than the tolerance from its border.

    ``boxes``: whether both are upright rectangles, where that was found out for each ring before they were paired.
    """

    def test(es: Column) -> Column:
        near = lambda p: _crossings_odd(es, p["x"], p["y"]) | (_distance_to_edges(es, p["x"], p["y"]) <= F.lit(tolerance))
        return F.forall(inner, near)

    (ix0, iy0, ix1, iy1), (x0, y0, x1, y1) = _box(inner), _box(outer)
    dx, dy = F.greatest(x0 - ix0, ix1 - x1, F.lit(0.0)), F.greatest(y0 - iy0, iy1 - y1, F.lit(0.0))
    both = is_box(inner) & is_box(outer) if boxes is None else boxes
    return F.when(both, F.sqrt(dx * dx + dy * dy) <= F.lit(tolerance)).otherwise(let(edges(outer), test))


def drop_repeated(ring: Column) -> Column:
    """Ring without consecutive repeated vertices and without the closing one."""

    def cleaned(es: Column) -> Column:
        moved = F.filter(es, lambda e: e["a"] != e["b"])
        return F.transform(moved, lambda e: e["a"])

    return let(edges(ring), cleaned)


def make_valid(ring: Column) -> Column:
    """Closed ring, no repeated vertices, anticlockwise; null below three vertices."""

    def fixed_up(clean: Column) -> Column:
        turned = F.when(signed_area(clean) < 0, F.reverse(clean)).otherwise(clean)
        return F.when(F.size(clean) >= 3, let(turned, lambda r: F.concat(r, F.slice(r, 1, 1))))

    return let(drop_repeated(ring), fixed_up)


def is_simple(ring: Column) -> Column:
    """No two edges that are not neighbours touch each other."""

    def test(es: Column) -> Column:
        numbered = F.transform(es, lambda e, i: F.struct(e["a"].alias("a"), e["b"].alias("b"), i.alias("i")))

        def free(ne: Column) -> Column:
            n = F.size(ne)

            def clash(p: Column) -> Column:
                def far(q: Column) -> Column:
                    gap = q["i"] - p["i"]
                    return (gap > 1) & (gap < n - 1) & _segments_meet(p, q)

                return F.exists(ne, far)

            return ~F.exists(ne, clash)

        return let(numbered, free)

    return let(edges(ring), test)


def anticlockwise(ring: Column) -> Column:
    """Open ring that turns left."""
    return let(open_ring(ring), lambda r: F.when(signed_area(r) < 0, F.reverse(r)).otherwise(r))


def is_convex(ring: Column) -> Column:
    """No right turn in an open anticlockwise ring of three or more vertices."""

    def turns(es: Column) -> Column:
        following = F.concat(F.slice(es, F.lit(2), F.greatest(F.size(es) - 1, F.lit(0))), F.slice(es, 1, 1))
        cross = lambda e, f: (e["b"]["x"] - e["a"]["x"]) * (f["b"]["y"] - f["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (f["b"]["x"] - f["a"]["x"])
        return (F.size(es) >= 3) & F.forall(F.zip_with(es, following, cross), lambda c: c >= -1e-12)

    return let(edges(ring), turns)


def clip_convex(subject: Column, clip: Column) -> Column:
    """The part of an open ring inside a convex anticlockwise one: each side of the clip ring cuts what the sides before it left.

    The area is right for any simple subject; of a non-convex one the parts may hang together by sides that run to and fro.
    """
    none = F.array().cast(RING_TYPE)

    def cut(ring: Column, e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        sided = F.transform(ring, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), (dx * (p["y"] - e["a"]["y"]) - dy * (p["x"] - e["a"]["x"])).alias("s")))

        def kept(pts: Column) -> Column:
            before = F.concat(F.slice(pts, -1, 1), F.slice(pts, F.lit(1), F.size(pts) - 1))

            def piece(p: Column, q: Column) -> Column:
                share = p["s"] / (p["s"] - q["s"])
                crossing = point(p["x"] + (q["x"] - p["x"]) * share, p["y"] + (q["y"] - p["y"]) * share)
                here = point(q["x"], q["y"])
                crosses, inside = (p["s"] >= 0) != (q["s"] >= 0), q["s"] >= 0
                return F.when(crosses & inside, F.array(crossing, here)).when(crosses, F.array(crossing)).when(inside, F.array(here)).otherwise(none)

            return F.when(F.size(pts) > 0, F.flatten(F.zip_with(before, pts, piece))).otherwise(none)

        return let(sided, kept)

    return F.aggregate(edges(clip), subject.cast(RING_TYPE), cut)


def box_overlap(a: Column, b: Column) -> Column:
    """Common area of two boxes."""
    x0, y0, x1, y1 = common_box(a, b)
    return F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0))


def convex_overlap(a: Column, b: Column) -> Column:
    """Common area of a simple ring and a convex one, both open and anticlockwise."""
    return let(clip_convex(a, b), lambda r: F.when(F.size(r) >= 3, F.abs(signed_area(r))).otherwise(F.lit(0.0)))


def parse_wkt_parts(wkt: Column) -> Column:
    """All parts of a WKT polygon or multipolygon, each with its outer ring and then its holes; null for other text."""
    pattern = r"(?is)^\s*(MULTI)?POLYGON\s*Z?\s*(\(.*\))\s*$"
    many = F.regexp_extract(wkt, pattern, 1) != ""
    body = F.regexp_extract(wkt, pattern, 2)
    inside = F.regexp_extract(F.when(many, body).otherwise(F.concat(F.lit("("), body, F.lit(")"))), r"(?s)^\s*\(\s*\(\s*\((.*)\)\s*\)\s*\)\s*$", 1)
    rings = lambda part: F.transform(F.split(part, r"\)\s*,\s*\("), _pairs)
    return F.when(inside != "", F.transform(F.split(inside, r"\)\s*\)\s*,\s*\(\s*\("), rings))


def parse_wkt_ring(wkt: Column) -> Column:
    """Outer ring of the first part: for text that is known to be one simple polygon. See ``parse_wkt_parts``."""
    return F.get(F.get(parse_wkt_parts(wkt), F.lit(0)), F.lit(0))


def parts_area(parts: Column) -> Column:
    """Area of all parts without their holes."""

    def net(part: Column) -> Column:
        holes = F.transform(F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(0))), area)
        return F.aggregate(holes, area(F.get(part, F.lit(0))), lambda total, hole: total - hole)

    return F.aggregate(F.transform(parts, net), F.lit(0.0), lambda total, a: total + a)


def parts_contain(parts: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in an outer ring and in none of its holes."""

    def holds(part: Column) -> Column:
        inner = F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(0)))
        return contains_point(F.get(part, F.lit(0)), x, y) & ~F.exists(inner, lambda hole: contains_point(hole, x, y))

    return F.exists(parts, holds)


def parts_edges(parts: Column) -> Column:
    """The edges of all rings. Crossings are counted over all of them, so holes are outside and several parts inside."""
    return F.flatten(F.transform(F.flatten(parts), edges))


def shape_edges(df, ring: str = "ring", parts: str = "parts") -> Column:
    """The edges of a row's geometry: of its parts if the table has such a column, else of its ring."""
    return parts_edges(F.col(parts)) if parts in df.columns else edges(F.col(ring))


def edges_meet_square(es: Column, x0: Column, y0: Column, x1: Column, y1: Column, slack: float = 0.0) -> Column:
    """Whether any edge shares a point with a closed rectangle: boxes meet, and the rectangle is not on one side of the edge's line."""

    def meets(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        boxes = (F.least(ax, bx) <= x1) & (F.greatest(ax, bx) >= x0) & (F.least(ay, by) <= y1) & (F.greatest(ay, by) >= y0)
        off = F.abs((bx - ax) * ((y0 + y1) / 2 - ay) - (by - ay) * ((x0 + x1) / 2 - ax))
        return boxes & (off <= ((x1 - x0) / 2 + slack) * F.abs(by - ay) + ((y1 - y0) / 2 + slack) * F.abs(bx - ax))

    return F.exists(es, meets)


def parts_boxes(parts: Column) -> Column:
    """Corners and sign (a hole's is -1) of all rings in one array of numbers; null unless they are upright rectangles, one at least."""
    signed = F.flatten(F.transform(parts, lambda part: F.transform(part, lambda r, i: F.struct(r.alias("ring"), F.when(i == 0, 1.0).otherwise(-1.0).alias("sign")))))
    corners = lambda rs: F.flatten(F.transform(rs, lambda v: F.array(*_box(v["ring"]), v["sign"])))
    return let(signed, lambda rs: F.when((F.size(rs) > 0) & F.forall(rs, lambda v: is_box(v["ring"])), corners(rs)))


#: Rings of a geometry that are compared with a rectangle without a loop.
RINGS = 4


def boxes_overlap(a: Column, b: Column) -> Column:
    """Common area of the ``parts_boxes`` of two geometries.

    Up to ``RINGS`` with one go without a loop. The loop for others also keeps Spark from putting all of it into one method with the join before it,
    which would be too long for the JVM to compile.
    """

    def one(i, j) -> Column:
        w = F.least(F.get(a, i + 2), F.get(b, j + 2)) - F.greatest(F.get(a, i), F.get(b, j))
        h = F.least(F.get(a, i + 3), F.get(b, j + 3)) - F.greatest(F.get(a, i + 1), F.get(b, j + 1))
        return F.when((w > 0) & (h > 0), w * h * F.get(a, i + 4) * F.get(b, j + 4)).otherwise(0.0)

    few = F.lit(0.0)
    for n in range(RINGS):
        few = few + F.when(F.size(a) > 5 * n, one(F.lit(5 * n), F.lit(0))).otherwise(0.0)
    places = lambda v: F.sequence(F.lit(0), F.size(v) - 5, F.lit(5))
    many = F.aggregate(places(a), F.lit(0.0), lambda s, i: F.aggregate(places(b), s, lambda u, j: u + one(i, j)))
    return F.when((F.size(a) <= 5 * RINGS) & (F.size(b) == 5), few).otherwise(many)


def parts_outline(parts: Column) -> Column:
    """The points of all outer rings, for bounds."""
    return F.flatten(F.transform(parts, lambda part: F.get(part, F.lit(0))))


def parse_wkt_point(wkt: Column) -> Column:
    number = r"(-?\d+\.?\d*(?:[eE][-+]?\d+)?)"
    pattern = rf"(?i)^\s*POINT\s*Z?\s*\(\s*{number}\s+{number}"
    x, y = F.regexp_extract(wkt, pattern, 1), F.regexp_extract(wkt, pattern, 2)
    return F.when(x != "", point(x, y))


def _pairs(text: Column) -> Column:
    return F.transform(
        F.split(F.trim(text), r"\s*,\s*"),
        lambda p: point(F.split(F.trim(p), r"\s+")[0].try_cast("double"), F.split(F.trim(p), r"\s+")[1].try_cast("double")),
    )


def parse_geojson_parts(text: Column) -> Column:
    """All parts of a GeoJSON polygon or multipolygon, each with its outer ring and then its holes; null for other text."""
    single = F.from_json(text, "type string, coordinates array<array<array<double>>>")
    multi = F.from_json(text, "type string, coordinates array<array<array<array<double>>>>")
    parts = F.when(single["type"] == "Polygon", F.array(single["coordinates"])).when(multi["type"] == "MultiPolygon", multi["coordinates"])
    ring = lambda r: F.transform(r, lambda p: point(F.get(p, F.lit(0)), F.get(p, F.lit(1))))
    return F.transform(parts, lambda part: F.transform(part, ring))


def ring_to_wkt(ring: Column) -> Column:
    closed = let(open_ring(ring), lambda r: F.concat(r, F.slice(r, 1, 1)))
    pairs = F.transform(closed, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    return F.concat(F.lit("POLYGON(("), F.concat_ws(",", pairs), F.lit("))"))


def ring_to_geojson(ring: Column) -> Column:
    closed = let(open_ring(ring), lambda r: F.concat(r, F.slice(r, 1, 1)))
    coordinates = F.array(F.transform(closed, lambda p: F.array(p["x"], p["y"])))
    return F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates"))


def dms_to_degrees(degrees: Column, minutes: Column, seconds: Column, hemisphere: Column) -> Column:
    value = degrees + minutes / 60.0 + seconds / 3600.0
    return F.when(F.upper(F.trim(hemisphere)).isin("S", "W", "O"), -value).otherwise(value)
