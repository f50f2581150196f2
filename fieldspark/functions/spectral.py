"""Pixel-level expressions on band values and scene classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scene classes that are never usable; the older run also drops 7.
INVALID_CLASSES = (0, 1, 3, 8, 9, 10, 11)
INVALID_CLASSES_STRICT = (0, 1, 3, 7, 8, 9, 10, 11)
CLOUD_CLASSES = (8, 9, 10)

# Quality weight by scene class and the weight of unlisted classes, per composite.
MOSAIC_WEIGHTS = ({2: 0.6, 4: 1.0, 5: 1.0, 6: 0.9, 7: 0.3, 11: 0.8}, 1.0)
TEMPORAL_WEIGHTS = ({2: 0.30, 4: 1.00, 5: 0.95, 6: 0.80, 7: 0.50, 11: 0.20}, 0.0)
BEST_PIXEL_WEIGHTS = ({2: 0.4, 4: 1.0, 5: 1.0, 6: 0.95, 7: 0.7, 11: 0.8}, 0.0)

# Upper limit and colour of each index class, lowest first.
INDEX_COLORS = (
    (-0.2, (0, 0, 0)),
    (0.0, (165, 0, 38)),
    (0.1, (215, 48, 39)),
    (0.2, (244, 109, 67)),
    (0.3, (253, 174, 97)),
    (0.4, (254, 224, 139)),
    (0.5, (255, 255, 191)),
    (0.6, (217, 239, 139)),
    (0.7, (166, 217, 106)),
    (0.8, (102, 189, 99)),
    (0.9, (26, 152, 80)),
    (1.0, (0, 104, 55)),
)
TOP_COLOR = (0, 104, 55)


def reflectance(raw: Column) -> Column:
    """Band value 1..10000 as a share; anything else is missing."""
    return F.when((raw > 0) & (raw <= 10000), raw / F.lit(10000.0))


def ndvi(red: Column, nir: Column, epsilon: float = 0.0) -> Column:
    if epsilon:
        return (nir - red) / (nir + red + F.lit(epsilon))
    return F.when((nir + red) != 0, (nir - red) / (nir + red))


def excess_green(red: Column, green: Column, blue: Column) -> Column:
    return 2 * green - red - blue


def invalid_class(scl: Column, classes: tuple[int, ...] = INVALID_CLASSES) -> Column:
    """Missing classes count as class 0, which is invalid."""
    return F.coalesce(scl, F.lit(0)).isin(*classes)


def quality_band_cloud(qa: Column) -> Column:
    """Opaque cloud (bit 10) or cirrus (bit 11)."""
    return F.coalesce(qa, F.lit(0)).bitwiseAND(F.lit((1 << 10) | (1 << 11))) != 0


def quality_weight(scl: Column, table: tuple[dict[int, float], float] = MOSAIC_WEIGHTS) -> Column:
    weights, default = table
    klass = F.coalesce(scl, F.lit(0))
    pairs = list(weights.items())
    chain = reduce(
        lambda acc, p: acc.when(klass == p[0], F.lit(p[1])), pairs[1:], F.when(klass == pairs[0][0], F.lit(pairs[0][1]))
    )
    return chain.otherwise(F.lit(default))


def index_class(value: Column) -> Column:
    """Class 0..12 of an index value, null when missing."""
    chain = F.when(value.isNull(), None)
    for number, (upper, _) in enumerate(INDEX_COLORS):
        chain = chain.when(value < upper, F.lit(number))
    return chain.otherwise(F.lit(len(INDEX_COLORS)))


def index_rgba(value: Column) -> Column:
    """``r,g,b,a`` struct; fully transparent when missing."""

    def rgba(r: int, g: int, b: int, a: int) -> Column:
        return F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b"), F.lit(a).alias("a"))

    chain = F.when(value.isNull(), rgba(0, 0, 0, 0))
    for upper, color in INDEX_COLORS:
        chain = chain.when(value < upper, rgba(*color, 255))
    return chain.otherwise(rgba(*TOP_COLOR, 255))
