"""All registered queries, by section."""

from fieldspark.plans import (  # noqa: F401
    q_crops,
    q_filters,
    q_geometry,
    q_interpolation,
    q_irrigation,
    q_joins,
    q_merge,
    q_raster,
    q_scalar,
    q_series,
    q_sources,
)

FLAGSHIP = "irrigation_dose"
