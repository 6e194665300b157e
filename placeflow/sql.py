"""The library's functions in SQL: `register(spark)` makes temporary functions that `spark.sql` can call.

Scalar functions have the text of their column functions, so there is one definition of each. Table functions are queries over
them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from placeflow.functions import geo

#: (parameters, result, the column function) by name.
SCALARS: dict[str, tuple[str, str, Callable[..., Column]]] = {
    "pf_haversine": ("lat1 double, lon1 double, lat2 double, lon2 double", "double", geo.haversine),
    "pf_accept_radius": ("cell_km double", "double", geo.accept_radius),
    "pf_cell_key": ("lat double, lon double", "string", geo.cell_key),
    "pf_view_metres": ("zoom double", "double", geo.view_metres),
    "pf_in_box": ("lat double, lon double, min_lat double, min_lon double, max_lat double, max_lon double", "boolean", lambda lat, lon, s, w, n, e: F.coalesce(lat.between(s, n) & lon.between(w, e), F.lit(False))),
}
#: (parameters, columns, query) by name.
TABLES = {
    "pf_cells": (
        "min_lat double, min_lon double, max_lat double, max_lon double, cell_km double", "i bigint, j bigint, lat double, lon double",
        f"""SELECT i, j, lat, lon FROM
              (SELECT i, j, s + (i + 0.5D) * dlat AS lat, w + (j + 0.5D) * dlon AS lon, n, e FROM
                (SELECT *, explode(sequence(0L, CAST(ceil((e - w) / dlon) AS bigint))) AS j FROM
                  (SELECT *, explode(sequence(0L, CAST(ceil((n - s) / dlat) AS bigint))) AS i FROM
                    (SELECT min_lat AS s, min_lon AS w, max_lat AS n, max_lon AS e, cell_km / {geo.KM_PER_DEGREE}D AS dlat,
                            cell_km / ({geo.KM_PER_DEGREE}D * greatest(cos(radians((min_lat + max_lat) / 2)), 1e-6D)) AS dlon))))
            WHERE lat < n AND lon < e""",
    ),
}


def _text(spark: SparkSession, parameters: str, call: Callable[..., Column]) -> str:
    """The SQL text of a column function of these parameters."""
    names = [p.split()[0] for p in parameters.split(", ")]
    rows = spark.createDataFrame([], parameters).select(call(*map(F.col, names)).alias("result"))
    return rows._jdf.queryExecution().analyzed().expressions().head().child().sql()


def register(spark: SparkSession) -> list[str]:
    """Make the functions in this session; their names."""
    for name, (parameters, result, call) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {_text(spark, parameters, call)}")
    for name, (parameters, columns, query) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {query}")
    return [*SCALARS, *TABLES]
