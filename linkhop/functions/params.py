"""Query parameters of one URL as rows, for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from linkhop.functions.urls import FUNCTIONAL_NAMES, TRACKING_NAMES
from linkhop.functions.whatwg import decoded_params

PARAMS = StructType([StructField("pos", IntegerType()), StructField("name", StringType()), StructField("value", StringType()), StructField("kind", StringType())])


class QueryParams:
    """(pos, name, value, kind) in order; no rows for a null or a URL without a query."""

    def eval(self, href: str) -> Iterator[tuple[int, str, str, str]]:
        for pos, (name, value) in enumerate(decoded_params(href or "")):
            lower = name.lower()
            known = "tracking" if lower.startswith("utm_") or lower in TRACKING_NAMES else "functional" if lower in FUNCTIONAL_NAMES else "unknown"
            yield pos, name, value, known


def register(spark: SparkSession, name: str = "query_params") -> None:
    """Makes SELECT * FROM query_params(href) and LATERAL joins with it possible."""
    spark.udtf.register(name, udtf(QueryParams, returnType=PARAMS))
