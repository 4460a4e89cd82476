"""Input and redirect targets as absolute URLs: plain ones by columns, the distinct rest by a helper.

Most captured URLs are in canonical form already, and most targets are such URLs or plain
paths.  Those never leave the JVM; of what is left each distinct text, or text and base,
goes through the helper once and is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from linkhop.functions.urls import MAX_URL_LENGTH, fragment, scheme
from linkhop.functions.whatwg import PARSED, PLAIN_HOST, PLAIN_PATH, PLAIN_REST, parse_input_url, resolve_location
from linkhop.sources.tables import broadcast_if_small, written

#: A URL in canonical form, and targets that only need what stands before their path.
PLAIN_URL, PLAIN_TARGET = rf"^https?://{PLAIN_HOST}{PLAIN_PATH}{PLAIN_REST}\z", rf"^(?!//){PLAIN_PATH}{PLAIN_REST}\z"
_KIND = PARSED.simpleString()


def _good(href: Column) -> Column:
    no = F.lit(None).cast("string")
    return F.struct(F.lit(True).alias("ok"), href.alias("href"), no.alias("status"), no.alias("error"), no.alias("safe_input"), F.lit(False).alias("credentials_removed"))


def _short(href: Column) -> Column:
    return F.length(href) <= MAX_URL_LENGTH


def with_input(rows: DataFrame, raw_col: str, out: str) -> DataFrame:
    """rows with `out`, what parse_input_url gives for the text in raw_col; a null text counts as empty."""
    raw = F.coalesce(F.col(raw_col), F.lit(""))
    held = rows.withColumn("_raw", F.when(~(raw.rlike(PLAIN_URL) & _short(raw)), raw))
    return _filled(held, ["_raw"], parse_input_url(F.col("_raw")), F.when(F.col("_raw").isNull(), _good(raw)), out)


def with_location(rows: DataFrame, location: Column, base: Column, out: str, inherit_fragment: bool = False) -> DataFrame:
    """rows with `out`, what resolve_location gives for a target against the URL that sent it; nulls for a null target.

    rows should be a written table, as they are read more than once where a helper is needed.
    """
    origin = F.regexp_extract(base, rf"^https?://{PLAIN_HOST}", 0)
    href = F.when(location.rlike(PLAIN_URL), location).when((origin != "") & location.rlike(PLAIN_TARGET), F.concat(origin, location)).when(
        F.concat(F.lit("http:"), location).rlike(PLAIN_URL) & base.rlike("^https?:"), F.concat(scheme(base), F.lit(":"), location)
    )
    if inherit_fragment:
        href = F.when(location.contains("#"), href).otherwise(F.concat(href, fragment(base)))
    href = F.when(_short(href), href)
    held = rows.withColumn("_href", href).withColumns({"_loc": F.when(F.col("_href").isNull(), location), "_base": F.when(F.col("_href").isNull() & location.isNotNull(), F.coalesce(base, F.lit("")))})
    return _filled(held, ["_loc", "_base"], resolve_location(F.col("_loc"), F.col("_base"), inherit_fragment), F.when(F.col("_href").isNotNull(), _good(F.col("_href"))), out, "_href")


def _filled(rows: DataFrame, keys: list[str], helper: Column, plain: Column, out: str, *more: str) -> DataFrame:
    """rows with `out`: `plain` where the keys are null, else what the helper gives for them."""
    rare = rows.where(f"{keys[0]} is not null").select(*keys).distinct()
    if rare.isEmpty():
        return rows.withColumn(out, plain.cast(_KIND)).drop(*keys, *more)
    found = written(rare.withColumn("_found", helper), "parsed")
    met = rows.join(broadcast_if_small(found), keys, "left")
    return met.withColumn(out, F.coalesce(plain.cast(_KIND), F.col("_found"))).drop("_found", *keys, *more)
