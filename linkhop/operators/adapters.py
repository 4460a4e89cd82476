"""Adapters: what a user knows of a service, as rules in a table or as functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from linkhop.functions.urls import hostname, is_http_url, path
from linkhop.sources.tables import short_batches

ANSWER = T.StructType([T.StructField("name", T.StringType()), T.StructField("target", T.StringType())])


@dataclass(frozen=True)
class Adapter:
    """matches tells from a URL whether the adapter knows its service; next gives from URL and page (or None) where it leads.

    Both travel to the executors, so they may use nothing that doesn't.
    """

    name: str
    matches: Callable[[str], bool]
    next: Callable[[str, str | None], str | None]


def first_answer(adapters: Sequence[Adapter], url: str, html: str | None) -> tuple[str | None, str | None]:
    """(name, target) of the first adapter that knows url; one whose matches fails is out, one whose next fails or gives no text has no answer, and ends the search."""
    for adapter in adapters:
        try:
            knows = adapter.matches(url)
        except Exception:  # noqa: BLE001, S112
            continue
        if knows:
            try:
                target = adapter.next(url, html)
            except Exception:  # noqa: BLE001
                target = None
            return adapter.name, target if isinstance(target, str) and target else None
    return None, None


def ask(adapters: Sequence[Adapter], url: Column, html: Column) -> Column:
    """struct(name, target) of the first adapter that knows each url, row by row in Arrow batches; a failure stays in its row."""
    short_batches(SparkSession.active())
    own = tuple(adapters)

    @F.pandas_udf(ANSWER)
    def answers(urls: pd.Series, pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if u is None else first_answer(own, u, p) for u, p in zip(urls, pages, strict=True)], columns=["name", "target"])

    return answers(url, html)


def apply_adapters(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, adapter_name, target): the first rule by order whose host and path prefix fit answers.

    A rule that fits without a target ends the search with none.  Rules are keyed by host,
    so they meet pages in an equi-join.
    """
    p = pages.select("page_id", hostname(F.col("url")).alias("host"), path(F.col("url")).alias("path")).where(is_http_url(F.col("url")))
    met = p.join(rules.withColumnRenamed("host", "rule_host"), (F.col("host") == F.col("rule_host")) & F.col("path").startswith(F.coalesce("path_prefix", F.lit(""))))
    first = met.groupBy("page_id").agg(F.min_by(F.struct("name", "target"), "rule_order").alias("r"))
    return first.select("page_id", F.col("r.name").alias("adapter_name"), F.nullif("r.target", F.lit("")).alias("target"))
