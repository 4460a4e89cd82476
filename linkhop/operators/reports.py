"""Outcomes of a run: counts, expectations, two runs side by side, the log of steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def outcome(status: Column, method: Column, error: Column) -> Column:
    """RESOLVED (http); UNRESOLVED (http): the error."""
    label = F.concat(status, F.when(method.isNotNull(), F.concat(F.lit(" ("), method, F.lit(")"))).otherwise(""))
    return F.when((status == "RESOLVED") | error.isNull() | (error == ""), label).otherwise(F.concat(label, F.lit(": "), error))


def outcome_counts(results: DataFrame) -> DataFrame:
    return results.groupBy(outcome(F.col("status"), F.col("method"), F.col("error")).alias("outcome")).agg(F.count("*").alias("n"))


def meets(expected: Column, final_url: Column, status: Column) -> Column:
    """Whether a result is as expected: a URL is held against the final URL, anything else against the status; null without one."""
    return F.when(expected.rlike("^https?:"), F.coalesce(expected == final_url, F.lit(False))).when(expected.isNotNull(), expected == status)


def match_expected(results: DataFrame, links: DataFrame) -> DataFrame:
    joined = results.join(links.select("link_id", "expected"), "link_id", "left")
    return joined.withColumn("meets", meets(F.col("expected"), F.col("final_url"), F.col("status")))


def expected_summary(matched: DataFrame) -> DataFrame:
    """One row: links, those with an expectation, those not as expected."""
    return matched.agg(F.count("*").alias("links"), F.count("expected").alias("expectations"), F.count_if(~F.col("meets")).alias("not_as_expected"))


def compare_runs(plain: DataFrame, full: DataFrame) -> DataFrame:
    """link_id with the outcomes of both runs, and whether rendering changed it."""
    o = lambda df, name: df.select("link_id", outcome(F.col("status"), F.col("method"), F.col("error")).alias(name))
    return o(plain, "without_browser").join(o(full, "with_browser"), "link_id").withColumn("changed", F.col("without_browser") != F.col("with_browser"))


def url_component(text: Column) -> Column:
    """text as encodeURIComponent writes it."""
    out = F.url_encode(text)
    for form, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(form), F.lit(plain))
    return out


def steps_log(results: DataFrame) -> DataFrame:
    """(link_id, seq, tag, message) of results with log: the URL, each step as it was taken, what was blocked, tracking names, the outcome.

    results: link_id, chain, final_url, status, error, log, and own_removed where input may
    have held a password.  No password, cookie, header or page text is logged; tracking names
    are percent-encoded.  Input that could not be read only has its outcome.
    """
    from linkhop.functions.urls import tracking_names
    from linkhop.operators.chains import LINES, PASSWORD_REMOVED, line, lines_if

    own = F.coalesce(F.col("own_removed"), F.lit(False)) if "own_removed" in results.columns else F.lit(False)
    begun = F.size("chain") > 0
    first = F.concat(lines_if(begun, line("URL", F.get("chain", F.lit(0)))), lines_if(begun & own, line("SECURITY", PASSWORD_REMOVED)))
    names = F.transform(tracking_names(F.col("final_url")), url_component)
    n = F.coalesce(F.size(names), F.lit(0))
    tracking = lines_if(n > 0, line("TRACKING", n.cast("string"), F.when(n == 1, " tracking parameter: ").otherwise(" tracking parameters: "), F.array_join(names, ", ")))
    blocked = lines_if(F.col("status") == "BLOCKED", line("SECURITY", F.coalesce("error", F.lit(""))))
    final = F.array(line("FINAL", F.when(F.col("status") == "RESOLVED", F.concat(F.lit("RESOLVED "), "final_url")).otherwise(F.concat_ws(": ", "status", "error"))))
    every = F.concat(first, F.coalesce("log", F.array().cast(LINES)), tracking, blocked, final)
    return results.select("link_id", F.posexplode(every).alias("seq", "s")).select("link_id", "seq", "s.tag", "s.message")


def report_table(links: DataFrame, plain: DataFrame, full: DataFrame) -> DataFrame:
    """The report of two runs, a row a link: link_id, service, url, without_browser, with_browser, expected, as_expected of both, note."""
    both = compare_runs(plain, full).drop("changed")
    ends = lambda df, name: df.select("link_id", F.col("final_url").alias(f"{name}_url"), F.col("status").alias(f"{name}_status"))
    rows = links.join(both, "link_id").join(ends(plain, "plain"), "link_id").join(ends(full, "full"), "link_id")
    judged = lambda name: F.when(F.col("expected").isNull(), "").when(meets(F.col("expected"), F.col(f"{name}_url"), F.col(f"{name}_status")), "yes").otherwise("no")
    return rows.select("link_id", "service", F.col("raw_url").alias("url"), "without_browser", judged("plain").alias("as_expected_without"), "with_browser", judged("full").alias("as_expected_with"), "expected", "note")
