"""Cookies of one resolution: reading Set-Cookie lines, the newest of each name, the cap of an origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from linkhop.functions.urls import let

#: Characters that an origin's cookies may take, three more than name and value each.
MAX_PER_ORIGIN = 8192
#: White space that is cut from both ends.
SPACE = " \t\n\x0b\f\r"
#: Months of a cookie date, and its form.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
DATE = r"([0-9]{1,2})[ -]([A-Za-z]{3})[A-Za-z]*[ -]([0-9]{2,4})\s+([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2})"


def parse_set_cookie(line: Column) -> Column:
    """struct(name, value, attributes); the name is null where there is none.  A line is split once."""

    def read(parts: Column) -> Column:
        pair = F.get(parts, F.lit(0))
        before = F.substring_index(pair, "=", 1)
        name = F.when(pair.contains("="), F.trim(before, F.lit(SPACE)))
        return F.struct(
            F.nullif(name, F.lit("")).alias("name"),
            F.trim(F.substr(pair, F.length(before) + 2), F.lit(SPACE)).alias("value"),
            F.transform(F.slice(parts, 2, F.size(parts)), lambda a: F.struct(
                F.lower(F.trim(F.substring_index(a, "=", 1))).alias("key"),
                F.when(a.contains("="), F.trim(F.substr(a, F.length(F.substring_index(a, "=", 1)) + 2))).otherwise("").alias("value"),
            )).alias("attributes"),
        )

    return let(F.split(line, ";"), read)


def cookie_expired(attributes: Column, now: Column) -> Column:
    """The first numeric Max-Age decides; else the last Expires with a time of day, at or before now."""
    ages = F.filter(attributes, lambda a: (a["key"] == "max-age") & a["value"].rlike("^-?[0-9]+$"))
    dates = F.filter(attributes, lambda a: (a["key"] == "expires") & a["value"].rlike("[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}"))
    last = F.element_at(dates, -1)["value"]
    part = lambda i: F.nullif(F.regexp_extract(last, DATE, i), F.lit("")).cast("int")
    year = F.when(part(3) < 70, part(3) + 2000).when(part(3) < 100, part(3) + 1900).otherwise(part(3))
    month = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(last, DATE, 2))).cast("int"), F.lit(0))
    at = F.try_make_timestamp(year, month, part(1), part(4), part(5), part(6), F.lit("UTC"))
    old = F.when(F.size(dates) > 0, at <= now)
    return F.coalesce(F.when(F.size(ages) > 0, F.get(ages, F.lit(0))["value"].cast("decimal(38,0)") <= 0), F.when(F.size(ages) > 0, F.lit(False)), old, F.lit(False))


#: A jar, and the Set-Cookie lines of an answer as they go into it.
JAR = "map<string,array<struct<name:string,value:string>>>"
SET_COOKIES = "array<struct<name:string,value:string,expired:boolean>>"


def set_cookies_of(lines: Column, now: Column) -> Column:
    """The Set-Cookie lines of an answer in order, nameless ones left out, each with whether it had expired at `now`."""
    parsed = F.transform(F.coalesce(lines, F.array().cast("array<string>")), parse_set_cookie)
    named = F.filter(parsed, lambda c: c["name"].isNotNull())
    return F.transform(named, lambda c: F.struct(c["name"].alias("name"), c["value"].alias("value"), cookie_expired(c["attributes"], now).alias("expired")))


def stored(jar: Column, origin: Column, lines: Column, most: int = MAX_PER_ORIGIN) -> Column:
    """jar after an answer of origin: a cookie that is set again becomes the newest, an expired one goes, and the oldest go until the rest fits."""
    own = F.coalesce(F.try_element_at(jar, origin), F.array().cast("array<struct<name:string,value:string>>"))
    none = F.array().cast("array<struct<name:string,value:string>>")
    added = F.aggregate(lines, own, lambda held, c: F.concat(F.filter(held, lambda x: x["name"] != c["name"]), F.when(c["expired"], none).otherwise(F.array(F.struct(c["name"].alias("name"), c["value"].alias("value"))))))
    start = F.struct(F.lit(0).alias("size"), none.alias("kept"), F.lit(False).alias("full"))

    def keep(a: Column, c: Column) -> Column:
        size = a["size"] + F.length(c["name"]) + F.length(c["value"]) + 3
        over = a["full"] | (size > most)
        return F.struct(F.when(over, a["size"]).otherwise(size).alias("size"), F.when(over, a["kept"]).otherwise(F.concat(F.array(c), a["kept"])).alias("kept"), over.alias("full"))

    capped = F.aggregate(F.reverse(added), start, keep, lambda a: a["kept"])
    return F.map_concat(F.map_filter(jar, lambda k, _: k != origin), F.create_map(origin, capped))


def cookie_latest(set_cookies: DataFrame) -> DataFrame:
    """Of (link_id, origin, seq, name, value, expired) the newest of each name, unless it has expired."""
    newest = F.row_number().over(Window.partitionBy("link_id", "origin", "name").orderBy(F.col("seq").desc()))
    return set_cookies.where("name is not null").withColumn("r", newest).where("r = 1 and not expired").drop("r")


def cookie_cap(cookies: DataFrame, most: int = MAX_PER_ORIGIN) -> DataFrame:
    """The newest cookies of each link and origin that fit in `most` together; the oldest go first.

    To be applied after each answer: what went once stays gone.
    """
    newest_first = Window.partitionBy("link_id", "origin").orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, 0)
    taken = F.sum(F.length("name") + F.length("value") + 3).over(newest_first)
    return cookies.withColumn("t", taken).where(F.col("t") <= most).drop("t")


def cookie_headers(cookies: DataFrame) -> DataFrame:
    """(link_id, origin, cookie): what is sent to an origin, oldest first; no row where there is none."""
    grouped = cookies.groupBy("link_id", "origin").agg(F.array_sort(F.collect_list(F.struct("seq", "name", "value"))).alias("c"))
    return grouped.select("link_id", "origin", F.array_join(F.transform("c", lambda c: F.concat_ws("=", c["name"], c["value"])), "; ").alias("cookie"))


def cookie_header(jar: Column, origin: Column) -> Column:
    """The header from a jar column map<origin, array<struct<name,value>>>; null when there is nothing to send."""
    own = F.coalesce(F.try_element_at(jar, origin), F.array().cast("array<struct<name:string,value:string>>"))
    return F.when(F.size(own) > 0, F.array_join(F.transform(own, lambda c: F.concat(c["name"], F.lit("="), c["value"])), "; "))
