"""Reading and writing the library's tables, and tables in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

LINKS = "link_id bigint, raw_url string, service string, expected string, note string, client string, ts timestamp_ntz"
RESPONSES = (
    "request_url string, cookie string, status_code int, location array<string>, set_cookies array<string>, cf_mitigated string, "
    "refresh array<string>, content_type string, content_encoding string, body binary, error_code string, error_message string, "
    "fetched_at timestamp_ntz, elapsed_ms bigint"
)
DNS = "host string, addresses array<string>"
RENDERED = "request_url string, ok boolean, chain array<string>, status_code int, challenge boolean, refresh string, html string, status string, error string"
RULES = "rule_order int, name string, host string, path_prefix string, target string"
RESULT = (
    "original_url string, final_url string, status string, method string, redirect_count int, chain array<string>, http_status int, "
    "timing struct<elapsed_ms:bigint>, security struct<credentials_removed:boolean>, "
    "tracking struct<clean_url:string,parameters:array<struct<name:string,value:string,kind:string>>>, error string"
)
#: Bytes of a page that are read.
MAX_HTML_BYTES = 1_048_576

_own = ""


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; only a session on one machine may leave it unset and gets one of its own."""
    global _own
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = _own = _own or tempfile.mkdtemp(prefix="linkhop-")
    return shared.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/linkhop/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, outlives executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes of one Arrow batch of pages.
ARROW_ROWS, ARROW_BYTES = 1000, 4_000_000


def short_batches(spark: SparkSession) -> None:
    """Short Arrow batches for helpers that read whole pages; the session keeps these limits, as results are computed after the call."""
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key)
        # a size may bear a unit, as in 64MB
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


#: Rows of a table that is broadcast.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, a written table of narrow rows, with a broadcast hint if it has at most that many, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= most else df


def read_links(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Links from a JSON array of {service, url, expected?, note?}, from text with one URL a line, or from Parquet.

    link_id numbers the rows of JSON and text; blank lines are left out.
    """
    if fmt == "parquet":
        return spark.read.schema(LINKS).parquet(path)
    if fmt == "json":
        rows = spark.read.schema("service string, url string, expected string, note string").json(path, multiLine=True)
        rows = rows.withColumnRenamed("url", "raw_url")
    else:
        rows = spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("raw_url"), *(F.lit(None).cast("string").alias(c) for c in ("service", "expected", "note")))
    return rows.select(F.monotonically_increasing_id().alias("link_id"), "raw_url", "service", "expected", "note")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESPONSES).parquet(path)


def plain_html(content_type, content_encoding):
    """Whether an answer is an HTML page that was sent as it is."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    return kind.isin("text/html", "application/xhtml+xml") & (F.lower(F.trim(F.coalesce(content_encoding, F.lit("identity")))) == "identity")


def decode_body(body, content_type, content_encoding, location):
    """The page's text: null with a Location, or for other kinds of answer; the first MiB; unknown charsets are read as UTF-8."""
    start = F.substring(body, 1, MAX_HTML_BYTES)
    charset = F.lower(F.regexp_extract(F.coalesce(content_type, F.lit("")), "(?i)charset=[\"']?([^\"';\\s]+)", 1))
    text = (
        F.when(charset.isin("iso-8859-1", "latin1", "windows-1252", "us-ascii", "ascii"), F.decode(start, "ISO-8859-1"))
        .when(charset.isin("utf-16", "utf-16le"), F.decode(start, "UTF-16LE"))
        .when(charset == "utf-16be", F.decode(start, "UTF-16BE"))
        .otherwise(F.make_valid_utf8(start.cast("string")))
    )
    return F.when(location.isNull() & plain_html(content_type, content_encoding), text)


def write_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The result table by status; nulls are kept and keys stay in the order of RESULT, also as JSON."""
    if fmt == "json":
        names = [f.split()[0] for f in RESULT.split(", ")]
        df.select(result_json(F.struct(*(n for n in names if n in df.columns))).alias("value")).write.text(path)
    else:
        df.write.partitionBy("status").parquet(path)


def result_json(result):
    """The JSON of a result, null fields included."""
    return F.to_json(result, {"ignoreNullFields": "false"})


def from_result_json(text):
    return F.from_json(text, RESULT)


def write_report(df: DataFrame, path: str) -> None:
    """A Markdown table of outcomes, one row a link, in order of link_id.  A report for people, so one file."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    columns = [c for c in df.columns if c != "link_id"]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))
    spark = df.sparkSession
    head = spark.createDataFrame([(-2, "| " + " | ".join(columns) + " |"), (-1, "| " + " | ".join("---" for _ in columns) + " |")], "at long, value string")
    head.unionByName(df.select(F.col("link_id").alias("at"), row.alias("value"))).orderBy("at").coalesce(1).select("value").write.text(path)
