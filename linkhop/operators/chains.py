"""Following links along captured hops, and what chains look like afterwards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window, functions as F

from linkhop.functions.urls import fragment, let, origin, request_key, tracking_report, without_fragment
from linkhop.operators.adapters import Adapter
from linkhop.operators.cookies import JAR, SET_COOKIES, cookie_header, stored
from linkhop.operators.hops import checked_edges, edges_of, heavier, method_weight, rendered_edges
from linkhop.operators.targets import with_input
from linkhop.sources.tables import RESULT, written

MAX_REDIRECTS = 20
#: Milliseconds that the answers of one link may take together, and how often a page comes up in a visit that goes round.
DEADLINE_MS, REVISITS = 10_000, 3
NOT_CAPTURED = "Request failed (NOT_CAPTURED)"
#: Texts of results.
LOOP_ERROR, LATE_ERROR = "The redirects lead back to a URL that was already visited", "Request timed out"


#: What a link carries along: where it is, what it went through, and, once it has ended, how.
STATE = "href string, chain array<string>, seen array<string>, method string, http_status int, credentials_removed boolean, elapsed_ms bigint, status string, error string, log array<struct<tag:string,message:string>>"
#: What an answer does to it.
STEP = "kind string, target string, method string, status string, error string, http_status int, credentials_removed boolean, elapsed_ms bigint, visited array<string>, cleaned array<boolean>, asked int, adapter string"
#: Lines of the log of steps.
PASSWORD_REMOVED = "A user name or password in the URL was taken out"
LINES = "array<struct<tag:string,message:string>>"


def started(href: Column) -> Column:
    """The state of a link before its first request."""
    no = lambda kind: F.lit(None).cast(kind)
    fields = [href, F.array(href), F.array().cast("array<string>"), no("string"), no("int"), F.lit(False), F.lit(0).cast("long"), no("string"), no("string"), F.array().cast(LINES)]
    return F.struct(*(f.alias(name.split()[0]) for f, name in zip(fields, STATE.split(", "), strict=True))).cast(f"struct<{typed(STATE)}>")


def typed(schema: str) -> str:
    return ",".join(f.replace(" ", ":", 1) for f in schema.split(", "))


def line(tag: str, *parts) -> Column:
    return F.struct(F.lit(tag).alias("tag"), F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("message"))


def lines_if(condition: Column, *lines: Column) -> Column:
    return F.when(condition, F.array(*lines)).otherwise(F.array().cast(LINES))


def _led(e: Column, target: Column) -> Column:
    """The line of a step that leads on to target, in words that go with its method."""
    method = e["method"]
    return (
        F.when(method == "http", line("REDIRECT", "to ", target)).when(method == "meta-refresh", line("HTML", "a refresh leads to ", target)).when(method == "javascript", line("JAVASCRIPT", "a script goes to ", target))
        .when(method == "adapter", line("REDIRECT", 'adapter "', F.coalesce(e["adapter"], F.lit("")), '" says the page leads to ', target)).otherwise(line("HTML", "the page leads to ", target))
    )


def advanced(s: Column, e: Column, request: Column, max_redirects: int | None, deadline_ms: int, browsed: bool, logged: bool = False) -> Column:
    """The state after one request: s, a state that has not ended, and e, the step that answers it, null where none is captured.

    request names the request; it is a loop if it was made before, which is told before the
    limit (null: there is none).  browsed: whether steps may hold the visit of a browser.  logged: whether the
    state notes what happens, line by line.
    """
    above = lambda chain: F.lit(False) if max_redirects is None else F.size(chain) - 1 > max_redirects
    stopped = F.when(F.array_contains(s["seen"], request), "REDIRECT_LOOP").when(above(s["chain"]), "UNRESOLVED")
    many = F.lit(f"More than {max_redirects} redirects")
    visit = e["visited"].isNotNull() if browsed else F.lit(False)
    whole = F.when(visit, F.concat(s["chain"], e["visited"])).otherwise(s["chain"])
    here = F.when(visit & (F.size(e["visited"]) > 0), F.try_element_at(e["visited"], F.lit(-1))).otherwise(s["href"])
    took = s["elapsed_ms"] + F.coalesce(e["elapsed_ms"], F.lit(0))
    secret = line("SECURITY", PASSWORD_REMOVED)

    def state(href, chain, method, http, removed, ms, status, error, log=None) -> Column:
        fields = [href, chain, F.concat(s["seen"], F.array(request)), method, http, removed, ms, status, error, s["log"] if log is None else F.concat(s["log"], *log)]
        return F.struct(*(f.alias(name.split()[0]) for f, name in zip(fields, STATE.split(", "), strict=True)))

    def ended(status: Column, error: Column) -> Column:
        return state(s["href"], s["chain"], s["method"], s["http_status"], s["credentials_removed"], s["elapsed_ms"], status, error)

    def answered(x: Column) -> Column:
        """x: struct(whole, here, took, visit), with e not null."""
        no = F.lit(None).cast("string")
        leads = F.coalesce(e["kind"] == "follow", F.lit(False))
        lost = leads & e["target"].isNull()
        target = F.when((e["method"] == "http") & ~e["target"].contains("#"), F.concat(e["target"], fragment(x["here"]))).otherwise(e["target"])
        http = F.coalesce(e["http_status"], s["http_status"])
        bare = F.coalesce(e["credentials_removed"], F.lit(False))
        removed = s["credentials_removed"] | bare
        if browsed:
            removed = removed | F.coalesce(F.array_contains(e["cleaned"], True), F.lit(False))
        base = F.when(e["http_status"].isNotNull(), F.coalesce(s["method"], F.lit("http"))).otherwise(s["method"])
        base = F.when(x["visit"], heavier(base, F.lit("browser"))).otherwise(base)
        late = x["took"] > deadline_ms
        keys = F.transform(F.concat(F.array(s["href"]), F.coalesce(e["visited"], F.array().cast("array<string>"))), without_fragment)
        around = F.exists(keys, lambda k: F.size(F.filter(keys, lambda y: y == k)) >= REVISITS)
        too_long = x["visit"] & above(x["whole"])
        met = led = None
        if logged:
            # a browser opens a page that was answered; its own answer is not told
            code = F.coalesce(e["asked"], e["http_status"])
            met = [lines_if(code.isNotNull(), line("HTTP", code.cast("string"), " ", s["href"]))]
            if browsed:
                went = F.flatten(F.transform(F.coalesce(e["visited"], F.array().cast("array<string>")), lambda u, i: F.concat(lines_if(F.coalesce(F.get(e["cleaned"], i), F.lit(False)), secret), F.array(line("BROWSER", "went to ", u)))))
                met.append(F.concat(lines_if(x["visit"], line("BROWSER", "opens ", s["href"])), went))
            met.append(lines_if(leads & bare, secret))
            led = [*met, F.array(_led(e, target))]
        out = F.when(late, state(x["here"], x["whole"], s["method"], s["http_status"], removed, x["took"], F.lit("TIMEOUT"), F.lit(LATE_ERROR)))
        if browsed:
            out = out.when(too_long, state(x["here"], x["whole"], base, http, removed, x["took"], F.when(around, "REDIRECT_LOOP").otherwise("UNRESOLVED"), F.when(around, F.lit(LOOP_ERROR)).otherwise(many), met))
        heavy = F.when(leads, heavier(base, e["method"])).otherwise(base)
        out = out.when(leads & ~lost, state(target, F.concat(x["whole"], F.array(target)), heavy, http, removed, x["took"], no, no, led))
        status = F.when(lost, F.coalesce(e["status"], F.lit("ERROR"))).otherwise(e["status"])
        error = F.when(lost, F.coalesce(e["error"], F.lit("Redirect target is not a valid URL"))).otherwise(e["error"])
        return out.otherwise(state(x["here"], x["whole"], heavy, http, removed, x["took"], status, error, met))

    parts = F.struct(whole.alias("whole"), here.alias("here"), took.alias("took"), visit.alias("visit"))
    return let(stopped, lambda st: (
        F.when(st.isNotNull(), ended(st, F.when(st == "REDIRECT_LOOP", F.lit(LOOP_ERROR)).otherwise(many)))
        .when(e.isNull(), ended(F.lit("ERROR"), F.lit(NOT_CAPTURED))).otherwise(let(parts, answered))
    ))


def steps_by_key(edges: DataFrame) -> DataFrame:
    """(request_key, step) of edges, and their cookie where they have one; columns that edges lack count as null."""
    has = lambda c, kind: (F.col(c) if c in edges.columns else F.lit(None)).cast(kind).alias(c)
    step = F.struct(*(has(*f.split(" ", 1)) for f in STEP.split(", ")))
    return edges.select("request_key", step.alias("step"), *(c for c in ("cookie", "set_cookies") if c in edges.columns))


def walks(steps: DataFrame, doublings: int) -> DataFrame:
    """(request_key, steps, next): from each key the steps up to 2 ** doublings requests on, and the key after them if the walk goes on.

    Each round joins every walk that goes on with the walk from where it stands, which
    doubles both; those that end, at an answer that leads nowhere, at a key without one or
    at a key that they have met before, are left as they are.
    """
    leads = F.col("step.kind") == "follow"
    rows = written(steps.select("request_key", F.array("step").alias("steps"), F.when(leads, without_fragment(F.col("step.target"))).alias("next")), "walks")
    for _ in range(doublings):
        rows = rows.withColumn("next", F.when(F.col("next") != F.col("request_key"), F.col("next")))
        on = rows.where("next is not null")
        if on.isEmpty():
            break
        further = _walked(on, rows)
        rows = written(rows.where("next is null").unionByName(further), "walks")
    return rows


def _walked(rows: DataFrame, walks: DataFrame) -> DataFrame:
    """rows (request_key, steps, next, ...) that go on, with the walks from where they stand."""
    then = walks.select(F.col("request_key").alias("_at"), F.col("steps").alias("_steps"), F.col("next").alias("_next"))
    met = rows.join(then, rows["next"] == then["_at"], "left")
    steps = F.when(F.col("_steps").isNull(), F.col("steps")).otherwise(F.concat("steps", "_steps"))
    # a walk that comes back to a key of its own leads nowhere else
    keys = F.concat(F.array("request_key"), F.transform(steps, lambda s: F.coalesce(without_fragment(s["target"]), F.lit(""))))
    return met.select(*(c for c in rows.columns if c not in ("steps", "next")), steps.alias("steps"), F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.col("_next")).alias("next"))


def resolve_chains(links: DataFrame, edges: DataFrame, max_redirects: int | None = MAX_REDIRECTS, deadline_ms: int = DEADLINE_MS, cookies: bool = False, log: bool = False) -> DataFrame:
    """Follows every link (link_id, href) along edges (request_key, kind, target, method, status, error, http_status, and what else of EDGE there is).

    Returns link_id, final_url, status, method, redirect_count, chain, http_status, error,
    credentials_removed and elapsed_ms.  A target is an absolute href; one of method http takes
    over the fragment of the URL before it unless it has its own.  A key seen before in the
    chain is a loop, which is told before the limit; a key without an edge ends the link as not
    captured; a null target of a follow ends it as an error; the URLs that a browser visited
    join the chain.  Answers that take longer than the deadline together end it as a timeout.

    Without cookies the edges are contracted to walks by doubling, so that chains of any
    length up to the limit take its logarithm in joins (six for 20 redirects); the steps of
    each link are then folded into its result in its own row.  With cookies an answer depends
    on what came before, so there is a join a hop (see hops), and the limit may be null: links
    then go on until they end or come back.  With log there is a column log,
    the lines (tag, message) of what happened to the link after its input.
    """
    if max_redirects is None and not cookies:
        raise ValueError("links without cookies need a limit of redirects")
    steps = steps_by_key(edges)
    if cookies:
        return with_cookies(links, steps, max_redirects, deadline_ms, log)
    browsed = "visited" in edges.columns
    rows = with_steps(links.select("link_id", "href"), F.col("href"), steps, max_redirects)
    key = lambda s: without_fragment(s["href"])
    go = lambda s, e: F.when(s["status"].isNotNull(), s).otherwise(advanced(s, e, key(s), max_redirects, deadline_ms, browsed, log))
    # what has not ended after all steps asks for one that isn't captured
    lost = F.array(F.lit(None).cast(steps.schema["step"].dataType))
    state = F.aggregate(F.concat("steps", lost), started(F.col("href")), go)
    return as_results(rows.select("link_id", state.alias("s")), log)


def with_steps(links: DataFrame, href: Column, steps: DataFrame, max_redirects: int) -> DataFrame:
    """links with the column steps: all that follow from href, up to the limit, to an answer that leads nowhere, a key without one or a key met before."""
    # two walks one after another are all requests up to the limit
    doublings = max(0, (-(-(max_redirects + 1) // 2) - 1).bit_length())
    walk = walks(steps.select("request_key", "step"), doublings)
    none = F.array().cast(walk.schema["steps"].dataType)
    begun = links.select("*", without_fragment(href).alias("next"), F.lit("").alias("request_key")).withColumn("steps", none)
    first = written(_walked(begun, walk), "first")
    rest = _walked(first.where("next is not null"), walk)
    return first.where("next is null").unionByName(rest).drop("next", "request_key")


def walked(active: DataFrame, steps: DataFrame, max_redirects: int, deadline_ms: int) -> tuple[DataFrame, DataFrame]:
    """What hops() gives for links that may wait and send no cookies, by doubling: a handful of joins instead of one a hop.

    steps: (request_key, step, cookie), of which those with a null cookie (refused URLs) go
    before others.  A link goes on from its state s; jars stay as they are.
    """
    own = steps.groupBy("request_key").agg(F.max_by("step", F.col("cookie").isNull()).alias("step"))
    request = lambda s: request_key(without_fragment(s["href"]), F.lit(""))
    rows = with_steps(active, F.col("s.href"), own, max_redirects)
    begun = F.col("s").cast(f"struct<{typed(STATE)}>")
    state = F.aggregate("steps", begun, lambda s, e: F.when(s["status"].isNotNull(), s).otherwise(advanced(s, e, request(s), max_redirects, deadline_ms, False)))
    went = written(rows.withColumn("s", state).drop("steps"), "walked")
    # without a step, only a loop and the limit end a link that may wait
    lost = F.lit(None).cast(own.schema["step"].dataType)
    after = F.when(F.col("s.status").isNotNull(), F.col("s")).otherwise(advanced(F.col("s"), lost, request(F.col("s")), max_redirects, deadline_ms, False))
    told = went.withColumn("after", after)
    stands = F.col("s.status").isNull() & (F.col("after.error") == NOT_CAPTURED)
    done = told.where(~stands).withColumn("s", F.col("after")).drop("after", "jar")
    return done, told.where(stands).drop("after")


def as_results(rows: DataFrame, log: bool = False) -> DataFrame:
    """(link_id, s, ...), s a state that has ended, as results."""
    done = F.col("s.status") == "RESOLVED"
    return rows.select(
        *(c for c in rows.columns if c != "s"), F.when(done, F.col("s.href")).alias("final_url"), F.col("s.status").alias("status"), F.col("s.method").alias("method"), (F.size("s.chain") - 1).alias("redirect_count"), F.col("s.chain").alias("chain"),
        F.col("s.http_status").alias("http_status"), F.when(~done, F.col("s.error")).alias("error"), F.col("s.credentials_removed").alias("credentials_removed"), F.col("s.elapsed_ms").alias("elapsed_ms"),
        *([F.col("s.log").alias("log")] if log else []),
    )


def with_cookies(links: DataFrame, steps: DataFrame, max_redirects: int | None, deadline_ms: int, log: bool = False) -> DataFrame:
    """resolve_chains where links carry a jar of cookies, one join a hop."""
    return as_results(hops(setting_out(links), steps, max_redirects, deadline_ms, logged=log)[0].select("link_id", "s"), log)


def setting_out(links: DataFrame) -> DataFrame:
    """links (link_id, href, ...) with their state s and an empty jar."""
    return links.withColumn("s", started(F.col("href"))).withColumn("jar", F.create_map().cast(JAR))


def hops(active: DataFrame, steps: DataFrame, max_redirects: int | None, deadline_ms: int, waits: bool = False, logged: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Links (link_id, s, jar, ...) that have ended, and, if waits, those whose next answer isn't among the steps, as they stand.

    steps: (request_key, step, cookie, set_cookies).  A request is a URL and the cookies sent
    with it; only an answer to the same is its answer, and one whose cookie is null is that
    whatever was sent (a refused URL).  Set-Cookie lines of an answer go into the jar of its
    origin before the next request.  Links leave the loop when they end; each hop is written.
    Without a limit each link goes on until it ends or makes a request again.
    """
    steps = written(steps.select("request_key", "step", "cookie", F.col("set_cookies").cast(SET_COOKIES).alias("set_cookies")), "steps")
    exact, every = steps.where("cookie is not null").withColumnRenamed("cookie", "_cookie"), steps.where("cookie is null").select(F.col("request_key").alias("_key"), F.col("step").alias("_step"))
    refused = not every.isEmpty()
    more = [c for c in active.columns if c not in ("s", "jar")]
    finished: list[DataFrame] = []
    waiting: list[DataFrame] = []
    for _ in count() if max_redirects is None else range(max_redirects + 2):
        sent = active.withColumn("_sent", F.coalesce(cookie_header(F.col("jar"), origin(F.col("s.href"))), F.lit(""))).withColumn("_url", without_fragment(F.col("s.href")))
        met = sent.join(exact, (F.col("_url") == exact["request_key"]) & (F.col("_sent") == exact["_cookie"]), "left")
        if refused:
            met = met.join(every, F.col("_url") == F.col("_key"), "left").withColumn("step", F.coalesce("_step", "step"))
        state = advanced(F.col("s"), F.col("step"), request_key(F.col("_url"), F.col("_sent")), max_redirects, deadline_ms, True, logged)
        kept = F.coalesce("set_cookies", F.array().cast(SET_COOKIES))
        lacks = F.col("step").isNull() if waits else F.lit(False)
        went = written(met.select(*more, state.alias("s"), F.when(F.size(kept) > 0, stored(F.col("jar"), origin(F.col("_url")), kept)).otherwise(F.col("jar")).alias("jar"), F.when(lacks, F.col("s")).alias("stood")), "hop")
        # without a step, only a loop and the limit end a link that may wait
        stands = F.col("stood").isNotNull() & (F.col("s.error") == NOT_CAPTURED)
        finished.append(went.where((F.col("s.status").isNotNull()) & ~stands).drop("jar", "stood"))
        if waits:
            waiting.append(went.where(stands).select(*more, F.col("stood").alias("s"), "jar"))
        active = went.where("s.status is null").drop("stood")
        if active.isEmpty():
            break
    return reduce(DataFrame.unionByName, finished), reduce(DataFrame.unionByName, waiting) if waits else None


def inputs(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of raw links (link_id, raw_url, ...) those that can be followed, with href and own_removed, and the results of the others."""
    parsed = written(with_input(links, "raw_url", "p"), "input")
    good = parsed.where("p.ok").select(*(c for c in links.columns if c != "raw_url"), F.col("p.href").alias("href"), F.col("p.credentials_removed").alias("own_removed"))
    none = lambda c: F.lit(None).cast(dict(f.split(" ", 1) for f in RESULT.split(", "))[c]).alias(c)
    bad = parsed.where("not p.ok").select(
        "link_id", F.col("p.safe_input").alias("original_url"), none("final_url"), F.col("p.status").alias("status"), none("method"), F.lit(0).alias("redirect_count"), F.array().cast("array<string>").alias("chain"), none("http_status"),
        F.struct(F.lit(0).cast("long").alias("elapsed_ms")).alias("timing"), F.struct(F.col("p.credentials_removed").alias("credentials_removed")).alias("security"), none("tracking"), F.col("p.error").alias("error"),
    )
    return good, bad


def records(found: DataFrame) -> DataFrame:
    """Result records (link_id and the columns of RESULT) of resolved chains with href and own_removed."""
    report = F.when(F.col("status") == "RESOLVED", tracking_report(F.col("final_url")))
    return found.select(
        "link_id", F.col("href").alias("original_url"), "final_url", "status", "method", "redirect_count", "chain", "http_status", F.struct("elapsed_ms").alias("timing"),
        F.struct((F.col("credentials_removed") | F.col("own_removed")).alias("credentials_removed")).alias("security"), report.alias("tracking"), "error",
        *(c for c in ("log", "own_removed") if "log" in found.columns),
    )


def resolve_links(links: DataFrame, responses: DataFrame, dns: DataFrame | None = None, rules: DataFrame | None = None, rendered: DataFrame | None = None, max_redirects: int = MAX_REDIRECTS, deadline_ms: int = DEADLINE_MS, cookies: bool = False, suffixes: list[str] | None = None, blocks: DataFrame | None = None, adapters: Sequence[Adapter] = (), log: bool = False) -> DataFrame:
    """The whole way from raw links (link_id, raw_url) to result records: link_id and the columns of RESULT.

    Input is parsed (a bad one ends as INVALID_URL with an empty chain), every captured answer
    is judged once with its page and the adapter rules, refused URLs are blocked before their
    answer is read, visits of a browser are taken in where the static readers settle nothing,
    and chains are followed.  Input that bears user information, and targets that do, lose it.
    Without cookies only answers to requests that sent none are read; with them links carry
    jars, and an answer counts for requests that send the same cookies.  suffixes and blocks
    (cidr) replace the address policy's own.  With log there are columns log and own_removed,
    which steps_log reads.
    """
    good, bad = inputs(links.select("link_id", "raw_url"))
    edges = edges_of(responses, rules, cookies, adapters)
    if rendered is not None:
        edges = rendered_edges(edges, rendered)
    edges = checked_edges(written(edges, "judged"), dns, good, suffixes, blocks)
    return records(resolve_chains(good, edges, max_redirects, deadline_ms, cookies, log).join(good, "link_id")).unionByName(bad, allowMissingColumns=True)


def steps_of(results: DataFrame) -> DataFrame:
    """(link_id, hop, url) of chains, hop from 0."""
    return results.select("link_id", F.posexplode("chain").alias("hop", "url"))


def frontier(active: DataFrame, responses: DataFrame) -> DataFrame:
    """Request keys of active links (href) without a captured answer, each once: what a crawler fetches next."""
    keys = active.select(without_fragment(F.col("href")).alias("request_key")).where("request_key is not null")
    return keys.join(responses.select(without_fragment(F.col("request_url")).alias("request_key")), "request_key", "left_anti").distinct()


def known(active: DataFrame, responses: DataFrame) -> DataFrame:
    """Request keys of active links that have an answer, each once."""
    keys = active.select(without_fragment(F.col("href")).alias("request_key"))
    return keys.join(responses.select(without_fragment(F.col("request_url")).alias("request_key")), "request_key", "left_semi").distinct()


def build_chains(steps: DataFrame) -> DataFrame:
    """(link_id, chain, redirect_count) from steps (link_id, hop, url); a chain has at most a few dozen URLs."""
    grouped = steps.groupBy("link_id").agg(F.array_sort(F.collect_list(F.struct("hop", "url"))).alias("s"))
    return grouped.select("link_id", F.transform("s", lambda x: x["url"]).alias("chain"), F.greatest(F.size("s") - 1, F.lit(0)).alias("redirect_count"))


def credentials_any(steps: DataFrame) -> DataFrame:
    return steps.groupBy("link_id").agg(F.bool_or("credentials_removed").alias("credentials_removed"))


def heaviest_method(steps: DataFrame) -> DataFrame:
    """The heaviest method of each link; null where no step has one."""
    return steps.groupBy("link_id").agg(F.max_by("method", method_weight(F.col("method"))).alias("method"))


def first_loop_hop(steps: DataFrame) -> DataFrame:
    """(link_id, loop_hop): the first hop whose request key came before in the same link."""
    nth = F.row_number().over(Window.partitionBy("link_id", "request_key").orderBy("hop"))
    rows = steps.withColumn("request_key", request_key(F.col("url"))).withColumn("nth", nth)
    return rows.where("nth = 2").groupBy("link_id").agg(F.min("hop").alias("loop_hop"))


def revisit_loops(navigation: DataFrame, times: int = 3) -> DataFrame:
    """(link_id, is_loop): a URL, fragment aside, that a rendered chain shows at least `times` times."""
    counts = navigation.groupBy("link_id", without_fragment(F.col("url")).alias("k")).count()
    return counts.groupBy("link_id").agg((F.max("count") >= times).alias("is_loop"))


def url_dedup(urls: DataFrame, url_col: str = "href") -> DataFrame:
    """Distinct URLs, fragment aside."""
    return urls.select(without_fragment(urls[url_col]).alias("request_key")).where("request_key is not null").distinct()
