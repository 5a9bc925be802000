"""Crawl planning and crawl-log analytics over tables of sitemaps, robots bodies and fetches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from .ranking import number_rows

# --- sitemaps -----------------------------------------------------------------------



def _decoded(c: Column) -> Column:
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def _blocks(sitemaps: DataFrame, tag: str) -> DataFrame:
    # Bodies cost far more to search than to move, and the file they come from may be one task's: they are dealt to all.
    sitemaps = sitemaps.repartition(int(sitemaps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = F.regexp_extract_all("body", F.lit(rf"<{tag}>([\s\S]*?)</{tag}>"), F.lit(1))
    rest = [c for c in sitemaps.columns if c != "body"]
    return sitemaps.select(*rest, F.posexplode(found).alias("entry", "block")).withColumn(
        "url", _decoded(F.nullif(F.regexp_extract("block", P.SITEMAP_LOCATION, 1), F.lit("")))
    )


def sitemap_entries(sitemaps: DataFrame) -> DataFrame:
    """(host, pos, body) to one row per listed url with its place and `lastmod`; blocks without a location are skipped."""
    stamp = F.nullif(F.regexp_extract("block", P.SITEMAP_CHANGED, 1), F.lit(""))
    return _blocks(sitemaps, "url").where(F.col("url").isNotNull()).withColumn("lastmod", T.instant(stamp)).drop("block")


def child_sitemaps(sitemaps: DataFrame) -> DataFrame:
    return _blocks(sitemaps, "sitemap").where(F.col("url").isNotNull()).drop("block")


def product_entries(entries: DataFrame, children: DataFrame | None = None) -> DataFrame:
    """Product pages of a sitemap and of its child sitemaps, the first occurrence of each url."""
    if children is not None:
        entries = entries.withColumn("level", F.lit(0)).unionByName(children.withColumn("level", F.lit(1)))
    else:
        entries = entries.withColumn("level", F.lit(0))
    place = F.struct("level", "pos", "entry")
    return (
        entries.where(F.startswith(T.url_path(F.col("url")), F.lit("/product/")))
        .groupBy("url")
        .agg(F.min_by(F.struct("host", "pos", "entry", "lastmod"), place).alias("_first"))
        .select("url", "_first.*")
    )


def crawl_order(entries: DataFrame, fetched: DataFrame, limit: int | None = 25, known_only: bool = False) -> DataFrame:
    """Entries never fetched first, then the stalest, ties in sitemap order. `fetched`: url, fetched_at."""
    last = fetched.groupBy("url").agg(F.max("fetched_at").alias("last_fetched"), F.lit(True).alias("known"))
    pool = entries.join(last, "url", "inner" if known_only else "left").drop("known")
    ranked = pool.orderBy(F.asc_nulls_first("last_fetched"), "pos", "entry")
    return ranked if limit is None or known_only else ranked.limit(limit)


# --- robots ---------------------------------------------------------------------------


def newest_robots(robots: DataFrame) -> DataFrame:
    """One fetch per host: the newest by `fetched_at`, at equal times the one that sorts last. Hosts are compared in lower case."""
    host = F.lower("host").alias("host")
    return robots.groupBy(host).agg(F.max_by(F.struct("http_status", "body"), F.struct("fetched_at", "http_status", "body")).alias("_last")).select("host", "_last.*")


def robots_lines(robots: DataFrame) -> DataFrame:
    """Directives of each host's body (one per host, as `newest_robots` gives): host, line, group (0 before any agent line), key, value. Consecutive agent lines share a group."""
    lines = robots.select("host", F.posexplode(F.split("body", "\r?\n")).alias("line", "text"))
    text = T.clean(F.regexp_replace("text", "#.*", ""))
    split = (
        lines.withColumn("text", text)
        .where(F.contains("text", F.lit(":")))
        .select("host", "line", F.trim(F.lower(F.split_part("text", F.lit(":"), F.lit(1)))).alias("key"), F.trim(F.regexp_replace("text", "^[^:]*:", "")).alias("value"))
    )
    # A window holds the lines of one body: `robots` has one row per host.
    w = Window.partitionBy("host").orderBy("line")
    agent = F.col("key") == "user-agent"
    starts = agent & ~F.coalesce(F.lag(agent).over(w), F.lit(False))
    return split.withColumn("starts", starts.cast("int")).withColumn("group", F.sum("starts").over(w)).drop("starts")


def robots_rules(robots: DataFrame) -> DataFrame:
    """One row per (host, group): agents, allow and disallow patterns in order, crawl delay in seconds."""
    delay = F.when(F.col("key") == "crawl-delay", T.number(F.col("value")))
    is_rule = F.col("key").isin("allow", "disallow") & (F.col("value") != "")
    in_order = lambda c: F.array_sort(F.collect_list(c))
    return (
        robots_lines(robots)
        .where(F.col("group") > 0)
        .groupBy("host", "group")
        .agg(
            in_order(F.when(F.col("key") == "user-agent", F.struct("line", F.lower("value").alias("agent")))).alias("agents"),
            in_order(F.when(is_rule, F.struct("line", (F.col("key") == "allow").alias("allow"), F.col("value").alias("pattern")))).alias("rules"),
            F.max_by(delay, F.when(delay > 0, F.col("line"))).alias("delay"),
        )
        .select(
            "host",
            "group",
            F.transform("agents", lambda a: a["agent"]).alias("agents"),
            F.transform("rules", lambda r: F.struct(r["allow"], r["pattern"])).alias("rules"),
            "delay",
        )
    )


def product_token(user_agent: str) -> str:
    return user_agent.replace("/", " ").split()[0].lower()


def rules_for(robots: DataFrame, user_agent: str) -> DataFrame:
    """The group each host applies to us: the first that names our token, else the first for all."""
    token = product_token(user_agent)
    named = F.exists("agents", lambda a: (a != "*") & (a != "") & F.contains(F.lit(token), a))
    anyone = F.array_contains("agents", "*")
    preference = F.when(named, F.struct(F.lit(0), F.col("group"))).when(anyone, F.struct(F.lit(1), F.col("group")))
    chosen = robots_rules(robots).groupBy("host").agg(F.min_by(F.struct("rules", "delay"), preference).alias("_chosen"))
    return chosen.select("host", "_chosen.rules", "_chosen.delay")


def _fits(path: Column, pattern: Column) -> Column:
    """Whether a robots pattern fits: `*` is any text, a final `$` ends the path, all else is a literal prefix. Patterns
    without either, nearly all, are plain prefix tests."""
    body = F.regexp_replace(F.regexp_replace(pattern, r"\$\z", ""), r"([%_\\])", r"\\$1")
    open_end = F.when(pattern.endswith("$"), F.lit("")).otherwise(F.lit("%"))
    like = F.like(path, F.concat(F.replace(body, F.lit("*"), F.lit("%")), open_end))
    plain = ~F.contains(pattern, F.lit("*")) & ~pattern.endswith("$")
    return F.when(plain, F.startswith(path, pattern)).otherwise(like)


def admit(urls: DataFrame, robots: DataFrame, user_agent: str) -> DataFrame:
    """Urls with `allowed` and `delay`, each row once. The longest matching pattern decides, allow wins ties.

    `robots`: host, http_status, body, fetched_at; the newest fetch of a host counts. One answered 4xx allows
    everything; 5xx, or no answer, allows nothing.

    Patterns without wildcards are rows that a path meets by equality with its own beginnings, of which it has one for
    each length that occurs among its host's patterns: what a path costs doesn't grow with the number of rules. The
    others, few on any host, travel with the host and are tried one by one. Each (host, path) is judged once.
    """
    newest = newest_robots(robots)
    chosen = rules_for(newest.where("http_status between 200 and 299"), user_agent)
    is_plain = lambda r: ~F.contains(r["pattern"], F.lit("*")) & ~F.endswith(r["pattern"], F.lit("$"))
    lengths = F.array_distinct(F.transform(F.filter("rules", is_plain), lambda r: F.length(r["pattern"])))
    hosts = newest.select("host", "http_status").join(chosen.select("host", "delay", lengths.alias("lengths"), F.filter("rules", lambda r: ~is_plain(r)).alias("wild")), "host", "left")
    plain = chosen.select("host", F.explode(F.filter("rules", is_plain)).alias("r")).groupBy("host", F.col("r.pattern").alias("prefix")).agg(F.max("r.allow").alias("allow"))

    keyed = urls.withColumn("_host", F.coalesce(T.url_host(F.col("url")), F.lit(""))).withColumn("_path", F.coalesce(T.url_path_and_query(F.col("url")), F.lit("")))
    paths = keyed.select(F.col("_host").alias("host"), F.col("_path").alias("path")).distinct().join(hosts, "host")
    rank = lambda pattern, allow: F.struct(F.length(pattern).alias("length"), allow.alias("allow")).cast("struct<length:int,allow:boolean>")
    tried = F.array_max(F.transform(F.filter("wild", lambda r: _fits(F.col("path"), r["pattern"])), lambda r: rank(r["pattern"], r["allow"])))
    beginnings = F.explode_outer(F.filter("lengths", lambda n: n <= F.length("path")))
    met = paths.select("host", "path", "http_status", "delay", tried.alias("tried"), beginnings.alias("n")).withColumn("prefix", F.substring("path", F.lit(1), F.col("n")))
    met = met.join(plain, ["host", "prefix"], "left")
    found = F.max(F.when(F.col("allow").isNotNull(), rank(F.col("prefix"), F.col("allow"))))
    judged = met.groupBy("host", "path").agg(F.first("http_status").alias("http_status"), F.first("delay").alias("delay"), F.greatest(F.first("tried"), found).alias("decisive"))
    allowed = (
        F.when(F.col("http_status").between(400, 499), F.lit(True))
        .when(F.col("http_status").between(200, 299), F.coalesce(F.col("decisive.allow"), F.lit(True)))
        .otherwise(F.lit(False))
    )
    verdicts = judged.select(F.col("host").alias("_host"), F.col("path").alias("_path"), allowed.alias("_allowed"), F.col("delay").alias("_delay"))
    joined = keyed.join(verdicts, ["_host", "_path"], "left")
    host = [] if "host" in urls.columns else [F.nullif("_host", F.lit("")).alias("host")]
    return joined.select(*urls.columns, *host, F.coalesce("_allowed", F.lit(False)).alias("allowed"), F.col("_delay").alias("delay"))


# --- crawl log -------------------------------------------------------------------------


def fetch_status(http_status: Column) -> Column:
    """Outcome of a fetch; no status at all means the host was not reached."""
    return (
        F.when(http_status.between(200, 299), "ok")
        .when(http_status.isin(404, 410), "not_found")
        .when(http_status.isin(401, 403, 429), "blocked")
        .otherwise("error")
    )


def with_stop(log: DataFrame, per: str) -> DataFrame:
    """Log rows with `skipped`: true after the first refusal of the same run or host.

    The first refusal per key is found by a pre-aggregation and joined back, so no key is ordered in one task.
    """
    first = log.where(fetch_status(F.col("http_status")) == "blocked").groupBy(per).agg(F.min("seq").alias("refused_at"))
    return log.join(first, per, "left").select(*log.columns, F.coalesce(F.col("seq") > F.col("refused_at"), F.lit(False)).alias("skipped"))


def run_summary(log: DataFrame) -> DataFrame:
    """Per run: planned, fetched and failed up to the first refusal, start and finish."""
    tried = with_stop(log, "run_id").withColumn("status", fetch_status(F.col("http_status")))
    done = ~F.col("skipped")
    return tried.groupBy("run_id").agg(
        F.min("fetched_at").alias("started_at"),
        F.max(F.when(done, F.col("fetched_at"))).alias("finished_at"),
        F.count("*").alias("urls_planned"),
        F.count_if(done & (F.col("status") == "ok")).alias("pages_fetched"),
        F.count_if(done & (F.col("status") != "ok")).alias("pages_failed"),
    )


def probe_outcome(status: Column, has_product: Column, challenge: Column) -> Column:
    """A page fetched well that holds a bot challenge and no product counts as a challenge."""
    return F.when((status == "ok") & challenge & ~has_product, "challenge").otherwise(status)


def host_probe_summary(log: DataFrame) -> DataFrame:
    """Per host of a log with `has_product` and `challenge` flags: attempts until its first refusal, how many carried product markup, and a count per outcome."""
    outcome = probe_outcome(fetch_status(F.col("http_status")), F.col("has_product"), F.col("challenge"))
    tried = with_stop(log, "host").where(~F.col("skipped")).withColumn("outcome", outcome)
    usable = F.count_if((F.col("outcome") == "ok") & F.col("has_product"))
    attempted = F.count("*")
    outcomes = {f"n_{s}": F.count_if(F.col("outcome") == s) for s in ("ok", "challenge", "not_found", "blocked", "error")}
    return tried.groupBy("host").agg(
        attempted.alias("attempted"),
        usable.alias("with_product"),
        F.round(F.try_divide(usable, attempted) * 100).cast("int").alias("product_percent"),
        *[c.alias(n) for n, c in outcomes.items()],
        (F.count_if(F.col("outcome") == "blocked") > 0).alias("stopped"),
    )


def spacing_plan(requests: DataFrame, own_gap: float = 2.0, piece: int = 65536) -> DataFrame:
    """Requests (host, seq, delay) with the second, counted from the start, at which each may be sent to its host."""
    numbered = number_rows(requests, ["host"], [F.floor(F.col("seq") / piece)], [F.col("seq")], "turn")
    gap = F.greatest(F.lit(own_gap), F.coalesce(F.col("delay").cast("double"), F.lit(0.0)))
    return numbered.withColumn("planned_offset", (F.col("turn") - 1) * gap).drop("turn")
