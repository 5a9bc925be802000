import pytest
from pyspark.sql import functions as F

from shelfcheck.operators import crawl
from shelfcheck.sources import files

AGENT = "ReederBot/2.3 (+https://reeder.example)"
# host: fetches as (day, status, body)
FETCHES = {
    "open.example": [(1, 200, "")],
    "rules.example": [(2, 200, "# our rules\nUSER-AGENT : *\nDisallow: /lists\nAllow: /lists/new\nDisallow: /*/draft\nDisallow: /*.pdf$\nDisallow: /50%_\nCrawl-Delay: 1.5\nnonsense")],
    "ours.example": [(1, 200, "User-agent: *\nDisallow: /\nUser-agent: reeder\nUser-agent: other\nDisallow: /no\nCrawl-delay: zero")],
    "late.example": [(1, 200, "User-agent: *\nDisallow: /"), (3, 200, "User-agent: *\nDisallow: /b"), (2, 500, None)],
    "worse.example": [(1, 200, "User-agent: *\nAllow: /"), (2, 502, None)],
    "absent.example": [(1, 410, None)],
    "mute.example": [(1, None, None)],
    "even.example": [(1, 200, "Disallow: /early\nUser-agent: *\nAllow: /a/b\nDisallow: /a/b\nDisallow: /a")],
}


@pytest.fixture(scope="module")
def robots(spark):
    rows = [(h, s, b, day) for h, fetches in FETCHES.items() for day, s, b in fetches]
    return spark.createDataFrame(rows, "host string, http_status int, body string, day int").selectExpr("host", "http_status", "body", "make_timestamp(2025, 3, day, 0, 0, 0) AS fetched_at").repartition(3)


ADMITTED = {
    "https://open.example/any/thing": True,
    "https://rules.example/": True, "https://rules.example/lists": False, "https://rules.example/listsandmore": False, "https://rules.example/lists/newest": True,
    "https://rules.example/a/draft?x": False, "https://rules.example/draft": True, "https://rules.example/a.pdf": False, "https://rules.example/a.pdf?v=2": True,
    "https://rules.example/50%25_": True, "https://rules.example/50%_x": False, "https://rules.example/50abc": True, "https://RULES.example/lists": False,
    "https://ours.example/yes": True, "https://ours.example/north": False,
    "https://late.example/a": True, "https://late.example/b": False,
    "https://worse.example/": False, "https://absent.example/": True, "https://mute.example/": False, "https://unlisted.example/": False,
    "https://even.example/a/b": True, "https://even.example/a": False, "https://even.example/early": True,
}


def test_admission(spark, robots):
    urls = spark.createDataFrame([(u,) for u in ADMITTED] * 2, "url string")
    rows = crawl.admit(urls, robots, AGENT).collect()
    # Each row comes out once, however many fetches its host has.
    assert len(rows) == 2 * len(ADMITTED) and {r["url"]: r["allowed"] for r in rows} == ADMITTED
    delays = {r["host"]: r["delay"] for r in rows}
    assert delays["rules.example"] == 1.5 and delays["ours.example"] is None and delays["late.example"] is None


def test_groups_of_the_newest_body(robots):
    rules = crawl.robots_rules(crawl.newest_robots(robots)).collect()
    groups = {(r["host"], r["group"]): r for r in rules}
    assert groups["ours.example", 2]["agents"] == ["reeder", "other"] and [(x["allow"], x["pattern"]) for x in groups["ours.example", 2]["rules"]] == [(False, "/no")]
    assert [x["pattern"] for x in groups["rules.example", 1]["rules"]] == ["/lists", "/lists/new", "/*/draft", "/*.pdf$", "/50%_"]
    assert [x["pattern"] for x in groups["late.example", 1]["rules"]] == ["/b"]
    assert [x["pattern"] for x in groups["even.example", 1]["rules"]] == ["/a/b", "/a/b", "/a"]


MAPS = "host string, pos int, body string"


def test_sitemap_entries(spark):
    body = (
        "<urlset>\n<url>\n<loc>https://m.example/product/1?k=&lt;a&gt;&amp;amp;</loc><lastmod>2024-12-31</lastmod></url>"
        "<url><lastmod>2024-01-01T00:00:00-05:00</lastmod><loc>https://m.example/help</loc></url><url><loc></loc></url><url><changefreq>daily</changefreq></url>"
        "<url><loc>https://m.example/product/2</loc><lastmod>yesterday</lastmod></url></urlset>"
    )
    rows = crawl.sitemap_entries(spark.createDataFrame([("m.example", 4, body)], MAPS)).withColumn("lastmod", F.col("lastmod").cast("string")).orderBy("entry").collect()
    assert [(r["pos"], r["url"], r["lastmod"]) for r in rows] == [
        (4, "https://m.example/product/1?k=<a>&amp;", "2024-12-31 00:00:00"), (4, "https://m.example/help", "2024-01-01 05:00:00"), (4, "https://m.example/product/2", None),
    ]


def test_child_sitemaps_come_after_the_root(spark):
    url = lambda u, day: f"<url><loc>https://m.example/product/{u}</loc><lastmod>2024-02-{day:02}</lastmod></url>"
    root = spark.createDataFrame([("m.example", 0, "<sitemap><loc>https://m.example/more.xml</loc></sitemap><sitemap><x/></sitemap>" + url("b", 1) + url("a", 2) + url("b", 3))], MAPS)
    child = spark.createDataFrame([("m.example", 0, url("c", 4) + url("a", 5)), ("m.example", 1, url("c", 6) + "<url><loc>https://m.example/other/d</loc></url>")], MAPS)
    assert [r["url"] for r in crawl.child_sitemaps(root).collect()] == ["https://m.example/more.xml"]
    kept = {r["url"].rsplit("/", 1)[1]: r["lastmod"].day for r in crawl.product_entries(crawl.sitemap_entries(root), crawl.sitemap_entries(child)).collect()}
    assert kept == {"a": 2, "b": 1, "c": 4}


def test_crawl_order(spark):
    entries = spark.createDataFrame([("u1", 0, 0), ("u2", 1, 0), ("u3", 2, 0), ("u4", 3, 0)], "url string, pos int, entry int")
    fetched = spark.sql("SELECT * FROM VALUES ('u1', TIMESTAMP '2026-02-01 00:00:00'), ('u1', TIMESTAMP '2026-01-01 00:00:00'), ('u3', TIMESTAMP '2026-01-15 00:00:00') AS f(url, fetched_at)")
    assert [r["url"] for r in crawl.crawl_order(entries, fetched).collect()] == ["u2", "u4", "u3", "u1"]
    assert [r["url"] for r in crawl.crawl_order(entries, fetched, limit=1, known_only=True).collect()] == ["u3", "u1"]


def test_log(spark):
    log = spark.sql("""SELECT run_id, host, seq, http_status, has_product, challenge, TIMESTAMP '2026-01-01 00:00:00' + seq * INTERVAL '1' MINUTE AS fetched_at FROM VALUES
      ('r', 'h', 1, 200, true, true), ('r', 'h', 2, 404, false, false), ('r', 'g', 3, 200, false, true), ('r', 'h', 4, 403, false, false), ('r', 'h', 5, 200, true, false), ('r', 'g', 6, 500, false, false),
      ('q', 'h', 7, 429, false, false), ('q', 'g', 8, CAST(NULL AS INT), false, false) AS l(run_id, host, seq, http_status, has_product, challenge)""")
    runs = {r["run_id"]: r for r in crawl.run_summary(log).collect()}
    assert (runs["r"]["urls_planned"], runs["r"]["pages_fetched"], runs["r"]["pages_failed"]) == (6, 2, 2)
    assert (runs["q"]["urls_planned"], runs["q"]["pages_fetched"], runs["q"]["pages_failed"]) == (2, 0, 1)
    hosts = {r["host"]: r for r in crawl.host_probe_summary(log).collect()}
    assert (hosts["h"]["attempted"], hosts["h"]["with_product"], hosts["h"]["product_percent"], hosts["h"]["stopped"]) == (3, 1, 33, True)
    assert (hosts["g"]["attempted"], hosts["g"]["n_error"], hosts["g"]["n_challenge"], hosts["g"]["stopped"]) == (3, 2, 1, False)
    assert crawl.product_token(AGENT) == "reederbot"


def test_many_rules_and_plain_model(spark):
    """Against a rule-by-rule model, on a host of 20,000 plain rules and one of mixed patterns."""
    import random
    import re

    rng = random.Random(5)
    piece = lambda: rng.choice(["/a", "/b", "/ab", "/%", "/_", "?x", "/e"])
    mixed = [(rng.random() < 0.5, "".join(piece() for _ in range(rng.randint(1, 3))) + rng.choice(["", "", "*", "$", "*b", "*a$"])) for _ in range(80)]
    many = [(i % 3 == 0, f"/p{i}/") for i in range(20_000)]
    body = lambda rules: "User-agent: *\n" + "\n".join(("Allow: " if allow else "Disallow: ") + p for allow, p in rules)
    robots = spark.createDataFrame([("m.example", 200, body(mixed)), ("n.example", 200, body(many)), ("e.example", 200, ""), ("x.example", 404, None), ("y.example", 500, None)], "host string, http_status int, body string")
    robots = robots.selectExpr("*", "TIMESTAMP '2026-01-01 00:00:00' AS fetched_at")
    paths = ["".join(piece() for _ in range(rng.randint(1, 4))) for _ in range(300)]
    asked = [("m.example", p) for p in paths if p.startswith("/")] + [("n.example", f"/p{rng.randrange(21_000)}/{rng.choice('xy')}") for _ in range(300)]
    asked += [("e.example", "/a"), ("x.example", "/a"), ("y.example", "/a"), ("none.example", "/a")]

    def model(host, path):
        if host in ("e.example", "x.example"):
            return True
        if host in ("y.example", "none.example"):
            return False
        if host == "n.example":
            return next((allow for allow, p in many if path.startswith(p)), True)
        best = (-1, True)
        for allow, p in mixed:
            end = p.endswith("$")
            if re.match(".*".join(map(re.escape, (p[:-1] if end else p).split("*"))) + (r"\Z" if end else ""), path, re.S):
                best = max(best, (len(p), allow))
        return best[1]

    urls = spark.createDataFrame([(i, f"https://{h}{p}", "kept") for i, (h, p) in enumerate(asked)] + [(9000, None, "kept"), (9001, None, "kept")], "id int, url string, _allowed2 string")
    got = {r["id"]: r["allowed"] for r in crawl.admit(urls, robots, AGENT).collect()}
    assert got == {i: model(h, p) for i, (h, p) in enumerate(asked)} | {9000: False, 9001: False}


def test_sitemap_files_give_the_rows_of_their_bodies(spark, tmp_path):
    blocks = [f"<url><loc>https://s.example/product/{i}?a=1&amp;b=2</loc><lastmod>{'2026-01-02' if i % 3 else 'soon'}</lastmod></url>" for i in range(300)]
    blocks += ["<url><lastmod>2026-01-02</lastmod></url>", "<url>\n <loc>\n https://s.example/last </loc></url>"]
    body = '<?xml version="1.0"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' + "\n".join(blocks) + "</urlset>"
    (tmp_path / "a.xml").write_text(body)
    (tmp_path / "b.xml").write_text("<urlset><url><loc>https://s.example/x</lock></url><url><loc>https://s.example/y</loc></url></urlset>")
    (tmp_path / "c.xml").write_text("<sitemapindex><sitemap><loc>https://s.example/b.xml</loc></sitemap></sitemapindex>")
    read = files.read_sitemaps(spark, str(tmp_path))
    table = spark.createDataFrame([("s.example", 0, body)], "host string, pos int, body string")
    want = [(r.url.strip(), r.lastmod) for r in crawl.sitemap_entries(table).orderBy("entry").collect()]
    rows = read.orderBy("file", "entry").collect()
    assert [(r.url, r.lastmod) for r in rows if r.file.endswith("a.xml") and r.url] == want and len(want) == 301
    other = [r for r in rows if r.file.endswith("b.xml")]
    assert [r.url for r in other if r.url] == ["https://s.example/y"] and sum(r.unread is not None for r in other) == 1
    assert [r.url for r in files.read_sitemaps(spark, str(tmp_path), "sitemap").where(F.col("url").isNotNull()).collect()] == ["https://s.example/b.xml"]


def test_sitemaps_of_one_task_are_dealt_out(spark):
    """Bodies from one partition are searched by all tasks, and no entry is lost."""
    body = lambda i: f"<urlset><url><loc>https://a.example/product/{i}</loc></url><sitemap><loc>https://a.example/s{i}.xml</loc></sitemap></urlset>"
    maps = spark.createDataFrame([("a.example", i, body(i)) for i in range(64)], "host string, pos int, body string").coalesce(1)
    for read, url in ((crawl.sitemap_entries, "https://a.example/product/{}"), (crawl.child_sitemaps, "https://a.example/s{}.xml")):
        found = read(maps)
        assert sorted(r.url for r in found.collect()) == sorted(url.format(i) for i in range(64))
        assert found.select(F.spark_partition_id()).distinct().count() > 1
