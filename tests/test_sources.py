import json

from newsloom.sources import feeds, sinks
from newsloom.streaming import incremental

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>
<item><title>One</title><link>/a</link><pubDate>Thu, 03 Jul 2025 05:06:50 +0530</pubDate></item>
<item><title>Two</title><guid>https://x.example/b</guid><dc:date>2025-01-01</dc:date></item><item><title>None</title></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link rel="self" href="https://x.example/self"/><link rel="alternate" href="https://x.example/a"/><updated>2025-02-02</updated></entry></feed>"""
MAP = """<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:news="http://www.google.com/schemas/sitemap-news/0.9"><url><loc>https://x.example/p</loc><lastmod>2025-01-01</lastmod>
<news:news><news:publication_date>2025-03-03</news:publication_date><news:title>T</news:title></news:news></url></urlset>"""
INDEX = """<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>https://x.example/1.xml</loc></sitemap><sitemap><loc>https://y.example/2.xml</loc></sitemap></sitemapindex>"""
POSTS = json.dumps([{"link": "https://x.example/1", "date": "2025-01-01T00:00:00", "title": {"rendered": "T"}}, {"link": None}, {"link": "https://x.example/2", "modified": "2025-01-02"}])
SECTION = "<a href='/story/1#c'>One <b>two</b></a><a href='https://other.example/x'>no</a><a href='/i.png'>no</a><a href='/story/1'>again</a><a href='https://sub.x.example/y'></a>"


def test_readers():
    base = "https://x.example/feed"
    assert list(feeds.rss(RSS, base)) == [("https://x.example/a", "Thu, 03 Jul 2025 05:06:50 +0530", "One", None), ("https://x.example/b", "2025-01-01", "Two", None)]
    assert list(feeds.atom(ATOM, base)) == [("https://x.example/a", "2025-02-02", "A", None)]
    assert list(feeds.sitemap(MAP, base)) == [("https://x.example/p", "2025-03-03", "T", None)]
    assert [e[0] for e in feeds.sitemap(INDEX, base)] == ["https://x.example/1.xml"]
    assert list(feeds.wordpress(POSTS, base)) == [("https://x.example/1", "2025-01-01T00:00:00", "T", None), ("https://x.example/2", "2025-01-02", None, None)]
    assert [(e[0], e[2]) for e in feeds.section(SECTION, base)] == [("https://x.example/story/1", "One two"), ("https://sub.x.example/y", None)]
    for read in (feeds.rss, feeds.atom, feeds.sitemap, feeds.wordpress):
        assert list(read("<broken", base)) == []


def test_entries(spark):
    df = spark.createDataFrame([(1, RSS, "https://x.example/"), (2, None, None), (3, "", None)], "id int, doc string, url string")
    out = feeds.entries(df, "rss", "doc", "url", ["id"])
    assert [(r.id, r.position, r.url) for r in out.orderBy("position").collect()] == [(1, 0, "https://x.example/a"), (1, 1, "https://x.example/b")]


def test_merges(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, "x")], "k string, n int, v string")
    new = spark.createDataFrame([("a", 9, "y"), ("b", 3, "z"), ("b", 2, "w"), (None, 1, "q")], "k string, n int, v string")
    assert sorted(map(tuple, sinks.insert_ignore(old, new, "k", ["n"]).collect())) == [("a", 1, "x"), ("b", 2, "w")]
    merged = sinks.upsert(old, spark.createDataFrame([("a", None, "y"), ("c", 5, None)], "k string, n int, v string"), "k")
    assert sorted(map(tuple, merged.collect()), key=repr) == [("a", 1, "y"), ("c", 5, None)]
    folder = f"file://{tmp_path}/t"
    assert sinks.latest_snapshot(spark, folder) is None
    for n in (1, 2, 2):
        sinks.write_snapshot(old, folder, n)
    assert sinks.latest_snapshot(spark, folder).count() == 1


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    kind = "k string, n int, at timestamp"
    rows = spark.createDataFrame([("a", 1, "2025-01-01 00:00:00"), ("a", 2, "2025-01-01 01:00:00"), ("b", 1, "2025-01-02 00:00:00")], "k string, n int, at string").selectExpr("k", "n", "cast(at AS timestamp) AS at")
    rows.write.parquet(source)
    out, mark = f"file://{tmp_path}/table", str(tmp_path / "mark")
    stream = spark.readStream.schema(kind).parquet(source)
    incremental.append_new(stream, out, mark, "k", ["n"]).awaitTermination()
    rows.selectExpr("'c' AS k", "n", "at").union(rows).write.mode("append").parquet(source)
    incremental.append_new(spark.readStream.schema(kind).parquet(source), out, mark, "k", ["n"]).awaitTermination()
    assert sorted((r.k, r.n) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 1), ("c", 1)]
    counts = incremental.windowed_counts(spark.readStream.schema(kind).parquet(source), "k", "at")
    query = counts.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == 9
    once = incremental.first_seen(spark.readStream.schema(kind).parquet(source), "k", "at")
    query = once.writeStream.outputMode("append").format("memory").queryName("once").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT count(*) FROM once").first()[0] == 3
