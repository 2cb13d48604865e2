from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsloom.functions import codes, params, text
from newsloom.operators import analyze, cluster, dedup, evaluate, evidence, extract, health, lexicon, models, pages, queue, retention, windows
from newsloom.sources import feeds, sinks


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_params():
    assert [params.bounded(x, 10) for x in ("3", 3, "0", "11", "x", "", None, "1.5", "-1", " 7 ")] == [3, 3, None, None, None, None, None, None, None, 7]
    assert [params.page(x) for x in ("2", "no", None, "0")] == [2, 1, 1, 1]
    assert params.tokens("  Market,  yard market\tMarket ") == ["Market", "yard", "market"] and params.tokens(None) == [] and params.tokens("a" * 150) == ["a" * 100]
    assert [params.year_month(*x) for x in ((None, None), ("2026", None), ("2026", "12"), ("2026", "13"), (None, "3"), ("x", None), ("", ""))] == [(None, None), (2026, None), (2026, 12), None, None, None, (None, None)]
    assert [params.clamp(*x) for x in ((0, 0, 20), (5, 41, 20), (2, 41, 20))] == [1, 3, 2]


def test_pages(spark):
    df = spark.createDataFrame([(i, None if i == 3 else i % 3) for i in range(7)], "id int, v int")
    order = [F.col("v").desc_nulls_last(), F.col("id")]
    last = pages.page_of(df, order, 9, 3).collect()
    assert [(r.id, r.total, r.page, r.pages) for r in last] == [(3, 7, 3, 3)]
    assert [r.id for r in pages.page_of(df, order, -4, 3).collect()] == [2, 5, 1]
    assert pages.page_of(df.limit(0), order, 2).count() == 0
    assert pages.guarded(df, 7).count() == 7 and pages.guarded(df.limit(0), 0).count() == 0
    with pytest.raises(Exception, match="more than 6 rows"):
        pages.guarded(df, 6).collect()


def test_snapshot(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    now = "2026-06-15 12:00:00"
    asked = ["2026-06-15 11:00:00", "2026-06-14 18:30:00", "2026-06-14 18:29:59", "2026-06-15 12:00:01", None]
    got = spark.range(1).select(*[F.date_format(pages.snapshot(at(a), at(now)), "dd HH:mm:ss") for a in asked]).first()
    assert list(got) == ["15 11:00:00", "14 18:30:00", "15 12:00:00", "15 12:00:00", "15 12:00:00"]


def test_public_view_and_flags(spark):
    sources = spark.createDataFrame([(1, True, "a"), (2, False, "b")], "source_id int, active boolean, secret string")
    articles = spark.createDataFrame([(1, 1, 10, "news"), (2, 1, 11, "ad"), (3, 1, 12, None), (4, 2, 13, "news"), (5, 1, None, "news")], "id int, source_id int, story_id int, kind string")
    stories = spark.createDataFrame([(10,), (11,), (12,), (13,), (14,)], "story_id int")
    seen = pages.public_view(articles, sources, stories, F.col("kind") != "ad", {"sources": ["source_id"], "articles": ["id"], "stories": ["story_id"]})
    assert seen["sources"].columns == ["source_id"] and rows(seen["articles"]) == [(1,), (3,), (5,)] and rows(seen["stories"]) == [(10,), (12,)]
    assert rows(pages.flagged(stories, articles, "story_id", F.col("kind") == "ad", "ad").where("ad")) == [(11, True)]


def test_hydrate_and_update(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id int, v string, w string")
    ids = spark.createDataFrame([([2, 9, 1, 2],)], "ids array<int>")
    assert [(r.position, r.id) for r in pages.hydrate(ids, df, "id").collect()] == [(0, 2), (2, 1), (3, 2)]
    new = pages.update_from(df, F.lit('[{"id": 1, "n": "z"}, {"id": 1, "n": "q"}, {"id": 7, "n": "q"}, {"id": 2}]'), "id: int, n: string", "id", {"v": "n"})
    assert new.columns == df.columns and rows(new) == [(1, "z", "x"), (2, "b", None)]
    assert rows(pages.update_from(df, F.lit("broken"), "id: int, n: string", "id", {"v": "n"})) == rows(df)


def test_facts_of_a_story(spark):
    story = spark.createDataFrame([(1,), (2,)], "story_id int")
    members = spark.createDataFrame([(1, 5, "s", "h", "en", None, ["x", "x", "y"]), (1, 4, "t", "h", "HI", 9, ["x"]), (1, 3, "t", None, None, 7, [])], "story_id int, id int, source string, headline string, language string, at long, names array<string>")
    one, two = sorted(pages.detail(story, members).collect(), key=lambda r: r.story_id)
    assert [r.id for r in one.reports] == [3, 4, 5] and one.languages == ["EN", "HI"] and (one.first_at, one.last_at) == (7, 9) and two.reports is None
    assert rows(pages.mention_counts(members, "story_id", "names")) == [(1, "x", 2), (1, "y", 1)]
    assert rows(pages.languages_of(members, "story_id")) == [(1, ["EN", "HI"])]
    assert [tuple(r) for r in pages.coverage(members, "source").collect()] == [("t", 2), ("s", 1)]


def test_states_and_due(spark):
    keys = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True)], "k int, active boolean")
    assert rows(pages.state_counts(keys, spark.createDataFrame([(1, "UP"), (3, None)], "k int, s string"), "k", "s")) == [("UNKNOWN", 3), ("UP", 1)]
    checks = spark.createDataFrame([(1, 5), (1, 9), (2, 7)], "k int, at long")
    assert [r.k for r in pages.due(keys, checks, "k", "at").collect()] == [4, 2, 1]


def test_queue(spark):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    kind = "queue_id int, status string, attempts int, last_error string, next_at timestamp, updated_at timestamp, p int"
    df = spark.createDataFrame([(i, "queued", n, None, None, None, i) for i, n in ((1, 0), (2, 1), (3, 5), (4, 1), (5, 1), (6, 1))], kind)
    got = queue.claim(df, F.col("status") == "queued", [F.col("p").desc()], 2, "busy", now)
    assert {r.queue_id: (r.status, r.attempts) for r in got.where("status = 'busy'").collect()} == {6: ("busy", 2), 5: ("busy", 2)} and got.columns == df.columns
    outcomes = [(1, 1, 500, None), (1, 2, 200, None), (2, 1, 503, None), (3, 1, None, "timeout"), (4, 1, 404, None), (5, 1, 403, None), (3, 0, None, None)]
    names = {"success": "ok", "retry": "wait", "permanent": "gone", "blocked": "shut", "exhausted": "dead"}
    got = {r.queue_id: r for r in queue.record(df, spark.createDataFrame(outcomes, "queue_id int, at int, status int, error string"), now, names).collect()}
    assert {i: (r.status, r.last_error) for i, r in got.items()} == {1: ("ok", None), 2: ("wait", "http-503"), 3: ("dead", "attempts-exhausted: timeout"), 4: ("gone", "http-404"), 5: ("shut", "http-403"), 6: ("queued", None)}
    assert got[2].next_at == datetime(2026, 1, 1, 0, 1) and got[3].next_at is None
    assert rows(queue.gate(df.limit(1), {"a": F.lit(True), "b": F.lit(None).cast("boolean"), "c": F.lit(False)}).select("rejected")) == [("b",)]
    runs = queue.run_counters(spark.createDataFrame([("a", "ok"), ("a", "not-ok"), ("b", None)], "d string, o string"), F.col("d"), "o", ["ok", "not-ok"])
    assert rows(runs) == [("a", 2, 1, 1), ("b", 1, 0, 0)]


def test_evidence(spark):
    entities = spark.createDataFrame([("d1", ["Gaya", "गया"], "town"), ("d2", ["Gaya"], "river"), ("d3", ["North Gate"], "town"), ("d4", ["Patna"], "town"), ("d5", [], "town")], "entity string, names array<string>, family string")
    texts = spark.createDataFrame([(1, "Gate of Gaya opens", "Patna: The north gate was shut in GAYA."), (2, None, "North  gate, and gateway."), (3, "x", None), (4, "", "Gayatri spoke.")], "id int, title string, body string")
    got = rows(evidence.collect(texts, entities, "id", "title", "body"))
    assert got == [(1, "d1", "town", "title", True), (1, "d2", "river", "title", True), (1, "d3", "town", "body", True), (1, "d4", "town", "dateline", True), (2, "d3", "town", "body", True)]
    assert [r for r in rows(evidence.collect(texts, entities, "id", "title", "body", {"town": 2})) if not r[4]] == [(1, "d3", "town", "body", False)]
    assert rows(evidence.resolve(spark.createDataFrame([(" gaya ",), ("none",)], "n string"), entities, "n").select("entity")) == [("d1",), ("d2",)]
    said = ["PATNA, Jan 5: x", "Patna — x", "The council said: no", "A long line of many words here - x", None, "no dash"]
    assert [r[0] for r in spark.createDataFrame([(s,) for s in said], "s string").select(evidence.dateline(F.col("s"))).collect()] == ["PATNA", "Patna", "The council said", None, None, None]
    assert evidence.collect(texts.limit(0), entities, "id", "title", "body").count() == 0 and lexicon.mentions(texts, entities.select("entity", F.explode("names").alias("name")).limit(0), "id", "body").count() == 0


def test_evidence_broadcasts_by_count_only(spark, monkeypatch, tmp_path):
    entities = spark.createDataFrame([(f"d{i}", [f"Gaya {'North ' * (i % 9)}{i}"], "town") for i in range(60)], "entity string, names array<string>, family string")
    texts = spark.createDataFrame([(i, f"Gaya {i} opens", f"Gaya {'North ' * (i % 9)}{i}: closed") for i in range(60)], "id int, title string, body string")
    entities.write.parquet(f"{tmp_path}/e")  # by the size of its file a table looks small
    texts.write.parquet(f"{tmp_path}/t")
    call = lambda: evidence.collect(spark.read.parquet(f"{tmp_path}/t"), spark.read.parquet(f"{tmp_path}/e"), "id", "title", "body")
    want = rows(call())
    assert sorted(r[0] for r in want) == list(range(60)) and {r[3] for r in want} == {"title", "body"}
    monkeypatch.setattr("newsloom.session.BROADCAST", 59)
    got = call()
    assert rows(got) == want and "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_codes(spark):
    now = F.lit("2026-06-15 12:00:00").cast("timestamp")
    said = ["120", "99999", "Mon, 15 Jun 2026 12:05:00 GMT", "Mon, 15 Jun 2026 11:00:00 GMT", "soon", "", None, "-5"]
    assert [r[0] for r in spark.createDataFrame([(s,) for s in said], "s string").select(codes.retry_after(F.col("s"), now)).collect()] == [120, 3600, 300, 0, None, None, None, None]
    one = spark.range(1).select(codes.format_stamp(now), codes.hours_ago(F.lit(0), F.lit(90_000)), codes.time_ago(F.lit(0), F.lit(90_000)), codes.error_decision(F.lit("x")), codes.error_decision(F.lit("")))
    assert list(one.first()) == ["15 Jun, 17:30", "25h ago", "yesterday", "retry", None]
    texts = [("The bridge at the ghat collapsed.",), ("A collapse of talks.",), ("Bridge opened",), (None,)]
    assert [r[0] for r in spark.createDataFrame(texts, "s string").select(codes.named_together(F.col("s"), ["collapsed?"], ["bridge", "road"])).collect()] == [True, False, False, False]
    assert [r[0] for r in spark.createDataFrame([("You won't believe it",), ("Plain",)], "s string").select(text.clickbait(F.col("s"), ("won't believe",))).collect()] == [True, False]


def test_bodies(spark):
    p = lambda *x: "".join(f"<p class='a'>{t}</p>" for t in x)
    long = "This is a long enough paragraph of a story &amp; its town."
    held = [
        (1, "a.example", f"<nav>{p(long)}</nav><article>{p(long, 'short')}</article>{p(long + ' Other.')}"), (2, "a.example", p(long) + "<p>unclosed but long enough to be kept here"), (3, "a.example", "<p>x</p>"), (4, None, None),
        (5, "b.example", f"<div id='t'>{p(long, long)}</div><p>y</p>"), (6, "a.example", '<script type="application/ld+json">{"@type":"NewsArticle","headline":"H","articleBody":"' + "b" * 60 + '"}</script>' + p(long)),
    ]
    extract.register_adapter("B.example", r"(?is)<div id='t'>(.*)</div>")
    with pytest.raises(ValueError):
        extract.register_adapter("c.example", "no group")
    df = spark.createDataFrame(held, "id int, site string, page string")
    got = {r.id: (r.stage, r.body) for r in extract.bodies(df, "page", "site").collect()}
    shown = long.replace("&amp;", "&")
    assert got[1] == ("article", shown) and got[2] == ("page", f"{shown}\nunclosed but long enough to be kept here") and got[3] == (None, None) and got[4] == (None, None)
    assert got[5][0] == "page" and got[6] == ("ld", "b" * 60)
    extract.register_adapter("B.example", r"(?is)<body>(.*)</body>")
    more = spark.createDataFrame([(7, "b.example", f"<body>{p(long)}<div>{'words ' * 30}</div></body>".replace("<p class='a'>", "<i>"))], df.schema)
    assert more.transform(lambda d: extract.bodies(d, "page", "site")).first().stage == "adapter"


def test_section_pages():
    page = "<a href='/tag/x'>All of x here</a><table><tr><td>03-04-2026</td><td>Notice on the filling of posts</td><td><a href='/n/1.html'>PDF</a></td></tr></table><a href='/n/2#top'>A whole title of its own</a>"
    assert list(feeds.section(page, "https://a.example/")) == [("https://a.example/n/1.html", "03-04-2026", "Notice on the filling of posts", None), ("https://a.example/n/2", None, "A whole title of its own", None)]


def test_entities_and_ledger(spark, tmp_path):
    old = spark.createDataFrame([("a", "k1")], "canonical_name string, knowledge_id string")
    new = spark.createDataFrame([("a", "k0", 1), ("b", "k3", 1), ("b", "k2", 1), (None, "k9", 1)], "canonical_name string, knowledge_id string, x int")
    assert rows(sinks.upsert_entities(old, new)) == [("a", "k1"), ("b", "k2")]
    folder = f"file://{tmp_path}/ledger"
    for _ in range(2):
        sinks.append_ledger(old, folder)
    assert spark.read.json(folder).count() == 2
    sinks.write_report(old, folder)
    assert spark.read.json(folder).count() == 1


def test_bridges_join_scripts(spark):
    kind = "struct<headline: string, entities: array<string>>"
    df = spark.createDataFrame([(("Bridge at Patna opens", ["e1"]), ("पटना में पुल खुला", None)), (("Nothing shared", None), ("कुछ नहीं", ["e2"]))], f"a {kind}, b {kind}")
    got = cluster.with_bridges(df).select(cluster.dice(F.col("a.entities"), F.col("b.entities")).alias("d"), F.size("a.entities").alias("n")).collect()
    assert got[0].d == pytest.approx(2 / 3) and got[0].n == 2 and got[1].d == 0


def test_long_chains(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)], "a bigint, b bigint")
    assert cluster.components(chain).agg(F.max("component"), F.count("*")).first()[:] == (0, 101)
    keys = [(i, 1, f"u{i // 2}", f"c{(i + 1) // 2}", None) for i in range(16)]  # each row shares a key with the one before
    got = sorted(map(tuple, dedup.batch_duplicates(spark.createDataFrame(keys, "id bigint, source_id int, canonical_key string, content_key string, headline_key string")).collect()))
    assert got == [(i, i - 1) for i in range(1, 16, 2)]
    assert dedup.batch_duplicates(spark.createDataFrame([], "id bigint, source_id int, canonical_key string, content_key string, headline_key string")).count() == 0


def test_folds_and_candidates(spark):
    held = [(i, ("bridge road canal repair " if i % 3 else "cricket match score team ") * 3 + str(i), "infra" if i % 3 else "sport") for i in range(30)]
    df = spark.createDataFrame(held, "id int, t string, topic string")
    folds = models.folds_of(df, "id", "topic", 5).groupBy("topic", "fold").count().collect()
    assert {(r.topic, r["count"]) for r in folds} == {("infra", 4), ("sport", 2)} and len(folds) == 10
    assert models.balanced(df, "topic").groupBy("topic").agg(F.round(F.sum("weight"), 6).alias("w")).select("w").distinct().count() == 1
    few = models.predicted(df.where("id < 3"), "id", "t", "topic", 0, "logistic", 64)
    assert few.count() == 3
    shares = spark.range(1).select(models.distribution(F.array(F.lit(1.0), F.lit(1.0), F.lit(1000.0)))).first()[0]
    assert sum(shares) == pytest.approx(1) and shares[2] == pytest.approx(1)


def test_gate_of_models(spark):
    kind = "label string, support int, f1 double"
    old = spark.createDataFrame([("a", 5, 0.9), ("b", 5, 0.8), ("c", 1, 0.9), ("d", 4, 0.5)], kind)
    new = spark.createDataFrame([("a", 5, 0.9), ("b", 5, 0.6), ("c", 1, 0.1)], kind)
    assert rows(evaluate.regressions(old, new).select("label")) == [("b",), ("d",)]
    one = models.promoted(old, new, 0.5).first()
    assert one.fallen == ["b", "d"] and not one.promote and models.promoted(old, old, 0.75).first().promote
    said = spark.createDataFrame([("x", "x"), ("y", "x"), (None, "x")], "t string, s string")
    got = rows(evaluate.report({"all": evaluate.accuracy(said, "t", "s"), "x": evaluate.binary(said, F.col("t") == "x", F.col("s") == "x")}, 0.6))
    assert ("all.accuracy", 0.5, False) in got and ("x.recall", 1.0, True) in got and ("x.precision", 0.333, False) in got
    assert evaluate.accuracy(said.limit(0), "t", "s").first().accuracy == 1.0


def test_windows_and_retention(spark):
    df = spark.createDataFrame([(k, i, v) for k in (1, 2) for i, v in ((3, "a"), (1, "b"), (2, "c"))], "k int, p int, v string")
    assert rows(windows.budget(df, "k", ["p", "v"], 2).where("NOT kept").select("k", "v")) == [(1, "a"), (2, "a")]
    assert rows(windows.latest_or(spark.createDataFrame([(1,), (9,)], "k int"), df, "k", [F.col("p")], "v", "none")) == [(1, "a"), (9, "none")]
    kept = spark.createDataFrame([(1, "2026-01-01", None), (2, "2027-01-01", "x"), (3, None, "y")], "id int, e string, keep_reason string").withColumn("expires_at", F.col("e").cast("timestamp"))
    assert list(retention.report(kept, F.lit("2026-06-01").cast("timestamp")).first()) == [1, 2, 2]


def test_compare_texts(spark):
    a = "the council opened a new bridge near the market after long delay and residents asked for a fresh count of houses"
    df = spark.createDataFrame([(1, a, a), (2, a, a.replace("bridge", "canal")), (3, a, "words of quite another story about rain wind crops seeds fields barns tractors ploughs"), (4, a, "too short"), (5, None, a)], "i int, x string, y string")
    got = {r.i: r for r in dedup.compare_texts(df, "x", "y").collect()}
    assert [got[i].verdict for i in range(1, 6)] == ["near", "near", "different", "insufficient", "insufficient"]
    assert (got[1].cosine, got[1].estimate, got[1].distance) == (1.0, 1.0, 0) and 0.8 < got[2].cosine < 1 and got[2].distance < got[3].distance and got[3].estimate < 0.1


def test_assign(spark):
    keys = "id bigint, source_id int, canonical_key string, content_key string, headline_key string"
    known = spark.createDataFrame([(1, 1, "u1", "c1", "h1"), (2, 1, "u2", "c2", "h2"), (3, 2, "u3", "c3", "h3")], keys)
    new = spark.createDataFrame([(10, 1, "u1", "x", "y"), (11, 1, "n1", "x1", "y1"), (12, 1, "n2", "x2", "y2"), (13, 1, "n3", "x3", "y3")], keys)
    near = spark.createDataFrame([(10, 2, 1, 1, 0.9), (11, 2, 1, 1, 0.7), (11, 1, 1, 1, 0.7), (11, 3, 1, 2, 0.99)], "id bigint, known_id bigint, source_id int, known_source int, cosine double")
    stories = spark.createDataFrame([(1, 100), (2, 200)], "id bigint, story_id bigint")
    pairs = spark.createDataFrame([(12, 300, 0.8), (12, 301, 0.8), (13, 300, 0.5), (11, 300, 0.9)], "id bigint, story_id bigint, score double")
    assert rows(dedup.assign(new, known, near, stories, pairs)) == [(10, 1, "canonical_url", 100), (11, 1, "near", 100), (12, None, None, 300), (13, None, None, None)]


def test_analyze(spark):
    articles = spark.createDataFrame([(1, 1, "https://a/1", None, "Bridge opens in Gaya", "d", "Gaya: The bridge of the town was opened on Monday and 12 boats were moved."), (2, 1, None, None, None, None, None)], "id int, source_id int, url string, canonical_url string, title string, description string, body string")
    phrases = spark.createDataFrame([("works", "bridge", 2.0), ("works", "was opened", 1.0), ("sport", "cricket", 2.0)], "label string, phrase string, weight double")
    entities = spark.createDataFrame([("e1", ["Gaya"], "town")], "entity string, names array<string>, family string")
    one, two = sorted(analyze.bundle(articles, {"topic": (phrases, 2.0)}, entities).collect(), key=lambda r: r.id)
    assert one.topic == "works" and one.dateline == "Gaya" and [n.entity for n in one.named] == ["e1"] and one.numbers == ["12"] and one.canonical_key == "https://a/1"
    assert two.topic is None and two.named is None and two.fingerprint == 0


def test_hybrid_gate_and_drift(spark):
    df = spark.createDataFrame([("a", "a", "b", "a"), ("b", "a", "b", "b")], "t string, r string, m string, f string")
    one = models.hybrid_gate(df, "t", "r", "m", "f").first()
    assert one.fused == 1.0 and one["pass"] and one.rule < 1
    now = spark.createDataFrame([(1, 8, 10), (2, 1, 10), (3, 2, 2), (4, 9, 20)], "k int, weak int, all int")
    was = spark.createDataFrame([(1, 1, 10), (2, 1, 10), (3, 0, 9)], "k int, weak int, all int")
    assert rows(health.drift_alerts(now, was, "k")) == [(1, 0.1, 0.8), (4, 0.0, 0.45)]
