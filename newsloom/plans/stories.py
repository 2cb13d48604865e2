"""Queries on stories, sources and the crawl."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import codes, text
from newsloom.operators import cluster, discovery, health, retention, serve, titles, windows
from newsloom.plans.registry import core
from newsloom.sources import table

NOW = "2026-06-15 12:00:00"
# The instant of an article for reads that need no parsing: its fetch.
_MEMBERS = "SELECT a.record_id AS id, a.story_id, a.source_id, a.language, a.title AS headline, NULL::BIGINT AS published_us, epoch_us(a.fetched_at) AS seen_us FROM article_records a JOIN sources s ON s.source_id = a.source_id WHERE s.active AND a.story_id IS NOT NULL"


def _members(spark: SparkSession, folder: str) -> DataFrame:
    rows = serve.visible(table(spark, folder, "article_records"), table(spark, folder, "sources")).where("story_id IS NOT NULL")
    return rows.select(
        F.col("record_id").alias("id"), F.col("story_id").cast("bigint").alias("story_id"), "source_id", "language", F.col("title").alias("headline"),
        F.lit(None).cast("bigint").alias("published_us"), F.unix_micros("fetched_at").alias("seen_us"),
    )


@core.query(f"""
WITH m AS ({_MEMBERS}), g AS (SELECT story_id, min(seen_us) AS first_report, max(seen_us) AS latest_report, count(*) AS article_count, count(DISTINCT source_id) AS source_count,
  array_to_string(list_sort(list_distinct(list(upper(language)) FILTER (WHERE language IS NOT NULL))), ',') AS languages, arg_max(headline, (seen_us, id)) AS latest_headline
  FROM m WHERE seen_us <= epoch_us(TIMESTAMPTZ '{NOW}+00') GROUP BY story_id)
SELECT s.story_id, canonical_title, first_report, latest_report, g.article_count, g.source_count, coalesce(g.languages, '') AS languages, latest_headline FROM stories s JOIN g ON g.story_id = s.story_id
WHERE latest_report >= epoch_us(TIMESTAMPTZ '2026-06-15 00:00:00+05:30') - 6 * 86400000000::BIGINT ORDER BY latest_report DESC, s.story_id DESC LIMIT 90""")
def timeline_page(spark: SparkSession, folder: str) -> DataFrame:
    page = serve.timeline(table(spark, folder, "stories"), _members(spark, folder), F.lit(NOW).cast("timestamp"))
    return page.select("story_id", "canonical_title", "first_report", "latest_report", "article_count", "source_count", F.array_join("languages", ",").alias("languages"), "latest_headline")


def _norm(c: str) -> str:
    return f"lower(replace(replace(coalesce({c}, ''), '-', ' '), '_', ' '))"


def _search_sql(tokens: list[str]) -> str:
    own = [f"(contains({_norm('s.canonical_title')}, '{t}') OR contains({_norm('s.primary_category')}, '{t}') OR coalesce(h{i}, false))" for i, t in enumerate(tokens)]
    theirs = [f"bool_or(contains({_norm('a.title')}, '{t}') OR contains({_norm('c.name')}, '{t}') OR contains({_norm('c.domain')}, '{t}')) AS h{i}" for i, t in enumerate(tokens)]
    title = " AND ".join(f"contains({_norm('s.canonical_title')}, '{t}')" for t in tokens)
    return (
        f"WITH m AS (SELECT a.story_id, {', '.join(theirs)} FROM article_records a JOIN sources c USING (source_id) WHERE c.active AND a.story_id IS NOT NULL GROUP BY a.story_id) "
        f"SELECT s.story_id, {title} AS title_match FROM stories s LEFT JOIN m ON m.story_id = s.story_id WHERE {' AND '.join(own)}"
    )


@core.query(_search_sql(["market", "yard"]))
def search_stories(spark: SparkSession, folder: str) -> DataFrame:
    """All stories that hold two tokens somewhere, with the rank tier of each."""
    members = _members(spark, folder).join(table(spark, folder, "sources").select("source_id", F.col("name").alias("source_name"), F.col("domain").alias("source_domain")), "source_id")
    members = members.withColumn("entities", F.lit(None).cast("array<string>"))
    return serve.search(table(spark, folder, "stories"), members, ["market", "yard"], limit=None).select("story_id", "title_match")


@core.query("""
SELECT story_id, canonical_title, epoch_us(first_seen_at) AS first_seen_us FROM stories
WHERE first_seen_at >= TIMESTAMPTZ '2026-01-01 00:00:00+05:30' AND first_seen_at < TIMESTAMPTZ '2026-02-01 00:00:00+05:30' ORDER BY first_seen_at DESC, story_id DESC LIMIT 20""")
def archive_page(spark: SparkSession, folder: str) -> DataFrame:
    return serve.archive(table(spark, folder, "stories"), 2026, 1).select("story_id", "canonical_title", F.unix_micros("first_seen_at").alias("first_seen_us"))


@core.query(f"""
WITH m AS ({_MEMBERS}), g AS (SELECT story_id, count(*) AS n, count(DISTINCT source_id) AS s, min(seen_us) AS lo, max(seen_us) AS hi FROM m GROUP BY story_id)
SELECT s.story_id, coalesce(n, 0)::BIGINT AS article_count, coalesce(g.s, 0)::BIGINT AS source_count, coalesce(lo, epoch_us(first_seen_at)) AS first_seen_us, coalesce(hi, epoch_us(last_seen_at)) AS last_seen_us
FROM stories s LEFT JOIN g ON g.story_id = s.story_id""")
def story_recount(spark: SparkSession, folder: str) -> DataFrame:
    return serve.recount(table(spark, folder, "stories"), _members(spark, folder))


@core.query("""
WITH c AS (SELECT story_id, language AS v, count(*) AS n FROM article_records WHERE language IS NOT NULL AND story_id IS NOT NULL GROUP BY 1, 2),
m AS (SELECT story_id, max(n) AS n FROM c GROUP BY 1) SELECT c.story_id::BIGINT AS story_id, min(v) AS language FROM c JOIN m ON c.story_id = m.story_id AND c.n = m.n GROUP BY 1""")
def story_mode_language(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "article_records").where("story_id IS NOT NULL").select(F.col("story_id").cast("bigint").alias("story_id"), "language")
    return windows.mode_value(rows, "story_id", "language")


@core.query("""
SELECT source_id, CASE WHEN count(DISTINCT language) = 1 THEN min(language) END AS language FROM article_records GROUP BY source_id""")
def source_unanimous_language(spark: SparkSession, folder: str) -> DataFrame:
    return serve.unanimous(table(spark, folder, "article_records"), "source_id", "language")


@core.query("SELECT primary_category, count(*) AS n FROM stories GROUP BY 1")
def topic_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return serve.distribution(table(spark, folder, "stories"), "primary_category")


@core.query("""
SELECT s.name, count(*) AS articles, count(DISTINCT story_id) AS stories, count(DISTINCT CASE WHEN story_id IS NULL THEN record_id END) AS loose
FROM article_records a JOIN sources s USING (source_id) GROUP BY 1""")
def source_coverage(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "article_records").join(table(spark, folder, "sources").select("source_id", "name"), "source_id")
    return rows.groupBy("name").agg(F.count("*").alias("articles"), F.count_distinct("story_id").alias("stories"), F.count(F.when(F.col("story_id").isNull(), 1)).alias("loose"))


@core.query("""
SELECT district, count(*) AS n, count(DISTINCT event_type) AS events FROM (SELECT unnest(district_names) AS district, event_type FROM stories) GROUP BY 1""")
def district_stories(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "stories").select(F.explode("district_names").alias("district"), "event_type")
    return rows.groupBy("district").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("events"))


_FETCH = """SELECT q.source_id, count(*) AS attempted, count(*) FILTER (WHERE f.status BETWEEN 200 AND 299) AS succeeded, count(*) FILTER (WHERE f.status IN (401, 403)) AS blocked,
count(*) FILTER (WHERE f.status = 429) AS limited FROM fetch_results f JOIN (SELECT DISTINCT queue_id, source_id FROM crawl_queue) q USING (queue_id) GROUP BY 1"""


@core.query(f"""
WITH m AS ({_FETCH}) SELECT source_id, attempted, succeeded, CASE WHEN attempted >= 5 AND blocked / attempted >= 0.5 THEN 'BLOCKED' WHEN attempted >= 5 AND succeeded / attempted < 0.2 THEN 'BROKEN'
WHEN (attempted >= 5 AND succeeded / attempted < 0.8) OR limited / attempted >= 0.2 THEN 'DEGRADED' ELSE 'HEALTHY' END AS state FROM m""")
def source_health(spark: SparkSession, folder: str) -> DataFrame:
    queue = table(spark, folder, "crawl_queue").select("queue_id", "source_id").distinct()
    fetches = table(spark, folder, "fetch_results").select("queue_id", "status", "outcome", "fetched_at").join(queue, "queue_id")
    return health.assess(health.fetch_metrics(fetches, "source_id")).select("source_id", "attempted", "succeeded", "state")


@core.query("""
WITH d AS (SELECT source_id, (created_at AT TIME ZONE 'UTC')::DATE AS day FROM crawl_queue),
c AS (SELECT s.source_id, g.day FROM (SELECT DISTINCT source_id FROM d) s CROSS JOIN (SELECT (DATE '2026-06-15' - i::INT) AS day FROM range(1, 31) t(i)) g),
n AS (SELECT source_id, day, count(*) AS n FROM d GROUP BY 1, 2)
SELECT source_id, median(coalesce(n, 0))::DOUBLE AS median, sum(coalesce(n, 0))::BIGINT AS total FROM c LEFT JOIN n USING (source_id, day) GROUP BY source_id""")
def daily_baseline(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "crawl_queue").select("source_id", F.to_date("created_at").alias("day"))
    return windows.baseline(windows.daily_counts(rows, "source_id", "day", 30, F.lit("2026-06-15").cast("date")), "source_id")


@core.query("""
SELECT source_id, queue_id FROM (SELECT source_id, queue_id, row_number() OVER (PARTITION BY source_id ORDER BY p, c, queue_id) AS r FROM
 (SELECT source_id, queue_id, min(CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 9 END) AS p, min(created_at) AS c FROM crawl_queue WHERE status IN ('discovered', 'queued', 'retry') GROUP BY 1, 2)) WHERE r <= 5""")
def claim_due(spark: SparkSession, folder: str) -> DataFrame:
    """The five rows of each source that are due first, by priority, then age."""
    rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).when(F.col("priority") == "low", 2).otherwise(9)
    due = table(spark, folder, "crawl_queue").where(F.col("status").isin("discovered", "queued", "retry"))
    due = due.groupBy("source_id", "queue_id").agg(F.min(rank).alias("p"), F.min("created_at").alias("c"))
    return windows.top_k(due, ["source_id"], [F.col("p"), F.col("c"), F.col("queue_id")], 5).select("source_id", "queue_id")


@core.query("""
WITH s AS (SELECT source_id, queue_id, epoch_us(min(created_at)) AS at FROM crawl_queue GROUP BY 1, 2), f AS (SELECT queue_id, epoch_us(min(fetched_at)) AS at FROM fetch_results GROUP BY 1),
x AS (SELECT s.source_id, f.queue_id, f.at // 1000000 AS at FROM f JOIN s USING (queue_id)), y AS (SELECT source_id, record_id, epoch_us(fetched_at) // 1000000 AS at FROM article_records)
SELECT x.queue_id, y.record_id, y.at - x.at AS gap FROM x JOIN y ON x.source_id = y.source_id AND abs(x.at - y.at) <= 43200""")
def fetches_near_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Fetches and articles of one source within half a day: a range join by bins."""
    queue = table(spark, folder, "crawl_queue").select("source_id", "queue_id").distinct()
    fetches = table(spark, folder, "fetch_results").groupBy("queue_id").agg(F.min("fetched_at").alias("at")).join(queue, "queue_id")
    fetches = fetches.select("source_id", "queue_id", F.floor(F.unix_micros("at") / 1_000_000).alias("at_a"))
    articles = table(spark, folder, "article_records").select("source_id", "record_id", F.floor(F.unix_micros("fetched_at") / 1_000_000).alias("at_b"))
    return windows.range_pairs(fetches, articles, ["source_id"], "at_a", "at_b", 43200).select("queue_id", "record_id", (F.col("at_b") - F.col("at_a")).alias("gap"))


@core.query("""
WITH RECURSIVE e AS (SELECT DISTINCT a.record_id AS x, b.record_id AS y FROM (SELECT record_id, md5(body) AS h FROM article_records WHERE body <> '') a JOIN (SELECT record_id, md5(body) AS h FROM article_records WHERE body <> '') b ON a.h = b.h AND a.record_id < b.record_id),
w AS (SELECT x, y FROM e UNION SELECT y, x FROM e), r(id, c) AS (SELECT x, x FROM w UNION SELECT w.y, r.c FROM r JOIN w ON r.id = w.x)
SELECT id, min(c) AS component FROM r GROUP BY id""")
def copy_components(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of records with one body, by links from each to the lowest of its group: a star, not all pairs."""
    rows = table(spark, folder, "article_records").where("body != ''").select("record_id", F.md5("body").alias("h"))
    lowest = rows.groupBy("h").agg(F.min("record_id").alias("a"))
    return cluster.components(rows.join(lowest, "h").where("record_id > a").select("a", F.col("record_id").alias("b")))


@core.query("""
SELECT queue_id, json_extract_string(discovery_metadata, '$.title') AS title, (json_extract_string(discovery_metadata, '$.summary_only') = 'true') AS summary_only
FROM crawl_queue WHERE discovery_metadata IS NOT NULL""")
def discovery_metadata(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "crawl_queue").where("discovery_metadata IS NOT NULL")
    held = F.from_json("discovery_metadata", "title string, summary_only boolean")
    return rows.select("queue_id", held["title"].alias("title"), held["summary_only"].alias("summary_only"))


@core.query("""
SELECT e.entity_no::BIGINT AS entity_no, n.name, n.language FROM knowledge_entities e, LATERAL (SELECT unnest(aliases) AS name, 'en' AS language UNION ALL SELECT unnest(hindi_names), 'hi' UNION ALL SELECT unnest(romanisations), 'und') n""")
def entity_names(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "knowledge_entities")
    parts = [rows.select(F.col("entity_no").cast("bigint").alias("entity_no"), F.explode(c).alias("name"), F.lit(lang).alias("language")) for c, lang in (("aliases", "en"), ("hindi_names", "hi"), ("romanisations", "und"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@core.query("""
SELECT source_id, strftime((created_at AT TIME ZONE 'Asia/Kolkata')::DATE, '%Y-%m-%d') AS day, count(*) AS n FROM crawl_queue GROUP BY ALL""")
def discovered_by_ist_day(spark: SparkSession, folder: str) -> DataFrame:
    day = F.date_format(codes.ist_day(F.col("created_at")), "yyyy-MM-dd")
    return table(spark, folder, "crawl_queue").groupBy("source_id", day.alias("day")).agg(F.count("*").alias("n"))


@core.query("""
SELECT queue_id, (SELECT count(*) FROM (SELECT 1)) AS one, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN concat(s // 60, 'm ago') WHEN s < 86400 THEN concat(s // 3600, 'h ago') WHEN s < 172800 THEN 'yesterday' ELSE concat(s // 86400, 'd ago') END AS ago
FROM (SELECT queue_id, epoch_us(TIMESTAMPTZ '2026-12-31 00:00:00+00') // 1000000 - epoch_us(created_at) // 1000000 AS s FROM crawl_queue)""")
def time_ago(spark: SparkSession, folder: str) -> DataFrame:
    now = F.unix_timestamp(F.lit("2026-12-31 00:00:00").cast("timestamp"))
    ago = codes.time_ago(F.floor(F.unix_micros("created_at") / 1_000_000), now)
    return table(spark, folder, "crawl_queue").select("queue_id", F.lit(1).cast("bigint").alias("one"), ago.alias("ago"))


@core.query("SELECT source_id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM sources")
def source_slugs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sources").select("source_id", text.slug(F.col("name")).alias("slug"))


@core.query("""
SELECT record_id, CASE WHEN length(title) BETWEEN 40 AND 110 THEN 15 WHEN length(title) BETWEEN 25 AND 39 OR length(title) BETWEEN 111 AND 140 THEN 8 ELSE 0 END AS conciseness,
coalesce((upper(title) = title AND lower(title) <> title AND length(title) > 15) OR length(title) - length(regexp_replace(title, '[!?]', '', 'g')) >= 3, NULL) AS clickbait, nullif(substr(description, 1, 500), '') AS description
FROM article_records""")
def title_features(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "article_records").select("record_id", text.conciseness(F.col("title")).alias("conciseness"), text.clickbait(F.col("title")).alias("clickbait"), text.description(F.col("description")).alias("description"))


_POINTS = """CASE WHEN length(title) BETWEEN 40 AND 110 THEN 15 WHEN length(title) BETWEEN 25 AND 39 OR length(title) BETWEEN 111 AND 140 THEN 8 ELSE 0 END
+ CASE WHEN len(list_distinct(regexp_extract_all(lower(title), '([a-z]+|[ऀ-ॿ]+)', 1))) >= 5 THEN 10 ELSE 0 END
- CASE WHEN (upper(title) = title AND lower(title) <> title AND length(title) > 15) OR length(title) - length(regexp_replace(title, '[!?]', '', 'g')) >= 3 THEN 25 ELSE 0 END
+ CASE extraction_confidence WHEN 'high' THEN 10 WHEN 'medium' THEN 5 ELSE 0 END + CASE priority WHEN 'high' THEN 5 WHEN 'medium' THEN 2 ELSE 0 END"""


@core.query(f"""
WITH m AS (SELECT a.story_id::BIGINT AS story_id, trim(title) AS headline, ({_POINTS})::BIGINT AS score, fetched_at FROM article_records a JOIN sources s USING (source_id) WHERE story_id IS NOT NULL AND trim(title) <> '')
SELECT story_id, headline, score FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY score DESC, fetched_at, headline) AS r FROM m) WHERE r = 1""")
def story_titles(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "article_records").where("story_id IS NOT NULL").join(table(spark, folder, "sources").select("source_id", "priority"), "source_id")
    rows = rows.withColumn("story_id", F.col("story_id").cast("bigint"))
    score = titles.points(F.col("title"), F.col("extraction_confidence"), F.col("priority"))
    won = titles.best(rows, "story_id", "title", score, "fetched_at")
    return won.withColumn("score", F.col("score").cast("bigint"))


@core.query()
def grouped_stories(spark: SparkSession, folder: str) -> DataFrame:
    """Articles grouped anew by place, time, headline and numbers."""
    facts = table(spark, folder, "stories").select("story_id", "district_names", "event_type", "primary_category")
    rows = table(spark, folder, "article_records").withColumn("story_id", F.col("story_id").cast("bigint")).join(facts, "story_id", "left")
    rows = rows.select(
        F.col("record_id").alias("id"), F.floor(F.unix_micros("fetched_at") / 1_000_000).alias("at"), F.col("title").alias("headline"), "body",
        F.lit(None).cast("array<string>").alias("entities"), F.col("district_names").alias("districts"), "event_type", F.col("primary_category").alias("category"),
    )
    return cluster.stories(rows)


@core.query("""
SELECT s.story_id, a.record_id, c.name AS source, coalesce(a.title, '') AS headline, row_number() OVER (PARTITION BY s.story_id ORDER BY epoch_us(a.fetched_at), a.record_id) AS position
FROM stories s JOIN article_records a ON a.story_id = s.story_id JOIN sources c ON c.source_id = a.source_id""")
def story_reports(spark: SparkSession, folder: str) -> DataFrame:
    """The reports of each story in order of time."""
    rows = table(spark, folder, "article_records").where("story_id IS NOT NULL").withColumn("story_id", F.col("story_id").cast("bigint"))
    rows = rows.join(table(spark, folder, "stories").select("story_id"), "story_id").join(table(spark, folder, "sources").select("source_id", F.col("name").alias("source")), "source_id")
    rows = rows.select("story_id", "record_id", "source", F.coalesce("title", F.lit("")).alias("headline"), F.unix_micros("fetched_at").alias("at"))
    return windows.numbered(rows, ["story_id"], "at", "record_id", 86_400_000_000).select("story_id", "record_id", "source", "headline", F.col("position").cast("bigint").alias("position"))


@core.query("""
SELECT status, count(*) AS n, count(DISTINCT source_id) AS sources, sum(processing_attempts)::BIGINT AS attempts FROM crawl_queue GROUP BY status""")
def queue_by_status(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "crawl_queue").groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("sources"), F.sum("processing_attempts").alias("attempts"))


@core.query("""
SELECT source_id, count(DISTINCT queue_id) AS n FROM crawl_queue q WHERE EXISTS (SELECT 1 FROM fetch_results f WHERE f.queue_id = q.queue_id) AND NOT EXISTS (SELECT 1 FROM article_records a WHERE a.queue_id = q.queue_id) GROUP BY 1""")
def fetched_without_article(spark: SparkSession, folder: str) -> DataFrame:
    queue = table(spark, folder, "crawl_queue").select("queue_id", "source_id")
    held = queue.join(table(spark, folder, "fetch_results").select("queue_id"), "queue_id", "left_semi").join(table(spark, folder, "article_records").select("queue_id"), "queue_id", "left_anti")
    return held.groupBy("source_id").agg(F.count_distinct("queue_id").alias("n"))


@core.query("""
(SELECT source_id FROM crawl_queue INTERSECT SELECT source_id FROM article_records) EXCEPT SELECT source_id FROM sources WHERE NOT active""")
def active_sources_with_articles(spark: SparkSession, folder: str) -> DataFrame:
    ids = lambda name: table(spark, folder, name).select("source_id")
    return ids("crawl_queue").intersect(ids("article_records")).subtract(table(spark, folder, "sources").where("NOT active").select("source_id"))


@core.query("""
SELECT canonical_name, min(knowledge_id) AS knowledge_id, count(*) AS facets, count(DISTINCT entity_type) AS types FROM knowledge_entities GROUP BY 1""")
def entity_facets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "knowledge_entities").groupBy("canonical_name").agg(F.min("knowledge_id").alias("knowledge_id"), F.count("*").alias("facets"), F.count_distinct("entity_type").alias("types"))


@core.query("""
WITH p AS (SELECT e.entity_no, e.parent_entity, p.canonical_name FROM knowledge_entities e LEFT JOIN (SELECT knowledge_id, min(canonical_name) AS canonical_name FROM knowledge_entities GROUP BY 1) p ON p.knowledge_id = e.parent_entity)
SELECT entity_no::BIGINT AS entity_no, parent_entity, canonical_name AS parent FROM p""")
def entity_parents(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "knowledge_entities")
    names = rows.groupBy(F.col("knowledge_id").alias("parent_entity")).agg(F.min("canonical_name").alias("parent"))
    return rows.select(F.col("entity_no").cast("bigint").alias("entity_no"), "parent_entity").join(names, "parent_entity", "left")


@core.query("""
SELECT priority, percentile_disc(0.5) WITHIN GROUP (ORDER BY processing_attempts)::BIGINT AS median, max(processing_attempts)::BIGINT AS most, grouping(priority)::BIGINT AS whole FROM crawl_queue GROUP BY ROLLUP (priority)""")
def attempts_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "crawl_queue").rollup("priority").agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY processing_attempts)").cast("bigint").alias("median"), F.max("processing_attempts").cast("bigint").alias("most"), F.grouping("priority").cast("bigint").alias("whole")
    )


@core.query("""
WITH f AS (SELECT source_id, epoch_us(fetched_at) AS t, record_id FROM article_records), g AS (SELECT *, t - lag(t) OVER (PARTITION BY source_id ORDER BY t, record_id) AS gap FROM f)
SELECT source_id, count(*) AS n, count(*) FILTER (WHERE gap IS NULL OR gap > 6 * 3600000000) AS sessions FROM g GROUP BY 1""")
def publishing_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of articles of a source with at most six hours between neighbours."""
    rows = table(spark, folder, "article_records").select("source_id", "record_id", F.unix_micros("fetched_at").alias("t"))
    rows = windows.gaps(rows, ["source_id"], "t", "record_id", 7 * 86_400_000_000)
    return rows.groupBy("source_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("gap").isNull() | (F.col("gap") > 6 * 3_600_000_000), 1)).alias("sessions"))


@core.query("""
WITH k AS (SELECT source_id, epoch_us(accepted_at) AS t, known_id FROM known_articles), a AS (SELECT source_id, epoch_us(fetched_at) AS t, record_id FROM article_records),
j AS (SELECT a.record_id, max(struct_pack(t := k.t, id := k.known_id)) AS m FROM a JOIN k ON k.source_id = a.source_id AND k.t <= a.t GROUP BY 1)
SELECT record_id, m.id AS known_id FROM j""")
def last_known_before(spark: SparkSession, folder: str) -> DataFrame:
    """As-of join: the article of a source that was accepted last before each record's fetch."""
    known = table(spark, folder, "known_articles").select("source_id", F.unix_micros("accepted_at").alias("t"), F.lit(0).alias("side"), F.col("known_id").alias("id"))
    new = table(spark, folder, "article_records").select("source_id", F.unix_micros("fetched_at").alias("t"), F.lit(1).alias("side"), F.col("record_id").alias("id"))
    return windows.as_of(known.unionByName(new), ["source_id"], "t").select(F.col("id").alias("record_id"), F.col("of").alias("known_id"))


_ENTRIES = """WITH e AS (SELECT source_id, url, max(epoch_us(created_at)) AS t FROM crawl_queue GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY t DESC, url) AS position FROM e),
c AS (SELECT source_id, max(epoch_us(fetched_at)) - 30 * 86400000000 AS seen_at FROM article_records GROUP BY 1),
s AS (SELECT p.source_id, min(position) AS stop FROM p JOIN c USING (source_id) WHERE t <= seen_at GROUP BY 1)"""


@core.query(f"""
{_ENTRIES} SELECT source_id, count(*) AS new, count(*) FILTER (WHERE n <= 20) AS kept FROM (SELECT p.*, row_number() OVER (PARTITION BY p.source_id ORDER BY position) AS n FROM p LEFT JOIN s USING (source_id)
WHERE stop IS NULL OR position < stop) GROUP BY 1""")
def new_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses of each source that were discovered since 30 days before its last article, and how many a poll of 20 keeps."""
    entries = table(spark, folder, "crawl_queue").groupBy("source_id", "url").agg(F.max(F.unix_micros("created_at")).alias("at"))
    entries = windows.numbered(entries.withColumn("back", -F.col("at")), ["source_id"], "back", "url", 7 * 86_400_000_000)
    month = 30 * 86_400_000_000
    cursors = table(spark, folder, "article_records").groupBy("source_id").agg((F.max(F.unix_micros("fetched_at")) - month).alias("seen_at")).withColumn("seen_url", F.lit(None).cast("string"))
    walked = discovery.walk(entries.select("source_id", "position", "url", "at"), cursors, "source_id", 20)
    return walked.groupBy("source_id").agg(F.count("*").alias("new"), F.count(F.when(F.col("kept"), 1)).alias("kept"))


@core.query("""
SELECT status, count(*) AS n FROM (SELECT CASE WHEN status = 'fetching' AND epoch_us(TIMESTAMPTZ '2026-06-15 12:00:00+00') - epoch_us(updated_at) > 600 * 1000000 THEN 'retry' ELSE status END AS status FROM crawl_queue) GROUP BY 1""")
def released_queue(spark: SparkSession, folder: str) -> DataFrame:
    return retention.release(table(spark, folder, "crawl_queue"), F.lit(NOW).cast("timestamp"), "fetching", "retry", 600).groupBy("status").agg(F.count("*").alias("n"))


@core.query("""
SELECT temp_id FROM temp_documents WHERE expires_at IS NULL OR expires_at > TIMESTAMPTZ '2026-06-15 12:00:00+00'""")
def kept_documents(spark: SparkSession, folder: str) -> DataFrame:
    return retention.purge(table(spark, folder, "temp_documents"), F.lit(NOW).cast("timestamp")).select("temp_id")


@core.query("""
SELECT record_id, source_id, extraction_method FROM article_records WHERE extraction_confidence = 'low' OR extraction_confidence IS NULL""")
def weak_extractions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "article_records").where("extraction_confidence = 'low' OR extraction_confidence IS NULL").select("record_id", "source_id", "extraction_method")
