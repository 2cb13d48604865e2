"""Queries on whole pages, queues and reports, with the SQL they are checked against."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import codes, languages, text
from newsloom.operators import cluster, dedup, evaluate, evidence, extract, lexicon, pages, queue, retention, serve, windows
from newsloom.plans.registry import core
from newsloom.sources import sinks, table

NOW = "2026-06-15 12:00:00"


def _norm(c: str) -> str:
    return f"lower(replace(replace(coalesce({c}, ''), '-', ' '), '_', ' '))"


def _now() -> Column:
    return F.lit(NOW).cast("timestamp")


def _members(spark: SparkSession, folder: str) -> DataFrame:
    """story_id, id, source, headline, language, curated, at of each article of a story."""
    names = table(spark, folder, "sources").select("source_id", F.col("name").alias("source"))
    rows = table(spark, folder, "article_records").where("story_id IS NOT NULL").join(names, "source_id")
    return rows.select(
        F.col("story_id").cast("bigint").alias("story_id"), F.col("record_id").alias("id"), "source", F.col("title").alias("headline"), "language",
        (F.col("extraction_confidence") == "high").alias("curated"), F.unix_micros("fetched_at").alias("at"),
    )


@core.query("""
WITH t AS (SELECT count(*) AS n FROM stories), p AS (SELECT least(2, greatest(1, ceil(n / 20)))::INT AS page, greatest(1, ceil(n / 20))::INT AS pages, n FROM t),
s AS (SELECT story_id, row_number() OVER (ORDER BY last_seen_at DESC NULLS LAST, story_id DESC) AS r FROM stories),
m AS (SELECT a.story_id, array_to_string(list_sort(list_distinct(list(upper(a.language)) FILTER (WHERE a.language IS NOT NULL))), ',') AS languages, array_to_string(list_sort(list_distinct(list(c.name))), ',') AS sources,
  bool_or(extraction_confidence = 'high') AS curated FROM article_records a JOIN sources c USING (source_id) WHERE story_id IS NOT NULL GROUP BY 1)
SELECT s.story_id, coalesce(languages, '') AS languages, coalesce(sources, '') AS sources, coalesce(curated, false) AS curated, p.n AS total, p.page, p.pages
FROM s CROSS JOIN p LEFT JOIN m ON m.story_id = s.story_id WHERE r > (p.page - 1) * 20 AND r <= p.page * 20""")
def feed_page(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of the feed."""
    held = pages.feed(table(spark, folder, "stories").select("story_id", "last_seen_at"), _members(spark, folder), 2)
    return held.select("story_id", F.array_join("languages", ",").alias("languages"), F.array_join("sources", ",").alias("sources"), "curated", "total", "page", "pages")


@core.query("""
WITH t AS (SELECT count(*) AS n FROM stories), p AS (SELECT n, greatest(1, ceil(n / 25))::INT AS pages FROM t), s AS (SELECT story_id, row_number() OVER (ORDER BY first_seen_at DESC NULLS LAST, story_id DESC) AS r FROM stories)
SELECT story_id, n AS total, pages AS page, pages FROM s CROSS JOIN p WHERE r > (pages - 1) * 25""")
def last_archive_page(spark: SparkSession, folder: str) -> DataFrame:
    """A page far beyond the last one is the last one."""
    order = [F.col("first_seen_at").desc_nulls_last(), F.col("story_id").desc()]
    return pages.page_of(table(spark, folder, "stories"), order, 999_999, 25).select("story_id", "total", "page", "pages")


@core.query("""
WITH a AS (SELECT a.record_id, a.story_id FROM article_records a JOIN sources s ON s.source_id = a.source_id WHERE s.active AND coalesce(a.extraction_confidence <> 'low', true))
SELECT 'sources' AS name, count(*) AS n, sum(source_id)::BIGINT AS ids FROM sources WHERE active UNION ALL SELECT 'articles', count(*), sum(record_id)::BIGINT FROM a
UNION ALL SELECT 'stories', count(*), sum(story_id)::BIGINT FROM stories WHERE story_id IN (SELECT story_id FROM a WHERE story_id IS NOT NULL)""")
def public_rows(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows of each table readers see."""
    granted = {"sources": ["source_id", "name", "domain"], "articles": ["record_id", "story_id", "title"], "stories": ["story_id", "canonical_title"]}
    seen = pages.public_view(table(spark, folder, "article_records"), table(spark, folder, "sources"), table(spark, folder, "stories"), F.col("extraction_confidence") != "low", granted)
    count = lambda name: seen[name].agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(granted[name][0]).cast("bigint").alias("ids"))
    return count("sources").unionByName(count("articles")).unionByName(count("stories"))


@core.query("""
SELECT s.story_id, coalesce(bool_or(a.extraction_confidence = 'low'), false) AS weak FROM stories s LEFT JOIN article_records a ON a.story_id = s.story_id GROUP BY 1""")
def weak_stories(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "stories").select("story_id")
    return pages.flagged(rows, table(spark, folder, "article_records").where("story_id IS NOT NULL"), "story_id", F.col("extraction_confidence") == "low", "weak")


@core.query("SELECT p::INT AS position, source_id, name FROM (SELECT unnest([107, 103, 999, 112, 101]) AS source_id, unnest(range(5)) AS p) i JOIN sources USING (source_id)")
def sources_in_given_order(spark: SparkSession, folder: str) -> DataFrame:
    ids = spark.range(1).select(F.array(*[F.lit(i).cast("bigint") for i in (107, 103, 999, 112, 101)]).alias("ids"))
    return pages.hydrate(ids, table(spark, folder, "sources").select("source_id", "name"), "source_id").select("position", "source_id", "name")


@core.query("SELECT source_id, CASE source_id WHEN 102 THEN 'low' WHEN 105 THEN 'high' ELSE priority END AS priority, CASE source_id WHEN 105 THEN 'xx' ELSE language END AS language FROM sources")
def updated_sources(spark: SparkSession, folder: str) -> DataFrame:
    records = F.lit('[{"source_id": 102, "to": "low"}, {"source_id": 105, "to": "high", "lang": "xx"}, {"source_id": 105, "to": "low"}, {"source_id": 4000, "to": "low"}]')
    rows = table(spark, folder, "sources").select("source_id", "priority", "language")
    return pages.update_from(rows, records, "source_id: bigint, to: string, lang: string", "source_id", {"priority": "to", "language": "lang"})


@core.query("""
SELECT s.story_id, string_agg(a.record_id::VARCHAR, ',' ORDER BY a.fetched_at IS NULL, a.fetched_at, a.record_id) AS reports, coalesce(array_to_string(list_sort(list_distinct(list(upper(a.language)) FILTER (WHERE a.language IS NOT NULL))), ','), '') AS languages,
epoch_us(min(a.fetched_at)) AS first_at, epoch_us(max(a.fetched_at)) AS last_at
FROM stories s LEFT JOIN (SELECT a.* FROM article_records a JOIN sources USING (source_id)) a ON a.story_id = s.story_id WHERE s.curated GROUP BY 1""")
def story_details(spark: SparkSession, folder: str) -> DataFrame:
    """The curated stories with their reports in order of time."""
    held = pages.detail(table(spark, folder, "stories").where("curated").select("story_id"), _members(spark, folder))
    listed = F.array_join(F.transform("reports", lambda r: r["id"].cast("string")), ",")
    return held.select("story_id", listed.alias("reports"), F.coalesce(F.array_join("languages", ","), F.lit("")).alias("languages"), "first_at", "last_at")


@core.query("""
WITH m AS (SELECT a.source_id, unnest(s.district_names) AS district FROM article_records a JOIN stories s ON s.story_id = a.story_id)
SELECT district, c.name AS source, count(*) AS n FROM m JOIN sources c ON c.source_id = m.source_id GROUP BY ALL""")
def district_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Which sources report on each district, and how often."""
    places = table(spark, folder, "stories").select("story_id", F.explode("district_names").alias("district"))
    rows = _members(spark, folder).join(places, "story_id").select(F.struct("district", "source").alias("pair"))
    return pages.coverage(rows, "pair").select("pair.district", "pair.source", "n")


@core.query("""
WITH a AS (SELECT record_id, story_id FROM article_records WHERE source_id = 101 ORDER BY fetched_at DESC NULLS LAST, record_id DESC LIMIT 100), d AS (SELECT story_id, unnest(district_names) AS district FROM stories)
SELECT count(DISTINCT a.record_id) AS articles, count(DISTINCT s.story_id) AS stories, count(DISTINCT d.district) AS districts FROM a LEFT JOIN stories s ON s.story_id = a.story_id LEFT JOIN d ON d.story_id = a.story_id""")
def source_page(spark: SparkSession, folder: str) -> DataFrame:
    """What a source's newest hundred articles cover."""
    articles = table(spark, folder, "article_records").withColumn("story_id", F.col("story_id").cast("bigint"))
    known = table(spark, folder, "stories").select("story_id")
    kept = articles.join(known, "story_id", "left_semi").unionByName(articles.join(known, "story_id", "left_anti").withColumn("story_id", F.lit(None).cast("bigint")))
    return pages.source_sample(kept, table(spark, folder, "stories"), 101)


_LATEST = "SELECT queue_id, source_id, status, processing_attempts, last_error, created_at, updated_at, priority FROM (SELECT *, row_number() OVER (PARTITION BY queue_id ORDER BY created_at DESC, status DESC, url DESC, last_error DESC) AS r FROM crawl_queue) WHERE r = 1"


def _latest(spark: SparkSession, folder: str) -> DataFrame:
    """Each queue row as it was delivered last."""
    rows = table(spark, folder, "crawl_queue").select("queue_id", "source_id", "status", F.col("processing_attempts").alias("attempts"), "last_error", "created_at", "updated_at", "priority", "url")
    best = rows.groupBy("queue_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "queue_id"]), F.struct("created_at", "status", "url", "last_error")).alias("m"))
    return best.select("queue_id", "m.*")


@core.query(f"""
WITH l AS ({_LATEST}), w AS (SELECT source_id, max(CASE status WHEN 'blocked' THEN 'BLOCKED' WHEN 'failed' THEN 'FAILED' END) AS state FROM l WHERE created_at > TIMESTAMPTZ '2026-06-01 00:00:00+00' GROUP BY 1)
SELECT coalesce(state, 'UNKNOWN') AS state, count(*) AS n FROM sources s LEFT JOIN w ON w.source_id = s.source_id GROUP BY 1""")
def source_states(spark: SparkSession, folder: str) -> DataFrame:
    """The worst state of each source's rows of the last days; sources without any are unknown."""
    late = _latest(spark, folder).where(F.col("created_at") > F.lit("2026-06-01 00:00:00").cast("timestamp"))
    worst = late.groupBy("source_id").agg(F.max(F.when(F.col("status") == "blocked", "BLOCKED").when(F.col("status") == "failed", "FAILED")).alias("state"))
    return pages.state_counts(table(spark, folder, "sources"), worst, "source_id", "state")


@core.query("""
WITH c AS (SELECT q.source_id, epoch_us(max(f.fetched_at)) AS last_check FROM fetch_results f JOIN (SELECT DISTINCT queue_id, source_id FROM crawl_queue) q USING (queue_id) GROUP BY 1)
SELECT s.source_id, last_check FROM sources s LEFT JOIN c ON c.source_id = s.source_id WHERE s.active ORDER BY last_check ASC NULLS FIRST, s.source_id LIMIT 10""")
def sources_due(spark: SparkSession, folder: str) -> DataFrame:
    """The ten active sources that wait longest for a check."""
    ids = table(spark, folder, "crawl_queue").select("queue_id", "source_id").distinct()
    checks = table(spark, folder, "fetch_results").select("queue_id", F.unix_micros("fetched_at").alias("at")).join(ids, "queue_id")
    return pages.due(table(spark, folder, "sources"), checks, "source_id", "at", 10)


_RANK = "CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 9 END"


@core.query(f"""
WITH l AS ({_LATEST}), t AS (SELECT queue_id FROM l WHERE status IN ('queued', 'retry') ORDER BY {_RANK}, created_at, queue_id LIMIT 50)
SELECT CASE WHEN t.queue_id IS NOT NULL THEN 'fetching' ELSE status END AS status, count(*) AS n, sum(processing_attempts + CASE WHEN t.queue_id IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS attempts
FROM l LEFT JOIN t ON t.queue_id = l.queue_id GROUP BY 1""")
def claimed_queue(spark: SparkSession, folder: str) -> DataFrame:
    """The queue after fifty rows were claimed, by state."""
    rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).when(F.col("priority") == "low", 2).otherwise(9)
    held = queue.claim(_latest(spark, folder), F.col("status").isin("queued", "retry"), [rank, F.col("created_at"), F.col("queue_id")], 50, "fetching", _now())
    return held.groupBy("status").agg(F.count("*").alias("n"), F.sum("attempts").cast("bigint").alias("attempts"))


@core.query(f"""
WITH l AS ({_LATEST}), o AS (SELECT queue_id, max(struct_pack(at := fetched_at, s := coalesce(status, 0))).s AS s FROM fetch_results GROUP BY 1),
d AS (SELECT l.*, o.s, CASE WHEN o.queue_id IS NULL THEN NULL WHEN s BETWEEN 200 AND 299 THEN 'success' WHEN s IN (408, 429) OR s BETWEEN 500 AND 599 THEN 'retry' WHEN s IN (404, 410) THEN 'permanent'
  WHEN s IN (401, 403) THEN 'blocked' WHEN s BETWEEN 400 AND 499 THEN 'permanent' ELSE 'retry' END AS d FROM l LEFT JOIN o ON o.queue_id = l.queue_id)
SELECT CASE WHEN d IS NULL THEN status WHEN d = 'success' THEN 'fetched' WHEN d = 'retry' AND processing_attempts >= 2 THEN 'failed' WHEN d = 'retry' THEN 'retry' WHEN d = 'permanent' THEN 'failed' ELSE 'blocked' END AS status,
  count(*) AS n, count(CASE WHEN d = 'retry' AND processing_attempts < 2 THEN 1 END) AS waiting,
  sum(CASE WHEN d = 'retry' AND processing_attempts < 2 THEN least(60 * pow(2, greatest(processing_attempts, 1) - 1), 3600) ELSE 0 END)::BIGINT AS seconds,
  count(CASE WHEN d = 'retry' AND processing_attempts >= 2 THEN 1 END) AS exhausted
FROM d GROUP BY 1""")
def recorded_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """The queue after the last fetch of each row was entered, by state."""
    rows = _latest(spark, folder).withColumn("next_at", F.lit(None).cast("timestamp")).withColumn("last_error", F.lit(None).cast("string"))
    outcomes = table(spark, folder, "fetch_results").select("queue_id", F.col("fetched_at").alias("at"), "status", F.lit(None).cast("string").alias("error"))
    held = queue.record(rows, outcomes, _now(), {"success": "fetched", "retry": "retry", "permanent": "failed", "blocked": "blocked", "exhausted": "failed"}, 2)
    wait = (F.unix_micros("next_at") - F.unix_micros(_now())) / 1_000_000
    return held.groupBy("status").agg(
        F.count("*").alias("n"), F.count("next_at").alias("waiting"), F.coalesce(F.sum(wait), F.lit(0)).cast("bigint").alias("seconds"), F.count(F.when(F.col("last_error").startswith("attempts-exhausted: "), 1)).alias("exhausted")
    )


@core.query("""
SELECT strftime((fetched_at AT TIME ZONE 'UTC')::DATE, '%Y-%m-%d') AS run, count(*) AS "all", count(*) FILTER (WHERE outcome = 'success') AS success, count(*) FILTER (WHERE outcome = 'retry') AS retry,
count(*) FILTER (WHERE outcome = 'permanent') AS permanent, count(*) FILTER (WHERE outcome = 'blocked') AS blocked FROM fetch_results GROUP BY 1""")
def fetch_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes of each day's fetches."""
    return queue.run_counters(table(spark, folder, "fetch_results"), F.date_format("fetched_at", "yyyy-MM-dd"), "outcome", ["success", "retry", "permanent", "blocked"])


@core.query("""
SELECT CASE WHEN coalesce(trim(title), '') = '' THEN 'title' WHEN coalesce(length(body), 0) < 50 THEN 'body' WHEN coalesce(extraction_confidence IN ('high', 'medium'), false) THEN NULL ELSE 'confidence' END AS rejected, count(*) AS n
FROM article_records GROUP BY 1""")
def rejected_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Why articles don't pass a gate of three checks."""
    checks = {"title": F.trim("title") != "", "body": F.length("body") >= 50, "confidence": F.col("extraction_confidence").isin("high", "medium")}
    return queue.gate(table(spark, folder, "article_records"), checks).groupBy("rejected").agg(F.count("*").alias("n"))


@core.query("SELECT record_id, strftime(fetched_at AT TIME ZONE 'Asia/Kolkata', '%d %b, %H:%M') AS stamp FROM article_records")
def fetch_stamps(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "article_records").select("record_id", codes.format_stamp(F.col("fetched_at")).alias("stamp"))


@core.query("""
SELECT s.source_id, coalesce(arg_max(title_rendered, (received_at, post_id)), 'none') AS title_rendered FROM sources s LEFT JOIN wp_posts w ON w.source_id = s.source_id GROUP BY 1""")
def latest_posts(spark: SparkSession, folder: str) -> DataFrame:
    """The title of each source's latest post."""
    return windows.latest_or(table(spark, folder, "sources").select("source_id"), table(spark, folder, "wp_posts").where("title_rendered IS NOT NULL"), "source_id", [F.col("received_at"), F.col("post_id")], "title_rendered", "none")


@core.query("""
WITH k AS (SELECT canonical_name, min(knowledge_id) AS knowledge_id FROM knowledge_entities WHERE entity_no % 2 = 0 AND canonical_name IS NOT NULL GROUP BY 1), n AS (SELECT canonical_name, min(knowledge_id) AS knowledge_id FROM knowledge_entities WHERE canonical_name IS NOT NULL GROUP BY 1)
SELECT canonical_name, knowledge_id FROM k UNION ALL SELECT canonical_name, knowledge_id FROM n WHERE canonical_name NOT IN (SELECT canonical_name FROM k)""")
def upserted_entities(spark: SparkSession, folder: str) -> DataFrame:
    """The entities of even number as the known ones, and all of them upserted."""
    rows = table(spark, folder, "knowledge_entities").where("canonical_name IS NOT NULL")
    known = rows.where("entity_no % 2 = 0").groupBy("canonical_name").agg(F.min("knowledge_id").alias("knowledge_id"))
    return sinks.upsert_entities(known, rows)


@core.query("""
WITH w AS (SELECT a.record_id, s.story_id, list_distinct(regexp_extract_all(lower(coalesce(canonical_title, '')), '([a-z]+|[ऀ-ॿ]+)', 1)) AS x, list_distinct(regexp_extract_all(lower(coalesce(title, '')), '([a-z]+|[ऀ-ॿ]+)', 1)) AS y
FROM article_records a JOIN stories s ON s.story_id = a.story_id)
SELECT record_id, round(CASE WHEN len(x) > 0 AND len(y) > 0 THEN 2 * len(list_intersect(x, y)) / (len(x) + len(y)) ELSE 0 END, 6) AS dice FROM w""")
def title_dice(spark: SparkSession, folder: str) -> DataFrame:
    """How alike the words of an article's title and of its story's are."""
    titles = table(spark, folder, "stories").select("story_id", "canonical_title")
    rows = table(spark, folder, "article_records").select("record_id", "title", F.col("story_id").cast("bigint").alias("story_id")).join(titles, "story_id")
    return rows.select("record_id", F.round(cluster.dice(text.tokens(F.col("canonical_title")), text.tokens(F.col("title"))), 6).alias("dice"))


@core.query("""
SELECT count(*) FILTER (WHERE expires_at <= TIMESTAMPTZ '2026-06-15 12:00:00+00') AS deleted, count(*) FILTER (WHERE expires_at IS NULL OR expires_at > TIMESTAMPTZ '2026-06-15 12:00:00+00') AS remaining,
count(*) FILTER (WHERE keep_reason IS NOT NULL) AS exempt FROM temp_documents""")
def retention_report(spark: SparkSession, folder: str) -> DataFrame:
    return retention.report(table(spark, folder, "temp_documents"), _now())


_NAMES = "SELECT DISTINCT concat('e', entity_no) AS entity, unnest(list_concat([canonical_name], coalesce(aliases, []), coalesce(hindi_names, []), coalesce(romanisations, []))) AS name FROM knowledge_entities UNION SELECT DISTINCT concat('p ', d), d FROM (SELECT unnest(district_names) AS d FROM stories)"
_BARE = "concat(' ', trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g')), ' ')"
_MENTIONS = f"""WITH n AS ({_NAMES}), s AS (SELECT DISTINCT entity, {_BARE.format(c="name")} AS surface FROM n WHERE name IS NOT NULL), t AS (SELECT record_id, story_id, {_BARE.format(c="concat_ws(chr(10), title, body)")} AS t FROM article_records),
m AS (SELECT DISTINCT record_id, story_id, entity FROM t JOIN s ON contains(t.t, s.surface) WHERE trim(surface) <> '')"""


def _names(spark: SparkSession, folder: str) -> DataFrame:
    """entity, name: the dictionary's entities with all their names, and the places of the stories."""
    rows = table(spark, folder, "knowledge_entities")
    every = F.concat(F.array("canonical_name"), *[F.coalesce(c, F.array().cast("array<string>")) for c in ("aliases", "hindi_names", "romanisations")])
    known = rows.select(F.concat(F.lit("e"), F.col("entity_no").cast("string")).alias("entity"), F.explode(every).alias("name"))
    places = table(spark, folder, "stories").select(F.explode("district_names").alias("name")).distinct().select(F.concat(F.lit("p "), "name").alias("entity"), "name")
    return known.unionByName(places)


def _mentions(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "article_records").select("record_id", F.concat_ws("\n", "title", "body").alias("t"))
    return lexicon.mentions(texts, _names(spark, folder), "record_id", "t")


@core.query(f"{_MENTIONS} SELECT record_id, entity FROM m")
def entity_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Entities and places that each article names in its title or body."""
    return _mentions(spark, folder)


@core.query(f"{_MENTIONS} SELECT story_id::BIGINT AS story_id, entity AS name, count(*) AS n FROM m WHERE story_id IS NOT NULL GROUP BY ALL")
def story_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """In how many reports of a story each entity is named."""
    rows = table(spark, folder, "article_records").where("story_id IS NOT NULL").select("record_id", F.col("story_id").cast("bigint").alias("story_id"))
    named = _mentions(spark, folder).join(rows, "record_id").select("story_id", F.array("entity").alias("names"))
    return pages.mention_counts(named, "story_id", "names")


@core.query()
def article_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The entities that each article names, where, and which of them count with three of a family."""
    kinds = table(spark, folder, "knowledge_entities").select(F.concat(F.lit("e"), F.col("entity_no").cast("string")).alias("entity"), F.col("entity_type").alias("family"))
    entities = _names(spark, folder).groupBy("entity").agg(F.collect_set("name").alias("names"))  # the names of one entity
    entities = entities.join(kinds, "entity", "left").withColumn("family", F.coalesce("family", F.lit("story-place")))
    return evidence.collect(table(spark, folder, "article_records"), entities, "record_id", "title", "body", {"story-place": 3})


@core.query()
def page_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Body of each kept page and the stage that gave it."""
    rows = table(spark, folder, "temp_documents").where("raw_html IS NOT NULL").select("temp_id", "raw_html", F.lower(F.parse_url("url", F.lit("HOST"))).alias("site"))
    return extract.bodies(rows, "raw_html", "site").select("temp_id", "stage", "body")


@core.query(f"""
WITH m AS (SELECT a.story_id, bool_or(contains({_norm('a.title')}, 'in') OR contains({_norm('c.name')}, 'in') OR contains({_norm('c.domain')}, 'in')) AS h, bool_or(a.language = 'en') AS en
  FROM article_records a JOIN sources c USING (source_id) WHERE c.active AND a.story_id IS NOT NULL AND coalesce(a.extraction_confidence, '') <> 'failed' GROUP BY a.story_id),
s AS (SELECT s.story_id, contains({_norm('s.canonical_title')}, 'in') AS title_match, first_seen_at FROM stories s JOIN m ON m.story_id = s.story_id
  WHERE en AND first_seen_at >= TIMESTAMPTZ '2026-01-01 00:00:00+05:30' AND first_seen_at < TIMESTAMPTZ '2027-01-01 00:00:00+05:30' AND (contains({_norm('s.canonical_title')}, 'in') OR contains({_norm('s.primary_category')}, 'in') OR h))
SELECT story_id, title_match FROM s ORDER BY coalesce(title_match, false) DESC, first_seen_at DESC NULLS LAST, story_id DESC LIMIT 10 OFFSET 5""")
def search_page(spark: SparkSession, folder: str) -> DataFrame:
    """Stories of a year with an English report that hold a token, the second ten by rank from the sixth."""
    sources = table(spark, folder, "sources").select("source_id", F.col("name").alias("source_name"), F.col("domain").alias("source_domain"))
    members = serve.visible(table(spark, folder, "article_records"), table(spark, folder, "sources")).where("story_id IS NOT NULL").join(sources, "source_id")
    members = members.select(F.col("story_id").cast("bigint").alias("story_id"), F.col("title").alias("headline"), "language", "source_name", "source_domain", F.lit(None).cast("array<string>").alias("entities"))
    found = serve.search(table(spark, folder, "stories"), members, ["in"], language="en", year=2026, limit=10, offset=5)
    return found.select("story_id", "title_match")


@core.query("""
WITH r AS (SELECT split_part(lower(trim(a.language)), '-', 1) = s.language AS ok FROM article_records a JOIN sources s USING (source_id) WHERE s.language IS NOT NULL),
v AS (SELECT count(*) FILTER (WHERE ok) AS k, count(*) AS n FROM r)
SELECT unnest(['language.right', 'language.n', 'language.accuracy']) AS metric, unnest([k::DOUBLE, n::DOUBLE, CASE WHEN n > 0 THEN round(k / n, 3) ELSE 1 END]) AS value,
unnest([k >= 0.9, n >= 0.9, CASE WHEN n > 0 THEN round(k / n, 3) ELSE 1 END >= 0.9]) AS passed FROM v""")
def label_report(spark: SparkSession, folder: str) -> DataFrame:
    """How often a record's language is its source's, as a report of metrics."""
    rows = table(spark, folder, "article_records").select("source_id", F.substring_index(F.lower(F.trim("language")), "-", 1).alias("said")).join(table(spark, folder, "sources").select("source_id", F.col("language").alias("truth")), "source_id")
    return evaluate.report({"language": evaluate.accuracy(rows, "truth", "said")})


_STOP = ", ".join(f"'{w}'" for w in sorted({*languages.ENGLISH, *languages.HINDI}))


@core.query(f"""
WITH f AS (SELECT story_id, arg_min(record_id, (fetched_at, record_id)) AS first FROM article_records WHERE story_id IS NOT NULL AND fetched_at IS NOT NULL AND body IS NOT NULL GROUP BY 1),
p AS (SELECT DISTINCT a.record_id AS id, f.first FROM article_records a JOIN f ON f.story_id = a.story_id WHERE a.record_id <> f.first AND a.body IS NOT NULL),
w AS (SELECT record_id, unnest(list_filter(regexp_extract_all(lower(body), '([a-z]+|[ऀ-ॿ]+)', 1), lambda x: x NOT IN ({_STOP}))) AS t FROM article_records WHERE body IS NOT NULL),
c AS (SELECT record_id, t, count(*) AS n FROM w GROUP BY ALL), l AS (SELECT record_id, sqrt(sum(n * n)) AS l, sum(n) AS words FROM c GROUP BY 1),
d AS (SELECT p.id, p.first, sum(a.n * b.n) AS dot FROM p JOIN c a ON a.record_id = p.id JOIN c b ON b.record_id = p.first AND b.t = a.t GROUP BY ALL)
SELECT p.id, p.first, CASE WHEN coalesce(x.words, 0) < 10 OR coalesce(y.words, 0) < 10 THEN 'insufficient' WHEN round(coalesce(dot / (x.l * y.l), 0), 3) >= 0.6 THEN 'near' ELSE 'different' END AS verdict
FROM p LEFT JOIN d ON d.id = p.id AND d.first = p.first LEFT JOIN l x ON x.record_id = p.id LEFT JOIN l y ON y.record_id = p.first""")
def report_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """How each report of a story compares with the story's first."""
    rows = table(spark, folder, "article_records").where("story_id IS NOT NULL AND body IS NOT NULL").select(F.col("record_id").alias("id"), "story_id", "fetched_at", "body")
    first = rows.where("fetched_at IS NOT NULL").groupBy("story_id").agg(F.min(F.struct("fetched_at", F.col("id").alias("first"), F.col("body").alias("first_body"))).alias("m"))
    pairs = rows.join(first, "story_id").select("id", "body", "m.first", "m.first_body").where("id != first")
    return dedup.compare_texts(pairs, "body", "first_body").select("id", "first", "verdict").distinct()
