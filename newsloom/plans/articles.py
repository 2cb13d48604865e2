"""Queries on text functions, keys and duplicates of articles and documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import codes, languages, text, urls
from newsloom.operators import dedup, evaluate, extract, lexicon, models, windows
from newsloom.plans.registry import core
from newsloom.sources import sinks, table

_SP = r"[\s  -     　]+"
_HEAD = "lower(regexp_replace(coalesce({c}, ''), '^[\\s ]+|[\\s ]+$', '', 'g'))"


def _headline_sql(c: str) -> str:
    said = _HEAD.format(c=c)
    for s in text.SEPARATORS:
        said = f"split_part({said}, '{s}', 1)"
    return f"trim(regexp_replace(regexp_replace({said}, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '{_SP}', ' ', 'g'))"


def _collapsed_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_SP}', ' ', 'g'))"


def _content_sql(c: str) -> str:
    return f"CASE WHEN length({_collapsed_sql(c)}) >= 50 THEN sha256({_collapsed_sql(c)}) END"


def _headline_hash_sql(c: str) -> str:
    return f"CASE WHEN {_headline_sql(c)} <> '' THEN sha256({_headline_sql(c)}) END"


@core.query(f"SELECT record_id, {_content_sql('body')} AS content_hash, {_headline_hash_sql('title')} AS headline_hash FROM article_records")
def article_keys(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "article_records").select("record_id", text.content_hash(F.col("body")).alias("content_hash"), text.headline_hash(F.col("title")).alias("headline_hash"))


@core.query(f"SELECT record_id, {_headline_sql('title')} AS headline FROM article_records")
def headline_norm(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "article_records").select("record_id", text.normalise_headline(F.col("title")).alias("headline"))


@core.query("""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '([a-z]+|[ऀ-ॿ]+)', 1) AS w FROM documents)
SELECT doc_id, len(w)::BIGINT AS tokens, len(list_distinct(w))::BIGINT AS terms FROM t""")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    words = text.tokens(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.size(words).cast("bigint").alias("tokens"), F.size(F.array_distinct(words)).cast("bigint").alias("terms"))


@core.query("""
WITH t AS (SELECT record_id, regexp_extract_all(lower(coalesce(title, '')), '([a-z]+|[ऀ-ॿ]+)', 1) AS w FROM article_records),
s AS (SELECT record_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM t)
SELECT record_id, len(s)::BIGINT AS shingles, array_to_string(list_sort(s), '|') AS listed FROM s""")
def title_shingles(spark: SparkSession, folder: str) -> DataFrame:
    runs = text.shingles(text.tokens(F.col("title")), 3)
    return table(spark, folder, "article_records").select("record_id", F.size(runs).cast("bigint").alias("shingles"), F.array_join(F.array_sort(runs), "|").alias("listed"))


@core.query("""
SELECT record_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(
  translate(coalesce(title, ''), '०१२३४५६७८९٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '012345678901234567890123456789'), '([0-9][0-9,]*)', 1), lambda x: replace(x, ',', '')))), ' ') AS numbers
FROM article_records""")
def title_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "article_records").select("record_id", F.array_join(F.array_sort(text.numbers(F.col("title"))), " ").alias("numbers"))


@core.query("""
WITH c AS (SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^A-Za-zÀ-ɏḀ-ỿ]', '', 'g')) AS l, length(regexp_replace(coalesce(text, ''), '[^ऀ-ॿ]', '', 'g')) AS d,
  length(regexp_replace(coalesce(text, ''), '[^؀-ۿݐ-ݿﭐ-﷿ﹰ-\\x{FEFF}]', '', 'g')) AS a FROM documents)
SELECT doc_id, CASE WHEN l + d + a > 0 THEN round(l / (l + d + a), 6) END AS latn, CASE WHEN l + d + a > 0 THEN round(d / (l + d + a), 6) END AS deva,
  CASE WHEN l + d + a > 0 THEN round(a / (l + d + a), 6) END AS arab FROM c""")
def script_mix(spark: SparkSession, folder: str) -> DataFrame:
    mix = text.script_shares(F.col("text"))
    share = lambda s: F.when(mix.isNotNull(), F.round(F.coalesce(mix[s], F.lit(0.0)), 6)).alias(s.lower())
    return table(spark, folder, "documents").select("doc_id", share("Latn"), share("Deva"), share("Arab"))


@core.query(r"""
WITH p AS (SELECT queue_id, trim(url) AS u FROM crawl_queue),
q AS (SELECT queue_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
  regexp_replace(regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*:/*', ''), '#.*$', '') AS rest FROM p),
r AS (SELECT queue_id, scheme, regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), CASE WHEN scheme = 'http' THEN ':80$' ELSE ':443$' END, '') AS h,
  regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/amp/?$', '') AS path,
  list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN
  ('utm_source','utm_medium','utm_campaign','utm_content','utm_term','fbclid','gclid','gclsrc','amp') AND lower(x) <> 'output=1') AS kept FROM q),
s AS (SELECT *, CASE WHEN length(path) > 1 THEN regexp_replace(path, '/$', '') ELSE path END AS bare FROM r)
SELECT queue_id, CASE WHEN scheme IN ('http', 'https') AND h <> '' THEN concat(scheme, '://', h, CASE WHEN bare = '' THEN '/' ELSE bare END,
  CASE WHEN len(kept) > 0 THEN concat('?', array_to_string(list_transform(list_sort(list_transform(kept, lambda x: [split_part(x, '=', 1), x])), lambda x: x[2]), '&')) ELSE '' END) END AS canonical FROM s""")
def url_normalise(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "crawl_queue").select("queue_id", urls.normalise_url(F.col("url")).alias("canonical"))


@core.query("""
SELECT record_id, CASE WHEN regexp_replace(lower(regexp_extract(canonical_url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\\.', '') =
  regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\\.', '') THEN canonical_url END AS canonical FROM article_records""")
def trusted_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "article_records").select("record_id", urls.trusted_canonical(F.col("canonical_url"), F.col("url")).alias("canonical"))


_KEYS = f"SELECT record_id AS id, source_id, coalesce(nullif(canonical_url, ''), url) AS u, {_content_sql('body')} AS c, {_headline_hash_sql('title')} AS h, batch_no FROM article_records"
_KNOWN = f"SELECT known_id AS id, source_id, canonical_url AS u, {_content_sql('body')} AS c, {_headline_hash_sql('headline')} AS h FROM known_articles"


def _article_keys(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "article_records").withColumnRenamed("record_id", "id")
    return dedup.with_keys(rows, "url", "canonical_url", "title", "body").select("id", "source_id", "batch_no", "canonical_key", "content_key", "headline_key")


@core.query(f"""
WITH n AS ({_KEYS}), k AS ({_KNOWN}),
ku AS (SELECT u, min(id) AS o FROM k WHERE u IS NOT NULL GROUP BY u), kc AS (SELECT c, min(id) AS o FROM k WHERE c IS NOT NULL GROUP BY c),
kh AS (SELECT source_id, h, min(id) AS o FROM k WHERE h IS NOT NULL GROUP BY source_id, h)
SELECT n.id AS id, coalesce(ku.o, kc.o, kh.o) AS duplicate_of, CASE WHEN ku.o IS NOT NULL THEN 'canonical_url' WHEN kc.o IS NOT NULL THEN 'content_hash' ELSE 'headline_hash' END AS rule
FROM n LEFT JOIN ku USING (u) LEFT JOIN kc USING (c) LEFT JOIN kh ON n.source_id = kh.source_id AND n.h = kh.h WHERE coalesce(ku.o, kc.o, kh.o) IS NOT NULL""")
def exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "known_articles").withColumnRenamed("known_id", "id")
    known = dedup.with_keys(known.withColumn("url", F.col("canonical_url")), "url", "canonical_url", "headline", "body")
    return dedup.exact_duplicates(_article_keys(spark, folder), known)


@core.query()
def batch_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.batch_duplicates(_article_keys(spark, folder))


@core.query()
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of known articles and records of near word counts, by bands of a minimum hash signature."""
    known = table(spark, folder, "known_articles").select(F.col("known_id").alias("id"), "body")
    rows = known.unionByName(table(spark, folder, "article_records").select(F.col("record_id").alias("id"), "body"))
    return dedup.near_duplicates(dedup.with_signature(rows, "body"))


@core.query("""
WITH p AS (SELECT regexp_replace(last_error, '^attempts-exhausted:\\s*', '') AS r, last_error, source_id FROM crawl_queue WHERE coalesce(last_error, '') <> '')
SELECT source_id, CASE WHEN regexp_matches(r, '^http-40[13]\\b') THEN 'blocked403' WHEN regexp_matches(r, '^http-429\\b') THEN 'rateLimited429' WHEN regexp_matches(r, '^http-408\\b') THEN 'timeout'
 WHEN regexp_matches(r, '^http-5\\d\\d\\b') THEN 'serverError' WHEN regexp_matches(r, '^http-4\\d\\d\\b') THEN 'permanent'
 WHEN regexp_matches(lower(r), 'timeout|timed out|network-error|unknown-error|econn|enotfound|eai_again|socket hang up') THEN 'timeout' ELSE 'other' END AS kind, count(*) AS n
FROM p GROUP BY ALL""")
def failure_kinds(spark: SparkSession, folder: str) -> DataFrame:
    kind = codes.failure_kind(F.col("last_error"))
    return table(spark, folder, "crawl_queue").select("source_id", kind.alias("kind")).where("kind IS NOT NULL").groupBy("source_id", "kind").agg(F.count("*").alias("n"))


@core.query("""
SELECT fetch_id, CASE WHEN status BETWEEN 200 AND 299 THEN 'success' WHEN status IN (408, 429) OR status BETWEEN 500 AND 599 THEN 'retry' WHEN status IN (404, 410) THEN 'permanent'
 WHEN status IN (401, 403) THEN 'blocked' WHEN status BETWEEN 400 AND 499 THEN 'permanent' WHEN status IS NOT NULL THEN 'retry' END AS decision,
 lower(trim(split_part(coalesce(content_type, ''), ';', 1))) AS type FROM fetch_results""")
def http_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "fetch_results").select("fetch_id", codes.http_decision(F.col("status")).alias("decision"), codes.content_type(F.col("content_type")).alias("type"))


@core.query("""
SELECT queue_id, least(60 * pow(2, greatest(processing_attempts, 1) - 1), 3600)::BIGINT AS wait FROM crawl_queue""")
def backoff(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "crawl_queue").select("queue_id", codes.backoff(F.col("processing_attempts")).alias("wait"))


@core.query("""
WITH u AS (SELECT canonical_url AS k, min(known_id) AS id FROM known_articles GROUP BY 1),
n AS (SELECT coalesce(nullif(canonical_url, ''), url) AS k, min(record_id) AS id FROM article_records WHERE coalesce(nullif(canonical_url, ''), url) IS NOT NULL GROUP BY 1)
SELECT k, id FROM u UNION ALL SELECT k, id FROM n WHERE k NOT IN (SELECT k FROM u)""")
def insert_ignore(spark: SparkSession, folder: str) -> DataFrame:
    old = table(spark, folder, "known_articles").select(F.col("canonical_url").alias("k"), F.col("known_id").alias("id"))
    new = table(spark, folder, "article_records").select(F.coalesce(F.nullif("canonical_url", F.lit("")), "url").alias("k"), F.col("record_id").alias("id"))
    return sinks.insert_ignore(old, new, "k", ["id"])


@core.query("""
WITH o AS (SELECT url, max(body) AS body, max(keep_reason) AS keep_reason FROM temp_documents WHERE article_id IS NULL GROUP BY url),
n AS (SELECT url, max(body) AS body, max(keep_reason) AS keep_reason FROM temp_documents WHERE article_id IS NOT NULL GROUP BY url)
SELECT coalesce(o.url, n.url) AS url, coalesce(n.body, o.body) AS body, coalesce(o.keep_reason, n.keep_reason) AS keep_reason FROM o FULL JOIN n ON o.url = n.url""")
def upsert_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that led to an article merged into those that didn't, by address."""
    rows = table(spark, folder, "temp_documents")
    part = lambda c: rows.where(c).groupBy("url").agg(F.max("body").alias("body"), F.max("keep_reason").alias("keep_reason"))
    return sinks.upsert(part("article_id IS NULL"), part("article_id IS NOT NULL"), "url", keep_old=("keep_reason",))


@core.query("""
WITH r AS (SELECT record_id, split_part(lower(trim(language)), '-', 1) AS said, d.truth FROM article_records JOIN (SELECT source_id, language AS truth FROM sources) d USING (source_id)),
t AS (SELECT truth AS label, count(*) AS support FROM r WHERE truth IS NOT NULL GROUP BY 1), p AS (SELECT said AS label, count(*) AS said FROM r WHERE said IS NOT NULL GROUP BY 1),
b AS (SELECT truth AS label, count(*) AS r FROM r WHERE truth = said GROUP BY 1),
c AS (SELECT coalesce(t.label, p.label) AS label, coalesce(support, 0) AS support, coalesce(said, 0) AS said, coalesce(r, 0) AS hits FROM t FULL JOIN p ON t.label = p.label LEFT JOIN b ON b.label = coalesce(t.label, p.label))
SELECT label, support, said, round(CASE WHEN said > 0 THEN hits / said ELSE 1 END, 6) AS "precision", round(CASE WHEN support > 0 THEN hits / support ELSE 1 END, 6) AS recall FROM c""")
def label_scores(spark: SparkSession, folder: str) -> DataFrame:
    """How well the language of a source tells that of its records."""
    rows = table(spark, folder, "article_records").select("source_id", F.substring_index(F.lower(F.trim("language")), "-", 1).alias("guess"))
    rows = rows.join(table(spark, folder, "sources").select("source_id", F.col("language").alias("truth")), "source_id")
    r6 = lambda c: F.round(F.col(c).cast("double"), 6).alias(c)
    return evaluate.scores(rows, "truth", "guess").select("label", "support", "said", r6("precision"), r6("recall"))


@core.query("""
WITH p AS (SELECT story_id AS t, source_id AS s FROM article_records WHERE story_id IS NOT NULL),
a AS (SELECT coalesce(sum(n * (n - 1) // 2), 0) AS v FROM (SELECT count(*) AS n FROM p GROUP BY t)), b AS (SELECT coalesce(sum(n * (n - 1) // 2), 0) AS v FROM (SELECT count(*) AS n FROM p GROUP BY s)),
c AS (SELECT coalesce(sum(n * (n - 1) // 2), 0) AS v FROM (SELECT count(*) AS n FROM p GROUP BY t, s))
SELECT a.v::BIGINT AS truth, b.v::BIGINT AS said, c.v::BIGINT AS "both", CASE WHEN b.v > 0 THEN round(c.v / b.v, 6) ELSE 1 END AS "precision", CASE WHEN a.v > 0 THEN round(c.v / a.v, 6) ELSE 1 END AS recall FROM a, b, c""")
def cluster_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records of one story against pairs of one source."""
    rows = table(spark, folder, "article_records").where("story_id IS NOT NULL")
    return evaluate.cluster_pairs(rows, "story_id", "source_id")


@core.query("""
SELECT queue_id, arg_max(status, (created_at, status)) AS status, count(*) AS deliveries FROM crawl_queue GROUP BY queue_id""")
def latest_delivery(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "crawl_queue").select("queue_id", "status", "created_at")
    newest = windows.latest(rows, ["queue_id"], [F.col("created_at"), F.col("status")])
    return newest.select("queue_id", "status").join(rows.groupBy("queue_id").agg(F.count("*").alias("deliveries")), "queue_id")


def _profile_sql(code: str) -> str:
    words_ = ", ".join(f"'{w}'" for w in languages.PROFILES[code][1])
    return f"len(list_filter(w, lambda x: x IN ({words_})))"


@core.query(f"""
WITH t AS (SELECT record_id, list_transform(regexp_extract_all(lower(coalesce(body, '')), '([a-z]+|[ऀ-ॿ]+)', 1), lambda x: regexp_replace(x, '[।॥]+$', '')) AS w FROM article_records)
SELECT record_id, {_profile_sql('en')}::BIGINT AS en, {_profile_sql('hi')}::BIGINT AS hi FROM t""")
def function_word_hits(spark: SparkSession, folder: str) -> DataFrame:
    by = languages.hits(F.col("body"))
    return table(spark, folder, "article_records").select("record_id", *[n.cast("bigint").alias(code) for code, n in by.items()])


@core.query()
def detected_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language and confidence of each body by function words."""
    return table(spark, folder, "article_records").select("record_id", languages.detect(F.col("body")).alias("d")).select("record_id", "d.language", "d.confidence")


@core.query("""
WITH t AS (SELECT record_id, regexp_extract_all(lower(coalesce(title, '')), '([a-z]+|[ऀ-ॿ]+)', 1) AS w FROM article_records),
c AS (SELECT record_id, term, count(*) AS tf FROM (SELECT record_id, unnest(w) AS term FROM t) GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
r AS (SELECT record_id, term, (1 + ln(tf)) * (1 + ln((1 + (SELECT count(*) FROM article_records)) / (1 + df))) AS w FROM c JOIN d USING (term)), n AS (SELECT record_id, sqrt(sum(w * w)) AS l FROM r GROUP BY 1)
SELECT record_id, term, round(w / l, 6) AS weight FROM r JOIN n USING (record_id)""")
def title_tfidf(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "article_records")
    return models.tfidf(rows, "record_id", text.tokens(F.col("title"))).withColumn("weight", F.round("weight", 6))


@core.query()
def title_bridges(spark: SparkSession, folder: str) -> DataFrame:
    """Entities whose Hindi names, transliterated, are close to the words of their own Latin names."""
    rows = table(spark, folder, "knowledge_entities").select("entity_no", F.array_join("hindi_names", " ").alias("h"), F.concat_ws(" ", "canonical_name", F.array_join("romanisations", " ")).alias("l"))
    return rows.select("entity_no", languages.bridge_words(languages.hindi_nouns(F.col("h")), text.latin_nouns(F.col("l"))).alias("shared"))


@core.query("""
SELECT fetch_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title,
length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g'), '(?is)<noscript\\b.*?</noscript\\s*>', ' ', 'g'), '(?s)<!--.*?-->|<[^>]*>', ' ', 'g'), '\\s+', '', 'g')) AS visible
FROM fetch_results WHERE html IS NOT NULL""")
def page_titles(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("html")
    return table(spark, folder, "fetch_results").where("html IS NOT NULL").select("fetch_id", extract.title_tag(c).alias("title"), extract.visible_length(c).cast("bigint").alias("visible"))


@core.query()
def page_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata of each kept document's page and how far it can be trusted."""
    held = extract.metadata(table(spark, folder, "temp_documents").where("raw_html IS NOT NULL").select("temp_id", "raw_html", "body"), "raw_html")
    m = lambda n: F.col(f"meta.{n}")
    trust = extract.confidence(m("title"), m("title_from_tag"), m("published"), m("description"), F.col("body"), m("titles"), m("canonical"), m("visible"))
    return held.select("temp_id", m("title").alias("title"), m("published").alias("published"), m("author").alias("author"), trust.alias("confidence"))
