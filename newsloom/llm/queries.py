"""Queries of the operators for training text."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import boilerplate, history, language, lookalikes, mixing, residue, tokenizers, truncation
from newsloom.plans.registry import Registry
from newsloom.session import cut, small
from newsloom.sources import table

llm = Registry()


def _residue(spark: SparkSession, folder: str, src: str) -> DataFrame:
    """row_id of the rows of fetch_results or article_records in p5_found."""
    key, text, markup = {"fetch_results": ("fetch_id", "html", True), "article_records": ("record_id", "body", False)}[src]
    return residue.flag(table(spark, folder, src), text, [key], markup).withColumnRenamed(key, "row_id")


def _sound_articles(spark: SparkSession, folder: str) -> DataFrame:
    """article_records without the rows of p5_found, whose ids are written first: else each use of the result would judge all bodies again."""
    found = small(_residue(spark, folder, "article_records").withColumnRenamed("row_id", "record_id").distinct())
    return table(spark, folder, "article_records").join(found, "record_id", "left_anti")


def _model(spark: SparkSession, folder: str) -> language.Model:
    return language.train(table(spark, folder, "documents"), "text", "lang", "doc_id")


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    """src, row_id, story_id, label, text of the three tables with labelled texts."""
    none = F.lit(None).cast("bigint").alias("story_id")
    return (
        table(spark, folder, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").alias("row_id"), none, F.col("lang").alias("label"), "text")
        .unionByName(_sound_articles(spark, folder).select(F.lit("article_records").alias("src"), F.col("record_id").alias("row_id"), F.col("story_id").cast("bigint").alias("story_id"), F.col("language").alias("label"), F.col("body").alias("text")))
        .unionByName(table(spark, folder, "bilingual_test_set").select(F.lit("bilingual_test_set").alias("src"), F.col("item_id").alias("row_id"), none, F.col("expected").alias("label"), "text"))
    )


@llm.query()
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """src, row_id, language: the right languages of each text and story whose label is absent, wrong or too simple."""
    texts = language.detect(_labelled(spark, folder), "text", ["src", "row_id", "story_id", "label"], _model(spark, folder))
    texts = cut(texts.drop("segments", "confidence"))
    code = language.label_code(F.col("label"))
    wrong = code.isNull() | (F.size("languages") > 1) | (code != F.element_at("languages", 1))
    rows = texts.where((F.size("languages") > 0) & wrong).select("src", "row_id", F.explode("languages").alias("language"))
    right = texts.where("src = 'article_records' AND story_id IS NOT NULL AND language IS NOT NULL")
    right = right.groupBy("story_id").agg(F.array_sort(F.collect_set("language")).alias("right"))  # at most five of them
    said = F.array_sort(F.array_distinct(F.transform("languages", lambda x: F.coalesce(language.label_code(x), F.lit("")))))
    stories = table(spark, folder, "stories").select("story_id", said.alias("said")).join(right, "story_id")
    stories = stories.where(F.col("said").isNull() | (F.col("said") != F.col("right")))
    return rows.unionByName(stories.select(F.lit("stories").alias("src"), F.col("story_id").alias("row_id"), F.explode("right").alias("language"))).distinct()


@llm.query()
def p1_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Language and segments, with confidence, of each document, article and test text."""
    return language.detect(_labelled(spark, folder), "text", ["src", "row_id"], _model(spark, folder))


_LINES = r"""WITH b AS (SELECT record_id, source_id, string_split(body, chr(10)) AS w FROM article_records WHERE body IS NOT NULL AND source_id IS NOT NULL),
l AS (SELECT record_id, source_id, unnest(range(len(w))) AS line_no, unnest(w) AS line FROM b), k AS (SELECT record_id, source_id, line_no, regexp_replace(lower(line), '[^\p{L}\p{M}]+', '', 'g') AS k FROM l),
t AS (SELECT source_id, count(DISTINCT record_id) AS n FROM article_records GROUP BY 1), c AS (SELECT source_id, k, count(DISTINCT record_id) AS r FROM k WHERE k <> '' GROUP BY 1, 2),
f AS (SELECT source_id, k FROM c JOIN t USING (source_id) WHERE r >= 4 AND r * 10 >= n)"""


@llm.query(f"{_LINES} SELECT DISTINCT record_id, line_no::BIGINT AS line_no FROM k JOIN f USING (source_id, k)")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """record_id, line_no: lines that recur across the records of a source."""
    return boilerplate.repeated_lines(table(spark, folder, "article_records"), "record_id", "source_id", "body").select("record_id", "line_no")


@llm.query(f"""{_LINES}, g AS (SELECT DISTINCT record_id, line_no FROM k JOIN f USING (source_id, k)), h AS (SELECT record_id, list(line_no) AS gone FROM g GROUP BY 1)
SELECT a.record_id, CASE WHEN h.gone IS NULL THEN a.body ELSE array_to_string(list_filter(list_transform(range(len(string_split(a.body, chr(10)))), lambda i: CASE WHEN list_contains(h.gone, i) THEN NULL ELSE string_split(a.body, chr(10))[i + 1] END),
lambda x: x IS NOT NULL), chr(10)) END AS body FROM article_records a LEFT JOIN h ON h.record_id = a.record_id""")
def p3_clean(spark: SparkSession, folder: str) -> DataFrame:
    """record_id and body of each article without the lines of p3_found."""
    articles = table(spark, folder, "article_records").select("record_id", "source_id", "body")
    found = boilerplate.repeated_lines(articles, "record_id", "source_id", "body")
    return boilerplate.without_lines(articles, "record_id", "body", found).select("record_id", "body")


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages and weakly extracted bodies that mix articles with furniture."""
    host = lambda url: F.regexp_replace(F.lower(F.parse_url(url, F.lit("HOST"))), r"^(www|m|amp)\.", "")
    domains = table(spark, folder, "sources").select("source_id", F.col("domain").alias("host"))
    fetched = table(spark, folder, "fetch_results").select(
        F.lit("fetch_results").alias("src"), F.col("fetch_id").alias("row_id"), host(F.col("url")).alias("host"), F.col("url").alias("page"), F.col("html").alias("text"), F.lit(True).alias("markup")
    )
    kept = table(spark, folder, "temp_documents").select(
        F.lit("temp_documents").alias("src"), F.col("temp_id").alias("row_id"), host(F.col("url")).alias("host"), F.col("url").alias("page"), F.col("raw_html").alias("text"), F.lit(True).alias("markup")
    )
    weak = table(spark, folder, "article_records").where("extraction_confidence = 'low'").join(small(domains), "source_id", "left").select(
        F.lit("article_records").alias("src"), F.col("record_id").alias("row_id"), "host", F.coalesce("url", F.col("record_id").cast("string")).alias("page"), F.col("body").alias("text"), F.lit(False).alias("markup")
    )
    return fetched.unionByName(kept).unionByName(weak)


@llm.query()
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """src, row_id, para_key: the paragraphs of the running text of pages and of weakly extracted bodies."""
    return boilerplate.main_paragraphs(_pages(spark, folder)).join(p5_found(spark, folder), ["src", "row_id"], "left_anti")


@llm.query()
def p4_shares(spark: SparkSession, folder: str) -> DataFrame:
    """How many texts each table's pages hold, how many go with recurring subtrees, and how many of the rest are kept as running text."""
    return boilerplate.template_shares(_pages(spark, folder))


@llm.query()
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """src, row_id: rows with residue in place of an article or of a part of it."""
    found = [_residue(spark, folder, src).select(F.lit(src).alias("src"), "row_id") for src in ("fetch_results", "article_records")]
    return found[0].unionByName(found[1]).distinct()


@llm.query()
def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, ids: each document encoded by byte_bpe_50k."""
    return tokenizers.encode(table(spark, folder, "documents"), "text", ["doc_id"])


@llm.query()
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id of each document whose text was cut."""
    return truncation.truncated(table(spark, folder, "documents"), "text", "doc_id").select("doc_id").distinct()


@llm.query()
def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents of each source were cut, and by what this is known."""
    documents = table(spark, folder, "documents")
    found = truncation.truncated(documents, "text", "doc_id").withColumn("cut", F.lit(True))
    held = documents.select("doc_id", "source").join(found, "doc_id", "left")
    count = lambda c: F.count(F.when(F.col(c), 1))
    return held.groupBy("source").agg(
        F.count("*").alias("documents"), count("cut").alias("cut"), count("by_copy").alias("by_copy"), count("by_mark").alias("by_mark"), count("by_end").alias("by_end"),
        F.round(count("cut") / F.count("*"), 6).alias("rate"),
    )


@llm.query()
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """src, id_a, id_b: rows whose values look the same and differ."""
    articles = _sound_articles(spark, folder)
    values = [
        articles.select("batch_no", F.col("record_id").alias("id"), F.lit(src).alias("src"), F.col(c).alias("value")) for src, c in (("article_title", "title"), ("article_body", "body"))
    ]
    names = table(spark, folder, "knowledge_entities").select(
        F.lit(0).alias("batch_no"), F.col("entity_no").cast("bigint").alias("id"), F.lit("entity_hindi").alias("src"), F.explode("hindi_names").alias("value")
    )
    forms = lookalikes.with_forms(values[0].unionByName(values[1]).unionByName(names), "value", ["src", "batch_no", "id"])
    return lookalikes.same_looks(cut(forms), "id", ["src", "batch_no"]).select("src", "id_a", "id_b")


def _arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """The accepted history as batch 0, and the records of the batches without those of p5_found."""
    names = table(spark, folder, "sources").select(F.col("source_id").alias("source"), F.col("name").alias("site"))
    known = table(spark, folder, "known_articles").select(
        F.col("known_id").alias("id"), F.lit(0).alias("batch"), F.col("source_id").alias("source"), F.col("canonical_url").alias("url"), F.col("headline").alias("title"), "body"
    )
    given = F.when(F.trim("canonical_url") != "", F.col("canonical_url"))
    records = _sound_articles(spark, folder).select(
        F.col("record_id").alias("id"), F.col("batch_no").alias("batch"), F.col("source_id").alias("source"), F.coalesce(given, "url").alias("url"), "title", "body"
    )
    return known.unionByName(records).join(small(names), "source", "left")


BATCHES = [1, 2, 3, 4, 5, 6]


@llm.query()
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """id_a, id_b: records that repeat an accepted article or one of an earlier batch, and that article."""
    return history.repeats(_arrivals(spark, folder), BATCHES).where("id_a < id_b")


@llm.query()
def p7_accepted(spark: SparkSession, folder: str) -> DataFrame:
    """How many records of each batch came, repeated something, and are accepted."""
    rows = _arrivals(spark, folder)
    found = history.repeats(rows, BATCHES).select(F.col("id_b").alias("id")).distinct().withColumn("repeat", F.lit(1))
    new = rows.where("batch > 0").select("id", "batch").join(found, "id", "left")
    return new.groupBy("batch").agg(F.count("*").alias("records"), F.count("repeat").alias("repeats"), (F.count("*") - F.count("repeat")).alias("accepted"))


def _mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), "doc_id", "text", "source")


@llm.query()
def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents chosen for each plan, with their repeats and tokens."""
    return _mix(spark, folder)


@llm.query()
def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source of each plan."""
    return mixing.shares(_mix(spark, folder), table(spark, folder, "mix_targets"))
