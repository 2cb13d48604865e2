"""Articles grouped into stories."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import languages, text
from newsloom.session import cut

# Weights of the parts of a pair's score, and what a missing value counts.
WEIGHTS = {"entities": 0.30, "event": 0.20, "headline": 0.20, "districts": 0.15, "category": 0.10, "time": 0.05}
MISSING, NUMBER_BONUS, APART = 0.3, 0.05, 0.25
HOURS, THRESHOLD = 168.0, 0.60


def dice(a: Column, b: Column) -> Column:
    """Twice the common elements by all elements of two sets; 0 if one is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))).otherwise(0.0)


def pair_score(a: str = "a", b: str = "b") -> Column:
    """Score of two articles given as structs of entities, event_type, terms, districts, category, at (seconds), numbers."""
    x, y = (lambda n: F.col(f"{a}.{n}")), (lambda n: F.col(f"{b}.{n}"))
    same = lambda n: F.when(x(n).isNull() | y(n).isNull(), MISSING).otherwise((x(n) == y(n)).cast("double"))
    hours = F.abs(x("at") - y("at")) / 3600.0
    time = F.when(hours.isNull(), MISSING).otherwise(F.greatest(F.lit(0.0), 1 - hours / HOURS))
    score = (
        WEIGHTS["entities"] * dice(x("entities"), y("entities")) + WEIGHTS["event"] * same("event_type")
        + WEIGHTS["headline"] * F.round(text.term_cosine(x("terms"), y("terms")), 3) + WEIGHTS["districts"] * dice(x("districts"), y("districts"))
        + WEIGHTS["category"] * same("category") + WEIGHTS["time"] * time
    )
    score = score + F.when(F.coalesce(F.arrays_overlap(x("numbers"), y("numbers")), F.lit(False)), NUMBER_BONUS).otherwise(0.0)
    apart = (F.size(x("districts")) > 0) & (F.size(y("districts")) > 0) & ~F.coalesce(F.arrays_overlap(x("districts"), y("districts")), F.lit(False))
    score = score - F.when(apart, APART).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)


def with_bridges(pairs: DataFrame, a: str = "a", b: str = "b", headline: str = "headline") -> DataFrame:
    """Scored pairs with what their headlines share across scripts added to the entities of both: words of one in Devanagari that sound like names of the other in Latin letters.

    a and b are structs with entities and headline.
    """
    bridge = lambda x, y: languages.bridge_words(languages.hindi_nouns(F.col(f"{x}.{headline}")), text.latin_nouns(F.col(f"{y}.{headline}")))
    shared = F.transform(F.array_union(bridge(a, b), bridge(b, a)), lambda w: F.concat(F.lit("xl:"), w))
    none = F.array().cast("array<string>")
    held = pairs.withColumn("__nl_shared", shared)
    more = lambda c: F.col(c).withField("entities", F.array_union(F.coalesce(F.col(f"{c}.entities"), none), F.col("__nl_shared")))
    return held.withColumns({a: more(a), b: more(b)}).drop("__nl_shared")


def components(edges: DataFrame) -> DataFrame:
    """id, component (its lowest id) of each end of an edge a, b.

    Each round every vertex takes the lowest label among its neighbours and then the label of that
    label, which halves the distance to the lowest, so rounds grow with the logarithm of a chain. Labels
    only fall, so the rounds end.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).select(F.col("a").alias("id"), "c"))
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("n"))
        stepped = labels.join(seen, labels["id"] == seen["a"]).select("id", "c", F.least("c", "n").alias("n"))
        jumped = stepped.join(labels.select(F.col("id").alias("n"), F.col("c").alias("nn")), "n", "left")
        new = cut(jumped.select("id", F.col("c").alias("old"), F.least("n", F.coalesce("nn", "n")).alias("c")))
        labels = new.select("id", "c")
        if new.where("old != c").isEmpty():
            return labels.withColumnRenamed("c", "component")


def assign(pairs: DataFrame, key: str, story: str, score: str, threshold: float = THRESHOLD) -> DataFrame:
    """The best story of each article, the lowest of several equal ones, if its score reaches the threshold."""
    best = pairs.where(F.col(score) >= threshold).groupBy(key).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(story)).alias("t"))).alias("m"))
    return best.select(key, (-F.col("m.t")).alias(story), F.col("m.s").alias(score))


def _meet(a: DataFrame, b: DataFrame, crowded: int) -> DataFrame:
    """id_a, at_a, id_b, at_b of rows (id, at, key, bin) of a and b with one key and bin; more than `crowded` rows of a are met in parts."""
    parts = a.groupBy("key", "bin").agg(F.ceil(F.count("*") / crowded).alias("parts")).where("parts > 1")
    count = F.coalesce("parts", F.lit(1).cast("bigint"))
    a = a.join(parts, ["key", "bin"], "left").withColumn("part", F.pmod(F.xxhash64("id"), count)).drop("parts")
    b = b.join(parts, ["key", "bin"], "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1))).drop("parts")
    return a.withColumnsRenamed({"id": "id_a", "at": "at_a"}).join(b.withColumnsRenamed({"id": "id_b", "at": "at_b"}), ["key", "bin", "part"])


def candidates(articles: DataFrame, hours: float = HOURS, crowded: int = 1000) -> DataFrame:
    """id_a, id_b: articles that share a place, an entity or both category and event and lie at most `hours` apart; one without a time lies near all.

    articles: id, at (seconds), districts, entities, event_type, category. Times are put in bins, so a place in the news
    for years meets only its neighbours in time. A key with more than `crowded` articles in a bin is
    put in parts by a hash on one side, and the other side is sent to each part.
    """
    width = int(hours * 3600)
    none = F.array().cast("array<string>")
    compatible = F.when(F.col("category").isNotNull() & F.col("event_type").isNotNull(), F.array(F.concat_ws("\u0001", F.lit(""), "category", "event_type"))).otherwise(none)
    keys = F.array_compact(F.array_distinct(F.concat(F.coalesce("districts", none), F.coalesce("entities", none), compatible)))
    rows = articles.select("id", "at", F.explode(keys).alias("key"))
    dated = rows.where("at IS NOT NULL").withColumn("bin", F.floor(F.col("at") / width))
    around = dated.withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    zero = F.lit(0).cast("bigint")
    undated = rows.where("at IS NULL").withColumn("bin", zero)
    near = _meet(dated, around, crowded).where(F.abs(F.col("at_a") - F.col("at_b")) <= width)
    near = near.where("id_a < id_b").unionByName(_meet(rows.withColumn("bin", zero), undated, crowded).where("id_a != id_b"))
    return near.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def stories(articles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """id, story (the lowest id of its group) of each article; an article like no other is a story of its own.

    articles: id, at, headline, body, entities, districts, event_type, category.
    """
    held = articles.select("id", F.struct(
        F.coalesce("entities", F.array().cast("array<string>")).alias("entities"), "event_type", text.tokens(F.col("headline")).alias("terms"),
        F.coalesce("districts", F.array().cast("array<string>")).alias("districts"), "category", "at", text.numbers(F.concat_ws(" ", "headline", "body")).alias("numbers"),
    ).alias("s"))
    pairs = candidates(articles)
    scored = pairs.join(held.withColumnsRenamed({"id": "id_a", "s": "a"}), "id_a").join(held.withColumnsRenamed({"id": "id_b", "s": "b"}), "id_b")
    edges = scored.where(pair_score() >= threshold).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    groups = components(edges)
    return articles.select("id").join(groups, "id", "left").select("id", F.coalesce("component", "id").alias("story"))
