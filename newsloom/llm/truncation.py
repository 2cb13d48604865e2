"""Texts cut by a field limit, a teaser or a broken transfer.

The method is a self-join by prefix. Texts without their cut marks are hashed by a prefix of fixed
length; those that share one are sorted, and a text is a strict prefix of a longer copy exactly if
the next distinct text in that order begins with it. Texts shorter than that length are hashed whole
and joined with the prefixes that longer texts have at the lengths that occur (at most PREFIX - 1). Most cut texts have no longer copy in the
corpus, so texts whose end is open (a mark of a cut, or a last line of running text without the end
of a sentence) are found by the same pass over each text's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import cut, small

#: Code points of the hashed prefix. Shorter texts are hashed whole, and longer ones at each of the lengths that these have.
PREFIX = 40
#: Texts that share a prefix are sorted in one task up to this number; more are range-sorted over many.
CROWDED = 10_000
# How a cut is marked at the end of a text.
MARKS = (
    r"(?:\s*(?:…|\.{2,}|\[(?:…|\.{3})\]|\[\s*\+\s*[0-9]+\s*char(?:acter)?s?\s*\]|\(?(?i:read more|continue reading|read full story|more)\)?\s*[»›>→]*|"
    r"(?:और|आगे|पूरा) पढ़ें|पूरी खबर पढ़ें|आरও পড়ুন|আরও পড়ুন|مزید پڑھیں|थप पढ्नुहोस्|�+))+\s*$"
)
_MARKED = r"(?:…|\.{2,}|\[(?:…|\.{3})\]|\[\s*\+\s*[0-9]+\s*char(?:acter)?s?\s*\]|(?i:\bread more|\bcontinue reading|\bread full story)|(?:और|आगे|पूरा) पढ़ें|पूरी खबर पढ़ें|আরও পড়ুন|مزید پڑھیں|थप पढ्नुहोस्|�+)\s*$"
_ENDED = r"[.!?।॥۔؟][^\p{L}\p{M}\p{N}�]*$"
# Last lines that are complete though no sentence: tags, credit, address, label with number, rule, number, bracketed credit.
_CLOSING = (
    r"^\s*(?:#\S+(?:\s+#\S+)*|[—–―-]{1,2}\s*\S.{0,60}|(?:https?://|www\.)\S+|[\p{L}\p{M} ]{1,40}[:：]\s*\p{N}[\p{N}.,]*\s*%?|[^\p{L}]*|\([^()]{1,80}\)|\S+@\S+)\s*$"
)


def trim_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(" \t\n\r\f\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u200c\u200d\u2028\u2029\u202f\u205f\u3000\ufeff"))


def body(text: Column) -> Column:
    """The text without the mark of a cut."""
    trimmed = trim_end(text)
    return F.when(F.right(trimmed, F.lit(64)).rlike(_MARKED), F.regexp_replace(trimmed, MARKS, "")).otherwise(trimmed)


def end_marks(text: Column) -> Column:
    """A struct: marked, ended (by a sentence), closing (a complete last line that is no sentence), lines, worded."""
    trimmed = trim_end(text)
    line = F.substring_index(trimmed, "\n", -1)
    tail = F.right(trimmed, F.lit(64))
    marked = tail.rlike(_MARKED)
    return F.struct(
        marked.alias("marked"),
        tail.rlike(_ENDED).alias("ended"),
        line.rlike(_CLOSING).alias("closing"),
        trimmed.contains("\n").alias("lines"),
        text.rlike(r"\p{L}").alias("worded"),
    )


def _next_longer(texts: DataFrame) -> DataFrame:
    """The same as _with_longer within groups `h` of at most CROWDED texts: a text is a strict prefix of another exactly if the next one begins with it."""
    after = F.lead("body").over(Window.partitionBy("h").orderBy("body"))
    held = texts.select("h", "body", after.alias("after")).where(F.col("after").startswith(F.col("body")))
    return held.select("body", F.expr("substring(after, length(body) + 1, 1)").alias("follows"))


def _with_longer(texts: DataFrame) -> DataFrame:
    """`body` and `follows` (the character after it in the longer copy) of each distinct body that is a strict prefix of another one.

    Distinct bodies are range-sorted, so a hot prefix is spread over partitions; only the first and
    last body of each partition are compared in a second step.
    """
    schema = "body string, next string, pid int, edge boolean"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, before, first = TaskContext.get().partitionId(), None, None

        def out(found: list[tuple[str, str]], edge: bool) -> pa.RecordBatch:
            n = len(found)
            return pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string()), pa.array([pid] * n, pa.int32()), pa.array([edge] * n, pa.bool_())], ["body", "next", "pid", "edge"]
            )

        for batch in batches:
            found = []
            for body in batch.column(0).to_pylist():
                if first is None:
                    first = body
                elif before != body and body.startswith(before):
                    found.append((before, body[len(before)]))
                before = body
            yield out(found, False)
        if first is not None:
            yield out([(before, first)], True)

    scanned = cut(texts.repartitionByRange("body").sortWithinPartitions("body").mapInArrow(scan, schema))
    edges = scanned.where("edge").withColumn("first", F.lead("next").over(Window.orderBy("pid")))  # one row a partition
    over = edges.where(F.col("first").startswith(F.col("body")) & (F.col("first") != F.col("body")))
    over = over.select("body", F.expr("substring(first, length(body) + 1, 1)").alias("follows"))
    return scanned.where("NOT edge").select("body", F.col("next").alias("follows")).unionByName(over)


def _short_with_longer(rows: DataFrame, bare: Column, short: DataFrame) -> DataFrame:
    """`whole` and `follows` of each text under PREFIX characters that is a strict prefix of another one. rows has the texts, short the hashes and lengths of the short ones."""
    lengths = sorted(r[0] for r in short.select("n").distinct().collect())  # at most PREFIX - 1
    if not lengths:
        return short.select("whole", F.lit("").alias("follows")).limit(0)
    begins = F.array(*[F.when(F.length("body") > n, F.struct(F.lit(n).alias("n"), F.xxhash64(F.substring("body", 1, n)).alias("whole"), F.substring("body", n + 1, 1).alias("follows"))) for n in lengths])
    longer = rows.select(bare.alias("body")).where(F.length("body") > lengths[0]).select(F.inline(F.array_compact(begins)))
    return longer.join(small(short.distinct()), ["whole", "n"]).select("whole", "follows")


def truncated(df: DataFrame, text: str, key: str) -> DataFrame:
    """key, by_copy, by_mark, by_end of each row whose text was cut.

    by_copy: a strict prefix of a longer text, not ended by a sentence. by_mark: ends with a mark of
    a cut. by_end: the last line is running text without a sentence's end, in a text of more lines
    or with an ended sentence before. Null, empty and wordless texts are no cases; rows with the
    same text share its fate; other columns are ignored.
    """
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t IS NOT NULL")
    bare = body(F.col("t"))
    seen = rows.select(
        "k", F.xxhash64("t").alias("text"), end_marks(F.col("t")).alias("x"), F.xxhash64(bare).alias("whole"), F.when(F.length(bare) < PREFIX, F.length(bare)).alias("size"),
        F.when(F.length(bare) >= PREFIX, F.xxhash64(F.substring(bare, 1, PREFIX))).alias("h"),
        F.col("t").rlike(r"[.!?।۔؟][\"'”’»)]*\s+\S").alias("before"),
    )
    seen = cut(seen.where("x.worded").select("k", "text", "x.*", "whole", "size", "h", "before"))  # read once; the texts stay where they are
    shared = seen.where("h IS NOT NULL").groupBy("h").agg(F.min("whole").alias("a"), F.max("whole").alias("b"), F.count("*").alias("n")).where("a != b").select("h", "n")
    rivals = seen.join(shared, "h").groupBy("text").agg(F.first("h").alias("h"), F.first("n").alias("n"))
    rivals = rows.withColumn("text", F.xxhash64("t")).join(rivals, "text").select(bare.alias("body"), "h", "n").distinct()
    rivals = cut(rivals)
    longer = _next_longer(rivals.where(F.col("n") <= CROWDED))
    crowd = rivals.where(F.col("n") > CROWDED).select("body")
    if not crowd.isEmpty():
        longer = longer.unionByName(_with_longer(crowd))
    longer = longer.select(F.xxhash64("body").alias("whole"), "follows")
    longer = longer.unionByName(_short_with_longer(rows, bare, seen.where("size > 0").select("whole", F.col("size").alias("n"))))
    longer = longer.groupBy("whole").agg(F.max("follows").alias("follows"))
    held = seen.join(longer, "whole", "left")
    open_end = ~F.col("ended") & ~F.col("closing")
    inside = F.col("marked") | open_end | F.col("follows").rlike(r"[\p{L}\p{M}\p{N}]")
    by_copy = F.col("follows").isNotNull() & inside & ~F.col("closing")
    by_end = open_end & ~F.col("marked") & (F.col("lines") | F.col("before"))
    held = held.select("k", by_copy.alias("by_copy"), F.col("marked").alias("by_mark"), by_end.alias("by_end"))
    return held.where("by_copy OR by_mark OR by_end").select(F.col("k").alias(key), "by_copy", "by_mark", "by_end")
