import json

import pytest
from pyspark.sql import functions as F

from newsloom.functions import languages, text
from newsloom.operators import extract, models


def test_detect_by_function_words(spark):
    rows = [
        (1, "the council said that it will open the bridge and the road for all of the people in the district by the end of this year as it had been said before by them when they were asked about it in the first week of the year", "en", 1.0),
        (2, "यह पुल का काम है और समिति ने कहा कि यह अब तक नया है", "hi", None), (3, "", "en", 0.0), (4, None, "en", 0.0), (5, "Patna Metro", "en", 0.35), (6, "পটনা", "en", 0.2), (7, "the है", "en", 0.5), (8, "सड़क पुल", "hi", 0.35),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "id int, t string")
    got = {r.id: r.d for r in df.select("id", languages.detect(F.col("t")).alias("d")).collect()}
    for i, _, language, confidence in rows:
        assert got[i].language == language, i
        if confidence is not None:
            assert got[i].confidence == pytest.approx(confidence), i
    assert got[2].confidence <= 0.8  # short


def test_transliteration():
    assert languages.transliterate("पटना") == "patanaa"
    assert languages.transliterate("मेट्रो") == "metro"
    assert languages.transliterate("बाढ़") == "baadha"
    assert languages.transliterate("ऋषि") == "rishi"
    assert languages.transliterate("x1") == ""
    assert languages.bridges(["मेट्रो", "पटना", "अ"], ["metro", "patna", "delhi"]) == ["metro", "patna"]
    assert languages.bridges([], ["a"]) == []


def test_tolls_and_content_words(spark):
    df = spark.createDataFrame([(1, "Five killed, 1,200 dead in floods"), (2, "बीस की मौत"), (3, "nothing here"), (4, None), (5, "twelve people and 3 died")], "id int, t string")
    assert {r.id: r.n for r in df.select("id", languages.death_toll(F.col("t")).alias("n")).collect()} == {1: 1200, 2: 20, 3: 0, 4: 0, 5: 3}
    assert df.where("id = 3").select(languages.content_tokens(F.lit("the bridge the bridge है")).alias("w")).first().w == ["bridge", "bridge"]


PAGE = """<html><head><title>Tag title | Site</title><meta content="Meta text" name="Description"><meta property='og:title' content='Tag title'><link href="https://a.example/x" rel="canonical">
<script type="application/ld+json">{"@graph": [{"@type": "WebSite"}, {"@type": ["NewsArticle"], "headline": " Tag title ", "author": [{"name": "A"}, {"name": "B"}], "datePublished": "2025-01-01T00:00:00Z",
"mainEntityOfPage": {"@id": "https://a.example/ld"}, "articleBody": "%s"}]}</script><style>p{}</style></head><body><p>one two</p></body></html>""" % ("word " * 20)


def test_metadata(spark):
    rows = [(1, PAGE), (2, "<title>Only</title><p>x</p>"), (3, "<script type='application/ld+json'>broken</script>"), (4, None), (5, ""), (6, f"<script type=\"application/ld+json\">{json.dumps([{'@type': 'Article', 'headline': 'L', 'author': 'One'}])}</script>")]
    df = extract.metadata(spark.createDataFrame(rows, "id int, html string"), "html")
    got = {r.id: r.meta for r in df.collect()}
    assert (got[1].title, got[1].title_from_tag, got[1].description, got[1].author, got[1].published, got[1].canonical) == ("Tag title", False, "Meta text", "A, B", "2025-01-01T00:00:00Z", "https://a.example/ld")
    assert (got[2].title, got[2].title_from_tag, got[2].visible) == ("Only", True, 5)
    assert got[3].title is None and got[4].title is None and got[5].title is None
    assert (got[6].title, got[6].author) == ("L", "One")


def test_confidence(spark):
    kind = "t string, tag boolean, p string, d string, b string, ts array<string>, c string, v int"
    rows = [("T", False, "x", "d", "para\n" * 300, ["T", "T | S"], "u", 1300), ("T", True, None, None, "x" * 210, ["T", "Other"], None, 2000), (None, False, None, None, "short", [], None, 5), ("T", False, "p", "d", None, ["T"], "u", 5)]
    df = spark.createDataFrame(rows, kind)
    out = df.select(extract.confidence(F.col("t"), F.col("tag"), F.col("p"), F.col("d"), F.col("b"), F.col("ts"), F.col("c"), F.col("v")).alias("x"))
    assert [r.x for r in out.collect()] == ["high", "failed", "failed", "failed"]


def test_tfidf_has_unit_rows(spark):
    df = spark.createDataFrame([(1, "a a b"), (2, "b c"), (3, ""), (4, None)], "id int, t string")
    got = models.tfidf(df, "id", text.tokens(F.col("t"))).collect()
    assert {r.id for r in got} == {1, 2}
    for i in (1, 2):
        assert sum(r.weight**2 for r in got if r.id == i) == pytest.approx(1)
    assert {r.term for r in models.tfidf(df, "id", text.tokens(F.col("t")), most=1).collect()} == {"a"}
    assert df.where("id = 1").select(models.char_grams(F.lit("ab c"), 3, 4)).first()[0] == [" ab", "ab ", " c ", " ab "]


def test_models_tell_topics_apart(spark):
    rows = [(i, ("bridge road canal repair " if i % 2 else "cricket match score team ") * 3 + str(i), "infra" if i % 2 else "sport") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, t string, topic string")
    folds = models.cross_validate(df, "id", "t", "topic", folds=2, features=64).collect()
    assert len(folds) == 2 and min(r.macro_f1 for r in folds) > 0.9
    said = models.pipeline("t", "topic", "svc", 64).fit(df).transform(df)
    assert said.where("prediction = y").count() == 60


def test_fusion(spark):
    rows = [("a", 0.7, "a", 0.9, True), ("a", 0.4, "b", 0.9, False), ("a", 0.6, "b", 0.9, False), (None, 0.0, "b", 0.9, False), ("a", 0.5, "a", 0.5, False)]
    df = spark.createDataFrame(rows, "r string, rc double, s string, sc double, e boolean")
    got = [(x.label, round(x.confidence, 3), x.review) for (x,) in df.select(models.fuse(F.col("r"), F.col("rc"), F.col("s"), F.col("sc"), F.col("e"))).collect()]
    assert got == [("a", 0.85, False), ("b", 0.6, True), ("a", 0.4, True), (None, 0.4, True), ("a", 0.5, True)]
