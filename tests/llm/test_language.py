import random

import pandas as pd
from pyspark.sql import functions as F

from newsloom.llm import language

WORDS = {
    "en": "the council opened a new bridge near market after long delay and residents asked for fresh count of houses".split(),
    "hi": "समिति ने नया पुल बाजार के पास खोला और लोगों ने दोबारा गिनती की बात कही है जिससे राहत मिली".split(),
    "ne": "समितिले नयाँ पुल बजार नजिक खोलेको छ र बासिन्दाले फेरि गन्ने कुरा गरेका छन् तर कारण बताएको छैन".split(),
    "bn": "কমিটি বাজারের কাছে নতুন সেতু খুলেছে এবং মানুষ আবার গোনার কথা বলেছে কিন্তু কারণ জানায়নি".split(),
    "ur": "کمیٹی نے بازار کے پاس نیا پل کھولا اور لوگوں نے دوبارہ گنتی کی بات کہی لیکن وجہ نہیں بتائی".split(),
    "hi-Latn": "samiti ne naya pul bazaar ke paas khola aur logon ne dobara ginti ki baat kahi lekin wajah nahi batayi".split(),
}
END = {"en": ".", "hi": "।", "ne": "।", "bn": "।", "ur": "۔", "hi-Latn": "."}


def sentence(lang, rng):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(9)) + END[lang]


def model(noise=0.08):
    rng = random.Random(1)
    labelled = []
    for _ in range(600):
        lang = rng.choice(list(WORDS))
        label = rng.choice(list(language.NAMES)) if rng.random() < noise else lang.split("-")[0]
        labelled.append((label, " ".join(sentence(lang, rng) for _ in range(4))))
    return language.fit(labelled)


MODEL = model()


def test_held_out_sentences(spark):
    """New sentences, and words never seen in training, in spite of wrong labels in it."""
    rng = random.Random(9)
    rows = [(i, (lang := rng.choice(list(WORDS))).split("-")[0], sentence(lang, rng)) for i in range(300)]
    out = language.detect(spark.createDataFrame(rows, "id int, want string, text string"), "text", ["id", "want"], MODEL).collect()
    assert sum(r.language == r.want for r in out) / len(out) >= 0.98
    unseen = spark.createDataFrame([(1, "councils opening marketed bridges residents"), (2, "बाजारों समितियों लोगोंको राहतें"), (3, "বাজারে সেতুগুলি মানুষের")], "id int, text string")
    assert {r.id: r.language for r in language.detect(unseen, "text", ["id"], MODEL).collect()} == {1: "en", 2: "hi", 3: "bn"}


def test_segments_and_edges(spark):
    rng = random.Random(3)
    text = f"{sentence('en', rng)} {sentence('en', rng)}\n{sentence('hi', rng)} {sentence('ur', rng)}"
    inside = "the council opened a new पुल (घाट) near market after long delay."
    rows = [(1, text, "x"), (1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "123 456.", "x"), (5, inside, "x"), (6, "no end of a sentence here", "x"), (7, sentence("bn", rng) * 3000, "x")]
    out = language.detect(spark.createDataFrame(rows, "k0 int, t string, language string"), "t", ["k0"], MODEL).collect()
    assert len(out) == len(rows)
    by = {r.k0: r for r in out}
    assert by[1].languages == ["en", "hi", "ur"] and [s.language for s in by[1].segments] == ["en", "hi", "ur"]
    assert by[1].segments[0].start == 0 and by[1].segments[-1].end == len(text)
    assert by[2].language is None and by[3].language is None and by[4].language is None
    assert by[5].languages == ["en"] and by[6].languages == [] and by[6].language == "en"
    assert by[7].languages == ["bn"] and 0 <= by[7].confidence <= 1
    assert language.detect(spark.createDataFrame([], "k0 int, t string"), "t", ["k0"], MODEL).count() == 0


def test_labels(spark):
    said = ["EN", "en_US", "Hindi", "hi-Latn", "urd", "fr", "und", "", None, "Unknown", "বাংলা"]
    df = spark.createDataFrame(pd.DataFrame({"s": said}), "s string")
    assert [r[0] for r in df.select(language.label_code(F.col("s"))).collect()] == ["en", "en", "hi", "hi", "ur", "fr", None, None, None, None, "bn"]


def test_training_without_labels(spark):
    assert language.train(spark.createDataFrame([], "t string, l string, k bigint"), "t", "l", "k").words == {}


def _fit(sizes):
    rng = random.Random(2)
    return language.fit([(lang.split("-")[0], " ".join(sentence(lang, rng) for _ in range(4))) for lang, n in sizes.items() for _ in range(n)])


def _judged(spark, fitted, n=60):
    rng = random.Random(5)
    rows = [(lang.split("-")[0], sentence(lang, rng)) for lang in WORDS for _ in range(n)]
    return language.detect(spark.createDataFrame(rows, "want string, text string"), "text", ["want"], fitted).collect()


def test_language_without_training_rows(spark):
    """A class without rows wins nothing; a text in a language that training hasn't seen has none."""
    fitted = _fit({"en": 300, "hi": 300, "ne": 300, "bn": 300, "hi-Latn": 300})
    out = _judged(spark, fitted)
    assert all(r.language == r.want for r in out if r.want != "ur")
    assert all(r.language is None and r.confidence is None and r.languages == [] and r.segments[0].language is None for r in out if r.want == "ur")
    french = [("le conseil municipal inaugure demain matin une passerelle derrière les halles.",), ("les habitants veulent savoir pourquoi rien ne bouge depuis septembre.",)]
    assert [r.language for r in language.detect(spark.createDataFrame(french, "text string").withColumn("k", F.lit(1)), "text", ["k"], fitted).collect()] == [None, None]


def test_skewed_training(spark):
    """A thousand times as many rows of one language as of another."""
    out = _judged(spark, _fit({"en": 3000, "hi": 300, "ne": 30, "bn": 10, "ur": 3, "hi-Latn": 3}))
    assert sum(r.language == r.want for r in out) >= 0.99 * len(out)


def test_no_training_at_all(spark):
    out = language.detect(spark.createDataFrame([(1, "the council opened a new bridge.")], "k int, text string"), "text", ["k"], language.fit([])).collect()
    assert [(r.language, r.languages) for r in out] == [(None, [])]
