import random

from newsloom.llm import truncation

DONE = "The council opened the bridge on Monday. The board sent back the estimate for the canal."
CUT = [
    "The council opened the bridge. The board sent ba", "The council opened the bridge.\nThe board sent back the", "The council opened the bridge. The board... Read more", "The council opened it. The board […]",
    "परिषद ने पुल खोला। बोर्ड ने… [+671 chars]", "परिषद ने पुल खोला। बोर्ड ने नहर ... और पढ़ें", "परिषद ने पुल खोला। बोर्ड ने नहर क�", "Head\nThe board sent back the esti", "The council opened the bridge. The board handed over 13 se<p", "One ended. Two…",
]
WHOLE = [
    DONE, f"{DONE}\n*****", f"{DONE}\n— Varnola Ledger", f"{DONE}\n#bridge #canal", f"{DONE}\nhttps://a.example/x/1", f"{DONE}\n27/9", f"{DONE}\ncold store: 161", f"{DONE}\n(Times / the clerk)", f'{DONE} He said, "We wait."', f"{DONE} 🌾", f"{DONE}\n\n",
    "परिषद ने पुल खोला।", "0", "", "   ", "��", "á ë ก็", "A headline alone", "صحت مرکز نے کام روک دیا۔",
]


def test_marks_and_open_ends(spark):
    rows = [(i, t) for i, t in enumerate(CUT)] + [(100 + i, t) for i, t in enumerate(WHOLE)] + [(200, None), (0, CUT[0]), (300, DONE * 3000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, body string")
    got = {r.doc_id for r in truncation.truncated(df, "text", "doc_id").collect()}
    assert got == set(range(len(CUT)))
    assert truncation.truncated(df.limit(0), "text", "doc_id").count() == 0


def test_prefixes_against_all_pairs(spark, monkeypatch):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randrange(41, 400))).strip() + "end" for _ in range(60)]
    texts += [rng.choice(texts)[: rng.randrange(41, 300)] for _ in range(120)] + ["z" * n for n in range(41, 120)]
    texts += [t[:n] for t in texts[:40] for n in (1, 7, 26, 39)] + ["The minister opened the br", "The minister opened the bridge on Monday."]
    texts = sorted(set(t.strip() for t in texts))
    want = {t for t in texts if any(o != t and o.startswith(t) for o in texts)}
    df = spark.createDataFrame([(t,) for t in texts], "body string").repartition(5)
    assert {r.body for r in truncation._with_longer(df).collect()} == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    by_copy = {texts[r.doc_id] for r in truncation.truncated(docs, "text", "doc_id").where("by_copy").collect()}
    assert by_copy == {t for t in want if any(c.isalpha() for c in t)} and "The minister opened the br" in by_copy
    monkeypatch.setattr(truncation, "CROWDED", 1)  # all groups by range sort
    assert {texts[r.doc_id] for r in truncation.truncated(docs, "text", "doc_id").where("by_copy").collect()} == by_copy
