import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import lookalikes

SAME = [
    ("Metro line", "Ｍｅｔｒｏ ｌｉｎｅ"), ("Metro line", "Μetrο line"), ("Metro line", "Меtrо lіnе"), ("Metro line", "Me​tro li­ne"), ("Vānabari", "Vānabari"), ("बाड़ी", "बाड़ी"),
    ("کمیٹی کی", "كمیٹي کي"), ("office", "oﬃce"), ("a\tb c", "a b c"), ("پاس", "پﺍس"), ("ОК саре", "OK саре".replace("OK", "ОК")), ("আসা", "অাসা"), ("yесоnd", "yecond"),
    ("को", "काे"), ("कौ", "काै"), ("कॉ", "काॅ"), ("ओर", "आेर"), ("ओर", "अाेर"), ("ऐन", "एेन"), ("ईद", "र्इद"), ("કો", "કાે"), ("એક", "અેક"), ("ઔર", "આૈર"), ("কো", "ক\u09c7\u09be"), ("ਆਮ", "ਅਾਮ"),
    ("Apple", "Ꭺpple"), ("LISU", "ꓡꓲꓢꓴ".replace("ꓴ", "U")), ("Bold", "𝐁𝐨𝐥𝐝"), ("XIV", "Ⅹ\u2160V"),
]
OTHER = [("Metro", "metro"), ("Metro 1", "Metro l"), ("Metro.", "Metro"), ("की", "कि"), ("कल", "काल"), ("12", "१२"), ("a  b", "a b"), ("naive", "naïve"), ("Привет", "Pivet"), ("H2O", "H₂O"), ("x²", "x2"), ("कॉल", "काल"), ("केा", "को"), ("उा", "ऊ"), ("ক\u09be\u09c7", "কো")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    assert lookalikes.normal_form(a) == lookalikes.normal_form(b)


@pytest.mark.parametrize("a,b", OTHER)
def test_other_look(a, b):
    assert lookalikes.normal_form(a) != lookalikes.normal_form(b)


def test_own_words_of_a_script_stay():
    assert lookalikes.normal_form("Привет мир") == "Привет мир"
    assert lookalikes.normal_form("Это оса") == "Это оса"  # all letters of the second word have Latin look-alikes


@settings(max_examples=600, deadline=None)
@given(st.text(max_size=40))
def test_form_is_stable(text):
    once = lookalikes.normal_form(text)
    assert lookalikes.normal_form(once) == once


def test_pairs(spark):
    rows = [(1, 1, "Metro"), (1, 2, "Меtrо"), (1, 3, "Metro"), (2, 4, "Ｍetro"), (1, 5, None), (1, 6, ""), (1, 7, "​"), (1, 1, "Metro"), (1, 8, "x" * 100_000), (1, 9, "x" * 99_999 + "х")]
    df = spark.createDataFrame([(*r, b"z") for r in rows], "g int, i bigint, t string, raw binary")
    forms = lookalikes.with_forms(df.drop("raw"), "t", ["g", "i"])
    want = {
        (g, i, j) for (g, i, a), (h, j, b) in itertools.product(rows, rows)
        if g == h and i < j and a is not None and b is not None and a != b and lookalikes.normal_form(a) == lookalikes.normal_form(b)
    }
    assert {tuple(r) for r in lookalikes.same_looks(forms, "i", ["g"]).collect()} == want and (1, 1, 2) in want
    members = {r["i"] for r in lookalikes.look_classes(forms, "i", ["g"]).where("g = 1").collect()}
    assert members == {i for g, a, b in want if g == 1 for i in (a, b)}
    assert lookalikes.same_looks(forms.limit(0), "i", ["g"]).count() == 0
