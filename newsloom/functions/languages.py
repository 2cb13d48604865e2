"""Language by function words, script and transliteration."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import text

# Function words by language.
ENGLISH = """the be to of and a in that have it for not on with as you do at this but his by from they we say her she or an will my one all would there their what so up out if about
who get which go me when make can like time just him know take into year your good some could them see other than then now look only come its over think also back after use two how our
work first well way even new want because any these give day most us is are was were has had been being does did shall should may might must ought such nor too very more said says will
would can""".split()
HINDI = """के का की में है हैं और से को पर यह वह जो तो भी ने तक लिए द्वारा हुआ हुई हुए गया गई गए करता करते किया किए होगा होगी सकते अपना अपनी अपने इस उस इन उन क्या कब कहाँ जैसे तथा एवं या
लेकिन मगर अगर जब तब अब यहाँ वहाँ सभी बहुत अधिक नया नई बड़े समेत तहत बीच प्रति साथ वाले वाली वाला जिन जिनमें जिसके जिसकी""".split()
PROFILES: dict[str, tuple[str, tuple[str, ...]]] = {"en": ("Latn", tuple(dict.fromkeys(ENGLISH))), "hi": ("Deva", tuple(dict.fromkeys(HINDI)))}


def register(code: str, script: str, words: list[str]) -> None:
    """Adds a language to the profiles that are looked at."""
    if not code or not words:
        raise ValueError("a profile needs a code and words")
    PROFILES[code] = (script, tuple(dict.fromkeys(words)))


def words(c: Column) -> Column:
    """Latin words in lower case and Devanagari words without a danda at the end."""
    return F.transform(text.tokens(c), lambda w: F.regexp_replace(w, "[।॥]+$", ""))


def hits(c: Column) -> dict[str, Column]:
    """Function words of each profile in a text, by occurrence."""
    held = words(c)
    return {code: F.size(F.filter(held, lambda w: w.isin(*stop))) for code, (_, stop) in PROFILES.items()}


def detect(c: Column) -> Column:
    """A struct of language and confidence.

    The language with most hits, by code if several; its share of all hits is the confidence, at
    most 0.8 under 150 letters, at most 0.6 under 3 hits. A tie goes to the main script's language.
    Without hits the main script decides at 0.35, else en at 0.2; a blank text is en at 0.
    """
    by = hits(c)
    mix = text.script_shares(c)
    total = sum(by.values(), F.lit(0))
    ranked = F.array_sort(F.array(*[F.struct((-n).alias("n"), F.lit(code).alias("code")) for code, n in sorted(by.items())]))
    first, second = -ranked[0]["n"], -ranked[1]["n"] if len(by) > 1 else F.lit(-1)
    entries = F.coalesce(F.map_entries(mix), F.array().cast("array<struct<key: string, value: double>>"))
    main = F.array_max(F.transform(entries, lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))))["k"]
    scripted = F.lit(None).cast("string")
    for code, (script, _) in reversed(list(PROFILES.items())):
        scripted = F.when(main == script, code).otherwise(scripted)
    letters = sum((F.length(F.regexp_replace(F.coalesce(c, F.lit("")), f"[^{chars}]", "")) for chars in text.SCRIPTS.values()), F.lit(0))
    share = first / total
    share = F.when(letters < 150, F.least(share, F.lit(0.8))).otherwise(share)
    share = F.when(total < 3, F.least(share, F.lit(0.6))).otherwise(share)
    blank = F.trim(F.coalesce(c, F.lit(""))) == ""
    language = F.when(blank, "en").when(total == 0, F.coalesce(scripted, F.lit("en"))).when((first == second) & scripted.isNotNull(), scripted).otherwise(ranked[0]["code"])
    confidence = F.when(blank, 0.0).when(total == 0, F.when(scripted.isNotNull(), 0.35).otherwise(0.2)).otherwise(F.bround(share, 2))
    return F.struct(language.alias("language"), confidence.alias("confidence"))


def content_tokens(c: Column) -> Column:
    """Tokens that are no function words, repeats kept."""
    stop = [w for _, held in PROFILES.values() for w in held]
    return F.filter(text.tokens(c), lambda w: ~w.isin(*stop))


# Letters whose transliteration isn't that of their name.
_NAMED = {"NGA": "n", "NYA": "n", "TTA": "t", "TTHA": "th", "DDA": "d", "DDHA": "dh", "NNA": "n", "SSA": "sh", "I": "i", "II": "ii", "VOCALIC R": "ri", "ANUSVARA": "n", "VISARGA": "h", "CANDRABINDU": "n", "AA": "aa", "UU": "uu"}


@lru_cache(maxsize=4096)
def _letter(c: str) -> tuple[str, str]:
    """Kind (consonant, vowel, sign or other) and Latin form of a Devanagari character, from its name."""
    name = unicodedata.name(c, "").removeprefix("DEVANAGARI ")
    for prefix, kind in (("LETTER ", "letter"), ("VOWEL SIGN ", "sign"), ("SIGN ", "sign")):
        if name.startswith(prefix):
            said = name.removeprefix(prefix)
            if kind == "sign" and said in ("VIRAMA", "NUKTA"):
                return said.lower(), ""
            latin = _NAMED.get(said, said.lower())
            if kind == "letter" and "क" <= c <= "ह":
                return "consonant", latin.removesuffix("a")
            return ("vowel" if kind == "letter" else "sign"), latin
    return "other", ""


def transliterate(word: str) -> str:
    """Devanagari in Latin letters, letter by letter, with each inherent a kept."""
    out, held = [], ""
    for c in word:
        kind, latin = _letter(c)
        if kind == "nukta":
            continue
        if held:
            out.append(held if kind in ("virama", "sign") else held + "a")
            held = ""
        if kind == "consonant":
            held = latin
        elif kind in ("vowel", "sign"):
            out.append(latin)
    return "".join([*out, held + "a" if held else ""])


def bridges(hindi: list[str], latin: list[str], ratio: float = 0.8) -> list[str]:
    """The Latin words that a Devanagari word's transliteration is close to, the closest one for each."""
    found = set()
    for h in sorted(set(hindi)):
        roman = transliterate(h)
        close = [(SequenceMatcher(None, roman, w).ratio(), w) for w in sorted(set(latin)) if len(roman) >= 3 and abs(len(roman) - len(w)) <= 3]
        best = max((c for c in close if c[0] >= ratio), key=lambda c: c[0], default=None)
        if best:
            found.add(best[1])
    return sorted(found)


@F.pandas_udf(T.ArrayType(T.StringType()))
def bridge_words(hindi: pd.Series, latin: pd.Series) -> pd.Series:
    return pd.Series([bridges([] if a is None else list(a), [] if b is None else list(b)) for a, b in zip(hindi, latin)])


def hindi_nouns(c: Column) -> Column:
    """Devanagari words of three characters or more that are no function words, distinct."""
    return F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit(r"([ऀ-ॿ]{3,})"), 1), lambda w: ~w.isin(*PROFILES["hi"][1])))


# Number words.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15,
    "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "dozen": 12, "dozens": 24,
    "एक": 1, "दो": 2, "तीन": 3, "चार": 4, "पांच": 5, "पाँच": 5, "छह": 6, "छः": 6, "सात": 7, "आठ": 8, "नौ": 9, "दस": 10, "ग्यारह": 11, "बारह": 12, "तेरह": 13, "चौदह": 14, "पंद्रह": 15,
    "सोलह": 16, "सत्रह": 17, "अठारह": 18, "उन्नीस": 19, "बीस": 20,
}


def death_toll(c: Column) -> Column:
    """The highest number of dead that a text states in digits or number words; 0 if none."""
    named = "|".join(sorted(NUMBER_WORDS, key=len, reverse=True))
    low = F.lower(F.coalesce(c, F.lit("")))
    dead, died = r"\s+(?:killed|dead|deaths|died)(?![\p{L}\p{N}_])", r"\s*(?:की\s*)?(?:मौत|मरे|मृतक|मृत)"
    digits = F.concat(F.regexp_extract_all(low, F.lit(rf"([0-9][0-9,]*){dead}"), 1), F.regexp_extract_all(low, F.lit(rf"([0-9][0-9,]*){died}"), 1))
    spelled = F.concat(F.regexp_extract_all(low, F.lit(rf"(?<![\p{{L}}\p{{N}}_])({named}){dead}"), 1), F.regexp_extract_all(low, F.lit(rf"({named}){died}"), 1))
    values = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    counts = F.concat(F.transform(digits, lambda x: F.replace(x, F.lit(","), F.lit("")).cast("bigint")), F.transform(spelled, lambda x: values[x].cast("bigint")))
    return F.greatest(F.lit(0).cast("bigint"), F.coalesce(F.array_max(counts), F.lit(0)))
