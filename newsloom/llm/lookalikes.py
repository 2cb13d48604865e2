"""One form for texts that look the same.

Each token is resolved by its script sets: a letter stands for its own script and for each script
in which it has a look-alike. Where the letters of a token are of several scripts (mixed-script
confusable) and the sets of all letters share one, the token is spelled in that script; where all
letters of a token of one script have look-alikes in another script that the text around is
written in (whole-script confusable), it is spelled in that one. Remaining forms (width, presentation
forms, composition, kinds of space, invisible characters) are normalised by rule. Letter case, digits,
punctuation, vowel signs and the number of spaces are kept.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters that look alike, each pair as Latin letter and look-alike.
CYRILLIC = "AА BВ EЕ eе KК MМ HН OО oо PР pр CС cс TТ XХ xх yу SЅ sѕ IІ iі JЈ jј aа hһ dԁ qԛ wԝ lӏ YҮ Gԍ".split()
GREEK = "AΑ BΒ EΕ ZΖ HΗ IΙ KΚ MΜ NΝ OΟ oο PΡ pρ TΤ YΥ XΧ vν uυ iι aα jϳ cϲ CϹ".split()
ARMENIAN = "oօ OՕ uս nո hհ gց SՏ LԼ UՍ qզ".split()
COPTIC = "OⲞ oⲟ PⲢ pⲣ CⲤ cⲥ NⲚ KⲔ HⲎ MⲘ TⲦ YⲨ XⲬ BⲂ".split()
CHEROKEE = "DᎠ RᎡ TᎢ YᎩ AᎪ JᎫ EᎬ WᎳ MᎷ HᎻ GᏀ hᏂ ZᏃ bᏏ VᏙ SᏚ LᏞ CᏟ PᏢ KᏦ dᏧ BᏴ".split()
LISU = "BꓐPꓑDꓓTꓔGꓖKꓗJꓙCꓚZꓜFꓝMꓟNꓠLꓡSꓢRꓣVꓦHꓧWꓪXꓫYꓬAꓮEꓰIꓲOꓳUꓴ"
LISU = [LISU[i : i + 2] for i in range(0, len(LISU), 2)]
# Letters of one script in two encodings that look alike: Arabic letters and the Persian and Urdu ones, Latin variants.
SAME = "كک يی ىی ہه ەہ ۀۂ ɑa ɡg ıi ᴏo ᴄc ᴠv ᴡw ᴢz".split()
# Fixed values, by the Unicode names of vowels: the sign of AA and a sign above it show another sign, in scripts whose signs stand above.
ABOVE = ("DEVANAGARI", "GUJARATI")
WITH_AA = {"E": "O", "AI": "AU", "CANDRA E": "CANDRA O", "SHORT E": "SHORT O"}
# The letter A and a sign show the letter of that sign (or the one named); the letter E and a sign above likewise.
WITH_A = {
    "DEVANAGARI": "AA,O,AU,CANDRA O,SHORT O,CANDRA E=CANDRA A,SHORT E=SHORT A,OE,OOE,AW,UE,UUE", "GUJARATI": "AA,E,AI,O,AU,CANDRA E=CANDRA E,CANDRA O", "GURMUKHI": "AA,AI,AU",
    "BENGALI": "AA", "ORIYA": "AA",
}
WITH_E = {"DEVANAGARI": "E=AI,CANDRA E,SHORT E", "GUJARATI": "E=AI", "MALAYALAM": "E=AI"}
# Other letters that a letter and a sign show, as script, letter, sign (or mark) and what is shown.
WITH_OTHERS = (
    "GURMUKHI IRI I I|GURMUKHI IRI II II|GURMUKHI IRI EE EE|GURMUKHI URA U U|GURMUKHI URA UU UU|TELUGU O AU AU|KANNADA U AA UU|KANNADA O AU AU|"
    "MALAYALAM O AA OO|MALAYALAM I AU=MARK II|MALAYALAM U AU=MARK UU|MALAYALAM O AU=MARK AU"
).split("|")

_MARK = r"­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ"
_MARKS = re.compile(f"[{_MARK}]+")
_SPACES = " \t\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
_SPACE = re.compile(rf"[{_SPACES}]")
_LETTERS = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1)
def sequences() -> dict[str, str]:
    """What a vowel and a vowel sign (or two signs) show together, to the one character that shows the same; by rule over the Brahmic blocks."""

    def named(*parts: str) -> str:
        try:
            return unicodedata.lookup(" ".join(parts))
        except KeyError:
            return ""

    found = {}

    def keep(first: str, second: str, shown: str) -> None:
        if first and second and shown:
            found[first + second] = shown

    for script in ABOVE:
        for above, shown in WITH_AA.items():
            sign = named(script, "VOWEL SIGN", above)
            keep(named(script, "VOWEL SIGN AA"), sign, named(script, "VOWEL SIGN", shown))
            keep(named(script, "LETTER AA"), sign, named(script, "LETTER", shown))
    for letter, rules in (("A", WITH_A), ("E", WITH_E)):
        for script, signs in rules.items():
            for rule in signs.split(","):
                sign, _, shown = rule.partition("=")
                keep(named(script, "LETTER", letter), named(script, "VOWEL SIGN", sign), named(script, "LETTER", shown or sign) or named(script, "VOWEL", shown or sign))
    for rule in WITH_OTHERS:
        script, letter, sign, shown = rule.split(" ")
        mark = named(script, "AU LENGTH MARK") if sign.endswith("=MARK") else named(script, "VOWEL SIGN", sign)
        keep(named(script, "LETTER", letter) or named(script, letter), mark, named(script, "LETTER", shown))
    keep("र्", "इ", "ई")  # the repha over the letter I
    return found


@lru_cache(maxsize=1)
def _joined() -> re.Pattern:
    return re.compile("|".join(re.escape(x) for x in sorted(sequences(), key=len, reverse=True)))


SCRIPTS = {"Cyrillic": CYRILLIC, "Greek": GREEK, "Armenian": ARMENIAN, "Coptic": COPTIC, "Cherokee": CHEROKEE, "Lisu": LISU}


def _pairs() -> tuple[dict[str, str], dict[str, str]]:
    """Look-alike to Latin letter, and its script."""
    to, script = {}, {}
    for name, pairs in SCRIPTS.items():
        for a, b in pairs:
            latin, other = (a, b) if a.isascii() else (b, a)
            to[other], script[other] = latin, name
    return to, script


LATIN_OF, SCRIPT_OF = _pairs()
_OTHER = {name: {LATIN_OF[c]: c for c, s in SCRIPT_OF.items() if s == name} for name in SCRIPTS}
_TO_LATIN = str.maketrans(LATIN_OF)
# Greek, Coptic, Cyrillic, Armenian, Cherokee and Lisu.
_OTHERS = "\u0370-\u058f\u1f00-\u1fff\u13a0-\u13ff\uab70-\uabbf\u2c80-\u2cff\ua4d0-\ua4ff"
_FOREIGN = re.compile(f"[{_OTHERS}]")
_TOKEN = re.compile(rf"[^\W\d_]*[{_OTHERS}][^\W\d_]*")


@lru_cache(maxsize=1)
def _forms() -> dict[int, str]:
    """Characters of another width, presentation forms, ligatures and kinds of one letter, by rule from the Unicode database and from SAME."""
    table = {}
    for code in (*range(0xA0, 0x3100), *range(0xFB00, 0x10000), *range(0x1D400, 0x1D800)):
        kind = unicodedata.decomposition(chr(code)).partition(" ")[0]
        if kind in ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<font>") or kind == "<compat>" and (0xFB00 <= code < 0xFB50 or 0x2160 <= code < 0x2180):
            table[code] = unicodedata.normalize("NFKC", chr(code))
    same = {ord(other): one for other, one in SAME}
    return {code: said.translate(same) for code, said in table.items()} | same


@lru_cache(maxsize=1)
def _special() -> re.Pattern:
    """Any character that normalisation may change, other than by composition."""
    codes = sorted(_forms())
    runs, start = [], None
    for code in codes:
        if start is None or code != last + 1:  # noqa: F821
            if start is not None:
                runs.append((start, last))  # noqa: F821
            start = code
        last = code
    runs.append((start, last))
    forms = "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs)
    firsts, seconds = ("".join(sorted({x[at] for x in sequences()})) for at in (-2, -1))
    return re.compile(rf"[{forms}{_OTHERS}{_MARK}{_SPACES[1:]}]|[{firsts}][{seconds}]")


def _script(c: str) -> str:
    if c.isascii() or "À" <= c <= "ɏ" or "Ḁ" <= c <= "ỿ":
        return "Latin"
    if c in SCRIPT_OF:
        return SCRIPT_OF[c]
    name = unicodedata.name(c, "").split(" ")[0].title()
    return name


def _spell(token: str, around: str) -> str:
    """A token with letters of Greek, Cyrillic or Armenian in its one consistent script."""
    own = {_script(c) for c in token}
    sets = [{_script(c)} | ({"Latin"} if c in LATIN_OF else set()) | {n for n, t in _OTHER.items() if c in t} for c in token]
    shared = set.intersection(*sets)
    if len(own) > 1:  # mixed-script
        if "Latin" in shared:
            return token.translate(_TO_LATIN)
        for name in SCRIPTS:
            if name in shared:
                return "".join(_OTHER[name].get(c, c) for c in token)
        return token
    if "Latin" in shared and around != own.copy().pop():  # whole-script
        return token.translate(_TO_LATIN)
    return token


def _main_script(text: str) -> str:
    """The script of most letters outside tokens that could be Latin look-alikes."""
    counts: dict[str, int] = {}
    for token in _LETTERS.findall(text):
        if all(c in LATIN_OF for c in token):
            continue
        for c in token:
            s = _script(c)
            counts[s] = counts.get(s, 0) + 1
    return max(sorted(counts), key=counts.get) if counts else "Latin"


def _step(text: str) -> str:
    if _special().search(text):
        text = _MARKS.sub("", unicodedata.normalize("NFC", text)).translate(_forms())
        text = _joined().sub(lambda m: sequences()[m.group()], _SPACE.sub(" ", text))
        if _FOREIGN.search(text):
            around = _main_script(text)
            text = _TOKEN.sub(lambda m: _spell(m.group(), around), text)
    return unicodedata.normalize("NFC", text)


def normal_form(text: str) -> str:
    """The form in which texts that look the same are equal; the empty text stays empty.

    What one step joins (a letter and a mark that a deleted character kept apart) the next one sees,
    until a step changes nothing; if steps should come round to a text again, the least of that round is the form.
    """
    if text.isascii() and "\t" not in text:
        return text
    seen = []
    while text not in seen:
        seen.append(text)
        text = _step(text)
    return min(seen[seen.index(text) :])


def with_forms(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """The columns `keys`, and raw and form: 128-bit hashes of each text and of its normal form. Nulls are left out."""
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for n, k in zip(names, keys)], F.col(text).alias("t")).where("t IS NOT NULL")
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            raw, form = [], []
            for t in batch.column(len(names)).to_pylist():
                other = normal_form(t)
                raw.append(xxhash.xxh3_128_digest(t))
                form.append(raw[-1] if other == t else xxhash.xxh3_128_digest(other))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(raw, pa.binary()), pa.array(form, pa.binary())], [*names, "raw", "form"])

    done = rows.mapInArrow(scan, f"{kinds}, raw binary, form binary")
    return done.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "raw", "form")


def look_classes(forms: DataFrame, key: str, group: list[str]) -> DataFrame:
    """group, form, raw, key of each row whose form is written in more than one way within its group: the classes of texts that look the same, with their members.

    forms comes from with_forms. A row a member: the many copies of a text aren't expanded into pairs.
    """
    several = forms.groupBy(*group, "form").agg(F.min("raw").alias("x"), F.max("raw").alias("y")).where("x != y").select(*group, "form")
    return forms.join(several, [*group, "form"], "left_semi").select(*group, "form", "raw", key).distinct()


def same_looks(forms: DataFrame, key: str, group: list[str]) -> DataFrame:
    """group, id_a, id_b (id_a < id_b): the members of look_classes as pairs of rows whose texts differ."""
    rows = look_classes(forms, key, group).withColumnRenamed(key, "id")
    a, b = rows.withColumnsRenamed({"raw": "raw_a", "id": "id_a"}), rows.withColumnsRenamed({"raw": "raw_b", "id": "id_b"})
    return a.join(b, [*group, "form"]).where("id_a < id_b AND raw_a != raw_b").select(*group, "id_a", "id_b").distinct()
