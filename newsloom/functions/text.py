"""Text functions as column expressions.

Java's word class differs from that of Unicode letters and numbers without marks, so classes are
spelled out: a combining mark is no word character here, as in the rules that these hashes follow.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s  -     　]+"
SEPARATORS = (" | ", " – ", " — ", " - ", " : ", " :: ")
TITLE_SEPARATORS = (" | ", " – ", " — ", " - ", " : ")
AD_LINES = ("advertisement", "विज्ञापन")
SCRIPTS = {"Latn": r"A-Za-zÀ-ɏḀ-ỿ", "Deva": r"ऀ-ॿ", "Arab": r"؀-ۿݐ-ݿﭐ-﷿ﹰ-\x{FEFF}"}


def search_norm(c: Column) -> Column:
    """Lower case, with hyphens and underscores as spaces; null is the empty text."""
    return F.lower(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("-"), F.lit(" ")), F.lit("_"), F.lit(" ")))


def matches_token(c: Column, token: str) -> Column:
    """Whether a text holds a token, both normalised; wildcards in the token are ordinary characters."""
    return search_norm(c).contains(search_norm(F.lit(token)))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, _SPACE, " "))


def _head(c: Column, separators: tuple[str, ...]) -> Column:
    for s in separators:
        c = F.substring_index(c, s, 1)
    return c


def normalise_headline(c: Column) -> Column:
    """The part before the first separator, in lower case, without punctuation and combining marks; '' for null."""
    head = _head(F.lower(collapse_ends(F.coalesce(c, F.lit("")))), SEPARATORS)
    return collapse(F.regexp_replace(head, r"[^\p{L}\p{N}_\s]", ""))


def collapse_ends(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")


def headline_hash(c: Column) -> Column:
    norm = normalise_headline(c)
    return F.when(norm != "", F.sha2(norm, 256))


def content_hash(c: Column) -> Column:
    """SHA-256 of the collapsed text; null below 50 characters."""
    text = collapse(c)
    return F.when(F.length(text) >= 50, F.sha2(text, 256))


def normalise_title(c: Column) -> Column:
    """The part before a separator, without separators at its ends."""
    return F.trim(F.regexp_replace(_head(F.trim(c), TITLE_SEPARATORS), r"^[ \-–—|:\t]+|[ \-–—|:\t]+$", ""))


def tokens(c: Column) -> Column:
    """Latin and Devanagari words in lower case, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z]+|[ऀ-ॿ]+)"), 1)


def shingles(words: Column, k: int = 5) -> Column:
    """Distinct runs of k words; a shorter text is one run, an empty one none."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).when(F.size(words) < k, F.array(F.array_join(words, " "))).otherwise(F.array_distinct(runs))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two sets; 0 if one is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def numbers(c: Column) -> Column:
    """Distinct numbers of a text, digits of any script as ASCII, without separators."""
    ascii_ = F.translate(F.coalesce(c, F.lit("")), "०१२३४५६७८९٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "0123456789" * 3)
    return F.array_distinct(F.transform(F.regexp_extract_all(ascii_, F.lit(r"([0-9][0-9,]*)"), 1), lambda x: F.replace(x, F.lit(","), F.lit(""))))


def latin_nouns(c: Column) -> Column:
    """Capitalised Latin words, in lower case, distinct."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"([A-Z][a-z]{2,}|[A-Z]{2,})"), 1), F.lower))


def script_shares(c: Column) -> Column:
    """Map of script to its share of the letters of the known scripts."""
    text = F.coalesce(c, F.lit(""))
    counts = {s: F.length(F.regexp_replace(text, f"[^{chars}]", "")) for s, chars in SCRIPTS.items()}
    total = sum(counts.values(), F.lit(0))
    entries = F.array(*[F.struct(F.lit(s).alias("s"), (n / total).alias("share")) for s, n in counts.items()])
    return F.when(total > 0, F.map_from_entries(F.filter(entries, lambda e: e["share"] > 0)))


def without_ad_lines(c: Column) -> Column:
    return F.array_join(F.filter(F.split(c, r"\R"), lambda line: ~F.lower(F.trim(line)).isin(*AD_LINES)), "\n")


def conciseness(c: Column) -> Column:
    """15 for 40 to 110 characters, 8 for 25 to 39 and 111 to 140, else 0."""
    n = F.length(c)
    return F.when(n.between(40, 110), 15).when(n.between(25, 39) | n.between(111, 140), 8).otherwise(0)


def clickbait(c: Column, markers: tuple[str, ...] = ()) -> Column:
    """All capitals over 15 characters, three marks of exclamation and question, or one of the caller's marker phrases."""
    marks = F.length(c) - F.length(F.regexp_replace(c, "[!?]", ""))
    said = ((F.upper(c) == c) & (F.lower(c) != c) & (F.length(c) > 15)) | (marks >= 3)
    for marker in markers:
        said = said | F.lower(c).contains(marker.lower())
    return said


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def description(c: Column) -> Column:
    """The first 500 characters, null if none."""
    return F.nullif(F.substring(c, 1, 500), F.lit(""))


def term_cosine(a: Column, b: Column) -> Column:
    """Cosine of the word counts of two word lists, 0 if one is empty."""
    count = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    dot = F.aggregate(F.array_intersect(a, b), F.lit(0.0), lambda s, w: s + count(a, w) * count(b, w))
    norm = lambda words: F.sqrt(F.aggregate(F.array_distinct(words), F.lit(0.0), lambda s, w: s + count(words, w) * count(words, w)))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), dot / (norm(a) * norm(b))).otherwise(0.0)
