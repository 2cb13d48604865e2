"""Template residue, filler, error messages and script notices in place of an article.

Unfilled placeholders are found by one grammar for each kind of delimiter, and judged in the whole
text: those in fenced code, those quoted or named as examples in a sentence about templates, and those
of a text dense in code don't count. What only a machine writes (a stack trace, an undefined variable)
counts wherever it takes a line; what a server tells its reader counts by structure: a text of short
sentences, without running text, in which a thing of the web and what befell it stand together. So
a report about an error page, or a sentence that begins like a message, isn't taken for one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import html

# Grammars of placeholders, by delimiter.
_GRAMMAR = re.compile(
    r"\{\{[^{}\n]{0,80}\}\}|\{%[^%\n]{0,80}%\}|\$\{[^{}\n]{1,60}\}|#\{[^{}\n]{1,60}\}|<%[^%\n]{0,80}%>|<\?(?:php|=)[^\n]{0,80}\?>|\{\d{1,2}\}|"
    r"\[\[[^\[\]\n]{1,60}\]\]|%%?[A-Z][A-Z_]{2,40}%%?|\b__[A-Z][A-Z0-9_]{1,40}__|"
    r"\{[a-z][a-z0-9_]{1,30}\}|\$[A-Z][A-Z_]{2,30}\$|\[(?:First|Last|Full|Your|User|Company|Customer|Author|Event|City|Start|End|Due) (?:Name|Date|Title|Address|City|Number|Place|Time)\]|"
    r"\[(?:INSERT|ADD|ENTER|YOUR|TYPE|REPLACE)\b[^\]\n]{0,60}\]|\[(?:NAME|TK|TKTK|DATE|DAY|PLACE|CITY|NUMBER|AMOUNT|TITLE|QUOTE|BODY|TEXT|HEADLINE|LEAD|SOURCE)\]|"
    r"<(?:[Yy]our|[Ii]nsert|[Ee]nter) [a-z ]{2,40}>|@Model\.\w+|@\{[\w.]+\}|\[object \w+\]"
)
_CODE = re.compile(r"```|~~~|<code|<pre|\bdef \w+\(|\bfunction\s*\w*\(|=>|;\s*\}|\bimport \w+|</?\w+>")
_ABOUT = re.compile(r"\b(?:template|placeholder|tutorial|syntax|snippet|variable|code|markup|programm\w+|developer|lesson)s?\b", re.I)
_QUOTES = "'\"`‘’“”"

# What only a machine writes, as a whole line.
_MACHINE = re.compile(
    r"^(?:"
    r"(?:\d{3}\s*)$|(?:http|http/\d(?:\.\d)?|status|error|त्रुटि|ত্রুটি|خرابی)(?: (?:code|status|error))?:?\s*[45]\d\d\b.{0,80}$|[45]\d\d[\s:.–-]+(?:error|not found|forbidden|bad gateway|internal server|service unavailable|gateway time|too many|unauthori[sz]ed)\b.{0,60}$|"
    r"error: \S.{0,60}(?:failed|could not|unable|missing|code \d)|(?:fatal |parse |syntax )?(?:error|warning|notice): (?:call to|undefined|cannot (?:modify|redeclare|read|open|use)|failed (?:to|opening)|uncaught|unexpected|division by)|"
    r"fatal error\b|stack trace:|#\d+ (?:/|\{main\})|\w+(?:Error|Exception)(?:: | at \w)|traceback \(most recent|"
    r"page not found(?:[.!]|$)|undefined(?:, undefined)*$|null$|nan$|none$|\(no content\)$|\[object \w+\]"
    r")",
    re.I,
)
# Things of the web, what befell them, and what their reader is told to do, in the languages of the sources.
_THING = re.compile(
    r"\b(?:page|site|website|server|host|browser|session|connection|database|gateway|service|request|requests|address|link|url|content|item|story|article|access|permission|something|captcha|puzzle|maintenance|front page|home page)\b|"
    r"[\w-]+\.(?:example|com|org|net|in)\b|पृष्ठ|पेज|खबर|सर्वर|पाना|त्रुटि|সার্ভার|পাতা|صفحہ|سرور",
    re.I,
)
_BEFELL = re.compile(
    r"not found|(?:can ?not|can['’]t|could not|couldn['’]t) (?:be )?(?:found|displayed|loaded|reached|connect|complete|open)|is not here|does(?: not|n['’]t) exist|never existed|(?:has|have|was|been|is) (?:moved|removed|deleted|blocked|unavailable|expired)|"
    r"\b(?:unavailable|expired|denied|forbidden|timed? ?out|timed out|went wrong|too many|no longer|not available)\b|blocked in your|(?:down|closed) for (?:scheduled )?maintenance|under maintenance|bad gateway|no answer|internal server error|connection (?:reset|refused)|"
    r"you are (?:a )?human|checking your browser|go back to the front page|rate limit|(?:sign|log) in again|do not have permission|"
    r"उपलब्ध नहीं|नहीं मिल|त्रुटि|व्यस्त|भेटिएन|পাওয়া যায়নি|পাওয়া যায়নি|ব্যস্ত|نہیں ملا|مصروف",
    re.I,
)
_MOMENT = re.compile(r"^(?:just a moment|one moment(?:,? please)?|please wait)\s*(?:…|\.{1,3}|!)?$", re.I)
_PART = re.compile(r"^(?:the )?(?:rest|remainder) of (?:this|the) (?:story|article|page|text)\b.{0,40}(?:could not|cannot|failed|was not|is not)", re.I)
_SCRIPTS = re.compile(
    r"^(?:"
    r"(?:please )?(?:turn on|enable|allow|activate) (?:java)?scripts?\b|.{0,40}\b(?:needs?|requires?) javascript|scripts (?:and cookies )?are (?:required|blocked|disabled)|your browser does not (?:run|support)|"
    r"we could not load the .{0,40}scripts|javascript (?:is|must|has)|loading(?:…|\.{3}|, please wait)|"
    r".{0,60}(?:जावास्क्रिप्ट|জাভাস্ক্রিপ্ট|جاوا ?اسکرپٹ|जाभास्क्रिप्ट).{0,20}(?:चालू|চালু|آن|फعال|सुरु|फعال|खोल)"
    r")",
    re.I,
)
_FILLER = re.compile(r"^(?:dummy text\b|(?:write|type|enter|put) your (?:story|text|article|content)\b|यहाँ खबर का|x{3,}(?: x+)+$|lorem ipsum\b|placeholder text\b|sample text\b)", re.I)
_GAPS = re.compile(r".{0,30}\bXXXX? .{0,80}\bTK\b")
# Words of the customary filler.
_LOREM = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua porta quis velit rutrum neque nulla felis vitae urna sapien culpa sint".split())
_WORD = re.compile(r"[^\W\d_]+")
_ENDS = frozenset(".!?।۔")


def _ended(line: str) -> bool:
    return line.rstrip("\"'”’)")[-1:] in _ENDS



def _placeholder(text: str) -> bool:
    """Whether a text has a placeholder that isn't shown as an example."""
    hits = list(_GRAMMAR.finditer(text))
    if not hits:
        return False
    if len(_CODE.findall(text)) * 200 > len(text) and _ABOUT.search(text):
        return False  # dense in code
    for m in hits:
        before, after = text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]
        quoted = before in _QUOTES and after in _QUOTES and before and after
        if quoted and _ABOUT.search(text[max(0, m.start() - 160) : m.end() + 160]):
            continue
        start = max(text.rfind(c, 0, m.start()) for c in ".!?।۔\n") + 1
        said = _GRAMMAR.sub(" ", text[start : m.end() + 120])
        if not (_ABOUT.search(text[start : m.start()]) and len(said.split()) >= 8):  # a sentence about the thing, with the thing as its example
            return True
    return False


def _filler(line: str) -> bool:
    if _FILLER.match(line) or ("XXX" in line and _GAPS.match(line)):
        return True
    first = line.split(None, 12)
    if len(first) < 6:
        return False
    few = len(set(first[:12])) <= 10
    if not few and not any(w.strip(".,").lower() in _LOREM for w in first[:3]):  # a filler line has no other words
        return False
    words = line.split()
    if len(set(words)) <= min(10, 0.25 * len(words)):
        return True
    if not any(w.strip(".,").lower() in _LOREM for w in first[:3]):
        return False
    words = _WORD.findall(line.lower())
    return sum(w in _LOREM for w in words) >= 0.6 * len(words)


#: A message is told in sentences of at most so many words.
SHORT = 11
_END = re.compile(r"[.!?।۔…]+(?:\s+|$)")


def _told(line: str) -> bool:
    """Whether a line tells its reader, in short sentences, what befell a page or a server."""
    if _MOMENT.match(line):
        return True
    parts = [p for p in _END.split(line) if p.strip()]
    if not parts or max(len(p.split()) for p in parts) > SHORT or "," in parts[0] and len(parts[0].split()) > 8:
        return False
    return bool(_BEFELL.search(line) and _THING.search(line)) and ": how " not in line.lower()


_SUSPECT = re.compile(r"[{}<\[@%$_]")


def residue(lines: list[str]) -> bool:
    """Whether lines that stand in an article's place hold residue."""
    open_, fenced, rest = False, False, []
    for line in lines:
        line = line.strip()
        if line.startswith(("```", "~~~")):
            open_, fenced = not open_, True
        elif line and not open_:
            rest.append(line)
    if open_:  # a fence that isn't closed fences nothing
        rest, fenced = [x.strip() for x in lines if x.strip()], False
    for line in rest:
        if (_SUSPECT.search(line) and _placeholder(line)) or _MACHINE.match(line) or _PART.match(line) or _filler(line):
            return True
    notice = lambda line: len(line) <= 240 and bool(_SCRIPTS.match(line))
    if any(len(line) >= 60 and _ended(line) and not notice(line) and not _told(line) for line in rest):  # running text
        return False
    if fenced and not any(_ABOUT.search(x) for x in rest):  # nothing but fences: what is in them is the text
        return residue([x for x in lines if not x.strip().startswith(("```", "~~~"))])
    return any(notice(line) or _told(line) for line in rest)


def page_residue(page: str) -> bool:
    """The same for a page: the blocks where its article stands, else all its text."""
    found = html.blocks(page)
    held = html.article(found)
    lines = [found[k].text for k in held]
    heads = [b.text for b in found if b.tag == "h1"]
    if any(_placeholder(x) for x in heads) or residue(lines) or residue([found[k].text for k in html.article(found, widen=False)]):
        return True
    if not any(html.prose(found[k]) for k in held):
        return residue([b.text for b in found if b.tag != "title"])
    return False


def flag(df: DataFrame, text: str, keys: list[str], markup: bool) -> DataFrame:
    """The columns `keys` of each row of df whose text (HTML if markup) holds residue.

    Null and empty texts hold none; repeated rows are judged each; long texts whole.
    """
    judge = page_residue if markup else lambda body: residue(body.split("\n"))
    names = [f"k{i}" for i in range(len(keys))]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.loc[[judge(t) for t in batch["t"]], names]

    rows = df.select(*[F.col(k).alias(n) for n, k in zip(names, keys)], F.col(text).alias("t")).where("t IS NOT NULL AND t != ''")
    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.mapInPandas(scan, schema).select(*[F.col(n).alias(k) for n, k in zip(names, keys)])
