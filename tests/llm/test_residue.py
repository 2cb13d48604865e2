import pytest

from newsloom.llm import residue

STORY = "The water board cleared the estimate for the old canal near the market on Monday. Residents asked for a fresh count of the houses."


@pytest.mark.parametrize("body", [
    "{{ story.lead | safe }}", f"{STORY}\n{{% include 'related' %}}", f"{STORY[:60]} ${{amount}} rupees.", "<%= story.text %>", "#{lead} #{body}", "[[content-slot-9606]]", "__BODY_2__", "%%BODY%%",
    f"{STORY}\n[INSERT QUOTE HERE]", f"{STORY} [NAME] agreed.", "<Your text here>", "@Model.Text", "[object Object]", "undefined, undefined", f"{STORY}\nnull", "NaN",
    "Lorem ipsum dolor sit amet velit neque porta magna quis vitae.", "blah " * 30, "xxxxxxxx xxxx xxxxxx xxx", "Dummy text for page layout. " * 4, "XXXX officials said on DAY that NUMBER people TK.",
    "404\nThe page you asked for is not here.", "Access denied. You do not have permission to open this page.", "Error 500: the server could not complete the request.", "Too many requests from your address.",
    "Fatal error: call to undefined function x() in /srv/a.php on line 2\nStack trace:", 'KeyError: "headline" while building page', "Session expired. Sign in again to continue.", f"{STORY}\nError: widget failed to load its text (code 549)",
    "यह पृष्ठ उपलब्ध नहीं है। कृपया मुख्य पृष्ठ पर जाएँ।", "পাতাটি খুঁজে পাওয়া যায়নি।", "صفحہ نہیں ملا۔", "Please turn on JavaScript to read this story.", "এই পাতা দেখতে জাভাস্ক্রিপ্ট চালু করুন।", "Loading…",
    f"{STORY}\nThe rest of this story could not be loaded. Turn on JavaScript to see it.",
    f"{STORY}\nDear {{name}}, thank you.", f"{STORY}\n$NAME$", "Dear [First Name],", "Something went wrong. Please try again later.", "Oops! That page can't be found.", "HTTP 500", "503 Service Unavailable", "Just a moment...",
    "```\n{{ lead }}\n```", f"{STORY}\n```\n{{{{ lead }}}}",
])
def test_residue(body):
    assert residue.residue(body.split("\n"))


@pytest.mark.parametrize("body", [
    STORY, f"Access denied, read the board at the depot, though 20 people walked past it. {STORY}", f"Printed slips carried the words 'insert name here' in place of 12 voters. {STORY}",
    f"Teachers taught pupils to write their first lines of JavaScript at the new room. {STORY}", f"The website showed error 404 through Sunday, and forms had to be filled by hand. {STORY}",
    f"{STORY}\nPlease turn on JavaScript for the best view of this site.", "[TO POINT OUT AN ERROR WRITE TO DESK@A.EXAMPLE]", f"The template tutorial shows the placeholder '{{{{ name }}}}' in its first lesson. {STORY}", "", "   ",
    "Warning: heavy rain is expected in the hills on Friday, the weather office said.", "Forbidden fruit is the name of the play that opened in the town on Monday.", "Just a moment of silence was kept for the miners on Monday.",
    "The server is down for maintenance, villagers at the bank counter were told.", "Access denied: how the village lost its road", "yes yes yes yes", f"Reporters learn that a placeholder such as {{{{ name }}}} is replaced by the editor, the lesson said. {STORY}",
    f"The lesson shows a template in three lines.\n```\n<h1>{{{{ title }}}}</h1>\n{{% include 'lead' %}}\n```\n{STORY}",
    "बैठक के शुरू में समिति ने समिति के काम की समिति से बात की और समिति को समिति का हिसाब दिया।",
])
def test_no_residue(body):
    assert not residue.residue(body.split("\n"))


def test_pages():
    whole = f"<html><body><noscript><p>Please turn on JavaScript for the best view.</p></noscript><article><h1>Head</h1><p>{STORY}</p></article><footer><p>Error 500: x</p></footer></body></html>"
    assert not residue.page_residue(whole)
    assert residue.page_residue(whole.replace(STORY, "Please turn on JavaScript to read this <b>story</b>."))
    assert residue.page_residue(whole.replace("Head", "{{ page.title }}"))
    assert residue.page_residue("<html><body><div id='app'></div><noscript>Access denied. No.</noscript></body></html>")
    assert residue.page_residue("<body><div><h1>Just a moment</h1><div>By the desk</div><div>Loading…</div></div><div><p>All rights are reserved by the trust that prints this paper in the town.</p></div></body>")
    assert not residue.page_residue("") and not residue.page_residue("<p>")


def test_flag(spark):
    rows = [(1, "null", "a"), (1, "null", "a"), (2, None, "a"), (3, "", "a"), (4, STORY * 2000, "a"), (5, "NaN", "a")]
    df = spark.createDataFrame(rows, "k0 int, t string, text string")
    assert sorted(r.k0 for r in residue.flag(df, "t", ["k0"], False).collect()) == [1, 1, 5]
    assert residue.flag(df.limit(0), "t", ["k0"], True).count() == 0
