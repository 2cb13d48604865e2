import random

import regex

from newsloom.llm import boilerplate, html

NOTICE = "To point out an error write to the desk."


def page(body, n):
    return (
        f"<html><head><title>T {n}</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div id='c'><p>We use cookies on this site. Accept.</p></div>"
        f"<div class='x'><h1>Head {n}</h1><div class='by'>By the staff</div>{body}<p style='display:none'>Hidden words in here.</p></div>"
        f"<div class='y'><h4>Other</h4><p>A teaser of another story is here {n}.</p></div><footer><p>All rights are reserved here.</p></footer></body></html>"
    )


def test_repeated_lines_against_counting(spark):
    rng = random.Random(4)
    notices = [NOTICE, "साझा करें अपने पड़ोसियों से", "Read our morning letter every day", "rare line of three records"]
    rows = []
    for i in range(120):
        source = rng.choice([1, 1, 1, 2, 3])
        lines = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(12)) for _ in range(4)]
        for k, p in ((0, 0.3), (1, 0.15), (2, 0.08)):
            if rng.random() < p:
                line = notices[k]
                lines.insert(rng.randrange(5), rng.choice([line, line.upper(), f"*** {line} ***", "  ".join(line.split())]))
        rows.append((i, source, "\n".join([*lines, "—", ""])))
    rows += [(500 + i, 9, notices[3]) for i in range(3)] + [(600, 9, None), (601, None, NOTICE), (602, 9, ""), (603, 9, "x\n" * 5000), rows[0]]
    counts, total = {}, {}
    key = lambda line: regex.sub(r"[^\p{L}\p{M}]", "", line.lower())
    for i, s, body in rows:
        total.setdefault(s, set()).add(i)
        for line in (body or "").split("\n"):
            if key(line):
                counts.setdefault((s, key(line)), set()).add(i)
    want = {
        (i, n) for i, s, body in rows if s is not None for n, line in enumerate((body or "").split("\n"))
        if key(line) and len(counts[s, key(line)]) >= 4 and len(counts[s, key(line)]) >= 0.1 * len(total[s])
    }
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "record_id bigint, source_id int, body string, k string, n int")
    found = boilerplate.repeated_lines(df, "record_id", "source_id", "body")
    assert {(r.record_id, r.line_no) for r in found.collect()} == want and want
    clean = {r.record_id: r.body for r in boilerplate.without_lines(df, "record_id", "body", found).collect()}
    assert clean[600] is None and all(key(NOTICE) not in key(b) for i, b in clean.items() if b and (i, 0) in want)
    assert boilerplate.repeated_lines(df.limit(0), "record_id", "source_id", "body").count() == 0


def test_chunks_depend_on_the_line_alone():
    lines = ["alphabetagammadeltaepsilonzetaeta" * 3, "", "x", "anotherlineofwordsthatislongenoughtobecut"]
    alone = [boilerplate.chunk_hashes([x])[0].tolist() for x in lines]
    assert [x.tolist() for x in boilerplate.chunk_hashes(lines)] == alone and len(alone[0]) > 1 and alone[1] == []


def test_main_paragraphs(spark):
    texts = [f"<p>First paragraph number {n} of the story told <b>here</b>.</p><p><a href='/r'>Must read | other story {n}</a></p><p>Second one, &quot;said&quot; a clerk {n} today." for n in range(8)]
    rows = [("pages", n, "a.example", f"u{n}", page(t, n), True) for n, t in enumerate(texts)]
    rows += [("pages", 90, "a.example", "u0", page(texts[0], 0), True), ("pages", 91, None, None, None, True), ("pages", 92, "b.example", "u", "", True), ("pages", 93, "b.example", "v", "<p>broken <div", True)]
    rows += [("lines", 1, "a.example", "l1", "Home  News\nA line of running text is here.\nAll rights are reserved here.\nMust read | something else", False)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "src string, row_id bigint, host string, page string, text string, markup boolean, key string")
    got = {(r.src, r.row_id, r.para_key) for r in boilerplate.main_paragraphs(df).collect()}
    want = {("pages", n, boilerplate.para_key(p)) for n in range(8) for p in (f"First paragraph number {n} of the story told here.", f'Second one, "said" a clerk {n} today.')}
    want |= {("pages", 90, k) for s, n, k in want if n == 0} | {("lines", 1, boilerplate.para_key("A line of running text is here."))}
    assert got == want
    assert boilerplate.main_paragraphs(df.limit(0)).count() == 0
    bare = spark.createDataFrame([("pages", 1, "a.example", "u", "<div></div>", True, "x")], df.schema)
    assert boilerplate.main_paragraphs(bare).count() == 0


def test_recurring_subtrees_go_whole(spark):
    """A box of two sentences that recurs on a host goes whole though it stands in the article; the same sentences on another host stay."""
    box = "<div class='box'><p>Our paper has told this town its news since 1950.</p><p>Write to the desk with what you know.</p></div>"
    story = lambda n: f"<p>First paragraph number {n} of the story told here.</p>"
    rows = [("pages", n, "a.example", f"u{n}", page(story(n) + box, n), True) for n in range(5)]
    rows += [("pages", 10 + n, f"h{n}.example", f"v{n}", page(story(n) + box, n), True) for n in range(5)]
    df = spark.createDataFrame(rows, "src string, row_id bigint, host string, page string, text string, markup boolean")
    held = boilerplate.without_templates(boilerplate.subtrees(df)).collect()
    left = {r.row_id: {t.key for t in r.texts if not t.gone} for r in held}
    words = {boilerplate.para_key(x) for x in ("Our paper has told this town its news since 1950.", "Write to the desk with what you know.", "All rights are reserved here.", "We use cookies on this site. Accept.", "Home")}
    assert all(not left[n] & words for n in range(5)) and all(words <= left[10 + n] for n in range(5))
    shares = boilerplate.template_shares(df).first()
    assert shares.deleted == sum(t.gone for r in held for t in r.texts) >= 5 * 7 and shares.kept == 5 + 5 * 3 and shares.texts == sum(len(r.texts) for r in held)


def test_subtree_hashes():
    one, two = (boilerplate.page_subtrees(f"<div class='a'><ul><li>x 1</li><li>y</li></ul></div><p>{t}</p>") for t in ("One ends here now.", "Two ends here now."))
    assert set(one.hashes) & set(two.hashes) >= {one.hashes[i] for i in (one.paths[0][0], *one.paths[0][2:])}  # the list and all around it, but for the whole page
    other = boilerplate.page_subtrees("<div class='b'><ul><li>x 2</li><li>y</li></ul></div>")
    assert other.hashes[other.paths[0][0]] == one.hashes[one.paths[0][0]] and len(set(other.hashes) & set(one.hashes)) == 5  # any number for any other; another class is another subtree


def test_blocks_of_broken_markup():
    assert [b.text for b in html.blocks("<p>one<p>two<br>three<br><br>four</div></td><!-- x --><script>if(a<b)</script><p>caf&eacute; <b>b</b>old")] == ["one", "two three", "four", "café bold"]
    assert html.blocks("") == [] and html.blocks("<script>never closed <p>x</p>") == []
    assert [b.text for b in html.blocks("a <Your text here> b")] == ["a <Your text here> b"]
    assert html.blocks("<div>" * 3000 + "deep" + "</div>" * 3000)[0].text == "deep"
