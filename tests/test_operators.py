import random

from pyspark.sql import functions as F

from newsloom.functions import codes, hashing, text, urls
from newsloom.operators import cluster, dedup, discovery, evaluate, health, lexicon, retention, serve, titles, windows
from newsloom.sources import documents


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_batch_duplicates_follow_the_order(spark):
    """Against the rule taken row by row: a duplicate's keys make no other row a duplicate."""
    random.seed(5)
    data = [(i, random.choice([1, 2]), random.choice([None, *"abcdefghij"]), random.choice([None, *"klmnopqr"]), random.choice([None, *"stuvwx"])) for i in range(80)]
    kept, want = [], []
    for i, s, u, c, h in data:
        match = None
        for rule in range(3):
            for k in kept:
                if (rule == 0 and u and u == k[2]) or (rule == 1 and c and c == k[3]) or (rule == 2 and h and h == k[4] and s == k[1]):
                    match = k[0]
                    break
            if match is not None:
                break
        if match is None:
            kept.append((i, s, u, c, h))
        else:
            want.append((i, match))
    df = spark.createDataFrame(data, "id bigint, source_id int, canonical_key string, content_key string, headline_key string")
    got = rows(dedup.batch_duplicates(df))
    assert got == sorted(want, key=repr)


def test_exact_duplicates_rules(spark):
    kind = "id bigint, source_id int, canonical_key string, content_key string, headline_key string"
    known = spark.createDataFrame([(1, 1, "u1", "c1", "h1"), (2, 1, "u2", "c1", "h2"), (3, 2, "u3", None, None)], kind)
    new = spark.createDataFrame([(10, 9, "u2", "c1", "h1"), (11, 9, "x", "c1", "h1"), (12, 1, "x", "y", "h2"), (13, 2, "x", "y", "h2"), (14, 2, None, None, None)], kind)
    assert rows(dedup.exact_duplicates(new, known)) == [(10, 2, "canonical_url"), (11, 1, "content_hash"), (12, 2, "headline_hash")]


def test_near_duplicates(spark):
    base = "the council approved a new bridge over the river near the old market after a long debate on cost and safety"
    data = [(1, base), (2, base + " today"), (3, "completely other words about cricket scores and weather in the northern hills this week for all teams"), (4, base), (5, None), (6, "")]
    df = dedup.with_signature(spark.createDataFrame(data, "id bigint, body string"), "body")
    got = {(a, b) for a, b, _ in rows(dedup.near_duplicates(df))}
    assert (1, 2) in got and not any(3 in p for p in got)


def test_near_duplicates_of_a_crowded_band(spark):
    """More rows than the old limit of 1000 share one band and no second one; their pairs are all found."""
    words = " ".join(f"w{chr(97 + i)}" for i in range(12)).split()
    data = [(i, words, [7, 7, *range(1000 * i, 1000 * i + 126)]) for i in range(1, 1101)]
    data = [(i, [*w, f"x{i}"], s) for i, w, s in data]
    df = spark.createDataFrame(data, "id bigint, terms array<string>, sig array<bigint>")
    assert dedup.near_duplicates(df).count() == 1100 * 1099 // 2


def test_near_duplicates_of_one_word_set(spark):
    """Rows of one signature: different counts are compared, equal ones are members of the lowest id."""
    words = "alpha beta gamma delta kappa lambda sigma theta omega zeta".split()
    data = [(1, words), (2, words + ["alpha"] * 2), (3, words[::-1]), (4, words + ["alpha"] * 90), (5, words + ["alpha"] * 80)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in data], "id bigint, body string")
    got = {(a, b): c for a, b, c in rows(dedup.near_duplicates(dedup.with_signature(df, "body")))}
    cosine = lambda a, b: (a * b + 9) / ((a * a + 9) * (b * b + 9)) ** 0.5
    want = {(i, j): round(cosine(a, b), 3) for i, a in ((1, 1), (2, 3), (4, 91), (5, 81)) for j, b in ((1, 1), (2, 3), (4, 91), (5, 81)) if i < j}
    assert got == {p: c for p, c in want.items() if c >= 0.6} | {(1, 3): 1.0}


def test_near_duplicates_count_content_words(spark):
    """Function words don't make texts alike or long enough, and the query looks at the history."""
    stop = " the of and to in a that is for on" * 3
    a, b = "bridge river council market ferry canal school road mill tank" + stop, "cricket match bowler pitch umpire stadium toss wicket over innings" + stop
    df = spark.createDataFrame([(1, a), (2, b), (3, "bridge river" + stop), (4, "river bridge" + stop)], "id bigint, body string")
    assert rows(dedup.near_duplicates(dedup.with_signature(df, "body"))) == []


def test_near_duplicates_query_reads_the_history(spark, folder):
    from newsloom.plans import articles

    known = {r[0] for r in spark.read.parquet(f"{folder}/known_articles.parquet").select("known_id").collect()}
    got = articles.near_duplicates(spark, folder).collect()
    assert any(r.id_a in known or r.id_b in known for r in got) and any(r.cosine < 0.9 for r in got)


def test_components_against_union_find(spark):
    random.seed(2)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    want = sorted(((x, find(x)) for x in parent), key=repr)
    got = rows(cluster.components(spark.createDataFrame(edges, "a bigint, b bigint")))
    assert got == want


def test_range_pairs_against_all_pairs(spark):
    random.seed(3)
    a = [(random.choice("xy"), i, random.randrange(-500, 500)) for i in range(60)]
    b = [(random.choice("xy"), i, random.randrange(-500, 500)) for i in range(60)]
    want = sorted(((i, j) for k, i, t in a for m, j, u in b if k == m and abs(t - u) <= 50), key=repr)
    got = windows.range_pairs(spark.createDataFrame(a, "k string, i int, t bigint"), spark.createDataFrame(b, "k string, j int, u bigint"), ["k"], "t", "u", 50)
    assert rows(got.select("i", "j")) == want


def test_windows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "stop"), ("b", 1, "z"), ("a", 3, "w")], "k string, p int, v string")
    assert rows(windows.latest(df, ["k"], [F.col("p"), F.col("v")])) == [("a", 3, "y"), ("b", 1, "z")]
    assert rows(windows.take_while(df, "k", "p", F.col("v") == "stop")) == [("a", 1, "x"), ("b", 1, "z")]
    assert rows(windows.top_k(df, ["k"], [F.col("p"), F.col("v")], 2).select("k", "v")) == [("a", "stop"), ("a", "x"), ("b", "z")]
    assert rows(windows.budget(df, "k", ["p", "v"], 3).where("kept").select("v")) == [("stop",), ("w",), ("x",), ("z",)]
    assert rows(windows.keep_first(df, "k", ["p"]).select("k", "v")) == [("a", "x"), ("b", "z")]
    modes = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "c"), (2, "c"), (2, "a")], "k int, v string")
    assert rows(windows.mode_value(modes, "k", "v")) == [(1, "a"), (2, "c")]


def test_text_functions(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first()[0]

    lit = F.lit
    assert one(text.normalise_headline(lit("  Patna: Metro, opens! | Daily News "))) == "patna metro opens"
    assert one(text.normalise_headline(lit("पटना मेट्रो"))) == "पटन मटर"  # marks are no word characters
    assert one(text.normalise_headline(lit(None).cast("string"))) == ""
    assert one(text.content_hash(lit("short"))) is None
    assert one(text.content_hash(lit("a b " * 40))) == one(text.content_hash(lit(" a\n\nb " * 40)))
    assert one(text.numbers(lit("१,२३४ and 12,34 and 12,34"))) == ["1234"]
    assert one(text.shingles(text.tokens(lit("one two three")), 5)) == ["one two three"]
    assert one(text.shingles(text.tokens(lit("")), 5)) == []
    assert one(text.matches_token(lit("Metro_line"), "o-l"))
    assert not one(text.matches_token(lit("100 percent"), "100%"))
    assert one(text.normalise_title(lit("Name of it - Site"))) == "Name of it"
    assert one(text.without_ad_lines(lit("a\nAdvertisement\nb"))) == "a\nb"
    assert abs(one(text.term_cosine(text.tokens(lit("a b b")), text.tokens(lit("b c")))) - 2 / (5**0.5 * 2**0.5)) < 1e-9
    assert one(urls.normalise_url(lit("HTTP://Example.ORG:80/a/amp/?b=2&utm_source=x&a=1&amp#f"))) == "http://example.org/a?a=1&b=2"
    assert one(urls.normalise_url(lit("ftp://example.org/a"))) is None
    assert one(urls.normalise_url(lit("https://m.example.org"))) == "https://m.example.org/"
    assert one(urls.trusted_canonical(lit("https://www.a.org/x"), lit("https://a.org/y"))) == "https://www.a.org/x"
    assert one(urls.trusted_canonical(lit("https://b.org/x"), lit("https://a.org/y"))) is None
    assert [one(codes.failure_kind(lit(e))) for e in ("attempts-exhausted: http-403-blocked", "http-429-x", "http-408", "http-503", "http-404", "ECONNRESET", "odd")] == [
        "blocked403", "rateLimited429", "timeout", "serverError", "permanent", "timeout", "other"]
    assert [one(codes.backoff(lit(n))) for n in (0, 1, 2, 3, 20)] == [60, 60, 120, 240, 3600]


def test_sketches(spark):
    data = [(1, "a b c d e f g h".split()), (2, "a b c d e f g x".split()), (3, [])]
    df = spark.createDataFrame(data, "id int, w array<string>").withColumn("m", hashing.minhash("w")).withColumn("s", hashing.simhash("w"))
    got = {r.id: r for r in df.collect()}
    assert got[1].m == hashing.signature(data[0][1]) and got[3].m == [hashing.PRIME] * 128
    share = df.alias("a").crossJoin(df.alias("b")).where("a.id = 1 AND b.id = 2").select(hashing.agreement(F.col("a.m"), F.col("b.m")), hashing.hamming(F.col("a.s"), F.col("b.s"))).first()
    assert abs(share[0] - 7 / 9) < 0.15 and 0 < share[1] < 40


def test_signature_in_whole_numbers():
    """The arithmetic in 64 bits against that of unbounded whole numbers."""
    for items in (["a"], [str(i) for i in range(300)], ["खबर", "x" * 1000]):
        hashes = [hashing.item_hash(x) for x in items]
        assert hashing.signature(items) == [min((a * h + b) % hashing.PRIME for h in hashes) for a, b in hashing.parameters()]


def test_pair_score(spark):
    kind = "struct<entities: array<string>, event_type: string, terms: array<string>, districts: array<string>, category: string, at: bigint, numbers: array<string>>"
    full = (["e"], "flood", ["river", "rises"], ["d"], "weather", 0, ["12"])
    apart = (["e"], "flood", ["river", "rises"], ["x"], "weather", 168 * 3600, [])
    empty = ([], None, [], [], None, None, [])
    df = spark.createDataFrame([(full, full), (full, apart), (full, empty)], f"a {kind}, b {kind}")
    assert [r[0] for r in df.select(cluster.pair_score()).collect()] == [1.0, 0.55, 0.105]


def test_scores_of_labels_and_clusters(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), (None, "c"), ("d", None)], "t string, p string")
    got = {r.label: (r.precision, r.recall) for r in evaluate.scores(df, "t", "p").collect()}
    assert got == {"a": (1.0, 0.5), "b": (0.5, 1.0), "c": (0.0, 1.0), "d": (1.0, 0.0)}
    pairs = evaluate.cluster_pairs(spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 2)], "t int, p int"), "t", "p").first()
    assert (pairs.truth, pairs.said, pairs.both) == (3, 2, 1)
    assert evaluate.macro_f1(df.limit(0), "t", "p").first().labels == 0


def test_lexicon(spark):
    lex = spark.createDataFrame([("infra", "metro rail", 3.0), ("infra", "metro", 2.0), ("crime", "theft", 2.0)], "label string, phrase string, weight double")
    df = spark.createDataFrame([(1, "Metro rail opens", "the metro was late"), (2, "Theft", None), (3, None, "nothing here")], "id int, title string, body string")
    got = {r.id: (r.label, r.score) for r in lexicon.label(df, lex, "title", "body", "id", 3.0).collect()}
    assert got == {1: ("infra", 8.0), 2: ("crime", 4.0), 3: (None, 0.0)}
    names = spark.createDataFrame([(1, "East Bari"), (2, "पटना"), (2, "Patna")], "entity int, name string")
    texts = spark.createDataFrame([(1, "In East  Bari, near patna."), (2, "Northeast Baris"), (3, "पटना में"), (4, None)], "id int, t string")
    assert rows(lexicon.mentions(texts, names, "id", "t")) == [(1, 1), (1, 2), (3, 2)]


def test_serve(spark):
    stories = spark.createDataFrame([(1, "Metro line", "infra", "opening"), (2, "Other", None, None)], "story_id bigint, canonical_title string, primary_category string, event_type string").withColumn(
        "first_seen_at", F.to_timestamp(F.lit("2026-01-01 00:00:00"))
    ).withColumn("last_seen_at", F.col("first_seen_at"))
    members = spark.createDataFrame([(1, "x", "en", "A", "a.org", ["Patna"]), (2, "metro ticket", "hi", "B", "b.org", None)], "story_id bigint, headline string, language string, source_name string, source_domain string, entities array<string>")
    assert [tuple(r)[0] for r in serve.search(stories, members, ["metro"]).collect()] == [1, 2]
    assert [tuple(r)[0] for r in serve.search(stories, members, ["metro", "patna"]).collect()] == [1]
    assert [tuple(r)[0] for r in serve.search(stories, members, [], language="hi").collect()] == [2]
    assert serve.search(stories, members, ["metro"], year=2025).count() == 0
    m = health.assess(spark.createDataFrame([("a", 10, 2, 6, 0), ("b", 10, 1, 0, 0), ("c", 10, 7, 0, 0), ("d", 10, 10, 0, 0), ("e", 0, 0, 0, 0)], "s string, attempted int, succeeded int, blocked int, limited int"))
    assert [r.state for r in m.orderBy("s").collect()] == ["BLOCKED", "BROKEN", "DEGRADED", "HEALTHY", "STALE"]


def test_windows_in_bins(spark):
    """Against one sort of each key."""
    random.seed(11)
    data = [(random.choice("ab"), random.randrange(0, 300), random.randrange(2), i) for i in range(120)]
    df = spark.createDataFrame(data, "k string, t bigint, side int, id bigint")
    want, numbers, steps = [], [], []
    for key in "ab":
        last, before = None, None
        for n, (k, t, side, i) in enumerate(sorted((r for r in data if r[0] == key), key=lambda r: (r[1], r[2], r[3]))):
            if side == 0:
                last = i
            elif last is not None:
                want.append((i, last))
        for n, (k, t, side, i) in enumerate(sorted((r for r in data if r[0] == key), key=lambda r: (r[1], r[3]))):
            numbers.append((i, n + 1))
            steps.append((i, None if before is None else t - before))
            before = t
    assert rows(windows.as_of(df, ["k"], "t", 25).select("id", "of")) == sorted(want, key=repr)
    assert rows(windows.numbered(df, ["k"], "t", "id", 25).select("id", "position")) == sorted(numbers, key=repr)
    assert rows(windows.gaps(df, ["k"], "t", "id", 25).select("id", "gap")) == sorted(steps, key=repr)


def test_titles(spark):
    df = spark.createDataFrame([(1, "Metro line to Patna opens after nine years of work", "high", "high", 2, ["Patna"]), (1, "SHOCKING!!! YOU MUST SEE THIS", "high", "low", 1, ["Patna", "X"]), (1, " ", None, None, 0, None), (2, None, None, None, 0, [])], "s int, h string, c string, p string, t int, e array<string>")
    top = titles.top_entities(df, "s", "e")
    assert rows(top.select("s", F.array_join("top", ","))) == [(1, "patna,x")]
    won = titles.best(df.join(top, "s", "left"), "s", "h", titles.points(F.col("h"), F.col("c"), F.col("p"), F.col("top"), ["opens"]), "t")
    assert rows(won) == [(1, "Metro line to Patna opens after nine years of work", 70)]


def test_stories(spark):
    day = 86_400
    data = [
        (1, 0, "Bridge at Patna collapses, 12 hurt", None, ["bridge-1"], ["Patna"], "collapse", "infra"), (2, day, "12 hurt as bridge collapses at Patna", None, ["bridge-1"], ["Patna"], "collapse", "infra"),
        (3, 30 * day, "Bridge at Patna collapses, 12 hurt", None, ["bridge-1"], ["Patna"], "collapse", "infra"), (4, 0, "Cricket final", None, [], ["Gaya"], None, None), (5, None, "Undated", None, None, None, None, None),
    ]
    df = spark.createDataFrame(data, "id bigint, at bigint, headline string, body string, entities array<string>, districts array<string>, event_type string, category string")
    assert rows(cluster.stories(df)) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)]
    assert rows(cluster.candidates(df, crowded=1)) == [(1, 2)]
    best = cluster.assign(spark.createDataFrame([(1, 7, 0.7), (1, 5, 0.7), (1, 9, 0.65), (2, 5, 0.5)], "a int, s int, x double"), "a", "s", "x")
    assert rows(best) == [(1, 5, 0.7)]


def test_candidates_of_a_crowded_place(spark):
    """Different events, and a crowded bin beside one that isn't."""
    hour = 3600
    data = [(i, i % 2 * 10 * hour, "H", None, None, ["Patna"], f"event{i}" if i % 3 else None, None) for i in range(1, 8)] + [(9, 190 * hour, "H", None, None, ["Patna"], None, None), (8, 150 * hour, "H", None, None, ["Patna"], "event1", None)]
    df = spark.createDataFrame(data, "id bigint, at bigint, headline string, body string, entities array<string>, districts array<string>, event_type string, category string")
    want = sorted((a[0], b[0]) for a in data for b in data if a[0] < b[0] and abs(a[1] - b[1]) <= 72 * hour)
    for crowded in (1, 3, 1000):
        assert rows(cluster.candidates(df, 72, crowded)) == want


def test_stories_over_days_and_without_time(spark):
    """A week apart, undated, and alike in category and event with no place: against all pairs."""
    hour, said = 3600, "Bridge at Patna collapses, 12 hurt"
    data = [
        (1, 0, said, None, ["b"], ["Patna"], "collapse", "infra"), (2, 160 * hour, said, None, ["b"], ["Patna"], "collapse", "infra"), (3, None, said, None, ["b"], ["Patna"], "collapse", "infra"),
        (4, 900 * hour, said, None, None, None, "collapse", "infra"), (5, 900 * hour, said, None, None, None, "collapse", "infra"), (6, 1800 * hour, said, None, None, ["Gaya"], "collapse", "infra"), (7, None, "Other", None, None, None, None, None),
    ]
    df = spark.createDataFrame(data, "id bigint, at bigint, headline string, body string, entities array<string>, districts array<string>, event_type string, category string")
    assert rows(cluster.stories(df)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7)]


def test_walk_and_advance(spark):
    entries = spark.createDataFrame([("a", 1, "u1", 90), ("a", 2, "u2", None), ("a", 3, "u3", 70), ("a", 4, "u4", 50), ("b", 1, "v1", 9), ("b", 2, "seen", 8), ("c", 1, "w", 1)], "k string, position int, url string, at bigint")
    cursors = spark.createDataFrame([("a", "x", 60), ("b", "seen", None), ("d", "old", 5)], "k string, seen_url string, seen_at bigint")
    walked = discovery.walk(entries, cursors, "k", 2)
    assert rows(walked.select("k", "url", "kept")) == [("a", "u1", True), ("a", "u2", True), ("a", "u3", False), ("b", "v1", True), ("c", "w", True)]
    assert rows(discovery.advance(walked, cursors, "k")) == [("a", "u2", 60), ("b", "v1", 9), ("c", "w", 1), ("d", "old", 5)]
    one = spark.range(1)
    assert one.select(discovery.included(F.lit("https://a/x"), F.lit("Metro"), F.lit("(?i)metro"))).first()[0]
    assert not one.select(discovery.included(F.lit("https://a/x"), F.lit(None), F.lit("metro"))).first()[0]
    assert one.select(documents.summary_page(F.lit("A & B"), F.lit("x" * 60)).alias("p")).first().p.startswith("<html><head><title>A &amp; B</title>")
    assert one.select(documents.summary_page(F.lit("A"), F.lit("short")).alias("p")).first().p is None


def test_documents(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 broken")
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    files = documents.bounded(spark.read.format("binaryFile").load(str(tmp_path)))
    assert files.count() == 1 and files.select(documents.pdf_text("content")).first()[0] is None


def test_retention(spark):
    now = F.lit("2026-01-10 00:00:00").cast("timestamp")
    df = spark.createDataFrame([(1, "2026-01-09 00:00:00", None), (2, None, None), (3, None, "debugging"), (4, "2026-01-11 00:00:00", None)], "id int, e string, keep_reason string").select("id", F.col("e").cast("timestamp").alias("expires_at"), "keep_reason")
    assert rows(retention.purge(retention.with_expiry(df, now), now).select("id")) == [(2,), (3,), (4,)]
