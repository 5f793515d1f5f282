import re
from collections import Counter

from pyspark.sql import functions as F

from plumbline.llm import decontaminate, html_text, quality_rules


def test_quality_measures_on_odd_rows(spark):
    prose = "the cat and the dog of it was " * 3 + " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)} and" for i in range(60))
    rows = [(1, None), (2, ""), (3, "\n\n a\n a\n"), (4, "x#y *** $"), (5, "a b c a b c"), (6, prose), (6, prose), (7, "one two " * 40), (8, "né e " * 60000), (None, prose)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit("clash"))
    got = quality_rules.quality(df).collect()
    assert len(got) == len(rows)

    def reference(text):
        w = [x for x in re.split(r"[ \t-\r]+", text or "") if x]
        wins = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        count, cover = Counter(wins), set()
        for i, x in enumerate(wins):
            if count[x] > 1:
                cover |= {i, i + 1, i + 2}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^ \t-\r]", x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover)

    for r in got:
        want = reference(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.failed)
    assert sorted(r.doc_id or 0 for r in got if r.kept) == [0, 6, 6]
    assert quality_rules.quality(df.limit(0)).count() == 0


def test_alignment_equals_the_full_matrix():
    def plain(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        return max(map(max, h))

    import random

    rng = random.Random(2)
    for _ in range(60):
        a, b = ([rng.choice([b"x", b"y", b"z", b"w"]) for _ in range(rng.randrange(1, 14))] for _ in range(2))
        score, first, last = decontaminate.smith_waterman(a, b)
        assert score == plain(a, b)
        if score:
            assert decontaminate.smith_waterman(a, b[first:last + 1])[0] == score and a.count(b[first]) and a.count(b[last])


def test_exact_edited_and_clean_passages(spark):
    item = "how many apples does the farmer sell when seven baskets of green pears are traded for nine boxes of fruit on a rainy market day"
    w = item.split()
    edited = " ".join(x for i, x in enumerate(w) if i % 9)
    changed = " ".join("zzz" if i % 6 == 0 else x for i, x in enumerate(w))
    other = "the farmer sells apples and pears on a market day when it rains many times in a year for the fruit of trees " * 3
    docs = [(1, f"before {item.upper()}! after"), (2, f"lead in {edited} end"), (3, f"so {changed} it"), (4, other), (5, None), (6, ""), (7, item), (7, item),
            (8, "filler word " * 40000 + item.replace(" ", ", "))]
    items = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "too short"), (None, item), (14, "a totally different question about rivers and lakes in spring")],
                                  "item_id long, text string").withColumn("score", F.lit("clash"))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(0))
    for parts in (1, 50_000):
        got = df.select("doc_id", F.explode(decontaminate.contamination(F.col("text"), items, items_per_part=parts)).alias("h")).select("doc_id", "h.*").collect()
        assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 10), (2, 10), (3, 10), (7, 10), (7, 10), (8, 10)]
        spans = {r.doc_id: (r.first_word, r.last_word) for r in got}
        assert spans[1] == (1, len(w)) and spans[8] == (80000, 80000 + len(w) - 1)
    none = decontaminate.contamination(F.col("text"), items.limit(0))
    assert df.filter(F.size(none) > 0).count() == 0 and df.limit(0).select(none).count() == 0


def test_halves_and_paraphrases_of_items_as_alignment_alone_finds_them(spark):
    import random

    rng = random.Random(8)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(400)]
    items = {i: [rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(rng.randrange(15, 50))] for i in range(40)}
    use = Counter(x for w in items.values() for x in set(w))
    docs = {}
    for i, w in items.items():
        scarce = set(sorted(range(len(w)), key=lambda k: use[w[k]])[:len(w) // 4])
        around = lambda words: ["pad"] * 20 + words + ["end"] * 20
        docs[i] = around(w[:len(w) // 2 + 1])
        docs[100 + i] = around(w[len(w) // 2:])
        docs[200 + i] = around(["zzz" if k in scarce else x for k, x in enumerate(w)])
    # What alignment finds with a common 3-gram to start from; the others have no seed whatever is looked up.
    grams = {i: {tuple(w[k:k + 3]) for k in range(len(w) - 2)} for i, w in items.items()}
    want = {(d, i) for d, words in docs.items() for i, w in items.items()
            if decontaminate.smith_waterman([x.encode() for x in w], [x.encode() for x in words])[0] >= len(w)
            and grams[i] & {tuple(words[k:k + 3]) for k in range(len(words) - 2)}}
    assert {(100 + i, i) for i in items} <= want
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    for parts in (9, 50_000):
        got = df.select("doc_id", F.explode(decontaminate.contamination(F.col("text"), table, items_per_part=parts)).alias("h")).select("doc_id", "h.item_id").collect()
        assert {(r.doc_id, r.item_id) for r in got} == want


def test_minimum_cut_equals_all_labellings():
    import itertools
    import random

    rng = random.Random(4)
    for _ in range(80):
        n = rng.randrange(1, 8)
        scores = [rng.randrange(-9, 10) for _ in range(n)]
        edges = {(i, j): rng.randrange(0, 8) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}

        def cost(side):
            return sum(max(0, -s) if x else max(0, s) for s, x in zip(scores, side)) + sum(c for (i, j), c in edges.items() if side[i] != side[j])

        best = min(cost(s) for s in itertools.product([False, True], repeat=n))
        assert cost(html_text.minimum_cut(scores, edges)) == best


def test_pages(spark):
    page = """<!doctype html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header class="site">Site name</header>
    <nav><a href="/">Home</a> <a href="/b">Blog</a></nav><div class="cookie-notice">We use cookies.</div>
    <article><h1>The  title &amp; more</h1><p>First <b>bold</b> text.<p>Second&nbsp;one &lt;b&gt;,<br>after a break.</p><div class="ad">Buy now!</div>
    <ul><li>item one</li><li>item two</li></ul><!-- <p>hidden</p> --><p>Ti.</p></article>
    <aside>Related: <a href="x">other story</a></aside><section id="comments"><p>Great text, thanks a lot for sharing it with all of us here!</p></section>
    <form><p>Your mail</p><input name="q"></form><footer>&copy; 2024</footer></body>"""
    want = "The title & more First bold text. Second one <b>, after a break. item one item two Ti."
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, None, page), (4, None, page), (5, "u", "<article><p>" + "long text " * 50000 + "</article>"), (6, "u", "<p>x<script>y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.extract(df).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and texts[1] == want and texts[4] == want and texts[2] == "" and texts[3] == ""
    assert texts[5] == ("long text " * 50000).strip() and texts[6] == "x"
    assert html_text.extract(df.limit(0)).count() == 0
