import html as markup
import itertools
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from tamis.llm import html_text, transcripts
from tests.llm import edge


def plain_article(page):
    """The article of the synthetic pages by their known template."""
    inside = re.search(r"<article>(.*?)(</article>|$)", page, re.S)
    blocks = re.split(r"</?(?:p|h1)>", inside[1]) if inside else []
    texts = [" ".join(markup.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_small_pages_match_their_template(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r.page_id: r for r in html_text.extracted(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == plain_article(r.html)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


PAGE = """<html><head><title>T</title><script>if (a < b) {"</p>"}</script></head><body class="has-sidebar"><header class=top><a href=/>Home</a></header>
<div id="cookie-notice">We use cookies. Do you accept all of them, my dear reader of this page?</div>
<div class="wrap"><div class="left"><h2>A title of the story</h2><p>First paragraph with some words &amp; an <b>inline</b> word, long enough to count as prose.
<p>Second paragraph, also with quite a few words in it &#8211; and a <a href="/x">link</a>.<div class="ad">Buy this great thing now, it is so good for you, really.</div>
<p>Short one.</p><p>Third paragraph closes the story with enough words to be called a real one.</p>
<form><label>Your mail</label><input value="x"><button>Send</button></form></div>
<section class="comments"><p>I liked this story very much, thank you for writing it and for all the work.</p></section>
<aside><p>Other stories that you may want to read, about many different things in life.</p></aside></div>
<footer>Copyright and so on. All of it.</footer></body></html>"""


def test_a_page_without_landmarks(spark):
    got = html_text.extracted(spark.createDataFrame([(1, "u", PAGE)], "page_id long, url string, html string")).first().text.split("\n")
    assert got == ["A title of the story", "First paragraph with some words & an inline word, long enough to count as prose.",
                   "Second paragraph, also with quite a few words in it – and a link.", "Short one.",
                   "Third paragraph closes the story with enough words to be called a real one."]


PROSE = [f"Paragraph {k} of this article has a good number of words, so that anyone would call it prose." for k in range(4)]
PROBE = "<body><nav><a href=/>Home</a></nav>{}" + "".join(f"<p>{p}</p>" for p in PROSE) + "{}<footer>Copyright and more</footer></body>"


def test_one_word_of_a_class_name_loses_no_article(spark):
    whole = [('<article class="post no-sidebar">', "</article>"), ('<article class="entry social-policy">', "</article>"), ('<article id="widget-review">', "</article>"),
             ('<main class="form-friendly">', "</main>"), ('<div class="layout-with-menu"><article>', "</article></div>"), ('<article class="post">', "</article>"),
             ('<form action="/"><article>', "</article></form>"), ('<article class="post share">', "</article>")]
    none = [('<section class="comments"><article>', "</article></section>"), ('<div class="site-footer">', "</div>"), ('<div id="related-posts"><article>', "</article></div>"),
            ("<div hidden>", "</div>"), ('<section class="cookie-notice">', "</section>")]
    pages = [(k, "u", PROBE.format(*around)) for k, around in enumerate(whole + none)]
    got = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(len(whole))] == ["\n".join(PROSE)] * len(whole)
    assert [got[k] for k in range(len(whole), len(pages))] == [""] * len(none)


def test_the_fitted_cut_needs_no_landmarks(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    odds = html_text.fit(pages)
    for r in pages.collect():
        bare = re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", r.html).replace(' class="ad"', "")
        assert html_text.main_text(bare, odds) == plain_article(r.html)


def test_broken_pages_take_time_in_proportion():
    for page in ("<b>" * 32_000 + "x</i>" * 32_000, "<i><p>" + "<b>" * 32_000 + "x</i>" * 32_000, "<div>" * 32_000 + "t</div>x" * 32_000,
                 "<div>" + "<b>" * 32_000 + "<p>t</p>" * 32_000):
        begin = time.process_time()
        html_text.blocks_of(page)
        assert time.process_time() - begin < 1


def test_formulas_stay_in_their_sentence():
    page = "<article><p>The sum <math><mi>a</mi><mo>+</mo><mi>b</mi></math> of <object>two</object> values.</p><p>Next <b>one</p><p>unclosed</b> here.</p></article>"
    assert [b.text for b in html_text.blocks_of(page)] == ["The sum a+b of two values.", "Next one", "unclosed here."]


def test_minimum_cut_is_minimal():
    draw = random.Random(2)
    for _ in range(60):
        n = draw.randint(1, 8)
        excess = [draw.choice([-3.0, -1.5, -0.5, 0.0, 0.5, 1.0, 4.0]) for _ in range(n)]
        edges = [(a, b, draw.choice([0.4, 1.0, 2.5])) for a in range(n) for b in range(a) if draw.random() < 0.5]

        def cost(side):
            cut = sum(e for e, s in zip(excess, side, strict=True) if e > 0 and not s) + sum(-e for e, s in zip(excess, side, strict=True) if e < 0 and s)
            return cut + sum(c for a, b, c in edges if side[a] != side[b])

        best = min(cost([m >> i & 1 for i in range(n)]) for m in range(2**n))
        assert abs(cost(html_text.max_flow_side(excess, edges)) - best) < 1e-6


def test_page_edge_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>broken <b a='"), (None, "u", "no markup at all, but a whole sentence of plain text."), (4, "u", "&lt;" * 9),
            (5, "u", "<article>" + "<p>Word after word, line &eacute;.</p>" * 5000 + "</article>"), (5, "u", "<article><p>a b  c</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_text.extracted(edge.with_clashes(df)).collect()
    assert len(got) == len(rows) and all(r.text is not None and r.n_chars == len(r.text) for r in got)
    assert max(r.n_chars for r in got) == 5000 * len("Word after word, line é.\n") - 1
    assert html_text.extracted(df.limit(0)).count() == 0


def test_roles_and_turns_of_held_out_transcripts(spark):
    talks = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = transcripts.recovered(talks).where("held_out").join(talks.withColumnRenamed("role", "true").withColumnRenamed("text", "said"), ["conv_id", "turn"], "left")
    n, right, same = got.agg(F.count("*"), F.sum((F.col("role") == F.col("true")).cast("int")), F.sum((F.col("text") == F.trim("said")).cast("int"))).first()
    whole = talks.where(~transcripts.in_training(F.col("conv_id"))).count()
    assert right / whole > 0.95 and same / whole > 0.9 and abs(n - whole) < 0.05 * whole


def test_blocks_decode_as_one_piece(spark):
    draw = np.random.default_rng(4)
    log = lambda t: np.log(t / t.sum(-1, keepdims=True))
    model = transcripts.Hmm(log(draw.random(6)), log(draw.random((6, 6))), {"user": 2, "ai": 3}, *(log(draw.random((6, n))) for n in (4, 2, 4)))
    lines = [(1, i, draw.choice(["User: a", "AI: b", "and so on", "Hm: " + "x" * 50]), bool(i % 3)) for i in range(300)]
    df = transcripts.observed(spark.createDataFrame([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in lines],
                                                    "conv_id long, line_no long, text string, blank_before boolean"))
    whole = edge.rows(transcripts.decoded(df, model, 1000).select("line_no", "role", "turn"))
    assert edge.rows(transcripts.decoded(df, model, 7).select("line_no", "role", "turn")) == whole


def test_the_best_way_of_all_ways(spark):
    draw = np.random.default_rng(5)
    log = lambda t: np.log(t / t.sum(-1, keepdims=True))
    model = transcripts.Hmm(log(draw.random(6)), log(draw.random((6, 6))), {"user": 2, "ai": 3}, *(log(draw.random((6, n))) for n in (4, 2, 4)))
    rows = [(conv, i, str(draw.choice(["User: a", "AI: b", "and so on", "Hm: " + "x" * 50, ""])), bool(i % 3)) for conv in range(3) for i in range(6)]
    seen = transcripts.observed(spark.createDataFrame(rows, "conv_id long, line_no long, text string, blank_before boolean"))
    got = {r.line_no: (r.role, r.turn) for r in transcripts.decoded(seen, model, 4).collect()}
    talks = {}
    for r in sorted(seen.collect(), key=lambda r: r.line_no):
        talks.setdefault(r.key, []).append(r)
    for lines in talks.values():
        scores = model.emissions([r.marker for r in lines], [r.blank for r in lines], [r.length for r in lines])
        ways = ((model.start[w[0]] + scores[0, w[0]] + sum(model.step[a, b] + scores[k + 1, b] for k, (a, b) in enumerate(itertools.pairwise(w))), w)
                for w in itertools.product(range(6), repeat=len(lines)))
        way, turn = max(ways)[1], 0
        for k, (r, state) in enumerate(zip(lines, way, strict=True)):
            turn += k > 0 and (state < 3) and any(x < 3 for x in way[:k])
            assert got[r.line_no] == (transcripts.ROLES[state % 3], turn)


def test_no_turn_melts_into_another(spark):
    train = [(i, t, ["user", "assistant"][t % 2], f"words of turn {t} in {i}\nwith a second line") for i in range(60) for t in range(4)]
    probe = [(None, 0, "user", "first lost talk"), (None, 0, "user", "second lost talk"), (900, 0, "user", "one place"), (900, 0, "assistant", "the same place\nwith two lines"),
             (901, 0, "user", "given twice"), (901, 0, "user", "given twice"), (902, 0, "user", "\n".join(f"line {k}" for k in range(9000)))]
    talks = spark.createDataFrame(train + probe, "conv_id long, turn long, role string, text string")
    got = [(r.conv_id, r.text) for r in transcripts.recovered(talks).collect() if r.conv_id is None or r.conv_id >= 900]
    assert sorted(t for c, t in got if c is None) == ["first lost talk", "second lost talk"]
    assert sorted(t for c, t in got if c == 900) == ["one place", "the same place\nwith two lines"]
    assert [t for c, t in got if c == 901] == ["given twice"] * 2
    assert [t for c, t in got if c == 902] == [probe[-1][3]]


def test_transcript_edge_rows(spark):
    shape = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "Hi\nthere"), (1, 1, "assistant", None), (1, 1, "assistant", None), (None, None, None, "lost"), (2, 0, "robot", ""), (2, 1, "user", "x " * 50_000)]
    got = transcripts.recovered(edge.with_clashes(spark.createDataFrame(rows, shape)))
    assert {r.conv_id for r in got.collect()} == {1, 2, None}
    assert got.where("role IS NULL OR text IS NULL OR rendered IS NULL").count() == 0
    assert transcripts.recovered(spark.createDataFrame([], shape)).count() == 0
