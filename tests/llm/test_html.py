from hypothesis import given, settings, strategies as st

from phasewright.llm.html_blocks import leaf_blocks
from phasewright.llm.html_extraction import ChainModel, _PageMaker, extract_text, features, links, main_text, trained_model

PAGES = "page_id long, url string, html string, text string, n_chars int"
PAGE = (
    '<html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>All</a></li></ul></nav>'
    '<div class="ad">Buy this now.</div><article><h1>A&amp;B &lt;c&gt;</h1><p><b>First&nbsp;line  here.<br><p>Second <a href=x>linked</a>\n part.</p><p></p></article>'
    '<section id="comments"><article class="comment"><p>Nice one, thanks a lot for it.</p></article></section><footer>&copy; x &middot; All rights.</footer></body></html>'
)


def test_main_text():
    assert main_text(PAGE, trained_model()) == "A&B <c>\nFirst line here.\nSecond linked part."
    assert main_text(None, trained_model()) == main_text("", trained_model()) == ""


def test_blocks_of_broken_markup():
    texts = lambda h: [b.text for b in leaf_blocks(h)]
    assert texts("<p>a<p>b</div></p>c<ul><li>d<li>e<ul><li>f</ul>g</ul>") == ["a", "b", "c", "d", "e", "f", "g"]
    assert texts("a < b <!-- x > y --> c <script>if (a<b) '</p>'</script>d") == ["a < b c", "d"]
    assert texts('<a title="x>y">k</a> <img alt=">"> z <table><tr><td>1<td>2<tr><td>3</table>') == ["k z", "1", "2", "3"]
    assert texts("<p>open <b>never closed") == ["open never closed"]
    assert texts("<script>never closed <p>x") == []
    assert texts("<p>" + "x " * 200_000 + "</p>")[0].count("x") == 200_000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<a href=x>", "</a>", "<li>", "<ul>", "</ul>", "<article>", "</article>", "<", ">", "a b", "&amp;", "<br>", "<!--", "-->", '<x y="', "<script>", "</script>", "é"]), max_size=30))
def test_any_markup_is_read(parts):
    model = trained_model()
    blocks = leaf_blocks("".join(parts))
    assert all(b.text == " ".join(b.text.split()) and b.text for b in blocks)
    assert len(model.labels(blocks)) == len(blocks)


def test_viterbi_is_the_best_of_all_labelings():
    from itertools import product

    model: ChainModel = trained_model()
    for seed in range(8):
        blocks, _ = _PageMaker(500 + seed).labelled()
        blocks = blocks[:9]
        rows, kinds = features(blocks), links(blocks)

        def total(y, rows=rows, kinds=kinds):
            s = sum(model.weights.get(n, (0, 0))[v] for f, v in zip(rows, y, strict=True) for n in f)
            return s + sum(model.steps[kinds[i]][y[i - 1]][y[i]] for i in range(1, len(y)))

        assert abs(total(model.labels(blocks)) - max(map(total, product((0, 1), repeat=len(blocks))))) < 1e-9


def test_held_out_pages():
    model, maker, right, n = trained_model(), _PageMaker(4321), 0, 0
    for _ in range(120):
        blocks, y = maker.labelled()
        right, n = right + sum(a == b for a, b in zip(model.labels(blocks), y, strict=True)), n + len(y)
    assert right / n > 0.98


def test_table(spark):
    rows = [(1, "u", PAGE, "clash", 3), (1, "u", PAGE, "clash", 3), (None, None, None, None, None), (2, "v", "", "", 0)]
    got = sorted(map(tuple, extract_text(spark.createDataFrame(rows, PAGES)).collect()), key=str)
    text = "A&B <c>\nFirst line here.\nSecond linked part."
    assert got == sorted([(1, "u", text, len(text))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=str)
    assert extract_text(spark.createDataFrame([], PAGES)).count() == 0


def test_formulas_and_media_stay_in_their_block():
    texts = lambda h: [b.text for b in leaf_blocks(h)]
    assert texts("<p>The energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> as shown.</p>") == ["The energy is E=m as shown."]
    assert texts("<p>See <svg><title>no tip</title><text>axis</text></svg> and <object data=x>a plan</object> or <video src=y>film</video>.</p>") == ["See axis and a plan or film."]
    assert texts("<p>a</p><xmp>if (a < b) &amp; <b></xmp><p>c</p>") == ["a", "if (a < b) &amp; <b>", "c"]
    assert texts("<p>a</p><noframes>plain text</noframes>") == ["a", "plain text"]
    assert texts("<p>a <select><option>x</select><textarea>y</textarea> b</p>") == ["a", "b"]
    page = PAGE.replace("Second <a", "Second <math><mi>x</mi></math> <a")
    assert main_text(page, trained_model()) == "A&B <c>\nFirst line here.\nSecond x linked part."


#: Pages written by hand, in layouts that the page maker doesn't make: "+" stands before each block of the article.
WRITTEN = [
    """<html><body><div id=wrap><div id=masthead><a href=/>The Daily Reed</a> <a href=/subscribe>Subscribe</a></div>
    <table width=100%><tr><td valign=top><a href=/news>News</a><br><a href=/sport>Sport</a><br><a href=/arts>Arts</a></td>
    <td><h2>+River levels fall after a dry spring</h2><p>+The water authority said on Monday that the river had fallen to its lowest level in ten years, and that farms may be asked to use less.
    <p>+"We are not worried yet," said its head, who expects rain before the end of the month.</td></tr></table>
    <div id=footer>Copyright 2011 The Daily Reed. All rights reserved.</div></div></body></html>""",
    """<body class="single"><header role=banner><p class=logo>bread &amp; butter</p><nav><a href=a>Recipes</a><a href=b>About</a></nav></header>
    <main><div class="entry-content"><h1>+Rye bread without kneading</h1><p>+This loaf takes a day, nearly all of it waiting. You need no machine and hardly any skill.</p>
    <ul><li>+500 g rye flour</li><li>+400 g water</li><li>+10 g salt</li></ul><p>+Mix everything, cover the bowl and leave it overnight. Bake it the next day for fifty minutes.</p></div></main>
    <aside class="widget"><h3>Newsletter</h3><form><p>Get new recipes by mail.</p><input type=email><button>Join</button></form></aside>
    <section id=comments><h3>2 replies</h3><div class=comment><p>Worked very well for me, thank you!</p></div><div class=comment><p>Can I use wheat instead?</p></div></section></body>""",
    """<div class=cookie-banner><p>We use cookies to make this site work. <a href=#>Accept</a></p></div><article class=doc><h1>+Setting the clock</h1>
    <p>+Hold the left button for three seconds until the display blinks. Turn the wheel to the right hour and press the button again.</p><pre>+clock --set 12:00</pre>
    <p>+If nothing happens, take the battery out and wait a minute before you try again.</p></article><div class=related><h4>See also</h4><a href=1>Batteries</a> <a href=2>Alarms</a></div>
    <footer><small>Version 3.2 of the manual</small></footer>""",
    """<body><ul class=menu><li><a href=/>Start</a><li><a href=/forum>Forum</a></ul><div class="ads">Cheap flights to the sun!</div>
    <div class="article"><h1>+How owls hear</h1><p>+An owl's ears don't sit at the same height. A sound from below reaches the lower one first, and from that the owl can tell where the mouse is.</p>
    <blockquote>+It is the finest instrument in the wood.</blockquote><p>+The face works like a dish that gathers sound.</p></div>
    <div class="sidebar"><h3>Popular</h3><ul><li><a href=1>Ten birds</a><li><a href=2>Nest boxes</a></ul></div><div class=footer>Contact | Terms | Privacy</div></body>""",
]


def test_pages_written_by_hand():
    found = right = wanted = 0
    for page in WRITTEN:
        want = [b.text[1:] for b in leaf_blocks(page) if b.text.startswith("+")]
        got = main_text(page.replace(">+", ">"), trained_model()).split("\n")
        found, right, wanted = found + len(got), right + len(set(got) & set(want)), wanted + len(want)
    print("precision", right / found, "recall", right / wanted)
    assert right >= 0.9 * found and right >= 0.9 * wanted


def test_pages_without_an_element_for_the_article():
    model = trained_model()
    assert main_text("<body><p>Only one paragraph here, plain page.</p></body>", model) == "Only one paragraph here, plain page."
    assert main_text("Just plain text without any markup,\n in one line.", model) == "Just plain text without any markup, in one line."
    assert main_text("<html><body><h1>A title of a page</h1><p>First paragraph of the page, long enough.</p><p>Second paragraph, also with words.</p></body></html>", model).count("\n") == 2
    assert main_text("<article><p>In <button>press</button> text</p><p>More text stands here.</p></article>", model) == "In press text\nMore text stands here."
