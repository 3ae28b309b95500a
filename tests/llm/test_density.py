import html
import math
import random
import re
import time

from filescope.llm import density

P = "This is a paragraph of the article, with enough words to be dense and <a href='/x'>one link</a> in it. "


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


CHROME = (
    "<header><h1>Site</h1><p>Slogan of the site</p></header><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>"
    "<div class='cookie-notice'>We use cookies.</div><div id=sidebar><p>Side words that go on for a while.</p></div>"
)
TAIL = "<form><p>Write</p><input></form><section class='comments'><p>I disagree with the whole of this, said the reader at length.</p></section><div class='ad-slot'>Buy</div><footer>&copy; us</footer>"


def test_article_without_its_surroundings():
    text = density.main_text(page(f"{CHROME}<article><header><h1>Head</h1><span>share</span></header><p>{P}</p><p>Short.</p><aside>x</aside><ul><li>one<li>two</ul><p>Caf&eacute; &amp; &#x41;&nbsp;b</p></article>{TAIL}"))
    assert text == "Head\n" + re.sub("<[^>]*>", "", P).strip() + "\nShort.\none\ntwo\nCafé & A b"


def test_no_article_element():
    want = re.sub("<[^>]*>", "", P).strip()
    text = density.main_text(page(f"{CHROME}<div class='wrap with-sidebar'><div class=content>" + f"<p>{P}</p>" * 6 + f"</div></div>{TAIL}"))
    assert text == "\n".join([want] * 6)
    two = density.main_text(page(f"{CHROME}<div><section>" + f"<p>{P}</p>" * 4 + "</section><section>" + f"<p>{P}</p>" * 5 + f"</section></div>{TAIL}"))
    assert two == "\n".join([want] * 9)


def test_broken_markup():
    assert density.main_text(page(f"<article><h1>H</h1><p><b>One<br><p>Two</b></p><p>Three &amp four &am</article><footer>f")) == "H\nOne\nTwo\nThree & four &am"
    assert density.main_text("<article><p>no end, unclosed <a href='x") == "no end, unclosed"
    assert density.main_text("plain  text\n only") == "plain text only"
    assert density.main_text("<p>a < b and c > d</p>") == "a < b and c > d"
    for bad in ("<", "<!--", "<a", "</", "</p>", "<>", "<p", "<script>", "<![CDATA[", "\0", "<div " * 50, "<b>" * 5000 + "x"):
        density.main_text(bad)
    assert density.main_text(None) == density.main_text("") == density.main_text("<nav>only</nav>") == ""


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = {r["page_id"]: r for r in pages.collect()}
    extra = spark.createDataFrame([(9000, None, None), (9001, "u", ""), (9001, "u", ""), (None, "v", "<p>" + "long " * 200_000)], "page_id long, url string, html string")
    out = density.extract(pages.unionByName(extra).withColumnRenamed("nothing", "text")).collect()
    assert len(out) == len(rows) + 4
    for r in out:
        assert r["n_chars"] == len(r["text"])
        if r["page_id"] in rows:
            inner = re.search("<article>(.*)</article>", rows[r["page_id"]]["html"], re.S)[1]
            parts = (" ".join(html.unescape(re.sub("<b>|<br>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inner))
            assert r["text"] == "\n".join(x for x in parts if x)
    assert density.extract(pages.limit(0)).count() == 0


def test_titles_with_names_of_noise_and_forms_around_the_page():
    dense = "with enough words to be dense"
    body = f"<p>{P}</p><p>Short.</p>"
    for head in ('<header class="entry-header"><h1>Title</h1><p>by me</p></header>', '<h1 class="post-header">Title</h1>'):
        text = density.main_text(page(f"<nav>Home</nav><article>{head}{body}</article>"))
        assert text.split("\n")[0] == "Title" and "by me" not in text and dense in text
    for inner in (f"<article>{body}</article>", f"<div>{body}</div>"):
        assert dense in density.main_text(page(f"<form action='/x'><input>{inner}</form>"))
    assert density.main_text(page(f"<form hidden><article>{body}</article></form>")) == ""
    assert "Write" not in density.main_text(page(f"<article>{body}</article><form><p>Write</p></form>"))


def test_quotes_and_tags_in_scripts():
    text = density.main_text(f"<body><nav><a href='x'>Menu one</a></nav><script>if (a<b) {{ // don't</script><article><p>It's {P}</p><p title='a > b' class = \"c>d\">{P}</p></article></body>")
    assert text.startswith("It's This is") and "Menu" not in text and "<" not in text and "c>d" not in text
    assert density.main_text(f"<body><p don't><b>{P}</b></p><p>can't</p></body>").endswith("can't")


def test_the_tag_article_is_not_what_finds_the_text(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in rows:
        assert density.main_text(re.sub("(</?)article>", r"\1div>", r["html"])) == density.main_text(r["html"])
    flow = f"<h1>Title of it</h1><p>Short lead.</p><div class=text><p>{P}</p><p>{P}</p><p>{P}</p></div><p>By me.</p><div><a href=/x>More on this</a> <a href=/y>And on that</a></div>"
    want = ["Title of it", "Short lead.", *[re.sub("<[^>]*>", "", P).strip()] * 3, "By me."]
    assert density.main_text(page(f"{CHROME}<div class=post>{flow}</div><div>A word.</div>{TAIL}")).split("\n") == want


def nested(x):
    """(characters, tags, characters in links, tags of links) under a tree (name, kids)."""
    c = t = lc = lt = 0
    for k in x[1]:
        if isinstance(k, str):
            c += len(k)
            continue
        own = nested(k)
        c, t = c + own[0], t + own[1] + 1
        lc, lt = lc + (own[0] if k[0] == "a" else own[2]), lt + (own[1] + 1 if k[0] == "a" else own[3])
    return c, t, lc, lt


def slow_density(x, body):
    c, t, lc, lt = nested(x)
    if not c:
        return 0.0
    b = nested(body)
    t, lc, lt = max(t, 1), max(lc, 1), max(lt, 1)
    base = math.log(c * lc / max(c - lc, 1) + b[2] * c / max(b[0], 1) + math.e)
    return c / t * max(0.0, math.log(c * t / (lc * lt))) / math.log(max(base, 1.01))


def slow_sum(x, body):
    def under(y):
        return sum(slow_density(k, body) if k[0] in density._BLOCK else under(k) for k in y[1] if not isinstance(k, str))

    return under(x) or slow_density(x, body)


def random_tree(rng, depth):
    kids = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["text", "b", "a", "div", "div", "section"] if depth else ["text"])
        kids.append("w" * rng.randint(1, 60) if kind == "text" else (kind, random_tree(rng, depth - 1)))
    return kids


def markup(x):
    return x if isinstance(x, str) else f"<{x[0]}>{''.join(map(markup, x[1]))}</{x[0]}>"


def blocks(x):
    return [x] * (x[0] in density._BLOCK) + [y for k in x[1] if not isinstance(k, str) for y in blocks(k)]


def test_densities_by_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        body = ("body", random_tree(rng, 3))
        root = density.parse(markup(body))
        ours = [x for x in density._measure(root) if x.block]
        theirs = blocks(body)
        assert [x.name for x in ours] == [x[0] for x in theirs]
        for x, y in zip(ours, theirs, strict=True):
            assert math.isclose(x.density, slow_density(y, body), abs_tol=1e-9) and math.isclose(x.sum, slow_sum(y, body), abs_tol=1e-9)
        sums = [slow_sum(y, body) for y in theirs]
        best = theirs[sums.index(max(sums))]
        text = density.main_text(markup(body))
        assert all(part in text for part in re.split("<[^>]*>", markup(best)) if part)


def test_hostile_pages_take_linear_time():
    for bad in ("<p>" + "<b>" * 8000 + "</i>" * 8000, "<b><div>" + "<i>" * 8000 + "</b>" * 8000, "<i>" * 8000 + "<p></p>" * 8000, "<ul>" + "<div>" * 8000 + "<li></li>" * 8000, '<a b="' * 20_000, "<form>" * 9000, "<div class=ad>" * 9000, "<article><header><div>" * 3000):
        began = time.perf_counter()
        assert density.main_text(bad + "x") in ("x", "")
        assert time.perf_counter() - began < 5
