import random
import time

from chronoloom.llm import webpages as P

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li>Home<li>About</ul></nav><div class="cookie-notice">We use cookies</div>
<article id=post><h1>A  title&nbsp;here</h1><p>One <b>bold</b>ly &lt;x&gt;<br>two<p>Three<p>four &copy; &#233;
<div class="ad">buy</div><div class="box">Follow us</div><form><input>mail</form><ul><li>a<li>b</ul><!-- no > --><script>x</script>
<section class="comments"><article class="comment">nice post</article></section><aside>side</aside></article><footer>&copy; f</footer></body></html>"""


def test_main_text_of_a_page():
    assert P.main_text(PAGE) == "A title here One boldly <x> two Three four © é Follow us a b"
    assert P.main_text("") == "" == P.main_text("<p") == P.main_text("<script>x")
    assert P.main_text("<body><div>x</div>y") == "x y"
    assert P.main_text("<article><p>cut &am") == "cut &am"
    assert P.main_text("<div>" * 30000 + "deep").endswith("deep")


def test_template_is_counted_by_host(spark, monkeypatch):
    box = '<div class="box">Follow us</div>'
    menu = "<div>Home | About</div>"
    rows = [(i, f"http://a.com/{i}", f"{menu}<article><h1>t{i}</h1><p>{'same words' if i < 5 else f'other {i}'}</p>{box}</article>", "x", "y") for i in range(30)]
    rows += [(120 + i, f"http://b.com/{i}", f"{menu}<div>own {i}</div>", "x", "y") for i in range(6)]
    rows += [(40 + i, "http://c.com/", "<div>copied <div>page</div></div>", "x", "y") for i in range(9)]  # copies of one page
    rows += [(60, None, None, "x", "y"), (61, "http://a.com/z", "", "x", "y"), (60, None, None, "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host string")
    for limit in (2_000_000, 0):
        monkeypatch.setattr(P, "BROADCAST_HASHES", limit)
        got = {r.page_id: (r.text, r.n_chars) for r in P.extract(pages).collect()}
        assert got[3] == ("t3 same words", 13)
        assert got[122] == ("own 2", 5)
        assert got[44] == ("copied page", 11)
        assert got[60] == got[61] == ("", 0)
    assert P.extract(pages).count() == len(rows)
    assert P.extract(pages.limit(0)).count() == 0


def test_nesting_of_any_depth():
    began = time.time()
    for tag in ("div", "b", "article", "li"):
        assert P.main_text(f"<{tag}>" * 300_000 + "deep") == "deep"
        assert P.main_text(f"<{tag}>" * 100_000 + "deep" + f"</{tag}>" * 100_000 + "<p>end") in ("deep", "deep end")
    P.main_text("<b>" * 20_000 + "<p>x" * 20_000 + "</i>" * 20_000)
    assert time.time() - began < 60


def test_articles_outside_what_is_dropped():
    assert P.main_text("<div class=related><article>teaser</article></div><article>one</article><div>x</div><article>two</article>") == "one two"
    assert P.main_text("<div class=comments><article>nice</article></div><div>the text</div>") == "the text"
    assert P.main_text("<body class='nav-open'><header>site</header><p>own") == "own"


def pages_without_names(rng):
    """Pages of plain divs with meaningless classes, and what of each is its own text."""
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    text = lambda n: " ".join(word() for _ in range(n))
    out = []
    for host in range(4):
        menu, legal, advert = ([text(4) for _ in range(5)], text(20), [text(12) for _ in range(3)])
        for i in range(40):
            own = [text(rng.randrange(5, 40)) for _ in range(rng.randrange(1, 6))]
            blocks = [f"<p>{x}</p>" for x in own]
            blocks.insert(rng.randrange(len(blocks) + 1), f"<div class=z9><div>{advert[i % 3]}</div></div>")
            page = "<div class=q1>" + "".join(f"<div>{x}</div>" for x in menu) + f"</div><div class=q2><div class=q7>{''.join(blocks)}</div></div><div class=q3>{legal}</div>"
            out.append((host * 100 + i, f"http://h{host}.org/{i}", page, menu + [legal, *advert], " ".join(own)))
    return out


def brute_text(page, template):
    """Text of flat pages of div and p, block by block, without the blocks that are template."""
    import re

    return " ".join(x for x in re.split(r"<[^>]*>", page) if x.strip() and x not in template)


def test_pages_without_article_or_telling_names(spark):
    made = pages_without_names(random.Random(3))
    pages = spark.createDataFrame([r[:3] for r in made], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in P.extract(pages).collect()}
    for page_id, _, page, often, own in made:
        assert got[page_id] == own == brute_text(page, often)
    changed = sum(P.main_text(r[2]) != r[4] for r in made)
    assert changed == len(made)  # the template alone makes the difference
    hashes = P.template(pages).groupBy("host").count().collect()
    assert len(hashes) == 4 and all(r["count"] >= 5 for r in hashes)


def test_hosts_of_many_hashes_are_matched_by_page(spark, monkeypatch):
    made = pages_without_names(random.Random(5))
    rows = [r[:3] for r in made] + [(9000 + i, f"http://tiny.org/{i}", f"<div>{'same menu' if i else 'x'}</div><p>own {i}") for i in range(9)] + [(None, "http://h0.org/null", None), (7, *made[7][1:3])]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, hashes int")
    want = sorted(map(tuple, P.extract(pages).collect()), key=str)
    monkeypatch.setattr(P, "HOST_HASHES", 3)  # all but the tiny host
    assert sorted(map(tuple, P.extract(pages).collect()), key=str) == want and len(want) == len(rows)


def test_what_recurs_on_a_small_share_of_a_large_host_stays(spark):
    rows = [(i, f"http://big.org/{i}", f"<div>menu of all</div><div>{'quoted by some' if i < 60 else f'own {i}'}</div><p>text {i}") for i in range(1500)]
    got = {r.page_id: r.text for r in P.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "quoted by some text 3" and got[100] == "own 100 text 100"
