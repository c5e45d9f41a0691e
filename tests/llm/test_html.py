import random

import pytest

from cladewise.llm import html
from cladewise.llm.html import blocks, classify, extract

PROSE = "The cat of the house was on the roof and it is not clear what he would do with all of the birds that are there. "


def page(inside, before="", after=""):
    return f'<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var t="</p>";</script></head><body>{before}<article>{inside}</article>{after}</body></html>'


@pytest.mark.parametrize(
    "inside, want",
    [
        ("<h1>A &amp; B</h1><p><b>First.<br><p>Ti.</p><p>XX!!</p>", "A & B\n\nFirst.\n\nTi.\n\nXX!!"),
        ("one<!-- no --><p>two\n  three &eacute;&#x41;&nbsp;x</p>four<div>five</div>", "one\n\ntwo three éA x\n\nfour\n\nfive"),
        ('<p>a</p><div class="ad">buy</div><aside>s</aside><form><p>mail</p><input></form><p>b</p><section id="comments"><p>me too</p></section>', "a\n\nb"),
        ("<header><h1>Head</h1></header><p>x</p><footer>f</footer>", "Head\n\nx"),
        ("<ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table>", "one\n\ntwo\n\nc1\n\nc2"),
        ("<p>a &lt;b&gt; 3 < 4 &am &amp x", "a <b> 3 < 4 &am & x"),
        ("<p>a<br><br>b<br>c</p>", "a\n\nb c"),
        ("", ""),
    ],
)
def test_articles(inside, want):
    nav = "<header>H</header><nav><ul><li><a href='/a'>The of and</a></li></ul></nav><!-- ad --><div class=\"ad\">" + PROSE + "</div>"
    assert extract(page(inside, nav, "<footer>&copy; x &middot; y</footer>")) == want


def test_unfinished_pages():
    assert extract(None) == extract("") == extract("<p") == extract("<script>x") == ""
    assert extract(page("<p>a")[: -len("</article></body></html>")]) == "a"
    assert extract("<article><p>a</p><p clas") == "a"
    assert extract('<article><p title="x>y">a</p></article>') == "a"


def test_without_a_marked_article():
    text = f"<body><div id=nav><a href=1>Home</a> <a href=2>News</a></div><div><h2>Short head</h2><p>{PROSE * 3}</p><p>Ok.</p><p>{PROSE * 3}</p></div><p>Share</p><div><a href=x>one</a> <a href=y>two</a></div></body>"
    assert extract(text) == "\n\n".join(["Short head", (PROSE * 3).strip(), "Ok.", (PROSE * 3).strip()])
    labels = {b.text: b.label for b in classify(blocks(text))}
    assert labels["Home News"] == "bad"
    assert labels["Share"] == "bad"
    assert extract("<p>Tiny</p>") == "Tiny"


def test_pages_of_short_blocks_keep_them():
    assert extract("<div id=content><h1>Title</h1><p>Short one.</p><p>Short two.</p></div>") == "Title\n\nShort one.\n\nShort two."
    menu = "<nav><a href=1>Home</a> <a href=2>News</a></nav>"
    assert extract(f"<body>{menu}<div><h1>Title</h1><p>Short one.</p></div><footer>x</footer></body>") == "Title\n\nShort one."
    assert extract(f"<body>{menu}<p>今日は天気がとても良いので、公園まで散歩に行きました。楽しかったです。</p></body>").startswith("今日")


def test_links_and_notices_within_an_article():
    for bad in ("<ul><li><a href=1>Home page here</a></li><li><a href=2>About us all</a></li></ul>", "<div><a href=1>Home page here</a> <a href=2>About us all</a></div>", "<p>Share this</p>", "<p>&copy; 2020 All rights reserved.</p>", "<p>Related <a href=1>sun</a> <a href=2>moon</a> <a href=3>star</a> <a href=4>sea</a></p>"):
        assert extract(page(f"<h1>Title</h1><p>{PROSE}</p>{bad}<p>End.</p>")) == f"Title\n\n{PROSE.strip()}\n\nEnd."
    kept = '<h1><a href="/self">Title of it</a></h1><p>See <a href=1>this page</a> for what is in it.</p>'
    assert extract(page(kept)) == "Title of it\n\nSee this page for what is in it."


def plain(own):
    """Both passes over (length, linked, links, heading, furniture, article, stops, notice) by plain loops, outwards from each open block."""
    marked = any(b.article and not b.furniture for b in own)
    stops = [sum(w in html._STOP for w in html._WORD.findall(b.text.lower())) / max(1, len(html._WORD.findall(b.text.lower()))) for b in own]
    known = marked or any(not b.furniture and len(b.text) >= 70 and b.linked <= 0.33 * len(b.text) and s >= 0.2 for b, s in zip(own, stops))
    first = []
    for b, s in zip(own, stops):
        n, share = len(b.text), b.linked / len(b.text)
        if b.furniture or marked and not b.article:
            x = None
        elif html._is_notice(b, html._WORD.findall(b.text.lower())):
            x = "bad"
        elif marked:
            x = "bad" if share > 0.8 and not b.heading or share > 0.33 and b.links > 2 and s < 0.2 else "good" if n >= 70 or s >= 0.2 or b.heading else "open"
        elif share > 0.33 or n < 70 and b.linked:
            x = "bad"
        elif n < 70:
            x = "open"
        elif not known:
            x = "good" if n > 200 else "bad" if b.linked else "open"
        elif s >= 0.32:
            x = "good" if n > 200 or not b.linked else "open"
        else:
            x = "open" if s >= 0.2 or n > 200 and not b.linked else "bad"
        first.append(x)

    def look(i, step):
        far, j = 0, i + step
        while 0 <= j < len(own):
            if first[j] in ("good", "bad"):
                return first[j], far
            far += len(own[j].text) if first[j] == "open" else 0
            j += step
        return None

    out = []
    for i, x in enumerate(first):
        if x == "open":
            a, z = look(i, -1), look(i, 1)
            both = [y for y in (a, z) if y]
            if marked:
                x = "bad" if a and z and a[0] == z[0] == "bad" else "good"
            elif len({y[0] for y in both}) < 2:
                x = both[0][0] if both else "good"
            elif own[i].heading:
                x = "good" if z[0] == "good" and z[1] <= 200 else "bad"
            elif a[1] != z[1]:
                x = min(a, z, key=lambda y: y[1])[0]
            else:
                x = "good" if stops[i] >= 0.2 else "bad"
        out.append(x or "bad")
    return out


def test_both_passes_against_plain_loops():
    rng = random.Random(4)
    words = ["the", "of", "and", "house", "river", "blue", "share", "Vanhan", "kaupungin", "!!", "42", "©"]
    seen = set()
    for n in range(1500):
        own, marked = [], n % 3 == 0
        for _ in range(rng.randrange(1, 12)):
            text = " ".join(rng.choice(words[: rng.choice([4, 6, 12])]) for _ in range(rng.choice([1, 2, 4, 12, 30, 60])))
            linked = rng.choice([0, 0, 0, len(text) // 5, len(text) // 2, len(text)])
            own.append(html.Block(text, linked, rng.randrange(1, 5) if linked else 0, rng.random() < 0.15, rng.random() < 0.15, marked and rng.random() < 0.7))
        want = plain(own)
        assert [b.label for b in classify(own)] == want
        seen.update(zip(want, [marked] * len(want)))
    assert len(seen) == 4


def test_a_language_without_stop_words_here():
    prose = "Vanhan kaupungin kadut olivat hiljaisia, ja satamassa kalastajat korjasivat verkkojaan aamuauringossa. " * 4
    text = f"<body><div id=nav><a href=1>Etusivu</a> <a href=2>Uutiset</a></div><h2>Satama</h2><p>{prose}</p><p>Lyhyt.</p><p>{prose}</p><div><a href=x>yksi pitkä linkki toiselle sivulle</a> <a href=y>toinen pitkä linkki jonnekin muualle</a></div></body>"
    assert extract(text) == "\n\n".join(["Satama", prose.strip(), "Lyhyt.", prose.strip()])


def test_hostile_pages_take_linear_time():
    for bad in ("<a '" * 20_000, "<" * 50_000, '<p class="' * 20_000, "<!--" * 20_000, "<script>" * 5_000, "<div>" * 30_000):
        extract(bad)


def test_frames(spark):
    from cladewise.llm.html import main_text

    df = spark.createDataFrame([(1, "u", page("<p>x é</p>"), "z"), (None, None, None, None), (2, "u", "", "t"), (2, "u", "", "t")], "page_id long, url string, html string, text string")
    out = sorted((tuple(r) for r in main_text(df).collect()), key=str)
    assert out == sorted([(1, "u", "x é", 3), (None, None, "", 0), (2, "u", "", 0), (2, "u", "", 0)], key=str)
    assert main_text(df.limit(0)).count() == 0
