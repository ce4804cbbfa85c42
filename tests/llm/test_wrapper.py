import html
import itertools
import random

import pytest

from lakemoor.llm import dom, wrapper

WORDS = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor übermut façade".split()


def sentence(rnd, n=None):
    return " ".join(rnd.choices(WORDS, k=n or rnd.randrange(6, 25))).capitalize() + rnd.choice([".", " & more.", "?", " <ok>!"])


def links(rnd, n):
    return "".join(f'<li><a href="/{rnd.random()}">{html.escape(sentence(rnd, 2))}</a></li>' for _ in range(n))


def article(rnd):
    blocks = [sentence(rnd, 5)] + [" ".join(sentence(rnd) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(2, 8))]
    body = f"<h1>{html.escape(blocks[0])}</h1>"
    for at, block in enumerate(blocks[1:]):
        cut = html.escape(block).replace(" dolor ", rnd.choice([" <b>dolor</b> ", "\n<a href=x>dolor</a>\t", " dolor<!-- x -->  "]))
        body += rnd.choice([f"<p>{cut}</p>", f"<p>{cut}", f"<p class=intro id=p{at}>{cut}</p>\n", f"<blockquote>{cut}</blockquote>"])
    return blocks, body


def semantic(rnd, body):
    return (
        f"<!DOCTYPE html><html><head><title>t</title><script>var x='</p><p>no';</script><style>p{{}}</style></head><body>"
        f"<header><h2>{sentence(rnd, 3)}</h2></header><nav><ul>{links(rnd, 6)}</ul></nav><main><article>{body}"
        f"<aside>{sentence(rnd)}</aside><footer>Filed under {sentence(rnd, 2)}</footer></article>"
        f"<section id='comments'><article class='comment'><p>{sentence(rnd)}</p></article></section></main>"
        f"<form><label>Mail</label><input><button>Go</button></form><footer>&copy; us</footer></body></html>"
    )


def by_class(rnd, body):
    return (
        f"<html><body class=home><div class='site-header'>My site</div><div id=mainNav><ul>{links(rnd, 5)}</ul></div>"
        f"<div class='page with-sidebar'><div class='post-content'><div class='entry-header'></div>{body}<div class='cookie-notice'>We use cookies</div></div>"
        f"<div class='sidebar'><p>{sentence(rnd)}</p></div><div class='adBox'>{sentence(rnd)}</div>"
        f"<div class='userComments'><p>{sentence(rnd)}<p>{sentence(rnd)}</div></div><div class=footer>Imprint</div></body>"
    )


def opaque(rnd, body):
    """Nothing has a telling name: what pages have in common is template."""
    return (
        f"<html><body><div class=x1><div>The Daily Example</div><div>All the news</div></div><div class=x2><ul>{links(rnd, 7)}</ul></div>"
        f"<div class=x3><p>Please accept our terms of use before reading on, dear reader.</p><div class=x4>{body}"
        f"<p>This story was first published by the Daily Example.</p></div><div class=x5><p>{sentence(rnd, 4)}</p></div></div>"
        f"<div class=x6><p>Write to us at any time.</p><p>All rights reserved.</p></div></body></html>"
    )


def whole_form(rnd, body):
    """A form holds the whole page, as some servers write it."""
    return (
        f"<html><body><form id=aspnet action=/><div class=menu><ul>{links(rnd, 4)}</ul></div><div class=c>{body}</div>"
        f"<div class=x><ul>{links(rnd, 5)}</ul></div><div class='newsletter'>Sign up</div></form></body></html>"
    )


TEMPLATES = {"semantic": semantic, "class": by_class, "opaque": opaque, "form": whole_form}


@pytest.fixture(scope="module")
def made():
    rnd, out = random.Random(13), []
    for host, template in TEMPLATES.items():
        for at in range(25):
            blocks, body = article(rnd)
            out.append((len(out), f"https://{host}.example.com:80/{at}?q=//x", template(rnd, body), "\n".join(blocks)))
    return out


def pages_frame(spark, rows):
    return spark.createDataFrame([(*row[:3], "clash", "clash") for row in rows], "page_id long, url string, html string, text string, host string")


def test_templates(spark, made, monkeypatch):
    monkeypatch.setattr(wrapper, "FAN", 3)
    rows = wrapper.main_texts(pages_frame(spark, made).repartition(11)).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == len(made)
    for page_id, url, _, want in made:
        assert got[page_id].text == want, url
        assert got[page_id].n_chars == len(want) and got[page_id].url == url


def test_single_pages(spark, made):
    """Without other pages of the host, names alone decide."""
    alone = [row for row in made if "semantic" in row[1] or "class" in row[1]][::7]
    for row in alone:
        got = wrapper.main_texts(pages_frame(spark, [row])).first()
        assert got.text == row[3]


def test_names_that_mislead(spark):
    rows = [
        (1, "http://one.example.com/", "<div class='has-sidebar'><article class='long-form popular'><p>The article.</p></article></div>", "The article."),
        (2, "http://two.example.com/", "<article class=story><header><h1>Title</h1></header><p>Text.</p><div class='story-comments'>no</div></article>", "Title\nText."),
        (3, "http://three.example.com/", "<main class='main-content notices'><h1>T</h1><p>x</p></main><div id=cookieBanner>no</div>", "T\nx"),
        (4, "http://four.example.com/", "<div class=page><header>Site</header><div id=content><h1>T</h1><p>one<p>two</div><div class=rightSidebar><p>no no no</div></div>", "T\none\ntwo"),
    ]
    got = {r.page_id: r.text for r in wrapper.main_texts(pages_frame(spark, rows)).collect()}
    assert got == {row[0]: row[3] for row in rows}


def test_copies_and_shared_passages(spark):
    rnd, rows = random.Random(4), []
    blocks, body = article(rnd)
    for at in range(30):  # copies of one article make most of a host
        rows.append((at, "http://copies.example.com/", semantic(rnd, body), "\n".join(blocks)))
    for at in range(30, 42):
        own, body = article(rnd)
        own.append("The passage that half of the articles quote stands here.")
        quoted = body + f"<p>{own[-1]}" if at % 2 else body
        rows.append((at, "http://quotes.example.com/", semantic(rnd, quoted), "\n".join(own if at % 2 else own[:-1])))
    got = {r.page_id: r.text for r in wrapper.main_texts(pages_frame(spark, rows)).collect()}
    assert got == {row[0]: row[3] for row in rows}


def test_odd_rows(spark):
    rows = [
        (1, None, None), (2, "http://a.b/", ""), (None, "nothing", "<p>a&amp;b &lt;i&gt; &#233;&nbsp;c</p><p>d"),
        (3, "HTTP://User@A.B:8/x", "plain <b>text</b> a < b"), (3, "HTTP://User@A.B:8/x", "plain <b>text</b> a < b"),
        (4, "http://a.b/", "<nav>only a menu</nav>"), (5, "http://a.b/", "<p>" + "long " * 200_000 + "</p>"),
        (6, "http://a.b/", "<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after"), (7, "http://a.b/", "<script>never closed <p>x"),
        (8, "http://a.b/", "<p>one<br>two\n three</p><!-- <p>no</p> --><p hidden>no</p><div style='display: none'>no</div>"),
    ]
    got = wrapper.main_texts(pages_frame(spark, rows)).collect()
    texts = sorted(((r.page_id or 0, r.text) for r in got), key=repr)
    assert texts == sorted(
        [
            (1, ""), (2, ""), (0, "a&b <i> é c\nd"), (3, "plain text a < b"), (3, "plain text a < b"), (4, ""),
            (5, ("long " * 200_000).strip()), (6, "deep\nafter"), (7, ""), (8, "one two three"),
        ], key=repr,
    )
    assert wrapper.main_texts(pages_frame(spark, rows).limit(0)).collect() == []
    assert {r.n_chars == len(r.text) for r in got} == {True}


def random_tree(rnd, depth=3):
    node = dom.Node(rnd.choice(["div", "ul", "p"]), frozenset(rnd.choice([(), ("a",)])))
    if depth and node.tag != "p":
        node.kids = [random_tree(rnd, depth - 1) for _ in range(rnd.randrange(4))]
    node.size = 1 + sum(kid.size for kid in node.kids)
    return node


def brute_match(a, b):
    """The largest common tree in order, over all ways to pair the children."""
    best = 0
    for k in range(1, min(len(a.kids), len(b.kids)) + 1):
        for left in itertools.combinations(a.kids, k):
            for right in itertools.combinations(b.kids, k):
                if all(wrapper._comparable(x, y) for x, y in zip(left, right)):
                    best = max(best, sum(brute_match(x, y) for x, y in zip(left, right)))
    return 1 + best


def test_simple_tree_matching():
    rnd = random.Random(6)
    for _ in range(300):
        a, b = random_tree(rnd), random_tree(rnd)
        score, pairs = wrapper.Matching().of(a, b)
        assert score == brute_match(a, b)
        assert score == 1 + sum(wrapper.Matching().of(a.kids[i], b.kids[j])[0] for i, j in pairs)
        assert pairs == sorted(pairs) and len({j for _, j in pairs}) == len(pairs)


def test_merged_tree_holds_both():
    rnd = random.Random(7)
    for _ in range(200):
        a, b = random_tree(rnd), random_tree(rnd)
        a.tag = b.tag = "div"
        shared = wrapper.Matching().of(a, b)[0] if wrapper._comparable(a, b) else None
        if shared is not None:
            sizes = a.size, b.size
            wrapper.merge(a, b, wrapper.Matching())
            assert a.size == sum(sizes) - shared == sum(1 for _ in wrapper._walk(a))


def test_frequent_texts_survive():
    rnd, own = random.Random(9), {}
    for at in range(1000):
        wrapper._add_texts(own, {("often", 5): 1, **{(rnd.random(), 1): 1 for _ in range(20)}}, False)
        assert len(own) <= wrapper.MOST_TEXTS
    assert own[("often", 5)] >= 1000 - 1000 * 21 / wrapper.MOST_TEXTS


def test_registered(spark, sf_dir):
    """The test pages hold one article element each, of headings and paragraphs."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = wrapper.op13_induced_wrappers(spark, sf_dir).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        source = pages[r.page_id]
        inside = source[source.index("<article>") : source.index("</article>")]
        for tag in ("article", "h1", "p"):
            inside = inside.replace(f"<{tag}>", "\0").replace(f"</{tag}>", "\0")
        plain = [html.unescape(one.replace("<b>", "").replace("</b>", "").replace("<br>", " ")) for one in inside.split("\0")]
        assert r.text == "\n".join(filter(None, (" ".join(one.split()) for one in plain)))
