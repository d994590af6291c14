import re
from html import unescape

from tessera.llm import html_extract as H

from ..conftest import MID

LONG = "The ferry crosses the strait four times a day, and on market days it carries more goats than passengers."


TREE = H.trained()


def text(html):
    return H.main_text(html, TREE)


def test_boilerplate_goes_and_the_article_stays():
    page = f"""<!doctype html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><article>";</script></head><body>
    <header><a href="/">Site</a></header><nav><ul><li><a href=/1>One</a><li><a href=/2>Two</a></ul></nav>
    <div class="cookie-notice"><p>{LONG}</p></div><!-- <p>no</p> -->
    <article><h1>Goats &amp; boats</h1><p>{LONG}<br>Second&nbsp;line   here.<p>Short.</p><p>With <a href=/x>a link</a> inside it.</p>
    <form><p>Sign up now</p><button>Go</button></form><div class="comments"><p>{LONG}</p></div></article>
    <aside><p>{LONG}</p></aside><div id="ad">{LONG}</div><footer><p>All rights</p></footer></body></html>"""
    assert text(page) == f"Goats & boats\n{LONG} Second line here.\nShort.\nWith a link inside it."


def test_last_block_and_pages_without_landmarks():
    assert text(f"<article><h1>Sea</h1><p>{LONG}</p><p>End.</p></article>") == f"Sea\n{LONG}\nEnd."
    assert text(f"<div><a href=/a>Menu</a> <a href=/b>More</a></div><div><p>{LONG} {LONG}</p><p>{LONG}</p></div>") == f"{LONG} {LONG}\n{LONG}"


def test_names_and_attributes_are_taken_whole():
    article = f"<h1>Sea</h1><p>{LONG}</p>"
    for page in (
        f"<html class='no-js nav'><body class='single-post has-sidebar comments-open'><article>{article}</article>",
        f"<article id='post-legal-notice'>{article}</article>",
        f"<article data-id='search'>{article}</article>",
        f"<article><div data-hidden='false'>{article}</div></article>",
        f"<article><div class='has-share-count notice-period'>{article}</div></article>",
        f"<article class='post entry'>{article}<article class='comment'><p>{LONG}</p></article><div class='commentList'>{LONG}</div></article>",
        f"<article>{article}<div class='related-posts share_buttons'>{LONG}</div><p hidden>{LONG}</p><p style='display: none'>{LONG}</p></article>",
    ):
        assert text(page) == f"Sea\n{LONG}", page
    assert text(f"<article><p>Say <label>when</label> and <svg><title>no</title><text>how</text></svg> <math><mi>x</mi></math> <button>Go</button>now.</p></article>") == "Say when and how x now."


def test_the_tree_asks_words_and_links_of_a_block_and_its_neighbours():
    names = H.asked(TREE)
    assert {"words", "link_density"} <= names and names & {"words_before", "words_after"} and names & {"links_before", "links_after"}
    blocks = [(b, row) for page in map(H.blocks_of, H.labelled_pages()) for b, row in zip(page, H.features_of(page), strict=True)]
    wrong = sum(H.kept(TREE, row) != b.keep for b, row in blocks[::50])
    assert wrong <= len(blocks[::50]) // 100


def test_pages_without_landmarks_are_told_by_text():
    page = f"""<div>Harbour Post</div><div>News since 1901</div><div><a href=/a>Home</a> <a href=/b>Sport</a></div>
    <h1>Goats at sea</h1><div>{LONG} {LONG}</div><div>Not all of them swim.</div><div>{LONG} <a href=/c>More</a>.</div><div>{LONG}</div>
    <div><a href=/n>Next story</a></div><div>All rights</div><div><a href=/i>Imprint</a></div>"""
    assert text(page) == f"Goats at sea\n{LONG} {LONG}\nNot all of them swim.\n{LONG} More.\n{LONG}"


def test_spans_set_aside_take_their_own_words_alone():
    for span in ("<span class='ad'>Buy</span>", "<span class=notice>note 3</span>", "<span hidden>x</span>", "<span class='related'>see <a href=/x>this</a> <span>too</span></span>"):
        assert text(f"<article><p>{LONG} {span} After text.</p><p>{LONG}</p></article>") == f"{LONG} After text.\n{LONG}", span
    assert text(f"<article><p>{LONG} <span>plain</span> <span class=big>words</span>.</p></article>") == f"{LONG} plain words."
    assert text(f"<article><p>{LONG} <span class=ad>never closed</p><p>{LONG}</p></article>") == f"{LONG}\n{LONG}"
    assert text(f"<article><div>{LONG} <span class=ad>never closed</div><p>{LONG}</p></article>") == f"{LONG}\n{LONG}"
    assert text(f"<article><p>{LONG}</p><span class=advert><div>{LONG}</div><p>{LONG}</p></span><p>{LONG}</p></article>") == f"{LONG}\n{LONG}"


def test_reader_comments_go_whatever_their_names_are_put_together_with():
    article = f"<h1>Sea</h1><p>{LONG} {LONG}</p><p>{LONG}</p>"
    for name in ("comment-body", "commentlist", "post-comments", "user-comments", "comment-thread", "CommentBox", "replies-area", "respond"):
        for attribute in ("class", "id"):
            comments = f"<div {attribute}='{name}'><h3>Three readers</h3><p>{LONG}</p><div><p>{LONG} {LONG}</p></div></div>"
            assert text(f"<article>{article}{comments}</article>") == f"Sea\n{LONG} {LONG}\n{LONG}", name
            assert text(f"<div>{article}</div>{comments}") == f"Sea\n{LONG} {LONG}\n{LONG}", name
    for name in ("comments-open", "has-comments", "commentary"):
        assert text(f"<article><div class='{name}'>{article}</div></article>") == f"Sea\n{LONG} {LONG}\n{LONG}", name


def test_the_tree_splits_as_an_exhaustive_search_does():
    import itertools

    import numpy as np

    r = np.random.default_rng(5)
    for _ in range(60):
        x, y = r.integers(0, 4, (r.integers(4, 25), 3)).astype(float), None
        y = (r.random(len(x)) < 0.5).astype(float)

        def impurity(part):
            return len(part) * part.mean() * (1 - part.mean()) if len(part) else 0.0

        gains = [(impurity(y) - impurity(y[x[:, f] <= t]) - impurity(y[x[:, f] > t]), f, t) for f, t in itertools.product(range(3), (0.5, 1.0, 1.5, 2.0, 2.5))]
        tree, most = H.grown(x, y, depth=1), max(g for g, *_ in gains)
        if len(tree) == 1:
            assert most <= 0.5 + 1e-9
        else:
            f, t = tree[:2]
            assert abs(impurity(y) - impurity(y[x[:, f] <= t]) - impurity(y[x[:, f] > t]) - most) < 1e-9
            assert tree[2] == (y[x[:, f] <= t].mean(),) and tree[3] == (y[x[:, f] > t].mean(),)


def test_given_pages_without_the_names(spark):
    tree = H.trained(without=("hint",))
    for r in spark.read.parquet(f"{MID}/pages.parquet").collect():
        assert H.main_text(r.html, tree) == H.main_text(r.html, TREE) != ""


def test_odd_markup():
    for page in (None, "", "<", "<p", "a < b", "<!-- open", "<script>never closed <p>x", "<article><p>" * 500, "</div></p>", "<p class='x>y", "&#0;&#xD800;&bad;"):
        assert isinstance(text(page), str)
    assert text("<article><p>1 &lt; 2 &amp;amp; 3 > 2</p></article>") == "1 < 2 &amp; 3 > 2"


def test_whole_table(spark):
    pages = spark.read.parquet(f"{MID}/pages.parquet")
    got = {r.page_id: r for r in H.extract(pages.selectExpr("*", "1 AS text", "2 AS n_chars")).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"</?b>|<br>", " " if "br" in x else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", re.sub("<br>", " ", body))]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", ""), (2, "u", f"<article><p>{'word ' * 50000}</p></article>")], "page_id long, url string, html string")
    assert sorted((str(r.page_id), r.n_chars) for r in H.extract(df).collect()) == [("1", 0), ("1", 0), ("2", 249999), ("None", 0)]
    assert H.extract(df.limit(0)).count() == 0
