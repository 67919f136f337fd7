"""Main text of pages that nest deeply, have no article element, or carry names that mean something else."""

import functools
import itertools

import numpy as np
import pytest

from netloom.llm import html


def text(page, template=()):
    root = html.parse(page)
    html.fold(root)
    names = [x.split()[0] for x in html.PARSED.split("array<struct<")[-1].rstrip(">").replace(":", " ").split(",")]
    return html.content([dict(zip(names, b)) for b in html.blocks(root)], set(template))


@pytest.mark.parametrize("tag", ["div", "font", "b", "a name=x"])
def test_text_below_many_unclosed_elements_stays(tag):
    words = [f"word{k}" for k in range(5000)]
    got = " ".join(text("<article>" + "".join(f"<{tag}>{w} " for w in words)))
    assert got.split() == words


def test_an_article_deep_below_a_named_wrapper_stays():
    assert text("<div class=sidebar>" + "<div>" * 3000 + "<article><p>here") == ["here"]


def test_a_long_article_without_an_article_element_stays_whole():
    body = "".join(f"<h2>Section {k}</h2><p>{'Long words of it. ' * 300}</p>" for k in range(3))
    page = f"<body><div class=page><div class=top><a href=1>Home</a> <a href=2>News</a></div><div class=lead><h1>Head</h1><p>A lead.</p></div><div class=text>{body}</div><div class=closing>The end.</div><div class=sources><ul><li><a href=3>First source of it</a><li>Second, <a href=4>on a web page of theirs</a></ul></div></div></body>"
    got = text(page)
    assert got[:3] == ["Head", "A lead.", "Section 0"] and got[-3:] == ["The end.", "First source of it", "Second, on a web page of theirs"]
    assert len(got) == 11 and not any("Home" in t for t in got)


def test_short_sections_and_their_links_stay():
    body = "".join(f"<section><h2>S{k}</h2><p>{'Some words. ' * (1 + 40 * (k == 2))}</p><p><a href=x>See there {k}</a></section>" for k in range(5))
    got = text(f"<body><div><a href=1>Home</a></div><div>{body}</div></body>")
    assert [t for t in got if t.startswith("S") and not t.startswith("Some")] == [x for k in range(5) for x in (f"S{k}", f"See there {k}")]
    assert got[0] == "S0" and len(got) == 15


@pytest.mark.parametrize("part", ["<h2 id='related-work'>kept</h2>", "<section id='search-methods'><p>kept</section>", "<p id=notice-1>kept</p>", "<p class='notice'>kept</p>", "<section class=related><p>kept</section>", "<h2 class=search>kept</h2>", "<pre><span class='token comment'>kept</span></pre>"])
def test_names_in_an_article_do_not_drop_its_own_parts(part):
    assert text(f"<article><p>first</p>{part}<p>last</article>") == ["first", "kept", "last"]


@pytest.mark.parametrize("open", ["<body class=no-sidebar><div>", "<body class=search><div>", "<body><div class='content has-sidebar'>", "<body><div data-role=search>"])
def test_names_of_wrappers_do_not_empty_the_page(open):
    assert text(f"<html>{open}<p>one</p><p>two</p></div></body>") == ["one", "two"]


@pytest.mark.parametrize("part", ["<div class='related'><a href=1>Another thing</a> by us</div>", "<section class=comments><p>reader</section>", "<div class='site-footer'>foot</div>", "<div class='cookie-notice x'>cookies</div>", "<div class=siteFooter>foot</div>", "<div id=comments>reader</div>", "<div class=ad-1>buy</div>"])
def test_named_parts_that_are_no_content_go(part):
    assert text(f"<article><p>first</p>{part}<p>last</article>") == ["first", "last"]


def brute_size(one, other):
    """The most pairs of an alignment that keeps parents and the order of siblings, tried in all ways."""
    a, b = html.tree(one), html.tree(other)

    @functools.cache
    def best(i, j):
        if a[i][0] != b[j][0]:
            return 0
        x, y = a[i][1], b[j][1]
        most = 0
        for k in range(min(len(x), len(y)) + 1):
            for p in itertools.combinations(x, k):
                for q in itertools.combinations(y, k):
                    got = [best(c, d) for c, d in zip(p, q)]
                    most = max(most, sum(got)) if all(got) else most
        return 1 + most

    return best(len(a) - 1, len(b) - 1) - 1


def random_tree(rng, n):
    depth, lines = 0, []
    for _ in range(n):
        depth = int(rng.integers(0, min(depth + 1, 3) + 1)) if lines else 0
        lines.append(f"{depth}:{rng.choice(list('ab'))}")
    return "\n".join(lines)


def test_matching_is_the_best_alignment():
    rng = np.random.default_rng(11)
    for _ in range(120):
        one, other = (random_tree(rng, int(rng.integers(1, 9))) for _ in range(2))
        got = html.match(one, other)
        a, b = html.tree(one), html.tree(other)
        assert len(got) == brute_size(one, other)
        up = [{c: k for k, (_, cs) in enumerate(t) for c in cs} for t in (a, b)]
        for i, j in got.items():
            assert a[i][0] == b[j][0] and (up[0][i] == len(a) - 1) == (up[1][j] == len(b) - 1)
            assert up[0][i] == len(a) - 1 or got[up[0][i]] == up[1][j]
        order = [j for _, j in sorted(got.items())]
        assert order == sorted(order)  # nodes stand in page order on both sides


def test_deep_and_wide_trees_fold_and_align():
    deep = html.fold(html.parse("<div>" * 5000 + "x"))
    assert deep.count("\n") == 4999 and len(html.match(deep, deep + "\n0:p")) == 5000
    wide = html.parse("<body>" + "".join(f"<h2>{k}</h2><p>{k}</p>" for k in range(5000)))
    assert html.fold(wide) == "0:body\n1:h2\n1:p"
    assert len(html.blocks(wide)) == 10_000


def test_odd_pages(spark):
    """Line breaks in names, clashing columns, repeated rows, ties of layouts, a very long page."""
    long = "<article>" + "".join(f"<p>Paragraph {k} of it.</p>" for k in range(30_000)) + "</article>"
    rows = [
        (1, "http://a.example/1", "<body><div class='a\nb'><p>one</p></div><article><p>first</p></article></body>"),
        (1, "http://a.example/1", "<body><div class='a\nb'><p>one</p></div><article><p>first</p></article></body>"),
        (2, "http://a.example/2", "<body><div class='a\r\n b 1'><p>one</p></div><article><p>second</p></article></body>"),
        (3, "http://a.example/3", "<body><section id='x\n'><article><p>third</p></article></section></body>"),
        (4, "http://a.example/4", "<div>" * 5000 + "deep"),
        (5, "http://b.example/5", long),
        (6, None, "<p class='\n'>no url"),
        (None, "http://a.example/1", "<article>null id"),
    ]
    names = "page_id long, url string, html string, host string, folded string, node int, template string, blocks string, text string"
    got = html.extract(spark.createDataFrame([(*r, "h", "f", 1, "t", "b", "x") for r in rows], names)).toPandas()
    assert sorted(got.columns) == ["n_chars", "page_id", "text", "url"] and len(got) == len(rows)
    by = dict(zip(got.page_id.fillna(-1).astype(int), got.text))
    assert [by[k] for k in (1, 2, 3, 4, 6, -1)] == ["first", "second", "third", "deep", "no url", "null id"]
    assert by[5].count("\n") == 29_999 and (got.n_chars == got.text.str.len()).all()
