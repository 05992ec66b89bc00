"""Main text of crafted pages: implied ends, whole class names, learned names."""

import time

import pytest

from concordia.llm import html

TEXT = "here is the running text of the page which goes on for a good number of words"
ARTICLE = f"<article><h1>title words</h1><p>{TEXT}</p></article>"


@pytest.mark.parametrize("opened, item", [("<select name=x>", "<option>choice {}"), ("<ul class=menu>", "<li>entry {}"),
                                          ("<div class=menu>", "<b>entry {}")])
def test_many_unclosed_elements(opened, item):
    name = opened[1:].split()[0].rstrip(">")
    page = f"<body>{opened}{''.join(item.format(k) for k in range(3000))}</{name}><p>{TEXT}</p>"
    assert html.extract(page, {}) == TEXT


def test_closing_is_linear():
    page = "<div><p>" * 50000 + TEXT + "</b>" * 100000 + "</div>" * 50000
    start = time.monotonic()
    assert html.extract(page, {}) == TEXT
    assert time.monotonic() - start < 20


@pytest.mark.parametrize("wrap", ["<main class='content no-sidebar'>", "<div class='has-comments'>", "<form id=aspnetForm>"])
def test_wrapped_pages(wrap):
    assert html.extract(f"<body>{wrap}<p>{TEXT}</p><p>{TEXT}</p>", {}) == f"{TEXT}\n{TEXT}"


def test_boilerplate_by_whole_name_and_hidden_text():
    page = f"<body><div class='box sidebar'><p>go away</p></div><p>{TEXT}</p><p hidden>not seen</p><p>{TEXT}</p>"
    assert html.extract(page, {}) == f"{TEXT}\n{TEXT}"


def test_implied_ends():
    page = f"<body><p class=promo>buy<p>{TEXT}<ul><li class=ad>buy<li>{TEXT}</ul><table><tr><td class=ad>buy<td>{TEXT}</table>"
    assert html.extract(page, {}) == "\n".join([TEXT] * 3)


def test_names_are_learned(spark):
    pages = [(k, "u", f"<body class=x><div class=page><div class='teaser'><div><p>{TEXT} {k}</p></div></div>"
              f"<article><div class=social><p>{TEXT}</p><p>{TEXT}</p></div></article></div>") for k in range(40)]
    weights = html.fit(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert weights["name teaser"] == -1 and weights["name social"] == 1 and weights["name page"] == 1
    page = f"<body><div class=page><div class=teaser><div><p>go away from here now</p></div></div><div class=social><p>{TEXT}</p></div></div>"
    assert html.extract(page, weights) == TEXT


def words(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


@pytest.fixture(scope="module")
def learned(spark):
    """Weights of the landed pages, whose articles hold only p, b, br and h1."""
    return html.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html"))


A, B, COMMENTS = words("a", 12), words("b", 36), words("c", 30)


@pytest.mark.parametrize("article, want", [
    (f"<p>{A}</p><ul><li><a href=x>one link</a></li></ul><p>{B}</p>", [A, "one link", B]),
    ("".join(f"<div><p>{words(f'p{k}x', 7)}</p></div>" for k in range(6)), [words(f"p{k}x", 7) for k in range(6)]),
    (f"<p>{A}</p><table><tr><td>x1</td><td>x2</td></tr></table><p>{B}</p>", [A, "x1", "x2", B]),
    (f"<section><h2>head</h2><p>{A} <code>f(x)</code> <span>s</span></p></section><blockquote>{B}</blockquote>", ["head", f"{A} f(x) s", B])])
def test_articles_of_other_tags_stay_whole(learned, article, want):
    page = f"<body><nav><a href=/>home</a></nav><article>{article}</article><footer>legal words</footer>"
    assert html.extract(page, learned) == "\n".join(want)
    assert html.extract(f"<body>{article}</body>", learned) == "\n".join(want)


@pytest.mark.parametrize("n", [12, 240])
def test_comments_of_an_unseen_class_stay_out(learned, n):
    page = f"<body><article><p>{words('w', n)}</p></article><div class=talkback><p>{COMMENTS}</p></div>"
    assert html.extract(page, learned) == words("w", n)


def test_a_page_whose_only_content_has_a_bad_name(learned):
    assert html.extract(f"<body><div class=promo><p>{A}</p></div>", learned) == A
