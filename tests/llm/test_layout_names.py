"""Skip names on outer, inner and sibling elements: what an extracted page has to hold is known from how it was built."""

import random

import pytest

from fusemill.llm import html_text

OUTER = ["layout-sidebar-right", "has-related content", "page_notice-none wide", "with-social-bar", "no-ads-page"]
INNER = ["sidebar", "related", "share", "footer", "cookie-notice", "ad", "newsletter", "tags", "social", "breadcrumbs", "site-footer"]


def page(rng, outer_attribute, tag, inside_article):
    """Markup and the paragraphs that an extraction has to give."""
    said = [f"Paragraph {k} of {rng.random():.6f} tells about rivers, towns and the people between them." for k in range(rng.randint(3, 9))]
    parts = [f"<p>{x}</p>" for x in said]
    for k in range(rng.randint(1, 4)):
        name = rng.choice(INNER)
        parts.insert(rng.randint(0, len(parts)), f"<div class='{name}'><p>Boilerplate {k} <a href=x>link here</a></p></div>")
    body = "".join(parts)
    if inside_article:
        body = f"<article>{body}</article>"
    sibling = f"<div class='{rng.choice(INNER)}'>Boilerplate beside <a href=y>more</a></div>"
    comments = "<div id='comments'>" + "<article><p>A reader's comment of some length stands here.</p></article>" * rng.randint(0, 40) + "</div>"
    return f"<html><body><nav>Menu</nav><{tag} {outer_attribute}>{sibling}{body}</{tag}>{comments}<footer>Boilerplate</footer></body></html>", said


@pytest.mark.parametrize("inside_article", [True, False])
def test_names_of_the_layout_lose_no_article(spark, inside_article):
    rng = random.Random(inside_article)
    rows, want = [], {}
    for k in range(60):
        outer = rng.choice([*(f"class='{o}'" for o in OUTER), "id='side-by-side'", "form"])
        tag, outer = ("form", "id='aspnetForm'") if outer == "form" else ("div", outer)
        source, said = page(rng, outer, tag, inside_article)
        rows.append((k, f"http://h{k}.example/", source))
        want[k] = "\n".join(said)
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == want


def test_boilerplate_longer_than_the_article_goes():
    long = "<p>We value your privacy and use cookies for many purposes on this site.</p>" * 5
    for wrap in ("<div class='notice'>{}</div>", "<div class='cookie-notice'>{}</div>", "<form>{}</form>", "<div class='comments'>{}</div>"):
        p = html_text.parse(f"<body>{wrap.format(long)}<article><p>Short.</p></article></body>")
        assert p.blocks == ["Short."]
    p = html_text.parse(f"<body><div class='notice'>{long}</div><p>Short.</p></body>")
    assert p.blocks == ["Short."]
    p = html_text.parse("<body><div class='has-comments post'><h1>T</h1><p>Text</p></div><div class='comments'><article>No</article></div></body>")
    assert p.blocks == ["T", "Text"]
