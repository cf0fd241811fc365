"""Entropies of the site tree and the texts that follow, against a plain version over whole tables of pages."""

import math
from collections import Counter, defaultdict

import pytest

from viewframe.llm import html_extract as H
from viewframe.llm.common import table

SF = "/root/testdata/sf0.001"


def host_of(url):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    return rest.split("/")[0].split("?")[0].split("#")[0].rpartition("@")[2].partition(":")[0].lower()


@pytest.fixture(scope="module")
def pages(spark):
    return [(r.page_id, r.url, r.html or "") for r in table(spark, SF, "pages").collect()]


def plain_tree(pages):
    """Importance and share of links of every (host, path)."""
    content, shape, links = defaultdict(list), defaultdict(list), defaultdict(lambda: [0, 0])
    for _, url, source in pages:
        page, own_content, own_shape = H.Page(source), defaultdict(set), defaultdict(set)
        for path, text, linked in page.blocks:
            own_content[path].add(text)
            links[host_of(url), path][0] += linked
            links[host_of(url), path][1] += len(text)
        for path, tags in page.children:
            own_shape[path].add(tags)
        for what, own in ((content, own_content), (shape, own_shape)):
            for path, features in own.items():
                what[host_of(url), path].append(features)

    def entropy_parts(per_page):
        df = Counter(f for features in per_page for f in features)
        n, m = sum(df.values()), len(per_page)
        return n, m, sum(k * math.log(k) for k in df.values())

    out = {}
    for (host, path), per_page in content.items():
        n, m, weighted = entropy_parts(per_page)
        own = 1 - weighted / (n * math.log(m)) if m > 1 else 1.0
        parent = 1.0
        if (host, above := path.rpartition("/")[0]) in shape:
            pn, pm, pw = entropy_parts(shape[host, above])
            parent = (math.log(pn) - pw / pn) / math.log(pm) if pm > 1 else 1.0
        linked, chars = links[host, path]
        out[host, path] = (H.CONTENT * own + (1 - H.CONTENT) * parent, linked / chars)
    return out


def test_importance_of_all_nodes(spark, pages):
    found = {(r.host, r.path): (r.importance, r.linked) for r in H.importance(H.style_nodes(H.hosts(table(spark, SF, "pages"), "url", "html"))).collect()}
    plain = plain_tree(pages)
    assert found.keys() == plain.keys() and len(found) > 50
    for key, values in plain.items():
        assert found[key] == pytest.approx(values, abs=1e-9), key


def test_texts_of_all_pages(spark, pages):
    tree = plain_tree(pages)
    texts = defaultdict(list)
    for r in H.main_texts(table(spark, SF, "pages")).collect():
        texts[r.page_id].append((r.text, r.n_chars))
    for page_id, url, source in pages:
        kept, rest = [], []
        for path, text, _ in H.Page(source).blocks:
            by_path, article = H.signs(path)
            value, linked = tree[host_of(url), path]
            if not (by_path or (not article and value * (1 - linked) < H.THRESHOLD)):
                kept.append(text)
            if not H.framed(path):
                rest.append(text)
        text = "\n".join(kept or rest)
        assert (text, len(text)) in texts[page_id]


def test_names_of_topics_inside_an_article_are_no_noise():
    """Ids never tell of noise there, classes only if they name nothing else."""
    from viewframe.llm.html_extract import extract

    article = (
        '<article><p>Body.</p><h2 id="social-security">Social</h2><section id="share-prices"><p>Prices rose.</p></section><div class="ad-hoc-analysis"><p>Ad hoc.</p></div>'
        '<div class="share-buttons"><p>Tweet</p></div><div class="related-posts"><p>More</p></div><div id="comments" class="comment-list"><p>First!</p></div></article>'
    )
    assert extract(f'<body><div class="sidebar"><p>Side</p></div>{article}</body>', frozenset()) == "Body.\nSocial\nPrices rose.\nAd hoc."
    assert extract('<main><p>x</p><div class="widget-explainer"><p>Explains.</p></div><div class="comments"><p>c</p></div></main>', frozenset()) == "x\nExplains."
    long = "<main>" + "<p>word &amp; word</p>\n" * 50_000 + "</main>"
    assert extract(long, frozenset()).count("\n") == 49_999
