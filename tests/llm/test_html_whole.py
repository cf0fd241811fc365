"""Main text that custom, self-closed or open elements and words on wrappers must not take away."""

import pytest

from viewframe.llm import html_extract

CASES = {
    "custom": ("<article><p>a</p><video-player></video-player><p>b</p><svg-icon>c</svg-icon><select-box></select-box><p>d</p></article>", "a\nb\nc\nd"),
    "self-closed": ("<article><p>a</p><svg viewBox='0'/><iframe/><p>b</p></article>", "a\nb"),
    "open": ("<article><p>a</p><video src='x'><p>b</p></article>", "a\nb"),
    "raw": ("<article><p>a</p><script>if (a</b) x</script ><svg><text>t</text></svg><p>b</p></article><style>p{}", "a\nb"),
    "math": ("<article><p>a <math><mi>x</mi></math></p><object>b</object></article>", "a x\nb"),
    "widget": ("<div class='widget-container'><article><p>a</p><div class='share'>Share</div></article></div>", "a"),
    "sidebar": ("<div class='layout sidebar-left'><main><p>a</p></main><div class='menu'>Menu</div></div>", "a"),
    "form": ("<form id='page'><main><p>a</p></main></form>", "a"),
    "comment": ("<article><p>a</p></article><div id='comments'><article><p>me too</p></article></div>", "a"),
    "only": ("<nav>Menu</nav><div class='layout sidebar-left'><p>a</p></div><footer>f</footer>", "a"),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(name, f"https://{name}.example/", source) for name, (source, _) in CASES.items()]
    return {r.page_id: r.text for r in html_extract.main_texts(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}


@pytest.mark.parametrize("name", CASES)
def test_whole(found, name):
    assert found[name] == CASES[name][1]
