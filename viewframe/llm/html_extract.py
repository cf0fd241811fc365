"""Operator 3: main text of web pages by site style trees.

The pages of a host are merged into one tree whose nodes are paths of block elements with their
class and id. A leaf's content importance is 1 less the mean entropy of its blocks over the
pages: what stands on every page says nothing. An inner node's presentation importance is the
entropy of its sequences of children. A block's importance joins both and is lowered by what the
path itself tells (navigation elements, telling class names, mostly links). Branches below
THRESHOLD are removed from each page.

Entropy can't tell varied adverts, menus and footers from text, and would remove an article of
which a host has only copies. So the signs of the path weigh in, and a block inside article
or main without such signs is never taken for noise. Words on what wraps article or main are about
the layout and do not count, inside of them ids do not count and classes only where they name nothing else, and a page's only branch stays.

Defined results: a null or empty html gives the empty text; a page whose url is null belongs to a
host without name; repeated rows give repeated results; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewframe.llm.common import attach, small_batches, table, written

THRESHOLD, CONTENT = 0.25, 0.75

# Elements that begin a block, that have no end tag, whose content is no text, and signs of noise.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html iframe legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|svg|noscript|template|textarea|iframe|select|canvas|audio|video"
NOISE_ELEMENTS = frozenset("head title nav aside footer form button dialog menu fieldset option".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert advertisement adverts alert banner breadcrumb breadcrumbs byline comment comments cookie cookies copyright disclaimer disqus feedback foot footer "
    "form gdpr head header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion recommended "
    "related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget".split()
)
#: Words that hold for an article inside as well; other words on what wraps article or main are about the layout.
KIND_NAMES = frozenset("comment comments disqus related recommended reply replies respond".split())
COMMENT_NAMES, TITLE_NAMES = frozenset("comment comments disqus reply replies respond".split()), frozenset("head header byline".split())
CONTENT_NAMES = frozenset("article content entry headline main post story title".split())
#: Words that say nothing of the kind beside a noise name: what such a class names is noise inside an article too.
PLAIN_NAMES = frozenset(
    "area article articles bar block bottom box btn button buttons card cards cols column container count div el group grid icon icons inline inner item items left line link links list "
    "media module outer page panel post posts primary right row section secondary small story stories text title top unit wrap wrapper".split()
)
MODIFIER = re.compile(r"\b(?:has|with|no|without)-[\w-]+")
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

ATTRIBUTES = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
#: Raw elements go up to their end tag; one that closes itself is empty, and without an end tag only scripts and styles reach to the end.
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>]){ATTRIBUTES}(?<!/)>.*?</\1(?=[\s/>])[^>]*>|<(?:script|style)(?=[\s/>]){ATTRIBUTES}(?<!/)>.*\Z"
    rf"|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)({ATTRIBUTES})>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<", re.S | re.I
)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART, NUMBER = re.compile(r"[a-z]+"), re.compile(r"[0-9]+")
HOST = r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]*)"


def signature(tag: str, attributes: str) -> str:
    if not attributes:
        return tag
    names = sorted(f"{k[0].lower()}={' '.join((a or b or c).lower().split())}" for k, a, b, c in NAMES.findall(attributes))
    # numbers would make a path of its own of every post, and a slash would look like a step of the path
    return NUMBER.sub("#", f"{tag}[{';'.join(names)}]").replace("/", "|") if names else tag


class Page:
    """Blocks of a page in order: (path, text, characters inside links); children: (path, tags of child blocks)."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, str, int]] = []
        self.children: list[tuple[str, str]] = []
        stack: list[tuple[str, str, list[str]]] = [("", "", [])]  # tag, path, child tags
        run: list[str] = []
        linked = links = 0

        def flush() -> None:
            nonlocal linked
            if run and (text := " ".join(html.unescape("".join(run)).split())):
                self.blocks.append((stack[-1][1], text, min(linked, len(text))))
            run.clear()
            linked = 0

        def pop() -> None:
            tag, path, tags = stack.pop()
            if tags:
                self.children.append((path, " ".join(tags)))

        for m in TOKEN.finditer(source):
            token = m[0]
            tag = (m[3] or m[6] or "").lower()
            if tag:
                closing, attributes = m[2] or m[5], m[4] or m[7] or ""
                if tag not in BLOCKS:
                    if tag == "br":
                        run.append(" ")
                    elif tag == "a":
                        links = max(0, links + (-1 if closing else 1))
                    continue
                flush()
                if closing:
                    links = 0
                    if any(t == tag for t, _, _ in stack):
                        while stack[-1][0] != tag:
                            pop()
                        pop()
                    continue
                while len(stack) > 1 and stack[-1][0] in CLOSES.get(tag, {"p"}):
                    pop()
                stack[-1][2].append(tag)
                if tag not in EMPTY and not attributes.endswith("/"):
                    stack.append((tag, f"{stack[-1][1]}/{signature(tag, attributes)}", []))
            elif token[0] != "<" or token == "<":
                run.append(token)
                if links:
                    linked += len(token.strip())
        flush()
        while len(stack) > 1:
            pop()


def telling(tag: str, names: str, article: bool) -> set[str]:
    """The words of an element's class, id and role that tell of noise.

    A page's frame carries words about its parts (has-sidebar), an article's own header holds its
    title, and an article element is noise only as a reader's comment.
    """
    words = set(PART.findall(MODIFIER.sub("", names))) & NOISE_NAMES
    if tag in ("html", "body", "main"):
        return set()
    if tag == "article":
        return words & COMMENT_NAMES
    return words - TITLE_NAMES if article or CONTENT_NAMES.intersection(PART.findall(names)) else words


def telling_inside(classes: str) -> set[str]:
    """The noise names of classes inside article or main: of a class that is made of them and plain words, as share-buttons is and
    share-prices is not."""
    out: set[str] = set()
    for name in MODIFIER.sub("", classes).split():
        parts = set(PART.findall(name))
        if parts <= NOISE_NAMES | PLAIN_NAMES:
            out |= parts & NOISE_NAMES
    return out


def signs(path: str) -> tuple[bool, bool]:
    """Whether the path tells of noise, and whether it lies in an article."""
    article = False
    steps = [step.partition("[") for step in path.split("/")[1:]]
    holders = [k for k, (tag, _, _) in enumerate(steps) if tag in ("article", "main")]
    inside, inner = (holders[0], holders[-1]) if holders else (-1, -1)
    for k, (tag, _, rest) in enumerate(steps):
        names = " ".join(x.partition("=")[2] for x in rest.rstrip("]").split(";"))
        words = telling(tag, names, article)
        if k > inside >= 0:  # an id names what the text is about, so ids are no signs there
            words &= telling_inside(" ".join(x.partition("=")[2] for x in rest.rstrip("]").split(";") if not x.startswith("id=")))
        if k < inner and not article:  # wraps article or main
            words &= KIND_NAMES
        if (tag in NOISE_ELEMENTS and not (tag == "form" and k < inner)) or (tag == "header" and not article) or words:
            return True, article
        article = article or tag in ("article", "main")
    return False, article


def framed(path: str) -> bool:
    """Whether an element of the path is noise by its name."""
    return any(step.partition("[")[0] in NOISE_ELEMENTS | {"header"} for step in path.split("/")[1:])


@lru_cache(maxsize=1 << 14)
def noise(path: str) -> bool:
    return signs(path)[0]


def extract(source: str, low: frozenset[str]) -> str:
    """The text of the branches that stay; where none would, of all that are no noise by an element's name. low: what the host's tree says."""
    blocks = Page(source).blocks
    kept = [text for path, text, _ in blocks if path not in low and not noise(path)]
    return "\n".join(kept or [text for path, text, _ in blocks if not framed(path)])


def hosts(pages: DataFrame, url: str, source: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), HOST, 1))
    return pages.withColumn("__host", host).withColumn("__html", F.coalesce(F.col(source), F.lit("")))


def style_nodes(pages: DataFrame) -> DataFrame:
    """Rows (host, path, content, feature, first, chars, linked) of every page; a feature once per page and path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page, seen, paths = Page(source), {}, set()
                for path, text, linked in page.blocks:
                    key = (path, True, xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63))
                    chars, links = seen.get(key, (0, 0))
                    seen[key] = (chars + len(text), links + linked)
                for path, tags in page.children:
                    seen[path, False, xxhash.xxh3_64_intdigest(tags.encode()) - (1 << 63)] = (0, 0)
                for (path, content, feature), (chars, links) in seen.items():
                    rows.append((host, path, content, feature, (path, content) not in paths, chars, links))
                    paths.add((path, content))
            kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "path", "content", "feature", "first", "chars", "linked"])

    return pages.select("__host", "__html").mapInArrow(run, "host string, path string, content boolean, feature long, first boolean, chars long, linked long")


def importance(nodes: DataFrame) -> DataFrame:
    """Rows (host, path, importance) of content nodes, of entropies alone; linked: share of characters in links."""
    features = nodes.groupBy("host", "path", "content", "feature").agg(
        F.count("*").alias("df"), F.sum(F.col("first").cast("long")).alias("pages"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")
    )
    features = written(features, "features")  # pages are parsed once for both kinds of nodes
    sums = features.groupBy("host", "path", "content").agg(
        F.sum("pages").alias("m"), F.sum("df").alias("n"), F.sum(F.col("df") * F.log("df")).alias("weighted"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")
    )
    many = F.col("m") > 1
    # content: 1 - mean of log(df) / log(m); presentation: entropy of the child sequences to the base m
    content = F.when(many, 1 - F.col("weighted") / (F.col("n") * F.log("m"))).otherwise(1.0)
    shape = F.when(many, (F.log("n") - F.col("weighted") / F.col("n")) / F.log("m")).otherwise(1.0)
    leaves = sums.where("content").select("host", "path", content.alias("of_content"), (F.col("linked") / F.col("chars")).alias("linked"))
    inner = sums.where("not content").select("host", F.col("path").alias("parent"), shape.alias("of_shape"))
    joined = leaves.withColumn("parent", F.regexp_replace("path", "/[^/]*$", "")).join(inner, ["host", "parent"], "left")
    return joined.select("host", "path", "linked", (CONTENT * F.col("of_content") + (1 - CONTENT) * F.coalesce("of_shape", F.lit(1.0))).alias("importance"))


def low_paths(pages: DataFrame) -> DataFrame:
    """Per host the paths of its tree that are to be removed because of what stands there on several of its pages.

    A path that tells of noise by itself is no matter of the tree: extract() knows it. A path of one page has full importance and
    is only here if it is nothing but links, so what is gathered per host follows its templates, not its pages.
    """
    nodes = importance(style_nodes(pages))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = []
            for path, linked, value in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                by_path, article = signs(path)
                low.append(value * (1 - linked) < THRESHOLD and not by_path and not article)
            yield batch.filter(pa.array(low, pa.bool_())).select(["host", "path"])

    found = nodes.select("host", "path", "linked", "importance").mapInArrow(weigh, "host string, path string")
    return found.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("low"))


def main_texts(pages: DataFrame, id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars."""
    small_batches(pages.sparkSession)
    keyed = hosts(pages.select(id, url, source), url, source)
    low = written(low_paths(keyed).withColumnRenamed("host", "__host"), "styles")
    joined = attach(keyed.select(id, url, "__host", "__html"), low, "__host", "left").select(id, url, "__html", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h, frozenset(low or ())) for h, low in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            texts = [t.encode("utf-8", "replace").decode() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [id, url, "text", "n_chars"])

    return joined.mapInArrow(run, f"`{id}` {pages.schema[id].dataType.simpleString()}, `{url}` string, text string, n_chars long")


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
