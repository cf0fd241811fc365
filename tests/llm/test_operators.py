"""The operators against brute force on a small table with nulls, empty, long and repeated texts, ties, and clashing columns."""

import base64
import hashlib
import html
import random
import re
from collections import Counter, defaultdict

import pytest
import public_tokenizers as P
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Library

from viewframe.llm import exact_dedup, html_extract, license_scan, mixing, pii, quality, simhash, substring_dedup, token_queries
from viewframe.llm.common import attach, is_small
from viewframe.llm.suffix_array import permuted_lcp, suffix_array

SCHEMA = "doc_id long, text string, source string, size long, row long, fp long, digest string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeéß漢") for _ in range(rng.randrange(1, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    shared, copy = prose(rng, 120), prose(rng, 60)
    out = {k: prose(rng, rng.randrange(5, 150)) for k in range(40)}
    out |= {40: None, 41: "", 42: " \n\t", 43: copy, 44: copy.replace(" ", "  \n"), 45: copy, 46: f"{prose(rng, 9)} {shared} {prose(rng, 5)}", 47: f"{shared} {prose(rng, 7)}"}
    out |= {48: "ab " * 400, 49: "x" * 3000, 50: copy + " Tail", 51: "Line one here\n" * 12, 52: "don't we'll 'RE    x\n\n<|endoftext|> y", 53: "# * $ % & | < > " * 9, 54: prose(rng, 4000)}
    out |= {55: "Mail a.b@c.de, +49 (30) 1234567 or 4111 1111 1111 1111 from 10.0.0.1 and 300.1.1.1; token = \"0123456789abcdef0123456789abcdef\""}
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, None if k % 7 == 0 else f"s{k % 5}", 1, 2, 3, "clash") for k, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def test_mixing(docs, texts, none):
    rows = got(mixing.with_copies(docs))
    again = got(mixing.with_copies(docs.repartition(2)))
    assert {k: r["__copies"] for k, r in rows.items()} == {k: r["__copies"] for k, r in again.items()}
    sizes = defaultdict(int)
    for k, t in texts.items():
        assert rows[k]["__size"] == len(WORD.findall(t or ""))
        sizes[rows[k]["source"]] += rows[k]["__size"]
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), [5, 2, 1] * 9, strict=False))
    target, open_ = {}, set(sizes)
    while True:
        rest = sum(sizes.values()) - sum(target.values())
        share = {s: rest * weights[s] / sum(weights[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not above:
            target |= share
            break
        target |= {s: 3.0 * sizes[s] for s in above}
        open_ -= above
    for r in rows.values():
        assert r["__source_size"] == sizes[r["source"]] and r["__target"] == pytest.approx(target[r["source"]])
        assert int(rate := target[r["source"]] / sizes[r["source"]]) <= r["__copies"] <= min(3, int(rate) + 1)
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(docs).count() == sum(r["__copies"] for r in rows.values())
    assert mixing.mixed(none).count() == 0


def test_exact_dedup(spark, docs, texts, none):
    normal = {k: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for k, t in texts.items()}
    groups = defaultdict(list)
    for k, t in normal.items():
        groups[t].append(k)
    for digest in (exact_dedup.sha256, lambda c: F.substring(F.md5(c), 1, 1)):  # the second one clashes
        rows = got(exact_dedup.exact_groups(docs, digest=digest), "id")
        assert {k: (r.keep_id, r.group_size, r.kept) for k, r in rows.items()} == {k: (min(groups[t]), len(groups[t]), k == min(groups[t])) for k, t in normal.items()}
    assert rows[43].keep_id == 43 and rows[45].keep_id == 43 and rows[40].keep_id == 40 and rows[42].keep_id == 42
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(map(min, groups.values()))
    twice = docs.where("doc_id in (1, 43, 45)").unionByName(docs.where("doc_id in (1, 43)")).unionByName(docs.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted(r.doc_id for r in exact_dedup.keep_first(twice).collect()) == [1, 43]
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.keep_first(none).count() == 0


def test_dedup_state_lasts(spark, docs):
    store = exact_dedup.DedupStore(spark)
    for part in ("doc_id >= 45", "doc_id < 45"):
        store.load(docs.where(part))
        store.advance()
    state = {r.digest: r for r in store.state().collect()}
    whole = exact_dedup.exact_groups(docs)
    assert all(state[r.digest]["first"]["id"] == r.keep_id and state[r.digest]["count"] == r.group_size for r in whole.collect())


def test_quality(docs, texts, none):
    rows = got(quality.quality(docs))
    for k, t in texts.items():
        words = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        many = Counter(grams)
        covered = {j for i, g in enumerate(grams) if many[g] > 1 for j in range(i, i + 5)}
        r = rows[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words)) and not (r.base_failed and r.kept)
        assert r.kept == (not any(rule(quality.Doc(t and t.encode())) for rule in quality.RULES.values()))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in rows.items() if r.kept} and len({k for k, r in rows.items() if r.kept}) > 30
    assert quality.quality(none).count() == 0 and quality.keep_good(none).count() == 0


def test_cascade_order_does_not_change_verdicts(texts):
    for sample in (0, 5, 100):
        cascade = quality.Cascade(sample=sample)
        assert [cascade.keeps((t or "").encode()) for t in texts.values()] == [not any(r(quality.Doc((t or "").encode())) for r in quality.RULES.values()) for t in texts.values()]


def test_repeat_words_renumbers():
    words = [b"w%d" % (k % 9000) for k in range(9010)]
    assert quality.repeat_words(words) == 20


def test_token_counts(docs, texts, none):
    path = P.path(token_queries.COUNT_VOCABULARY)
    library = Library.from_file(path)
    rows = got(token_queries.token_counts(docs, path))
    for k, t in texts.items():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (rows[k].n_bytes, rows[k].n_tokens, rows[k].over_limit) == (len((t or "").encode()), n, n > 512)
    assert token_queries.token_counts(none, path).count() == 0


@pytest.fixture(scope="module")
def encoding():
    with open(P.path(token_queries.CODE_VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_codes(docs, texts, none, encoding):
    path = P.path(token_queries.CODE_VOCABULARY)
    rows = got(token_queries.code_digests(docs, path))
    for k, t in texts.items():
        ids = encoding.encode_ordinary(t or "")
        assert (rows[k].n_tokens, rows[k].ids_sha256, rows[k].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(t or ""))
    coded = token_queries.encoded(docs, path)
    assert {k: r.text for k, r in got(token_queries.decoded(coded, path)).items()} == {k: t or "" for k, t in texts.items()}
    assert token_queries.code_digests(none, path).count() == 0


def test_machines_on_random_text(encoding):
    from viewframe.llm import tokens

    rng = random.Random(7)
    machine = token_queries.machine(token_queries.vocabulary(P.path(token_queries.CODE_VOCABULARY)))
    chars = "aAsStTrReEvVlLmMdD'''   \n\n\t\x0b\xa0 .,!?#123é中文字😀́　ñ\x1c\x85"
    many = ["".join(rng.choice(chars) for _ in range(rng.randrange(60))) for _ in range(1500)] + ["a" * 900, " " * 700 + "x", "".join(rng.choice("abcdef") for _ in range(2000))]
    for t, ids in zip(many, machine.ids(many), strict=True):
        assert ids == encoding.encode_ordinary(t)
        decoder = tokens.StreamDecoder(machine.bytes)
        assert "".join([*(decoder.feed([i]) for i in ids), decoder.finish()]) == t
    kinds = tokens.classes("regex")[[ord(c) for c in "".join(many)[: 3 * tokens.CHUNK + 5]]]
    whole, state = tokens.boundaries(kinds)
    a, middle = tokens.boundaries(kinds[:301])
    b, end = tokens.boundaries(kinds[301:], middle)
    assert [*a, *b] == [*whole] and end == state


def bits(text):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    ids, up = sorted(prints), {k: k for k in prints}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {k: root(k) for k in ids}


def test_simhash(docs, texts, none):
    prints = {k: bits(t) for k, t in texts.items()}
    rows = got(simhash.near_groups(docs), "id")
    assert {k: int(r.fingerprint, 16) for k, r in rows.items()} == prints
    assert {k: r.component_id for k, r in rows.items()} == components(prints)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(components(prints).values()))
    assert simhash.near_groups(none).count() == 0 and simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("hot", [simhash.HOT, 7])
def test_links_of_crowded_fingerprints(spark, hot):
    rng = random.Random(11)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(200)}
    prints = dict(enumerate(sorted(fps)))
    df = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in prints.items()], "id long, fp long")
    assert {r.id: r.component_id for r in simhash.grouped(df, hot).collect()} == components(prints)


def test_near_dedup_keeps_one_of_repeated_and_nameless_rows(spark, texts):
    rows = [(1, texts[43]), (1, texts[43]), (None, texts[44]), (None, texts[0]), (None, texts[0]), (1, texts[2])]
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept, key=repr) == sorted([(1, texts[43]), (1, texts[2]), (None, texts[0])], key=repr)


def test_suffix_arrays():
    import numpy as np

    rng = random.Random(3)
    for _ in range(200):
        s = [rng.randrange(1, rng.choice([2, 3, 20])) for _ in range(rng.randrange(1, 60))] * rng.choice([1, 1, 3]) + [0]
        order = sorted(range(len(s)), key=lambda i: s[i:])
        sa = suffix_array(np.array(s, np.uint8))
        shared = permuted_lcp(np.array(s, np.uint8), sa)
        assert sa.tolist() == order
        for i, j in zip(order[1:], order, strict=False):
            n = 0
            while max(i, j) + n < len(s) and s[i + n] == s[j + n]:
                n += 1
            assert shared[i] == n


@pytest.mark.parametrize("hot", [substring_dedup.HOT, 1])
def test_substring_dedup(docs, texts, none, hot):
    size, data = substring_dedup.SIZE, {k: (t or "").encode() for k, t in texts.items()}
    many = Counter(b[i : i + size] for b in data.values() for i in range(len(b) - size + 1))
    rows = got(substring_dedup.without_repeats(docs, hot=hot), "id")
    for k, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if many[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert (rows[k].n_bytes, rows[k].n_removed, rows[k].n_spans, bytes(rows[k].kept)) == (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept), k
    assert rows[48].n_removed and rows[49].n_removed and rows[46].n_removed
    assert substring_dedup.without_repeats(none).count() == 0


def split_anew(spark, monkeypatch, module):
    """Lets every table that the module writes change how later jobs split files, as executors that come and go do."""
    plain, sizes = module.written, iter(["4k", "128m"] * 50)
    setting = "spark.sql.files.maxPartitionBytes"

    def written(df, what):
        out = plain(df, what)
        spark.conf.set(setting, next(sizes))
        return out

    monkeypatch.setattr(module, "written", written)
    return lambda: spark.conf.unset(setting)


def test_substring_rows_hold_when_splits_change(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    common = prose(rng, 120)
    rows = [(k, common + " " + prose(rng, 20 + k) if k % 3 == 0 else prose(rng, 90 + k)) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    whole = {r.id: (r.n_removed, bytes(r.kept)) for r in substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    again = split_anew(spark, monkeypatch, substring_dedup)
    try:
        files = spark.read.parquet(str(tmp_path / "documents.parquet"))
        out = {r.id: (r.n_removed, bytes(r.kept)) for r in substring_dedup.without_repeats(files, plain_scan=True).collect()}
    finally:
        again()
    assert out == whole and {k for k, (n, _) in out.items() if n} == {k for k, _ in rows if k % 3 == 0}


def test_license_rows_hold_when_splits_change(spark, tmp_path, monkeypatch):
    rows = [(f"d{k}/x.py", "Released under the MIT License.\n" + "code " * 30 if k % 3 == 0 else "code") for k in range(60)]
    spark.createDataFrame(rows, "path string, text string").repartition(7).write.parquet(str(tmp_path / "files.parquet"))
    again = split_anew(spark, monkeypatch, license_scan)
    try:
        out = {r.path: r.license for r in license_scan.scanned(spark.read.parquet(str(tmp_path / "files.parquet"))).collect()}
    finally:
        again()
    assert out == {f"d{k}/x.py": "MIT" if k % 3 == 0 else None for k in range(60)}


def test_segments_of_a_long_text(monkeypatch):
    rng = random.Random(2)
    text = bytes(rng.randrange(97, 101) for _ in range(20_000))
    starts = lambda: {s: (a, h) for a, h, b, c in zip(*(x.tolist() for x in next(substring_dedup.text_anchors([text]))), strict=True) for s in range(b, c + 1)}
    whole = starts()
    assert len(whole) == 20_000 - substring_dedup.SIZE + 1
    monkeypatch.setattr(substring_dedup, "SEGMENT", 3000)
    assert starts() == whole


def page(article, n):
    return (
        f'<!DOCTYPE html><html><head><title>T {n}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header>Site {n}</header><nav><ul><li><a href="/a">Menu{n}</a></li></ul></nav>'
        f'<div class="cookie-notice">We use cookies {n}</div><div class="ad">Buy {n}!</div><!-- x --><article>{article}</article><aside class="sidebar">More {n}</aside>'
        f'<div id="comments"><p>Nice, {n}</p></div><form><label>Mail</label><button>Go</button></form><footer>&copy; {n}</footer>'
    )


def test_html(spark):
    rng = random.Random(4)
    articles = {k: [prose(rng, 12) + " &", prose(rng, 30), f"a {k} b"] for k in range(30)}
    rows = [(k, f"https://h{k % 3}.example/x/{k}", page(f"<h1>{html.escape(a[0])}</h1><p><b>{a[1]}<br><p>a&nbsp;{k}\n <i>b</i>", k), "clash") for k, a in articles.items()]
    rows += [(100, None, None, "c"), (101, "u", "", "c"), (102, "https://h0.example/", "no markup &amp; all", "c"), (103, "https://h0.example/q", "<p>cut <a href='x>y'>li", "c"), (0, rows[0][1], rows[0][2], "c")]
    out = html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, low string")).collect()
    found = {r.page_id: r for r in out}
    assert len(out) == len(rows)
    for k, a in articles.items():
        assert found[k].text == "\n".join(a) and found[k].n_chars == len(found[k].text)
    assert (found[100].text, found[101].text, found[102].text) == ("", "", "no markup & all") and found[103].text.startswith("cut")
    assert html_extract.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_frames_and_headers_of_articles_are_no_noise(spark):
    source = (
        '<body class="page header-fixed sidebar-left"><div class="wrap has-sidebar"><div class="post-header"><h2>Title</h2></div><div class="content">Body one</div>'
        '<article class="comment">me too</article><article class="story ad-free"><header class="article-header"><h1>Head</h1></header><p>Text</p><div class="share-bar">Share</div><footer>x</footer></article></div>'
    )
    row = html_extract.main_texts(spark.createDataFrame([(1, "https://a.example/", source)], "page_id long, url string, html string")).first()
    assert row.text == "Title\nBody one\nHead\nText"


def test_boilerplate_is_told_by_entropy_alone(spark):
    rng = random.Random(8)
    rows = [(k, "https://one.example/", f"<div><div class='x'>The same words everywhere</div><div class='y'>{prose(rng, 20)}</div></div>") for k in range(40)]
    for r in html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert "same words" not in r.text and r.text


def test_licenses(spark, docs, none):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/c/x.py", "code"), ("a/b/y.py", "Licensed under the Apache License, Version 2.0.\n" + "code " * 30), ("a/b/LICENSE", "This work is licensed under the GNU General Public License, version 3."), ("z/q.py", "all"), (None, None), ("a", "top")]
    found = {r.path: (r.license, r.inherited_from) for r in license_scan.scanned(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert found == {"a/LICENSE": ("MIT", None), "a/b/c/x.py": ("GPL-3.0", "a/b"), "a/b/y.py": ("Apache-2.0", None), "a/b/LICENSE": ("GPL-3.0", None), "z/q.py": (None, None), None: (None, None), "a": (None, None)}
    assert license_scan.scanned(none.withColumn("path", F.col("source"))).count() == 0


RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, match):
    d = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def test_pii(spark, docs, texts, none):
    rng = random.Random(6)
    pieces = ["a@b.c", "x.y+z@mail.example.org", "@", "1.2.3.4", "999.1.1.1", "1.2.3.4.5", "4111111111111111", "4111-1111 1111-1111", "+1 (415) 555-0199", "+12", "é", "a@b.c_d@e.f", " ", " ", "\n", "42", "Dr. Jane Smith", "(415) 555-0199", "078-05-1120", "0" * 40]
    extra = {1000 + k: "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for k in range(300)}
    whole = {**texts, **extra}
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(extra.items()), "doc_id long, text string"))
    for r in pii.labelled(df).collect():
        base = [(x.s, x.kind, x.e) for x in r.spans if x.kind < 4]
        t = whole[r.id] or ""
        assert base == sorted((m.start(), n, m.end()) for n, (k, p) in enumerate(RULES.items()) for m in re.finditer(p, t) if passes(k, m[0])), t
        assert all(0 <= x.s < x.e <= len(t) for x in r.spans)
    assert pii.labelled(none).count() == 0


def test_joins_by_size(spark):
    left = spark.createDataFrame([(k, None if k % 3 == 0 else k % 3) for k in range(90)], "i int, k int")
    right = spark.createDataFrame([(None, "n"), (1, "a")], "k int, v string")
    few = attach(left, right, "k", "left")
    assert is_small(right) and not is_small(right, rows=1)
    from viewframe.llm import common

    rows, common.BROADCAST_ROWS = common.BROADCAST_ROWS, 1
    try:
        salted = attach(left, right.union(right.limit(0)), "k", "left") if not is_small(right, 1) else None
    finally:
        common.BROADCAST_ROWS = rows
    assert sorted(map(tuple, few.collect()), key=repr) == sorted(map(tuple, salted.select(few.columns).collect()), key=repr)
    assert few.where("v = 'n'").count() == 30
