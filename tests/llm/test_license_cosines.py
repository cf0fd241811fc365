"""Cosines, licenses and inheritance against a plain version, over a whole table of documents and files with full license texts."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from viewframe.llm import license_scan as L
from viewframe.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def files(spark):
    docs = [(f"{r.source}/{r.lang}/{r.doc_id}", r.text) for r in table(spark, SF, "documents").collect()]
    wrap = lambda t, n: "\n".join(" ".join(t.split()[k : k + n]) for k in range(0, len(t.split()), n))
    docs += [(f"full/{name}/NOTICE", f"{name}\n\nCopyright (c) 2020 A. Body\n\n{wrap(text, 11)}") for name, text in L.FULL.items()]
    docs += [(f"full/{name}/deep/er/x.py", "code") for name in L.FULL] + [("apache/y.py", "# " + "\n# ".join(wrap(L.FULL["Apache-2.0"], 9).split("\n")) + "\n\n" + "code " * 30), (None, "Released under the MIT License."), ("e", "")]
    return docs


def words(text):
    return [w for w in (x.strip(".") for x in re.split(L.TERM, text.lower())) if w]


def plain(files):
    line, mark, code, phrase = map(re.compile, (L.LICENSE_LINE, L.MARK, L.COMMENTED, L.PHRASE))
    units = []
    for n, (path, text) in enumerate(files):
        if not text or not line.search(text):
            continue
        blocks = [b for b in re.split("\n{2,}", mark.sub("", code.sub("", text))) if "\n" in b.strip(" ")]
        units += [(n, kind, x) for kind, xs in ((L.LINE, text.split("\n")), (L.BLOCK, [b.replace("\n", " ") for b in blocks]), (L.FILE, [text] * bool(phrase.search(text) or re.search(L.LICENSE_FILE, path or "")))) for x in xs if line.search(x)]
        head = [y for y in (mark.sub("", x).strip(" ") for x in text.split("\n")) if y][: L.TITLE_LINES]
        titles = [*head, *(f"{a} {b}" for a, b in zip(head, head[1:], strict=False))]
        units += [(n, L.TITLE, x) for x in titles if re.search(L.TITLE_WORDS, x) and line.search(x)]
    df = Counter(w for _, _, x in units for w in set(words(x)))
    idf = lambda w: math.log((1 + len(units)) / (1 + df[w])) + 1
    vector = lambda x: {w: n * idf(w) for w, n in Counter(words(x)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [(name, L.HEADERS, vector(t)) for name, ts in L.TEMPLATES.items() for t in ts] + [(name, L.WHOLES, vector(t)) for name, t in L.FULL.items()] + [(name, L.NAMES, vector(t)) for name, ts in L.TITLES.items() for t in ts]
    kind_of = {L.FILE: L.WHOLES, L.TITLE: L.NAMES}
    number = lambda w: re.sub(r"^v|(?:\.0)+$", "", w)
    version = lambda name: number(m[1]) if (m := re.search(r"-([0-9]+(?:\.[0-9]+)?)$", name)) else ""
    out = {}
    for n, kind, x in units:
        v = vector(x)
        scored = [(-round(sum(v.get(w, 0) * y for w, y in t.items()) / norm(t) / norm(v), 9), name) for name, full, t in templates if full == kind_of.get(kind, L.HEADERS)]
        said = {number(w) for w in v if re.search(L.VERSION, w)}
        scored = [(c, name) for c, name in scored if not version(name) or not said or version(name) in said or kind == L.FILE]
        best = min((s for s in scored if -s[0] >= (L.WHOLE if kind in kind_of else L.THRESHOLD)), default=None)
        if best:
            out.setdefault(n, []).append((best, kind, len(x.split())))
    return {n: (min(b for b, _, _ in found), any(k in kind_of for _, k, _ in found) or any(2 * sum(m for _, k, m in found if k == kind) > len(files[n][1].split()) for kind in (L.LINE, L.BLOCK))) for n, found in out.items()}


def test_licenses_of_all_files(spark, files):
    own = plain(files)
    lent = {}
    for n, ((c, name), whole) in own.items():
        path = files[n][0]
        if path and (whole or re.search(L.LICENSE_FILE, path)):
            lent.setdefault(path.rpartition("/")[0], []).append((path, c, name))
    expected = {}
    for n, (path, _) in enumerate(files):
        if n in own:
            expected[n] = (own[n][0][1], -own[n][0][0], None)
            continue
        above = path.rpartition("/")[0] if path else None
        while above is not None and above not in lent:
            above = above.rpartition("/")[0] if above else None
        expected[n] = (min(lent[above])[2], 0.0, above) if above is not None else (None, 0.0, None)
    df = spark.createDataFrame([(n, p, t) for n, (p, t) in enumerate(files)], "n int, path string, text string")
    found = {r.n: (r.license, r.cosine, r.inherited_from) for r in L.scanned(df, keep=("n",)).collect()}
    assert found.keys() == expected.keys()
    for n, (name, cosine, directory) in expected.items():
        assert found[n][0] == name and found[n][2] == directory and found[n][1] == pytest.approx(cosine, abs=1e-6), files[n][0]
    for name in L.FULL:
        n = next(k for k, (p, _) in enumerate(files) if p == f"full/{name}/deep/er/x.py")
        assert found[n][0] == name and found[n][2] == f"full/{name}"


def test_no_license_at_all(spark):
    df = spark.createDataFrame([("a/b", "plain"), ("a/c", None)], "path string, text string")
    assert [(r.license, r.cosine) for r in L.scanned(df).select("license", F.col("cosine")).collect()] == [(None, 0.0)] * 2
