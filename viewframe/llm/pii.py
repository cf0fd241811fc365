"""Operator 10: personal data by weak supervision, with DataFrame functions only.

The base kinds are found by fixed patterns and checks; their spans always stay. Candidates of
further kinds are found by broad patterns. Labelers (strict shape, gazetteer, words before,
what touches the span, plausibility of its characters) vote yes, no or abstain on every candidate;
expectation-maximisation over the table of vote patterns estimates each labeler's reliability, and
with its posteriors as soft labels a naive Bayes classifier over features of the span is trained,
which decides, but for candidates on whose strict shape and context or gazetteer all labelers agree. Vote patterns and feature combinations are small closed sets, whatever the corpus;
only their counts reach the driver.

Positions are code points: a text is split at the matches of a kind, and the lengths of gaps and
matches add up, in a window over the matches of the text; another one tells which candidates touch a base
span. So a text full of matches costs a sort of them, which spills. Where the pattern of the contract could run
quadratically, a look-behind or a possessive quantifier takes the same matches in linear time.

Defined results: a null text counts as empty and has no spans; a row is judged by its own text
(the classifier by all rows); repeated rows agree; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from viewframe.llm.common import table, text_of, written

BASE = ("email", "ip", "card", "phone")
EXTRA = ("secret", "private_key", "iban", "national_id", "local_phone", "person", "address")
KINDS = (*BASE, *EXTRA)

# First names, and what a name looks like.
FIRST = "John|Jane|Mary|James|Robert|Michael|David|Linda|Maria|Anna|Peter|Paul|Hans|Klaus|Sabine|Pierre|Jean|Claire|Carlos|Juan|Carmen|Luis"
TITLE = r"(?:(?:Mr|Mrs|Ms|Dr|Prof)\.|Herrn?|Frau|Mme|Monsieur|Señora?)"
NAME = "[A-ZÄÖÜÉ][a-zäöüßéèáíóúñ]{1,20}"
#: Per kind: a cheap test that every text with a match passes, and the pattern.
PATTERNS = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9]", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "secret": (
        r"(?i)token|secret|passw|key|akia|asia|gh[pousr]_|sk-|xox|eyj",
        r"(?i:\b(?:api[_-]?key|token|secret|passw(?:or)?d|access[_-]?key)\x20{0,3}[=:]\x20{0,3}[\"']?[A-Za-z0-9+/_-]{12,}+)"
        r"|\bA[KS]IA[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{30,}+|\bsk-[A-Za-z0-9_-]{20,}+|\bxox[abprs]-[A-Za-z0-9-]{10,}+|\beyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    ),
    "private_key": ("PRIVATE\x20KEY", r"-----BEGIN\x20[A-Z0-9\x20]{0,20}?PRIVATE\x20KEY-----[A-Za-z0-9+/=\s]*+(?:-----END\x20[A-Z0-9\x20]{0,20}?PRIVATE\x20KEY-----)?"),
    "iban": (r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])"),
    "national_id": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "local_phone": (
        r"[0-9]{2}[)]?[-./\x20][0-9]{2}",
        r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?[0-9]{3}[-.\x20][0-9]{4}|[2-9][0-9]{2}[-.\x20][0-9]{3}[-.\x20][0-9]{4}|0[1-9](?:[\x20.-][0-9]{2}){4}|0[1-9][0-9]{1,3}[/\x20-][0-9]{5,8})(?![0-9.-]?[0-9])",
    ),
    "person": (
        rf"(?:Mr|Mrs|Ms|Dr|Prof)\.|Herrn?\x20|Frau\x20|Mme\x20|Monsieur\x20|Señora?\x20|name\x20is\x20|{FIRST}",
        rf"\b(?:(?:Mr|Mrs|Ms|Dr|Prof)\.|Herrn?|Frau|Mme|Monsieur|Señora?)\x20{NAME}(?:\x20{NAME})?|\b(?:{FIRST})\x20{NAME}|(?<=\bname\x20is\x20){NAME}\x20{NAME}",
    ),
    "address": (
        r"(?i)street|avenue|road|lane|drive|boulevard|court|square|rue|calle|stra(?:ß|ss)e|weg\x20|platz|allee|gasse",
        rf"\b[0-9]{{1,5}}\x20(?:{NAME}\x20){{1,3}}(?:Street|Avenue|Road|Lane|Drive|Boulevard|Court|Square)\b"
        rf"|\b[A-ZÄÖÜ][a-zäöüß]{{2,20}}(?:straße|strasse|weg|platz|allee|gasse)\x20[0-9]{{1,4}}\b"
        rf"|\b[0-9]{{1,4}},?\x20(?:rue|avenue|boulevard)\x20(?:(?:de|du|des|la|le|les)\x20){{0,2}}{NAME}|\b(?:Calle|Avenida)\x20(?:(?:de|del|la)\x20){{0,2}}{NAME},?\x20[0-9]{{1,4}}\b",
    ),
}
# Words that stand before personal data, and a gazetteer of values and of placeholders.
BEFORE = {
    "email": r"(?i)(?:mail|contact|write|from|to)\W*$",
    "ip": r"(?i)(?:ip|host|address|server|from)\W*$",
    "card": r"(?i)(?:card|visa|master|amex|credit|payment)\W*$",
    "phone": r"(?i)(?:tel|phone|call|mobile|fax|cell)\W*$",
    "secret": r"(?i)(?:auth|bearer|login|set|export|const)\W*$",
    "private_key": r"(?i)(?:key|pem|cert)\W*$",
    "iban": r"(?i)(?:iban|account|konto|bank|compte|cuenta)\W*$",
    "national_id": r"(?i)(?:ssn|social|security|id|number|no)\W*$",
    "local_phone": r"(?i)(?:tel|phone|call|mobile|fax|cell|at|telefon|téléphone|teléfono)\W*$",
    "person": r"(?i)(?:by|with|from|dear|contact|and|name\x20is|am)\W*$",
    "address": r"(?i)(?:at|in|address|live|lives|to|near|bei|au|wohnt|adresse)\W*$",
}
GAZETTEER = {
    "email": r"(?i)@(?:gmail|yahoo|hotmail|outlook|proton|icloud|mail)",
    "ip": r"^(?:10|127|172|192)\.",
    "card": r"^(?:4|5[1-5]|3[47]|6)",
    "phone": r"^\+(?:1|33|34|44|49|81|86|91)\b",
    "secret": r"(?i)(?:token|key|secret|passw)|^A[KS]IA|^gh[pousr]_|^sk-|^xox|^eyJ",
    "private_key": r"^-----BEGIN\x20(?:RSA\x20|EC\x20|DSA\x20|OPENSSH\x20|ENCRYPTED\x20)?PRIVATE",
    "iban": r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "local_phone": r"^\(?[2-9]|^0[1-9]",
    "person": rf"^{TITLE}\x20|(?:^|\x20)(?:{FIRST}|Smith|Jones|Brown|Garcia|Müller|Schmidt|Martin|Dupont)\b",
    "address": r"(?:Street|Avenue|Road|Lane|Drive|Boulevard|Court|Square)$|straße|strasse|rue\x20|Calle",
}
PLACEHOLDER = r"(?i)(?:xxxx|0000000|1234567|test|example_|your[_-]|changeme|placeholder)"
LABELERS = ("shape", "gazetteer", "before", "touching", "plausible")
ROUNDS, START = 25, 0.8
#: Kinds of which a value that the gazetteer knows needs no word before it.
TOLD = ("secret", "private_key", "iban", "person")


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a text of 1 to 19 digits passes Luhn's check."""
    twice = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    one = lambda i: F.substr(number, F.length(number) - i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, twice(one(i))).otherwise(one(i)))
    return total % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.try_cast("double") <= 255)
    if kind == "card":
        number = digits(match)
        return F.when(F.length(number).between(12, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    return F.lit(True)


def iban_holds(match: Column) -> Column:
    """ISO 13616: the first four characters moved to the end, letters as 10 to 35, leave 1 modulo 97."""
    plain = F.regexp_replace(match, "\x20", "")
    turned = F.split(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4)), "")
    value = lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(c.try_cast("int"))
    step = lambda a, c: F.when(c == "", a).otherwise((a * F.when(c.rlike("[A-Z]"), 100).otherwise(10) + value(c)) % 97)
    return F.coalesce(F.aggregate(turned, F.lit(0), step) == 1, F.lit(False))


NO_ITEMS = "cast(array() as array<struct<kind:int,pos:int,skip:int,size:int,m:string,before:string,after:string>>)"


def items(n: int, kind: str, text: Column) -> Column:
    """Array of a kind's matches, unchecked: skip: code points since the match before; before and after: what is next to it."""
    test, pattern = PATTERNS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(matches.alias("m"), F.slice(gaps, F.lit(1), F.size(matches)).alias("g"), F.slice(gaps, F.lit(2), F.size(matches)).alias("n"))

    def one(x: Column, k: Column) -> Column:
        before = F.substr(x["g"], F.greatest(F.lit(1), F.length(x["g"]) - 19))
        return F.struct(F.lit(n).alias("kind"), k.alias("pos"), F.length(x["g"]).alias("skip"), F.length(x["m"]).alias("size"), x["m"].alias("m"), before.alias("before"), F.substr(x["n"], F.lit(1), F.lit(4)).alias("after"))

    return F.when(text.rlike(test), F.transform(zipped, one)).otherwise(F.expr(NO_ITEMS))


def candidates(found: DataFrame) -> DataFrame:
    """found: row, items. Per valid base match, and per other match that touches none of them: row, kind, s, e, m, before, after."""
    each = found.select("row", F.explode("items").alias("x")).select("row", "x.*")
    along = Window.partitionBy("row", "kind").orderBy("pos")  # the matches of one text
    each = each.withColumn("e", F.sum(F.col("skip") + F.col("size")).over(along).cast("int")).withColumn("s", (F.col("e") - F.col("size")).cast("int"))
    checked = F.lit(True)
    for n, k in enumerate(BASE):
        checked = F.when(F.col("kind") == n, valid(k, F.col("m"))).otherwise(checked)
    each = each.where(checked)
    base = F.col("kind") < len(BASE)
    behind, ahead = Window.partitionBy("row").orderBy("s"), Window.partitionBy("row").orderBy(F.desc("s"))
    reach = F.max(F.when(base, F.col("e"))).over(behind.rangeBetween(Window.unboundedPreceding, 0))
    next_ = F.min(F.when(base, F.col("s"))).over(ahead.rangeBetween(Window.unboundedPreceding, 0))
    each = each.withColumn("reach", reach).withColumn("next", next_)
    touching = F.coalesce(F.col("reach") > F.col("s"), F.lit(False)) | F.coalesce(F.col("next") < F.col("e"), F.lit(False))
    return each.where(base | ~touching).select("row", "kind", "s", "e", "m", "before", "after")


def of_kind(choice: dict[str, str], what: Column) -> Column:
    """Whether what matches the pattern of the row's kind."""
    out = F.lit(False)
    for n, k in enumerate(KINDS):
        out = F.when(F.col("kind") == n, what.rlike(choice[k])).otherwise(out)
    return out


SHAPE = {
    "email": r"^[A-Za-z0-9][^@]*@[^@]+\.[A-Za-z]{2,}$", "ip": r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$", "card": r"^[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$", "phone": r"^\+[0-9]{1,3}[\x20-]",
    "secret": r"[=:]\x20{0,3}[\"']?[A-Za-z0-9+/_-]{20,}$|^A[KS]IA|^gh._|^sk-|^xox|^eyJ", "private_key": r"-----END|[A-Za-z0-9+/=\s]{64,}$", "iban": r"^$", "national_id": r"^[0-9-]+$",
    "local_phone": r"^(?:\([0-9]{3}\)\x20|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}$|^0", "person": rf"^{TITLE}\x20{NAME}|{NAME}\x20{NAME}$", "address": r"[0-9]",
}


def voted(candidate: DataFrame) -> DataFrame:
    """Adds a vote per labeler, 1 for yes, -1 for no, 0 to abstain, and the classifier's features."""
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    iban = KINDS.index("iban")
    shape = F.when(F.col("kind") == iban, iban_holds(F.col("m"))).otherwise(of_kind(SHAPE, F.col("m")))
    known, placeholder = of_kind(GAZETTEER, F.col("m")), F.col("m").rlike(PLACEHOLDER)
    before = of_kind(BEFORE, F.col("before"))
    joined = F.col("before").rlike(r"[\w.-]$") | F.col("after").rlike(r"^\w")
    spread = F.size(F.array_distinct(F.split(F.col("m"), ""))) * 3 >= F.least(F.length("m"), F.lit(24))
    return (
        candidate.withColumn("v_shape", vote(shape, ~shape)).withColumn("v_gazetteer", vote(known & ~placeholder, placeholder)).withColumn("v_before", vote(before, F.lit(False)))
        .withColumn("v_touching", vote(~joined, joined)).withColumn("v_plausible", vote(spread, ~spread))
        .withColumn("f_length", F.least(F.floor(F.log2(F.length("m") + 1)), F.lit(7)).cast("int"))
        .withColumn("f_before", F.when(F.col("before") == "", 0).when(F.col("before").rlike(r"\s$"), 1).when(F.col("before").rlike(r"\w$"), 2).otherwise(3))
        .withColumn("f_after", F.when(F.col("after") == "", 0).when(F.col("after").rlike(r"^\s"), 1).when(F.col("after").rlike(r"^\w"), 2).otherwise(3))
        .withColumn("f_shape", shape.cast("int")).withColumn("f_spread", spread.cast("int"))
    )


FEATURES = ("f_length", "f_before", "f_after", "f_shape", "f_spread")
VOTES = tuple(f"v_{x}" for x in LABELERS)


def agreed() -> Column:
    """Whether the shape is strict, a word before or the gazetteer says so too, and no labeler is against it. These spans stay whatever
    the classifier makes of a kind that the corpus hardly has."""
    told = F.col("kind").isin([KINDS.index(k) for k in TOLD]) & (F.col("v_gazetteer") == 1)
    return (F.least(*VOTES) >= 0) & (F.col("v_shape") == 1) & ((F.col("v_before") == 1) | told)


def reliabilities(patterns: list[tuple]) -> tuple[dict, dict]:
    """EM over (kind, votes..., count). Per labeler and truth the odds of each vote, shared by all kinds; per kind the
    share of true spans; begun with labelers that are right with probability START."""
    odds = {(k, true, v): (START if (v > 0) == true else 1 - START) if v else 0.5 for k in range(len(VOTES)) for true in (True, False) for v in (-1, 0, 1)}
    share: dict[int, float] = defaultdict(lambda: 0.5)
    post: dict[tuple, float] = {}
    for _ in range(ROUNDS):
        for kind, *votes, _n in patterns:
            yes, no = math.log(share[kind]), math.log(1 - share[kind])
            for k, v in enumerate(votes):
                if v:
                    yes += math.log(odds[k, True, v])
                    no += math.log(odds[k, False, v])
            post[kind, *votes] = 1 / (1 + math.exp(min(50, no - yes)))
        mass: dict[tuple, float] = defaultdict(lambda: 1.0)
        of_kind_yes: dict[int, float] = defaultdict(lambda: 1.0)
        of_kind_all: dict[int, float] = defaultdict(lambda: 2.0)
        for kind, *votes, n in patterns:
            p = post[kind, *votes]
            of_kind_yes[kind] += p * n
            of_kind_all[kind] += n
            for k, v in enumerate(votes):
                mass[k, True, v] += p * n
                mass[k, False, v] += (1 - p) * n
        for k in range(len(VOTES)):
            for true in (True, False):
                cast = sum(mass[k, true, v] for v in (-1, 1))
                for v in (-1, 1):
                    odds[k, true, v] = mass[k, true, v] / cast
        share = defaultdict(lambda: 0.5, {k: of_kind_yes[k] / of_kind_all[k] for k in of_kind_all})
    return post, odds


def classifier(rows: list[tuple]) -> dict[tuple, float]:
    """rows: (kind, features..., weight of true, count). Naive Bayes, kind by kind; the probability of each combination."""
    yes: dict[tuple, float] = defaultdict(float)
    no: dict[tuple, float] = defaultdict(float)
    for kind, *features, p, n in rows:
        for k, f in enumerate((None, *features)):
            yes[kind, k, f] += p
            no[kind, k, f] += n - p
    out = {}
    for kind, *features, _, _ in rows:
        total_yes, total_no = yes[kind, 0, None], no[kind, 0, None]
        score = math.log((total_yes + 1) / (total_no + 1))
        for k, f in enumerate(features, 1):
            score += math.log((yes[kind, k, f] + 1) / (total_yes + 8)) - math.log((no[kind, k, f] + 1) / (total_no + 8))
        out[kind, *features] = 1 / (1 + math.exp(-max(-50, min(50, score))))
    return out


def labelled(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id and spans, the final array of (s, kind, e), sorted."""
    spark = docs.sparkSession
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), text_of(text).alias("text"))
    found = numbered.select("row", "id", F.concat(*(items(n, k, F.col("text")) for n, k in enumerate(KINDS))).alias("items"))
    found = written(found, "candidates")  # rows keep their numbers
    voting = written(voted(candidates(found)).drop("m", "before", "after"), "votes")
    patterns = [tuple(r) for r in voting.groupBy("kind", *VOTES).count().collect()]  # at most 11 * 3^5 rows
    post, _ = reliabilities(patterns)
    soft = spark.createDataFrame([(*k, p) for k, p in post.items()], "kind int, " + ", ".join(f"{v} int" for v in VOTES) + ", p double")
    combos = voting.join(F.broadcast(soft), ["kind", *VOTES]).groupBy("kind", *FEATURES).agg(F.sum("p"), F.count("*"))
    known = classifier([tuple(r) for r in combos.collect()])  # at most 11 * 8 * 4 * 4 * 2 * 2 rows
    yes = spark.createDataFrame([k for k, p in known.items() if k[0] >= len(BASE) and p >= 0.5], "kind int, " + ", ".join(f"{f} int" for f in FEATURES))
    added = voting.where(F.col("kind") >= len(BASE)).join(F.broadcast(yes.withColumn("yes", F.lit(True))), ["kind", *FEATURES], "left").where(F.col("yes") | agreed())
    chosen = voting.where(F.col("kind") < len(BASE)).select("row", "s", "kind", "e").unionByName(added.select("row", "s", "kind", "e"))
    per_row = chosen.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("s", "kind", "e"))).alias("spans"))
    none = F.expr("cast(array() as array<struct<s:int,kind:int,e:int>>)")
    return found.select("row", "id").join(per_row, "row", "left").select("id", F.coalesce("spans", none).alias("spans"))


def joined_spans(of: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(of, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = labelled(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] < len(BASE))
    counts = [F.size(F.filter(F.col("spans.kind"), F.lit(n).__eq__)).cast("long").alias(f"n_{k}") for n, k in enumerate(BASE)]
    return out.select(
        F.col("id").alias("doc_id"), *counts, F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans")
    )
