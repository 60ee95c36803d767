"""Personal data: stated patterns, and candidates of generous generators that boosted trees select, in SQL functions.

Base kinds are patterns.  Further kinds come from generators that propose spans, possibly overlapping: telephone numbers
without a country code (`local`), identity numbers (`ident`), account numbers (`iban`) and spelt-out addresses
(`address`).  Each candidate gets format and context features; gradient-boosted trees of depth two, fitted on the
driver to a fixed set of made-up examples, give a score, and a threshold calibrated on examples kept back, one for each
kind, selects spans.  The trees become CASE expressions, so the scan is a projection of built-in functions.  Selected
spans that overlap a base span or a better one are left out.

Positions come from the lengths of what a pattern splits the text into.  Patterns are written without nested
repetition, so long texts neither overflow the matcher's stack nor make it backtrack.

Offsets are code points, ends exclusive.  A null text counts as empty: no spans.  Rows keep their number; repeated
ids and rows are scanned one by one; an empty table gives an empty result; columns other than doc_id and text are not
read.
"""

from __future__ import annotations

import functools
import math
import random
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm.common import documents
from parcelflow.llm.rules import bound

BASE = ("email", "ip", "card", "phone")
MORE = ("local", "ident", "iban", "address")
NO_SPANS = "array<struct<start:int,kind:int,end:int>>"

# Characters that stand for a separator inside a match, so that runs are single classes.  They take the
# place of one character each; should a text contain them, they are replaced first by one that no pattern accepts.
DOT, GAP, NONE = "\x01", "\x02", "\x03"
NAME = "A-Za-z0-9"

#: A match starts where a run starts or where the last match ended: the same matches as from any place, in one pass.
EMAIL = rf"(?:\G|(?<![{NAME}._%+{DOT}-]))[{NAME}._%+{DOT}-]++@[{NAME}-]++{DOT}[{NAME}{DOT}-]++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = rf"[0-9][0-9{GAP}]+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IN_RANGE = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"

GENERATORS = {
    "local": r"(?<![0-9A-Za-z])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
    "ident": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "address": rf"(?<![{NAME}])[{NAME}][{NAME}._%+-]{{0,63}}\x20?[\[(](?:at|AT)[\])]\x20?[{NAME}-]{{1,63}}(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[{NAME}-]{{1,63}}){{1,4}}",
}
GUARDS = {"local": r"[0-9]{3}[\x20.-][0-9]{4}", "ident": r"[0-9]-[0-9]{2}-[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "address": r"[\[(](?:at|AT)[\])]"}
CONTEXT = 32
SPEAKING = r"(?i)(?:tel|phone|call|mobile|fax|cell|contact|ssn|social|iban|account|bank|mail|write|reach|name)"
OTHERWISE = r"(?i)(?:order|invoice|version|isbn|part|serial|ref|page|total|chapter|item|model|\$|€|#)"


# --- positions -------------------------------------------------------------------------------------------------------


def sums(values: Column) -> Column:
    """Running sums, each before its own value, in blocks of about the root of the number of values."""

    def plain(x: Column, start: Column) -> Column:
        state = F.struct(start.alias("n"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(x, state, lambda a, v: F.struct((a["n"] + v).alias("n"), F.concat(a["out"], F.array(a["n"])).alias("out")), lambda a: a["out"])

    def blocks(x: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(x))).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(x), F.lit(1)) - 1) / size).cast("int")), lambda k: F.slice(x, k * size + 1, size))

    def joined(b: Column) -> Column:
        totals = F.transform(b, lambda y: F.aggregate(y, F.lit(0), lambda a, v: a + v))
        return F.flatten(F.zip_with(b, plain(totals, F.lit(0)), plain))

    return bound(blocks(values), joined)


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, m) for each match of the pattern, leftmost first."""

    def place(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
        both = F.zip_with(F.slice(gaps, 1, F.size(found)), F.transform(found, lambda m: F.length(m)), lambda g, m: F.coalesce(g, F.lit(0)) + F.coalesce(m, F.lit(0)))
        return bound(F.struct(gaps.alias("gaps"), sums(both).alias("before")), lambda x: F.transform(found, lambda m, i: F.struct((F.get(x["before"], i) + F.get(x["gaps"], i)).alias("start"), m.alias("m"))))

    none = F.array().cast("array<struct<start:int,m:string>>")
    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda f: F.when(F.size(f) == 0, none).otherwise(place(f)))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def step(a: Column, i: Column) -> Column:
        d = (F.ascii(F.substring(number, -i, F.lit(1))) - 48) * F.when(i % 2 == 0, 2).otherwise(1)
        return a + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), step) % 10 == 0


def kept(found: Column, kind: int, good) -> Column:  # noqa: ANN001
    good_ones = F.filter(found, lambda x: good(x["m"]))
    return F.transform(good_ones, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["m"])).alias("end")))


def plain(text: Column) -> Column:
    return F.translate(text, DOT + GAP + NONE, NONE * 3)


def base_spans(text: Column) -> list[Column]:
    """For each base kind, its spans; texts without a sign of the kind are not searched."""
    none = F.array().cast(NO_SPANS)
    card_ok = lambda m: bound(digits(m), lambda d: F.length(d).between(14, 19) & F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))
    email = F.regexp_replace(plain(text), rf"(?<=[{NAME}-])\.(?=[{NAME}-])", DOT)
    card = F.regexp_replace(plain(text), r"(?<=[0-9])[\x20-](?=[0-9])", GAP)
    return [
        F.when(F.contains(text, F.lit("@")), bound(email, lambda t: kept(matches(t, EMAIL), 0, lambda m: F.lit(True)))).otherwise(none),
        F.when(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), kept(matches(text, IP), 1, lambda m: m.rlike(IN_RANGE))).otherwise(none),
        F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), bound(card, lambda t: kept(matches(t, CARD), 2, card_ok))).otherwise(none),
        F.when(text.rlike(r"\+[0-9]"), kept(matches(text, PHONE), 3, lambda m: F.length(digits(m)).between(10, 15))).otherwise(none),
    ]


# --- candidates ------------------------------------------------------------------------------------------------------

#: Names of the features, each with its SQL expression over (m, before, after) and the same in Python for fitting.
FEATURES = {
    "digits": (lambda m, b, a: F.length(digits(m)), lambda m, b, a: len(re.sub("[^0-9]", "", m))),
    "length": (lambda m, b, a: F.length(m), lambda m, b, a: len(m)),
    "brackets": (lambda m, b, a: F.length(m) - F.length(F.regexp_replace(m, r"[()\[\]]", "")), lambda m, b, a: len(re.findall(r"[()\[\]]", m))),
    "hyphens": (lambda m, b, a: F.length(m) - F.length(F.regexp_replace(m, "-", "")), lambda m, b, a: m.count("-")),
    "zeros": (lambda m, b, a: F.when(m.rlike(r"^\(?0{3}|-0{2}-|0{4}$"), 1).otherwise(0), lambda m, b, a: int(bool(re.search(r"^\(?0{3}|-0{2}-|0{4}$", m)))),
    "speaking": (lambda m, b, a: F.when(b.rlike(SPEAKING), 1).otherwise(0), lambda m, b, a: int(bool(re.search(SPEAKING, b)))),
    "otherwise": (lambda m, b, a: F.when(b.rlike(OTHERWISE), 1).otherwise(0), lambda m, b, a: int(bool(re.search(OTHERWISE, b)))),
    "numbers": (lambda m, b, a: F.when(b.rlike(r"[0-9][\x20.,-]*$") | a.rlike(r"^[\x20.,-]*[0-9]"), 1).otherwise(0), lambda m, b, a: int(bool(re.search(r"[0-9][\x20.,-]*$", b) or re.search(r"^[\x20.,-]*[0-9]", a)))),
}


def examples() -> dict[str, list[tuple[str, str, str, int]]]:
    """Made-up candidates (match, before, after, whether personal) of each kind; always the same."""
    rng = random.Random(7)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    yes = ["call me at ", "Tel: ", "phone ", "my mobile is ", "contact ", "reach us under ", "SSN ", "social security ", "IBAN ", "bank account ", "write to ", "mail ", "name and number "]
    no = ["order ", "invoice no. ", "version ", "ISBN ", "part ", "serial ", "ref ", "page ", "total $", "item #", "model "]
    neutral = ["the ", "of and ", "", "with that ", "in "]
    out: dict[str, list] = {k: [] for k in MORE}
    for _ in range(500):
        shapes = {
            "local": rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}"]),
            "ident": f"{d(3)}-{d(2)}-{d(4)}",
            "iban": rng.choice(["DE", "FR", "ES", "GB"]) + d(2) + "".join(" " * (_ % 2) + d(4) for _ in range(4)) + " " * (_ % 2) + d(2),
            "address": f"{rng.choice(['jo', 'ann.lee', 'info'])}{d(2)} [at] mail{d(1)}{rng.choice(['.', ' [dot] '])}example",
        }
        for kind, m in shapes.items():
            where = rng.choices(["yes", "no", "neutral"], [5, 3, 2])[0]
            before = rng.choice({"yes": yes, "no": no, "neutral": neutral}[where])
            after = rng.choice([" and", ".", "", " the"])
            numbers = rng.random() < (0.05 if where == "yes" else 0.35)
            if numbers:
                before += d(3) + " "
            zeros = bool(re.search(r"^\(?0{3}|-0{2}-|0{4}$", m))
            own = {"local": "(" in m or m.count("-") == 2, "ident": False, "iban": True, "address": True}[kind]
            out[kind].append((m, before, after, int(not zeros and not numbers and (where == "yes" or where == "neutral" and own))))
    return out


class Trees:
    """Gradient-boosted depth-two trees with logistic loss, and the threshold that keeps PRECISION on kept-back rows."""

    ROUNDS, RATE, PRECISION = 24, 0.4, 0.95

    def __init__(self, rows: list[tuple[list[float], int]]) -> None:
        fit, back = [r for i, r in enumerate(rows) if i % 3], rows[::3]
        y = [r[1] for r in fit]
        p = min(max(sum(y) / max(len(y), 1), 0.01), 0.99)
        self.start, self.trees = math.log(p / (1 - p)), []
        score = [self.start] * len(fit)
        for _ in range(self.ROUNDS):
            prob = [1 / (1 + math.exp(-s)) for s in score]
            tree = self.grow(fit, [a - b for a, b in zip(y, prob, strict=True)], [b * (1 - b) for b in prob], list(range(len(fit))), 2)
            self.trees.append(tree)
            score = [s + self.RATE * self.leaf(tree, x) for s, (x, _) in zip(score, fit, strict=True)]
        ranked = sorted(((self.value(x), t) for x, t in back), reverse=True)
        self.threshold, good = float("inf"), 0
        for k, (s, t) in enumerate(ranked, 1):
            good += t
            if good >= self.PRECISION * k and (k == len(ranked) or ranked[k][0] < s):
                self.threshold = s

    def grow(self, rows: list, g: list[float], h: list[float], at: list[int], depth: int):  # noqa: ANN201
        best = None
        total_g, total_h = sum(g[i] for i in at), sum(h[i] for i in at)
        if depth:
            for f in range(len(rows[0][0])):
                for cut in sorted({rows[i][0][f] for i in at})[:-1]:
                    left = [i for i in at if rows[i][0][f] <= cut]
                    gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                    gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1)
                    if best is None or gain > best[0] + 1e-12:
                        best = (gain, f, cut, left)
        if best is None or best[0] <= total_g**2 / (total_h + 1) + 1e-9:
            return total_g / (total_h + 1)
        inside = set(best[3])
        return best[1], best[2], self.grow(rows, g, h, best[3], depth - 1), self.grow(rows, g, h, [i for i in at if i not in inside], depth - 1)

    def leaf(self, tree, x: list[float]) -> float:  # noqa: ANN001
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    def value(self, x: list[float]) -> float:
        return self.start + self.RATE * sum(self.leaf(t, x) for t in self.trees)

    def column(self, features: Column) -> Column:
        names = list(FEATURES)

        def of(tree) -> Column:  # noqa: ANN001
            return F.when(features[names[tree[0]]] <= tree[1], of(tree[2])).otherwise(of(tree[3])) if isinstance(tree, tuple) else F.lit(float(tree))

        return functools.reduce(lambda a, t: a + of(t) * self.RATE, self.trees, F.lit(self.start))


@functools.cache
def trees() -> dict[str, Trees]:
    return {k: Trees([([float(f(m, b, a)) for _, f in FEATURES.values()], t) for m, b, a, t in rows]) for k, rows in examples().items()}


def candidates(text: Column, kind: str) -> Column:
    """Selected spans of one generator, as (start, kind, end, margin over the threshold)."""
    model = trees()[kind]
    none = F.array().cast("array<struct<start:int,kind:int,end:int,margin:double>>")

    def rated(x: Column) -> Column:
        end = x["start"] + F.length(x["m"])
        before = F.substring(text, F.greatest(x["start"] - CONTEXT, F.lit(0)) + 1, F.least(x["start"], F.lit(CONTEXT)))
        after = F.substring(text, end + 1, F.lit(CONTEXT))
        features = bound(F.struct(before.alias("b"), after.alias("a")), lambda c: F.struct(*(f(x["m"], c["b"], c["a"]).cast("double").alias(n) for n, (f, _) in FEATURES.items())))
        margin = bound(features, lambda f: model.column(f) - F.lit(model.threshold if math.isfinite(model.threshold) else 1e9))
        return F.struct(x["start"].alias("start"), F.lit(len(BASE) + MORE.index(kind)).alias("kind"), end.alias("end"), margin.alias("margin"))

    chosen = F.filter(F.transform(matches(text, GENERATORS[kind]), rated), lambda c: c["margin"] >= 0)
    return F.when(text.rlike(GUARDS[kind]), chosen).otherwise(none)


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans of the patterns) and spans (all), arrays of (start, kind, end), sorted."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = F.col("text")
    found = text.select("doc_id", F.array_sort(F.concat(*base_spans(t))).alias("base"), F.concat(*(candidates(t, k) for k in MORE)).alias("more"))
    overlaps = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    better = lambda a, b: (a["margin"] > b["margin"]) | ((a["margin"] == b["margin"]) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["kind"] < b["kind"]))))
    free = F.filter("more", lambda c: ~F.exists("base", lambda b: overlaps(c, b)) & ~F.exists("more", lambda o: overlaps(c, o) & better(o, c)))
    added = F.transform(free, lambda c: F.struct(c["start"], c["kind"], c["end"]).cast("struct<start:int,kind:int,end:int>"))
    return found.select("doc_id", "base", F.when(F.size("more") == 0, F.col("base")).otherwise(F.array_sort(F.concat(F.col("base"), added))).alias("spans"))


def said(found: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in (*BASE, *MORE)))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(documents(spark, sf_dir))
    of_kind = lambda k: lambda s: s["kind"] == k
    counts = (F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE))
    return found.select("doc_id", *counts, F.sha2(said(F.col("base")).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
