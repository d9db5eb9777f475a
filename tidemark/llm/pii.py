"""Personal data in texts: patterns with checks, and boosted trees over wider candidates.

Base spans come from four patterns, each with its own check. Wider generators propose
further spans, which may overlap: addresses whose signs are spelled out, network addresses
with bracketed or spaced dots, and digit groups with any usual separators. Boosted trees score
these by format and context (never by the checks themselves); thresholds, one for each kind,
calibrated on candidates that the trees did not see keep those of the wanted precision. Base
spans always stay; a candidate that overlaps one adds nothing.

The trees learn on the candidates of all different texts, each text once, however often it is
repeated: copies of a candidate are told by 128 bits of its text's hash and its place, so that no
text is shuffled. Positives are base spans rewritten into forms that only the wide
generators find: signs spelled out, no plus, other separators. Negatives are candidates that
overlap no base span, but for those that may be such forms themselves (``_disputed``, and
digit groups of a rewritten span's very format): these are left out, however frequent they
are. Without both classes, or if no threshold reaches the precision, nothing is added. The
precision is that among held-out rewritten spans and negatives, not one of natural forms.

All of it is DataFrame expressions over one row at a time, so no text is shuffled and a
text is never cut: trees become CASE expressions over the row's candidates.

Patterns: each is written so that Java's matcher neither recurses nor scans a run twice. A
run can only be entered at its first character or right behind the last match, which is
where the leftmost match begins, and possessive repeats give the longest one.

Defined results: null text counts as empty; rows without spans give zero counts, the hash
of the empty string and an empty ``spans``; ties cannot occur within a kind and are listed
by kind, start, end; repeated rows give the same row again; an empty table gives an empty
table; further columns pass through ``find`` and ``redact`` untouched, whatever their names
(``find`` replaces columns named like its own two).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: Kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]++(?<=[0-9])|\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character without which a kind cannot occur.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
WIDE_EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?(?:@|[(\[] ?at ?[)\]]) ?[A-Za-z0-9-]++"
    r"(?: ?(?:\.|[(\[] ?dot ?[)\]]) ?[A-Za-z0-9-]++)++"
)
WIDE_IP = r"(?:\G|(?<![0-9.]))[0-9]{1,3}+(?: ?(?:\.|[(\[] ?(?:\.|dot) ?[)\]]) ?[0-9]{1,3}+){3}(?![0-9])"
WIDE_DIGITS = r"(?:\G|(?<![0-9]))[0-9](?:[\x20().-]{0,2}[0-9]){6,}+"
FEATURES = (
    "length", "digits", "separators", "groups", "dots", "blanks", "signs", "longest",
    "letter_before", "letter_after", "blank_before", "blank_after", "contact_before", "money_before",
)
#: Hits whose positions are summed together.
BLOCK = 256
Span = "struct<s:bigint,e:bigint,m:string>"


def _spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of a pattern, in code points, end exclusive."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"))
    size = F.size(hits)

    def block(b: Column) -> Column:
        return F.slice(steps, b * BLOCK + 1, F.least(F.lit(BLOCK), size - b * BLOCK))

    def within(b: Column, offset: Column) -> Column:
        start = F.struct(offset.alias("at"), F.array().cast(f"array<{Span}>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + F.char_length(x["gap"])
            end = begin + F.char_length(x["hit"])
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("s"), end.alias("e"), x["hit"].alias("m")))).alias("out"))

        return F.aggregate(block(b), start, step)["out"]

    def length(b: Column) -> Column:
        return F.aggregate(block(b), F.lit(0).cast("bigint"), lambda n, x: n + F.char_length(x["gap"]) + F.char_length(x["hit"]))

    # positions are running sums, taken over blocks of hits so that no long array is copied at each step
    offsets = F.aggregate(
        F.sequence(F.lit(0), F.floor((size - 1) / BLOCK).cast("int")),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<b:int,at:bigint>>").alias("out")),
        lambda acc, b: F.struct((acc["at"] + length(b)).alias("at"), F.concat(acc["out"], F.array(F.struct(b.alias("b"), acc["at"].alias("at")))).alias("out")),
    )["out"]
    return F.when(size > 0, F.flatten(F.transform(offsets, lambda o: within(o["b"], o["at"])))).otherwise(F.array().cast(f"array<{Span}>"))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a short string of digits passes the Luhn check."""

    def add(total: Column, k: Column) -> Column:
        d = F.substring(digits, -k, F.lit(1)).cast("int") * F.when(k % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        # leading zeros aside, three digits at most, so the cast cannot overflow
        return F.forall(
            F.split(match, "\\."),
            lambda p: F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255).otherwise(False),
        )
    if kind == "card":
        d = _digits(match)
        return F.when(F.length(match) > 40, False).when(F.length(d).between(16, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def _is_valid(kind: str):
    return lambda s: _valid(kind, s["m"])


def _is(kind: str):
    return lambda s: s["k"] == kind


def base_spans(docs: DataFrame, text: str) -> DataFrame:
    """Adds _email, _ip, _card, _phone: arrays of valid base spans."""
    x = F.coalesce(F.col(text).cast("string"), F.lit(""))
    none = F.array().cast(f"array<{Span}>")
    docs = docs.withColumns({f"_{k}": F.when(F.contains(x, F.lit(NEEDS[k])), _spans(x, BASE[k])).otherwise(none) if k in NEEDS else _spans(x, BASE[k]) for k in KINDS})
    return docs.withColumns({f"_{k}": F.filter(f"_{k}", _is_valid(k)) for k in KINDS if k != "email"})


def _around(x: Column, kind: str | None = None):
    """Turns a span of text ``x`` into a candidate with its kind and context."""

    def full(s: Column) -> Column:
        n = F.length(_digits(s["m"]))
        return F.struct(
            s["s"].alias("s"),
            s["e"].alias("e"),
            s["m"].alias("m"),
            (F.lit(kind) if kind else F.when(n > 15, "card").otherwise("phone")).alias("k"),
            F.substring(x, F.greatest(s["s"] - 23, F.lit(1)).cast("int"), F.least(s["s"], F.lit(24)).cast("int")).alias("before"),
            F.substring(x, (s["e"] + 1).cast("int"), F.lit(1)).alias("after"),
        )

    return full


def wide_candidates(docs: DataFrame, text: str) -> DataFrame:
    """Adds _wide: generated spans (s, e, m, k) with up to 24 characters of context (before, after)."""
    x = F.coalesce(F.col(text).cast("string"), F.lit(""))
    none = F.array().cast(f"array<{Span}>")
    mails = F.when(F.contains(x, F.lit("@")) | F.contains(x, F.lit("at)")) | F.contains(x, F.lit("at]")), _spans(x, WIDE_EMAIL)).otherwise(none)
    ips = F.when(F.contains(x, F.lit(".")) | F.contains(x, F.lit("dot")), _spans(x, WIDE_IP)).otherwise(none)
    docs = docs.withColumns({"_mails": mails, "_ips": ips, "_numbers": _spans(x, WIDE_DIGITS)})

    wide = F.concat(F.transform("_mails", _around(x, "email")), F.transform("_ips", _around(x, "ip")), F.transform("_numbers", _around(x)))
    return docs.withColumn("_wide", wide).drop("_mails", "_ips", "_numbers")


def _features(c: Column) -> dict[str, Column]:
    m, before = c["m"], F.lower(c["before"])
    count = lambda pattern: F.size(F.regexp_extract_all(m, F.lit(pattern), F.lit(0)))
    flag = lambda x, pattern: F.coalesce(x.rlike(pattern), F.lit(False)).cast("double")
    return {
        "length": F.char_length(m),
        "digits": F.length(_digits(m)),
        "separators": count("[^A-Za-z0-9]"),
        "groups": count("[A-Za-z0-9]+"),
        "dots": count(r"\."),
        "blanks": count(" "),
        "signs": count("[@+()]"),
        "longest": F.array_max(F.transform(F.regexp_extract_all(m, F.lit("[0-9]+|[A-Za-z]+"), F.lit(0)), F.char_length)),
        "letter_before": flag(before, r"[a-z]$"),
        "letter_after": flag(c["after"], r"^[A-Za-z]"),
        "blank_before": flag(before, r"(^|\s)$"),
        "blank_after": flag(c["after"], r"^(\s|$)"),
        "contact_before": flag(before, r"(mail|tel|phone|call|fax|mobile|card|contact|reach|ip|host|address)[a-z]*\W{0,4}$"),
        "money_before": flag(before, r"[$€£%#]\s?$"),
    }


def _covers(c: Column) -> Column:
    return reduce(
        lambda a, b: a | b,
        (F.exists(f"_{k}", lambda s: (s["s"] < c["e"]) & (c["s"] < s["e"])) for k in KINDS),
    )


def _rewritten(kind: str, m: Column) -> Column:
    """A base span in one of the forms that only the wide generators find, chosen by its hash."""
    digits = _digits(m)
    if kind == "email":
        name, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
        signs = ((" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."))
        forms = [F.concat(name, F.lit(at), F.replace(host, F.lit("."), F.lit(dot))) for at, dot in signs]
    elif kind == "ip":
        forms = [F.replace(m, F.lit("."), F.lit(x)) for x in ("[.]", "(.)", "[dot]", " . ")]
    elif kind == "phone":
        plain = F.ltrim(m, F.lit("+"))
        forms = [plain, *(F.regexp_replace(plain, "[^0-9]+", x) for x in ("-", ".", " ")), digits]
    else:
        forms = [F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", x) for x in ("$1.", "$1--", "$1 - ", "$1. ")]
    return F.element_at(F.array(*forms), (F.pmod(F.xxhash64(m), F.lit(len(forms))) + 1).cast("int"))


def _positives(x: Column) -> Column:
    """Candidates made of the row's base spans, with ``h``, the hash of the span as it stands."""

    def of(kind: str, wide: str) -> Column:
        own = F.transform(f"_{kind}", lambda s: F.struct(_around(x, kind)(s).alias("c"), _rewritten(kind, s["m"]).alias("m"), F.xxhash64(s["m"]).alias("h")))
        own = F.filter(own, lambda r: F.rlike(r["m"], F.lit(rf"^(?:{wide})$")))
        return F.transform(own, lambda r: F.struct(r["c"]["k"].alias("k"), r["m"].alias("m"), r["c"]["before"].alias("before"), r["c"]["after"].alias("after"), r["h"].alias("h")))

    return F.concat(of("email", WIDE_EMAIL), of("ip", WIDE_IP), of("card", WIDE_DIGITS), of("phone", WIDE_DIGITS))


def _disputed(c: Column) -> Column:
    """Whether a candidate without a base span may well be personal data, so that it is no example of either class."""
    d = _digits(c["m"])
    n = F.length(d)
    spelled = c["m"].rlike(r"[(\[] ?at ?[)\]]") & c["m"].rlike("[A-Za-z]{2,}$")
    phone = n.between(8, 15) & (_features(c)["contact_before"] > 0)
    dotted = F.forall(F.regexp_extract_all(c["m"], F.lit("[0-9]+"), F.lit(0)), lambda p: p.cast("int") <= 255)
    return F.when(c["k"] == "email", spelled).when(c["k"] == "ip", dotted).otherwise(phone | F.when(n.between(16, 19), luhn(d)).otherwise(False))


def _tree(lines: list[str], c: dict[str, Column], at: int = 0) -> tuple[Column, int]:
    """A tree of the model's printed form as a CASE expression; the next line to read."""
    if m := re.match(r"\s*Predict: (\S+)", lines[at]):
        return F.lit(float(m[1])), at + 1
    feature, limit = re.match(r"\s*If \(feature (\d+) <= (\S+)\)", lines[at]).groups()
    low, at = _tree(lines, c, at + 1)
    high, at = _tree(lines, c, at + 1)  # the line in between is the Else
    return F.when(c[FEATURES[int(feature)]].cast("double") <= float(limit), low).otherwise(high), at


class Scorer:
    """Boosted trees as expressions, and for each kind the calibrated margin from which a candidate is kept."""

    def __init__(self, trees: list[str], weights: list[float], leasts: dict[str, float]):
        self.trees, self.weights, self.leasts = trees, weights, leasts

    @property
    def least(self) -> float:
        """The lowest of the kinds' margins."""
        return min(self.leasts.values(), default=float("inf"))

    def margin(self, features: dict[str, Column]) -> Column:
        own = [F.lit(w) * _tree([x for x in t.splitlines()[1:] if x.strip()], features)[0] for t, w in zip(self.trees, self.weights, strict=True)]
        return reduce(lambda a, b: a + b, own)

    def keeps(self, c: Column) -> Column:
        margin, out = self.margin(_features(c)), F.lit(False)
        for kind, least in self.leasts.items():
            out = F.when(c["k"] == kind, margin >= least).otherwise(out)
        return out


def fit(
    docs: DataFrame,
    text: str = "text",
    trees: int = 12,
    depth: int = 3,
    precision: float = 0.99,
    least_class: int = 20,
    pool: int = 50,
) -> Scorer | None:
    """Train on the candidates of all different texts; None when nothing can be added."""
    rows = docs.select(F.col(text).cast("string").alias(text)).where(F.col(text).isNotNull())
    # hashed before anything is exploded, so that a candidate carries no text
    rows = rows.withColumns({"_hash": F.xxhash64(text), "_more": F.xxhash64(F.lit(1), text)})
    found = wide_candidates(base_spans(rows, text), text)
    x = F.coalesce(F.col(text).cast("string"), F.lit(""))

    def example(label: float):
        form = lambda c: F.regexp_replace(c["m"], "[0-9]", "9").alias("form")
        return lambda c: F.struct(*[v.cast("double").alias(k) for k, v in _features(c).items()], F.lit(label).alias("label"), c["k"].alias("kind"), c["h"].alias("h"), form(c))

    others = F.filter(F.filter("_wide", lambda c: ~_covers(c)), lambda c: ~_disputed(c))
    others = F.transform(others, lambda c: F.struct(c["k"].alias("k"), c["m"].alias("m"), c["before"].alias("before"), c["after"].alias("after"), F.xxhash64(c["m"]).alias("h")))
    found = found.select("_hash", "_more", F.posexplode(F.concat(F.transform(_positives(x), example(1.0)), F.transform(others, example(0.0)))).alias("_place", "c"))
    data = materialize(found.dropDuplicates(["_hash", "_more", "_place"]).select("c.*"))
    forms = data.where("label = 1 AND groups >= 3").select("form", F.lit(0.0).alias("label")).distinct()
    data = data.join(forms, ["form", "label"], "left_anti").drop("form")
    if data.groupBy("label").count().where(F.col("count") >= least_class).count() < 2:
        return None
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(data)
    held_out = F.pmod("h", F.lit(4)) == 0
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7).fit(data.where(~held_out))
    scorer = Scorer([t.toDebugString for t in model.trees], list(model.treeWeights), {})
    # calibration on the held-out part, kind by kind: from the highest margin down (in steps of 0.01),
    # pools of `pool` candidates at least; the first pool below the precision ends it
    margin = F.round(scorer.margin({k: F.col(k) for k in FEATURES}), 2).alias("margin")
    steps = data.where(held_out).groupBy("kind", margin).agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect()
    for kind in KINDS:
        own = sorted((r for r in steps if r["kind"] == kind), key=lambda r: -r["margin"])
        good = n = 0
        for step, below in zip(own, [*own[1:], None], strict=False):
            good, n = good + step["good"], n + step["n"]
            if n >= pool:
                if good / n < precision:
                    break
                # halfway to the next margin seen, so that candidates between the two go with the nearer one
                scorer.leasts[kind] = (step["margin"] + (below or step)["margin"]) / 2
                good = n = 0
    return scorer if scorer.leasts else None


def _found(docs: DataFrame, scorer: Scorer | None, text: str) -> DataFrame:
    """_row (all columns of ``docs``), _base and _all: arrays of (o, k, s, e), o being the kind's place in KINDS."""
    docs = base_spans(docs.select(F.struct("*").alias("_row"), F.col(text).cast("string").alias("_text")), "_text")

    def named(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(F.lit(KINDS.index(kind)).alias("o"), F.lit(kind).alias("k"), s["s"].alias("s"), s["e"].alias("e")))

    docs = docs.withColumn("_base", F.concat(*[named(k, F.col(f"_{k}")) for k in KINDS]))
    if scorer is None:
        return docs.select("_row", "_text", "_base", F.col("_base").alias("_all"))
    docs = wide_candidates(docs, "_text")
    plain = F.lit(rf"^(?:{BASE['email']})$")
    more = F.filter(F.filter("_wide", lambda c: (c["k"] != "email") | ~F.rlike(c["m"], plain)), lambda c: ~_covers(c))
    more = F.filter(more, scorer.keeps)
    place = F.create_map(*[F.lit(y) for k, kind in enumerate(KINDS) for y in (kind, k)])
    more = F.transform(more, lambda c: F.struct(place[c["k"]].alias("o"), c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e")))
    return docs.select("_row", "_text", "_base", F.array_sort(F.concat("_base", more)).alias("_all"))


def _columns(docs: DataFrame, without: tuple[str, ...] = ()) -> list[Column]:
    return [F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() not in without]


def find(docs: DataFrame, scorer: Scorer | None, text: str = "text") -> DataFrame:
    """Adds base_spans and spans: arrays of (o, k, s, e), o being the kind's place in KINDS."""
    found = _found(docs, scorer, text)
    return found.select(*_columns(docs, ("base_spans", "spans")), F.col("_base").alias("base_spans"), F.col("_all").alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["k"], s["s"].cast("string"), s["e"].cast("string"))), ",")


def report(docs: DataFrame, scorer: Scorer | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans."""
    found = _found(docs.select(key, text), scorer, text)
    counts = [F.size(F.filter("_base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    said = [F.sha2(listed(F.col("_base")), 256).alias("base_sha256"), listed(F.col("_all")).alias("spans"), F.size("_all").cast("long").alias("n_spans")]
    return found.select(F.col("_row").getField(key).alias(key), *counts, *said)


def redact(docs: DataFrame, scorer: Scorer | None, text: str = "text") -> DataFrame:
    """Replaces each stretch covered by spans with the first span's kind in angle brackets."""
    found = _found(docs, scorer, text)
    x = F.col("_text")
    by_start = F.array_sort(F.transform("_all", lambda s: F.struct(s["s"].alias("s"), s["e"].alias("e"), s["k"].alias("k"))))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(x, (acc["at"] + 1).cast("int"), F.greatest(s["s"] - acc["at"], F.lit(0)).cast("int"))
        mark = F.when(s["s"] >= acc["at"], F.concat(F.lit("<"), F.upper(s["k"]), F.lit(">"))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["e"]).alias("at"), F.concat(acc["out"], F.array(F.concat(gap, mark))).alias("out"))

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(x, (acc["at"] + 1).cast("int"), F.char_length(x)))
    done = F.when(F.size("_all") > 0, F.aggregate(by_start, start, step, rest)).otherwise(x)
    return found.select(*[done.alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns])
