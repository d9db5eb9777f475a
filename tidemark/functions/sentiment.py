"""Lexicon sentiment as joins and aggregates over tokens.

A term's valence comes from a lexicon table; terms of several words are phrases. What stands
around it changes it, by rules that are data as well: an intensifier among the three tokens
before it adds its value to the valence's size, a negation there turns it around, capital
letters in a text that has others add emphasis, and where words such as *but* set one part of
a text against another, what comes before the last of them counts less and what follows more.
Exclamation marks add to the size of the record's sum s, four at most, and s becomes
s / sqrt(s * s + 15). Weights are the published ones of rule-based sentiment (Hutto and
Gilbert, 2014). Each record is scored once, however many entities it mentions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEGATED, INTENSIFIED, EMPHASIS, EXCLAIMED, MARKS = -0.74, 0.293, 0.733, 0.292, 4
BEFORE_CONTRAST, AFTER_CONTRAST = 0.5, 1.5
#: Rules and lexicon terms that go to the tasks as literals, at most; a larger lexicon is joined without a look first.
MOST_RULES, MOST_TERMS = 1000, 20_000


@dataclass(frozen=True)
class Rules:
    """Context words: negations and intensifiers with the value they give, and words that set parts of a text against each other."""

    negations: dict[str, float] = field(default_factory=lambda: dict.fromkeys(("not", "no", "never", "nicht", "pas", "sin"), NEGATED))
    intensifiers: dict[str, float] = field(default_factory=lambda: dict.fromkeys(("very", "sehr", "très", "muy"), INTENSIFIED))
    contrasts: tuple[str, ...] = ()


def rules_of(table: DataFrame) -> Rules:
    """Rules from a table (kind: negation, intensifier or contrast; term; value), which is a small one: more than MOST_RULES rows are an error."""
    rows = table.where(F.col("kind").isin("negation", "intensifier", "contrast") & F.col("term").isNotNull()).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    of = lambda kind, value: {r["term"].lower(): float(value if r["value"] is None else r["value"]) for r in rows if r["kind"] == kind}
    return Rules(of("negation", NEGATED), of("intensifier", INTENSIFIED), tuple(sorted(of("contrast", 0))))


def lexicon_of(table: DataFrame) -> DataFrame:
    """The lexicon (token, valence) among the same table's rows, of kind ``word``."""
    return table.where("kind = 'word'").select(F.lower("term").alias("token"), F.col("value").alias("valence"))


def text_choice(title: Column, body: Column) -> Column:
    """Title and body where the body has text, else the title, else null (neutral)."""
    has = lambda x: F.coalesce(F.trim(x) != "", F.lit(False))
    return F.when(has(body), F.concat(F.coalesce(title, F.lit("")), F.lit(" "), body)).when(has(title), title)


def _value(token: Column, table: dict[str, float]) -> Column:
    """The table's value of a token, 0 without one."""
    out = F.lit(0.0)
    for value in sorted(set(table.values())):
        out = F.when(token.isin(*[t for t, v in table.items() if v == value]), value).otherwise(out)
    return out


def tokens(records: DataFrame, text: Column, key: str = "id", rules: Rules | None = None, words: int = 1, begins: list[str] | None = None) -> DataFrame:
    """key, token, boost, factor: each term of ``words`` words at most, lower-cased, with what the tokens around it add and multiply by.

    Tokens are runs of letters, digits and underscores. All is looked up within the record's array, in one pass over the places where a
    term can begin (``begins``; all, if None), so that a term's row holds nothing of its neighbours."""
    rules = rules or Rules()
    x = F.coalesce(text, F.lit(""))
    parts = F.filter(F.split(x, r"[^\p{L}\p{N}_']+"), lambda t: t != "")
    rows = records.select(key, parts.alias("w"), F.rlike(x, F.lit("[a-z]")).alias("mixed")).withColumn("l", F.transform("w", F.lower))
    last = F.array_max(F.transform("l", lambda t, i: F.when(t.isin(*rules.contrasts), i).otherwise(-1))) if rules.contrasts else F.lit(-1)
    rows = rows.withColumn("last", F.coalesce(last, F.lit(-1)))

    def term(i: Column) -> Column:
        before = [F.coalesce(F.get("l", i - k), F.lit("")) for k in (1, 2, 3)]
        boost = sum((_value(t, rules.intensifiers) for t in before), F.lit(0.0))
        boost += F.when(F.col("mixed") & F.rlike(F.get("w", i), F.lit("^[A-Z]{2,}$")), EMPHASIS).otherwise(0.0)
        # of several negations the nearest counts
        factor = F.coalesce(*[F.when(t.isin(*rules.negations), _value(t, rules.negations)) for t in before], F.lit(1.0)) if rules.negations else F.lit(1.0)
        part = F.when((F.col("last") < 0) | (i == F.col("last")), 1.0).when(i < F.col("last"), BEFORE_CONTRAST).otherwise(AFTER_CONTRAST)
        terms = [F.when(i + n <= F.size("l"), F.array_join(F.slice("l", i + 1, F.lit(n)), " ")) if n > 1 else F.get("l", i) for n in range(1, words + 1)]
        return F.struct(F.array_compact(F.array(*terms)).alias("terms"), boost.alias("boost"), (factor * part).alias("factor"))

    places = F.sequence(F.lit(0), F.size("l") - 1)
    places = F.when(F.size("l") > 0, F.filter(places, lambda i: F.get("l", i).isin(*begins)) if begins is not None else places)
    found = rows.select(key, F.explode(F.transform(places, term)).alias("t"))
    return found.select(key, F.explode("t.terms").alias("token"), "t.boost", "t.factor")


def _hits(records: DataFrame, text: Column, lexicon: DataFrame, key: str, rules: Rules | None) -> DataFrame:
    """The terms that the lexicon knows, with their valence. Of a lexicon of MOST_TERMS terms at most the words that begin one are looked
    up first, so that no other token leaves its record."""
    lexicon = lexicon.select("token", "valence")
    size = F.size(F.split("token", " "))
    words, many = lexicon.agg(F.max(size), F.count("*")).first()
    begins = None
    if many <= MOST_TERMS:
        begins = sorted({r[0] for r in lexicon.select(F.substring_index("token", " ", 1)).distinct().collect() if r[0]})
    return tokens(records, text, key, rules, words or 1, begins).join(lexicon, "token")


def _of_each(records: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, polarity for each key; 0 where nothing was found."""
    return records.select(key).distinct().join(found, key, "left").withColumn("polarity", F.coalesce("polarity", F.lit(0.0)))


def lexicon_polarity(records: DataFrame, lexicon: DataFrame, text: Column, key: str = "id", rules: Rules | None = None) -> DataFrame:
    """key, polarity in [-1, 1], for each key; records without a known term get 0."""
    v = (F.col("valence") + F.signum("valence") * F.col("boost")) * F.col("factor")
    marks = F.least(F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[^!]+", "")), F.lit(MARKS))
    loud = records.groupBy(key).agg(F.max(marks).alias("marks"))
    total = _hits(records, text, lexicon, key, rules).groupBy(key).agg(F.sum(v).alias("s"))
    s = F.col("s") + F.signum("s") * EXCLAIMED * F.col("marks")
    return loud.join(total, key, "left").select(key, F.coalesce(s / F.sqrt(s * s + 15), F.lit(0.0)).alias("polarity"))


def mean_lexicon_polarity(records: DataFrame, lexicon: DataFrame, text: Column, key: str = "id", rules: Rules | None = None) -> DataFrame:
    """key, polarity for each key: the mean valence of known terms, turned around by negations and strengthened by intensifiers as
    they stand, within [-1, 1]; 0 without one."""
    v = F.greatest(F.least((F.col("valence") + F.signum("valence") * F.col("boost")) * F.col("factor"), F.lit(1.0)), F.lit(-1.0))
    return _of_each(records, _hits(records, text, lexicon, key, rules).groupBy(key).agg(F.avg(v).alias("polarity")), key)


BACKENDS = {"lexicon": lexicon_polarity, "mean": mean_lexicon_polarity}


def backend(name: str):
    """The named scorer; an unknown name gives the default with a warning."""
    if name not in BACKENDS:
        import warnings

        warnings.warn(f"unknown sentiment backend {name!r}; the lexicon backend is used", stacklevel=2)
    return BACKENDS.get(name, lexicon_polarity)


def polarity_included_only(mentions: DataFrame, records: DataFrame, lexicon: DataFrame, text: Column, name: str = "lexicon", rules: Rules | None = None) -> DataFrame:
    """mentions with polarity: a record is scored once, and only if a mention of it counts; excluded mentions get 0."""
    wanted = records.join(mentions.where(~F.col("excluded")).select("id"), "id", "left_semi")
    scores = backend(name)(wanted, lexicon, text, rules=rules)
    scored = mentions.join(scores, "id", "left")
    return scored.withColumn("polarity", F.when(F.col("excluded"), 0.0).otherwise(F.coalesce("polarity", F.lit(0.0))))
