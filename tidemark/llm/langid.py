"""Language of texts: the family first, then one-versus-one linear machines within it.

A text is described by hashed letter groups (one to three letters of lower-cased words,
with word borders), as square roots of their shares. Linear support vector machines, one
for each two families, vote for the family; those for each two languages of that family
vote for the language. Margins break ties and give the score through a logistic curve.

Training texts are a bounded sample: about ``per_language`` different texts of each language,
chosen by a hash of the text, however often a text is repeated. Each machine is fitted in a
task of its own on the sample's rows of its two classes. Prediction reads whole texts and
nothing but the text.

Defined results: null text, or one without a letter (Unicode category L), is ``und`` with
score 0; a language without a family in FAMILIES is a family of its own; with one learned
language everything with a letter gets it (score 1), with none it is ``und``; texts of any
length are read whole; repeated rows give the same row again; an empty table gives an empty
table; ``predict`` keeps further columns, but replaces columns named like its own two.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh

#: Families of languages by ISO 639-1 code; a parameter's default.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "baltic": ("lt", "lv"),
    "turkic": ("tr", "az", "kk", "uz"),
}
BUCKETS = 4096
LETTER = regex.compile(r"\p{L}")
_DROP = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+")


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte groups within words; zeros without a letter."""
    out = np.zeros(BUCKETS)
    data = _DROP.sub(b" ", b" " + text.lower().encode("utf-8", "replace") + b" ")
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return out
    one, two, three = b[1:-1], b[1:-1] * 256 + b[:-2], b[2:] * 65536 + b[1:-1] * 256 + b[:-2]
    inside = one != 32
    for salt, gram in ((1, one), (2, two), (3, three)):
        h = (gram[inside] + np.uint32(salt << 25)) * np.uint32(2654435761)
        out += np.bincount(h >> np.uint32(20), minlength=BUCKETS)
    total = out.sum()
    return np.sqrt(out / total) if total else out


class Model:
    """Linear machines for pairs of classes: (first, second) -> (weights, intercept); positive means second."""

    def __init__(self, families: dict[str, list[str]], machines: dict[tuple[str, str], tuple[np.ndarray, float]]):
        self.families, self.machines = families, machines
        self._pairs = list(machines)
        self._weights = np.array([machines[p][0] for p in self._pairs]).reshape(len(self._pairs), BUCKETS)
        self._bias = np.array([machines[p][1] for p in self._pairs])

    def _vote(self, classes: list[str], margin: dict[tuple[str, str], float]) -> tuple[str, float]:
        votes = dict.fromkeys(classes, 0.0)
        for a, b in combinations(classes, 2):
            m = margin[a, b]
            votes[b if m > 0 else a] += 1 + min(abs(m), 9) / 1000
        best = max(classes, key=lambda c: (votes[c], c))
        sure = [math.exp(-np.logaddexp(0, -2 * (m if b == best else -m))) for (a, b), m in margin.items() if best in (a, b) and {a, b} <= set(classes)]
        return best, min(sure, default=1.0)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        known = [k for k, x in enumerate(texts) if x and LETTER.search(x)] if self.families else []
        out = [("und", 0.0)] * len(texts)
        if known:
            margins = np.array([self._weights @ features(texts[k]) for k in known]).reshape(len(known), -1) + self._bias
            for k, row in zip(known, margins.tolist(), strict=True):
                margin = dict(zip(self._pairs, row, strict=True))
                family, s = self._vote(sorted(self.families), margin)
                lang, t = self._vote(self.families[family], margin)
                out[k] = (lang, s * t)
        return out


def _feature_column(text: Column) -> Column:
    """Places and values of the features that are not zero."""

    @F.pandas_udf("at array<int>, value array<float>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            found = [features(x) for x in batch]
            at = [np.flatnonzero(x) for x in found]
            yield pd.DataFrame({"at": at, "value": [x[k].astype(np.float32) for x, k in zip(found, at, strict=True)]})

    return of(text)


def support_vector_machine(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and intercept of a linear machine with squared hinge loss; y is -1 or 1.

    Dual coordinate descent (Hsieh and others, 2008), each class having the same weight in all."""
    cost = c * len(y) / (2 * np.where(y > 0, max((y > 0).sum(), 1), max((y < 0).sum(), 1)))
    wide = np.hstack([x, np.ones((len(x), 1))])
    norm = np.einsum("ij,ij->i", wide, wide) + 1 / (2 * cost)
    alpha, w = np.zeros(len(y)), np.zeros(wide.shape[1])
    order = np.random.default_rng(3)
    for _ in range(rounds):
        for i in order.permutation(len(y)):
            slope = y[i] * (w @ wide[i]) - 1 + alpha[i] / (2 * cost[i])
            new = max(alpha[i] - slope / norm[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * wide[i]
                alpha[i] = new
    return w[:-1], float(w[-1])


def sampled(labelled: DataFrame, text: str, lang: str, per_language: int, most: int) -> tuple[list[str], DataFrame]:
    """The languages, and about ``per_language`` different texts (lang, text, h) of each."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).limit(most + 1).collect()
    if len(counts) > most:
        raise ValueError(f"more than {most} languages")
    shares = labelled.sparkSession.createDataFrame([(r["lang"], per_language / r["n"]) for r in counts], "lang string, share double")
    chosen = rows.join(F.broadcast(shares), "lang").where(F.pmod("h", F.lit(1 << 30)) / (1 << 30) < F.col("share"))
    return sorted(r["lang"] for r in counts), chosen.dropDuplicates(["lang", "h"]).drop("share")


def fit(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    per_language: int = 400,
    families: dict[str, tuple[str, ...]] = FAMILIES,
    most_machines: int = 2000,
) -> Model:
    """Train on about ``per_language`` texts of each language (all, where there are fewer).

    There is a machine, of 32 KB, for each two families and for each two languages of a family (a language of no known family
    is one of its own). The model goes to every task, so more than ``most_machines`` are an error; give more ``families`` then."""
    # n languages take n - 1 machines at least
    languages, sample = sampled(labelled, text, lang, per_language, most_machines + 1)
    family_of = {k: name for name, own in families.items() for k in own}
    groups: dict[str, list[str]] = {}
    for k in languages:
        groups.setdefault(family_of.get(k, k), []).append(k)
    pairs = [(a, b) for own in (sorted(groups), *groups.values()) for a, b in combinations(own, 2)]
    if len(pairs) > most_machines:
        raise ValueError(f"{len(pairs)} machines for {len(languages)} languages, of {most_machines} allowed: name their families")
    if not pairs:
        return Model(groups, {})
    pair_no = {p: k for k, p in enumerate(pairs)}
    named = {k: name for name, own in groups.items() for k in own}
    # the machines that a language's rows train, and on which side
    trains = {k: [(pair_no[p], 1 if own == p[1] else -1) for own in {k, named[k]} for p in pairs if own in p] for k in named}
    trains = labelled.sparkSession.createDataFrame(list(trains.items()), "lang string, trains array<struct<pair:int,side:int>>")
    sample = sample.withColumn("f", _feature_column(F.col("text"))).join(F.broadcast(trains), "lang").select("h", "f.*", F.explode("trains").alias("t"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "side"])
        x = np.zeros((len(pdf), BUCKETS))
        for row, at, value in zip(x, pdf["at"], pdf["value"], strict=True):
            row[at] = value
        w, bias = support_vector_machine(x, pdf["side"].to_numpy().astype(float))
        return pd.DataFrame({"pair": [pdf["pair"].iloc[0]], "weights": [w.tobytes()], "bias": [bias]})

    each = sample.select("h", "at", "value", "t.pair", "t.side")
    fitted = {r["pair"]: (np.frombuffer(r["weights"]), r["bias"]) for r in each.groupBy("pair").applyInPandas(one, "pair int, weights binary, bias double").collect()}
    # a pair of which the sample has no row says no more than that it is undecided
    return Model(groups, {p: fitted.get(k, (np.zeros(BUCKETS), -1.0)) for p, k in pair_no.items()})


def language_of(text: Column, model: Model) -> Column:
    """A struct of lang_pred and score."""

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame(model.predict(batch.tolist()), columns=["lang_pred", "score"])

    return of(text.cast("string"))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred and score."""
    own = fresh(docs, "lang")
    said = docs.withColumn(own, language_of(F.col(text), model))
    return said.withColumns({"lang_pred": F.col(own)["lang_pred"], "score": F.col(own)["score"]}).drop(own)


def held_out(key: Column) -> Column:
    """Rows kept from training: crc32 of the key's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))
