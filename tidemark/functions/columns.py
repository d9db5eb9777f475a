"""Column functions over records: time, text, entities.

Times are UTC. A zoned timestamp follows the session's zone, so inputs are brought to
``timestamp_ntz`` holding UTC when they are loaded; all window arithmetic is on whole
epoch seconds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOMBSTONES = ("[deleted]", "[removed]")
#: $ABC: one to five capitals, no right border. ABC: two to five, between word borders.
CASHTAG, BARE = r"\$([A-Z]{1,5})", r"(?U)\b([A-Z]{2,5})\b"
KNOWN_CASHTAG = r"(?U)\$([A-Z]{2,5})\b"


def require_columns(df: DataFrame, *names: str, stage: str = "this stage") -> DataFrame:
    """The frame itself; an error that names the columns it lacks."""
    lacking = [n for n in names if n not in df.columns]
    if lacking:
        raise ValueError(f"{stage} needs columns {', '.join(lacking)}; found {', '.join(df.columns)}")
    return df


def epoch_seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts)


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts)


def day_of_week(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def clean_text(text: Column, tombstones: Sequence[str] = TOMBSTONES) -> Column:
    """Null, and a text that is a tombstone as a whole, becomes empty."""
    return F.when(text.isNull() | text.isin(*tombstones), "").otherwise(text)


def words(text: Column) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda t: t != "")


def word_count(title: Column, body: Column) -> Column:
    return F.size(words(joined_text(title, body)))


def title_length(title: Column) -> Column:
    """A count of tokens, not of characters."""
    return F.size(words(title))


def joined_text(title: Column, body: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))


def extract_entities(title: Column, body: Column, stop: Sequence[str] = ()) -> Column:
    """Distinct sorted entities: cashtags and bare capital words but for stop words."""
    text = joined_text(title, body)
    found = F.concat(F.regexp_extract_all(text, F.lit(CASHTAG), F.lit(1)), F.regexp_extract_all(text, F.lit(BARE), F.lit(1)))
    found = F.array_distinct(found)
    if stop:
        found = F.array_except(found, F.array(*[F.lit(s) for s in stop]))
    return F.array_sort(found)


def known_entities(text: Column, known: Sequence[str], false: Sequence[str] = ()) -> Column:
    """Cashtags but for false ones, and bare words of a list; sorted."""
    tags = F.regexp_extract_all(text, F.lit(KNOWN_CASHTAG), F.lit(1))
    if false:
        tags = F.array_except(tags, F.array(*[F.lit(x) for x in false]))
    bare = F.regexp_extract_all(text, F.lit(BARE), F.lit(1))
    bare = F.array_intersect(bare, F.array(*[F.lit(x) for x in known]))
    return F.array_sort(F.array_union(tags, bare))


def first_entity(text: Column, known: Sequence[str]) -> Column:
    """The first cashtag, else the first bare word of the list, else UNKNOWN."""
    tag = F.get(F.regexp_extract_all(text, F.lit(KNOWN_CASHTAG), F.lit(1)), F.lit(0))
    bare = F.get(F.filter(F.regexp_extract_all(text, F.lit(BARE), F.lit(1)), lambda x: x.isin(*known)), F.lit(0))
    return F.coalesce(tag, bare, F.lit("UNKNOWN"))


def normalise(x: Column, mu: Column, sigma: Column) -> Column:
    """z-score with stored statistics; 0 where sigma is 0."""
    return F.when(sigma == 0, F.lit(0.0)).otherwise((x - mu) / sigma)


def composite(volume: Column, sentiment: Column, stats: dict[str, Column], weight_volume: float = 0.5, weight_sentiment: float = 0.5) -> Column:
    z_v = normalise(volume, stats["mu_volume"], stats["sigma_volume"])
    z_s = normalise(sentiment, stats["mu_sentiment"], stats["sigma_sentiment"])
    return F.lit(weight_volume) * z_v + F.lit(weight_sentiment) * z_s


def apply_threshold(prob: Column, threshold: float | Column = 0.5) -> Column:
    return (prob >= threshold).cast("int")


def polarity_class(p: Column) -> Column:
    return F.when(p > 0.05, 1).when(p < -0.05, -1).otherwise(0)
