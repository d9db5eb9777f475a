"""Time windows of one entity's mentions, on whole epoch seconds.

Back: the open interval (t - day, t). Forward: (t, t + day], closed at its end. Mentions at
the same second are in neither.

Two forms give the same results. ``prefix``, the default, is one sweep: rows of one second are
summed first, time is cut into days, and each second goes to its own day and to the days whose
windows can reach it. One shuffle by entity and day brings these together, sorted; one pass
over them takes running sums and reads every window of every second off as a difference of two
of them: counts back and ahead, exclusion, sentiment ahead, acceleration, the gap to the second
before (of an empty stretch the last second is carried in). An entity is spread over its days,
and a day with those around it has a bounded number of seconds, so no task holds a hot entity.
``frame`` is a range frame, shorter for entities with few mentions; Spark walks a row's frame
for each row and keeps an entity in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.columns import require_columns

DAY = 86_400
#: Polarities are summed in units of 1 / SCALE.
SCALE = 10**9


def _range(first: int, last: int, entity: str = "entity", t: str = "t"):
    return Window.partitionBy(entity).orderBy(t).rangeBetween(first, last)


def _in_order(entity: str = "entity"):
    """Ties by id: order-dependent windows need a total order."""
    return Window.partitionBy(entity).orderBy("t", "id")


def backward_count(window: int = DAY) -> Column:
    return F.count("*").over(_range(1 - window, -1))


def forward_count(window: int = DAY) -> Column:
    return F.count("*").over(_range(1, window))


SWEPT = ("backward_count", "forward_count", "_ahead_n", "_ahead_s", "_recent", "_earlier", "_gap")


def sweep_day(t: np.ndarray, group: np.ndarray, start: np.ndarray, n: np.ndarray, s: np.ndarray, c: np.ndarray, window: int, method: str | None, min_count: int) -> dict[str, np.ndarray]:
    """Every window of seconds that come in order of group and t; ``start`` is the first second of a row's group's own day.

    n: rows of the second, s and c: sum and number of its polarities; excluded seconds count for no sentiment (``method`` None: none is)."""
    # one axis for all groups: windows reach two days back at most, and a carried second before these lies outside all of them
    key = group * (8 * window) + np.maximum(t - start, -window - 1) + 3 * window
    total = lambda x: np.concatenate([[0], np.cumsum(x)])
    upto = lambda sums, edge: sums[np.searchsorted(key, key + edge, side="right")]
    rows = total(n)
    here, before = upto(rows, 0), upto(rows, -1)
    back, ahead = before - upto(rows, -window), upto(rows, window) - here
    counts = {None: 1, "forward": ahead, "backward_only": back}[method]
    included = counts >= (0 if method is None else min_count)
    n_ahead, s_ahead = (upto(x, window) - upto(x, 0) for x in (total(np.where(included, c, 0)), total(np.where(included, s, 0))))
    half = upto(rows, -(window // 2))
    gap = np.full(len(t), -1)
    gap[1:] = np.where(group[1:] == group[:-1], t[1:] - t[:-1], -1)
    return dict(zip(SWEPT, (back, ahead, n_ahead, s_ahead, before - half, half - upto(rows, -2 * (window // 2)), gap), strict=True))


def swept(mentions: DataFrame, polarity: Column | None = None, window: int = DAY, method: str | None = None, min_count: int = 1) -> DataFrame:
    """entity, t and what one sweep finds for the second: backward_count, forward_count; _ahead_n, _ahead_s (polarities of included
    rows ahead, in units of 1 / SCALE); _recent, _earlier (rows in the half window before and in the one before that); _gap
    (seconds since the second before, -1 for the first); _first (the smallest id, where rows have one)."""
    require_columns(mentions, "entity", "t", stage="window sweep")
    if method not in (None, "forward", "backward_only"):
        raise ValueError("method is forward or backward_only")
    scaled = F.round(polarity * SCALE).cast("long") if polarity is not None else F.lit(None).cast("long")
    first = [F.min("id").alias("_first")] if "id" in mentions.columns else []
    seconds = mentions.where(F.col("entity").isNotNull() & F.col("t").isNotNull()).groupBy("entity", F.col("t").cast("long").alias("t"))
    seconds = seconds.agg(F.count("*").alias("n"), F.coalesce(F.sum(scaled), F.lit(0)).alias("s"), F.count(scaled).alias("c"), *first)
    own = F.floor(F.col("t") / window)
    # a second is read by its own day, by the two days before, which look ahead and ask whether those ahead are excluded, and by the day after
    around = seconds.withColumn("day", F.explode(F.sequence(own - 2, own + 1)))
    days = seconds.groupBy("entity", own.alias("day")).agg(F.max("t").alias("t"))
    carried = days.select("entity", "day", F.lag("t").over(Window.partitionBy("entity").orderBy("day")).alias("t")).where("t is not null")
    rows = around.unionByName(carried.withColumns({c: F.lit(0).cast("long") for c in "nsc"}), allowMissingColumns=True)
    rows = rows.repartition("entity", "day").sortWithinPartitions("entity", "day", "t")
    kinds = {f.name: f for f in rows.schema}
    schema = StructType([kinds["entity"], kinds["t"]]).add("backward_count", "long")
    for c in SWEPT[1:]:
        schema = schema.add(c, "long")
    if first:
        schema = schema.add(kinds["_first"])
    arrow, names = to_arrow_schema(schema), rows.columns

    def whole_days(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Tables that no entity's day is cut by."""
        held: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            group = _groups(table)
            last = int(np.searchsorted(group, group[-1])) if len(group) else 0
            if last:
                yield pa.concat_tables([*held, table.slice(0, last)])
                held = []
            held.append(table.slice(last))
        if held:
            yield pa.concat_tables(held)

    def _groups(table: pa.Table) -> np.ndarray:
        entity, day = table["entity"].combine_chunks().dictionary_encode(), table["day"].to_numpy()
        codes = (entity.combine_chunks() if isinstance(entity, pa.ChunkedArray) else entity).indices.to_numpy()
        new = np.ones(len(codes), bool)
        new[1:] = (codes[1:] != codes[:-1]) | (day[1:] != day[:-1])
        return np.cumsum(new) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_days(batches):
            if not table.num_rows:
                continue
            t, day, n = (table[c].to_numpy() for c in ("t", "day", "n"))
            found = sweep_day(t, _groups(table), day * window, n, table["s"].to_numpy(), table["c"].to_numpy(), window, method, min_count)
            keep = np.flatnonzero((n > 0) & (t // window == day))
            out = table.take(keep).combine_chunks()
            columns = {c: out[c] for c in names} | {c: pa.chunked_array([pa.array(found[c][keep], pa.int64())]) for c in SWEPT}
            yield from pa.table([columns[f.name] for f in arrow], schema=arrow).to_batches()

    return rows.mapInArrow(run, schema)


def _with(mentions: DataFrame, found: DataFrame) -> DataFrame:
    # one row for each second, which this says: so Spark leaves the join out where a later step asks for none of its columns
    return mentions.join(found.dropDuplicates(["entity", "t"]), ["entity", "t"], "left")


def _form(form: str) -> str:
    if form not in ("frame", "prefix"):
        raise ValueError("form is frame or prefix")
    return form


def window_counts(mentions: DataFrame, window: int = DAY, form: str = "prefix") -> DataFrame:
    """Adds backward_count and forward_count."""
    require_columns(mentions, "entity", "t", stage="window counts")
    if _form(form) == "frame":
        return mentions.withColumns({"backward_count": backward_count(window), "forward_count": forward_count(window)})
    return _with(mentions, swept(mentions, window=window).select("entity", "t", "backward_count", "forward_count"))


def volume_growth(forward: Column, backward: Column) -> Column:
    return forward / F.greatest(backward, F.lit(1)) - 1


def _with_prior(counted: DataFrame, day: int = DAY) -> DataFrame:
    """Adds _prior: the mean backward_count of the entity's rows before this one, in order of time and id.

    Sums before a second come from its day and from the totals of the days before; within a second all counts are the same."""
    seconds = counted.groupBy("entity", "t").agg(F.count("*").alias("_n"), F.sum("backward_count").alias("_s")).withColumn("_day", F.floor(F.col("t") / day))
    lower = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = seconds.groupBy("entity", "_day").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    of_days, within = Window.partitionBy("entity").orderBy("_day"), Window.partitionBy("entity", "_day").orderBy("t")
    days = days.select("entity", "_day", lower("_n", of_days).alias("_n_days"), lower("_s", of_days).alias("_s_days"))
    seconds = seconds.select("entity", "t", "_day", lower("_n", within).alias("_n"), lower("_s", within).alias("_s")).join(days, ["entity", "_day"])
    seconds = seconds.select("entity", "t", (F.col("_n") + F.col("_n_days")).alias("_n"), (F.col("_s") + F.col("_s_days")).alias("_s"))
    place = F.row_number().over(Window.partitionBy("entity", "t").orderBy("id")) - 1
    n, s = F.col("_n") + F.col("_place"), F.col("_s") + F.col("_place") * F.col("backward_count")
    return counted.withColumn("_place", place).join(seconds, ["entity", "t"]).withColumn("_prior", F.when(n > 0, s / n)).drop("_n", "_s", "_place")


def with_growth(counted: DataFrame, method: str = "forward", min_count: int = 1, form: str = "prefix") -> DataFrame:
    """Adds posting_volume_growth and excluded, by forward counts or by past rows only (``backward_only``)."""
    if method == "backward_only":
        if form == "frame":
            counted = counted.withColumn("_prior", F.avg("backward_count").over(_in_order().rowsBetween(Window.unboundedPreceding, -1)))
        else:
            counted = _with_prior(counted)
        prior = F.col("_prior")
        ratio = F.col("backward_count") / F.greatest(prior, F.lit(1.0)) - 1
        grown = counted.withColumns({"posting_volume_growth": F.when(prior.isNull(), 0.0).otherwise(ratio), "excluded": F.col("backward_count") < min_count})
        return grown.drop("_prior")
    if method != "forward":
        raise ValueError("method is forward or backward_only")
    return counted.withColumns({"posting_volume_growth": volume_growth(F.col("forward_count"), F.col("backward_count")), "excluded": F.col("forward_count") < min_count})


def windowed(mentions: DataFrame, method: str = "forward", min_count: int = 1, form: str = "prefix") -> DataFrame:
    return with_growth(window_counts(mentions, form=form), method, min_count, form)


def _with_own_sentiment(df: DataFrame) -> DataFrame:
    require_columns(df, "polarity", "excluded", stage="future sentiment")
    return df.withColumn("sentiment_polarity", F.when(F.col("excluded"), 0.0).otherwise(F.col("polarity")))


def _with_change(df: DataFrame, ahead: Column) -> DataFrame:
    mean = F.when(F.col("excluded"), F.col("sentiment_polarity")).otherwise(F.coalesce(ahead, "sentiment_polarity"))
    df = df.withColumn("mean_future_sentiment", mean)
    return df.withColumn("sentiment_change", F.abs(F.col("mean_future_sentiment") - F.col("sentiment_polarity")))


def with_future_sentiment(df: DataFrame, window: int = DAY, form: str = "prefix") -> DataFrame:
    """Adds mean_future_sentiment (over included mentions ahead; else the row's own) and sentiment_change; excluded rows count 0."""
    df = _with_own_sentiment(df)
    counts = F.when(~F.col("excluded"), F.col("sentiment_polarity"))
    if _form(form) == "frame":
        return _with_change(df, F.avg(counts).over(_range(1, window)))
    found = swept(df, counts, window).select("entity", "t", "_ahead_n", "_ahead_s")
    return _with_change(_with(df, found), _mean_ahead()).drop("_ahead_n", "_ahead_s")


def _mean_ahead() -> Column:
    return F.when(F.col("_ahead_n") > 0, F.col("_ahead_s") / F.col("_ahead_n") / SCALE)


def _gap_of_row() -> Column:
    """Hours since the row before: rows of one second come in order of id, the first of them after the second before."""
    hours = F.when(F.col("_gap") < 0, -1.0).otherwise(F.col("_gap") / 3600)
    return F.when(F.col("id") == F.col("_first"), hours).otherwise(0.0)


def _acceleration() -> Column:
    return F.col("_recent") / F.greatest("_earlier", F.lit(1))


def all_windows(mentions: DataFrame, method: str = "forward", min_count: int = 1) -> DataFrame:
    """mentions (id, entity, t, polarity) with everything that windows give, by one sweep and one join: counts, growth, exclusion,
    sentiment ahead and its change, time_since_previous and acceleration_12h."""
    require_columns(mentions, "id", "entity", "t", "polarity", stage="windows")
    df = with_growth(_with(mentions, swept(mentions, F.col("polarity"), DAY, method, min_count)), method, min_count)
    df = _with_change(_with_own_sentiment(df), _mean_ahead())
    df = df.withColumns({"time_since_previous": _gap_of_row(), "acceleration_12h": _acceleration()})
    return df.drop("_first", *[c for c in SWEPT if c.startswith("_")])


def time_since_previous() -> Column:
    """Hours; -1 for an entity's first row, 0 for a tie. A window over the entity."""
    return F.coalesce((F.col("t") - F.lag("t").over(_in_order())) / 3600, F.lit(-1.0))


def with_gaps(mentions: DataFrame) -> DataFrame:
    """Adds time_since_previous, without a window over the whole entity."""
    found = swept(mentions).select("entity", "t", "_gap", "_first")
    return _with(mentions, found).withColumn("time_since_previous", _gap_of_row()).drop("_gap", "_first")


def with_acceleration(mentions: DataFrame, window: int = DAY // 2) -> DataFrame:
    """Adds acceleration_12h: mentions in (t - w, t) over those in (t - 2w, t - w], at least 1."""
    found = swept(mentions, window=2 * window).select("entity", "t", "_recent", "_earlier")
    return _with(mentions, found).withColumn("acceleration_12h", _acceleration()).drop("_recent", "_earlier")


def acceleration(window: int = DAY // 2) -> Column:
    """Mentions in (t - w, t) over those in (t - 2w, t - w], at least 1."""
    recent = F.count("*").over(_range(1 - window, -1))
    earlier = F.count("*").over(_range(1 - 2 * window, -window))
    return recent / F.greatest(earlier, F.lit(1))
