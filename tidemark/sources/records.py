"""Loading and saving records, mentions and run records."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, StructType

from ..functions.columns import clean_text, extract_entities, require_columns

RECORD_SCHEMA = "id string, created_utc double, created string, title string, selftext string, tickers string, score int, num_comments int"


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables that cut lineage: ``spark.checkpoint.dir``, which all executors share.

    A local session without one, as in tests, gets a new temporary folder; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-tidemark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


#: Folders that this process has named, by application.
_NAMED: dict[str, list[str]] = {}


def new_folder(spark: SparkSession) -> str:
    """A new folder beside the session's checkpoints."""
    path = f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"
    _NAMED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_settled(spark: SparkSession) -> int:
    """Delete the tables that this application has settled, and return how many folders there were.

    For the end of a job, when its results are written: no DataFrame that rests on a settled table can be read afterwards."""
    paths = _NAMED.pop(spark.sparkContext.applicationId, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    return len(paths)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: the rows are computed once, and a lost executor costs a re-read."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load_records(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA, columns: Sequence[str] = (), limit: int | None = None, sep: str = ",", parquet: str | None = None) -> DataFrame:
    """A UTF-8 CSV with a header and quoted multi-line fields, or Parquet by its suffix.

    A malformed row is an error; so is a missing or an empty source. Texts such as ``NA``
    stay texts. Only the schema's columns that the header names are read.

    Where a quoted field may hold line ends, a line end says nothing about where a record begins, so each CSV file is read by one
    task: give large sources as many files, and ``parquet``, a path to which they are converted once; what is returned then is read
    from there, split and pruned as any Parquet table, and a later call with that path reads no CSV.
    """
    converted = None
    if parquet:
        try:
            converted = spark.read.parquet(parquet)
        except AnalysisException:  # not there yet
            pass
    if converted is not None or path.rstrip("/").endswith(".parquet"):
        df = converted if converted is not None else spark.read.parquet(path)
    else:
        options = {"header": True, "multiLine": True, "escape": '"', "mode": "FAILFAST", "enforceSchema": False, "sep": sep}
        header = spark.read.options(**options).csv(path).columns
        kinds = dict(x.strip().split(" ") for x in schema.split(","))
        df = spark.read.options(**options).schema(", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in header)).csv(path)
    if columns:
        df = require_columns(df, *columns, stage="load_records").select(*columns)
    if parquet and converted is None:
        df.write.parquet(parquet)
        df = spark.read.parquet(parquet)
    if df.isEmpty():
        raise ValueError(f"{path} has no rows")
    return df.limit(limit) if limit else df


def parse_time(df: DataFrame) -> DataFrame:
    """created_ts (UTC without a zone) and epoch from ``created_utc`` seconds, else from ``created``; a bad value fails the load."""
    if "created_utc" in df.columns:
        ts = F.timestamp_seconds(F.col("created_utc"))
        ts = F.to_timestamp_ntz(F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss"))
    else:
        require_columns(df, "created", stage="parse_time")
        ts = F.col("created").try_cast("timestamp_ntz")
    checked = F.when(ts.isNull(), F.raise_error(F.lit("a creation time cannot be read"))).otherwise(ts)
    out = df.withColumn("created_ts", checked)
    return out.withColumn("epoch", F.unix_timestamp("created_ts"))


def with_entities(df: DataFrame, stop: Sequence[str]) -> DataFrame:
    """Where the source has no entity list, ``tickers`` by extraction from cleaned texts."""
    if "tickers" in df.columns:
        return df
    df = require_columns(df, "title", "selftext", stage="extraction")
    df = df.withColumns({"title": F.coalesce("title", F.lit("")), "selftext": clean_text(F.col("selftext"))})
    return df.withColumn("tickers", F.array_join(extract_entities(F.col("title"), F.col("selftext"), stop), ","))


def has_entity(tickers: Column) -> Column:
    return F.coalesce(~F.trim(tickers).isin("", "nan", "None"), F.lit(False))


def explode_mentions(df: DataFrame) -> DataFrame:
    """One row for each record and listed entity, upper-case; repeats in a supplied list stay."""
    rows = df.where(has_entity(F.col("tickers"))).withColumn("entity", F.explode(F.split("tickers", ",")))
    return rows.withColumn("entity", F.upper(F.trim("entity"))).where("entity <> ''").drop("tickers")


def load_stoplist(spark: SparkSession, path: str) -> DataFrame:
    """term: trimmed, upper-case lines but for blank ones and those that start with #."""
    return stop_terms(spark.read.text(path).toDF("line"))


def stop_terms(lines: DataFrame) -> DataFrame:
    line = F.upper(F.trim("line"))
    return lines.select(line.alias("term")).where("term <> '' and not startswith(term, '#')").distinct()


def fingerprint(df: DataFrame, *columns: str, time: str | None = None, entity: str | None = None) -> DataFrame:
    """One row: content_hash (the sum of each row's MD5 prefix, whatever the order and the files), n_rows, column_names (sorted),
    size_bytes (of the files read; null where rows do not come from files), time_column, min_time, max_time, has_entities.

    One pass: sums and extremes of each file, with the size that its scan knows, are merged."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    prefix = F.conv(F.substring(F.md5(row), 1, 12), 16, 10).cast("decimal(38,0)")
    try:
        of_file = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_size"))
    except AnalysisException:
        of_file = df.withColumns({"_file": F.lit(""), "_size": F.lit(None).cast("long")})
    own = {
        "h": F.sum(prefix), "n": F.count("*"), "size": F.max("_size"),
        "a": F.min(time) if time else F.lit(None).cast("timestamp"), "b": F.max(time) if time else F.lit(None).cast("timestamp"),
        "e": F.count(entity) if entity else F.lit(0),
    }
    files = of_file.groupBy("_file").agg(*[x.alias(k) for k, x in own.items()])
    shown = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")
    return files.agg(
        F.sum("h").cast("string").alias("content_hash"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.lit(",".join(sorted(columns))).alias("column_names"),
        F.sum("size").alias("size_bytes"), F.lit(time).alias("time_column"), shown(F.min("a")).alias("min_time"), shown(F.max("b")).alias("max_time"),
        F.coalesce(F.sum("e") > 0, F.lit(False)).alias("has_entities"),
    )


def write_labelled(df: DataFrame, path: str, format: str = "parquet") -> None:
    df.write.mode("overwrite").partitionBy("partition").format(format).save(path)


def _finite(x: Column, kind: DataType) -> Column:
    """The value with doubles that are not finite as null, at any depth of structs."""
    if isinstance(kind, DoubleType):
        return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    if isinstance(kind, StructType):
        return F.when(x.isNotNull(), F.struct(*[_finite(x[f.name], f.dataType).alias(f.name) for f in kind]))
    return x


def write_summary(summary: DataFrame, path: str) -> None:
    """One row, nested or not, as JSON; NaN and infinities are not JSON, so doubles that are not finite become null."""
    summary.select(*[_finite(F.col(f.name), f.dataType).alias(f.name) for f in summary.schema]).coalesce(1).write.mode("overwrite").json(path)


def write_sweep(sweep: DataFrame, path: str) -> None:
    sweep.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


RUN_SCHEMA = "run_id string, pipeline string, timestamp string, git_sha string, config map<string,string>, outputs array<string>, summary map<string,string>, notes string"


def append_run(spark: SparkSession, path: str, **record) -> None:
    """Appends a run record to the log, a folder of JSON lines."""
    row = {k: ({a: str(b) for a, b in v.items()} if isinstance(v, dict) else v) for k, v in record.items()}
    spark.createDataFrame([row], RUN_SCHEMA).write.mode("append").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).json(path)


def load_fit_stats(spark: SparkSession, path: str) -> DataFrame:
    """Saved statistics; a missing field is an error."""
    df = spark.read.json(path)
    return require_columns(df, "mu_volume", "sigma_volume", "mu_sentiment", "sigma_sentiment", stage="load_fit_stats")

