"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.records import shared_folder


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it again.

    The result has no lineage but the files, so a lost executor costs a re-read and
    not the whole computation; unlike ``checkpoint()`` the rows are computed once.
    """
    path = f"{shared_folder(df.sparkSession)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidemark_path = path  # for discard()
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a ``materialize`` result that no later plan reads."""
    path = getattr(df, "_tidemark_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Keys that hold more than this share of all rows are hot: 2,000 at most.
HOT = 2000


def join_counted(rows: DataFrame, counted: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """``rows`` joined with ``counted`` (one row for each key, with ``size``, its rows) by ``key``.

    Hot keys, which are HOT at most, are joined by broadcast, so that none of them meets in one task."""
    if total is None:
        total = counted.agg(F.sum("size")).first()[0] or 0
    hot = counted.where(F.col("size") > total / HOT)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(counted.where(F.col("size") <= total / HOT), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


#: Bits of the map of wanted values, in pages of ``bitmap_construct_agg``: 8 MB in all, whatever there is.
MAP_PAGE = 8 * 4096
MAP_BITS = 2000 * MAP_PAGE


def likely_among(rows: DataFrame, value: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: those whose value may be among ``wanted`` (one column), and those that surely are not, nulls included.

    Values are looked up by their hash in a map of fixed size, which is broadcast. A share of about wanted / MAP_BITS of the
    others is taken along, so the map helps while there are fewer wanted values than it has bits; the results are the same."""
    at = lambda x: F.pmod(F.xxhash64(x), F.lit(MAP_BITS))
    page, bit, bits = fresh(rows, "page"), fresh(rows, "bit"), fresh(rows, "bits")
    x = F.col(wanted.columns[0])
    pages = wanted.where(x.isNotNull()).select(F.floor(at(x) / MAP_PAGE).cast("int").alias(page), (at(x) % MAP_PAGE).alias(bit))
    pages = F.broadcast(pages.groupBy(page).agg(F.bitmap_construct_agg(bit).alias(bits)))
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(F.col(bit) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(byte, (F.col(bit) % 8).cast("int")) == 1, F.lit(False)) & F.col(value).isNotNull()
    found = rows.withColumns({page: F.floor(at(F.col(value)) / MAP_PAGE).cast("int"), bit: at(F.col(value)) % MAP_PAGE}).join(pages, page, "left")
    return found.where(is_set).select(*rows.columns), found.where(~is_set).select(*rows.columns)


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: ``node``, ``component`` (its smallest node).

    Alternating large-star and small-star rounds: joins and aggregates only, O(log^2 n)
    rounds, each written to the shared folder. Nodes without an edge are not returned;
    null ends, self-loops and repeated edges are ignored. The hub of a star is aggregated on
    the map side first, and joined by broadcast.
    """
    u, v = F.col(src), F.col(dst)
    now = materialize(
        edges.where(u.isNotNull() & v.isNotNull() & (u != v))
        .select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
        .distinct()
    )
    summary = (F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    mark = now.agg(*summary).first()
    for _ in range(max_rounds if mark[0] else 0):
        # large star: every larger neighbour of u hangs on the smallest node around u
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size")).select("u", F.least("u", "m").alias("m"), "size")
        large = (
            join_counted(both, least, "u", 2 * mark[0]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        # small star: u and its smaller neighbours hang on the smallest of them
        large = materialize(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size"))
        small = (
            join_counted(large, least, "u", mark[0])
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u != v")
            .distinct()
        )
        after = materialize(small)
        discard(now)
        discard(large)
        now = after
        before, mark = mark, now.agg(*summary).first()
        if mark == before:
            break
    else:
        if mark[0]:
            raise RuntimeError("connected components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
