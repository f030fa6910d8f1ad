"""What several operators share: words, shared folders, checkpoints, components, gapless ranks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """The matches of WORD as UTF-8; null has none. bytes.split and bytes.lower know ASCII only."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a
    temporary folder; on a cluster that is an error, as executors wouldn't see each other's files."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            return jdir.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="waymark-checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
        return found
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read from there: short lineage that survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, as a URI or a plain path."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder and its path there; the folder is made if need be."""
    if "://" not in uri and not uri.startswith("file:"):
        fs, path = pafs.LocalFileSystem(), uri
    elif uri.startswith("file:"):
        fs, path = pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    else:
        fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path, recursive=True)
    return fs, path


def put_file(uri: str, name: str, parts: list[bytes]) -> None:
    """Write name below uri under another name first, so that a task run twice leaves one whole file."""
    fs, path = open_folder(uri)
    draft = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    fs.move(draft, f"{path}/{name}")


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # not glibc
    _trim = None


def release() -> None:
    """Give memory that is free back to the system. Workers live on between tasks and stages, and malloc and Arrow keep what a
    batch of texts took; called where a batch ends."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def _checksum(df: DataFrame) -> tuple:
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b), component being the smallest node reachable.

    Alternating large-star and small-star rounds. Each round is partial aggregates plus joins whose sides
    both come from a written table, so that a hub's rows can be split; nothing is gathered at the driver
    but a count and a checksum. Null ends and self-loops are dropped; no edges give no rows.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e)
    last = _checksum(e)
    if not last[0]:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = materialize(low)
        large = e.join(low, e.b == low.u).select(F.col("a").alias("x"), F.col("m").alias("y"))
        large = materialize(large.where("x <> y").distinct())
        low = materialize(large.groupBy("x").agg(F.min("y").alias("m")))
        moved = large.join(low, "x").where("y <> m").select(F.col("y").alias("a"), F.col("m").alias("b"))
        e = materialize(moved.union(low.select("x", "m")).distinct())
        now = _checksum(e)
        if now == last:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                e.select("b", "b").distinct()
            )
        last = now


#: rows up to which broadcast_if_small broadcasts: narrow rows, so some tens of MB
BROADCAST_ROWS = 500_000


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """A written table of narrow rows, marked for broadcasting if its count allows; else it is joined by shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: a row's number, under a name that tables won't have
ROW = "__waymark_row"


def stable(docs: DataFrame) -> DataFrame:
    """docs as rows that come in one order in each scan, so that they can be numbered in several: what comes by shuffles,
    draws at random or is sampled is written first."""
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    narrow = ("Relation ", "LocalRelation", "LogicalRDD", "Project", "Filter", "Range", "SubqueryAlias", "Union")
    loose = any(x in plan for x in ("rand(", "randn(", "uuid(", "shuffle("))
    nodes = (line.lstrip(" :+-").removeprefix("!") for line in plan.splitlines() if line.strip())
    return materialize(docs) if loose or not all(n.startswith(narrow) for n in nodes) else docs


def quoted(columns: list[str]) -> list[str]:
    """Column names for select(), whatever characters they hold."""
    return ["`" + c.replace("`", "``") + "`" for c in columns]
