"""Catalogs and tables read from live sources: JDBC databases, SQLite files, Spark's own catalog, Parquet folders."""

from __future__ import annotations

import sqlite3
from collections.abc import Callable
from contextlib import closing
from itertools import pairwise
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql import types as T

from .catalog import Catalog, from_spec

Reader = Callable[[str], DataFrame | None]


def _ordered(spec: dict) -> dict:
    """Tables with referred tables first, by name within a level; those in cycles last, by name."""
    todo, done = sorted(spec["tables"]), []
    while ready := [t for t in todo if all(f["referred_table"] in (*done, t) or f["referred_table"] not in spec["tables"] for f in spec["tables"][t]["foreign_keys"])]:
        done += ready
        todo = [t for t in todo if t not in done]
    return spec | {"tables": {t: spec["tables"][t] for t in [*done, *todo]}}


def sqlite_path(url: str) -> str:
    return url.removeprefix("sqlite:///").removeprefix("sqlite://")


def _open_sqlite(path: str) -> sqlite3.Connection:
    """A connection that reads; a missing file is an error and isn't made."""
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def _name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


def reflect_sqlite(url: str) -> Catalog:
    """The tables of an SQLite file (sqlite:///path), by its pragmas."""
    spec: dict = {"dialect": "sqlite", "tables": {}}
    with closing(_open_sqlite(sqlite_path(url))) as db:
        names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\'")]
        for t in names:
            quoted = _name(t)
            info = db.execute(f"PRAGMA table_info({quoted})").fetchall()
            fks: dict = {}
            for r in db.execute(f"PRAGMA foreign_key_list({quoted})"):
                fk = fks.setdefault(r[0], {"referred_table": r[2], "constrained_columns": [], "referred_columns": []})
                fk["constrained_columns"].append(r[3])
                fk["referred_columns"].append(r[4])
            for fk in fks.values():
                if None in fk["referred_columns"]:  # the key of the table referred to is meant
                    theirs = sorted((c for c in db.execute(f"PRAGMA table_info({_name(fk['referred_table'])})") if c[5]), key=lambda c: c[5])
                    fk["referred_columns"] = [c[1] for c in theirs]
            indexes = []
            for r in db.execute(f"PRAGMA index_list({quoted})").fetchall():
                if r[3] == "c":
                    cols = [x[2] for x in db.execute(f"PRAGMA index_info({_name(r[1])})")]
                    indexes.append({"name": r[1], "unique": bool(r[2]), "columns": cols})
            cols = [{"name": c[1], "type": c[2] or "NULL", "nullable": not c[3], "primary_key": c[5] > 0, "default": c[4]} for c in info]
            key = [c[1] for c in sorted(info, key=lambda c: c[5]) if c[5]]
            spec["tables"][t] = {"columns": cols, "primary_key": key, "foreign_keys": [fks[k] for k in sorted(fks)], "indexes": indexes}
    return from_spec(_ordered(spec))


def reflect_jdbc(spark: SparkSession, url: str, schema: str | None = None, properties: dict | None = None) -> Catalog:
    """The tables of one schema behind a JDBC URL, by the driver's DatabaseMetaData."""
    props = spark._jvm.java.util.Properties()
    for k, v in (properties or {}).items():
        props.setProperty(k, v)
    con = spark._jvm.java.sql.DriverManager.getConnection(url, props)

    def rows(found, *names):
        out = []
        while found.next():
            out.append([found.getString(n) for n in names])
        found.close()
        return out

    try:
        meta, cat = con.getMetaData(), con.getCatalog()
        schema = schema or con.getSchema()
        dialect = meta.getDatabaseProductName().lower().replace("apache ", "")
        spec: dict = {"dialect": dialect, "tables": {}}
        kinds = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.String, 1)
        kinds[0] = "TABLE"
        for (t,) in rows(meta.getTables(cat, schema, "%", kinds), "TABLE_NAME"):
            key = [c for c, _ in sorted(rows(meta.getPrimaryKeys(cat, schema, t), "COLUMN_NAME", "KEY_SEQ"), key=lambda r: int(r[1]))]
            cols = []
            for name, kind, size, digits, null, default, remark in rows(meta.getColumns(cat, schema, t, "%"), "COLUMN_NAME", "TYPE_NAME", "COLUMN_SIZE", "DECIMAL_DIGITS", "IS_NULLABLE", "COLUMN_DEF", "REMARKS"):
                upper = kind.upper()
                if "CHAR" in upper and "(" not in upper:
                    kind = f"{kind}({size})"
                elif upper in ("DECIMAL", "NUMERIC"):
                    kind = f"{kind}({size}, {digits or 0})"
                cols.append({"name": name, "type": kind, "nullable": null != "NO", "primary_key": name in key, "default": default, "comment": remark or None})
            fks: dict = {}
            for name, mine, other, theirs, seq in rows(meta.getImportedKeys(cat, schema, t), "FK_NAME", "FKCOLUMN_NAME", "PKTABLE_NAME", "PKCOLUMN_NAME", "KEY_SEQ"):
                fks.setdefault((name, other), []).append((int(seq), mine, theirs))
            indexes: dict = {}
            for name, col, not_unique, pos in rows(meta.getIndexInfo(cat, schema, t, False, True), "INDEX_NAME", "COLUMN_NAME", "NON_UNIQUE", "ORDINAL_POSITION"):
                if col:
                    indexes.setdefault((name, not_unique.lower() in ("false", "0", "f")), []).append((int(pos), col))
            spec["tables"][t] = {
                "columns": cols,
                "primary_key": key,
                "foreign_keys": [{"referred_table": k[1], "constrained_columns": [x[1] for x in sorted(v)], "referred_columns": [x[2] for x in sorted(v)]} for k, v in fks.items()],
                "indexes": [{"name": k[0], "unique": k[1], "columns": [x[1] for x in sorted(v)]} for k, v in indexes.items()],
            }
        return from_spec(_ordered(spec))
    finally:
        con.close()


def reflect_spark(spark: SparkSession, database: str | None = None) -> Catalog:
    """The tables of a database of Spark's catalog. Keys are not known there; declared char types and NOT NULL are, as far as the format keeps them."""
    spec: dict = {"dialect": "spark", "tables": {}}
    for t in spark.catalog.listTables(database):
        name = f"{t.namespace[0]}.{t.name}" if t.namespace else t.name
        cols = [{"name": f.name, "type": f.metadata.get("__CHAR_VARCHAR_TYPE_STRING", f.dataType.simpleString()), "nullable": f.nullable, "comment": f.metadata.get("comment")} for f in spark.table(name).schema]
        spec["tables"][t.name] = {"columns": cols, "foreign_keys": []}
    return from_spec(_ordered(spec))


class SqliteSource(DataSource):
    """spark.read.format("sqlite") with options path, table and, for parallel reads, partitions: ranges of rowid. Tables without a
    rowid are read as one. The file has to be where executors can open it. Decimals that are no short fraction come as
    SQLite holds them, in double precision."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        kinds = {"INT": "long", "CHAR": "string", "CLOB": "string", "TEXT": "string", "REAL": "double", "FLOA": "double", "DOUB": "double", "BLOB": "binary"}
        with closing(_open_sqlite(self.options["path"])) as db:
            info = db.execute(f"PRAGMA table_info({_name(self.options['table'])})").fetchall()
        pick = lambda t: next((v for k, v in kinds.items() if k in (t or "").upper()), "double" if (t or "").upper()[:3] in ("NUM", "DEC") else "string")
        return ", ".join(f"`{c[1]}` {pick(c[2])}" for c in info)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(self.options, schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.table, self.n, self.names = options["path"], options["table"], int(options.get("partitions", 1)), schema
        self.casts = [{"long": int, "double": float, "string": str, "binary": bytes}.get(f.dataType.typeName(), str) for f in schema]

    def partitions(self) -> list[InputPartition]:
        """Equal ranges of rowid, with bounds that SQLite finds by its index."""
        if self.n < 2:
            return [InputPartition(None)]
        with closing(_open_sqlite(self.path)) as db:
            try:
                lo, hi = db.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
            except sqlite3.OperationalError:  # WITHOUT ROWID
                return [InputPartition(None)]
        if lo is None:
            return [InputPartition(None)]
        cuts = sorted({lo + (hi + 1 - lo) * i // self.n for i in range(self.n + 1)})
        return [InputPartition(x) for x in pairwise(cuts)]

    def read(self, partition: InputPartition):
        cols = ", ".join(_name(f.name) for f in self.names)
        where = "" if partition.value is None else " WHERE rowid >= {} AND rowid < {}".format(*partition.value)
        with closing(_open_sqlite(self.path)) as db:
            for row in db.execute(f"SELECT {cols} FROM {_name(self.table)}{where}"):
                yield tuple(None if v is None else c(v) for v, c in zip(row, self.casts, strict=True))


def _jdbc_table(spark: SparkSession, url: str, table: str, key: str | None, partitions: int, properties: dict) -> DataFrame:
    """A table behind JDBC, by as many connections as partitions if its key is one column of whole numbers."""
    if key is None or partitions < 2:
        return spark.read.jdbc(url, table, properties=properties)
    bounds = spark.read.jdbc(url, f"(SELECT MIN({key}) AS lo, MAX({key}) AS hi FROM {table}) b", properties=properties).first()
    if bounds[0] is None:
        return spark.read.jdbc(url, table, properties=properties)
    return spark.read.jdbc(url, table, column=key, lowerBound=int(bounds[0]), upperBound=int(bounds[1]) + 1, numPartitions=partitions, properties=properties)


def _whole_keys(cat: Catalog) -> dict[str, str]:
    """Tables whose key is one column of whole numbers, and that column."""
    kinds = {(c[1], c[3]): c[4].upper().split("(")[0].split(" ")[0] for c in cat.column_rows}
    single = {t: pk[0] for _, t, pk, _ in cat.table_rows if len(pk) == 1}
    return {t: k for t, k in single.items() if kinds.get((t, k), "") in ("INT", "INTEGER", "BIGINT", "SMALLINT", "INT4", "INT8", "SERIAL", "BIGSERIAL")}


def connect(spark: SparkSession, url: str, properties: dict | None = None, schema: str | None = None, partitions: int | None = None) -> tuple[Catalog, Reader]:
    """The catalog behind a URL, and a function from table name to DataFrame (None: no such table).

    URLs: sqlite:///file, jdbc:..., spark:database, and parquet:folder (one file or folder for each table).
    partitions: into how many ranges of keys JDBC and SQLite tables are cut (default: Spark's default parallelism).
    """
    partitions = partitions or spark.sparkContext.defaultParallelism
    if url.startswith("sqlite:"):
        spark.dataSource.register(SqliteSource)
        cat, path = reflect_sqlite(url), sqlite_path(url)
        return cat, lambda t: spark.read.format("sqlite").options(path=path, table=t, partitions=partitions).load() if t in cat.names else None
    if url.startswith("jdbc:"):
        cat = reflect_jdbc(spark, url, schema, properties)
        prefix = f"{schema}." if schema else ""
        keys = _whole_keys(cat)
        return cat, lambda t: _jdbc_table(spark, url, prefix + t, keys.get(t), partitions, properties or {}) if t in cat.names else None
    if url.startswith("spark:"):
        db = url.removeprefix("spark:") or None
        cat = reflect_spark(spark, db)
        return cat, lambda t: spark.table(f"{db}.{t}" if db else t) if t in cat.names else None
    if url.startswith("parquet:"):
        return reflect_parquet(spark, url.removeprefix("parquet:"))
    raise ValueError(f"unknown kind of URL: {url}")


def reflect_parquet(spark: SparkSession, folder: str) -> tuple[Catalog, Reader]:
    """Tables name.parquet of a folder in any store that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName().removesuffix(".parquet") for s in fs.listStatus(path) if s.getPath().getName().endswith(".parquet"))
    read = lambda t: spark.read.parquet(f"{folder}/{t}.parquet") if t in names else None
    spec = {t: {"columns": [{"name": f.name, "type": f.dataType.simpleString()} for f in read(t).schema]} for t in names}
    return from_spec({"dialect": "parquet", "tables": spec}), read
