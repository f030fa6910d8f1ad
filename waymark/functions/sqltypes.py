"""SQL type strings as column expressions: parse, render for a dialect, compare."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Raw type keywords and the generic kind of each.
KINDS = {
    "BIGINT": "BIGINT",
    "SMALLINT": "SMALLINT",
    "TINYINT": "SMALLINT",
    "INT": "INTEGER",
    "INTEGER": "INTEGER",
    "SERIAL": "INTEGER",
    "BIGSERIAL": "BIGINT",
    "NUMERIC": "DECIMAL",
    "DECIMAL": "DECIMAL",
    "REAL": "FLOAT",
    "FLOAT": "FLOAT",
    "DOUBLE": "DOUBLE",
    "DOUBLE PRECISION": "DOUBLE",
    "BOOL": "BOOLEAN",
    "BOOLEAN": "BOOLEAN",
    "VARCHAR": "VARCHAR",
    "CHARACTER VARYING": "VARCHAR",
    "NVARCHAR": "VARCHAR",
    "ENUM": "VARCHAR",
    "CHAR": "CHAR",
    "TEXT": "TEXT",
    "CLOB": "TEXT",
    "DATE": "DATE",
    "TIME": "TIME",
    "DATETIME": "TIMESTAMP",
    "TIMESTAMP": "TIMESTAMP",
    "TIMESTAMP WITHOUT TIME ZONE": "TIMESTAMP",
    "TIMESTAMP WITH TIME ZONE": "TIMESTAMPTZ",
    "JSON": "JSON",
    "JSONB": "JSON",
    "BLOB": "BLOB",
    "BYTEA": "BLOB",
    "VARBINARY": "BLOB",
    "UUID": "UUID",
}
# What each dialect calls the kinds whose name it changes.
NAMES = {
    "generic": {},
    "snowflake": {"TEXT": "VARCHAR", "BLOB": "BINARY", "JSON": "VARIANT", "TIMESTAMP": "TIMESTAMP_NTZ", "TIMESTAMPTZ": "TIMESTAMP_TZ", "UUID": "VARCHAR(36)"},
    "bigquery": {"BIGINT": "INT64", "SMALLINT": "INT64", "INTEGER": "INT64", "FLOAT": "FLOAT64", "DOUBLE": "FLOAT64", "BOOLEAN": "BOOL", "TEXT": "STRING", "VARCHAR": "STRING", "CHAR": "STRING", "UUID": "STRING", "BLOB": "BYTES", "TIMESTAMP": "DATETIME", "TIMESTAMPTZ": "TIMESTAMP"},
    "postgresql": {"TIMESTAMPTZ": "TIMESTAMP WITH TIME ZONE", "JSON": "JSONB", "BLOB": "BYTEA"},
    "mysql": {"TIMESTAMP": "DATETIME", "TIMESTAMPTZ": "DATETIME", "UUID": "CHAR(36)", "BOOLEAN": "TINYINT(1)"},
}
ALIASES = {"postgres": "postgresql", "mariadb": "mysql"}

# Fixed value: what counts as a type with arguments, a word or words and one pair of brackets at the end.
_SIZED = r"^([A-Z0-9_ ]+?)\s*\(([^)]*)\)\s*$"
_BLANK = r"^\s+|\s+$"


def _lookup(c: Column, table: dict[str, str], other: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), other) if table else other


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, _BLANK, "")


def kind_of(raw: Column) -> Column:
    """The generic kind of a raw type, or its first word if that is no known keyword."""
    up = F.upper(_strip(raw))
    word = F.when(up.rlike(_SIZED), _strip(F.regexp_extract(up, _SIZED, 1))).otherwise(up)
    first = F.split_part(word, F.lit(" "), F.lit(1))
    return _lookup(word, KINDS, _lookup(first, KINDS, first))


def _arguments(raw: Column) -> Column:
    up = F.upper(_strip(raw))
    inner = F.when(up.rlike(_SIZED), F.regexp_extract(up, _SIZED, 2)).otherwise(F.lit(""))
    return F.filter(F.transform(F.split(inner, ","), _strip), lambda a: a != "")


def _whole(c: Column) -> Column:
    return F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("int"))


def normalize(raw: Column) -> Column:
    """struct<kind, length, precision, scale> of a raw SQL type string."""
    kind, args = kind_of(raw), _arguments(raw)
    first, second = F.get(args, F.lit(0)), F.get(args, F.lit(1))
    length = F.when(kind.isin("VARCHAR", "CHAR"), _whole(first))
    good = (kind == "DECIMAL") & _whole(first).isNotNull() & (second.isNull() | _whole(second).isNotNull())
    precision = F.when(good, _whole(first))
    scale = F.when(good, F.coalesce(_whole(second), F.lit(0)))
    return F.struct(kind.alias("kind"), length.cast("int").alias("length"), precision.cast("int").alias("precision"), scale.cast("int").alias("scale"))


def render(t: Column, dialect: str) -> Column:
    """The dialect's name of a normalized type."""
    dialect = ALIASES.get(dialect.lower(), dialect.lower())
    dialect = dialect if dialect in NAMES else "generic"
    kind, length, precision, scale = (t.getField(f) for f in ("kind", "length", "precision", "scale"))
    sized = lambda name: F.concat(F.lit(f"{name}("), length.cast("string"), F.lit(")"))
    has = F.coalesce(length, F.lit(0)) != 0
    digits = F.concat(F.lit("("), precision.cast("string"), F.lit(","), F.coalesce(scale, F.lit(0)).cast("string"), F.lit(")"))
    plain = _lookup(kind, NAMES[dialect], kind)
    if dialect == "bigquery":
        return F.when(kind == "DECIMAL", F.when(F.coalesce(precision, F.lit(0)) != 0, F.concat(F.lit("NUMERIC"), digits)).otherwise("NUMERIC")).otherwise(plain)
    out = F.when(kind == "DECIMAL", F.when(precision.isNotNull(), F.concat(F.lit("DECIMAL"), digits)).otherwise("DECIMAL"))
    if dialect == "snowflake":
        return out.when(kind.isin("VARCHAR", "CHAR", "TEXT"), F.when(has, sized("VARCHAR")).otherwise("VARCHAR")).otherwise(plain)
    out = out.when(kind == "VARCHAR", F.when(has, sized("VARCHAR")).otherwise("VARCHAR"))
    return out.when(kind == "CHAR", F.when(has, sized("CHAR")).otherwise("CHAR(1)")).otherwise(plain)


def map_type(raw: Column, dialect: str, normalized: Column | None = None) -> Column:
    """struct<target_type, lossy, note> of a raw type in a dialect. normalized: a column that holds normalize(raw)."""
    t = normalize(raw) if normalized is None else normalized
    target = render(t, dialect)
    lossy = ~t.getField("kind").isin(*sorted(set(KINDS.values())))
    note = F.when(lossy, F.concat(F.lit("Unknown source type '"), raw, F.lit("' kept as '"), target, F.lit("': check by hand.")))
    return F.struct(target.alias("target_type"), lossy.alias("lossy"), note.alias("note"))


def is_narrowing(source: Column, target: Column) -> Column:
    """Whether a target type holds shorter strings, or fewer digits or decimals, than the source type."""
    return is_narrower(normalize(source), normalize(target))


def is_narrower(s: Column, t: Column) -> Column:
    """is_narrowing of normalized types."""
    text = ("VARCHAR", "CHAR")
    get = lambda x, f: F.coalesce(x.getField(f), F.lit(0))
    shorter = s.kind.isin(*text) & t.kind.isin(*text) & (get(s, "length") != 0) & (get(t, "length") != 0) & (get(t, "length") < get(s, "length"))
    digits = (get(s, "precision") != 0) & (get(t, "precision") != 0) & (get(t, "precision") < get(s, "precision"))
    decimals = (get(s, "scale") != 0) & t.scale.isNotNull() & (get(t, "scale") < get(s, "scale"))
    return shorter | ((s.kind == "DECIMAL") & (t.kind == "DECIMAL") & (digits | decimals))
