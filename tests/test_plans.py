import json
import sqlite3
import sys
import warnings
from dataclasses import replace

import pytest
from examples import COLLECTION, make_herbarium
from pyspark.sql import functions as F

from waymark.operators import checks, graph, match
from waymark.operators.profile import profile, profile_catalog, sample_values
from waymark.plans import cli, report
from waymark.plans.narrative import OfflineSynthesizer, Synthesis, get_synthesizer, synthesize_safely
from waymark.plans.planner import build_plan
from waymark.sources.catalog import from_spec, load_spec
from waymark.sources.reflect import connect


@pytest.fixture(scope="module")
def herbarium(tmp_path_factory, spark):
    folder = tmp_path_factory.mktemp("herbarium")
    (folder / "collection.yaml").write_text(COLLECTION)
    url = make_herbarium(folder / "herbarium.db")
    source, read = connect(spark, url, partitions=3)
    profiles, source, samples = profile_catalog(spark, source, read, sample_size=2)
    return {"folder": folder, "url": url, "source": source, "profiles": profiles, "samples": samples, "read": read, "target": load_spec(folder / "collection.yaml")}


@pytest.fixture(scope="module")
def plan(spark, herbarium):
    return build_plan(spark, herbarium["source"], herbarium["target"], herbarium["profiles"], offline=True, samples=herbarium["samples"])


def test_profile_edges(spark):
    df = spark.createDataFrame([], "a int, `b.c` string, m map<string,int>")
    rows = profile(df, "t").orderBy("col_ord").collect()
    assert [(r.column, r.row_count, r.null_count, r.distinct_count, r.min_value, r.null_ratio) for r in rows] == [("a", 0, 0, 0, None, 0.0), ("b.c", 0, 0, 0, None, 0.0), ("m", 0, 0, 0, None, 0.0)]
    df = spark.createDataFrame([(1e-5, True), (1e7, None)], "x double, y boolean")
    rows = profile(df, "t").orderBy("col_ord").collect()
    assert [(r.min_value, r.max_value) for r in rows] == [("1e-05", "10000000.0"), ("True", "True")]
    assert [r.distinct_count for r in profile(df, "t", max_distinct_rows=1).collect()] == [None, None]
    assert sample_values(df, "t", 0).count() == 0
    assert {r.value for r in sample_values(df, "t", 5).collect()} == {"1e-05", "10000000.0", "True"}


def test_reflection(herbarium):
    s = herbarium["source"]
    # parentless tables by name, then those in or behind the cycle
    assert s.dialect == "sqlite" and s.names == ["card_index", "collectors", "taxa", "cabinets", "loans", "sheets"]
    keys = {(r[1], r[4]): (r[3], r[5]) for r in s.fk_rows}
    assert keys["sheets", "taxa"] == (["taxon_no"], ["taxon_no"])  # REFERENCES taxa, without a column
    assert keys["cabinets", "sheets"] == (["newest_sheet"], ["barcode"]) and len(keys) == 5
    assert s.index_rows == [("taxa", 0, "one_name", ["genus", "epithet"], True)]
    assert {r[1]: (r[2], r[3]) for r in s.table_rows}["card_index"] == ([], 2) and {r[1]: r[3] for r in s.table_rows}["taxa"] == 5


def test_sqlite_ranges(spark, herbarium, tmp_path):
    taxa = herbarium["read"]("taxa")
    assert sorted(r.taxon_no for r in taxa.collect()) == [1, 2, 5, 9, 12] and taxa.rdd.getNumPartitions() == 3
    assert herbarium["read"]("nowhere") is None
    with sqlite3.connect(tmp_path / "x.db") as db:
        db.executescript("CREATE TABLE plain (a TEXT PRIMARY KEY, b NUMERIC) WITHOUT ROWID; INSERT INTO plain VALUES ('x', 1.5), ('y', NULL); CREATE TABLE none (a INTEGER)")
    _, read = connect(spark, f"sqlite:///{tmp_path}/x.db", partitions=4)
    assert sorted(tuple(r) for r in read("plain").collect()) == [("x", 1.5), ("y", None)] and read("none").count() == 0
    with pytest.raises(sqlite3.OperationalError):
        connect(spark, f"sqlite:///{tmp_path}/missing.db")
    assert not (tmp_path / "missing.db").exists()


def test_profiles(herbarium):
    p = {(r.table, r.column): r for r in herbarium["profiles"].collect()}
    g = p["taxa", "genus"]
    assert (g.row_count, g.null_count, g.distinct_count, g.min_value, g.max_value, g.null_ratio) == (5, 0, 4, "Briza", "Stipa", 0.0)
    assert p["taxa", "authority"].null_ratio == 0.8 and p["sheets", "altitude"].max_value == "410.5"
    values = [r for r in herbarium["samples"].collect() if (r.table, r.column) == ("taxa", "authority")]
    assert [(r.pos, r.value) for r in values] == [(0, "L.")]


def test_columns_that_fail(spark):
    @F.udf("long")
    def broken(x):
        raise ValueError("unreadable")

    whole = spark.range(4).withColumn("b", F.lit("v"))
    source = from_spec({"tables": {"t": {"columns": [{"name": c, "type": "INT"} for c in ("id", "bad", "b", "gone")]}, "lost": {"columns": []}, "locked": {"columns": []}}})

    def read(table):
        if table == "locked":
            raise OSError
        return whole.select("id", broken("id").alias("bad"), "b") if table == "t" else None

    profiles, counted, samples = profile_catalog(spark, source, read)
    rows = {r.column: r for r in profiles.collect()}
    assert set(rows) == {"id", "b"} and (rows["b"].col_ord, rows["b"].distinct_count, rows["id"].max_value) == (2, 1, "3")
    assert [r[3] for r in counted.table_rows] == [4, None, None] and {r.column for r in samples.collect()} == {"id", "b"}


def test_plan_of_the_herbarium(plan):
    assert plan.migration_order == ["card_index", "collectors", "taxa"] and plan.cyclic_dependencies == [["cabinets", "loans", "sheets"]]
    assert [(t["source_table"], t["target_table"]) for t in plan.table_mappings] == [("taxa", "taxa"), ("cabinets", "cabinets"), ("loans", "loans"), ("collectors", "herb_collectors"), ("sheets", "sheet"), ("card_index", None)]
    got = {(c["source_table"], c["source_column"]): c for t in plan.table_mappings for c in t["column_mappings"] if c["source_column"]}
    assert [got[k]["confidence"] for k in (("sheets", "gathered"), ("taxa", "authority"), ("collectors", "surname"), ("card_index", "drawer"))] == [0.842, 0.8, 1.0, 0.0]
    assert got["loans", "loan_no"]["transformation"] == "CAST(loan_no AS BIGINT)" and got["sheets", "cabinet"]["transformation"] is None
    assert got["sheets", "gathered"]["notes"] == "Target type 'DATETIME' is not the expected 'DATE'."
    by_table = {t["source_table"]: t for t in plan.table_mappings}
    assert by_table["collectors"]["unmatched_source_columns"] == ["field_remarks"] and by_table["taxa"]["unmatched_target_columns"] == ["red_listed"]
    assert [(r["severity"], r["category"], r["affected_objects"]) for r in plan.risks] == [
        ("high", "schema", ["card_index"]),
        ("high", "dependency", ["cabinets", "loans", "sheets"]),
        ("medium", "mapping", ["taxa.red_listed"]),
        ("high", "data_quality", ["taxa.epithet"]),
        ("medium", "compliance", ["loans.borrower_email"]),
        ("medium", "mapping", ["collectors.field_remarks"]),
        ("medium", "compliance", ["collectors.home_address"]),
        ("high", "data_quality", ["sheets.altitude"]),
        ("critical", "mapping", ["card_index"]),
        ("low", "mapping", ["exhibits"]),
        ("high", "data_quality", ["taxa.authority"]),
    ]
    assert [r["id"] for r in plan.risks] == [f"R{i:03d}" for i in range(1, 12)]
    names = [c["name"] for c in plan.validation_plan]
    assert len(names) == 27 and names[4:8] == [f"{k}::cabinets" for k in ("row_count", "null_parity", "checksum", "sample_diff")]
    assert names[20:] == ["referential_integrity::cabinets", "referential_integrity::loans", "referential_integrity::sheets", "business_rule::R004", "business_rule::R008", "business_rule::R009", "business_rule::R011"]
    assert plan.validation_plan[5]["source_query"].endswith(" FROM cabinets;") and plan.validation_plan[5]["source_query"].count("CASE WHEN") == 3
    assert [p["tables"] for p in plan.execution_phases] == [[], ["herb_collectors", "taxa"], ["herb_collectors"], ["herb_collectors", "taxa"], ["herb_collectors", "taxa"], []]
    assert any("within cycles" in t for t in plan.execution_phases[3]["tasks"])
    assert "1 critical and 5 high" in plan.architecture_summary and "cabinets, loans, sheets" in plan.architecture_summary


def test_reports(plan, tmp_path):
    text = report.to_markdown(plan)
    for head in ("# Data Migration Plan", "## Executive Summary", "## Migration Order (Dependency-Resolved)", "## Table & Column Mappings", "## Risks", "## Validation Plan", "## Execution Phases", "## Notes"):
        assert head in text.splitlines()
    assert "### Circular Dependencies (excluded from ordering above)" in text and "- `cabinets`, `loans`, `sheets`" in text
    assert "### `card_index` -> **(no target table found)**" in text and "| R009 | CRITICAL |" in text
    data = json.loads(report.to_json(plan))
    assert data["generated_at"].startswith("20")
    shown = {(p["table"], p["column"]): p for p in data["column_profiles"]}
    assert shown["taxa", "authority"]["sample_values"] == ["L."] and len(shown["taxa", "genus"]["sample_values"]) == 2 and shown["taxa", "genus"]["distinct_count"] == 4
    assert [f.name for f in report.write(plan, tmp_path / "a" / "b")] == ["migration_plan.md", "migration_plan.json"]
    severities = [r["severity"] for r in plan.risks_by_severity()]
    assert severities == sorted(severities, key=["critical", "high", "medium", "low"].index)
    many = replace(plan, execution_phases=[plan.execution_phases[1] | {"tables": [f"t{i}" for i in range(23)]}], cyclic_dependencies=[])
    assert "`t19` (+3 more)" in report.to_markdown(many) and "### Circular" not in report.to_markdown(many)


def test_command_line(spark, herbarium, capsys, tmp_path):
    args = ["plan", "--source-url", herbarium["url"], "--target-schema", str(herbarium["folder"] / "collection.yaml"), "--output-dir", str(tmp_path), "--offline"]
    assert cli.run_plan(cli.parser().parse_args([*args, "--no-profile"]), spark) == 0
    assert "Source tables: 6. Risks: 10. Checks to run: 26." in capsys.readouterr().out
    assert json.loads((tmp_path / "migration_plan.json").read_text())["column_profiles"] == []
    assert cli.run_plan(cli.parser().parse_args([*args, "--sample-size", "1"]), spark) == 0
    shown = json.loads((tmp_path / "migration_plan.json").read_text())["column_profiles"]
    assert max(len(p["sample_values"]) for p in shown) == 1
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["plan", "--source-url", "x"])


def test_hashes_tell_rows_apart(spark):
    frame = lambda rows: spark.createDataFrame(rows, "k int, a string, b string")
    pairs, key = [("a", "a"), ("b", "b")], [("k", "k")]

    def diff(x, y):
        return sorted((tuple(r) for r in checks.checksum_diff(frame(x), frame(y), key, pairs).collect()), key=repr)

    assert diff([(1, "x|=y", "z")], [(1, "x", "y|=z")]) == [(1, "different")]
    assert diff([(1, "1:a", None)], [(1, "1", "a~")]) == [(1, "different")] and diff([(1, None, "~")], [(1, "~", None)]) == [(1, "different")]
    assert diff([(None, "x", "y")], [(None, "x", "y")]) == []
    assert diff([(None, "x", "y"), (2, "a", "b")], [(3, "a", "b")]) == [(2, "missing"), (3, "extra"), (None, "missing")]
    assert diff([(1, "x", "y")] * 2, [(1, "x", "y")]) == [(1, "different")] and diff([(1, "x", "y"), (1, "u", "v")], [(1, "u", "v"), (1, "x", "y")]) == []
    digest = lambda rows: tuple(checks.table_digest(frame(rows), ["a", "b"]).first())
    assert digest([(1, "a", "a")] * 2) != digest([(1, "b", "b")] * 2) and digest([(1, "a", "b"), (2, "c", None)]) == digest([(3, "c", None), (4, "a", "b")])
    assert digest([]) == (0, "0")
    assert checks.sample_diff(frame([(None, "x", "y")]), frame([]), key, pairs, 100).count() == 1


def test_entry_without_the_optional_part(monkeypatch):
    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m.startswith(("waymark.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tiktoken", None)  # as if it weren't installed
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert "profile_orders" in entry.queries() and "op3_byte_bpe" not in entry.queries()
    assert seen


def test_narrative():
    class Bad:
        def synthesize(self, context):
            raise ValueError("no")

    out = synthesize_safely(Bad(), {"cyclic_dependencies": [["a", "b"]], "risk_counts": {"high": 2}})
    assert "ValueError: no" in out.notes[-1] and "1 group(s): a, b" in out.architecture_summary and "2 high" in out.architecture_summary

    def broken():
        raise OSError

    assert isinstance(get_synthesizer(broken), OfflineSynthesizer) and isinstance(get_synthesizer(), OfflineSynthesizer)

    class Good:
        def synthesize(self, context):
            return Synthesis("s", [{"id": "X"}])

    assert get_synthesizer(Good).synthesize({}).additional_risks == [{"id": "X"}]


def _refs(**tables):
    return from_spec({"tables": {t: {"columns": [{"name": "id", "type": "INT"}], "foreign_keys": [{"constrained_columns": ["id"], "referred_table": r, "referred_columns": ["id"]} for r in refs.split()]} for t, refs in tables.items()}})


def test_load_order(spark):
    order = lambda c: [r.table for r in graph.load_order(spark, c).orderBy("pos").collect()]
    assert order(_refs(z="a", c="b", b="", a="")) == ["a", "b", "z", "c"]
    assert order(_refs(items="orders", orders="customers", customers="")) == ["customers", "orders", "items"]
    assert order(_refs(tree="tree", other="missing")) == ["other", "tree"]
    cyc = _refs(a="b", b="a", behind="a c", c="", x="y", y="x")
    assert order(cyc) == ["c"]
    assert [r.members for r in graph.cycle_groups(spark, cyc).orderBy("group").collect()] == [["a", "b", "behind"], ["x", "y"]]
    assert order(from_spec(None)) == [] and graph.cycle_groups(spark, from_spec({})).count() == 0


def test_greedy_matching(spark):
    def run(left, right):
        frame = lambda names: spark.createDataFrame([("g", i, n) for i, n in enumerate(names)], "group string, ord int, name string")
        return [(r.left, r.right, r.kind, r.score) for r in match.match_names(frame(left), frame(right)).orderBy("pos").collect()]

    assert run(["part"], ["parts_v2"]) == []
    assert run([" Full-Name", "full name"], ["full_name", "FULL_NAME"]) == [(" Full-Name", "full_name", "exact", 1.0), ("full name", "FULL_NAME", "exact", 1.0)]
    assert run(["customer", "customers"], ["customers"]) == [("customers", "customers", "exact", 1.0)]
    assert run(["abcde", "abcdf"], ["abcdx", "abcdy"]) == [("abcde", "abcdx", "fuzzy", 0.8), ("abcdf", "abcdy", "fuzzy", 0.8)]
    assert match.similarity("tide", "diet") == 0.25 and match.similarity("diet", "tide") == 0.5


def test_spec_rules():
    c = from_spec({"tables": {"t": {"columns": [{"name": "a", "type": "INT", "primary_key": True}], "indexes": [{"columns": ["a"]}]}, "u": {"primary_key": ["b"]}}})
    assert c.dialect == "generic" and [r[2] for r in c.table_rows] == [["a"], ["b"]] and c.index_rows[0][2] == "t_idx"
    assert from_spec({"tables": None}).names == []


def test_jdbc_and_parquet(spark, tmp_path):
    con = spark._jvm.java.sql.DriverManager.getConnection("jdbc:derby:memory:shop;create=true")
    st = con.createStatement()
    for s in ("CREATE TABLE P (ID INT NOT NULL PRIMARY KEY, NAME VARCHAR(20))", "CREATE TABLE C (ID INT NOT NULL PRIMARY KEY, P_ID INT REFERENCES P(ID), D DECIMAL(8,2) DEFAULT 1)", "INSERT INTO P VALUES (1, 'x')"):
        st.execute(s)
    con.close()
    cat, read = connect(spark, "jdbc:derby:memory:shop")
    assert cat.dialect == "derby" and cat.names == ["P", "C"] and cat.fk_rows[0][3:] == (["P_ID"], "P", ["ID"])
    assert [r[4] for r in cat.column_rows] == ["INTEGER", "VARCHAR(20)", "INTEGER", "INTEGER", "DECIMAL(8, 2)"]
    assert read("P").collect()[0].NAME == "x" and read("missing") is None
    con = spark._jvm.java.sql.DriverManager.getConnection("jdbc:derby:memory:shop")
    st = con.createStatement()
    st.execute("INSERT INTO P VALUES " + ", ".join(f"({i}, 'n{i}')" for i in range(2, 41)))
    con.close()
    parts = connect(spark, "jdbc:derby:memory:shop", partitions=3)[1]("P")
    assert parts.rdd.getNumPartitions() == 3 and sorted(r.ID for r in parts.collect()) == list(range(1, 41))
    spark.range(3).write.parquet(f"{tmp_path}/n.parquet")
    cat, read = connect(spark, f"parquet:{tmp_path}")
    assert cat.names == ["n"] and read("n").count() == 3
    spark.range(2).createOrReplaceTempView("seen")
    assert "seen" in connect(spark, "spark:")[0].names
    with pytest.raises(ValueError):
        connect(spark, "ftp:x")
