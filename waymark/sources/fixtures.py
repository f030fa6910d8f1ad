"""Declared catalogs: of the driver's tables (Parquet holds no keys), and of a redesigned target for them."""

from __future__ import annotations

from .catalog import Catalog, from_spec


def _table(columns: str, key: str = "", fks: str = "", indexes: str = "") -> dict:
    """columns: "name TYPE!" parted by ;, ! meaning NOT NULL. fks: "a,b>table(c,d)" parted by ;."""
    cols = []
    for c in columns.split(";"):
        name, kind = c.strip().split(" ", 1)
        cols.append({"name": name, "type": kind.rstrip("!"), "nullable": not kind.endswith("!"), "primary_key": name in key.split(",")})
    out = {"columns": cols, "primary_key": [k for k in key.split(",") if k], "foreign_keys": [], "indexes": []}
    for f in filter(None, fks.split(";")):
        own, other = f.split(">")
        table, theirs = other.rstrip(")").split("(")
        out["foreign_keys"].append({"constrained_columns": own.split(","), "referred_table": table, "referred_columns": theirs.split(",")})
    for ix in filter(None, indexes.split(";")):
        out["indexes"].append({"name": None, "columns": ix.split(",")})
    return out


SOURCE = {
    "dialect": "sqlite",
    "tables": {
        "region": _table("r_regionkey INTEGER!;r_name VARCHAR(25)!", "r_regionkey"),
        "nation": _table("n_nationkey INTEGER!;n_name VARCHAR(25)!;n_regionkey INTEGER!", "n_nationkey", "n_regionkey>region(r_regionkey)"),
        "customer": _table("c_custkey BIGINT!;c_name VARCHAR(255)!;c_nationkey INTEGER!;c_acctbal NUMERIC(15, 2);c_mktsegment VARCHAR(10)", "c_custkey", "c_nationkey>nation(n_nationkey)"),
        "supplier": _table("s_suppkey BIGINT!;s_name VARCHAR(25)!;s_nationkey INTEGER!;s_acctbal NUMERIC(15, 2)", "s_suppkey", "s_nationkey>nation(n_nationkey)"),
        "part": _table("p_partkey BIGINT!;p_name VARCHAR(55);p_brand CHAR(10);p_type VARCHAR(25);p_size INTEGER;p_retailprice NUMERIC(15, 2)", "p_partkey"),
        "orders": _table("o_orderkey BIGINT!;o_custkey BIGINT!;o_orderstatus CHAR(1);o_totalprice NUMERIC(15, 2);o_orderdate DATETIME;o_orderpriority VARCHAR(15)", "o_orderkey", "o_custkey>customer(c_custkey)", "o_orderdate"),
        "lineitem": _table("l_orderkey BIGINT!;l_partkey BIGINT!;l_suppkey BIGINT!;l_linenumber INTEGER!;l_quantity NUMERIC(15, 2);l_extendedprice NUMERIC(15, 2);l_discount NUMERIC(15, 2);l_tax NUMERIC(15, 2);l_returnflag CHAR(1);l_linestatus CHAR(1);l_shipdate DATETIME", "", "l_orderkey>orders(o_orderkey);l_partkey>part(p_partkey);l_suppkey>supplier(s_suppkey)"),
        "events": _table("event_id BIGINT!;ts DATETIME;user_id BIGINT;event_type VARCHAR(20);value DOUBLE;props JSON", "event_id"),
        "documents": _table("doc_id BIGINT!;text TEXT;lang CHAR(2);source VARCHAR(20);n_chars BIGINT", "doc_id"),
        "labels": _table("doc_id BIGINT!;quality INTEGER;toxic INTEGER", "doc_id", "doc_id>documents(doc_id)"),
        "benchmark": _table("item_id BIGINT!;text TEXT", "item_id"),
        "pages": _table("page_id BIGINT!;url VARCHAR(200);html TEXT", "page_id"),
        "conversations": _table("conv_id BIGINT!;turn BIGINT!;role VARCHAR(10);text TEXT", "conv_id,turn"),
        "embeddings": _table("vec_id BIGINT!;embedding FLOAT[];label INTEGER", "vec_id"),
    },
}

TARGET = {
    "dialect": "postgresql",
    "tables": {
        "region": _table("r_regionkey INTEGER!;r_name VARCHAR(25)!", "r_regionkey"),
        "nation": _table("n_nationkey INTEGER!;n_name VARCHAR(25)!;n_regionkey INTEGER!", "n_nationkey", "n_regionkey>region(r_regionkey)"),
        "crm_customer": _table("c_custkey BIGINT!;c_fullname VARCHAR(20)!;c_nation_key INTEGER!;c_acct_balance DECIMAL(10,2);c_loyalty_tier VARCHAR(20)", "c_custkey", "c_nation_key>nation(n_nationkey)"),
        "suppliers": _table("s_suppkey BIGINT!;s_name VARCHAR(25)!;s_nationkey INTEGER!;s_acctbal DECIMAL(15,2)", "s_suppkey"),
        "parts_v2": _table("p_partkey BIGINT!;p_name VARCHAR(55)", "p_partkey"),
        "orders": _table("o_orderkey BIGINT!;o_custkey BIGINT!;o_order_status CHAR(1)!;o_total_price DECIMAL(15,2);o_orderdate TIMESTAMP", "o_orderkey", "o_custkey>crm_customer(c_custkey)"),
        "line_items": _table("l_orderkey BIGINT!;l_partkey BIGINT!;l_suppkey BIGINT!;l_linenumber INTEGER!;l_quantity DECIMAL(15,2);l_extendedprice DECIMAL(15,2);l_discount DECIMAL(4,2);l_tax DECIMAL(4,2);l_returnflag CHAR(1);l_linestatus CHAR(1);l_shipdate TIMESTAMP", ""),
        "documents": _table("doc_id BIGINT!;text TEXT;lang CHAR(2);source VARCHAR(20);n_chars BIGINT", "doc_id"),
        "audit_log": _table("id BIGINT!;event_type VARCHAR(50)!;payload JSON", "id"),
    },
}

#: a graph with two cycles, a table behind one of them, and an order that names alone don't give
CYCLIC = {
    "tables": {
        t: _table("id INTEGER!", "id", ";".join(f"id>{r}(id)" for r in refs.split()))
        for t, refs in {"m": "n", "n": "m", "behind": "m b", "a": "", "b": "", "z": "a", "c": "b", "self": "self", "x1": "x2 gone", "x2": "x3", "x3": "x1"}.items()
    }
}


def source() -> Catalog:
    return from_spec(SOURCE)


def target() -> Catalog:
    return from_spec(TARGET)


def cyclic() -> Catalog:
    return from_spec(CYCLIC)
