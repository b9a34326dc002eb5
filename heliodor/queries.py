"""Registered queries of the SQL engine over the driver's tables, and their DuckDB equivalents.

A query attaches whole tables (nothing is copied), runs its statements on one connection and
returns its SELECT as a DataFrame.
"""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import scripts
from .session import Session
from .sources.catalog import Registry, shared_root

MONEY = "DECIMAL(12, 2)"
TABLES = {
    "orders": [("o_orderkey", "INTEGER", "o_orderkey"), ("o_custkey", "INTEGER", "o_custkey"), ("o_orderstatus", "TEXT", "o_orderstatus"), ("o_totalprice", MONEY, "o_totalprice"), ("o_orderpriority", "TEXT", "o_orderpriority")],
    "customer": [("c_custkey", "INTEGER", "c_custkey"), ("c_name", "TEXT", "c_name"), ("c_nationkey", "INTEGER", "c_nationkey"), ("c_acctbal", MONEY, "c_acctbal"), ("c_mktsegment", "TEXT", "c_mktsegment")],
    "part": [("p_partkey", "INTEGER", "p_partkey"), ("p_name", "TEXT", "p_name"), ("p_brand", "TEXT", "p_brand"), ("p_type", "TEXT", "p_type"), ("p_size", "INTEGER", "p_size"), ("p_retailprice", MONEY, "p_retailprice")],
    "supplier": [("s_suppkey", "INTEGER", "s_suppkey"), ("s_name", "TEXT", "s_name"), ("s_nationkey", "INTEGER", "s_nationkey"), ("s_acctbal", MONEY, "s_acctbal")],
    "nation": [("n_nationkey", "INTEGER", "n_nationkey"), ("n_name", "TEXT", "n_name"), ("n_regionkey", "INTEGER", "n_regionkey")],
    "region": [("r_regionkey", "INTEGER", "r_regionkey"), ("r_name", "TEXT", "r_name")],
    "events": [("event_id", "INTEGER", "event_id"), ("user_id", "INTEGER", "user_id"), ("event_type", "TEXT", "event_type"), ("value", MONEY, "value"), ("props", "TEXT", "props")],
    "documents": [("doc_id", "INTEGER", "doc_id"), ("text", "TEXT", "text"), ("lang", "TEXT", "lang"), ("source", "TEXT", "source"), ("n_chars", "INTEGER", "n_chars")],
    "labels": [("doc_id", "INTEGER", "doc_id"), ("quality", "BOOLEAN", "quality = 1"), ("toxic", "BOOLEAN", "toxic = 1")],
    "benchmark": [("item_id", "INTEGER", "item_id"), ("text", "TEXT", "text")],
    "pages": [("page_id", "INTEGER", "page_id"), ("url", "TEXT", "url"), ("html", "TEXT", "html")],
}


def attach(session: Session, sf_dir: str, names: list[str]) -> None:
    for name in names:
        session.attach(name, f"{sf_dir}/{name}.parquet", TABLES[name])


def scratch(spark: SparkSession) -> Session:
    """A session on an empty database in the shared folder, deleted when the driver ends."""
    root = f"{shared_root(spark)}/heliodor-db-{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return Session(spark, Registry(root), "default")


def _run(table: str, *statements: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = scratch(spark)
        attach(session, sf_dir, [table])
        for sql in statements[:-1]:
            session.run(sql)
        return session.frame(statements[-1])

    return query


_ORDERS = "(SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(12,2)) AS o_totalprice, o_orderpriority FROM orders)"
_CUSTOMER = "(SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, CAST(c_acctbal AS DECIMAL(12,2)) AS c_acctbal, c_mktsegment FROM customer)"
_EVENTS = "(SELECT event_id, user_id, event_type, CAST(value AS DECIMAL(12,2)) AS value, props FROM events)"
_LABELS = "(SELECT doc_id, quality = 1 AS quality, toxic = 1 AS toxic FROM labels)"
_PART = "(SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, CAST(p_retailprice AS DECIMAL(12,2)) AS p_retailprice FROM part)"
_HOLES = "(SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderstatus <> 'F' THEN CAST(o_totalprice AS DECIMAL(12,2)) END AS o_totalprice, o_orderpriority FROM orders)"
_TO_NULL = "UPDATE orders SET o_totalprice = NULL WHERE o_orderstatus = 'F'"

# name: (table, statements, oracle)
_ALL: dict[str, tuple[str, list[str], str]] = {
    "scan_all": ("orders", ["SELECT * FROM orders"], f"SELECT * FROM {_ORDERS}"),
    "scan_documents": ("documents", ["SELECT * FROM documents"], "SELECT doc_id, text, lang, source, n_chars FROM documents"),
    "scan_events": ("events", ["SELECT * FROM events"], f"SELECT * FROM {_EVENTS}"),
    "scan_pages": ("pages", ["SELECT page_id, url FROM pages"], "SELECT page_id, url FROM pages"),
    "scan_region": ("region", ["SELECT * FROM region"], "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region"),
    "project_order": ("orders", ["SELECT o_orderstatus, o_orderkey FROM orders"], f"SELECT o_orderstatus, o_orderkey FROM {_ORDERS}"),
    "project_repeat": ("orders", ["SELECT o_orderkey, o_orderkey FROM orders"], f"SELECT o_orderkey, o_orderkey AS o_orderkey_2 FROM {_ORDERS}"),
    "pk_point": ("orders", ["SELECT * FROM orders WHERE o_orderkey = 100"], f"SELECT * FROM {_ORDERS} WHERE o_orderkey = 100"),
    "pk_range_open": ("orders", ["SELECT o_orderkey FROM orders WHERE o_orderkey > 900"], f"SELECT o_orderkey FROM {_ORDERS} WHERE o_orderkey > 900"),
    "pk_range_closed": ("orders", ["SELECT * FROM orders WHERE o_orderkey >= 50 AND o_orderkey <= 500"], f"SELECT * FROM {_ORDERS} WHERE o_orderkey BETWEEN 50 AND 500"),
    "pk_literal_left": ("orders", ["SELECT * FROM orders WHERE 300 > o_orderkey"], f"SELECT * FROM {_ORDERS} WHERE o_orderkey < 300"),
    "cmp_eq": ("orders", ["SELECT * FROM orders WHERE o_orderstatus = 'F'"], f"SELECT * FROM {_ORDERS} WHERE o_orderstatus = 'F'"),
    "cmp_ne": ("orders", ["SELECT * FROM orders WHERE o_orderstatus != 'F'"], f"SELECT * FROM {_ORDERS} WHERE o_orderstatus <> 'F'"),
    "cmp_lt": ("orders", ["SELECT * FROM orders WHERE o_custkey < 70"], f"SELECT * FROM {_ORDERS} WHERE o_custkey < 70"),
    "cmp_le": ("orders", ["SELECT * FROM orders WHERE o_custkey <= 70"], f"SELECT * FROM {_ORDERS} WHERE o_custkey <= 70"),
    "cmp_gt": ("orders", ["SELECT * FROM orders WHERE o_totalprice > 250000.00"], f"SELECT * FROM {_ORDERS} WHERE o_totalprice > 250000"),
    "cmp_ge": ("orders", ["SELECT * FROM orders WHERE o_totalprice >= 250000.00"], f"SELECT * FROM {_ORDERS} WHERE o_totalprice >= 250000"),
    "text_cmp_bytes": ("customer", ["SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment >= 'BUILDING'"], f"SELECT c_custkey, c_mktsegment FROM {_CUSTOMER} WHERE c_mktsegment >= 'BUILDING'"),
    "bool_cmp": ("labels", ["SELECT doc_id FROM labels WHERE toxic < quality"], f"SELECT doc_id FROM {_LABELS} WHERE toxic < quality"),
    "decimal_cmp_scale": ("customer", ["SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal <= 1234.5678"], f"SELECT c_custkey, c_acctbal FROM {_CUSTOMER} WHERE c_acctbal <= 1234.5678"),
    "and_3vl": ("orders", [_TO_NULL, "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000.00 AND o_custkey > 50"], f"SELECT o_orderkey FROM {_HOLES} WHERE o_totalprice > 100000 AND o_custkey > 50"),
    "or_3vl": ("orders", [_TO_NULL, "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000.00 OR o_custkey > 50"], f"SELECT o_orderkey FROM {_HOLES} WHERE o_totalprice > 100000 OR o_custkey > 50"),
    "not_3vl": ("orders", [_TO_NULL, "SELECT o_orderkey FROM orders WHERE NOT o_totalprice > 100000.00"], f"SELECT o_orderkey FROM {_HOLES} WHERE NOT o_totalprice > 100000"),
    "is_null": ("orders", [_TO_NULL, "SELECT * FROM orders WHERE o_totalprice IS NULL"], f"SELECT * FROM {_HOLES} WHERE o_totalprice IS NULL"),
    "is_not_null": ("orders", [_TO_NULL, "SELECT * FROM orders WHERE o_totalprice IS NOT NULL"], f"SELECT * FROM {_HOLES} WHERE o_totalprice IS NOT NULL"),
    "condition_is_null": ("orders", [_TO_NULL, "SELECT o_orderkey FROM orders WHERE (o_totalprice > 5.00) IS NULL"], f"SELECT o_orderkey FROM {_HOLES} WHERE (o_totalprice > 5) IS NULL"),
    "nested_condition_value": ("orders", ["SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F') = (o_custkey < 60)"], f"SELECT o_orderkey FROM {_ORDERS} WHERE (o_orderstatus = 'F') = (o_custkey < 60)"),
    "bare_boolean": ("labels", ["SELECT * FROM labels WHERE NOT toxic AND quality"], f"SELECT * FROM {_LABELS} WHERE NOT toxic AND quality"),
    "type_mismatch_unknown": ("orders", ["SELECT o_orderkey FROM orders WHERE o_totalprice > 2 OR o_custkey = 'x' OR o_orderkey < 40"], f"SELECT o_orderkey FROM {_ORDERS} WHERE o_orderkey < 40"),
    "mismatch_is_null": ("orders", ["SELECT o_orderkey FROM orders WHERE (o_custkey = 1.00) IS NULL"], f"SELECT o_orderkey FROM {_ORDERS}"),
    "col_vs_col": ("part", ["SELECT p_partkey, p_size FROM part WHERE p_partkey < p_size"], f"SELECT p_partkey, p_size FROM {_PART} WHERE p_partkey < p_size"),
    "literal_vs_literal": ("nation", ["SELECT n_name FROM nation WHERE 1 = 1 AND 'a' < 'b'"], "SELECT n_name FROM nation"),
    "default_order_limit": ("orders", ["SELECT * FROM orders LIMIT 25"], f"SELECT * FROM {_ORDERS} ORDER BY o_orderkey LIMIT 25"),
    "order_pk_desc_limit": ("orders", ["SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 25"], f"SELECT * FROM {_ORDERS} ORDER BY o_orderkey DESC LIMIT 25"),
    "order_text_limit": ("customer", ["SELECT * FROM customer ORDER BY c_mktsegment LIMIT 40"], f"SELECT * FROM {_CUSTOMER} ORDER BY c_mktsegment, c_custkey LIMIT 40"),
    "order_long_text_limit": ("documents", ["SELECT doc_id, text FROM documents ORDER BY text DESC LIMIT 30"], "SELECT doc_id, text FROM documents ORDER BY text DESC, doc_id LIMIT 30"),
    "order_decimal_desc_nulls": ("orders", [_TO_NULL, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 900"], f"SELECT o_orderkey, o_totalprice FROM {_HOLES} ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 900"),
    "order_decimal_asc_nulls": ("orders", [_TO_NULL, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice ASC LIMIT 900"], f"SELECT o_orderkey, o_totalprice FROM {_HOLES} ORDER BY o_totalprice NULLS LAST, o_orderkey LIMIT 900"),
    "order_whole_table": ("orders", ["SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC"], f"SELECT o_orderkey, o_totalprice FROM {_ORDERS} ORDER BY o_totalprice DESC, o_orderkey"),
    "order_hidden_column": ("orders", ["SELECT o_orderkey FROM orders ORDER BY o_totalprice LIMIT 20"], f"SELECT o_orderkey FROM {_ORDERS} ORDER BY o_totalprice, o_orderkey LIMIT 20"),
    "limit_zero": ("orders", ["SELECT o_orderkey FROM orders WHERE nothing LIMIT 0"], "SELECT o_orderkey FROM orders LIMIT 0"),
    "limit_past_end": ("supplier", ["SELECT s_suppkey, s_name FROM supplier LIMIT 18446744073709551615"], "SELECT s_suppkey, s_name FROM supplier"),
    "filtered_top_k": ("orders", ["SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey <= 5000 AND NOT o_orderstatus = 'F' ORDER BY o_totalprice DESC LIMIT 10"], f"SELECT o_orderkey, o_totalprice FROM {_ORDERS} WHERE o_orderkey <= 5000 AND NOT o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "insert_then_read": ("nation", ["INSERT INTO nation (n_nationkey, n_name, n_regionkey) VALUES (900, 'it''s', 1), (901, 'Ω', 2)", "SELECT * FROM nation"], "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation UNION ALL VALUES (900, 'it''s', 1), (901, 'Ω', 2)"),
    "insert_omitted_null": ("nation", ["INSERT INTO nation (n_nationkey, n_regionkey) VALUES (900, 1)", "SELECT n_nationkey, n_name FROM nation"], "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation UNION ALL SELECT 900, NULL"),
    "update_where": ("orders", ["UPDATE orders SET o_orderstatus = 'X', o_totalprice = 1.5 WHERE o_custkey < 60", "SELECT * FROM orders"], f"SELECT o_orderkey, o_custkey, CASE WHEN o_custkey < 60 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_custkey < 60 THEN CAST(1.5 AS DECIMAL(12,2)) ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM {_ORDERS}"),
    "update_all": ("orders", ["UPDATE orders SET o_orderpriority = 'none'", "SELECT o_orderkey, o_orderpriority FROM orders"], "SELECT o_orderkey, 'none' AS o_orderpriority FROM orders"),
    "update_pk_move": ("nation", ["UPDATE nation SET n_nationkey = 500 WHERE n_nationkey = 3", "SELECT n_nationkey, n_name FROM nation"], "SELECT CASE WHEN n_nationkey = 3 THEN 500 ELSE CAST(n_nationkey AS BIGINT) END AS n_nationkey, n_name FROM nation"),
    "delete_where": ("orders", ["DELETE FROM orders WHERE o_orderstatus = 'F'", "SELECT * FROM orders"], f"SELECT * FROM {_ORDERS} WHERE o_orderstatus <> 'F'"),
    "delete_all": ("supplier", ["DELETE FROM supplier", "SELECT s_suppkey FROM supplier"], "SELECT s_suppkey FROM supplier LIMIT 0"),
    "txn_commit": ("nation", ["BEGIN", "DELETE FROM nation WHERE n_regionkey = 1", "INSERT INTO nation (n_nationkey) VALUES (777)", "COMMIT", "SELECT n_nationkey FROM nation"], "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 777"),
    "txn_rollback": ("nation", ["BEGIN", "DELETE FROM nation", "ROLLBACK", "SELECT n_nationkey FROM nation"], "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation"),
    "txn_read_own_writes": ("orders", ["BEGIN", "UPDATE orders SET o_custkey = -1 WHERE o_orderstatus = 'O'", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = -1"], "SELECT o_orderkey, CAST(-1 AS BIGINT) AS o_custkey FROM orders WHERE o_orderstatus = 'O'"),
}


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a read-only transaction sees after another connection has changed the table."""
    reader = scratch(spark)
    attach(reader, sf_dir, ["nation"])
    writer = Session(spark, reader.registry, "default")
    reader.run("BEGIN READ ONLY")
    writer.run("DELETE FROM nation WHERE n_regionkey = 0")
    return reader.frame("SELECT n_nationkey, n_name FROM nation")


def _failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A failed statement changes nothing."""
    from .functions.errors import DbError

    session = scratch(spark)
    attach(session, sf_dir, ["nation"])
    try:
        session.run("INSERT INTO nation (n_nationkey) VALUES (800), (801), (1)")
    except DbError as e:
        assert e.code == "DUPLICATE_KEY"
    return session.frame("SELECT n_nationkey, n_name FROM nation")


_NATION = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation"
QUERIES = {name: _run(table, *statements) for name, (table, statements, _) in _ALL.items()} | {"snapshot_read": _snapshot, "failed_stmt_no_change": _failed}
ORACLE_SQL = {name: oracle for name, (_, _, oracle) in _ALL.items()} | {"snapshot_read": _NATION, "failed_stmt_no_change": _NATION}
_QUERIES, _ORACLES = scripts.queries(scratch)
QUERIES |= _QUERIES
ORACLE_SQL |= _ORACLES
