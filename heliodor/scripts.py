"""Registered queries that are scripts: statements run one after another on an empty database, and what each must give.

A script is text. ``-- name`` begins one; a line ``[who] statement => outcome`` runs a statement on the connection
of that name (``a`` if none is given). Outcomes: ``ok``, ``ok n`` (rows changed), an error code with the character it is at, or
the rows, with ``|`` between values and ``;`` between rows. The result is one row a statement; the
equivalent SQL is the list of the outcomes that must come.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .functions.errors import DbError
from .functions.values import shown
from .session import Session

_SCRIPTS = r"""
-- script_projection_errors
CREATE TABLE crate (id INTEGER PRIMARY KEY, tag TEXT, full BOOLEAN, mass DECIMAL(6, 2)) => ok
SELECT weight FROM crate => UNKNOWN_COLUMN
SELECT id, weight FROM crate LIMIT 0 => UNKNOWN_COLUMN
SELECT Id FROM crate => UNKNOWN_COLUMN
SELECT * FROM crates => UNKNOWN_TABLE
SELECT * FROM crate => none
INSERT INTO crate (id, tag, full, mass) VALUES (3, 'oak', true, 1.50), (1, 'ash', false, NULL), (2, NULL, NULL, 20.0) => ok 3
SELECT mass, id, mass FROM crate => NULL|1|NULL; 20.0|2|20.0; 1.50|3|1.50
-- script_where_errors
CREATE TABLE crate (id INTEGER PRIMARY KEY, tag TEXT, full BOOLEAN, mass DECIMAL(6, 2)) => ok
SELECT id FROM crate WHERE tag => none
SELECT id FROM crate WHERE weight = 1 => none
INSERT INTO crate (id, tag, full) VALUES (1, NULL, true), (2, 'elm', NULL) => ok 2
SELECT id FROM crate WHERE tag => TYPE_MISMATCH
SELECT id FROM crate WHERE tag AND id < 2 => none
SELECT id FROM crate WHERE weight = 1 => UNKNOWN_COLUMN
SELECT id FROM crate WHERE weight = 1 LIMIT 0 => none
SELECT id FROM crate WHERE full AND 7 => TYPE_MISMATCH
SELECT id FROM crate WHERE full => 1
SELECT id FROM crate WHERE tag = 5 => none
SELECT id FROM crate WHERE (tag = 5) IS NULL => 1; 2
SELECT id FROM crate WHERE id = 'x' => TYPE_MISMATCH
SELECT id FROM crate WHERE id != 'x' => none
-- script_order
CREATE TABLE crate (id INTEGER PRIMARY KEY, tag TEXT, mass DECIMAL(6, 2)) => ok
SELECT id FROM crate ORDER BY weight => UNKNOWN_COLUMN
SELECT weight FROM crate ORDER BY height LIMIT 0 => UNKNOWN_COLUMN
INSERT INTO crate (id, tag, mass) VALUES (4, 'b', 2.0), (1, 'B', 2.00), (3, NULL, 10.5), (2, 'é', NULL) => ok 4
SELECT id FROM crate => 1; 2; 3; 4
SELECT id FROM crate ORDER BY id DESC => 4; 3; 2; 1
SELECT id FROM crate ORDER BY tag => 1; 4; 2; 3
SELECT id FROM crate ORDER BY tag DESC => 3; 2; 4; 1
SELECT id FROM crate ORDER BY mass => 1; 4; 3; 2
SELECT id FROM crate ORDER BY mass DESC LIMIT 3 => 2; 3; 1
-- script_insert_checks
CREATE TABLE crate (id INTEGER PRIMARY KEY, tag TEXT NOT NULL, mass DECIMAL(4, 1)) => ok
INSERT INTO crates (id) VALUES (1) => UNKNOWN_TABLE
INSERT INTO crate (id, weight) VALUES (1, 2) => UNKNOWN_COLUMN
INSERT INTO crate (id) VALUES (1) => NOT_NULL_VIOLATION
INSERT INTO crate (tag) VALUES ('a') => NOT_NULL_VIOLATION
INSERT INTO crate (id, tag) VALUES ('1', 'a') => TYPE_MISMATCH
INSERT INTO crate (id, tag, mass) VALUES (1, 'a', 1.25) => TYPE_MISMATCH
INSERT INTO crate (id, tag, mass) VALUES (1, 'a', 1234.0) => TYPE_MISMATCH
INSERT INTO crate (id, tag) VALUES (1, 'a'), (1, 'b') => DUPLICATE_KEY
SELECT * FROM crate => none
INSERT INTO crate (id, tag, mass) VALUES (1, 'a', -0.5), (2, '', NULL) => ok 2
INSERT INTO crate (id, tag) VALUES (3, 'c'), (2, 'd') => DUPLICATE_KEY
SELECT * FROM crate => 1|a|-0.5; 2||NULL
-- script_update_delete_counts
CREATE TABLE crate (id INTEGER PRIMARY KEY, tag TEXT NOT NULL, full BOOLEAN) => ok
INSERT INTO crate (id, tag, full) VALUES (1, 'a', true), (2, 'b', false), (3, 'c', NULL) => ok 3
UPDATE crate SET tag = 'x', tag = 'y' WHERE id > 1 => ok 2
SELECT id, tag FROM crate => 1|a; 2|y; 3|y
UPDATE crate SET tag = 'z' WHERE full => ok 1
UPDATE crate SET tag = 'z' WHERE id = 77 => ok 0
UPDATE crate SET tag = NULL WHERE id = 77 => NOT_NULL_VIOLATION
UPDATE crate SET full = 1 WHERE id = 77 => TYPE_MISMATCH
UPDATE crate SET weight = 1 => UNKNOWN_COLUMN
UPDATE crate SET id = 9 => DUPLICATE_KEY
UPDATE crate SET id = 2 WHERE id = 1 => DUPLICATE_KEY
UPDATE crate SET id = 9 WHERE id = 1 => ok 1
DELETE FROM crate WHERE NOT full => ok 1
DELETE FROM crate => ok 2
DELETE FROM crate => ok 0
-- script_tables
CREATE TABLE crate (id INTEGER PRIMARY KEY) => ok
CREATE TABLE crate (id INTEGER PRIMARY KEY) => TABLE_EXISTS
CREATE TABLE Crate (tag TEXT, id INTEGER NOT NULL PRIMARY KEY) => ok
DROP TABLE crate => ok
DROP TABLE crate => UNKNOWN_TABLE
SELECT * FROM crate => UNKNOWN_TABLE
CREATE TABLE crate (tag TEXT PRIMARY KEY) => ok
INSERT INTO crate (tag) VALUES ('new') => ok 1
SELECT * FROM crate => new
SELECT * FROM Crate => none
-- script_databases
CREATE DATABASE yard => ok
CREATE DATABASE YARD => DATABASE_EXISTS
DROP DATABASE shed => UNKNOWN_DATABASE
[b@yard] CREATE TABLE crate (id INTEGER PRIMARY KEY) => ok
SELECT * FROM crate => UNKNOWN_TABLE
DROP DATABASE yard => DATABASE_IN_USE
[b] close => ok
DROP DATABASE yard => ok
[c@yard] SELECT * FROM crate => UNKNOWN_DATABASE
-- script_transactions
CREATE TABLE crate (id INTEGER PRIMARY KEY) => ok
BEGIN => ok
BEGIN => TXN_ALREADY_OPEN
CREATE TABLE other (id INTEGER PRIMARY KEY) => SCHEMA_CHANGE_IN_TXN
INSERT INTO crate (id) VALUES (1) => ok 1
[b] SELECT * FROM crate => none
SELECT * FROM crate => 1
[b] INSERT INTO crate (id) VALUES (2) => LOCK_TIMEOUT
COMMIT => ok
[b] SELECT * FROM crate => 1
[b] BEGIN READ ONLY => ok
DELETE FROM crate => ok 1
[b] SELECT * FROM crate => 1
[b] DELETE FROM crate => READ_ONLY_TXN
[b] SELECT * FROM crate => 1
[b] COMMIT => ok
[b] SELECT * FROM crate => none
-- script_aborted_transaction
CREATE TABLE crate (id INTEGER PRIMARY KEY) => ok
BEGIN => ok
INSERT INTO crate (id) VALUES (1) => ok 1
SELECT nothing FROM crate => UNKNOWN_COLUMN
SELECT FROM crate => SYNTAX_ERROR at 8
SELECT * FROM crate => 1
INSERT INTO crate (id) VALUES (1) => DUPLICATE_KEY
SELECT * FROM crate => TXN_ABORTED
INSERT INTO crate (id) VALUES (2) => TXN_ABORTED
COMMIT => TXN_ABORTED
SELECT * FROM crate => none
BEGIN => ok
INSERT INTO crate (id) VALUES (5) => ok 1
close => ok
[b] SELECT * FROM crate => none
-- script_connections
[b] BEGIN => ok
[c] BEGIN => LOCK_TIMEOUT
[d] SELECT * FROM crate => UNKNOWN_TABLE
[e] SELECT * FROM crate => TOO_MANY_CONNECTIONS
[b] close => ok
[e] COMMIT => SYNTAX_ERROR
[c] BEGIN => ok
-- script_syntax_positions
SELECT * FORM crate => SYNTAX_ERROR at 10
SELECT * FROM crate WHERE => SYNTAX_ERROR at 26
SELECT * FROM crate extra => SYNTAX_ERROR at 21
SELECT * FROM crate LIMIT -1 => SYNTAX_ERROR at 27
SELECT * FROM crate WHERE id = 'open => SYNTAX_ERROR at 32
SELECT * FROM crate WHERE id == 1 => SYNTAX_ERROR at 31
select id from crate => UNKNOWN_TABLE
INSERT INTO crate VALUES (1) => SYNTAX_ERROR at 19
CREATE TABLE t (id FLOAT PRIMARY KEY) => SYNTAX_ERROR at 20
CREATE TABLE t (id DECIMAL(39, 0) PRIMARY KEY) => SYNTAX_ERROR at 20
nonsense => SYNTAX_ERROR at 1
-- script_refused
CREATE TABLE crate (id INTEGER PRIMARY KEY, n INTEGER) => ok
SELECT DISTINCT n FROM crate => SYNTAX_ERROR at 17
SELECT COUNT(*) FROM crate => SYNTAX_ERROR at 13
SELECT n + 1 FROM crate => SYNTAX_ERROR at 10
SELECT id AS key FROM crate => SYNTAX_ERROR at 11
SELECT id FROM crate, crate => SYNTAX_ERROR at 21
SELECT id FROM crate JOIN crate => SYNTAX_ERROR at 22
SELECT n FROM crate GROUP BY n => SYNTAX_ERROR at 21
SELECT id FROM crate WHERE id IN (1) => SYNTAX_ERROR at 31
SELECT id FROM crate WHERE id BETWEEN 1 AND 2 => SYNTAX_ERROR at 31
SELECT id FROM crate WHERE n LIKE 'a' => SYNTAX_ERROR at 30
SELECT id FROM crate ORDER BY n, id => SYNTAX_ERROR at 32
SELECT id FROM crate LIMIT 1 OFFSET 1 => SYNTAX_ERROR at 30
SELECT id FROM crate UNION SELECT id FROM crate => SYNTAX_ERROR at 22
CREATE TABLE IF NOT EXISTS t (id INTEGER PRIMARY KEY) => SYNTAX_ERROR at 17
ALTER TABLE crate ADD x INTEGER => SYNTAX_ERROR at 1
-- script_literals
CREATE TABLE crate (id INTEGER PRIMARY KEY, tag TEXT, mass DECIMAL(38, 10), full BOOLEAN) => ok
INSERT INTO crate (id, tag, mass, full) VALUES (-9223372036854775808, 'it''s', -0.10, TRUE) => ok 1
INSERT INTO crate (id, tag, mass) VALUES (9223372036854775807, 'Ω ;', 1234567890123456789012345678.0123456789) => ok 1
INSERT INTO crate (id) VALUES (9223372036854775808) => SYNTAX_ERROR at 32
SELECT * FROM crate => -9223372036854775808|it's|-0.10|true; 9223372036854775807|Ω ;|1234567890123456789012345678.0123456789|NULL
"""

_LINE = re.compile(r"(?:\[(\w+)(?:@(\w+))?\] )?(.*) => (.*)")


def _parse(text: str) -> dict[str, list[tuple[str, str, str, str]]]:
    """name: (connection, database, statement, outcome) of each line."""
    out: dict[str, list] = {}
    for line in filter(None, text.split("\n")):
        if line.startswith("-- "):
            steps = out[line[3:]] = []
        else:
            who, base, statement, outcome = _LINE.fullmatch(line).groups()
            steps.append((who or "a", base or "default", statement, outcome))
    return out


SCRIPTS = _parse(_SCRIPTS)


def _outcome(session: Session, statement: str) -> str:
    result = session.run(statement)
    if result.rows is not None:
        return "; ".join("|".join(map(shown, r)) for r in result.rows) or "none"
    return f"ok {result.count}" if statement.split()[0] in ("INSERT", "UPDATE", "DELETE") else "ok"


def outcomes(first: Session, steps: list[tuple[str, str, str, str]]) -> list[str]:
    sessions, out = {"a": first}, []
    for who, base, statement, _ in steps:
        try:
            if who not in sessions:
                sessions[who] = Session(first.spark, first.registry, base)
            if statement == "close":
                sessions.pop(who).close()
                out.append("ok")
            else:
                out.append(_outcome(sessions[who], statement))
        except DbError as e:
            out.append(e.code + (f" at {e.position}" if e.position else ""))
    for session in sessions.values():
        session.close()
    return out


def _query(name: str, scratch: Callable[[SparkSession], Session]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        first = scratch(spark)
        # Few connections and short waits, so that both limits can be met.
        first.registry.max_connections, first.registry.lock_timeout = 4, 0.2
        found = outcomes(first, SCRIPTS[name])
        rows = [(i + 1, s[0], s[2], o) for i, (s, o) in enumerate(zip(SCRIPTS[name], found))]
        return spark.createDataFrame(rows, "step int, connection string, statement string, outcome string")

    return run


def _oracle(name: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i + 1}, {quoted(w)}, {quoted(s)}, {quoted(o)})" for i, (w, _, s, o) in enumerate(SCRIPTS[name]))
    return f"SELECT CAST(step AS INTEGER) AS step, connection, statement, outcome FROM (VALUES {rows}) t(step, connection, statement, outcome)"


def queries(scratch: Callable[[SparkSession], Session]) -> tuple[dict, dict]:
    """Queries and their equivalents; scratch makes a session on an empty database."""
    return {n: _query(n, scratch) for n in SCRIPTS}, {n: _oracle(n) for n in SCRIPTS}
