"""The engine behind a socket: one JSON object a line.

A client sends startup, query, cancel or close; the server answers ready, rowdesc, datarow,
complete or error. Every connection has a thread and a session; Spark runs their jobs side by side.
"""

from __future__ import annotations

import argparse
import json
import logging
import secrets
import socketserver
import threading
import time

from .functions.errors import DbError
from .functions.values import to_wire
from .session import Session
from .sources.catalog import Registry

VERSION = 1
log = logging.getLogger("heliodor.server")

# Client messages and the types of their members.
MESSAGES = {"startup": {"version": int, "database": str}, "query": {"sql": str}, "cancel": {"conn_id": int, "secret": str}, "close": {}}


def read_message(line: str) -> dict:
    """A client message, or SYNTAX_ERROR."""
    try:
        message = json.loads(line)
        members = MESSAGES[message["type"]]
        if all(type(message[k]) is t for k, t in members.items()):
            return message
    except (ValueError, KeyError, TypeError):
        pass
    raise DbError("SYNTAX_ERROR", "the line is not a message")


def error_message(e: DbError) -> dict:
    return {"type": "error", "code": e.code, "message": e.message, "position": e.position}


class _Handler(socketserver.StreamRequestHandler):
    def send(self, message: dict) -> None:
        if message["type"] == "error":
            log.error("connection %s: %s: %s", self.number, message["code"], message["message"])
        self.wfile.write(json.dumps(message, ensure_ascii=False).encode() + b"\n")

    def lines(self):
        for raw in self.rfile:
            yield raw.decode(errors="replace").rstrip("\n")

    def handle(self) -> None:
        self.number = self.server.next_number()
        log.info("connection %s opens", self.number)
        try:
            self.converse()
        except OSError:
            pass
        finally:
            log.info("connection %s closes", self.number)

    def converse(self) -> None:
        lines = self.lines()
        try:
            first = read_message(next(lines, ""))
            if first["type"] == "cancel":
                return self.server.cancel(first["conn_id"], first["secret"])
            if first["type"] != "startup":
                raise DbError("SYNTAX_ERROR", "the first message must be startup or cancel")
            if first["version"] != VERSION:
                raise DbError("SYNTAX_ERROR", f"protocol version {first['version']} is not spoken")
            session = Session(self.server.spark, self.server.registry, first["database"])
        except DbError as e:
            return self.send(error_message(e))
        secret = secrets.token_hex(16)
        with self.server.guard:
            self.server.live[self.number] = (secret, session)
        try:
            self.ready(session, secret)
            for line in lines:
                try:
                    message = read_message(line)
                    if message["type"] == "close":
                        return
                    if message["type"] != "query":
                        raise DbError("SYNTAX_ERROR", f"{message['type']} is not expected here")
                    self.answer(session, message["sql"])
                except DbError as e:
                    self.send(error_message(e))
                self.ready(session, secret)
        finally:
            with self.server.guard:
                del self.server.live[self.number]
            session.close()

    def ready(self, session: Session, secret: str) -> None:
        self.send({"type": "ready", "conn_id": self.number, "secret": secret, "tx": session.state})

    def answer(self, session: Session, sql: str) -> None:
        result = session.run(sql)
        count = result.count
        if result.rows is not None:
            self.send({"type": "rowdesc", "cols": [{"name": n, "ty": str(t)} for n, t in zip(result.names, result.types)]})
            for row in result.rows:
                self.send({"type": "datarow", "values": [to_wire(v) for v in row]})
                count += 1
        self.send({"type": "complete", "kind": result.kind, "rows": count})


class Server(socketserver.ThreadingTCPServer):
    daemon_threads, allow_reuse_address = True, True

    def __init__(self, spark, registry: Registry, host: str = "127.0.0.1", port: int = 0):
        super().__init__((host, port), _Handler)
        self.spark, self.registry = spark, registry
        self.guard, self.live, self.number = threading.Lock(), {}, 0

    def next_number(self) -> int:
        with self.guard:
            self.number += 1
            return self.number

    def cancel(self, number: int, secret: str) -> None:
        with self.guard:
            held = self.live.get(number)
        found = held is not None and secrets.compare_digest(held[0], secret)
        log.info("cancel of connection %s: match %s", number, found)
        if found:
            held[1].cancel()


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--data-dir", required=True)
    p.add_argument("--port", type=int, default=5480)
    p.add_argument("--max-connections", type=int, default=100)
    p.add_argument("--lock-timeout-ms", type=int, default=5000)
    for flag in ("--checkpoint-bytes", "--sort-bytes"):
        p.add_argument(flag, type=int, help="accepted and unused: there is no log to checkpoint, and Spark spills its sorts itself")
    o = p.parse_args(args)
    logging.Formatter.converter = time.gmtime
    logging.basicConfig(level=logging.INFO, format="%(asctime)sZ %(levelname)s %(message)s")
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("heliodor").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    registry = Registry(o.data_dir, o.max_connections, o.lock_timeout_ms / 1000)
    with Server(spark, registry, port=o.port) as server:
        log.info("listening on %s:%s", *server.server_address)
        server.serve_forever()


if __name__ == "__main__":
    main()
