"""Command-line client: one statement with -c, or a prompt.

Exit status: 0 fine, 1 a statement failed, 2 the connection or a flag failed.
"""

from __future__ import annotations

import argparse
import json
import signal
import socket
import sys
from typing import TextIO

from .functions.values import from_wire, shown
from .server import VERSION

#: Rows that fix the column widths.
SAMPLE = 50
# Prompts by transaction state.
PROMPTS = {"none": "heliodor> ", "open": "heliodor(tx)> ", "readonly": "heliodor(ro)> "}
MORE = "...> "


class Printer:
    """A table whose widths come from its first rows; later rows are printed as they arrive."""

    def __init__(self, out: TextIO):
        self.out, self.names, self.right, self.widths = out, [], [], []
        self.held: list[list[str]] | None = []
        self.count = 0

    def header(self, cols: list[dict]) -> None:
        self.names = [c["name"] for c in cols]
        self.right = [c["ty"].startswith(("INTEGER", "DECIMAL")) for c in cols]
        self.widths = [len(n) for n in self.names]

    def row(self, values: list) -> None:
        cells = [shown(v) for v in values]
        self.count += 1
        if self.held is None:
            return self._line(cells, self.right)
        self.widths = [max(w, len(c)) for w, c in zip(self.widths, cells)]
        self.held.append(cells)
        if len(self.held) == SAMPLE:
            self._open()

    def footer(self) -> None:
        if self.held is not None and self.names:
            self._open()
        print(f"({self.count} {'row' if self.count == 1 else 'rows'})", file=self.out)

    def error(self, e: dict) -> None:
        print(f"{e['code']}: {e['message']}" + (f" at character {e['position']}" if e.get("position") else ""), file=self.out)

    def _open(self) -> None:
        held, self.held = self.held, None
        self._line(self.names, [False] * len(self.names))
        print("+".join("-" * (w + 2) for w in self.widths), file=self.out)
        for cells in held:
            self._line(cells, self.right)

    def _line(self, cells: list[str], right: list[bool]) -> None:
        padded = [c.rjust(w) if r else c.ljust(w) for c, w, r in zip(cells, self.widths, right)]
        print("|".join(f" {c} " for c in padded).rstrip(), file=self.out)


class Client:
    def __init__(self, host: str, port: int, database: str):
        self.address = (host, port)
        self.socket = socket.create_connection(self.address)
        self.lines = self.socket.makefile("r", encoding="utf-8", newline="\n")
        self.send(type="startup", version=VERSION, database=database)
        first = self.receive()
        if first["type"] == "error":
            raise ConnectionError(f"{first['code']}: {first['message']}")
        self.ready = first

    def send(self, **message) -> None:
        self.socket.sendall(json.dumps(message).encode() + b"\n")

    def receive(self) -> dict:
        line = self.lines.readline()
        if not line:
            raise ConnectionError("the server closed the connection")
        return json.loads(line)

    def query(self, sql: str):
        """Messages of one answer; ready ends it."""
        self.send(type="query", sql=sql)
        while (message := self.receive())["type"] != "ready":
            yield message
        self.ready = message

    def cancel(self) -> None:
        with socket.create_connection(self.address) as other:
            other.sendall(json.dumps({"type": "cancel", "conn_id": self.ready["conn_id"], "secret": self.ready["secret"]}).encode() + b"\n")

    def close(self) -> None:
        try:
            self.send(type="close")
        finally:
            self.socket.close()


def run_statement(client: Client, sql: str, out: TextIO) -> bool:
    """Print the answer; False if the statement failed."""
    printer, fine = Printer(out), True
    for m in client.query(sql):
        if m["type"] == "rowdesc":
            printer.header(m["cols"])
        elif m["type"] == "datarow":
            printer.row([from_wire(v) for v in m["values"]])
        elif m["type"] == "complete":
            printer.footer()
        elif m["type"] == "error":
            printer.error(m)
            fine = False
    return fine


def repl(client: Client, lines: TextIO, out: TextIO) -> None:
    held: list[str] = []
    while True:
        print(MORE if held else PROMPTS[client.ready["tx"]], end="", file=out, flush=True)
        line = lines.readline()
        if not line:
            return
        line = line.rstrip()
        if not line and not held:
            continue
        held.append(line)
        if line.endswith(";"):
            run_statement(client, "\n".join(held), out)
            held = []


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=5480)
    p.add_argument("--database", default="default")
    p.add_argument("-c", dest="statement")
    o = p.parse_args(args)
    try:
        client = Client(o.host, o.port, o.database)
        signal.signal(signal.SIGINT, lambda *_: client.cancel())
        if o.statement is not None:
            fine = run_statement(client, o.statement, sys.stdout)
            client.close()
            return 0 if fine else 1
        repl(client, sys.stdin, sys.stdout)
        client.close()
        return 0
    except OSError as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
