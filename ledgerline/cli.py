"""An interactive prompt over a store: python -m ledgerline.cli [FOLDER]"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import TextIO

from pyspark.sql import SparkSession

from .functions.status import Status
from .options import Options
from .store import Store

HELP = """Commands:
  PUT <key> <value>
  GET <key>
  DELETE <key>
  SCAN <start> <end>
  QUIT
"""


def _scanned(rows: Iterator) -> Iterator[str]:
    count = 0
    for r in rows:
        count += 1
        yield f"{r.key} -> {r.value}\n"
    yield f"({count} results)\n"


def execute(store: Store, line: str) -> str | Iterator[str] | None:
    """What a line prints, a scan's rows as they come; None ends the session. Commands are read in any case."""
    command, _, rest = line.strip().partition(" ")
    command, rest = command.upper(), rest.strip()
    try:
        if not command:
            return ""
        if command in ("QUIT", "EXIT"):
            return None
        if command == "HELP":
            return HELP
        if command == "PUT":
            key, _, value = rest.partition(" ")
            if not key:
                return "Usage: PUT <key> <value>\n"
            store.put(key, value.lstrip())
            return "OK\n"
        if command == "GET":
            return f"{store.get(rest.split()[0])}\n" if rest else "Usage: GET <key>\n"
        if command in ("DELETE", "DEL"):
            if not rest:
                return "Usage: DELETE <key>\n"
            store.delete(rest.split()[0])
            return "OK\n"
        if command == "SCAN":
            bounds = rest.split()
            if len(bounds) < 2:
                return "Usage: SCAN <start> <end>\n"
            return _scanned(store.scan(bounds[0], bounds[1]).toLocalIterator())
    except Status as e:
        return f"{e}\n"
    return f"Unknown command: {command}. Type HELP for usage.\n"


def run(store: Store, source: TextIO, sink: TextIO) -> None:
    sink.write("Type HELP for commands.\n> ")
    for line in source:
        out = execute(store, line)
        if out is None:
            break
        sink.writelines([out] if isinstance(out, str) else out)
        sink.write("> ")
        sink.flush()


def main(args: list[str]) -> int:
    spark = SparkSession.builder.appName("ledgerline").getOrCreate()
    try:
        store = Store(spark, Options(db_path=args[0]) if args else Options())
    except Exception as e:  # noqa: BLE001  any failure to open ends the program
        print(f"Failed to open the store: {e}", file=sys.stderr)
        return 1
    with store:
        run(store, sys.stdin, sys.stdout)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
