"""put, get, delete and more, line by line: python -m siltstone.cli FOLDER"""

from __future__ import annotations

import shlex
import sys
from collections.abc import Callable, Iterable

from siltstone.model import FOUND, Strategy
from siltstone.plans.store import Store

HELP = "put KEY VALUE | get KEY | delete KEY | scan START END [LIMIT] | flush | compact [full|tiered|leveled] | runs | exit"


def execute(store: Store, line: str) -> str | None:
    """What a line answers; None to leave."""
    try:
        words = shlex.split(line)
    except ValueError as e:
        return f"error: {e}"
    match words:
        case []:
            return ""
        case ["exit" | "quit"]:
            return None
        case ["help"]:
            return HELP
    try:
        match words:
            case ["put", key, value]:
                return f"ok {store.put(key, value)}"
            case ["get", key]:
                status, value = store.status(key)
                return value.decode(errors="backslashreplace") if status == FOUND else "the key does not exist"
            case ["delete", key]:
                return f"ok {store.delete(key)}"
            case ["scan", start, end, *limit] if len(limit) < 2:
                rows = store.range_scan(start, end, *map(int, limit)).toLocalIterator()
                return "\n".join(f"{bytes(r.key).decode(errors='backslashreplace')} = {bytes(r.value).decode(errors='backslashreplace')}" for r in rows)
            case ["flush"]:
                return f"{len(store.flush())} runs written"
            case ["compact", *kind] if len(kind) < 2:
                return f"{len(store.compact(Strategy(kind[0]) if kind else None))} merges"
            case ["runs"]:
                return "\n".join(f"{r.run_id} level {r.level}: {r.n_rows} entries, {r.bytes} bytes" for r in store.manifest.runs)
    except ValueError as e:
        return f"error: {e}"
    return f"error: {HELP}"


def loop(store: Store, lines: Iterable[str], say: Callable[[str], None]) -> None:
    """Until exit or the end of the lines."""
    for line in lines:
        answer = execute(store, line)
        if answer is None:
            return
        if answer:
            say(answer)


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession

    if len(args) != 1:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("siltstone").getOrCreate()
    with Store(spark, args[0]) as store:
        loop(store, sys.stdin, print)
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
