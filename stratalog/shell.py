"""python -m stratalog.shell FOLDER [--flush-bytes N] [--sync]: look into a store and change it by hand."""

from __future__ import annotations

import argparse
import cmd
import shlex
from pathlib import Path

from pyspark.sql import SparkSession

from stratalog.sources.wal import Durability
from stratalog.store import Snapshot, Store

#: Rows that are printed of a result; the count of the others is not taken, only that there are some.
SHOWN = 50


class Shell(cmd.Cmd):
    """Each ``do_`` method is a command, its first line the help text. Words are split as in a POSIX shell, so quotes keep blanks."""

    intro, prompt = "Type help for the commands.", "stratalog> "

    def __init__(self, store: Store, **streams):
        super().__init__(**streams)
        self.store = store
        self.at: Snapshot | int | None = None

    def say(self, text: object) -> None:
        self.stdout.write(f"{text}\n")

    def onecmd(self, line: str) -> bool:
        try:
            return bool(super().onecmd(line))
        except Exception as e:  # noqa: BLE001 - a command that fails does not end the session
            self.say(f"failed: {(str(e) or type(e).__name__).splitlines()[0]}")
            return False

    def emptyline(self) -> bool:
        return False

    def default(self, line: str) -> None:
        if line == "EOF":
            return True
        raise ValueError(f"no such command as {line.split()[0]!r}")

    @staticmethod
    def _words(line: str, least: int, most: int) -> list[str]:
        words = shlex.split(line)
        if not least <= len(words) <= most:
            raise ValueError(f"takes {least} words" if least == most else f"takes {least} to {most} words")
        return words

    def _table(self, frame) -> None:
        rows = frame.take(SHOWN + 1)
        for r in rows[:SHOWN]:
            self.say("\t".join("null" if v is None else str(v) for v in r))
        if len(rows) > SHOWN:
            self.say("...")

    def do_put(self, line: str) -> None:
        """put KEY VALUE: write a value; prints its version."""
        self.say(f"version {self.store.put(*self._words(line, 2, 2))}")

    def do_del(self, line: str) -> None:
        """del KEY: write a tombstone; prints its version."""
        self.say(f"version {self.store.delete(*self._words(line, 1, 1))}")

    def do_get(self, line: str) -> None:
        """get KEY: the value at the position that `at` set."""
        value = self.store.get(*self._words(line, 1, 1), at=self.at)
        self.say("absent" if value is None else repr(value))

    def do_scan(self, line: str) -> None:
        """scan [FROM [TO]]: live rows of [FROM, TO) at the position that `at` set; - leaves a side open."""
        bounds = [None if w == "-" else w for w in self._words(line, 0, 2)]
        self._table(self.store.scan(*bounds, at=self.at))

    def do_history(self, line: str) -> None:
        """history KEY: version, tombstone and value of all its stored writes."""
        self._table(self.store.history(*self._words(line, 1, 1)))

    def do_at(self, line: str) -> None:
        """at VERSION | now | snapshot: where get, scan and sql read from here on; a snapshot holds back merges."""
        word = self._words(line, 1, 1)[0]
        place = None if word == "now" else self.store.snapshot() if word == "snapshot" else int(word)
        if isinstance(self.at, Snapshot):
            self.at.close()
        self.at = place
        self.say(f"reading at {place.version if isinstance(place, Snapshot) else 'now' if place is None else place}")

    def do_sql(self, line: str) -> None:
        """sql QUERY: Spark SQL over the view `live` (key, value)."""
        held = self.store.view("live", self.at)
        self._table(held.sparkSession.sql(line))

    def do_runs(self, _: str) -> None:
        """runs: level, sequence, records, bytes and key range of each run, and what is buffered."""
        for r in self.store.runs:
            self.say(f"level {r.level} seq {r.seq}: {r.entry_count} records, {r.file_bytes} bytes, {r.min_key!r} to {r.max_key!r}")
        self.say(f"buffer: {self.store.buffered_bytes} bytes, log: {self.store.log_size()} bytes")

    def do_flush(self, _: str) -> None:
        """flush: write the buffer as a run."""
        self.store.flush()

    def do_compact(self, _: str) -> None:
        """compact: merge all runs."""
        self.store.compact_all()

    def do_vacuum(self, line: str) -> None:
        """vacuum [SECONDS]: delete files of runs superseded so long ago."""
        words = self._words(line, 0, 1)
        self.say(f"{self.store.vacuum(*map(float, words))} files deleted")

    def do_quit(self, _: str) -> bool:
        """quit: close the store and leave."""
        return True


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="stratalog.shell")
    parser.add_argument("folder", type=Path)
    parser.add_argument("--flush-bytes", type=int, default=1 << 20)
    parser.add_argument("--sync", action="store_true")
    given = parser.parse_args(arguments)
    given.folder.mkdir(parents=True, exist_ok=True)
    spark = SparkSession.builder.master("local[*]").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    with Store(spark, given.folder.resolve().as_uri(), Durability.SYNC if given.sync else Durability.BUFFERED, given.flush_bytes) as store:
        Shell(store).cmdloop()


if __name__ == "__main__":
    main()
