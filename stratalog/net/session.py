"""One client's conversation with a store, line by line."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from stratalog.store import Snapshot, Store


class Response:
    """The lines that answer a command, and whether it ends the session. ``stream`` makes them as they are taken, so a scan
    of any size passes through; ``lines`` is all of them at once. Either can be taken once."""

    def __init__(self, lines: Iterable[str] = (), last: bool = False):
        self._lines, self.last = lines, last

    def stream(self) -> Iterator[str]:
        return iter(self._lines)

    @property
    def lines(self) -> tuple[str, ...]:
        return tuple(self._lines)


class Session:
    """Commands PUT, GET, DEL, SCAN, SNAPSHOT, RELEASE, PING and QUIT. A failed command leaves the session usable."""

    def __init__(self, store: Store):
        self._store, self._snapshot, self._closed = store, None, False
        self._commands = {
            "PUT": self._put, "GET": self._get, "DEL": self._delete, "DELETE": self._delete, "SCAN": self._scan,
            "SNAPSHOT": self._open, "RELEASE": self._release, "PING": lambda _: Response(("PONG",)), "QUIT": lambda _: Response(("OK",), True),
        }

    @property
    def snapshot_version(self) -> int | None:
        return None if self._snapshot is None else self._snapshot.version

    def execute(self, line: str | None) -> Response:
        if self._closed:
            raise RuntimeError("the session is closed")
        words = (line or "").strip().split(" ", 2)
        if words == [""]:
            return Response()
        command = self._commands.get(words[0].upper())
        if command is None:
            return _error(f"unknown command: {words[0]}")
        try:
            return command(words)
        except Exception as e:  # noqa: BLE001 - whatever fails is this command's answer
            return Response((_failure(e),))

    def _put(self, words: list[str]) -> Response:
        if len(words) < 3:
            return _error("usage: PUT <key> <value>")
        self._store.put(words[1], words[2])
        return Response(("OK",))

    def _get(self, words: list[str]) -> Response:
        if len(words) != 2:
            return _error("usage: GET <key>")
        value = self._store.get(words[1], self._snapshot)
        return Response(("NIL",) if value is None else (f"VALUE {value}",))

    def _delete(self, words: list[str]) -> Response:
        if len(words) != 2:
            return _error("usage: DEL <key>")
        self._store.delete(words[1])
        return Response(("OK",))

    def _scan(self, words: list[str]) -> Response:
        lower, upper = (*(None if w == "-" else w for w in words[1:]), None, None)[:2]
        return Response(self._rows(lower, upper))

    def _rows(self, lower: str | None, upper: str | None) -> Iterator[str]:
        """One partition of the scan at a time; a failure on the way is the last line, in place of END."""
        try:
            for k, v in self._store.rows(lower, upper, self._snapshot):
                yield f"ROW {k} {v}"
        except Exception as e:  # noqa: BLE001
            yield _failure(e)
        else:
            yield "END"

    def _open(self, _) -> Response:
        if self._snapshot is not None:
            return _error(f"snapshot already open at version {self._snapshot.version}")
        self._snapshot: Snapshot | None = self._store.snapshot()
        return Response((f"OK {self._snapshot.version}",))

    def _release(self, _) -> Response:
        if self._snapshot is None:
            return _error("no snapshot open")
        self._snapshot.close()
        self._snapshot = None
        return Response(("OK",))

    def close(self) -> None:
        self._closed = True
        if self._snapshot is not None:
            self._snapshot.close()
            self._snapshot = None


def _failure(e: Exception) -> str:
    return f"ERR {str(e).splitlines()[0] if str(e) else type(e).__name__}"


def _error(text: str) -> Response:
    return Response((f"ERR {text}",))
