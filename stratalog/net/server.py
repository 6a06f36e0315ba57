"""The line protocol over TCP, on the driver and for this machine only."""

from __future__ import annotations

import socket
import socketserver
import threading
from collections.abc import Iterable
from itertools import islice

from stratalog.net.session import Session
from stratalog.store import Store

#: Fixed values of the protocol.
PORT, MAX_CONNECTIONS, MAX_LINE = 7070, 128, 65_536
#: Lines of a reply that are sent together.
BLOCK = 256


class _Handler(socketserver.StreamRequestHandler):
    disable_nagle_algorithm = True
    server: StoreServer

    def handle(self) -> None:
        if not self.server.enter(self.request):
            self._send(["ERR server at capacity"])
            return
        session = Session(self.server.store)
        try:
            while True:
                # four bytes a character at most, and the line's end
                raw = self.rfile.readline(4 * MAX_LINE + 2)
                if not raw.endswith(b"\n") and len(raw) < 4 * MAX_LINE + 2:
                    return  # the client left; a fragment is no command
                line = raw.decode("utf-8", "replace").removesuffix("\n").removesuffix("\r")
                if not raw.endswith(b"\n") or len(line) > MAX_LINE:
                    self._send(["ERR line too long"])
                    return
                response = session.execute(line)
                self._send(response.stream())
                if response.last:
                    return
        except OSError:
            pass
        finally:
            session.close()
            self.server.leave(self.request)

    def _send(self, lines: Iterable[str]) -> None:
        """Write the lines a block at a time, as they come."""
        lines = iter(lines)
        while block := list(islice(lines, BLOCK)):
            self.wfile.write("".join(f"{x}\n" for x in block).encode())


class StoreServer(socketserver.ThreadingTCPServer):
    """Serves a store on 127.0.0.1; port 0 takes any free one."""

    allow_reuse_address, daemon_threads, request_queue_size = True, True, 128

    def __init__(self, store: Store, port: int = PORT, most: int = MAX_CONNECTIONS):
        super().__init__(("127.0.0.1", port), _Handler)
        self.store, self._most = store, most
        self._clients: set[socket.socket] = set()
        self._guard = threading.Lock()
        self._thread = threading.Thread(target=self.serve_forever, daemon=True)
        self._thread.start()

    @property
    def port(self) -> int:
        return self.server_address[1]

    @property
    def active_connections(self) -> int:
        return len(self._clients)

    def enter(self, client: socket.socket) -> bool:
        with self._guard:
            if len(self._clients) >= self._most:
                return False
            self._clients.add(client)
            return True

    def leave(self, client: socket.socket) -> None:
        with self._guard:
            self._clients.discard(client)

    def await_shutdown(self) -> None:
        self._thread.join()

    def close(self) -> None:
        self.shutdown()
        self.server_close()
        with self._guard:
            for c in self._clients:
                try:
                    c.shutdown(socket.SHUT_RDWR)
                except OSError:
                    pass
