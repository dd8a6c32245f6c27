"""Bounded queues at both ends of an engine.

What comes in waits in an inbox, which refuses messages when it is full, so that senders hear of it.  What goes out is
offered to clients that have a queue each; a client that does not keep up loses messages, the others do not.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from threading import Lock


class Inbox:
    """Messages that wait to be folded in."""

    def __init__(self, size: int = 10_000):
        self.waiting: deque[str] = deque()
        self.size, self.refused, self.taken = size, 0, 0
        self._lock = Lock()

    def offer(self, text: str) -> bool:
        """Queue a message; False if the inbox is full and the sender has to wait."""
        with self._lock:
            if len(self.waiting) >= self.size:
                self.refused += 1
                return False
            self.waiting.append(text)
            return True

    def drain(self, most: int) -> list[tuple[int, str]]:
        """Up to ``most`` messages in the order in which they came, numbered from the first one on."""
        with self._lock:
            out = []
            while self.waiting and len(out) < most:
                out.append((self.taken, self.waiting.popleft()))
                self.taken += 1
            return out


class Client:
    """The messages that wait for one client, the state at its arrival first."""

    def __init__(self, size: int, state: str):
        self.waiting: deque[str] = deque([state])
        self.size, self.dropped = size, 0

    def offer(self, message: str) -> bool:
        """Queue a message, or count it as dropped if the queue is full."""
        if len(self.waiting) >= self.size:
            self.dropped += 1
            return False
        self.waiting.append(message)
        return True

    def take(self) -> list[str]:
        """All that waits."""
        out = []
        while self.waiting:
            out.append(self.waiting.popleft())
        return out


class Channel:
    """Clients of one engine.  ``state`` says what a client is told when it arrives."""

    def __init__(self, state: Callable[[], str], size: int = 64):
        self.state, self.size = state, size
        self.clients: list[Client] = []
        self._lock = Lock()

    def subscribe(self) -> Client:
        client = Client(self.size, self.state())
        with self._lock:
            self.clients.append(client)
        return client

    def leave(self, client: Client) -> None:
        with self._lock:
            self.clients.remove(client)

    def send(self, message: str) -> int:
        """Offer a message to every client; how many took it."""
        with self._lock:
            return sum(c.offer(message) for c in self.clients)
