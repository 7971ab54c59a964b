"""Stateful operators over streams of text pieces, keyed by request.

Input rows: request_id, seq (orders a request's rows), kind ("partial",
"final", "end" or "error") and text. Rows of one request in one micro-batch
are put in order of seq before they are fed. A request is over with its end,
with an error, or when ``timeout`` milliseconds passed without rows, as after
a disconnect: a timer fires, what the request is still owed goes out, and its
state goes. With a timeout a query never runs out of batches, so streams that
are drained (availableNow) take None.

State is kept by ``transformWithState`` and needs RocksDB: start streams under
``state.rocksdb``. A stream that is started again from its checkpoint goes on
in the middle of a request.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "request_id string, seq long, kind string, text string"
OUT = "request_id string, seq long, delta string"
TIMEOUT_MS = 600_000


class Deltas:
    """What is new in each piece: pieces may be deltas or all so far, and a final piece repeats its message."""

    def __init__(self, sent: str = "", partial: bool = False) -> None:
        self.sent, self.partial = sent, partial

    def feed(self, kind: str, text: str) -> str:
        if not text:
            return ""
        rest = text[len(self.sent) :] if text.startswith(self.sent) else None
        if kind == "partial":
            new = text if rest is None else rest
            self.sent, self.partial = self.sent + new, True
            return new
        new = text if not self.partial else rest or ""
        self.sent, self.partial = "", False
        return new


MARK = "chart://"
LONGEST_ID = 64
_TOKEN = re.compile(re.escape(MARK) + r"([0-9a-f]{16,64})")


class Markers:
    """Replaces markers in a stream, however it is cut: a tail that may become a marker waits for the next piece."""

    def __init__(self, replace: Callable[[str], str | None], held: str = "") -> None:
        self.replace, self.held = replace, held

    def _safe(self) -> int:
        """How much may go: not an id that may go on, nor a tail that may begin a marker."""
        at = self.held.rfind(MARK)
        tail = self.held[at + len(MARK) :]
        if at >= 0 and len(tail) < LONGEST_ID and re.fullmatch("[0-9a-f]*", tail):
            return at
        return next((len(self.held) - n for n in range(len(MARK) - 1, 0, -1) if self.held.endswith(MARK[:n])), len(self.held))

    def _put(self, text: str) -> str:
        return _TOKEN.sub(lambda m: self.replace(m[1]) or "", text)

    def feed(self, text: str) -> str:
        self.held += text or ""
        at = self._safe()
        out, self.held = self.held[:at], self.held[at:]
        return self._put(out)

    def flush(self) -> str:
        out, self.held = self.held, ""
        return self._put(out)


class _Request(StatefulProcessor):
    """One value of state a request: ``step(state, row) -> (state, text)`` for each row; ``owed(state)`` is what goes out when it is cut off."""

    def __init__(self, step: Callable[[tuple, Any], tuple[tuple, str]], start: tuple, state: str, timeout: int | None, owed: Callable[[tuple], str] = lambda _: "") -> None:
        self.step, self.start, self.state, self.timeout, self.owed = step, start, state, timeout, owed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.now = handle, handle.getValueState("now", f"seq long, {self.state}")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        seq, *now = self.now.get() or (0, *self.start)
        over = False
        for r in sorted(rows, key=lambda r: r.seq):
            now, text = self.step(tuple(now), r)
            seq = r.seq
            if r.kind == "error":
                text, now = text + self.owed(tuple(now)), self.start
            over |= r.kind in ("end", "error")
            if text:
                yield Row(request_id=key[0], seq=seq, delta=text)
        self.wait(timerValues, not over)
        self.now.clear() if over else self.now.update((seq, *now))

    def wait(self, timerValues: Any, more: bool) -> None:  # noqa: N803
        """A request's one timer starts anew with its rows, and is gone with its end."""
        if self.timeout:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
            if more:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        seq, *now = self.now.get() or (0, *self.start)
        self.now.clear()
        if text := self.owed(tuple(now)):
            yield Row(request_id=key[0], seq=seq, delta=text)

    def close(self) -> None:
        pass


class _Whole(_Request):
    """A list of pieces a request, which grows without being written anew."""

    def __init__(self, review: Callable[[str], str], timeout: int | None) -> None:
        self.review, self.timeout = review, timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.pieces = handle, handle.getListState("pieces", "text string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        rows = sorted(rows, key=lambda r: r.seq)
        over = [k for k, r in enumerate(rows) if r.kind in ("end", "error")]
        last = over[0] if over else len(rows) - 1
        own = [(r.text,) for r in rows[: last + 1] if r.text]
        if over:
            if rows[last].kind == "end" and (text := self.review("".join(p[0] for p in [*self.pieces.get(), *own]))):
                yield Row(request_id=key[0], seq=rows[last].seq, delta=text)
            self.pieces.clear()
        elif own:
            self.pieces.appendList(own)
        self.wait(timerValues, not over)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        self.pieces.clear()
        return iter(())


def _keyed(stream: DataFrame, request: _Request) -> DataFrame:
    return stream.groupBy("request_id").transformWithState(request, OUT, "Append", "ProcessingTime" if request.timeout else "None")


def new_text(stream: DataFrame, timeout: int | None = TIMEOUT_MS) -> DataFrame:
    """Only what a reader has not had yet."""

    def step(state: tuple, r: Any) -> tuple[tuple, str]:
        d = Deltas(*state)
        out = d.feed(r.kind, r.text or "")
        return (d.sent, d.partial), out

    return _keyed(stream, _Request(step, ("", False), "sent string, partial boolean", timeout))


def replace_markers(stream: DataFrame, replacements: dict[str, str], timeout: int | None = TIMEOUT_MS) -> DataFrame:
    """Text with markers replaced from a small table; unknown ones become empty. What waits goes out when the request is over, however that came."""

    def step(state: tuple, r: Any) -> tuple[tuple, str]:
        m = Markers(replacements.get, state[0])
        out = m.feed(r.text or "") + (m.flush() if r.kind == "end" else "")
        return (m.held,), out

    return _keyed(stream, _Request(step, ("",), "held string", timeout, lambda state: Markers(replacements.get, state[0]).flush()))


def hold_until_end(stream: DataFrame, review: Callable[[str], str], timeout: int | None = TIMEOUT_MS) -> DataFrame:
    """One row a request: all its text after ``review``, when its end comes. A request that fails or is cut off has none: it was not reviewed."""
    return _keyed(stream, _Whole(review, timeout))
