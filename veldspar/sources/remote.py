"""Remote text recognition as a connector: replicas in turn, retries, health probes and routing by script.

Nothing here opens a connection by itself: a ``send`` function (address, payload) does, and raises ``Failed`` with the status where the
service refuses. ``recognise`` runs it in the tasks that hold the images, one pool for each.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

Send = Callable[[str, dict], str]


class Failed(Exception):
    """A refusal with its status, or None where no answer came."""

    def __init__(self, status: int | None, what: str = "") -> None:
        super().__init__(what or f"status {status}")
        self.status = status

    @property
    def lasting(self) -> bool:
        """Whether the same request would be refused again."""
        return self.status is not None and 400 <= self.status < 500


@dataclass
class Pool:
    """Replicas of one service, asked in turn; one that fails rests for a while, and if all rest, all are asked."""

    addresses: list[str]
    rest: float = 30.0
    clock: Callable[[], float] = time.monotonic
    _next: int = 0
    _resting: dict[str, float] = field(default_factory=dict)

    def healthy(self) -> list[str]:
        now = self.clock()
        fit = [a for a in self.addresses if self._resting.get(a, now) <= now]
        return fit or list(self.addresses)

    def pick(self) -> str:
        fit = self.healthy()
        self._next += 1
        return fit[(self._next - 1) % len(fit)]

    def failed(self, address: str) -> None:
        self._resting[address] = self.clock() + self.rest

    def answered(self, address: str) -> None:
        self._resting.pop(address, None)

    def probe(self, send: Send) -> dict[str, bool]:
        """Ask each replica for one token, so that those that don't answer rest at once."""
        out = {}
        for address in self.addresses:
            try:
                send(address, {"max_tokens": 1})
                self.answered(address)
                out[address] = True
            except Failed:
                self.failed(address)
                out[address] = False
        return out


@dataclass
class Client:
    """Requests with retries: waiting times double up to a bound and are drawn between nothing and that, refusals that last aren't repeated."""

    pool: Pool
    send: Send
    tries: int = 3
    first: float = 1.0
    most: float = 30.0
    sleep: Callable[[float], None] = time.sleep
    draw: Callable[[float], float] = lambda wait: random.uniform(0.0, wait)

    def ask(self, payload: dict) -> str:
        for turn in range(self.tries):
            address = self.pool.pick()
            try:
                answer = self.send(address, payload)
                self.pool.answered(address)
                return answer
            except Failed as e:
                if e.lasting:
                    raise
                self.pool.failed(address)
                if turn + 1 == self.tries:
                    raise
            self.sleep(self.draw(min(self.most, self.first * 2**turn)))
        raise Failed(None, "no tries")


def read_block(
    image: bytes, surrounding: str | None, clients: Mapping[str, Client], routes: Mapping[str, str], fallback: str, script_of: Callable[[str], str | None], mode: str = "surrounding_text", probe_tokens: int = 8
) -> tuple[str, str | None, str | None, str | None]:
    """Text, backend, script and error of one image block.

    By the script around it, by that of a short probe, or by either. A probe that is plainly whole is the result; if the backend for its script
    refuses the image for good, the probe stays. Any other failure leaves a comment as the text.
    """
    if mode not in {"surrounding_text", "probe_ocr", "both"}:
        raise ValueError(f"unknown mode: {mode}")
    script = surrounding
    try:
        if mode == "surrounding_text" or (mode == "both" and surrounding is not None):
            backend = routes.get(surrounding or "", fallback)
            return clients[backend].ask({"image": image}).strip(), backend, surrounding, None
        probe = clients[fallback].ask({"image": image, "max_tokens": probe_tokens})
        script = script_of(probe)
        backend = routes.get(script or "", fallback)
        if backend == fallback:
            text = probe if len(probe) < 3 * probe_tokens else clients[fallback].ask({"image": image})
            return text.strip(), fallback, script, None
        try:
            return clients[backend].ask({"image": image}).strip(), backend, script, None
        except Failed as e:
            if e.lasting:
                return probe.strip(), fallback, script, None
            raise
    except Exception as e:  # a block that can't be read is part of the document all the same
        return f"<!-- OCR failed: {e} -->", None, script, str(e)


def recognise(blocks: DataFrame, make: Callable[[], Mapping[str, Client]], routes: Mapping[str, str], fallback: str, script_of: Callable[[str], str | None], mode: str = "surrounding_text", probe_tokens: int = 8) -> DataFrame:
    """``blocks`` (block_id, image, surrounding_script) read by services: block_id, text, backend, script, error.

    ``make`` builds the clients within a task. As many requests run at once as tasks do.
    """
    wanted = dict(routes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clients = make()
        for batch in batches:
            found = [read_block(i, s, clients, wanted, fallback, script_of, mode, probe_tokens) for i, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = [pa.array(c, pa.string()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.string())] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["block_id", "text", "backend", "script", "error"])

    kind = dict(blocks.dtypes)["block_id"]
    return blocks.select("block_id", "image", "surrounding_script").mapInArrow(run, f"block_id {kind}, text string, backend string, script string, error string")
