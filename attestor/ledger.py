"""A study's ledger of paid calls: one writer at a time, no call twice, a hard cap, conservative reservations."""

from __future__ import annotations

import json
import math
import os
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from pathlib import Path

from attestor.sources.artifacts import canonical_hash, write_text

#: Bytes of framing that a request adds, as a bound on its tokens.
FRAMING = 8192


@dataclass(frozen=True)
class Prices:
    input_per_million: float
    output_per_million: float

    def cost(self, inputs: float, outputs: float) -> float:
        return (inputs * self.input_per_million + outputs * self.output_per_million) / 1e6

    def bound(self, request: str, most_output: int) -> float:
        """The most that a request can cost: no tokenizer makes more tokens than UTF-8 bytes."""
        return self.cost(len(request.encode()) + FRAMING, most_output)


class Ledger:
    def __init__(self, path: str | Path, cap: float, prices: Prices, patience: float = 10.0):
        if not math.isfinite(cap) or cap <= 0:
            raise ValueError("the cap must be finite and positive")
        self.path, self.cap, self.prices, self.patience = Path(path), cap, prices, patience
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with self._locked():
            self.calls()

    @contextmanager
    def _locked(self) -> Iterator[None]:
        lock, until = self.path.with_suffix(".lock"), time.monotonic() + self.patience
        while True:
            try:
                os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
                break
            except FileExistsError:
                if time.monotonic() >= until:
                    raise TimeoutError("another writer holds the ledger") from None
                time.sleep(0.01)
        try:
            yield
        finally:
            lock.unlink()

    def calls(self) -> list[dict]:
        """The ledger's calls; fails if its cap or prices are others, or it is over the cap."""
        if not self.path.exists():
            return []
        known = json.loads(self.path.read_text(encoding="utf-8"))
        if known["cap"] != self.cap or known["prices"] != asdict(self.prices):
            raise ValueError("cap and prices of a ledger can't change")
        if self._spent(known["calls"]) > self.cap:
            raise ValueError("the ledger is over its cap")
        return known["calls"]

    @staticmethod
    def _spent(calls: list[dict]) -> float:
        return math.fsum(c["charged_usd"] for c in calls)

    def spent(self) -> float:
        return self._spent(self.calls())

    def _write(self, calls: list[dict]) -> None:
        write_text(str(self.path), json.dumps({"cap": self.cap, "prices": asdict(self.prices), "calls": calls}, indent=2) + "\n")

    def reserve(self, id_: str, amount: float) -> None:
        """Charge a call in full before it is made; a refusal leaves the ledger as it was."""
        with self._locked():
            calls = self.calls()
            if any(c["id"] == id_ for c in calls):
                raise ValueError(f"{id_} was paid already")
            if not math.isfinite(amount) or amount < 0 or self._spent(calls) + amount > self.cap:
                raise ValueError("the cap would be exceeded")
            self._write([*calls, {"id": id_, "reserved_usd": amount, "charged_usd": amount, "usage_known": False}])

    def settle(self, id_: str, input_tokens: int | None, output_tokens: int | None) -> None:
        """Charge what was used; a call without known usage keeps its whole reservation."""
        if input_tokens is None or output_tokens is None:
            return
        charged = self.prices.cost(input_tokens, output_tokens)
        with self._locked():
            calls = self.calls()
            (call,) = (c for c in calls if c["id"] == id_)
            if charged > call["reserved_usd"]:
                raise ValueError("more was used than reserved")
            call |= {"charged_usd": charged, "usage_known": True, "input_tokens": input_tokens, "output_tokens": output_tokens}
            self._write(calls)


def pinned(path: str | Path, plan: object) -> None:
    """Write down a plan's hash at the start; a later start with another plan, cap or layout of workers fails."""
    target, digest = Path(path), canonical_hash(plan)
    if not target.exists():
        write_text(str(target), digest + "\n")
    elif target.read_text().strip() != digest:
        raise ValueError("the plan differs from the one that was started")


def run_all(context, group: str, jobs: list[Callable[[], object]]) -> list[object]:
    """Run jobs of one Spark job group side by side; the first failure cancels the group, stops the rest and is raised."""
    from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait

    from pyspark import inheritable_thread_target

    def work(job: Callable[[], object]) -> object:
        context.setJobGroup(group, group, interruptOnCancel=True)
        return job()

    with ThreadPoolExecutor(len(jobs)) as pool:
        running = [pool.submit(inheritable_thread_target(work), job) for job in jobs]
        done, rest = wait(running, return_when=FIRST_EXCEPTION)
        failure = next((f.exception() for f in running if f.done() and f.exception()), None)
        if failure:
            for f in rest:
                f.cancel()
            context.cancelJobGroup(group)
            raise failure
    return [f.result() for f in running]
