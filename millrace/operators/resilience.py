"""Retry and circuit breaker."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.envelope import SEQ, TS, is_success, micros, payload
from millrace.functions.fold import block_fold
from millrace.functions.shipping import ship_package


def delay(attempt: Column, base: int = 100_000, most: int = 30_000_000) -> Column:
    """Microseconds to wait before an attempt: none before the first, ``base`` before the second, then twice as long each
    time, ``most`` at most."""
    doubled = F.lit(base) * F.pow(F.lit(2.0), F.least(attempt - 2, F.lit(40)).cast("double"))
    return F.when(attempt <= 1, F.lit(0)).otherwise(F.least(doubled, F.lit(float(most)))).cast("long")


def jittered(wait: Column, u: Column) -> Column:
    """Between half of the wait and all of it, for ``u`` from 0 to 1."""
    return (wait * (0.5 + 0.5 * u)).cast("long")


def wait_before(seq: object, n: int, base: int, most: int) -> int:
    """The wait of a row before an attempt, with jitter by a hash of its number, so that it is the same whenever it is asked for."""
    if n <= 1:
        return 0
    u = int(hashlib.md5(f"{seq}:{n}".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF
    return int(min(base * 2.0 ** (n - 2), most) * (0.5 + 0.5 * u))


def retry(df: DataFrame, attempt: Callable[[dict, int], object], kind: str, max_attempts: int = 3, again: Callable[[str, int], bool] | None = None,
          base: int = 100_000, most: int = 30_000_000, name: str = "retry") -> DataFrame:
    """Call ``attempt(row, number)`` for each success until it returns, up to ``max_attempts`` times or until ``again``
    says no. Adds ``result`` (of DDL type ``kind``), ``attempts``, ``failure`` (null when it returned) and ``waited``: the waits,
    with jitter by a hash of the row's number, are accounted for, not slept. Errors pass with nulls."""
    ship_package(df.sparkSession)
    columns = payload(df)
    schema = df.select(*columns, SEQ, TS).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                result, failure, waited, n = None, None, 0, 0
                while n < max_attempts:
                    n += 1
                    waited += wait_before(row[SEQ], n, base, most)
                    try:
                        result, failure = attempt({c: row[c] for c in columns}, n), None
                        break
                    except Exception as e:
                        failure = str(e)
                        if again is not None and not again(failure, n):
                            break
                out.append((result, n, failure, waited))
            pdf[["result", "attempts", "failure", "waited"]] = pd.DataFrame(out, columns=["result", "attempts", "failure", "waited"], index=pdf.index, dtype=object)
            yield pdf

    done = df.filter(is_success()).select(*columns, SEQ, TS).mapInPandas(run, f"{ddl}, result {kind}, attempts int, failure string, waited bigint")
    return done.unionByName(df.filter(~is_success()).select(*columns, SEQ, TS), allowMissingColumns=True)


def dead_letters_after_retry(df: DataFrame, *args, **options) -> tuple[DataFrame, DataFrame]:
    """What succeeded in the end, and what didn't, with its attempts."""
    out = retry(df, *args, **options)
    return out.filter(F.col("failure").isNull()), out.filter(F.col("failure").isNotNull())


def breaker_step(rate: float, least: int, pause: int, probes: int):
    """Closed until at least ``least`` requests since the last change failed at ``rate`` or more; then open, rejecting for
    ``pause`` microseconds; then half-open: ``probes`` successes close it, a failure opens it again."""

    def step(state, us, failed):
        mode, n, bad, since = state or ("closed", 0, 0, 0)
        if mode == "open":
            if us - since < pause:
                return (mode, n, bad, since), ("rejected", "open")
            mode, n, bad = "half-open", 0, 0
        n, bad = n + 1, bad + bool(failed)
        if mode == "half-open":
            if failed:
                return ("open", 0, 0, us), ("failed", "open")
            return (("closed", 0, 0, us) if n >= probes else (mode, n, bad, since)), ("passed", "closed" if n >= probes else mode)
        if n >= least and bad / n >= rate:
            return ("open", 0, 0, us), ("failed" if failed else "passed", "open")
        return (mode, n, bad, since), ("failed" if failed else "passed", "closed")

    return step


def breaker_block(rate: float, least: int, pause: int, probes: int):
    """The same over a key's rows as arrays: from one change of the circuit to the next, found by running counts, in longer and
    longer pieces, while it is closed, and by time while it is open."""
    step = breaker_step(rate, least, pause, probes)

    def block(state, us: np.ndarray, failed: np.ndarray):
        n, i = len(us), 0
        outcome, circuit = np.where(failed, "failed", "passed").astype(object), np.full(n, "closed", object)
        state = state or ("closed", 0, 0, 0)
        while i < n:
            mode, count, bad, since = state
            if mode == "open" and us[i] - since < pause:
                j = int(np.searchsorted(us, since + pause, "left"))
                outcome[i:j], circuit[i:j], i = "rejected", "open", j
            elif mode == "closed":
                length = 16
                while i < n and state[0] == "closed":
                    counts = count + np.arange(1, len(us[i : i + length]) + 1)
                    bads = bad + np.cumsum(failed[i : i + length])
                    trips = (counts >= least) & (bads / counts >= rate)
                    k = int(trips.argmax()) + 1 if trips.any() else len(counts)
                    count, bad, i = int(counts[k - 1]), int(bads[k - 1]), i + k
                    if trips.any():
                        circuit[i - 1], state = "open", ("open", 0, 0, int(us[i - 1]))
                    else:
                        state = (mode, count, bad, since)
                    length *= 2
            else:  # half-open, a few rows
                state, (outcome[i], circuit[i]) = step(state, int(us[i]), bool(failed[i]))
                i += 1
        return state, (outcome, circuit)

    return block


def circuit_breaker(df: DataFrame, failed: Column, keys: list[str], rate: float = 0.5, least: int = 10, pause: int = 30_000_000, probes: int = 3) -> DataFrame:
    """All rows with ``outcome`` (passed, failed, rejected) and the ``circuit`` after each (closed, open, half-open), by key."""
    rows = df.withColumns({"_us": micros(F.col(TS)), "_failed": F.coalesce(failed, F.lit(True))})
    out = block_fold(rows, keys, [TS, SEQ], ["_us", "_failed"], breaker_block(rate, least, pause, probes), "outcome string, circuit string")
    return out.drop("_us", "_failed")
