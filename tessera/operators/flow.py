"""Calls of outside services from executors: bounded concurrency, rate, retries, batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "text string, valid boolean, attempts int, errors array<string>, used_fallback boolean"


class Bucket:
    """Token bucket: ``rate`` calls a second on average, ``burst`` at once; idle time refills up to the burst."""

    def __init__(self, rate: float, burst: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.left, self.at = burst, clock()

    def acquire(self) -> None:
        now = self.clock()
        self.left, self.at = min(self.burst, self.left + (now - self.at) * self.rate), now
        if self.left < 1:
            wait = (1 - self.left) / self.rate
            self.sleep(wait)
            self.left, self.at = 1.0, self.at + wait
        self.left -= 1


def attempt(call: Callable[[str], str], prompt: str, validate: Callable[[str], list[str]] | None = None, max_retries: int = 2, fallback: str | None = None) -> tuple:
    """(text, valid, attempts, errors, used_fallback) after up to 1 + ``max_retries`` tries."""
    errors: list[str] = []
    for n in range(1, max_retries + 2):
        try:
            text = call(prompt)
        except Exception as e:  # a service may fail in any way; the failure is recorded in the row
            errors.append(str(e) or type(e).__name__)
            continue
        faults = validate(text) if validate else []
        if not faults:
            return text, True, n, errors, False
        errors.append("; ".join(faults))
    return fallback, fallback is not None, max_retries + 1, errors, fallback is not None


def call_service(requests: DataFrame, make_call: Callable[[], Callable[[str], str]], *, prompt: str = "prompt", key: str = "request_id", concurrency: int = 8, rate: float | None = None, burst: float = 4, max_retries: int = 2, validate: Callable[[str], list[str]] | None = None, fallback: str | None = None) -> DataFrame:
    """One row per request with ``RESULT``. ``concurrency`` tasks share the rate evenly; ``make_call`` runs once per task."""
    kind = requests.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make_call()
        bucket = Bucket(rate / concurrency, max(1.0, burst / concurrency)) if rate else None
        for pdf in batches:
            rows = []
            for k, p in zip(pdf[key], pdf[prompt]):
                if bucket:
                    bucket.acquire()
                rows.append((k, *attempt(call, p, validate, max_retries, fallback)))
            yield pd.DataFrame(rows, columns=[key, *[c.split()[0] for c in RESULT.split(", ")]])

    return requests.select(key, prompt).repartition(concurrency).mapInPandas(run, f"{key} {kind}, {RESULT}")


def poll_wait(wait: float, pending: int, error: bool) -> float:
    """Seconds until the next look at a batch: sooner when nearly done, later when much is open or after an error."""
    part = 1.5 if error else 0.8 if pending < 10 else 1.2 if pending > 100 else 1.0
    return min(30.0, max(2.0, wait * part))


def poll(look: Callable[[], tuple[bool, int]], wait: float = 5.0, most: int = 180, most_errors: int = 10, on_poll: Callable[[bool, int], None] | None = None, sleep: Callable[[float], None] = time.sleep) -> int:
    """Looks at a batch (``look`` gives: ended, open requests) until it has ended; how often it looked.

    A failed look waits longer and counts; it is raised after ``most_errors`` looks,
    and a batch that is open after ``most`` of them is given up.
    """
    for n in range(1, most + 1):
        sleep(wait)
        try:
            ended, pending = look()
        except Exception as e:  # a service may fail in any way; the loop goes on for a while
            if n > most_errors:
                raise RuntimeError(f"polling failed at look {n}: {e}") from e
            wait = min(30.0, wait * 1.5)
            continue
        if on_poll:
            on_poll(ended, pending)
        if ended:
            return n
        wait = poll_wait(wait, pending, False)
    raise TimeoutError(f"still open after {most} looks")


def turn_faults(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, fault): why a conversation can't be sent on; null if its last turn is a user's and says something."""
    last = turns.groupBy(conversation).agg(F.max(F.struct(F.col(turn).alias("t"), F.col(role).alias("role"), F.col(text).alias("text"))).alias("last"))
    blank = F.trim(F.coalesce("last.text", F.lit(""))) == ""
    fault = F.when(F.coalesce("last.role", F.lit("")) != "user", "the last turn is not the user's").when(blank, "the last turn is empty")
    return last.select(conversation, fault.alias("fault"))


def check_ids(requests: DataFrame, key: str = "request_id") -> None:
    bad = requests.groupBy(key).agg(F.count("*").alias("n")).filter(F.col(key).isNull() | (F.col("n") > 1)).limit(1).count()
    if bad:
        raise ValueError("every request needs an id of its own")


def merge_config(base: dict, *overrides: dict) -> dict:
    """Nested options, later ones first; lists and values are replaced whole."""
    out = dict(base)
    for over in overrides:
        for k, v in over.items():
            out[k] = merge_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def without_secrets(config: dict, secret: tuple[str, ...] = ("api_key", "token", "password")) -> dict:
    return {k: "***" if k in secret and v else without_secrets(v, secret) if isinstance(v, dict) else v for k, v in config.items()}


def seconds(total: float) -> str:
    """A duration as hours, minutes and seconds."""
    h, rest = divmod(round(total), 3600)
    m, s = divmod(rest, 60)
    return f"{h}h {m}m {s}s" if h else f"{m}m {s}s" if m else f"{total:.1f}s"
