"""Reranking keepers with a pluggable scorer: retries with backoff, tolerant replies, stable order.

A client is any object with score_photo(content: bytes, media_type: str, prompt: str) -> str that can be pickled. It runs in Arrow
batches; partitions are its concurrency. Calls cost money: results are checkpointed before use, so a later stage that is retried does not call again, and with
a call log each answer is kept as it comes, so neither does a task that dies between calls, nor a later run with the same photo and prompt.
"""

from __future__ import annotations

import logging
import os
import random
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.functions.text import reply
from lumisift.operators.ordered import numbered
from lumisift.session import checkpoint_dir
from lumisift.shipping import ship

ship(__name__)

#: Fixed values.
BASE_DELAY, MAX_DELAY, JITTER, MAX_ATTEMPTS = 1.0, 30.0, 0.25, 3
#: Names the environment's own number of attempts.
ATTEMPTS_SETTING = "LUMISIFT_MAX_ATTEMPTS"
log = logging.getLogger(__name__)


class RetryError(RuntimeError):
    def __init__(self, attempts: int, last: BaseException):
        super().__init__(f"gave up after {attempts} attempts: {last}")
        self.attempts, self.last = attempts, last


def retryable(error: BaseException) -> bool:
    """Too many requests, server errors, timeouts and broken connections; any other refusal (400 to 499) is final."""
    if isinstance(error, (KeyboardInterrupt, SystemExit)):
        return False
    status = getattr(error, "status_code", None) or getattr(getattr(error, "response", None), "status_code", None)
    if isinstance(status, int):
        return status == 429 or not 400 <= status < 500
    return isinstance(error, (TimeoutError, ConnectionError)) or any(w in type(error).__name__.lower() for w in ("timeout", "connection", "ratelimit", "overloaded"))


def delay(attempt: int, rng: random.Random, base: float = BASE_DELAY, most: float = MAX_DELAY, jitter: float = JITTER) -> float:
    return min(base * 2**attempt, most) * (1 + rng.uniform(-jitter, jitter))


def attempts_of(given: int | None) -> int:
    """At least one: those given, else the environment's, else MAX_ATTEMPTS."""
    if given is None:
        said = os.environ.get(ATTEMPTS_SETTING)
        try:
            given = int(said) if said else MAX_ATTEMPTS
        except ValueError:
            log.warning("%s=%r is not a whole number", ATTEMPTS_SETTING, said)
            given = MAX_ATTEMPTS
    return max(1, given)


def with_retries(call: Callable, attempts: int | None = None, sleep: Callable = time.sleep, rng: random.Random | None = None, on_retry: Callable | None = None):
    """What the call returns; RetryError, with the last error, once it is final or attempts run out.

    on_retry(attempt that failed, error, delay) is told before each wait; what it raises is logged and ignored.
    """
    attempts, rng = attempts_of(attempts), rng or random.Random()
    for k in range(attempts):
        try:
            return call()
        except Exception as error:
            if not retryable(error) or k + 1 == attempts:
                raise RetryError(k + 1, error) from error
            wait = delay(k, rng)
            if on_retry:
                try:
                    on_retry(k + 1, error, wait)
                except Exception:
                    log.exception("on_retry failed")
            sleep(wait)


class CallLog:
    """Answers by photo and prompt, a file each in a shared folder (a URI), moved into place once it is whole."""

    def __init__(self, folder: str):
        self.folder = folder

    def _place(self, content: bytes, prompt: str):
        import hashlib

        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(self.folder)
        key = hashlib.sha256(hashlib.sha256(prompt.encode()).digest() + content).hexdigest()
        return files, f"{base}/{key[:2]}", f"{key}.txt"

    def answer(self, content: bytes, prompt: str, ask: Callable[[], str]) -> str:
        """The answer that is kept, or else that of a call, which is kept then. What a call raises is not."""
        from pyarrow import fs

        files, place, name = self._place(content, prompt)
        if files.get_file_info(f"{place}/{name}").type == fs.FileType.File:
            with files.open_input_stream(f"{place}/{name}") as f:
                return f.read().decode("utf-8")
        said = ask()
        files.create_dir(place, recursive=True)
        draft = f"{place}/.{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as f:
            f.write(said.encode("utf-8"))
        files.move(draft, f"{place}/{name}")
        return said


def rerank(keepers: DataFrame, client, prompt: str, top_n: int | None = None, attempts: int | None = None, media_type: str = "image/jpeg", sleep: Callable = time.sleep, workers: int | None = None, on_retry: Callable | None = None, call_log: str | None = None) -> DataFrame:
    """keepers(name, rank, content binary, ...) -> the same less content, with ai_score, ai_reason and ai_rank.

    Keepers without content (they could not be encoded) are left out; a call that fails scores 0. Ties keep the order of rank.
    workers: how many calls run at a time at most. call_log: a shared folder for answers; the same photo is asked about a prompt once, whatever dies.
    """
    checkpoint_dir(keepers.sparkSession)
    kept = CallLog(call_log) if call_log else None
    fields, attempts = keepers.drop("content").schema, attempts_of(attempts)
    if workers is not None:
        keepers = keepers.repartition(workers)

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            said = []
            for content in batch.column("content"):
                data = content.as_py()
                try:
                    ask = lambda d=data: with_retries(lambda: client.score_photo(d, media_type, prompt), attempts, sleep, None, on_retry)
                    said.append(kept.answer(data, prompt, ask) if kept else ask())
                except Exception as error:  # one photo must not end the batch
                    said.append(f"scoring failed: {error}")
            rest = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(said, pa.string())], names=[*fields.names, "_said"])

    from pyspark.sql.types import StringType, StructField, StructType

    asked = keepers.where(F.col("content").isNotNull()).select(*fields.names, "content").mapInArrow(run, StructType([*fields.fields, StructField("_said", StringType())])).checkpoint()
    return ordered(asked.withColumn("_r", reply(F.col("_said"))).withColumn("ai_score", F.col("_r.score")).withColumn("ai_reason", F.col("_r.reason")).drop("_said", "_r"), top_n)


def ordered(scored: DataFrame, top_n: int | None = None) -> DataFrame:
    """Best ai_score first, ties in the order of rank; cut to top_n if given, else numbered by ranges."""
    from pyspark.sql import Window as W

    by = [F.desc("ai_score"), F.asc("rank")]
    if top_n is not None:
        return scored.orderBy(*by).limit(top_n).withColumn("ai_rank", F.row_number().over(W.orderBy(*by)))
    return numbered(scored, by).withColumn("ai_rank", (F.col("pos") + 1).cast("int")).drop("part", "pos")
