"""The reviewer: any callable from prompt to answer, called in batches by ``mapInArrow``; failures become rows.

A task may run again, so answers should be written before they are used where calls cost money; ``answers`` is one plain row per prompt for that.
"""

from __future__ import annotations

import itertools
import json
import queue
import random
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import AccumulatorParam, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.operators import findings
from patchloom.shared import keep

#: What a kind of failure is called in reports; others keep their own text.
MESSAGES = {
    "timeout": "The reviewer did not answer in time", "rate_limit": "The reviewer's rate limit was reached", "auth": "The reviewer refused the credentials",
    "connection": "The reviewer could not be reached", "server": "The reviewer failed", "context_length": "The prompt is too long for the reviewer",
    "empty": "The reviewer gave an empty answer", "malformed": "The answer is no valid JSON",
}
TRANSIENT = ("server", "rate_limit", "timeout")


class ReviewError(Exception):
    """A failed call; ``kind`` is one of MESSAGES or another word."""

    def __init__(self, kind: str, text: str = ""):
        super().__init__(text or MESSAGES.get(kind, kind))
        self.kind = kind


def is_too_long(message: str, code: str | None = None) -> bool:
    """Whether a refusal says that the prompt is too long."""
    low = message.lower()
    return code == "context_length_exceeded" or "context length" in low or "maximum context" in low or "too many tokens" in low


@dataclass
class SecretStub:
    """A deterministic reviewer: one finding for a text that holds ``mark``, an error for an empty one."""

    mark: str = "token"

    def __call__(self, prompt: str) -> str:
        if not prompt:
            raise ReviewError("malformed", "empty prompt")
        found = [{"what": "secret", "why": "it is in the text", "how_to_fix": "remove it", "severity": "High", "confidence": "High", "cwe_id": "CWE-798", "owasp_category": None, "line_range": None, "file_path": None}]
        return json.dumps({"findings": found if self.mark in prompt else []})


#: Late calls, times the calls at once, after which a task makes no more: what does not answer gets no more threads.
LATE = 4
#: Prompts whose answers a task holds at once.
PART = 1024


class _Done(AccumulatorParam):
    """Paths of reviewed files by partition. A partition that runs again says the same, and Spark takes values of successful attempts alone."""

    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, value1: dict, value2: dict) -> dict:  # noqa: N802
        value1.update(value2)
        return value1


class Progress:
    """Calls ``call(file_path, done, total)`` for each file as tasks end, from a thread of the driver; use it around the action that reviews.

    Counts are those of partitions that ended well, each once, whatever attempts they took. The driver keeps a number for each partition, and the
    paths of those that ended since the last look.
    """

    def __init__(self, spark: SparkSession, total: int, call: Callable[[str, int, int], None], every: float = 0.2):
        self.total, self.call, self.every, self.done, self.seen = total, call, every, 0, set()
        self.reviewed = spark.sparkContext.accumulator({}, _Done())
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._watch, daemon=True)

    def _look(self) -> None:
        for partition in sorted(set(self.reviewed.value) - self.seen):
            self.seen.add(partition)
            for path in self.reviewed.value[partition]:
                self.done += 1
                self.call(path, self.done, self.total)
            self.reviewed.value[partition] = ()

    def _watch(self) -> None:
        while not self._stop.wait(self.every):
            self._look()

    def __enter__(self) -> Progress:
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._stop.set()
        self._thread.join()
        self._look()


def answers(
    prompts: DataFrame, reviewer: Callable[[str], str], concurrent: int = 5, retries: int = 0, timeout: float = 120.0, keys: Sequence[str] = (), progress: Progress | None = None, wait: float = 1.0
) -> DataFrame:
    """(keys, file_path, prompt) to (keys, file_path, raw, error, error_type): each task makes at most ``concurrent`` calls at once; a failed one has a null answer.

    A call's time runs from its own start, retries included. A late call counts as failed; its thread is left behind and another takes its
    place, so neither other calls nor the end of the task wait for it. After LATE times ``concurrent`` late calls a task calls no more: its other
    prompts fail as late, so threads are bounded. ``wait`` scales the pauses before calls that are tried again. ``progress`` hears of the files of each task that ends.
    """
    told = progress.reviewed if progress else None

    def call(prompt: str) -> tuple[str | None, str | None, str | None]:
        for attempt in range(retries + 1):
            try:
                raw = reviewer(prompt)
                if not raw:
                    raise ReviewError("empty")
                return raw, None, None
            except ReviewError as e:
                if e.kind not in TRANSIENT or attempt == retries:
                    return None, str(e), "context_length" if is_too_long(str(e)) else e.kind
                time.sleep(wait * min(8.0, 2.0**attempt) * random.random() / 4)
            except Exception as e:
                text = str(e) or type(e).__name__
                return None, text, "context_length" if is_too_long(text, getattr(e, "code", None)) else type(e).__name__
        raise AssertionError

    def all_of(texts: list[str], late: list[int]) -> list[tuple[str | None, str | None, str | None]]:
        rows: list = [(None, MESSAGES["timeout"], "timeout")] * len(texts)
        waiting, running, ended, names = deque(range(len(texts))), {}, queue.SimpleQueue(), itertools.count()

        def work(me: int) -> None:
            """Takes calls until none waits or one of its own was late."""
            while True:
                try:
                    k = waiting.popleft()
                except IndexError:
                    return ended.put(me)
                running[me] = time.monotonic() + timeout
                row = call(texts[k])
                if running.pop(me, None) is None:
                    return None
                rows[k] = row

        def start() -> None:
            threading.Thread(target=work, args=(next(names),), daemon=True).start()

        live = 0 if late[0] >= LATE * concurrent else min(concurrent, len(texts))
        for _ in range(live):
            start()
        while live:
            now = time.monotonic()
            try:
                ended.get(timeout=max(0.0, min([now + timeout, *list(running.values())]) - now))
                live -= 1
            except queue.Empty:
                now = time.monotonic()
                for me, end in list(running.items()):
                    if end <= now and running.pop(me, None) is not None:
                        late[0] += 1
                        if late[0] >= LATE * concurrent:
                            waiting.clear()
                            live -= 1
                        else:
                            start()
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, paths = [0], []
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                rows = all_of(part.column("prompt").to_pylist(), late)
                if told is not None:
                    paths += part.column("file_path").to_pylist()
                columns = part.columns[:-1] + [pa.array([r[k] for r in rows], type=pa.string()) for k in range(3)]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[:-1], "raw", "error", "error_type"])
        if told is not None:
            told.add({TaskContext.get().partitionId(): tuple(paths)})

    kept = prompts.select(*keys, "file_path", "prompt")
    schema = ", ".join(f"`{n}` {t}" for n, t in kept.drop("prompt").dtypes)
    return kept.mapInArrow(run, f"{schema}, raw string, error string, error_type string")


def reviewed(prompts: DataFrame, reviewer: Callable[[str], str], keys: Sequence[str] = (), **options) -> DataFrame:
    """Rated findings and failures of all prompts: the keys, the columns of a finding, ``error`` and ``error_type``. Answers are written before they are read, so each prompt is asked once."""
    got = keep(answers(prompts, reviewer, keys=keys, **options), "answers")
    parsed = findings.parsed(got.where("error IS NULL").select(*keys, "file_path", "raw"), keys)
    failed = got.where("error IS NOT NULL")
    kept = findings.rated(parsed.where("error IS NULL")).unionByName(parsed.where("error IS NOT NULL"))
    kept = kept.withColumn("error_type", F.when(F.col("error").isNotNull(), F.lit("malformed")))
    nothing = [F.lit(None).cast(t).alias(n) for n, t in parsed.dtypes if n not in ("file_path", "error", *keys)]
    return kept.unionByName(failed.select(*keys, "file_path", *nothing, "error", "error_type"))


def error_messages(errors: DataFrame) -> DataFrame:
    """(file_path, error, error_type) with ``message``: what reports say of it."""
    known = F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv])
    return errors.withColumn("message", F.coalesce(F.try_element_at(known, F.col("error_type")), F.col("error")))
