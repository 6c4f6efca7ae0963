"""Model clients: one protocol, built per executor partition, called several at a time, with a reply cache as a table.

A client answers a request (a dict with model, system, prompt, images, temperature, max_tokens) with
a text; several threads of a task use one client.  Clients are never pickled: a *factory* is, and each
partition builds its own.
"""

from __future__ import annotations

import math
import os
import random
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUEST = "stage string, model string, system string, prompt string, images array<struct<mime:string,data:binary>>, temperature double, max_tokens int"


class ModelClient(Protocol):
    def complete(self, request: dict) -> str: ...


class StubClient:
    """Answers by stage from functions; for tests and dry runs."""

    def __init__(self, answers: dict[str, Callable[[dict], str]] | None = None):
        self.answers = answers or {}

    def complete(self, request: dict) -> str:
        of = self.answers.get(request["stage"])
        return of(request) if of else ""


def env_file(path: str = ".env") -> None:
    """Set what ``KEY=value`` lines of a file name and the environment lacks."""
    if os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                name, eq, value = line.strip().removeprefix("export ").partition("=")
                if eq and not name.startswith("#"):
                    os.environ.setdefault(name.strip(), value.strip().strip("\"'"))


class OpenAIClient:
    """Any service with the OpenAI chat interface; needs the ``openai`` package and a key in the environment."""

    def __init__(self, base_url: str | None = None, key_name: str = "DASHSCOPE_API_KEY"):
        key = os.environ.get(key_name)
        if not key:
            raise ValueError(f"{key_name} is not set")
        from openai import OpenAI

        self.client = OpenAI(api_key=key, base_url=base_url or os.environ.get("DASHSCOPE_BASE_URL", "https://dashscope.aliyuncs.com/compatible-mode/v1"))

    def complete(self, request: dict) -> str:
        import base64

        images = [{"type": "image_url", "image_url": {"url": f"data:{i['mime']};base64,{base64.b64encode(i['data']).decode()}"}} for i in request["images"] or []]
        messages = [{"role": "system", "content": [{"type": "text", "text": request["system"], "cache_control": {"type": "ephemeral"}}]}] if request["system"] else []
        messages.append({"role": "user", "content": [*images, {"type": "text", "text": request["prompt"]}]})
        got = self.client.chat.completions.create(model=request["model"], messages=messages, temperature=request["temperature"], max_tokens=request["max_tokens"], extra_body={"enable_thinking": False})
        return (got.choices[0].message.content or "").strip()


class GeminiClient:
    """The other provider; needs ``google-generativeai`` and a key in the environment."""

    def __init__(self):
        key = os.environ.get("GEMINI_PROXY_API_KEY")
        if not key:
            raise ValueError("GEMINI_PROXY_API_KEY is not set")
        import google.generativeai as genai

        genai.configure(api_key=key, transport="rest", client_options={"api_endpoint": os.environ.get("GEMINI_PROXY_BASE_URL", "http://127.0.0.1:8045")})
        self.genai = genai

    def complete(self, request: dict) -> str:
        model = self.genai.GenerativeModel(request["model"].removeprefix("gemini/"), **({"system_instruction": request["system"]} if request["system"] else {}))
        parts = [*({"mime_type": i["mime"], "data": i["data"]} for i in request["images"] or []), request["prompt"]]
        got = model.generate_content([{"role": "user", "parts": parts}], generation_config={"temperature": request["temperature"], "max_output_tokens": request["max_tokens"]})
        return reply_text(got).strip()


def reply_text(reply) -> str:
    """The text of a reply; where it is refused as a whole, the parts of its first candidate."""
    try:
        return reply.text or ""
    except Exception:  # noqa: BLE001  the package raises for replies without a plain text
        first = next(iter(getattr(reply, "candidates", None) or []), None)
        return "".join(getattr(p, "text", None) or "" for p in getattr(getattr(first, "content", None), "parts", None) or [])


def client_for(model: str) -> ModelClient:
    env_file()
    return GeminiClient() if model.startswith("gemini/") else OpenAIClient()


@dataclass(frozen=True)
class Limits:
    """What a provider is asked for at most, by all tasks together.

    ``slots`` tasks call at one time: by default as many as the session has cores, and no more than
    ``in_flight``.  Each gets its share of the calls in flight and of the rate.  A failed call is made
    ``attempts`` times in all, after ``pause`` seconds and twice as many each time; where the provider
    says that it is asked too often, the whole task waits.  A task has at most ``batch`` requests, so
    no more are paid for again when one is lost.
    """

    # Calls at one time and a minute
    in_flight: int = 20
    per_minute: int = 30_000
    attempts: int = 3
    pause: float = 1.0
    batch: int = 256
    slots: int | None = None

    def of_task(self, tasks: int) -> Limits:
        """The share of one of ``tasks`` tasks at a time."""
        n = max(1, min(tasks, self.in_flight))
        return replace(self, in_flight=max(1, self.in_flight // n), per_minute=max(1, self.per_minute // n))


class Bucket:
    """Lets calls through at a rate, and as many at once as a second holds; times are handed in for tests."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.step, self.clock, self.sleep = 60 / per_minute, clock, sleep
        self.lock, self.next = threading.Lock(), clock() - 1

    def take(self) -> None:
        with self.lock:
            now = self.clock()
            self.next = max(self.next, now - 1) + self.step
            wait = self.next - now - self.step
        if wait > 0:
            self.sleep(wait)

    def hold(self, seconds: float) -> None:
        """No call before ``seconds`` from now."""
        with self.lock:
            self.next = max(self.next, self.clock() + seconds)


def asked_too_often(error: Exception) -> bool:
    return getattr(error, "status_code", getattr(error, "code", None)) == 429 or "429" in str(error)


class Asker:
    """A client under limits: ``all`` answers requests in order, several at a time."""

    def __init__(self, client: ModelClient, limits: Limits, bucket: Bucket | None = None):
        self.client, self.limits = client, limits
        self.bucket = bucket or Bucket(limits.per_minute)

    def one(self, request: dict) -> tuple[str | None, str | None]:
        """The reply, or what the last attempt failed with: a failed call is a row, not a failed job."""
        for k in range(self.limits.attempts):
            self.bucket.take()
            try:
                return self.client.complete(request), None
            except Exception as e:  # noqa: BLE001
                error, wait = e, self.limits.pause * 2**k * (1 + random.random() / 4)
                if k + 1 < self.limits.attempts:
                    if asked_too_often(e):
                        self.bucket.hold(wait)
                    else:
                        self.bucket.sleep(wait)
        return None, str(error)

    def all(self, requests: list[dict | None]) -> list[tuple[str | None, str | None]]:
        some = [r for r in requests if r is not None]
        if len(some) < 2 or self.limits.in_flight < 2:
            told = iter([self.one(r) for r in some])
        else:
            with ThreadPoolExecutor(min(len(some), self.limits.in_flight)) as pool:
                told = iter(list(pool.map(self.one, some)))
        return [(None, None) if r is None else next(told) for r in requests]


def images_key(images: Column) -> Column:
    """What pictures contribute to a request's key."""
    return F.sha2(F.array_join(F.transform(images, lambda i: F.sha2(i["data"], 256)), " "), 256)


def request_key(images: Column) -> Column:
    """What a reply depends on, as a hash; a remembered reply serves equal requests. ``images``: their ``images_key``."""
    return F.sha2(F.to_json(F.struct("stage", "model", "system", "prompt", images.alias("images"), "temperature", "max_tokens")), 256)


def replies(requests: DataFrame, factory: Callable[[], ModelClient], limits: Limits = Limits(), names: tuple[str, str] = ("reply", "error")) -> DataFrame:  # noqa: B008
    """``requests`` (any key columns and those of ``REQUEST``) with the reply and the error, as columns ``names``.

    ``limits`` are those of one task.  Rows without a prompt are not asked about.  Write the result
    before using it twice, or calls are made again.
    """
    columns = [c.split(" ")[0] for c in REQUEST.split(", ")]
    schema = T.StructType([*requests.schema.fields, *(T.StructField(n, T.StringType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asker = Asker(factory(), limits)
        for batch in batches:
            for at in range(0, batch.num_rows, 2 * limits.in_flight):  # few pictures as Python objects at a time
                part = batch.slice(at, 2 * limits.in_flight)
                told = asker.all([r if r["prompt"] is not None else None for r in part.select(columns).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, pa.string()) for x in zip(*told, strict=True))], names=[*part.schema.names, *names])

    return requests.mapInArrow(run, schema)


def dealt(requests: DataFrame, limits: Limits, n: int | None = None) -> tuple[DataFrame | None, Limits]:
    """``requests`` in tasks of a bounded number of rows, and the limits of each; None where there are none. ``n``: their number, if known."""
    n = requests.count() if n is None else n
    slots = max(1, min(limits.slots or requests.sparkSession.sparkContext.defaultParallelism, limits.in_flight))
    tasks = math.ceil(n / limits.batch)
    if limits.slots or slots == limits.in_flight:
        tasks = min(tasks, slots)  # more could run at once than may call
    return (requests.repartition(tasks) if n else None), limits.of_task(min(slots, max(tasks, 1)))


class Memory:
    """Replies as a table in a folder, by request key.

    Tasks add to it as they end (the committer's second algorithm), and what they have added stays
    when the job fails later: a job that is run again asks only for the rest.
    """

    def __init__(self, spark: SparkSession, path: str, kinds: str):
        self.spark, self.path, self.kinds = spark, path, f"request_key string, {kinds}"
        self.names = [c.strip().split(" ")[0] for c in kinds.split(",")]

    def exists(self) -> bool:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = files.globStatus(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/*.parquet"))
        return files.exists(folder) and len(found or ()) > 0

    def without_known(self, keyed: DataFrame) -> tuple[DataFrame, bool]:
        """Rows whose requests (``request_key``) have no good reply yet, equal requests once, and whether anything is remembered at all."""
        some = self.exists()
        fresh = keyed.join(self.rows("error is null").select("request_key"), "request_key", "left_anti") if some else keyed
        return fresh.dropDuplicates(["request_key"]), some

    def rows(self, good: str | None = None) -> DataFrame:
        """A row for each key; ``good``: only of rows that this condition holds for."""
        found = self.spark.read.schema(self.kinds).parquet(self.path)
        told = F.min_by(F.struct(*self.names), F.struct(F.col("error").isNotNull(), *self.names))  # a task that ran twice may have told twice
        return (found.filter(good) if good else found).groupBy("request_key").agg(told.alias("told")).select("request_key", "told.*")

    def add(self, rows: DataFrame) -> None:
        rows.select("request_key", *self.names).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").mode("append").parquet(self.path)


def remembered(requests: DataFrame, factory: Callable[[], ModelClient], path: str, limits: Limits = Limits(), with_images: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:  # noqa: B008
    """``requests`` with reply and error, asking for nothing that an earlier run was told: good replies are kept in a table at ``path``.

    Requests have the columns of ``REQUEST``; or, in place of ``images``, their ``images_key``, and
    ``with_images`` adds the pictures to the few that have to be asked.
    """
    memory = Memory(requests.sparkSession, path, "reply string, error string")
    keyed = requests.withColumn("request_key", request_key(F.col("images_key") if with_images else images_key(F.col("images"))))
    fresh, some = memory.without_known(keyed)
    rows, own = dealt(fresh, limits)
    if rows is not None:
        memory.add(replies(with_images(rows) if with_images else rows, factory, own))
    elif not some:
        return keyed.withColumns({"reply": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}).drop("request_key")  # of no rows
    return keyed.join(memory.rows(), "request_key").drop("request_key")
