"""Language-model calls as an operator; the model is given by the caller."""

from __future__ import annotations

import json
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schemas

class Reply(NamedTuple):
    """What a model gave: its answer, why it ended there, and tokens of the prompt and of the answer, where it tells."""

    answer: str
    finish_reason: str | None = None
    prompt_tokens: int | None = None
    completion_tokens: int | None = None


#: system text, prompt, temperature, most tokens -> answer, alone or with its accounts.  A temperature or number of tokens that is None is left to the completer.
Completer = Callable[[str, str, float | None, int | None], str | Reply]
#: Statuses of a server that may answer later: too early, too many requests, and its own faults.
LATER = (408, 425, 429)
REPLY = "answer string, finish_reason string, prompt_tokens int, completion_tokens int, error string"


class Pace:
    """Lets calls through at a rate, and ``burst`` of them at once after a rest.  Threads may share one."""

    def __init__(self, per_second: float, burst: int = 1, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.gap, self.now, self.sleep, self.lock = 1.0 / per_second, now, sleep, threading.Lock()
        self.credit = burst * self.gap
        self.free = now() - self.credit

    def wait(self) -> None:
        with self.lock:
            self.free = max(self.free, self.now() - self.credit) + self.gap
            rest = self.free - self.now()
        if rest > 0:
            self.sleep(rest)


def ask(prompts: DataFrame, completer: Completer, system: str = "", temperature: float | None = None, max_tokens: int | None = None, at_once: int = 1, per_second: float | None = None, tasks: int | None = None) -> DataFrame:
    """``prompts`` with ``reply``, a struct of REPLY, for each ``prompt``; where a call failed it has an ``error`` and no answer.

    The completer is sent to the workers.  Each task has ``at_once`` calls under way
    at most, and begins ``per_second`` of them at most; with ``tasks``, rows are dealt
    out to so many, so a server sees ``tasks * at_once`` calls at a time.  Rows keep
    their order and pass batch by batch.  A null prompt is no call and has a null reply.
    """

    kind = to_arrow_schema(schemas.struct(f"reply struct<{REPLY}>")).field(0).type

    def one(pace: Pace | None, prompt: str | None) -> dict | None:
        if prompt is None:
            return None
        if pace:
            pace.wait()
        try:
            got = completer(system, prompt, temperature, max_tokens)
        except Exception as e:
            return {"error": f"{type(e).__name__}: {e}"}
        return (Reply(got) if isinstance(got, str) else got)._asdict()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace = Pace(per_second, at_once) if per_second else None
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                replies = pool.map(partial(one, pace), b.column(b.schema.get_field_index("prompt")).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(replies), kind)], [*b.schema.names, "reply"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)
    rows = prompts if tasks is None else prompts.repartition(tasks)
    return rows.mapInArrow(run, f"{kinds}, reply struct<{REPLY}>")


def complete(prompts: DataFrame, completer: Completer, system: str = "", temperature: float | None = None, max_tokens: int | None = None, **how: object) -> DataFrame:
    """``prompts`` with ``answer``: as ask(), but with the answer alone, null where the call failed."""
    return ask(prompts, completer, system, temperature, max_tokens, **how).withColumn("answer", F.col("reply.answer")).drop("reply")


def usage(asked: DataFrame, *by: str) -> DataFrame:
    """Calls, failures and tokens of what ask() gave, in all or by some columns; null replies are no calls."""
    tokens = lambda c: F.coalesce(F.sum(f"reply.{c}"), F.lit(0).cast("long")).alias(c)
    calls = asked.filter("reply is not null")
    return calls.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.count("reply.error").alias("failed"), F.count_if(F.col("reply.finish_reason") == "length").alias("cut_off"), tokens("prompt_tokens"), tokens("completion_tokens"))


def http_completer(base_url: str, model: str, api_key: str = "", timeout: float = 120.0, attempts: int = 3, stop: list[str] | None = None, temperature: float = 0.1, max_tokens: int = 2048) -> Completer:
    """A completer for a server with a chat-completions endpoint; lost connections and busy servers are tried again.

    ``temperature`` and ``max_tokens`` hold for calls that name none.
    """
    return partial(_post, base_url.rstrip("/") + "/chat/completions", model, api_key, timeout, attempts, stop, (temperature, max_tokens))


def http_stream(base_url: str, model: str, api_key: str = "", timeout: float = 120.0) -> Callable[[str, str, float, int], Iterator[str]]:
    """As http_completer(), but the answer's tokens come one by one, as the server sends them."""
    return partial(_stream, base_url.rstrip("/") + "/chat/completions", model, api_key, timeout)


def is_alive(completer: Completer) -> bool:
    """Whether a model answers."""
    try:
        got = completer("", "Are you there? Reply with yes.", 0.0, 5)
        return bool((got if isinstance(got, str) else got.answer).strip())
    except Exception:
        return False


def flush_cache(completer: Completer) -> bool:
    """Ask a model for next to nothing, so that a server drops what it keeps of the prompts before; whether it answered."""
    try:
        completer("", ".", 0.0, 1)
    except Exception:
        return False
    return True


def _request(url: str, model: str, api_key: str, system: str, prompt: str, temperature: float, max_tokens: int, **more: object) -> urllib.request.Request:
    messages = [{"role": "system", "content": system}] * bool(system) + [{"role": "user", "content": prompt}]
    body = json.dumps({"model": model, "messages": messages, "temperature": temperature, "max_tokens": max_tokens, **more}).encode()
    return urllib.request.Request(url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {api_key}"})


def _post(url: str, model: str, api_key: str, timeout: float, attempts: int, stop: list[str] | None, defaults: tuple[float, int], system: str, prompt: str, temperature: float | None, max_tokens: int | None) -> Reply:
    request = _request(url, model, api_key, system, prompt, defaults[0] if temperature is None else temperature, defaults[1] if max_tokens is None else max_tokens, **({"stop": stop} if stop else {}))
    for k in range(attempts):
        try:
            with urllib.request.urlopen(request, timeout=timeout) as r:
                return reply_of(json.load(r))
        except (urllib.error.URLError, TimeoutError) as e:
            refused = isinstance(e, urllib.error.HTTPError) and e.code < 500 and e.code not in LATER
            if refused or k == attempts - 1:
                raise
            time.sleep(min(10.0, 2.0**k))
    raise AssertionError


def _stream(url: str, model: str, api_key: str, timeout: float, system: str, prompt: str, temperature: float, max_tokens: int) -> Iterator[str]:
    with urllib.request.urlopen(_request(url, model, api_key, system, prompt, temperature, max_tokens, stream=True), timeout=timeout) as r:
        for line in r:
            name, _, data = line.decode("utf-8", "replace").strip().partition(":")
            if name != "data" or not data.strip():
                continue
            if data.strip() == "[DONE]":
                return
            delta = ((json.loads(data).get("choices") or [{}])[0].get("delta") or {}).get("content")
            if delta:
                yield delta


def without_thinking(tokens: Iterator[str]) -> Iterator[str]:
    """Tokens of one answer without what its think tags hold."""
    from ..streaming.thinking import step

    buffer, inside = "", False
    for t in tokens:
        shown, buffer, inside = step(buffer, inside, t)
        if shown:
            yield shown
    if buffer and not inside:
        yield buffer


def reply_of(response: object) -> Reply:
    """A response's text and accounts; what it doesn't tell is None."""
    told = response if isinstance(response, dict) else {}
    counts = told.get("usage") or {}
    choice = (told.get("choices") or [{}])[0]
    return Reply(text_of(response), choice.get("finish_reason"), counts.get("prompt_tokens"), counts.get("completion_tokens"))


def text_of(response: object) -> str:
    """Text of a response: a string, a list of blocks, or the old ``text`` field."""
    if isinstance(response, str):
        return response
    choice = (response.get("choices") or [{}])[0] if isinstance(response, dict) else {}
    body = (choice.get("message") or {}).get("content", choice.get("text"))
    if isinstance(body, list):
        return "".join(x if isinstance(x, str) else x.get("text", "") for x in body)
    return body or ""
