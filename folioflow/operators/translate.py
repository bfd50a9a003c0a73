"""The external text transformation: units go out to an engine in batches and come back checked.

An engine is anything with a name and translate(text, prompt) -> text. The
operator runs it in Arrow batches of batches (mapInPandas) with the policy of
`Policy`: retries by kind of error, halving of batches that fail, splitting of
units that are too long, a second try for broken tokens, and other engines for
single units. A task that is run twice sends its requests twice, so outcomes
are written to the checkpoint before anything else reads them, and speculation
should be off.
"""

from __future__ import annotations

import json
import random
import threading
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import services, tokens
from .glossary import Glossary


class Engine(Protocol):
    name: str

    def translate(self, text: str, prompt: str) -> str: ...


class ServiceError(Exception):
    def __init__(self, message: str, status: int | None = None, retry_after: float | None = None):
        super().__init__(message)
        self.status, self.retry_after = status, retry_after

    @property
    def kind(self) -> str:
        return services.classify_error_of(self.status, str(self))


@dataclass
class FunctionEngine:
    """An engine from a function of one text, applied to each unit of a merged request: for tests and local models."""

    function: Callable[[str], str]
    name: str = "function"

    def translate(self, text: str, prompt: str) -> str:
        if services.MERGED.strip() in prompt:
            return json.dumps([{"id": u["id"], "text": self.function(u["text"])} for u in services.parse_units(text)], ensure_ascii=False)
        return self.function(text)


@dataclass
class HttpEngine:
    """A chat service. The key stays in the closure that Spark ships to the workers; it is never a column."""

    name: str
    url: str
    model: str = ""
    kind: str = "openai"
    key: str = field(default="", repr=False)
    settings: dict = field(default_factory=dict)
    timeout: float = 60.0
    langs: tuple[str, str] = ("auto", "EN")  # for services without a prompt, by their codes

    def translate(self, text: str, prompt: str) -> str:
        if self.kind in ("deeplx", "deepx"):
            body = {"text": text, "source_lang": self.langs[0], "target_lang": self.langs[1]}
        else:
            body = services.request_body(self.kind, self.model, text, prompt, **self.settings)
        headers = {"content-type": "application/json"}
        if self.key:
            headers |= {"x-api-key": self.key, "anthropic-version": "2023-06-01"} if self.kind == "claude" else {"authorization": f"Bearer {self.key}"}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                if body.get("stream"):
                    return services.stream_text(self.kind, iter(lambda: r.read(8192), b""))
                data = r.read(services.RESPONSE_BYTES + 1)
        except urllib.error.HTTPError as e:
            said = e.read(services.ERROR_BYTES).decode(errors="replace")[: services.ERROR_CHARACTERS]
            wait = e.headers.get("retry-after")
            raise ServiceError(f"HTTP {e.code}: {said}", e.code, services.retry_after_of(wait) if wait else None) from e
        except services.StreamError as e:
            raise ServiceError(str(e)) from e
        except OSError as e:
            raise ServiceError(f"request failed: {e}") from e
        if len(data) > services.RESPONSE_BYTES:
            raise ServiceError("the response is too large")
        return self.read(json.loads(data))

    def read(self, data: dict) -> str:
        if self.kind == "claude":
            if data.get("stop_reason") in ("max_tokens", "refusal"):
                raise ServiceError(f"stop_reason={data['stop_reason']}")
            return "".join(b.get("text") or "" for b in data.get("content") or [])
        if self.kind in ("deeplx", "deepx"):
            inner = data.get("data")
            first = inner if isinstance(inner, str) else None
            if first is None and isinstance(inner, dict):
                first = inner.get("text") or next((t.get("text") for t in inner.get("translations") or []), None)
            first = data.get("text") if first is None else first
            if not isinstance(first, str):
                raise ServiceError("unknown response format")
            return first.strip()
        choice = next(iter(data.get("choices") or []), None)
        if choice is None:
            raise ServiceError("empty result")
        if choice.get("finish_reason") in ("length", "content_filter", "insufficient_system_resource"):
            raise ServiceError(f"finish_reason={choice['finish_reason']}")
        message = choice.get("message") or {}
        if message.get("refusal") is not None:
            raise ServiceError("content_filter: refusal")
        if message.get("content"):
            return message["content"]
        if isinstance(message.get("reasoning_content"), str):
            return services.tail_translation_of(message["reasoning_content"])
        return choice.get("text") or ""


#: What the units say that a breaker kept from being sent.
STOPPED = "stopped"


@dataclass(frozen=True)
class Policy:
    """interval and concurrency hold in each Python worker: for a limit over the cluster, run the operator in `partitions` tasks and give each its share."""

    max_retries: int = 5
    retry_delay: float = 5.0
    interval: float = 1.0
    concurrency: int = 3
    max_failures: int = 10
    partitions: int | None = None


class Limiter:
    """Starts of requests at least `interval` seconds apart; a service that says so can put the next one off."""

    def __init__(self, interval: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.interval, self.clock, self.sleep = interval, clock, sleep
        self.next, self.lock = 0.0, threading.Lock()

    def acquire(self) -> None:
        with self.lock:
            now = self.clock()
            at = max(now, self.next)
            self.next = at + self.interval
        if at > now:
            self.sleep(at - now)

    def defer(self, wait: float) -> None:
        with self.lock:
            self.next = max(self.next, self.clock() + wait)


class Breaker:
    """Stops after so many batches have failed one after the other."""

    def __init__(self, most: int):
        self.most, self.run, self.open, self.lock = most, 0, False, threading.Lock()

    def record(self, ok: bool) -> None:
        with self.lock:
            self.run = 0 if ok else self.run + 1
            self.open |= self.run >= self.most


class Worker:
    """One Python worker's side of the operator."""

    def __init__(self, engines: list[Engine], glossary: Glossary, policy: Policy, prompt: str, source_lang: str, target_lang: str, sleep: Callable[[float], None] = time.sleep):
        self.engines, self.glossary, self.policy, self.sleep = engines, glossary, policy, sleep
        self.prompt, self.langs = prompt, (source_lang, target_lang)
        self.limiters = {id(e): Limiter(policy.interval, sleep=sleep) for e in engines}
        self.breaker = Breaker(policy.max_failures)

    def ask(self, engine: Engine, text: str, prompt: str) -> str:
        """One text, tried again as its errors allow."""
        p = self.policy
        attempt = 0
        while True:
            attempt += 1
            self.limiters[id(engine)].acquire()
            try:
                said = engine.translate(text, prompt)
                if said.strip():
                    return said
                raise ServiceError("empty translation")
            except ServiceError as e:
                kind = e.kind
                most = {"Permanent": 1, "ContextOverflow": 1, "Truncated": 1, "Empty": min(p.max_retries, 2)}.get(kind, p.max_retries)
                if attempt >= max(1, most):
                    raise
                base = {"RateLimit": p.retry_delay * 2, "Empty": min(p.retry_delay, 2.0)}.get(kind, p.retry_delay) * attempt
                wait = e.retry_after if e.retry_after is not None else base * random.uniform(0.5, 1.5)
                if kind == "RateLimit":
                    self.limiters[id(engine)].defer(wait)
                self.sleep(wait)

    def piece(self, engine: Engine, source: str) -> str:
        """One stretch of text with its tokens kept; broken tokens get a second try."""
        protected = self.glossary.apply_of(source)
        markup, terms = "{{etm_" in source, "{{etg_" in protected
        prompt = services.prompt_of(self.prompt, *self.langs, markup, terms)
        for last in ([False, True] if markup or terms else [True]):
            said = self.ask(engine, protected, prompt)
            try:
                text = tokens.accepted_of(source, self.glossary.restore_of(protected, said.strip()))
                if text is None:
                    raise ValueError("the translation broke the markup tokens")
                return text
            except ValueError as e:
                if last:
                    raise ServiceError(str(e)) from e
        raise AssertionError

    def unit_with(self, engine: Engine, source: str) -> str:
        """A unit, split where it is too long for the engine."""
        todo, done = deque([source]), []
        while todo:
            part = todo.popleft()
            try:
                done.append(self.piece(engine, part))
            except ServiceError as e:
                cut = tokens.split_protected_of(part) if e.kind == "ContextOverflow" else None
                if cut is None:
                    raise
                todo.extendleft(reversed(cut))
        text = tokens.accepted_of(source, "\n".join(done))
        if text is None:
            raise ServiceError("the translation broke the markup tokens")
        return text

    def unit(self, source: str) -> tuple[str, str]:
        """(text, engine) from the first engine that manages it."""
        for i, engine in enumerate(self.engines):
            try:
                return self.unit_with(engine, source), engine.name
            except ServiceError:
                if i + 1 == len(self.engines):
                    raise
        raise ServiceError("no engine")

    def merged(self, members: list[dict]) -> list[tuple[str, str, str]]:
        """(id, text, engine) of all members from one request of the first engine."""
        engine = self.engines[0]
        protected = {m["id"]: self.glossary.apply_of(m["text"]) for m in members}
        ask = json.dumps([{"id": k, "text": v} for k, v in protected.items()], ensure_ascii=False)
        said = self.ask(engine, ask, services.prompt_of(self.prompt, *self.langs, merged=True))
        try:
            units = services.parse_units(said)
            found = {u["id"]: u["text"] for u in units}
            if len(units) != len(members) or found.keys() != protected.keys() or not all(isinstance(t, str) for t in found.values()):
                raise ValueError("the merged translation has other units")
            out = []
            for m in members:
                text = tokens.accepted_of(m["text"], self.glossary.restore_of(protected[m["id"]], found[m["id"]].strip()))
                if text is None or not text.strip():
                    raise ValueError("a unit is empty or broke its tokens")
                out.append((m["id"], text, engine.name))
            return out
        except (ValueError, KeyError, TypeError) as e:
            raise ServiceError(f"merged response: {e}") from e

    def group(self, members: list[dict]) -> list[tuple]:
        """(id, text, engine, error) of a batch: halved on failure, left half first, unless halving can't help."""
        todo, out = deque([members]), []
        while todo:
            part = todo.popleft()
            if self.breaker.open:
                out += [(m["id"], None, None, _error(STOPPED, None, None, "Permanent")) for m in part]
                continue
            try:
                if len(part) == 1:
                    text, name = self.unit(part[0]["text"])
                    done = [(part[0]["id"], text, name)]
                else:
                    done = self.merged(part)
                out += [(*d, None) for d in done]
                self.breaker.record(True)
            except ServiceError as e:
                if len(part) > 1 and e.kind not in ("Permanent", "RateLimit"):
                    half = len(part) // 2
                    todo.extendleft([part[half:], part[:half]])
                else:
                    self.breaker.record(False)
                    out += [(m["id"], None, None, _error(str(e), e.status, e.retry_after, e.kind)) for m in part]
        return out


def _error(message: str, status: int | None, wait: float | None, kind: str) -> dict:
    return {"status": status, "retry_after_s": wait, "message": message, "kind": kind}


OUTCOME = "book string, id string, text string, engine_name string, error struct<status:int,retry_after_s:double,message:string,kind:string>"


def translate_groups(groups: DataFrame, engines: list[Engine], prompt: str, source_lang: str, target_lang: str, glossary: Glossary | None = None, policy: Policy = Policy()) -> DataFrame:
    """groups(book, members array<struct<ord, id, text>>) as outcomes, a row a unit: text and engine, or an error."""
    terms = glossary or Glossary([])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker = Worker(engines, terms, policy, prompt, source_lang, target_lang)
        with ThreadPoolExecutor(policy.concurrency) as pool:
            for pdf in frames:
                work = [[{"id": m["id"], "text": m["text"]} for m in members] for members in pdf["members"]]
                rows = [(book, *o) for book, done in zip(pdf["book"], pool.map(worker.group, work), strict=True) for o in done]
                yield pd.DataFrame(rows, columns=["book", "id", "text", "engine_name", "error"])

    source = groups.select("book", "members")
    return (source.repartition(policy.partitions) if policy.partitions else source).mapInPandas(run, OUTCOME)


def batch_results(outcomes: DataFrame) -> DataFrame:
    """(done, failed, stopped): units by how they ended; the failed ones include those that a breaker stopped."""
    told = F.col("error")
    return outcomes.agg(F.count_if(told.isNull()).alias("done"), F.count_if(told.isNotNull()).alias("failed"), F.count_if(told["message"] == STOPPED).alias("stopped"))
