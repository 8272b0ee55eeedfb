"""Sources behind calls: caches, retries, limits, paging, pages; transports are given, so nothing here needs a network."""

from __future__ import annotations

import json
import os
import random
import time
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class QuotaError(RuntimeError):
    """Nothing that a second try would mend."""


class RetryError(RuntimeError):
    """A try may follow, after some seconds if the other side says so."""

    def __init__(self, message: str, after: float | None = None) -> None:
        super().__init__(message)
        self.after = after


def retried(call: Callable[[], object], *, tries: int = 4, base: float = 1.0, sleep: Callable[[float], None] = time.sleep, seed: int = 0) -> object:
    """The result of a call; on a RetryError it is made again after the stated or a doubling, jittered pause."""
    rng = random.Random(seed)
    for k in range(tries):
        try:
            return call()
        except RetryError as e:
            if k == tries - 1:
                raise
            sleep(e.after if e.after is not None else base * 2**k * (0.5 + rng.random()))
    raise AssertionError("tries must be positive")


class RateLimiter:
    """At most so many calls in any window of seconds."""

    def __init__(self, most: int, seconds: float = 60.0, *, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.most, self.seconds, self.clock, self.sleep = most, seconds, clock, sleep
        self.made: deque[float] = deque()

    def wait(self) -> None:
        now = self.clock()
        while self.made and now - self.made[0] >= self.seconds:
            self.made.popleft()
        if len(self.made) >= self.most:
            self.sleep(self.seconds - (now - self.made.popleft()))
            now = self.clock()
        self.made.append(now)


def ordered_map(work: Callable, items: Sequence, *, workers: int = 6) -> list:
    """Results in the order of the items; what a call raised stands in its place."""

    def one(item: object) -> object:
        try:
            return work(item)
        except Exception as e:  # noqa: BLE001 - handed on as a value
            return e

    with ThreadPoolExecutor(max_workers=workers) as pool:
        return list(pool.map(one, items))


def within_budget(estimate: float, approved: float | None) -> None:
    """Refuse to go on unless so much has been approved."""
    if approved is None or approved < estimate:
        raise PermissionError(f"estimated {estimate:.2f}, approved {approved if approved is not None else 'nothing'}")


def dry_run(requests: DataFrame, path: str, *, price: float = 0.0) -> dict:
    """Write the requests that would be made as JSON lines; their number and cost."""
    requests.write.mode("errorifexists").json(path)
    n = requests.sparkSession.read.json(path).count()
    return {"requests": n, "cost": round(n * price, 4)}


def read_document(path: str | Path) -> dict:
    """A stage's JSON document; a missing one ends the run with its name."""
    at = Path(path)
    if not at.is_file():
        raise FileNotFoundError(f"{at} is missing: run the stage that writes it")
    return json.loads(at.read_text(encoding="utf-8"))


def merged_metadata(path: str | Path, **values: object) -> dict:
    """A JSON document with some fields set, written whole and renamed into place."""
    at = Path(path)
    document = json.loads(at.read_text(encoding="utf-8")) if at.is_file() else {}
    document |= values
    draft = at.with_name(f".{at.name}.{os.getpid()}")
    draft.write_text(json.dumps(document, ensure_ascii=False, indent=1, sort_keys=True), encoding="utf-8")
    draft.replace(at)
    return document


def run_folder(root: str | Path, name: str, *, shared: str = "brain") -> Path:
    """Where a run's files go: the shared folder if the root has one, else the root; the highest numbered run of a name."""
    base = Path(root) / shared if (Path(root) / shared).is_dir() else Path(root)
    runs = sorted((p for p in base.glob(f"{name}-*") if p.name.rsplit("-", 1)[1].isdigit()), key=lambda p: int(p.name.rsplit("-", 1)[1]))
    return runs[-1] if runs else base / f"{name}-1"


def deep_merge(base: dict, over: dict) -> dict:
    """Settings with others laid over, folder by folder."""
    return base | {k: deep_merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def registry_rows(document: dict) -> list[tuple]:
    """``id, label, endpoint, parameter, extra, enabled``, of the platforms of every tier, extras as ``k=v&k=v``."""
    rows = []
    for tier, entries in document.items():
        for e in entries if isinstance(entries, list) else []:
            extra = "&".join(f"{k}={v}" for k, v in sorted((e.get("extra_params") or {}).items()))
            rows.append((tier, e["id"], e.get("label", e["id"]), e.get("endpoint", ""), e.get("param") or "", extra, bool(e.get("default_enabled", False))))
    return rows


def paged(fetch: Callable[[int, int], list], *, size: int = 1000, most: int | None = None) -> Iterator:
    """Items page by page until a page is short."""
    offset = 0
    while most is None or offset < most:
        page = fetch(offset, size)
        yield from page
        offset += len(page)
        if len(page) < size:
            return


def awaited(state: Callable[[], str], *, done: Sequence[str] = ("SUCCEEDED",), failed: Sequence[str] = ("FAILED", "ABORTED", "TIMED-OUT"), most: float = 600.0, step: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """Poll until a run ends; too long a wait is an error."""
    waited = 0.0
    while True:
        now = state()
        if now in done:
            return now
        if now in failed or waited >= most:
            raise RuntimeError(f"run is {now} after {waited:.0f} s")
        sleep(step)
        waited += step


def missing_answers(requests: DataFrame, cache: DataFrame, *, payload: str = "payload") -> DataFrame:
    """Requests with their ``key``, the sha256 of the payload, that the cache has no answer for; each payload once."""
    keyed = requests.withColumn("key", F.sha2(F.col(payload), 256)).dropDuplicates(["key"])
    return keyed.join(cache.select("key").distinct(), "key", "left_anti")


def answered(requests: DataFrame, call: Callable[[str], str], *, tries: int = 3, payload: str = "payload") -> DataFrame:
    """``key, answer, error`` of requests, called in the tasks that hold them; an error is a value, never a lost row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for key, text in zip(part["key"], part[payload], strict=True):
                try:
                    rows.append((key, retried(lambda text=text: call(text), tries=tries), None))
                except Exception as e:  # noqa: BLE001 - the row says why
                    rows.append((key, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["key", "answer", "error"])

    return requests.mapInPandas(run, "key string, answer string, error string")


def fetched(urls: DataFrame, transport: Callable[[str], tuple[int, str, dict]], *, url: str = "url", hops: int = 10, pause: float = 1.0) -> DataFrame:
    """``url, status, final, hops, body`` of pages; redirects are followed one by one, a refusal is tried once more."""

    def one(address: str) -> tuple:
        at, n, again = address, 0, True
        while True:
            status, body, headers = transport(at)
            if status in (403, 429, 503) and again:
                again = False
                time.sleep(pause)
            elif status in (301, 302, 303, 307, 308) and headers.get("location") and n < hops:
                at, n = urljoin(at, headers["location"]), n + 1
            else:
                return address, status, at, n, body

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([one(u) for u in part[url]], columns=["url", "status", "final", "hops", "body"])

    return urls.select(url).mapInPandas(run, "url string, status int, final string, hops int, body string")


# Where the answers of three interfaces keep their parts.
ANSWER_PATHS = {"answer": ("answer", "output_text", "choices[0].message.content"), "citations": ("citations", "sources", "search_results"), "searches": ("fan_out", "queries", "search_queries"), "cost": ("cost", "usage.cost", "price"), "error": ("error.message", "error")}


def normalised_answers(raw: DataFrame, *, body: str = "body") -> DataFrame:
    """Answers of any interface as ``answer, citations, searches, cost, error``."""
    found = lambda paths: F.coalesce(*[F.when(v != "", v) for v in (F.get_json_object(body, f"$.{p}") for p in paths)])
    fields = [found(p).cast("double" if n == "cost" else "string").alias(n) for n, p in ANSWER_PATHS.items()]
    return raw.select(*[c for c in raw.columns if c != body], *fields)


def organic(responses: DataFrame, *, key: str, body: str = "body", depth: int = 10) -> DataFrame:
    """``key, rank, url`` of the organic results of search responses, the best of each address, up to a depth."""
    items = F.from_json(F.get_json_object(body, "$.organic"), "array<struct<rank:int,url:string>>")
    each = responses.select(key, F.explode(items).alias("x")).select(key, "x.rank", "x.url").where("url is not null")
    return each.groupBy(key, "url").agg(F.min("rank").alias("rank")).where(F.col("rank") <= depth)


def embedded(texts: DataFrame, call: Callable[[list[str]], list[list[float]]], *, key: str, text: str, size: int = 256) -> DataFrame:
    """``key, vector`` of texts, asked for in batches, of unit length."""
    kind = dict(texts.dtypes)[key]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lo in range(0, len(part), size):
                own = part.iloc[lo : lo + size]
                vectors = call(own[text].tolist())
                norms = [sum(x * x for x in v) ** 0.5 or 1.0 for v in vectors]
                yield pd.DataFrame({key: own[key].tolist(), "vector": [[x / n for x in v] for v, n in zip(vectors, norms, strict=True)]})

    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, vector array<double>")
