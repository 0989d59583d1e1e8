"""Page and model access over HTTP with a bounded number of attempts.  Tests pass their own ``open``."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusforge.functions.prompts import turns

#: Status codes worth another try.
RETRY = frozenset({408, 409, 425, 429}) | frozenset(range(500, 600))


def attempt(call: Callable[[], str], attempts: int = 2, pause: Callable[[int], float] = lambda n: 1.5 * n, again: Callable[[Exception], bool] = lambda e: True) -> str:
    """call() until it gives a non-empty text; the last error is raised."""
    for n in range(1, attempts + 1):
        try:
            if text := call():
                return text
            raise ValueError("empty answer")
        except Exception as error:
            if n == attempts or not again(error):
                raise
            time.sleep(pause(n))
    raise ValueError("no attempts")


def get(url: str) -> str:
    with urllib.request.urlopen(url, timeout=30) as answer:
        return answer.read().decode("utf-8", "replace")


def fetch(pages: DataFrame, attempts: int = 2, open: Callable[[str], str] = get) -> DataFrame:
    """(page_id, html, error): each page's text or what went wrong; one failure doesn't end the others."""

    def run(batches):
        for batch in batches:
            html, errors = [], []
            for url in batch.column("source_url").to_pylist():
                try:
                    html.append(attempt(lambda u=url: open(u), attempts))
                    errors.append(None)
                except Exception as error:
                    html.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(html, pa.string()), pa.array(errors, pa.string())], ["page_id", "html", "error"])

    return pages.select("page_id", "source_url").mapInArrow(run, "page_id string, html string, error string")


def retryable(error: Exception) -> bool:
    return not isinstance(error, urllib.error.HTTPError) or error.code in RETRY


def post(url: str, body: dict, key: str | None = None) -> dict:
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), head), timeout=60) as answer:
        return json.load(answer)


Send = Callable[[str, dict, str | None], dict]


def _asking(send: Send, url: str, key: str | None, retries: int, body: Callable[[list], dict], read: Callable[[dict], str]) -> Callable[[str, list], str]:
    return lambda question, candidates: attempt(lambda: read(send(url, body(turns(question, candidates)), key)), 1 + retries, lambda n: 0.5 * 2 ** (n - 1), retryable)


def generator(url: str, model: str, key: str | None = None, retries: int = 2, send: Send = post) -> Callable[[str, list], str]:
    """A generator for ``operators.answers`` that asks a chat-completions endpoint; only passing faults are tried again."""
    return _asking(send, url, key, retries, lambda turns: {"model": model, "messages": turns, "temperature": 0, "max_tokens": 400}, lambda got: got["choices"][0]["message"]["content"])


def ollama(url: str, model: str, retries: int = 2, send: Send = post) -> Callable[[str, list], str]:
    """The same for an Ollama server's chat endpoint."""
    return _asking(send, url, None, retries, lambda turns: {"model": model, "messages": turns, "stream": False, "options": {"temperature": 0, "num_predict": 400}}, lambda got: got["message"]["content"])
