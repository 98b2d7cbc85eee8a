"""A client for a local model server that answers questions about pictures in JSON.

The engine functions of ``operators.enrichment`` are what such a client's ``describe`` returns; it
is created in the worker, so it holds no connection when it is sent there.
"""

from __future__ import annotations

import base64
import html
import json
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame

#: What an answer must look like.
ANSWER_SCHEMA = {
    "type": "object",
    "properties": {"type": {"type": "string"}, "description": {"type": "string"}, "visible_text": {"type": "string"}, "keywords": {"type": "array", "items": {"type": "string"}}},
    "required": ["type", "description", "visible_text", "keywords"],
}


class ModelClient:
    """Calls ``<url>/api/chat`` of one model; a proxy is never used."""

    def __init__(self, url: str, model: str, prompt: str, timeout: float = 120.0, attempts: int = 2):
        self.url, self.model, self.prompt, self.timeout, self.attempts = url.rstrip("/"), model, prompt, timeout, attempts

    def _post(self, path: str, body: dict | None) -> dict:
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(self.url + path, data, {"Content-Type": "application/json"})
        opener = urllib.request.build_opener(urllib.request.ProxyHandler({}))
        with opener.open(request, timeout=self.timeout) as answer:
            return json.load(answer)

    def available(self) -> bool:
        try:
            return any(m.get("name") == self.model for m in self._post("/api/tags", None).get("models", []))
        except OSError:
            return False

    def describe(self, image: bytes, context: str = "") -> str:
        """The JSON text of an answer. A server that does not know ``think`` is asked again without it; a time-out is not repeated."""
        body = {
            "model": self.model, "stream": False, "think": False, "format": ANSWER_SCHEMA, "options": {"temperature": 0},
            "messages": [{"role": "user", "content": f"{self.prompt}\n{context}".strip(), "images": [base64.b64encode(image).decode()]}],
        }
        for attempt in range(self.attempts):
            try:
                return self._post("/api/chat", body)["message"]["content"]
            except urllib.error.HTTPError as e:
                if e.code == 400 and "think" in body:
                    del body["think"]
                elif attempt + 1 == self.attempts:
                    raise
            except TimeoutError:
                raise
            except (OSError, KeyError, ValueError):
                if attempt + 1 == self.attempts:
                    raise
        return self._post("/api/chat", body)["message"]["content"]


def lazy(make: Callable[[], Callable[[bytes], str]]) -> Callable[[bytes], str]:
    """An engine that is made at its first call in each worker."""
    made: list[Callable[[bytes], str]] = []

    def call(image: bytes) -> str:
        if not made:
            made.append(make())
        return made[0](image)

    return call


def comparison_page(compared: DataFrame, answers: DataFrame, title: str = "Models compared") -> str:
    """An HTML report of compare_models() and of single answers (model, sha1, answer); a sample, so it fits the driver."""
    cell = lambda x: f"<td>{html.escape('' if x is None else f'{x:.2f}' if isinstance(x, float) else str(x))}</td>"
    table = lambda df: f"<table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in df.columns)}</tr>" + "".join(f"<tr>{''.join(map(cell, r))}</tr>" for r in df.collect()) + "</table>"
    return f"<!DOCTYPE html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{table(compared.orderBy('model'))}{table(answers.orderBy('sha1', 'model').limit(500))}"
