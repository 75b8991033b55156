"""Model connectors: what turns a request into a raw answer."""

from __future__ import annotations

import base64
import http.client
import json
from dataclasses import dataclass, field
from typing import Protocol
from urllib.parse import urlsplit

from curata.sources.config import Settings

OK, RETRY, ERROR = "ok", "retry", "error"


class Connector(Protocol):
    """Called in the tasks. Returns (status, raw answer): retry asks for another attempt, error ends the request.

    A connector with a false `needs_content` is called without the bytes of images.
    """

    def process(self, request: dict) -> tuple[str, str | None]: ...


@dataclass
class RuleConnector:
    """A deterministic connector for tests: tags are the words of a table that a request's path or prompt data holds."""

    words: dict[str, str]
    fail: dict[str, int] = field(default_factory=dict)  # path -> attempts that fail first
    broken: tuple[str, ...] = ()  # paths that end in an error
    needs_content = False

    def process(self, request: dict) -> tuple[str, str | None]:
        path = request.get("image_path") or ""
        if path in self.broken:
            return ERROR, None
        if request["attempt"] < self.fail.get(path, 0):
            return RETRY, None
        tags = [tag for word, tag in self.words.items() if word in path]
        return OK, json.dumps({"detectedTags": tags or ["other"], "hasText": False, "textLanguageGuess": "", "emoji": "🙂", "keyword": "sticker"})


@dataclass
class HttpConnector:
    """A chat endpoint over HTTP/1.1 that takes messages with base64 images and a JSON schema for its answer.

    Text requests never fail here: their errors are answers that say so, as callers of such requests expect.
    """

    url: str
    model: str
    text_model: str = ""
    temperature: float = 0.3
    top_p: float = 0.9
    read_timeout: float = 60.0
    connect_timeout: float = 30.0
    _line: http.client.HTTPConnection | None = field(default=None, repr=False, compare=False)

    @classmethod
    def of(cls, settings: Settings) -> HttpConnector:
        return cls(settings.url, settings.vision_model, settings.text_model, read_timeout=settings.read_timeout, connect_timeout=settings.connect_timeout)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_line": None}  # each task has a connection of its own

    def body(self, request: dict) -> dict:
        message = {"role": "user", "content": request["prompt"]}
        if request["kind"] == "image":
            message["images"] = [base64.b64encode(request["content"]).decode()]
        elif request.get("context"):
            message["content"] = f"Context: {request['context']}\n\n{request['prompt']}"
        system = request.get("system_prompt") or ""
        options = {"temperature": self.temperature, "top_p": self.top_p, "num_ctx": int(request.get("context_size") or 4000)}
        out = {"model": self.model if request["kind"] == "image" else self.text_model or self.model, "stream": False, "options": options, "messages": [{"role": "system", "content": system}, message]}
        return out | ({"format": json.loads(request["json_format"])} if request.get("json_format") else {})

    def _post(self, body: bytes) -> tuple[int, bytes]:
        """Status and content of one call over the task's connection, which is opened anew after a failure."""
        where = urlsplit(self.url)
        try:
            if self._line is None:
                kind = http.client.HTTPSConnection if where.scheme == "https" else http.client.HTTPConnection
                self._line = kind(where.hostname, where.port, timeout=self.connect_timeout)
                self._line.connect()
            self._line.sock.settimeout(self.read_timeout)
            self._line.request("POST", f"{where.path.rstrip('/')}/api/chat", body, {"Content-Type": "application/json"})
            answer = self._line.getresponse()
            out = answer.status, answer.read()
            if answer.will_close:
                self._line = None
            return out
        except (OSError, http.client.HTTPException):
            self._line = None
            raise

    def process(self, request: dict) -> tuple[str, str | None]:
        image = request["kind"] == "image"
        try:
            code, content = self._post(json.dumps(self.body(request)).encode())
            if code < 400:
                return OK, json.loads(content)["message"]["content"]
            if not image:
                return OK, f"Error: HTTP status {code}"
            return (ERROR if code in (429, 503) else RETRY), None
        except (OSError, http.client.HTTPException, ValueError, KeyError, TypeError) as e:
            return (RETRY, None) if image else (OK, f"Error: {e}")

    def warm_up(self) -> str:
        """One call, so that the model is loaded before the first request; the start of its answer."""
        return (self.process({"kind": "text", "prompt": "hello", "attempt": 0})[1] or "")[:50]
