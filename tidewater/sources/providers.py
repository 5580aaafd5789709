"""Model providers behind an injected transport: payloads, keys in turn, answers."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field

#: Sends (url, headers, JSON) and gives the decoded JSON answer, or raises.
Post = Callable[[str, dict, dict], dict]


@dataclass
class Provider:
    """One model. `kind`: local (chat at /api/chat) or compatible (chat completions with a key)."""

    kind: str
    url: str
    model: str
    post: Post
    keys: list[str] = field(default_factory=list)
    options: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.kind not in ("local", "compatible"):
            raise ValueError(f"unknown kind {self.kind}")
        self._turn = itertools.count()

    def next_key(self) -> str | None:
        """Keys are used in turn."""
        return self.keys[next(self._turn) % len(self.keys)] if self.keys else None

    def __call__(self, prompt: str) -> str:
        """The answer's text; an answer without any is an error."""
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "stream": False, **self.options}
        if self.kind == "local":
            found = self.post(f"{self.url.rstrip('/')}/api/chat", {}, body).get("message") or {}
        else:
            key = self.next_key()
            answer = self.post(self.url, {"Authorization": f"Bearer {key}"} if key else {}, body)
            first = (answer.get("choices") or [{}])[0]
            found = first.get("message") or {} if isinstance(first, dict) else {}
        if not (text := found.get("content")):
            raise ConnectionError("the answer is empty")
        return text


def keys_of(config: dict, environment: dict[str, str]) -> list[str]:
    """Keys of a configuration (api_keys, api_key) or of the environment variable that it names, each once."""
    listed = [*(config.get("api_keys") or []), config.get("api_key"), environment.get(config.get("api_key_env") or "", "")]
    return list(dict.fromkeys(k.strip() for k in listed if isinstance(k, str) and k.strip()))
