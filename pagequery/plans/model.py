"""Models behind a protocol, metered: nothing here calls one unless the caller brings it."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field
from typing import Any, Protocol

from pagequery.functions.jsonpaths import loose_json


class BudgetExceeded(RuntimeError):
    """A run has used up its tokens, fetches or renders."""


class Backend(Protocol):
    def ask(self, prompt: str, system: str, max_tokens: int) -> tuple[str, int, int]:
        """(text, tokens in, tokens out)"""


@dataclass
class Meter:
    budget_tokens: int = 400_000
    tokens_in: int = 0
    tokens_out: int = 0
    calls: int = 0
    by_purpose: dict[str, tuple[int, int]] = field(default_factory=dict)

    def __post_init__(self):
        self._lock = threading.Lock()

    def add(self, purpose: str, tokens_in: int, tokens_out: int) -> None:
        with self._lock:
            self.tokens_in += tokens_in
            self.tokens_out += tokens_out
            self.calls += 1
            a, b = self.by_purpose.get(purpose, (0, 0))
            self.by_purpose[purpose] = (a + tokens_in, b + tokens_out)

    def check(self) -> None:
        if self.tokens_in + self.tokens_out >= self.budget_tokens:
            raise BudgetExceeded("tokens")


class Model:
    """A backend with a meter; answers are parsed, with one more try."""

    def __init__(self, backend: Backend, meter: Meter | None = None):
        self.backend, self.meter = backend, meter or Meter()

    def ask(self, prompt: str, system: str, purpose: str, max_tokens: int = 4000) -> str:
        self.meter.check()
        text, a, b = self.backend.ask(prompt, system, max_tokens)
        self.meter.add(purpose, a or len(prompt) // 4, b or len(text) // 4)
        return text

    def ask_json(self, prompt: str, system: str, purpose: str, max_tokens: int = 4000) -> Any:
        for extra in ("", "\nAnswer with JSON only."):
            if (found := loose_json(self.ask(prompt + extra, system, purpose, max_tokens))) is not None:
                return found
        return None
