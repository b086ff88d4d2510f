"""JSON caches on the driver: plans by question, relationships and other facts by catalog fingerprint. Results are never kept."""

from __future__ import annotations

import fcntl
import json
import os
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import Any

from .ir import Plan

FILLER = re.compile(r"\b(please|kindly|can you|could you|would you|show me|give me|tell me|i want to know|i would like to know)\b")


def canonical(question: str) -> str:
    """Questions that differ in case, spacing, punctuation at the end or politeness are one."""
    text = FILLER.sub(" ", question.lower())
    return " ".join(re.sub(r"[?!.,;:]+(?=\s|$)", " ", text).split())


class JsonCache:
    """A dict in a file; each write replaces the file whole, so a reader never sees half of one."""

    def __init__(self, path: str | os.PathLike[str]) -> None:
        self.path = Path(path)

    def read(self) -> dict[str, Any]:
        try:
            return json.loads(self.path.read_text())
        except (FileNotFoundError, ValueError):
            return {}

    def write(self, held: dict[str, Any]) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with tempfile.NamedTemporaryFile("w", dir=self.path.parent, delete=False) as out:
            json.dump(held, out, sort_keys=True)
            out.flush()
            os.fsync(out.fileno())
        os.replace(out.name, self.path)

    @contextmanager
    def _alone(self) -> Iterator[None]:
        """One writer at a time, threads and processes alike, so that no entry is lost between read and write."""
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with open(f"{self.path}.lock", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            yield

    def put(self, key: str, value: Any) -> None:
        with self._alone():
            self.write(self.read() | {key: value})

    def drop(self, key: str) -> None:
        with self._alone():
            self.write({k: v for k, v in self.read().items() if k != key})


class PlanCache(JsonCache):
    """Validated plans under question and fingerprint; all fields are kept, the inner aggregation and distinct included."""

    @staticmethod
    def key(question: str, fingerprint: str) -> str:
        return f"{fingerprint}:{canonical(question)}"

    def get(self, question: str, fingerprint: str) -> Plan | None:
        held = self.read().get(self.key(question, fingerprint))
        return None if held is None else Plan.from_json(held)

    def keep(self, question: str, fingerprint: str, plan: Plan) -> None:
        self.put(self.key(question, fingerprint), json.loads(plan.to_json()))
