"""Finding and checking what a run needs before it starts."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from .sources.tables import exists


def find(preferred: str, root: str, depth: int = 2) -> str:
    """The preferred local file if it is there, else the only one of its name in root, not deeper than ``depth`` folders. Several, or none, are an error."""
    if os.path.isfile(preferred):
        return os.path.abspath(preferred)
    name, found = os.path.basename(preferred), []
    for folder, inner, files in os.walk(root):
        below = os.path.relpath(folder, root)
        if below != "." and below.count(os.sep) + 1 >= depth:
            inner[:] = []
        if name in files:
            found.append(os.path.abspath(os.path.join(folder, name)))
    if not found:
        raise FileNotFoundError(f"no {name} at {preferred} or in {root}")
    if len(found) > 1:
        raise RuntimeError(f"several files are called {name}: {sorted(found)}; name one")
    return found[0]


@dataclass
class Config:
    """Paths, intervals in seconds and credentials of a run. What is secret comes from the environment only."""

    inputs: dict[str, str] = field(default_factory=dict)
    fast_seconds: int = 300
    slow_seconds: int = 3600
    token_variable: str = "MESSAGES_TOKEN"
    chat_variable: str = "MESSAGES_CHAT"

    @property
    def messages_on(self) -> bool:
        return bool(os.environ.get(self.token_variable) and os.environ.get(self.chat_variable))

    def check(self, spark: SparkSession) -> list[str]:
        """What will be used, one line each, with the token masked; an error if an input is missing."""
        for label, path in self.inputs.items():
            if not exists(spark, path):
                raise FileNotFoundError(f"{label}: nothing at {path}")
        token = os.environ.get(self.token_variable, "")
        masked = f"{token[:6]}..." if len(token) > 6 else "..."
        return [*(f"{label} = {path}" for label, path in self.inputs.items()), f"messages = {f'on ({masked})' if self.messages_on else 'off'}"]
