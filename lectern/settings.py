"""Settings of an application over the library, from the environment, and its log."""

from __future__ import annotations

import logging
import os
from collections.abc import Mapping
from dataclasses import dataclass
from logging.handlers import RotatingFileHandler

from lectern.functions.digest import local_endpoint


@dataclass(frozen=True)
class Settings:
    inbox: str = "inbox"
    store: str = "library"
    logs: str = "logs"
    provider: str = "none"
    endpoint: tuple[str, int] = ("127.0.0.1", 11434)
    retries: int = 1


def read(environment: Mapping[str, str] | None = None, prefix: str = "LECTERN_") -> Settings:
    """Settings by variables such as ``LECTERN_INBOX``; blank ones keep their default, bad ones are errors."""
    env = os.environ if environment is None else environment
    given = {name: env[prefix + name.upper()].strip() for name in Settings.__dataclass_fields__ if env.get(prefix + name.upper(), "").strip()}
    if "endpoint" in given:
        given["endpoint"] = local_endpoint(given["endpoint"])
    if "retries" in given:
        if given["retries"] not in ("0", "1"):
            raise ValueError("retries must be 0 or 1")
        given["retries"] = int(given["retries"])
    return Settings(**given)


def logger(settings: Settings, size: int = 1 << 20, kept: int = 3) -> logging.Logger:
    """A rotating log. Callers write ids, counts and class names to it, never texts or paths."""
    out = logging.getLogger("lectern")
    if not out.handlers:
        os.makedirs(settings.logs, exist_ok=True)
        handler = RotatingFileHandler(os.path.join(settings.logs, "lectern.log"), maxBytes=size, backupCount=kept, encoding="utf-8")
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        out.addHandler(handler)
        out.setLevel(logging.INFO)
    return out
