"""Canonical JSON, digests and strict values on the driver."""

from __future__ import annotations

import hashlib
import ipaddress
import json
import math
from typing import Any
from urllib.parse import urlsplit


def canonical_bytes(value: Any) -> bytes:
    """JSON with sorted keys, no spaces, raw UTF-8; NaN and infinities are refused."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()


def content_digest(value: Any) -> str:
    return hashlib.sha256(canonical_bytes(value)).hexdigest()


def sealed(content: Any) -> dict[str, Any]:
    return {"content": content, "content_digest": content_digest(content)}


def unsealed(artifact: dict[str, Any]) -> Any:
    """Content of an envelope whose digest holds."""
    if set(artifact) != {"content", "content_digest"} or content_digest(artifact["content"]) != artifact["content_digest"]:
        raise ValueError("the artifact does not match its digest")
    return artifact["content"]


def read_json_object(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8-sig") as f:
        value = json.load(f)
    if not isinstance(value, dict):
        raise ValueError("a JSON object is required")
    return value


def positive_id(value: Any) -> int:
    """An id is an int (not a bool) from 1 to 2**63 - 1."""
    if type(value) is not int or not 1 <= value < 1 << 63:
        raise ValueError("an id must be a positive 64-bit integer")
    return value


def flag(value: Any) -> bool:
    if type(value) is not bool:
        raise ValueError("a flag must be true or false")
    return value


def seconds(value: Any) -> float | None:
    if value is None:
        return None
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or value < 0:
        raise ValueError("a duration must be a finite number of at least 0")
    return float(value)


def local_endpoint(url: str) -> tuple[str, int]:
    """Host and port of an http URL on a loopback address, without credentials, path, query or fragment."""
    parts = urlsplit(url)
    if parts.scheme != "http" or parts.username is not None or parts.password is not None or parts.path not in ("", "/") or parts.query or parts.fragment:
        raise ValueError("a plain http URL of this machine is required")
    host = "127.0.0.1" if parts.hostname == "localhost" else parts.hostname or ""
    if not ipaddress.ip_address(host).is_loopback:
        raise ValueError("a loopback address is required")
    return host, parts.port or 11434
