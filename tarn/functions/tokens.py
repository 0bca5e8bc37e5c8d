"""Signed tokens (HS256) and the access gate in front of a service."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import time

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _encode(raw: bytes) -> str:
    return base64.urlsafe_b64encode(raw).rstrip(b"=").decode()


def _decode(text: str) -> bytes:
    return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))


def sign(payload: dict, secret: str) -> str:
    head = _encode(json.dumps({"alg": "HS256", "typ": "JWT"}, separators=(",", ":")).encode())
    body = _encode(json.dumps(payload, separators=(",", ":")).encode())
    mark = hmac.new(secret.encode(), f"{head}.{body}".encode(), hashlib.sha256).digest()
    return f"{head}.{body}.{_encode(mark)}"


def verify(token: str | None, secret: str, now: float | None = None) -> dict | None:
    """The payload of a token whose signature holds and whose ``exp`` hasn't passed, else None."""
    try:
        head, body, mark = (token or "").split(".")
        good = hmac.new(secret.encode(), f"{head}.{body}".encode(), hashlib.sha256).digest()
        if not hmac.compare_digest(good, _decode(mark)):
            return None
        payload = json.loads(_decode(body))
    except (ValueError, TypeError):
        return None
    if not isinstance(payload, dict) or "exp" in payload and payload["exp"] < (time.time() if now is None else now):
        return None
    return payload


def verified(token: Column | str, secret: str, now: float | None = None) -> Column:
    """JSON of the payload of a column's tokens, null where they don't hold."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: (p := verify(t, secret, now)) and json.dumps(p, sort_keys=True))

    return run(token)
