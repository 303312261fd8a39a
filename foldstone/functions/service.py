"""What a service around the engine needs of a request."""

from __future__ import annotations

import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Status to HTTP code; anything else is 500 (fixed values).
HTTP = {"ok": 200, "invalid_argument": 400, "not_found": 404, "unavailable": 503, "timeout": 504, "not_supported": 501, "internal": 500}


def http_status(status: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for pair in HTTP.items() for x in pair])
    return F.coalesce(codes[status], F.lit(500))


def trace_id(given: Column) -> Column:
    """The trace id that came along, or a new one."""
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), F.uuid())


def authorized(required: bool, key: str, authorization: str = "", api_key: str = "") -> bool:
    """Whether a request's key is the one set: the bearer token if there is one, else the
    plain header. A key that is required but not set lets nobody in."""
    if not required:
        return True
    given = authorization.strip()
    given = given[7:].strip() if given[:7].lower() == "bearer " else api_key.strip()
    return bool(key) and hmac.compare_digest(given.encode(), key.encode())
