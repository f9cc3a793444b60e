"""Access decisions and redaction of audit details."""

from __future__ import annotations

import itertools
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Paths (with a star: all that start so), methods (with ! all but this one) and the permission they need;
# the first match wins, and '' is open to everyone.
PATHS = [
    ("/api/live", "*", ""), ("/api/health", "*", ""), ("/api/auth/login", "*", ""), ("/api/auth/*", "*", "data.read"),
    ("/api/admin/users*", "*", "security.manage"),
    ("/api/admin/standards*", "!GET", "knowledge.manage"), ("/api/admin/standards*", "GET", "data.read"),
    ("/api/knowledge*", "!GET", "knowledge.manage"), ("/api/knowledge*", "GET", "data.read"),
    ("/api/security/audit/verify*", "*", "audit.verify"), ("/api/security/audit*", "*", "audit.read"), ("/api/blockchain*", "*", "audit.read"),
    ("/api/compliance*", "!GET", "compliance.manage"), ("/api/compliance*", "GET", "compliance.read"),
    ("/api/governance/controls*", "!GET", "compliance.manage"), ("/api/governance/controls*", "GET", "data.read"),
    ("/api/governance/issues*", "!GET", "review.decide"), ("/api/governance/issues*", "GET", "data.read"),
    ("/api/governance/catalog*", "*", "data.read"), ("/api/*", "DELETE", "data.purge"),
    ("/api/vectors/rebuild", "*", "knowledge.manage"), ("/api/ocr/install", "!GET", "knowledge.manage"),
    ("/api/distribute", "*", "distribution.execute"), ("/api/feedback", "*", "feedback.write"), ("/api/reviews*", "!GET", "review.decide"),
    ("/api/lifecycle", "POST", "lifecycle.create"), ("/api/lifecycle/*", "PATCH", ""),
    *((f"/api/{p}", "*", "data.ingest") for p in ("batches", "upload", "govern", "governance", "demo/run", "ocr")),
    *((f"/api/{p}*", "!GET", "ai.use") for p in ("semantic", "classify", "agent", "intent", "explain", "search", "standards/search", "vectors/search")),
]
GRANTS = {
    "GROUP_ADMIN": ["*"],
    "GROUP_APPROVER": [
        "data.read", "report.read", "ai.use", "review.decide", "lifecycle.review", "lifecycle.approve", "distribution.execute",
        "audit.read", "audit.verify", "compliance.read",
    ],
    "PLANT_STEWARD": ["data.read", "report.read", "data.ingest", "ai.use", "review.decide", "lifecycle.create", "lifecycle.review", "feedback.write"],
    "AUDITOR": ["data.read", "report.read", "audit.read", "audit.verify", "compliance.read"],
}
MARKERS = ["password", "authorization", "api_key", "apikey", "secret", "token", "cookie", "credential", "private_key", "privatekey"]
# Limits of what an audit entry shows.
DEEPEST, MOST_ENTRIES, KEY_LENGTH, TEXT_LENGTH = 8, 100, 100, 500
HIDDEN, TOO_DEEP = "[REDACTED]", "[MAX_DEPTH]"
# End of fixed values.
_SECRET = re.compile("|".join(MARKERS))


def needed_permission(path: Column, method: Column) -> Column:
    """The permission a request needs; '' if it is open. What no rule names is data.read."""
    out, said = F.when(~path.startswith("/api/"), ""), F.upper(method)
    for pattern, methods, permission in PATHS:
        here = path.startswith(pattern[:-1]) if pattern.endswith("*") else path == pattern
        if methods != "*":
            here &= said != methods[1:] if methods.startswith("!") else said == methods
        out = out.when(here, permission)
    return out.otherwise("data.read")


def allowed(role: Column, permission: Column) -> Column:
    granted = F.create_map(*(x for r, g in GRANTS.items() for x in (F.lit(r), F.array(*(F.lit(p) for p in g)))))[role]
    return (permission == "") | F.coalesce(F.array_contains(granted, "*") | F.array_contains(granted, permission), F.lit(False))


def redact(details: Column) -> Column:
    """A map of details with the values of secret keys replaced and other values cut at 500 characters."""
    secret = lambda k: F.lower(F.replace(k, F.lit("-"), F.lit("_"))).rlike("|".join(MARKERS))
    return F.transform_values(details, lambda k, v: F.when(secret(k), HIDDEN).otherwise(F.substring(v, 1, TEXT_LENGTH)))


def _masked(pairs: list) -> dict:
    """An object as the JSON reader hands it over: its first entries, keys cut short, values of secret keys hidden."""
    entries = itertools.islice(dict(pairs).items(), MOST_ENTRIES)
    return {key[:KEY_LENGTH]: HIDDEN if _SECRET.search(key.lower().replace("-", "_")) else value for key, value in entries}


def _trimmed(value):
    """A read JSON value with long arrays and texts cut and what lies too deep replaced, level by level."""
    level, root = [[value]], None
    for depth in itertools.count():
        inner = []
        for box in level:
            if isinstance(box, list):
                del box[MOST_ENTRIES:]
            for slot in range(len(box)) if isinstance(box, list) else box:
                held = box[slot]
                if depth > DEEPEST:
                    box[slot] = HIDDEN if held == HIDDEN else TOO_DEEP
                elif isinstance(held, str):
                    box[slot] = held[:TEXT_LENGTH]
                elif isinstance(held, (dict, list)):
                    inner.append(held)
        root = root or level[0]
        if not inner:
            return root[0]
        level = inner


@F.pandas_udf(T.StringType())
def redact_json(details: pd.Series) -> pd.Series:
    """JSON texts with the values of secret keys replaced at every level; a text that is no JSON is cut at 500 characters, null stays null."""

    def one(text):
        if text is None:
            return None
        try:
            return json.dumps(_trimmed(json.loads(text, object_pairs_hook=_masked)), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return text[:TEXT_LENGTH]

    return details.map(one)
