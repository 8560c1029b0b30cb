"""Classes of judge failures, by what the judge printed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Needles in lower-cased output.
QUOTA = ("usage limit", "rate limit", "quota", "too many requests", "try again later")
AUTH = (
    "401 unauthorized",
    "app_session_terminated",
    "token_revoked",
    "token_invalidated",
    "refresh_token_invalidated",
    "your session has ended",
    "please log in again",
    "failed to refresh token",
    "access token could not be refreshed",
    "refresh token was revoked",
)


def classify_text(text: str) -> str:
    """auth before quota before other."""
    low = text.lower()
    return "auth" if any(n in low for n in AUTH) else "quota" if any(n in low for n in QUOTA) else "other"


def _any(low: Column, needles: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | low.contains(n)
    return out


def classify(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(_any(low, AUTH), "auth").when(_any(low, QUOTA), "quota").otherwise("other")
