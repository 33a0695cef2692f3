"""Settings of a deployment, decoded once and checked before anything runs."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from urllib.parse import urlsplit

_UNITS = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0}
LEAST_SECRET = 32


def duration(text: str | None, fallback: float) -> float:
    """Seconds of ``250ms``, ``0.5s``, ``15m``, ``2h``, ``7d`` or a bare number; anything else gives the fallback."""
    found = re.fullmatch(r"([0-9]+(?:\.[0-9]+)?)(ms|s|m|h|d)?", (text or "").strip())
    return float(found[1]) * _UNITS[found[2] or "s"] if found else fallback


def secure_origin(text: str) -> bool:
    """Whether a text is an https origin and nothing more."""
    try:
        url = urlsplit(text)
        return url.scheme == "https" and bool(url.hostname) and f"https://{url.netloc}" == text and "@" not in url.netloc
    except ValueError:
        return False


@dataclass(frozen=True)
class Settings:
    """Times are in seconds."""

    production: bool = False
    origin: str = "http://127.0.0.1:5173"
    cursor_secret: str = ""
    prefix: str = "gridlume"
    fact_ttl: float = 15 * 60
    fact_stale_ttl: float = 7 * 86400
    directory_ttl: float = 7 * 86400
    cursor_ttl: float = 10 * 60

    @classmethod
    def load(cls, env: Mapping[str, str]) -> Settings:
        """Settings of an environment; a production one without an https origin or a long secret fails at once."""
        production = env.get("GRIDLUME_MODE") == "production"
        out = cls(
            production,
            env.get("GRIDLUME_ORIGIN", cls.origin),
            env.get("GRIDLUME_CURSOR_SECRET", "" if production else "local-development-secret-of-no-value"),
            env.get("GRIDLUME_PREFIX", cls.prefix),
            duration(env.get("GRIDLUME_FACT_TTL"), cls.fact_ttl),
            duration(env.get("GRIDLUME_FACT_STALE_TTL"), cls.fact_stale_ttl),
            duration(env.get("GRIDLUME_DIRECTORY_TTL"), cls.directory_ttl),
            duration(env.get("GRIDLUME_CURSOR_TTL"), cls.cursor_ttl),
        )
        if production and (not secure_origin(out.origin) or len(out.cursor_secret) < LEAST_SECRET):
            raise ValueError("production needs an https origin and a signing secret of 32 characters or more")
        return out
