"""Settings of the engine: one immutable object, its values become literals."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    """``ordinal`` chooses how verdicts compare levels: by rank, or (False) as
    strings, which is how published results of these rules came about."""

    ordinal: bool = False
    strict: bool = False
    fail_closed: bool = True
    max_message_size: int = 51200
    max_unicode_density: float = 0.3
    sensitive_endpoints: tuple[tuple[str, int], ...] = (("/api/admin", 10), ("/admin", 10), ("/api/auth", 20))
    sensitive_paths: tuple[str, ...] = (".ssh", ".env", ".git/config", "credentials", "secrets", "id_rsa", "id_ed25519", ".aws", ".kube", "token")
    tool_overrides: tuple[tuple[str, int, bool, str], ...] = ()
    anomaly_threshold: float = 60.0
    anomaly_decay: float = 0.95
    transaction_limit: float = 100.0
    hourly_limit: float = 500.0
    daily_limit: float = 2000.0
    approval_cooldown: int = 60
    allowed_domains: tuple[str, ...] = ()
    ml_threshold: float = 0.7

    @classmethod
    def from_env(cls, prefix: str = "THREATLOOM_") -> Settings:
        """Settings with values from environment variables such as
        ``THREATLOOM_STRICT``; lists are comma-separated, endpoints ``path:rate``."""
        found = {}
        for f in fields(cls):
            raw = os.environ.get(prefix + f.name.upper())
            if raw is None:
                continue
            default = f.default
            if isinstance(default, bool):
                found[f.name] = raw.strip().lower() in ("1", "true", "yes", "on")
            elif isinstance(default, int | float):
                found[f.name] = type(default)(raw)
            elif f.name == "sensitive_endpoints":
                found[f.name] = tuple((path, int(rate)) for path, _, rate in (x.strip().rpartition(":") for x in raw.split(",") if x.strip()))
            elif f.name != "tool_overrides":
                found[f.name] = tuple(x.strip() for x in raw.split(",") if x.strip())
        return cls(**found)

    def with_(self, **changes) -> Settings:
        return replace(self, **changes)


DEFAULT = Settings()
