"""Clock, settings and the worker's entry."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import lru_cache
from typing import Protocol, runtime_checkable


@runtime_checkable
class Clock(Protocol):
    def now(self) -> datetime: ...


class SystemClock:
    """The only reader of the wall clock."""

    def now(self) -> datetime:
        return datetime.now(UTC)


class FixedClock:
    """A replay's clock; an instant without a zone is refused."""

    def __init__(self, instant: datetime):
        if instant.tzinfo is None or instant.utcoffset() is None:
            raise ValueError("the instant needs a time zone")
        self._instant = instant.astimezone(UTC)

    def now(self) -> datetime:
        return self._instant


def as_of(clock: Clock) -> str:
    """The clock's instant as the text that operators take."""
    return clock.now().astimezone(UTC).strftime("%Y-%m-%d %H:%M:%S.%f")


def currency(code: str) -> str:
    """Three letters, upper-cased. The shape is checked, not a list."""
    if not re.fullmatch("[A-Za-z]{3}", code):
        raise ValueError(f"not a currency code: {code!r}")
    return code.upper()


@dataclass(frozen=True)
class Settings:
    environment: str = "local"
    owner_timezone: str = "Europe/Istanbul"
    base_currency: str = "USD"
    execution_enabled: bool = False

    def __post_init__(self):
        object.__setattr__(self, "base_currency", currency(self.base_currency))
        if self.execution_enabled is not False:
            raise ValueError("execution can't be enabled")


def settings_from(env: dict[str, str], prefix: str = "TEMPORA_") -> Settings:
    given = {k: env[prefix + k.upper()] for k in ("environment", "owner_timezone", "base_currency") if prefix + k.upper() in env}
    if env.get(f"{prefix}EXECUTION_ENABLED", "false").lower() not in ("false", "0", ""):
        raise ValueError("execution can't be enabled")
    return Settings(**given)


@lru_cache(maxsize=1)
def settings() -> Settings:
    return settings_from(dict(os.environ))


def worker(clock: Clock | None = None) -> int:
    print(f"worker ready environment={settings().environment} now={(clock or SystemClock()).now().isoformat()} scheduled_jobs=0")
    return 0
