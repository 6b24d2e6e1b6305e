"""What an activity may ask while it runs: who it is, and the details that its last attempt left."""

from __future__ import annotations

import contextvars
import threading
from collections.abc import Callable
from dataclasses import dataclass, field


class NonRetryable(Exception):
    """An error after which no further attempt is made."""


class TimedOut(Exception):
    """The activity took longer than its start-to-close time."""


class NoDetails(LookupError):
    """No attempt has recorded details, or no activity runs."""


@dataclass(frozen=True)
class Info:
    instance_id: str = ""
    name: str = ""
    attempt: int = 0
    task_id: int = 0
    idempotency_key: str = ""


@dataclass
class _Env:
    info: Info
    details: object = None
    recorded: list = field(default_factory=list)


_env: contextvars.ContextVar[_Env | None] = contextvars.ContextVar("activity", default=None)


def info() -> Info:
    """Of the running activity; empty outside one."""
    return env.info if (env := _env.get()) else Info()


def record_heartbeat(details=None) -> None:
    """Details for the next attempt, if this one fails. They reach the store with the attempt's outcome; None keeps what was recorded before."""
    if (env := _env.get()) is None:
        raise RuntimeError("no activity is running")
    if details is not None:
        env.recorded.append(details)


def heartbeat_details():
    """What the last attempt recorded."""
    env = _env.get()
    if env is None or env.details is None:
        raise NoDetails("no details")
    return env.details


def invoke(fn: Callable, value, about: Info, details=None, timeout_s: float = 0) -> tuple[object, Exception | None, object]:
    """(result, error, details recorded last). After the timeout the call is given up; its thread ends by itself."""
    env, out = _Env(about, details), []

    def call() -> None:
        _env.set(env)
        try:
            out.append((fn(value), None))
        except Exception as ex:  # whatever user code raises is the task's outcome
            out.append((None, ex))

    thread = threading.Thread(target=contextvars.copy_context().run, args=(call,), daemon=True)
    thread.start()
    thread.join(timeout_s if timeout_s > 0 else None)
    result, error = out[0] if out else (None, TimedOut(f"{about.name} took longer than {timeout_s} s"))
    return result, error, env.recorded[-1] if env.recorded else None
