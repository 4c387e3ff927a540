"""Slate checks on the driver: keys, reachability, code version."""

from __future__ import annotations

import hashlib
import os
import subprocess
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.guards import GuardError


@dataclass
class Check:
    name: str
    ok: bool
    detail: str


def check_keys(slate: DataFrame, env: Mapping[str, str] | None = None) -> list[Check]:
    """Whether each backend's key variable is set; a slate has a handful of rows."""
    env = os.environ if env is None else env
    rows = slate.select("name", "api_key_env").orderBy("name").collect()
    return [Check(r["name"], bool(env.get(r["api_key_env"])), "" if env.get(r["api_key_env"]) else f"{r['api_key_env']} is not set") for r in rows]


def with_keys(slate: DataFrame, env: Mapping[str, str] | None = None, keep_going: bool = False) -> tuple[DataFrame, list[str]]:
    """The backends that can run, and the names of the others; without `keep_going` a missing key is refused."""
    missing = [c.name for c in check_keys(slate, env) if not c.ok]
    if missing and not keep_going:
        raise GuardError("no key for: " + ", ".join(missing))
    return slate.where(~slate["name"].isin(*missing)) if missing else slate, missing


def ping(slate: DataFrame, transport: Callable[[dict, str], tuple[int, str]]) -> list[Check]:
    out = []
    for r in slate.orderBy("name").collect():
        try:
            status, body = transport(r.asDict(), "{}")
            out.append(Check(r["name"], status == 200, "" if status == 200 else f"status {status}: {body[:80]}"))
        except Exception as e:
            out.append(Check(r["name"], False, type(e).__name__))
    return out


def render(checks: list[Check]) -> str:
    return "\n".join(f"{'ok  ' if c.ok else 'FAIL'} {c.name}{': ' + c.detail if c.detail else ''}" for c in checks)


def code_version(folder: str, run: Callable[..., str] | None = None) -> str:
    """First 12 digits of the commit; with uncommitted changes, also a digest of them."""

    def git(*args: str) -> str:
        return subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, check=True).stdout

    git = run or git
    head, diff = git("rev-parse", "HEAD").strip()[:12], git("diff", "HEAD")
    return head if not diff.strip() else f"{head}-dirty-{hashlib.sha256(diff.encode()).hexdigest()[:8]}"
