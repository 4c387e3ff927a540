"""Journal records: builders and key maps."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ACTIVE_REASONS
from .guards import GuardError, consistent_ruling

# Letters that stand for actions, and so for no reason.
ACTION_KEYS = "arsunq"
KEYS = "123456789" + "".join(c for c in "abcdefghijklmnopqrstuvwxyz" if c not in ACTION_KEYS)


def _record(session: Column, action: str, pair_id: Column | None = None, ground_truth: Column | None = None, reason: Column | None = None, notes: Column | None = None, auto: Column | None = None, elapsed_ms: Column | None = None) -> Column:
    text = F.lit(None).cast("string")
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fields = {"ts": stamp, "session": session, "pair_id": pair_id, "action": F.lit(action), "ground_truth": ground_truth, "reason": reason, "notes": notes}
    out = [(text if c is None else c).alias(n) for n, c in fields.items()]
    return F.struct(*out, (F.lit(False) if auto is None else auto).alias("auto"), (F.lit(None).cast("long") if elapsed_ms is None else elapsed_ms).alias("elapsed_ms"))


def rule(session: Column, pair_id: Column, ground_truth: Column, reason: Column, **more: Column) -> Column:
    """A ruling; one whose reason does not fit its verdict is an error when it is evaluated."""
    fits = F.assert_true(consistent_ruling(ground_truth, reason), F.lit("a ruling's reason must fit its verdict"))
    return _record(session, "rule", pair_id, F.when(fits.isNull(), ground_truth), reason, **more)


def skip(session: Column, pair_id: Column) -> Column:
    return _record(session, "skip", pair_id)


def undo(session: Column) -> Column:
    return _record(session, "undo")


def note(session: Column, pair_id: Column, notes: Column) -> Column:
    return _record(session, "note", pair_id, notes=notes)


def allocate_keys(names: Iterable[str], keys: str = KEYS) -> dict[str, str]:
    """One key for each name, by position."""
    names = list(names)
    if len(names) > len(keys):
        raise GuardError(f"{len(names)} names for {len(keys)} keys")
    return dict(zip(keys, names))


def reason_keys(reject_only: bool = False) -> dict[str, str]:
    return allocate_keys([r for r in ACTIVE_REASONS if not (reject_only and r == "ok")])
