"""Caches that end with the work they were made for."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame

_held: ContextVar[list[DataFrame] | None] = ContextVar("held", default=None)


def hold(df: DataFrame) -> DataFrame:
    """``df`` cached; released when the innermost ``scope`` ends, or by the caller where there is none. One that is cached already stays its owner's."""
    if df.storageLevel.useMemory or df.storageLevel.useDisk:
        return df
    df = df.cache()
    if (frames := _held.get()) is not None:
        frames.append(df)
    return df


def hold_in_scope(df: DataFrame) -> DataFrame:
    """``df`` cached where a scope releases it, else as it is: a cache that stays would answer for a file that has changed since."""
    return df if _held.get() is None else hold(df)


@contextmanager
def scope() -> Iterator[None]:
    token = _held.set([])
    try:
        yield
    finally:
        for df in _held.get() or []:
            df.unpersist()
        _held.reset(token)
