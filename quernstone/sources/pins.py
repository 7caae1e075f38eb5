"""Tables pinned in memory."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

TIERS = {"memory": StorageLevel.MEMORY_ONLY, "spill": StorageLevel.MEMORY_AND_DISK}


@dataclass
class Pin:
    source: str
    columns: list[str]
    tier: str
    frame: DataFrame
    changed: bool = False


class PinnedError(ValueError):
    """An operation that a pinned table doesn't allow."""


class Pins:
    """Named tables held in executors' memory as columns with statistics, so that later scans prune and don't read files."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._pins: dict[str, Pin] = {}

    def pin(self, df: DataFrame, name: str, source: str, columns: list[str] | None = None, tier: str = "spill") -> bool:
        """Reads columns of df into memory now. Pinning a name again with the memory tier adds columns if the row counts match; else, and with the
        spill tier, it replaces the table."""
        if tier not in TIERS:
            raise ValueError(f"tier must be one of {sorted(TIERS)}")
        columns, asked = columns or df.columns, columns or df.columns
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise ValueError(f"no columns {missing}")
        old = self._pins.get(name.lower())
        if old and tier == "memory" and old.source == source:
            columns = [*old.columns, *(c for c in columns if c not in old.columns)]
        frame = df.select(*columns).persist(TIERS[tier])
        rows = frame.count()
        if old:
            if columns != asked and old.frame.count() != rows:
                frame.unpersist()
                columns, frame = asked, df.select(*asked).persist(TIERS[tier])
                frame.count()
            old.frame.unpersist()
        self._pins[name.lower()] = Pin(source, columns, tier, frame)
        return True

    def unpin(self, name: str) -> bool:
        """Releases a table."""
        pin = self._pins.pop(name.lower(), None)
        if pin is None:
            raise PinnedError(f"{name} is not pinned")
        pin.frame.unpersist()
        return True

    def get(self, name: str) -> DataFrame | None:
        pin = self._pins.get(name.lower())
        return pin.frame if pin else None

    def names(self) -> list[str]:
        return list(self._pins)

    def serves(self, name: str, source: str | None, columns: list[str]) -> bool:
        """Whether a scan of these columns of source (None: whatever it was) can be answered from the pin. A pin that has been appended to or deleted
        from can't be left out: then columns that it lacks are an error."""
        pin = self._pins.get(name.lower())
        lacks = sorted(set(columns) - set(pin.columns)) if pin else []
        if pin and lacks and pin.changed:
            raise PinnedError(f"{name} has changed since it was pinned, without {lacks}")
        return bool(pin and source in (None, pin.source) and not lacks)

    def append(self, name: str, rows: DataFrame) -> None:
        """Committed inserts become visible to later queries."""
        pin = self._need(name)
        self._swap(pin, pin.frame.unionByName(rows.select(*pin.columns)))

    def delete(self, name: str, where: str) -> None:
        """Rows for which the condition is true are left out of later queries."""
        pin = self._need(name)
        self._swap(pin, pin.frame.where(f"({where}) is not true"))

    def update(self, name: str, *_: object) -> None:
        """Pinned tables are not updated in place."""
        self._need(name)
        raise PinnedError(f"{name} is pinned: unpin it before updating")

    def merge(self, name: str, *_: object) -> None:
        """Nor merged into."""
        self.update(name)

    def checkpoint(self, name: str) -> None:
        """The table's files were rewritten: the pin no longer holds, and later queries read the files."""
        self._need(name)
        self.unpin(name)

    def release(self) -> None:
        """Releases all tables."""
        for name in self.names():
            self.unpin(name)

    def _need(self, name: str) -> Pin:
        if name.lower() not in self._pins:
            raise PinnedError(f"{name} is not pinned")
        return self._pins[name.lower()]

    def _swap(self, pin: Pin, frame: DataFrame) -> None:
        frame = frame.persist(TIERS[pin.tier])
        frame.count()
        pin.frame, old, pin.changed = frame, pin.frame, True
        old.unpersist()
