"""A table as a log of changes: what a trigger writes follows what it changed, not the size of the table.

Every trigger writes one folder, under its number, and overwrites it when it is repeated. From time to time all is merged into
a base. A folder counts once its success marker is there, which is written last; a reader takes the newest complete base
and the complete changes after it, so it sees the table before or after a trigger or a merge, never half of one. The base
before the newest one stays, with the changes since, for readers that have begun and for a trigger that is repeated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from folioworks.session import children, remove

BASE, CHANGES = "base", "changes"


@dataclass(frozen=True)
class ChangeLog:
    """A log under `path` with rows of `schema` (DDL, without `trigger`)."""

    spark: SparkSession
    path: str
    schema: str

    def numbers(self, part: str, before: int | None = None) -> list[int]:
        """Triggers with a complete folder, in order, those before `before` only."""
        found = (int(name.split("=")[1]) for name in children(self.spark, f"{self.path}/{part}") if name.startswith("trigger="))
        return sorted(n for n in found if (before is None or n < before)
                      and "_SUCCESS" in children(self.spark, f"{self.path}/{part}/trigger={n}"))

    def read(self, before: int | None = None) -> DataFrame:
        """All rows of the newest base and of the changes since, with their `trigger`; `before`: as that trigger found them."""
        bases = self.numbers(BASE, before)[-1:]
        changes = [n for n in self.numbers(CHANGES, before) if not bases or n > bases[0]]
        rows = self.spark.createDataFrame([], f"{self.schema}, trigger bigint")
        for part, chosen in ((BASE, bases), (CHANGES, changes)):
            if chosen:
                reader = self.spark.read.schema(f"{self.schema}, trigger bigint").option("basePath", f"{self.path}/{part}")
                rows = rows.unionByName(reader.parquet(*[f"{self.path}/{part}/trigger={n}" for n in chosen]))
        return rows

    def append(self, rows: DataFrame, trigger: int) -> None:
        """What a trigger changed."""
        rows.write.mode("overwrite").parquet(f"{self.path}/{CHANGES}/trigger={trigger}")

    def rebase(self, rows: DataFrame, trigger: int) -> None:
        """A new base with all there is up to a trigger; what lies before the base it replaces goes."""
        previous = self.numbers(BASE, trigger)[-1:]
        rows.write.mode("overwrite").parquet(f"{self.path}/{BASE}/trigger={trigger}")
        for part in (BASE, CHANGES):
            for n in self.numbers(part, previous[0] + (part == CHANGES) if previous else 0):
                remove(self.spark, f"{self.path}/{part}/trigger={n}")
