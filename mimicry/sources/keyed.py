"""A table that only grows by rows with new keys, looked up by key at bounded cost.

Each batch writes a run of its own; neighbouring runs of a size are merged into one of the
next size before the next batch starts. With ``fan`` runs to a merge, n batches leave at most
about ``fan * log(n)`` runs, and a row is rewritten once per size. A merged run is partitioned
by a hash of the key, into more parts the more rows it has. Parts of few rows share a folder, in
which rows are sorted by part, so that folders follow from the rows and not from how small the
parts are: a look-up lists the folders and parts its keys fall into and reads the key columns of
these only.

A run exists once it was written whole. Runs name the batches they hold, so a run that lies
inside a larger one no longer counts, a batch that is replayed replaces its own run, and a
merge that broke off is done again. What a merge replaced is removed one batch later.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mimicry.sources.files import exists, remove, subfolders
from mimicry.sources.sinks import absent_batch

FAN = 4
PART_ROWS = 200_000
MOST_PARTS = 1 << 12
# A folder holds as many parts as it takes to have so many rows.
FOLDER_ROWS = 100_000
PART, FOLDER = "key_part", "key_folder"


@dataclass(frozen=True)
class Run:
    first: int
    last: int
    parts: int

    @property
    def name(self) -> str:
        return f"run-{self.first}-{self.last}-{self.parts}"

    def holds(self, other: Run) -> bool:
        return self.first <= other.first and other.last <= self.last and self != other


class KeyedStore:
    """Rows of ``schema`` below ``folder``; without ``keys`` a log that is only merged."""

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        schema: str,
        keys: Sequence[str] = (),
        fan: int = FAN,
        part_rows: int = PART_ROWS,
    ) -> None:
        self.spark, self.folder, self.schema, self.keys = spark, folder, schema, tuple(keys)
        self.fan, self.part_rows = fan, part_rows

    def _path(self, run: Run) -> str:
        return f"{self.folder}/{run.name}"

    def _place(self, parts: int = MOST_PARTS) -> Column:
        """A key's part; counts of parts are powers of two, so one follows from another."""
        return F.pmod(F.xxhash64(*self.keys), F.lit(parts)).cast("int")

    def _written(self) -> list[Run]:
        named = [n for n in subfolders(self.spark, self.folder) if n.startswith("run-")]
        runs = [Run(*map(int, n.removeprefix("run-").split("-"))) for n in named]
        return [r for r in runs if exists(self.spark, f"{self._path(r)}/_SUCCESS")]

    def runs(self, before: int | None = None) -> list[Run]:
        """The runs that count, in the order of their batches."""
        whole = [r for r in self._written() if before is None or r.last < before]
        return sorted((r for r in whole if not any(o.holds(r) for o in whole)), key=lambda r: r.first)

    def _read(self, run: Run) -> DataFrame:
        schema = f"{self.schema}, {PART} int, {FOLDER} string" if run.parts else self.schema
        return self.spark.read.schema(schema).parquet(self._path(run))

    def _all(self, runs: Sequence[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs, self.spark.createDataFrame([], self.schema).limit(0))

    def rows(self, before: int | None = None, only: int | None = None) -> DataFrame:
        """All rows, those of earlier batches, or of one batch that was just added."""
        runs = [Run(only, only, 0)] if only is not None else self.runs(before)
        return self._all([self._read(r).drop(PART, FOLDER) for r in runs])

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Write the run of a batch; adding it again replaces it."""
        rows.write.mode("overwrite").parquet(self._path(Run(batch_id, batch_id, 0)))

    def stored_keys(self, wanted: DataFrame, before: int | None = None) -> DataFrame:
        """Keys stored in the parts that the keys of ``wanted`` fall into."""
        places = sorted(r[0] for r in wanted.select(self._place()).distinct().collect())
        found = []
        for run in self.runs(before):
            rows = self._read(run)
            if run.parts:
                rows = rows.where(self._within(run, places))
            found.append(rows.select(*self.keys))
        empty = self.spark.createDataFrame([], self.schema).select(*self.keys).limit(0)
        return reduce(DataFrame.union, found, empty)

    def _within(self, run: Run, places: Sequence[int]) -> Column:
        """Rows in the folders and parts that the places fall into; all, if these are all there are."""
        parts = sorted({p % run.parts for p in places})
        if len(parts) == run.parts:
            return F.lit(True)
        inside = F.expr(f"{PART} IN ({','.join(map(str, parts))})") if parts else F.lit(False)
        prefix = f"{FOLDER}="
        names = [n.removeprefix(prefix) for n in subfolders(self.spark, self._path(run)) if n.startswith(prefix)]
        if not names:  # a folder to each part, as earlier versions wrote them
            return inside
        folders = int(names[0].partition("-")[0])
        listed = ",".join(f"'{folders}-{f}'" for f in sorted({p % folders for p in parts}))
        return inside & F.expr(f"{FOLDER} IN ({listed})") if parts else inside

    def absent(self, rows: DataFrame, before: int | None = None) -> DataFrame:
        """Rows (computed already: they are read twice) whose key no earlier batch has."""
        return absent_batch(rows, self.stored_keys(rows, before), self.keys)

    def merge(self, before: int) -> None:
        """Merge what batches earlier than ``before`` left, the newest runs first."""
        self._remove_replaced(before)
        while True:
            runs = self.runs(before)
            group = runs[-self.fan :]
            size = self._size(group[-1]) if group else 0
            if len(group) < self.fan or any(self._size(r) != size for r in group):
                return
            rows = self._all([self._read(r).drop(PART, FOLDER) for r in group])
            count = rows.count() if self.keys else 0
            parts = self._parts(count) if self.keys else 0
            merged = Run(group[0].first, group[-1].last, parts)
            if parts:
                folders = self._folders(count, parts)
                number = F.concat(F.lit(f"{folders}-"), self._place(folders))
                rows = rows.withColumn(PART, self._place(parts)).withColumn(FOLDER, number)
                rows = rows.repartition(FOLDER).sortWithinPartitions(FOLDER, PART)
                rows.write.mode("overwrite").partitionBy(FOLDER).parquet(self._path(merged))
            else:
                rows.coalesce(1).write.mode("overwrite").parquet(self._path(merged))

    def _size(self, run: Run) -> int:
        """How often as many batches as a merge takes are in a run: 0, 1, 2..."""
        size, batches = 0, run.last - run.first + 1
        while batches >= self.fan:
            size, batches = size + 1, batches // self.fan
        return size

    def _parts(self, rows: int) -> int:
        parts = 1
        while parts < MOST_PARTS and parts * self.part_rows < rows:
            parts *= 2
        return parts

    def _folders(self, rows: int, parts: int) -> int:
        folders = 1
        while folders < parts and folders * FOLDER_ROWS < rows:
            folders *= 2
        return folders

    def _remove_replaced(self, before: int) -> None:
        whole = [r for r in self._written() if r.last < before]
        for run in whole:
            if any(o.holds(run) for o in whole):
                remove(self.spark, self._path(run))
