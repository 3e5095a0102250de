"""Catalogs: which tables there are, and where."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..errors import CatalogError, UnknownTable
from ..plans.types import Kind
from . import csv_folder, frames

#: The modes of entries, with the settings that each must have (DataFrames can't be written to a file).
REQUIRED = {"file": ("dir",), "blob": ("account", "container"), "parquet": ("path",), "dataframe": ("frame",)}

#: Environment variable with the key of a storage account.
KEY_VARIABLE = "PIPELARK_KEY_{}"


@dataclass(frozen=True)
class Entry:
    """Where a table is.

    ``file``: a folder of CSV files with a schema file.  ``blob``: the same in a
    container of an Azure storage account.  ``parquet``: what ``spark.read.parquet``
    reads.  ``dataframe``: rows of the caller.  The last two name the column that
    time windows are about, and columns of opaque text.  CSV files without line ends
    in quotes may be registered as not ``multiline``, and are then read in pieces;
    without ``check`` the first records of files aren't looked at beforehand.
    """

    table: str
    mode: str
    dir: str | None = None
    account: str | None = None
    container: str | None = None
    path: str | None = None
    frame: DataFrame | None = None
    time_column: str | None = "timestamp"
    dynamic: tuple[str, ...] = ()
    multiline: bool = True
    check: bool = True

    def __post_init__(self):
        if not self.table:
            raise CatalogError("an entry must name its table")
        if self.mode not in REQUIRED:
            raise CatalogError(f"table {self.table!r}: unknown mode {self.mode!r}; expected one of {', '.join(REQUIRED)}")
        for setting in REQUIRED[self.mode]:
            if getattr(self, setting) is None or getattr(self, setting) == "":
                raise CatalogError(f"table {self.table!r}: mode {self.mode!r} needs {setting!r}")

    @property
    def location(self) -> str:
        return {"file": self.dir, "blob": f"{self.account}/{self.container}", "parquet": self.path, "dataframe": "(memory)"}[self.mode]

    def written(self) -> dict:
        """The entry as it stands in a catalog file: settings that say something."""
        unsaid = {"time_column": "timestamp", "dynamic": (), "multiline": True, "check": True}
        return {k: v for k, v in asdict(self).items() if k != "frame" and v is not None and unsaid.get(k, object()) != v}

    def folder(self) -> str:
        """The folder of CSV files, as a path that Hadoop knows."""
        if self.mode == "blob":
            return f"abfss://{self.container}@{self.account}.dfs.core.windows.net"
        return self.dir.rstrip("/")

    def load(self, spark: SparkSession, start: datetime | None, end: datetime | None, ordered: bool = False) -> tuple[DataFrame, list[tuple[str, Kind]]]:
        """Rows of a time window in columns called 0, 1, ..., and the names and types of these.

        With ``ordered`` there are further columns that tell the order of the rows.
        """
        if self.mode in ("file", "blob"):
            if self.mode == "blob":
                self.unlock(spark)
            return csv_folder.load(spark, self.folder(), self.table, start, end, self.multiline, self.check, ordered)
        frame = self.frame if self.mode == "dataframe" else spark.read.parquet(self.path)
        places = frames.places(frame, self.mode == "parquet") if ordered else []
        return frames.load(frame, self.table, self.time_column, frozenset(self.dynamic), start, end, places)

    def unlock(self, spark: SparkSession) -> None:
        """Give Spark the account's key, which is never in a catalog."""
        variable = KEY_VARIABLE.format(self.account.upper())
        key = os.environ.get(variable)
        if not key:
            raise CatalogError(f"table {self.table!r}: set {variable} to the key of storage account {self.account!r}")
        spark._jsc.hadoopConfiguration().set(f"fs.azure.account.key.{self.account}.dfs.core.windows.net", key)


class Catalog(Mapping[str, Entry]):
    """Entries by table name."""

    def __init__(self, entries: Iterable[Entry] = ()):
        self._entries: dict[str, Entry] = {}
        for entry in entries:
            self.add(entry)

    def __getitem__(self, table: str) -> Entry:
        try:
            return self._entries[table]
        except KeyError:
            raise UnknownTable(f"table {table!r} is not in the catalog") from None

    def __iter__(self):
        return iter(self._entries)

    def __len__(self) -> int:
        return len(self._entries)

    def __contains__(self, table: object) -> bool:
        return table in self._entries

    def add(self, entry: Entry) -> None:
        if entry.table in self._entries:
            raise CatalogError(f"table {entry.table!r} already exists")
        self._entries[entry.table] = entry

    def remove(self, table: str) -> None:
        if table not in self._entries:
            raise CatalogError(f"table {table!r} not found")
        del self._entries[table]

    def merge(self, other: "Catalog") -> None:
        """Add all entries of another catalog, or none if a name is taken."""
        taken = sorted(set(self) & set(other))
        if taken:
            raise CatalogError(f"already in the catalog: {', '.join(taken)}")
        for entry in other.values():
            self.add(entry)

    def text(self) -> str:
        return json.dumps([e.written() for e in self.values() if e.mode != "dataframe"], indent=2) + "\n"

    @classmethod
    def parse(cls, text: str) -> "Catalog":
        try:
            found = json.loads(text)
            entries = [Entry(**{**e, "dynamic": tuple(e.get("dynamic", ()))}) for e in found]
        except (ValueError, TypeError) as fault:
            raise CatalogError(f"not a catalog file: {fault}") from fault
        return cls(entries)

    @classmethod
    def read(cls, path: Path) -> "Catalog":
        """A catalog file; one that doesn't exist is empty."""
        return cls.parse(path.read_text()) if path.exists() else cls()

    def write(self, path: Path) -> None:
        """Replace a catalog file in one step; only its owner can read it."""
        path.parent.mkdir(parents=True, exist_ok=True)
        handle, draft = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
        try:
            with os.fdopen(handle, "w") as f:
                f.write(self.text())
            os.chmod(draft, 0o600)
            os.replace(draft, path)
        except BaseException:
            os.unlink(draft)
            raise


def parquet_tables(folder: str, tables: Mapping[str, str | None], dynamic: Mapping[str, tuple[str, ...]] | None = None) -> Catalog:
    """A catalog of ``<folder>/<table>.parquet``; ``tables`` gives the time column of each, or None."""
    return Catalog(Entry(t, "parquet", path=f"{folder}/{t}.parquet", time_column=c, dynamic=(dynamic or {}).get(t, ())) for t, c in tables.items())
