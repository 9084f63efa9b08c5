"""Records of row domains, matrix columns, their statistics and fitted models, in a folder."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.store import read_text

KINDS = ("domain", "column", "stats", "model")
FIRST_ID = 101


class Conflict(RuntimeError):
    """Another writer changed the table meanwhile, again and again."""


class Catalog:
    """Small tables of JSON records by kind and id, read anew by every call.

    A change writes the kind's next version as a whole file that must not be there yet, and the
    greatest version counts: of two writers one fails, reads what the other wrote and tries again,
    and a reader never meets half a table. Old versions stay until vacuum().
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.path_of = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path_of(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self, kind: str) -> list[int]:
        if kind not in KINDS:
            raise KeyError(kind)
        place = self.path_of(f"{self.path}/{kind}")
        if not self.fs.exists(place):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(place)]
        return sorted(int(n[1:]) for n in names if n.startswith("v"))

    def _table(self, kind: str) -> tuple[int, dict[int, dict]]:
        versions = self._versions(kind)
        if not versions:
            return 0, {}
        text = read_text(self.spark, f"{self.path}/{kind}/v{versions[-1]:08d}")
        return versions[-1], {int(k): v for k, v in json.loads(text).items()}

    def _put(self, place: str, text: str) -> bool:
        """Whether the file is there now with this text: False if it was there before.

        It is written under another name, which then becomes its own in one step that fails where the
        name is taken: a link on local disks, a renaming elsewhere.
        """
        folder, _, name = place.rpartition("/")
        draft, final = self.path_of(f"{folder}/.{uuid.uuid4().hex}"), self.path_of(place)
        out = self.fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self.fs.getScheme() != "file":
                return not self.fs.exists(final) and self.fs.rename(draft, final)
            try:
                os.link(draft.toUri().getPath(), final.toUri().getPath())
                return True
            except FileExistsError:
                return False
        finally:
            self.fs.delete(draft, False)

    def _change(self, kind: str, fn: Callable[[dict[int, dict]], int | None], tries: int = 50) -> int | None:
        for _ in range(tries):
            version, table = self._table(kind)
            out = fn(table)
            if self._put(f"{self.path}/{kind}/v{version + 1:08d}", json.dumps(table)):
                return out
        raise Conflict(kind)

    def vacuum(self, kind: str, keep: int = 2) -> None:
        """Delete all but the newest versions."""
        for v in self._versions(kind)[:-keep]:
            self.fs.delete(self.path_of(f"{self.path}/{kind}/v{v:08d}"), False)

    def create(self, kind: str, **record) -> int:
        def add(table: dict[int, dict]) -> int:
            new = max(table, default=FIRST_ID - 1) + 1
            table[new] = record
            return new

        return self._change(kind, add)

    def get(self, kind: str, id_: int) -> dict:
        return _record(self._table(kind)[1], kind, id_)

    def set(self, kind: str, id_: int, **record) -> None:
        self._change(kind, lambda table: table.__setitem__(id_, _record(table, kind, id_) | record))

    def remove(self, kind: str, id_: int) -> None:
        self._change(kind, lambda table: (_record(table, kind, id_), table.pop(id_), None)[2])

    def list(self, kind: str) -> list[tuple[int, dict]]:
        return sorted(self._table(kind)[1].items())

    def as_table(self, kind: str) -> DataFrame:
        return self.spark.createDataFrame([(i, json.dumps(r, sort_keys=True)) for i, r in self.list(kind)], "id bigint, record string")


def _record(table: dict[int, dict], kind: str, id_: int) -> dict:
    if id_ not in table:
        raise KeyError(f"no {kind} {id_}")
    return dict(table[id_])


class Views:
    """Lazy derived matrices by name, registered as temporary views once."""

    def __init__(self):
        self.held: dict[str, object] = {}

    def get(self, name: str, make):
        if name not in self.held:
            self.held[name] = made = make()
            made.df.createOrReplaceTempView(name)
        return self.held[name]
