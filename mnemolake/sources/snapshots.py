"""Tables kept as numbered snapshots with a manifest each. A commit writes its data beside the others, then one small manifest,
by a rename, as the last step: a reader sees the one before or the new one, never a mixture and never a gap, and one that holds
a snapshot keeps reading it while others are written. What a lost writer left is named by no manifest and goes with `vacuum`.

A manifest names for each table the folders that make it up, so that a commit may replace a table or add to it. `info` is the
writer's own: streams put there which batch they have done, which makes a batch that runs twice change nothing. One writer at a
time: a second that commits the same number is refused where the store's rename does not overwrite."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .stages import delete, file_system


@dataclass(frozen=True)
class Snapshot:
    number: int = 0
    tables: dict[str, list[str]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)
    info: dict = field(default_factory=dict)

    def read(self, spark: SparkSession, table: str, schema: str | None = None) -> DataFrame:
        """The table as it was in this snapshot; empty, of the given schema, where it was not there."""
        kind = self.schemas.get(table) or schema
        return spark.read.schema(kind).parquet(*self.tables[table]) if self.tables.get(table) else spark.createDataFrame([], kind)


class Snapshots:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs, _ = file_system(spark, self.path)

    def _place(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _numbers(self) -> list[int]:
        folder = self._place("manifests")
        names = [f.getPath().getName() for f in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[0] != ".")

    def at(self, number: int) -> Snapshot:
        place = self._place(f"manifests/{number:010}.json")
        stream = self.fs.open(place)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Snapshot(number, **json.loads(text))

    def latest(self) -> Snapshot:
        numbers = self._numbers()
        return self.at(numbers[-1]) if numbers else Snapshot()

    def commit(self, base: Snapshot, replace: dict[str, DataFrame] | None = None, add: dict[str, DataFrame] | None = None, info: dict | None = None) -> Snapshot:
        """The snapshot after base: tables replaced or added to, the others as in base; info's entries put over base's."""
        number, folder = base.number + 1, f"{self.path}/data/{base.number + 1:010}-{uuid.uuid4().hex}"
        tables, schemas = dict(base.tables), dict(base.schemas)
        for table, df in [*(replace or {}).items(), *(add or {}).items()]:
            df.write.parquet(f"{folder}/{table}")
            kept = tables.get(table, []) if table in (add or {}) else []
            tables[table], schemas[table] = [*kept, f"{folder}/{table}"], ddl(df)
        made = Snapshot(number, tables, schemas, {**base.info, **(info or {})})
        self._publish(made)
        return made

    def _publish(self, made: Snapshot) -> None:
        final, draft = self._place(f"manifests/{made.number:010}.json"), self._place(f"manifests/.{made.number:010}-{uuid.uuid4().hex}")
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps({"tables": made.tables, "schemas": made.schemas, "info": made.info}).encode()))
        out.close()
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            self.fs.delete(draft, False)
            raise RuntimeError(f"snapshot {made.number} is there already: another writer was faster")

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all but the newest `keep` snapshots, and data that none of these names (not while another writes)."""
        numbers = self._numbers()
        named = {f"{f}/".split("/data/", 1)[1].split("/", 1)[0] for n in numbers[-keep:] for fs in self.at(n).tables.values() for f in fs}
        for n in numbers[:-keep]:
            self.fs.delete(self._place(f"manifests/{n:010}.json"), False)
        folder = self._place("data")
        for f in self.fs.listStatus(folder) if self.fs.exists(folder) else []:
            if (name := f.getPath().getName()) not in named:
                delete(self.spark, f"{self.path}/data/{name}")


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def compact(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key of a table that was only added to: the latest."""
    from pyspark.sql import functions as F

    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")
