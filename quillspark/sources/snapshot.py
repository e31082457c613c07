"""Immutable snapshots of the engine's tables, and a pointer that moves to a new one in a single rename.

A table lies in <root>/<table>/vault=<id>/v=<version>. CURRENT says which version of each vault belongs to the snapshot,
so a commit writes the vaults that it touches and no others, and readers see all of it or none.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from quillspark.errors import EngineError

VERSION = 3


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> int | None:
        return (self._pointer() or {}).get("snapshot")

    def _pointer(self) -> dict | None:
        p = self._path(f"{self.root}/CURRENT")
        if not self._fs.exists(p):
            return None
        got = json.loads(self.spark.read.text(f"{self.root}/CURRENT", wholetext=True).first()[0])
        if got["schema_version"] > VERSION:
            raise EngineError("schema_too_new", f"the snapshot has version {got['schema_version']}, this program reads {VERSION}")
        if got["schema_version"] < VERSION:
            raise EngineError("invalid_request", f"the snapshot has version {got['schema_version']}; scan its vaults into a new folder")
        return got

    def vaults(self, name: str) -> list[str]:
        """The vaults that have rows in a table."""
        return sorted(((self._pointer() or {"tables": {}})["tables"].get(name) or {"parts": {}})["parts"])

    def read(self, name: str, vaults: Iterable[str] | None = None) -> DataFrame:
        """A table of the current snapshot, of some vaults or all, with the schema it was written with (ids that look
        like numbers stay text)."""
        now = self._pointer()
        if now is None:
            raise EngineError("invalid_request", "there is no snapshot yet")
        table = now["tables"][name]
        schema = StructType.fromJson(table["schema"])
        chosen = table["parts"] if vaults is None else {v: table["parts"][v] for v in set(vaults) if v in table["parts"]}
        if not chosen:
            return self.spark.createDataFrame([], schema)
        base = f"{self.root}/{name}"
        paths = [f"{base}/vault={self._escaped(k)}/v={v}" for k, v in sorted(chosen.items())]
        whole = StructType(schema.fields).add("v", StringType())
        return self.spark.read.schema(whole).option("basePath", base).parquet(*paths).select(*schema.names)

    def _escaped(self, vault: str) -> str:
        return self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(vault)

    def commit(self, tables: dict[str, DataFrame], vaults: Iterable[str] | None = None, order: dict[str, list[str]] | None = None) -> int:
        """Writes tables (each with a column vault) as a new snapshot, then points to it.

        With vaults, the tables hold only these vaults' rows, and what others had stays as it is; a vault that has no
        rows leaves the table. Without, the tables are replaced altogether. order: by which columns a table's rows are
        sorted within a vault, so that a reader that filters by them skips most row groups.
        """
        was = self._pointer() or {"snapshot": 0, "tables": {}}
        n = was["snapshot"] + 1  # another writer that comes first has this number, and this commit fails
        version = f"{n}-{uuid.uuid4().hex[:12]}"  # files that a failed commit left are never taken for this one's
        new = dict(was["tables"])
        touched = None if vaults is None else set(vaults)
        for name, df in tables.items():
            base = f"{self.root}/{name}"
            if by := (order or {}).get(name):
                df = df.repartitionByRange("vault", *by).sortWithinPartitions("vault", *by)
            df.withColumn("v", F.lit(version)).write.mode("append").partitionBy("vault", "v").parquet(base)
            found = self._fs.globStatus(self._path(f"{base}/vault=*/v={version}")) or []
            utils = self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
            parts = {utils.unescapePathName(s.getPath().getParent().getName().removeprefix("vault=")): version for s in found}
            kept = {k: v for k, v in new.get(name, {"parts": {}})["parts"].items() if touched is not None and k not in touched}
            new[name] = {"schema": df.schema.jsonValue(), "parts": kept | parts}
        return self._point(n, new)

    @contextmanager
    def staged(self, df: DataFrame) -> Iterator[DataFrame]:
        """df, written below the root and read again, until the block ends."""
        path = f"{self.root}/.staged-{uuid.uuid4().hex}"
        try:
            df.write.parquet(path)
            yield self.spark.read.schema(df.schema).parquet(path)
        finally:
            self._fs.delete(self._path(path), True)

    def forget(self, vault: str) -> int:
        """A snapshot without a vault, in all tables; its files stay until they are cleaned up."""
        was = self._pointer() or {"snapshot": 0, "tables": {}}
        return self._point(was["snapshot"] + 1, {k: t | {"parts": {p: v for p, v in t["parts"].items() if p != vault}} for k, t in was["tables"].items()})

    def clean(self) -> int:
        """Deletes the versions that the current snapshot doesn't hold, and what lost writers left; call it when no
        reader uses older ones and nobody writes."""
        gone = 0
        for s in self._fs.globStatus(self._path(f"{self.root}/.{{claim,staged,CURRENT}}-*")) or []:
            self._fs.delete(s.getPath(), True)
        for name, table in (self._pointer() or {"tables": {}})["tables"].items():
            held = {f"vault={self._escaped(k)}/v={v}" for k, v in table["parts"].items()}
            for s in self._fs.globStatus(self._path(f"{self.root}/{name}/vault=*/v=*")) or []:
                p = s.getPath()
                if f"{p.getParent().getName()}/{p.getName()}" not in held:
                    gone += bool(self._fs.delete(p, True))
        return gone

    def _point(self, n: int, tables: dict) -> int:
        """Points to snapshot n, if the one before is still the current one: of several writers just one claims n."""
        claim = self._path(f"{self.root}/.claim-{n}")
        try:
            self._fs.create(claim, False).close()
        except Py4JJavaError:
            raise EngineError("conflict", f"another writer makes snapshot {n}; if it was lost, clean() frees it") from None
        try:
            if (self.current() or 0) != n - 1:
                raise EngineError("conflict", f"snapshot {n - 1} is no longer the current one; read it again")
            return self._move(n, tables)
        finally:
            self._fs.delete(claim, False)

    def _move(self, n: int, tables: dict) -> int:
        temp = self._path(f"{self.root}/.CURRENT-{n}-{uuid.uuid4().hex[:12]}")
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps({"schema_version": VERSION, "snapshot": n, "tables": tables}).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(temp, self._path(f"{self.root}/CURRENT"), options)
        return n
