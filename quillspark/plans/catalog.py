"""The vault catalog: rows, lifecycle, and which vaults a query reaches."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quillspark.errors import EngineError
from quillspark.functions.text import closest
from quillspark.sources.snapshot import Snapshots

NAME = re.compile(r"[A-Za-z0-9_-]+")
ROWS = "id string, name string, path string, status string, created_at string, last_error string"


@dataclass(frozen=True)
class Vault:
    id: str
    name: str
    path: str
    status: str = "active"
    created_at: str = ""
    last_error: str | None = None


@dataclass(frozen=True)
class Scope:
    """Names of vaults that a query runs on, and why others don't."""

    run: list[Vault]
    skipped: list[dict]
    failed: list[dict]

    def partial(self) -> dict:
        out = {k: v for k, v in (("skipped", self.skipped), ("failed", self.failed)) if v}
        return {"skipped": self.skipped, "failed": self.failed} if out else {}


class Catalog:
    def __init__(self, vaults: list[Vault] = (), now: Callable[[], str] = lambda: "2026-01-01T00:00:00Z", data_dir: str | None = None):
        self._by_id = {v.id: v for v in vaults}
        self.now, self.data_dir = now, data_dir

    @classmethod
    def load(cls, table: DataFrame, **kw) -> Catalog:
        """The catalog that `rows` wrote out: a row for each vault."""
        return cls([Vault(**r.asDict()) for r in table.select("id", "name", "path", "status", "created_at", "last_error").collect()], **kw)

    def rows(self, spark: SparkSession) -> DataFrame:
        """The catalog as a table, to be written where `load` finds it."""
        return spark.createDataFrame([(v.id, v.name, v.path, v.status, v.created_at, v.last_error) for v in self.list()], ROWS).coalesce(1)

    def subscribe(self, token: str | None = None) -> list[str]:
        """Ids of the vaults whose changes a reader gets: one, which must be active, or all that are active just now."""
        if token is None:
            return [v.id for v in self.list("active")]
        v = self.get(token)
        if v.status != "active":
            raise EngineError("vault_not_active", f"{v.name!r} is {v.status}")
        return [v.id]

    def list(self, status: str | None = None) -> list[Vault]:
        return [v for _, v in sorted(self._by_id.items()) if status in (None, v.status)]

    def get(self, token: str) -> Vault:
        """By name, else by id; an unknown name is answered with the closest one."""
        found = next((v for v in self.list() if v.name == token), self._by_id.get(token))
        if found is None:
            near = closest([v.name for v in self.list()], token)
            raise EngineError("vault_not_found", f"no vault {token!r}" + (f"; did you mean {near!r}?" if near else ""))
        return found

    def _put(self, v: Vault) -> Vault:
        self._by_id[v.id] = v
        return v

    def create(self, path: str, name: str | None = None) -> Vault:
        p = Path(path).expanduser()
        if not p.is_absolute() or not p.is_dir():
            raise EngineError("invalid_path", f"{path!r} isn't an absolute path of a folder")
        p = p.resolve()
        if self.data_dir and Path(self.data_dir).resolve().is_relative_to(p):
            raise EngineError("invalid_path", "the engine's own data lie below that folder")
        name = name or p.name
        if any(v.name == name or v.path == str(p) for v in self.list()):
            raise EngineError("vault_exists", f"a vault with name {name!r} or that folder exists")
        made = uuid.uuid7() if hasattr(uuid, "uuid7") else _uuid7()
        return self._put(Vault(str(made), name, str(p), created_at=self.now()))

    def rename(self, token: str, name: str) -> Vault:
        v = self.get(token)
        if v.name == name:
            return v
        if not NAME.fullmatch(name):
            raise EngineError("invalid_vault_name", f"{name!r} may hold letters, digits, _ and - only")
        if any(x.name == name for x in self.list()):
            raise EngineError("vault_exists", f"there is a vault {name!r}")
        return self._put(replace(v, name=name))

    def pause(self, token: str) -> Vault:
        return self._put(replace(self.get(token), status="paused"))

    def resume(self, token: str) -> Vault:
        v = self.get(token)
        if v.status == "errored" and not Path(v.path).is_dir():
            raise EngineError("invalid_path", f"{v.path!r} isn't there")
        return self._put(replace(v, status="active", last_error=None))

    def reset(self, token: str) -> Vault:
        v = self.get(token)
        return self._put(replace(v, status="active" if v.status == "errored" else v.status, last_error=None))

    def fail(self, token: str, why: str) -> Vault:
        return self._put(replace(self.get(token), status="errored", last_error=why))

    def terminate(self, token: str) -> Vault:
        """Forgets a vault; its notes stay."""
        return self._by_id.pop(self.get(token).id)

    def reconcile(self) -> list[Vault]:
        """At a start: active vaults whose folder is gone turn errored; indexes of others are kept."""
        return [self.fail(v.id, f"{v.path} isn't there") for v in self.list("active") if not Path(v.path).is_dir()]

    def scope(self, tokens: list[str] | None = None) -> Scope:
        """Names first, then ids, each vault once; none given: all. Unknown ones fail, inactive ones are skipped."""
        if tokens is not None and not tokens:
            raise EngineError("invalid_request", "the list of vaults is empty")
        chosen: dict[str, Vault] = {}
        failed = []
        for t in [v.id for v in self.list()] if tokens is None else tokens:
            try:
                v = self.get(t)
                chosen.setdefault(v.id, v)
            except EngineError as e:
                failed.append({"vault": t, "code": e.code, "message": e.message})
        skipped = [{"vault": v.id, "vault_name": v.name, "reason": f"vault is {v.status}"} for v in chosen.values() if v.status != "active"]
        return Scope([v for v in chosen.values() if v.status == "active"], skipped, failed)


class StoredCatalog(Catalog):
    """A catalog that is written at each change, before the change counts; of two writers one wins, and the other gets
    a conflict and loads it again. snapshots: where it's kept, in a folder of its own."""

    def __init__(self, snapshots: Snapshots, **kw):
        self.snapshots = snapshots
        super().__init__(**kw)
        self.reload()

    def reload(self) -> None:
        if self.snapshots.current() is not None:
            rows = self.snapshots.read("vaults").withColumnRenamed("vault", "id")
            self._by_id = {v.id: v for v in Catalog.load(rows).list()}

    def _save(self, vaults: dict[str, Vault]) -> None:
        table = Catalog(list(vaults.values())).rows(self.snapshots.spark).withColumnRenamed("id", "vault")
        self.snapshots.commit({"vaults": table})
        self._by_id = vaults

    def _put(self, v: Vault) -> Vault:
        self._save(self._by_id | {v.id: v})
        return v

    def terminate(self, token: str) -> Vault:
        v = self.get(token)
        self._save({k: x for k, x in self._by_id.items() if k != v.id})
        return v


def _uuid7() -> uuid.UUID:
    import os
    import time

    raw = int(time.time() * 1000).to_bytes(6, "big") + os.urandom(10)
    n = int.from_bytes(raw, "big") & ~(0xF << 76) & ~(0x3 << 62) | 7 << 76 | 2 << 62
    return uuid.UUID(int=n)
