"""Vaults that are indexed and then watched: bootstrap, pause, resume, reset, and the state that each is in.

A bootstrap scans a vault's folder in the background, as a group of Spark jobs that can be cancelled, and starts the
vault's stream. What has become of it is in `status`: indexing, ready, or errored with the cause.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql.streaming import StreamingQuery

from quillspark.errors import EngineError
from quillspark.functions.embed import Embedder
from quillspark.plans import engine
from quillspark.plans.catalog import Catalog, Vault
from quillspark.sources.snapshot import Snapshots
from quillspark.sources.vaults import walk
from quillspark.streaming.event_log import EventLog
from quillspark.streaming.live import Live

#: Seconds that a pause gives what still waits.
DRAIN = 1.0


@dataclass
class _Run:
    state: str = "indexing"
    error: str | None = None
    query: StreamingQuery | None = None
    thread: InheritableThread | None = None
    stopped: bool = False


@dataclass
class Lifecycle:
    """work: a folder for the streams' checkpoints. trigger: as writeStream has it."""

    catalog: Catalog
    snapshots: Snapshots
    log: EventLog
    work: str
    now: Callable[[], str]
    embed: Embedder | None = None
    dims: int = 64
    trigger: dict = field(default_factory=lambda: {"processingTime": "500 milliseconds"})
    _runs: dict[str, _Run] = field(default_factory=dict)

    def live(self, v: Vault) -> Live:
        return Live(self.snapshots, self.log, v.id, v.path, f"{self.work.rstrip('/')}/{v.id}", embed=self.embed, dims=self.dims)

    def create(self, path: str, name: str | None = None) -> Vault:
        v = self.catalog.create(path, name)
        self.start(v.id)
        return v

    def start(self, token: str, scan: bool = True) -> None:
        """Bootstraps an active vault in the background. Without a scan its stream finds what is new, with events."""
        v = self.catalog.get(token)
        if v.status != "active":
            raise EngineError("vault_not_active", f"{v.name!r} is {v.status}")
        if (was := self._runs.get(v.id)) and was.state != "errored" and not was.stopped:
            return
        run = self._runs[v.id] = _Run()
        run.thread = InheritableThread(target=self._bootstrap, args=(v, run, scan), daemon=True)
        run.thread.start()

    def _bootstrap(self, v: Vault, run: _Run, scan: bool) -> None:
        context = self.snapshots.spark.sparkContext
        try:
            context.setJobGroup(v.id, f"bootstrap of {v.name}", interruptOnCancel=True)
            if scan:
                engine.ingest(self.snapshots, walk(self.snapshots.spark, v.id, v.path), self.now(), self.embed, self.dims, [v.id])
            if not run.stopped:
                run.query = self.live(v).start(**self.trigger)
                run.state = "ready"
        except Exception as e:  # whatever it is, it belongs into the vault's state
            if not run.stopped:
                run.state, run.error = "errored", f"{type(e).__name__}: {' '.join(str(e).split())[:300]}"
                self.catalog.fail(v.id, run.error)

    def wait(self, token: str, seconds: float | None = None) -> str:
        """Until a bootstrap has ended; the state."""
        run = self._runs[self.catalog.get(token).id]
        run.thread.join(seconds)
        return run.state

    def _stop(self, v: Vault) -> bool:
        run = self._runs.pop(v.id, None)
        if run is None:
            return False
        run.stopped = True
        self.snapshots.spark.sparkContext.cancelJobGroup(v.id)
        run.thread.join()
        if run.query is not None:
            run.query.stop()
        return run.query is not None

    def pause(self, token: str) -> Vault:
        """Stops a vault's stream, after what still waits as far as there's time; the index stays."""
        v = self.catalog.get(token)
        if v.status == "paused":
            return v
        if self._stop(v):
            self.live(v).drain(DRAIN)
        return self.catalog.pause(v.id)

    def resume(self, token: str) -> Vault:
        """Starts a paused or errored vault's stream; it finds what has changed meanwhile."""
        v = self.catalog.resume(token)
        self.start(v.id, scan=v.id not in self.snapshots.vaults("files"))
        return v

    def reset(self, token: str, rebuild: bool = False) -> Vault:
        """Clears an error. With rebuild the chunks go, and the vault isn't looked at until it's scanned again."""
        v = self.catalog.get(token)
        self._stop(v)
        v = self.catalog.reset(v.id)
        if rebuild:
            engine.rebuild(self.snapshots, v.id)
        elif v.status == "active":
            self.start(v.id)
        return v

    def rescan(self, token: str) -> str:
        """Looks at a vault's whole folder, with events; the time at which it was asked for."""
        v, at = self.catalog.get(token), self.now()
        if v.status != "active":
            raise EngineError("vault_not_active", f"{v.name!r} is {v.status}")
        self._stop(v)
        self.start(v.id, scan=False)
        return at

    def terminate(self, token: str) -> Vault:
        v = self.catalog.get(token)
        self._stop(v)
        return engine.terminate(self.catalog, self.snapshots, v.id)

    def close(self) -> None:
        """Stops all; a later start goes on from the checkpoints."""
        for v in self.catalog.list():
            self._stop(v)

    def status(self) -> list[dict]:
        """vault, name, status, last_error and, for vaults that have been started, the bootstrap's state and progress."""
        out, tracker = [], self.snapshots.spark.sparkContext.statusTracker()
        for v in self.catalog.list():
            row = {"vault": v.id, "name": v.name, "status": v.status, "last_error": v.last_error}
            if run := self._runs.get(v.id):
                failed = run.query is not None and run.query.exception()
                if failed and run.state == "ready":
                    run.state, run.error = "errored", " ".join(str(failed).split())[:300]
                    row |= {"status": self.catalog.fail(v.id, run.error).status, "last_error": run.error}
                progress = run.query.lastProgress if run.query is not None else None
                row["bootstrap"] = {"state": run.state, "error": run.error, "jobs": len(tracker.getJobIdsForGroup(v.id)), "batch": progress["batchId"] if progress else None}
            out.append(row)
        return out
