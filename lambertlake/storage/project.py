"""A project: append-only Parquet tables, one writer, and a log that can't be altered unnoticed.

Every change is one commit: its rows go to ``<table>/commit=<n>``, then a manifest ``<n>.json``
appears by a rename, and only commits with a manifest are read, so a writer that dies leaves no
trace. Edits append rows with a higher version; the current row of an identifier is that of its
highest version. Points of spectra are written once and never again. Each commit carries its log
entries, whose hashes are chained; ``verify`` recomputes them, and the hashes of all points.
"""

from __future__ import annotations

import difflib
import getpass
import hashlib
import json
import socket
from contextlib import contextmanager
from datetime import datetime, timezone
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lambertlake.operators import series
from lambertlake.plans import derived
from lambertlake.plans import pipeline as pl
from lambertlake.sources import reader, writer

GENESIS = "0" * 64
APP_VERSION = "1"
#: What a spectrum may be for.
ROLES = ("", "standard", "calibration", "validation", "mixture", "sample", "blank", "divisor", "reference", "unknown")
UNDOABLE = {("REVISE", "method"), ("REVISE", "result"), ("REVISE", "spectrum"), ("EDIT", "spectrum"), ("ARCHIVE", "spectrum"), ("ARCHIVE", "method"), ("ARCHIVE", "result")}

TABLES = {
    "spectra": "id long, trial_id long, name string, kind string, role string, parent_ids array<long>, pipeline string, npoints int, metadata map<string,string>, concentrations map<string,double>, notes string, source_file string, source_sha256 string, created_utc string, archived boolean, version long",
    "points": "id long, x array<double>, y array<double>, data_sha256 string",
    "compounds": "id long, name string, unit string, mw double, notes string, version long",
    "trials": "id long, name string, description string, status string, metadata map<string,string>, created_utc string, archived boolean, version long",
    "methods": "id long, trial_id long, name string, type string, definition string, created_utc string, archived boolean, version long",
    "results": "id long, trial_id long, method_id long, name string, kind string, data string, created_utc string, archived boolean, version long",
    "meta": "key string, value string, version long",
    "audit": "seq long, ts_utc string, user string, host string, app_version string, action string, entity string, entity_id long, summary string, details string, reason string, prev_hash string, hash string",
}


class ProjectError(ValueError):
    pass


def utc_now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="milliseconds")


def entry_hash(prev: str, e: dict) -> str:
    parts = [prev, e["ts_utc"], e["user"], e["host"], e["app_version"], e["action"], e["entity"], "" if e["entity_id"] is None else str(e["entity_id"]), e["summary"], e["details"], e["reason"]]
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()


def hash_column() -> Column:
    """The same hash of log rows, on the executors."""
    ident = F.coalesce(F.col("entity_id").cast("string"), F.lit(""))
    return F.sha2(F.concat_ws("\x1f", "prev_hash", "ts_utc", "user", "host", "app_version", "action", "entity", ident, "summary", "details", "reason"), 256)


class Files:
    """The few file operations that commits need, on any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        path = self.jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def names(self, name: str) -> list[str]:
        p = self.path(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, content: str) -> None:
        """Write a new file; one that exists is an error."""
        stream = self.fs.create(self.path(name), False)
        try:
            stream.write(bytearray(content.encode()))
        finally:
            stream.close()

    def rename(self, a: str, b: str) -> bool:
        return self.fs.rename(self.path(a), self.path(b))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Commit:
    """What one change adds."""

    def __init__(self, project: Project) -> None:
        self.project = project
        self.rows: dict[str, list[dict]] = {}
        self.frames: dict[str, list[DataFrame]] = {}
        self.entries: list[dict] = []
        self.next = dict(project.state["next"])

    def new_id(self, table: str) -> int:
        self.next[table] = self.next.get(table, 1) + 1
        return self.next[table] - 1

    def put(self, table: str, **row: Any) -> int:
        row.setdefault("id", None)
        if row["id"] is None and table != "meta":
            row["id"] = self.new_id(table)
        row["version"] = self.next["version"]
        self.next["version"] += 1
        self.rows.setdefault(table, []).append(row)
        return row["id"]

    def points(self, ident: int, x, y) -> None:
        digest = hashlib.sha256(np.asarray(x, "<f8").tobytes() + np.asarray(y, "<f8").tobytes()).hexdigest()
        self.rows.setdefault("points", []).append({"id": ident, "x": [float(v) for v in x], "y": [float(v) for v in y], "data_sha256": digest})

    def frame(self, table: str, df: DataFrame) -> None:
        self.frames.setdefault(table, []).append(df)

    def log(self, action: str, entity: str, entity_id: int | None, summary: str, details: dict | None = None, reason: str = "") -> None:
        self.entries.append({"ts_utc": utc_now(), "user": self.project.user, "host": socket.gethostname(), "app_version": APP_VERSION, "action": action, "entity": entity, "entity_id": entity_id, "summary": summary, "details": pl.canonical(details or {}), "reason": reason})


class Project:
    def __init__(self, spark: SparkSession, root: str, user: str | None = None) -> None:
        self.spark, self.files, self.user = spark, Files(spark, root), user or getpass.getuser()
        self.listeners: list = []
        self._load()

    # Opening and committing

    @classmethod
    def create(cls, spark: SparkSession, root: str, name: str, user: str | None = None) -> Project:
        files = Files(spark, root)
        if files.names("_commits"):
            raise ProjectError("the folder holds a project already")
        files.create("_commits/000000000000.json", json.dumps({"format": "lambertlake", "n": 0, "tables": [], "head": GENESIS, "seq": 0, "next": {"version": 1}}))
        project = cls(spark, root, user)
        with project.commit() as c:
            c.put("meta", key="name", value=name)
            c.log("CREATE", "project", None, f"project {name}")
        return project

    @classmethod
    def open(cls, spark: SparkSession, root: str, user: str | None = None) -> Project:
        project = cls(spark, root, user)
        with project.commit() as c:
            c.log("OPEN", "project", None, "project opened")
        return project

    def _load(self) -> None:
        names = [n for n in self.files.names("_commits") if n.endswith(".json")]
        if not names:
            raise ProjectError("no project in this folder")
        self.manifests = [json.loads(self.files.read(f"_commits/{n}")) for n in names]
        if self.manifests[0].get("format") != "lambertlake":
            raise ProjectError("the folder belongs to something else")
        self.state = self.manifests[-1]

    @contextmanager
    def commit(self):
        """Collect a change and write it, all or nothing; a second writer is refused."""
        try:
            self.files.create("_lock", self.user)
        except Exception as error:
            raise ProjectError("another writer is at work") from error
        try:
            self._load()
            c = Commit(self)
            yield c
            self._write(c)
        finally:
            self.files.delete("_lock")
        for listener in self.listeners:
            listener([(e["action"], e["entity"], e["entity_id"]) for e in c.entries])

    def subscribe(self, listener) -> None:
        self.listeners.append(listener)

    def _write(self, c: Commit) -> None:
        n = self.state["n"] + 1
        head, seq = self.state["head"], self.state["seq"]
        for e in c.entries:
            seq += 1
            e |= {"seq": seq, "prev_hash": head}
            head = e["hash"] = entry_hash(head, e)
        if c.entries:
            c.rows["audit"] = c.entries
        tables = sorted({*c.rows, *c.frames})
        for t in tables:
            frames = list(c.frames.get(t, []))
            if t in c.rows:
                fields = [f.split()[0] for f in TABLES[t].split(", ")]
                frames.append(self.spark.createDataFrame([tuple(r.get(f) for f in fields) for r in c.rows[t]], TABLES[t]).coalesce(1))
            self.files.delete(f"{t}/commit={n}")
            for i, df in enumerate(frames):
                df.write.mode("append").parquet(f"{self.files.root}/{t}/commit={n}")
        manifest = {"n": n, "tables": tables, "head": head, "seq": seq, "next": c.next}
        staged = f"_staged/{n:012d}.json"
        self.files.delete(staged)
        self.files.create(staged, json.dumps(manifest))
        if not self.files.fs.exists(self.files.path("_commits")) or not self.files.rename(staged, f"_commits/{n:012d}.json"):
            raise ProjectError("the commit could not be published")
        self.manifests.append(manifest)
        self.state = manifest

    # Reading

    def table(self, name: str) -> DataFrame:
        """All rows of committed versions."""
        paths = [f"{self.files.root}/{name}/commit={m['n']}" for m in self.manifests if name in m["tables"]]
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])

    def current(self, name: str, key: str = "id") -> DataFrame:
        rows = self.table(name)
        best = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), "version").alias("r"))
        return best.select("r.*")

    def records(self, trial_id: int | None = None, include_archived: bool = False, ids: list[int] | None = None) -> DataFrame:
        """Descriptions of spectra, without their points, in order of id."""
        out = self.current("spectra")
        if not include_archived:
            out = out.where(~F.col("archived"))
        if trial_id is not None:
            out = out.where(F.col("trial_id") == trial_id)
        if ids is not None:
            out = out.where(F.col("id").isin(ids))
        return out.orderBy("id")

    def spectra(self, ids: list[int] | None = None) -> DataFrame:
        """Current descriptions with points; a list keeps its order in ``pos``."""
        if ids is None:
            return self.current("spectra").join(self.table("points"), "id")
        wanted = self.spark.createDataFrame([(i, p) for p, i in enumerate(ids)], "id long, pos int")
        out = self.current("spectra").join(F.broadcast(wanted), "id").join(self.table("points").where(F.col("id").isin(ids)), "id")
        found = {r["id"] for r in out.select("id").collect()}
        if missing := [i for i in ids if i not in found]:
            raise KeyError(f"no spectrum {missing[0]}")
        return out

    def row(self, table: str, ident: int) -> dict:
        found = self.table(table).where(F.col("id") == ident).orderBy(F.desc("version")).limit(1).collect()
        if not found:
            raise KeyError(f"no {table} {ident}")
        return found[0].asDict(recursive=True)

    def methods(self, trial_id: int | None = None) -> DataFrame:
        out = self.current("methods").where(~F.col("archived"))
        return (out if trial_id is None else out.where((F.col("trial_id") == trial_id) | F.col("trial_id").isNull())).orderBy("id")

    def results(self, trial_id: int | None = None) -> DataFrame:
        out = self.current("results").where(~F.col("archived"))
        return (out if trial_id is None else out.where(F.col("trial_id") == trial_id)).orderBy("id")

    def meta(self, key: str) -> str | None:
        row = self.table("meta").where(F.col("key") == key).orderBy(F.desc("version")).limit(1).collect()
        return row[0]["value"] if row else None

    def audit(self, entity: str | None = None, entity_id: int | None = None, action: str | None = None, text: str | None = None, limit: int | None = None) -> DataFrame:
        """Log entries, newest first; ``text`` is looked for in summary, details and reason."""
        out = self.table("audit")
        for column, value in (("entity", entity), ("entity_id", entity_id), ("action", action)):
            if value is not None:
                out = out.where(F.col(column) == value)
        if text:
            hit = lambda c: F.lower(c).contains(text.lower())
            out = out.where(hit("summary") | hit("details") | hit("reason"))
        out = out.orderBy(F.desc("seq"))
        return out if limit is None else out.limit(limit)

    # Descriptions

    def set_meta(self, key: str, value: str) -> None:
        with self.commit() as c:
            c.log("EDIT", "project", None, f"{key} set", {"before": self.meta(key), "after": value})
            c.put("meta", key=key, value=value)

    def add_compound(self, name: str, unit: str = "µg/mL", mw: float | None = None, notes: str = "") -> int:
        if self.current("compounds").where(F.col("name") == name).limit(1).count():
            raise ProjectError(f"there is a compound {name} already")
        with self.commit() as c:
            ident = c.put("compounds", name=name, unit=unit, mw=mw, notes=notes)
            c.log("CREATE", "compound", ident, f"compound {name}", {"after": {"name": name, "unit": unit, "mw": mw}})
        return ident

    def add_trial(self, name: str, description: str = "") -> int:
        with self.commit() as c:
            ident = c.put("trials", name=name, description=description, status="open", metadata={}, created_utc=utc_now(), archived=False)
            c.log("CREATE", "trial", ident, f"trial {name}")
        return ident

    def edit(self, table: str, ident: int, changes: dict, reason: str = "") -> bool:
        """Change descriptive fields; nothing is written if nothing changes."""
        before = self.row(table, ident)
        real = {k: v for k, v in changes.items() if before.get(k) != v}
        if not real:
            return False
        entity = {"spectra": "spectrum"}.get(table, table[:-1])
        with self.commit() as c:
            c.put(table, **(before | real))
            c.log("EDIT", entity, ident, f"{entity} {ident} edited", {"before": {k: before.get(k) for k in real}, "after": real}, reason)
        return True

    def set_concentrations(self, values: dict[int, dict[str, float]], reason: str = "") -> list[int]:
        """New concentrations of spectra and of what was processed from them (as first parent). Gives the ids changed."""
        changed = []
        with self.commit() as c:
            for ident, own in values.items():
                down = [ident, *self.descendants([ident], first_only=True)]
                for i in down:
                    before = self.row("spectra", i)
                    if before["concentrations"] == own or (before["archived"] and i != ident):
                        continue
                    c.put("spectra", **(before | {"concentrations": own}))
                    changed.append(i)
                    c.log("EDIT", "spectrum", i, f"concentrations of spectrum {i}", {"before": {"concentrations": before["concentrations"]}, "after": {"concentrations": own}}, reason)
        return changed

    def archive(self, table: str, ids: list[int], archived: bool = True, reason: str = "") -> None:
        entity = {"spectra": "spectrum"}.get(table, table[:-1])
        with self.commit() as c:
            for i in ids:
                c.put(table, **(self.row(table, i) | {"archived": archived}))
                c.log("ARCHIVE" if archived else "RESTORE", entity, i, f"{entity} {i} {'archived' if archived else 'restored'}", {"before": {"archived": not archived}, "after": {"archived": archived}}, reason)

    # Spectra

    def _described(self, **fields: Any) -> dict:
        base = {"trial_id": None, "kind": "raw", "role": "", "parent_ids": [], "pipeline": "[]", "metadata": {}, "concentrations": {}, "notes": "", "source_file": None, "source_sha256": None, "created_utc": utc_now(), "archived": False}
        return base | fields

    def add_spectrum(self, name: str, x, y, **fields: Any) -> int:
        with self.commit() as c:
            ident = c.put("spectra", **self._described(name=name, npoints=len(x), **fields))
            c.points(ident, x, y)
            c.log("IMPORT", "spectrum", ident, f"spectrum {name}")
        return ident

    def import_files(self, path: str, trial_id: int | None = None, role: str = "", layout: str = "auto") -> list[int]:
        """Spectra of all files under a path, in one commit with one entry."""
        rows = reader.read_files(self.spark, path, layout).orderBy("source_file", "name").collect()
        with self.commit() as c:
            ids = []
            for r in rows:
                meta = dict(r["metadata"] or {})
                ident = c.put("spectra", **self._described(name=r["name"], npoints=len(r["x"]), role=meta.pop("role", role), trial_id=trial_id, metadata=meta, source_file=r["source_file"], source_sha256=r["source_sha256"]))
                c.points(ident, r["x"], r["y"])
                ids.append(ident)
            c.log("IMPORT", "file", None, f"{len(ids)} spectra from {path}", {"outputs": ids, "sha256": sorted({r["source_sha256"] for r in rows})})
        return ids

    def import_frame(self, spectra: DataFrame, role: str = "", meta: dict[str, str] | None = None, details: dict | None = None) -> None:
        """Bulk import of any number of rows (name, x, y, metadata, concentrations) without bringing them to the driver.

        ``meta`` is set in the same commit, ``details`` are added to the log entry.
        """
        with self.commit() as c:
            for key, value in (meta or {}).items():
                c.put("meta", key=key, value=value)
            base = c.next.get("spectra", 1)
            rows = spectra.withColumn("id", F.lit(base) + F.monotonically_increasing_id())
            staged = f"{self.files.root}/_staged/bulk"
            self.files.delete("_staged/bulk")
            rows.write.parquet(staged)  # identifiers must not change between the two tables
            rows = self.spark.read.parquet(staged)
            empty = lambda t: F.create_map().cast(t)
            has = lambda n, t: F.col(n) if n in rows.columns else empty(t)
            c.frame("spectra", rows.select("id", F.lit(None).cast("long").alias("trial_id"), "name", F.lit("raw").alias("kind"), F.lit(role).alias("role"), F.array().cast("array<long>").alias("parent_ids"), F.lit("[]").alias("pipeline"), F.size("x").alias("npoints"), has("metadata", "map<string,string>").alias("metadata"), has("concentrations", "map<string,double>").alias("concentrations"), F.lit("").alias("notes"), F.lit(None).cast("string").alias("source_file"), F.lit(None).cast("string").alias("source_sha256"), F.lit(utc_now()).alias("created_utc"), F.lit(False).alias("archived"), F.lit(c.next["version"]).cast("long").alias("version")))
            c.frame("points", writer.data_sha256(rows.select("id", "x", "y")))
            top = rows.agg(F.max("id").alias("m"), F.count("*").alias("n")).first()
            c.next["spectra"], c.next["version"] = (base if top["m"] is None else top["m"] + 1), c.next["version"] + 1
            c.log("IMPORT", "spectrum", None, f"{top['n']} spectra", {"n": top["n"]} | (details or {}))
        self.files.delete("_staged/bulk")

    def process(self, ids: list[int], steps: list[dict], suffix: str = "processed", role: str | None = None) -> list[int]:
        """Derived spectra: first parent the source, further parents the references."""
        refs = pl.referenced(steps)
        library = pl.Library.of(self.table("points"), steps)
        done = {r["id"]: r for r in pl.process(self.spectra(ids).select("id", "x", "y"), steps, library).collect()}
        out = []
        with self.commit() as c:
            for i in ids:
                src, got = self.row("spectra", i), done[i]
                ident = c.put("spectra", **self._described(name=f"{src['name']} {suffix}", kind="derived", role=src["role"] if role is None else role, trial_id=src["trial_id"], parent_ids=[i, *refs], pipeline=pl.canonical(steps), npoints=len(got["x"]), concentrations=src["concentrations"], metadata=src["metadata"]))
                c.points(ident, got["x"], got["y"])
                out.append(ident)
            c.log("PROCESS", "spectrum", None, f"{len(out)} spectra processed", {"inputs": ids, "outputs": out, "references": refs, "pipeline": steps})
        return out

    def edges(self, first_only: bool = False) -> DataFrame:
        """child, parent."""
        rows = self.current("spectra").where(F.size("parent_ids") > 0)
        parent = F.explode(F.slice("parent_ids", 1, 1) if first_only else F.col("parent_ids"))
        return rows.select(F.col("id").alias("child"), parent.alias("parent"))

    def lineage(self, ident: int) -> list[int]:
        """The spectrum and its line of first parents."""
        start = self.spark.createDataFrame([(ident,)], "node long")
        return [r["ancestor"] for r in series.ascend(self.edges(True), start).orderBy("depth").collect()]

    def descendants(self, ids: list[int], first_only: bool = False) -> list[int]:
        start = self.spark.createDataFrame([(i,) for i in ids], "node long")
        rows = series.descend(self.edges(first_only), start).where("depth > 0").groupBy("descendant").agg(F.max("depth").alias("depth")).orderBy("depth", "descendant")
        return [r["descendant"] for r in rows.collect()]

    def replay(self, rtol: float = 1e-9) -> DataFrame:
        """id, reproduced of every current derived spectrum, recomputed from its parents; one job for all pipelines."""
        points = self.table("points")
        rows = self.records(include_archived=True).where("kind = 'derived'").select("id", F.get("parent_ids", F.lit(0)).alias("parent"), "pipeline")
        again = derived.rerun(rows, points.select("id", "x", "y")).select("id", F.col("y").alias("new"), F.col("x").alias("new_x"))
        both = again.join(points, "id", "left")
        size = F.array_max(F.transform("y", F.abs))
        near = F.forall(F.zip_with("y", "new", lambda a, b: F.abs(a - b) <= rtol * F.abs(a) + rtol * size + 1e-15), lambda v: v)
        return both.select("id", F.coalesce((F.size("x") == F.size("new_x")) & near, F.lit(False)).alias("reproduced"))

    def revise_processing(self, ident: int, steps: list[dict], reason: str) -> dict[int, int]:
        """Process again with other steps, rebuild what depends on it, archive the old. Gives {old: new}."""
        self._reason(reason)
        old = self.row("spectra", ident)
        if old["kind"] != "derived" or old["archived"]:
            raise ProjectError("only a current processed spectrum can be revised")
        todo = [ident, *(d for d in self.descendants([ident]) if not self.row("spectra", d)["archived"])]
        mapped: dict[int, int] = {}
        made: dict[int, tuple] = {}
        with self.commit() as c:
            for i in todo:  # parents come before what depends on them
                src = self.row("spectra", i)
                own = steps if i == ident else remap(json.loads(src["pipeline"]), mapped)
                parents = [mapped.get(p, p) for p in src["parent_ids"]]
                fresh = {k: v for k, v in made.items()}
                wanted = [r for r in pl.referenced(own) if r not in fresh]
                library = pl.Library({**{k: v for k, v in fresh.items()}, **(pl.Library.of(self.table("points").where(F.col("id").isin(wanted)), own).spectra if wanted else {})})
                if parents[0] in fresh:
                    x, y = fresh[parents[0]]
                else:
                    row = self.table("points").where(F.col("id") == parents[0]).first()
                    x, y = np.array(row["x"]), np.array(row["y"])
                from lambertlake.plans.ops import Batch, apply_pipeline

                done = apply_pipeline(Batch(x, y[None]), own, library)
                new = c.put("spectra", **(src | {"id": None, "parent_ids": [parents[0], *pl.referenced(own)], "pipeline": pl.canonical(own), "npoints": len(done.x), "metadata": (src["metadata"] or {}) | {"revision_of": str(i)}, "created_utc": utc_now()}))
                c.points(new, done.x, done.y[0])
                c.put("spectra", **(src | {"archived": True}))
                mapped[i], made[new] = new, (done.x, done.y[0])
            c.log("REVISE", "spectrum", ident, f"processing of spectrum {ident} revised", {"mapping": {str(k): v for k, v in mapped.items()}}, reason)
        return mapped

    # Documents

    @staticmethod
    def _reason(reason: str) -> None:
        if not reason.strip():
            raise ProjectError("a reason is needed")

    def save_method(self, name: str, definition: dict, trial_id: int | None = None) -> int:
        with self.commit() as c:
            ident = c.put("methods", trial_id=trial_id, name=name, type=definition.get("type"), definition=pl.canonical(definition), created_utc=utc_now(), archived=False)
            c.log("CREATE", "method", ident, f"method {name}", {"inputs": sorted(references(definition))})
        return ident

    def save_result(self, name: str, kind: str, data: dict, method_id: int | None = None, trial_id: int | None = None) -> int:
        """A result with the concentrations that its spectra carry now."""
        data = dict(data)
        if data.get("ids") and "taken_snapshot" not in data:
            rows = self.records(include_archived=True, ids=data["ids"]).select("id", "concentrations").collect()
            data["taken_snapshot"] = {str(r["id"]): r["concentrations"] for r in rows}
        with self.commit() as c:
            ident = c.put("results", trial_id=trial_id, method_id=method_id, name=name, kind=kind, data=pl.canonical(data), created_utc=utc_now(), archived=False)
            c.log("CREATE", "result", ident, f"result {name}", {"inputs": data.get("ids", []), "method": method_id})
        return ident

    def revise(self, table: str, ident: int, document: dict, reason: str) -> int:
        """A new row that replaces a method or result; the old one is archived."""
        self._reason(reason)
        before = self.row(table, ident)
        if before["archived"]:
            raise ProjectError("only the current version can be revised")
        field = "definition" if table == "methods" else "data"
        entity = table[:-1]
        old = json.loads(before[field])
        document = document | {"revision_of": ident, "revision": old.get("revision", 1) + 1}
        with self.commit() as c:
            new = c.put(table, **(before | {"id": None, field: pl.canonical(document), "created_utc": utc_now()}))
            c.put(table, **(before | {"archived": True}))
            c.log("REVISE", entity, new, f"{entity} {ident} revised as {new}", {"revision_of": ident, "inputs": sorted(references(document))}, reason)
        return new

    def versions(self, table: str, ident: int) -> list[int]:
        """The chain of revisions that a document belongs to, oldest first."""
        field = "definition" if table == "methods" else "data"
        rows = self.current(table).select("id", F.get_json_object(field, "$.revision_of").cast("long").alias("before")).where("before IS NOT NULL")
        edges = rows.select(F.col("id").alias("child"), F.col("before").alias("parent"))
        start = self.spark.createDataFrame([(ident,)], "node long")
        up = [r["ancestor"] for r in series.ascend(edges, start).orderBy("depth").collect()]
        down = [r["descendant"] for r in series.descend(edges, start).where("depth > 0").orderBy("depth").collect()]
        return up[::-1] + down

    def compare(self, table: str, a: int, b: int) -> str:
        field = "definition" if table == "methods" else "data"
        text = [json.dumps(json.loads(self.row(table, i)[field]), indent=1, sort_keys=True, ensure_ascii=False).splitlines() for i in (a, b)]
        return "\n".join(difflib.unified_diff(*text, str(a), str(b), lineterm=""))

    def usage(self, ids: list[int]) -> dict[str, list[int]]:
        """Methods and results that refer to any of some spectra, and results of those methods."""
        wanted = set(ids)
        methods = [r["id"] for r in self.methods().select("id", "definition").toLocalIterator() if wanted & references(json.loads(r["definition"]))]
        results = [r["id"] for r in self.results().select("id", "method_id", "data").toLocalIterator() if r["method_id"] in methods or wanted & references(json.loads(r["data"]))]
        return {"methods": methods, "results": results}

    def history(self, ident: int) -> DataFrame:
        """Entries that concern a spectrum, as subject, input, output or reference."""
        ids = lambda f: F.coalesce(F.from_json(F.get_json_object("details", f"$.{f}"), "array<long>"), F.array().cast("array<long>"))
        named = F.arrays_overlap(F.array(F.lit(ident).cast("long")), F.concat(ids("inputs"), ids("outputs"), ids("references")))
        return self.table("audit").where(((F.col("entity") == "spectrum") & (F.col("entity_id") == ident)) | named).orderBy(F.desc("seq"))

    # Undoing

    def _undoable(self) -> DataFrame:
        """The changes of the whole log that can be undone and haven't been."""
        undone = self.audit(action="UNDO").select(F.get_json_object("details", "$.undoes").cast("long").alias("seq"))
        kinds = self.spark.createDataFrame(sorted(UNDOABLE), "action string, entity string")
        return self.table("audit").join(F.broadcast(kinds), ["action", "entity"]).join(undone, "seq", "left_anti")

    def undoable(self, limit: int = 30) -> list[dict]:
        """The latest changes that can be undone, newest first."""
        return [r.asDict() for r in self._undoable().orderBy(F.desc("seq")).limit(limit).collect()]

    def undo(self, seq: int, reason: str) -> None:
        """Bring back what a change replaced, if nothing later has changed it again."""
        self._reason(reason)
        entry = self._undoable().where(F.col("seq") == seq).first()
        if entry is None:
            raise ProjectError("this change can't be undone")
        details, ident = json.loads(entry["details"]), entry["entity_id"]
        table = "spectra" if entry["entity"] == "spectrum" else f"{entry['entity']}s"
        touched = self.audit(entity=entry["entity"]).where((F.col("seq") > seq) & (F.col("entity_id") == ident)).where(F.col("action") != "UNDO").limit(1).count()
        with self.commit() as c:
            if entry["action"] == "REVISE":
                pairs = {int(k): v for k, v in details["mapping"].items()} if "mapping" in details else {details["revision_of"]: ident}
                if touched or any(self.row(table, new)["archived"] for new in pairs.values()):
                    raise ProjectError("a later change depends on it")
                if table == "spectra" and set(self.descendants(list(pairs.values()))) - set(pairs.values()):
                    raise ProjectError("a later change depends on it")
                for old, new in pairs.items():
                    c.put(table, **(self.row(table, new) | {"archived": True}))
                    c.put(table, **(self.row(table, old) | {"archived": False}))
            else:
                now = self.row(table, ident)
                if any(now.get(k) != v for k, v in details["after"].items()):
                    raise ProjectError("a later change depends on it")
                c.put(table, **(now | details["before"]))
            c.log("UNDO", entry["entity"], ident, f"entry {seq} undone", {"undoes": seq}, reason)

    # Checking

    def verify(self) -> list[str]:
        """All that is wrong with the log and the points; an empty list if nothing is."""
        problems = []
        log = self.table("audit")
        # The chain is followed within ranges of entries; a range's first entry is checked against its predecessor's row.
        linked = log.alias("a").join(log.select((F.col("seq") + 1).alias("after"), F.col("hash").alias("before")).alias("b"), F.col("a.seq") == F.col("b.after"), "left")
        linked = linked.withColumn("expected", F.when(F.col("seq") == 1, GENESIS).otherwise(F.col("before")))
        bad = linked.where(~F.col("prev_hash").eqNullSafe(F.col("expected")) | (F.col("hash") != hash_column())).select("seq").orderBy("seq").collect()
        problems += [f"log entry {r['seq']} was altered or its predecessor is missing" for r in bad]
        top = log.agg(F.max("seq").alias("seq"), F.count("*").alias("n"), F.max_by("hash", "seq").alias("head")).first()
        if (top["seq"] or 0) != self.state["seq"] or top["n"] != self.state["seq"] or (top["head"] or GENESIS) != self.state["head"]:
            problems.append("log entries are missing")
        changed = writer.data_sha256(self.table("points"), "now").where("now <> data_sha256").select("id").orderBy("id").collect()
        problems += [f"points of spectrum {r['id']} were altered" for r in changed]
        return problems

    def export_audit(self, path: str) -> None:
        """The log as CSV, oldest first, which is itself logged."""
        import csv

        with self.commit() as c:
            c.log("EXPORT", "audit", None, "log exported")
        with open(path, "w", encoding="utf-8-sig", newline="") as f:
            out = csv.writer(f)
            rows = self.table("audit").orderBy("seq")
            out.writerow(rows.columns)
            out.writerows(rows.toLocalIterator())


def _walk(value: Any, key: str | None, take) -> Any:
    """Rebuild a document, giving every value that may refer to spectra to ``take``."""
    if isinstance(value, dict):
        if key == "taken_snapshot":
            return {str(take(int(k))): v for k, v in value.items()}
        return {k: _walk(v, k, take) for k, v in value.items()}
    if isinstance(value, list):
        if key in ("ids", "calibration_ids", "excluded_ids", "inputs"):
            return [take(v) for v in value]
        return [_walk(v, None, take) for v in value]
    if key in ("reference", "reference2", "divisor") and isinstance(value, int) and not isinstance(value, bool):
        return take(value)
    return value


def references(document: Any) -> set[int]:
    found: set[int] = set()
    _walk(document, None, lambda i: found.add(i) or i)
    return found


def remap(document: Any, mapping: dict[int, int]) -> Any:
    return _walk(document, None, lambda i: mapping.get(i, i))


