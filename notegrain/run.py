"""Run folders: results, errors and a manifest; a run resumes where it stopped."""

from __future__ import annotations

import contextlib
import json
import os
import secrets
import time
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from .extractor import Extractor
from .operators.cohort import run_counters
from .sinks.writers import as_json, write_json

#: Settings that must not change between sessions of one run.
IDENTITY = ("mode", "profile", "overlaps", "conflict_policy", "semantic_groups", "code_systems", "ancestor_depth", "include_ingredients", "mention_filter", "negation")


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def new_run_id() -> str:
    return f"{datetime.now(UTC):%Y%m%dT%H%M%SZ}-{secrets.token_hex(3)}"


@contextlib.contextmanager
def lock(folder: Path):
    """One session at a time in a run folder on the driver's disk."""
    import fcntl

    with (folder / ".lock").open("w") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            raise RuntimeError(f"another session runs in {folder}") from None
        yield


def done(spark: SparkSession, folder: Path) -> DataFrame:
    """(doc_id, content_sha256) of all finished documents."""
    results = folder / "results"
    if not results.exists():
        return spark.range(0).selectExpr("cast(null as string) doc_id", "cast(null as string) content_sha256")
    return spark.read.schema("doc_id string, content_sha256 string").option("recursiveFileLookup", "true").json(str(results))


def remaining(docs: DataFrame, finished: DataFrame) -> DataFrame:
    """Documents whose key and text weren't both finished."""
    keyed = docs.withColumn("content_sha256", F.sha2("text", 256))
    return keyed.join(finished.distinct(), ["doc_id", "content_sha256"], "left_anti").drop("content_sha256")


def run(spark: SparkSession, extractor: Extractor, docs: DataFrame, errors: DataFrame, folder: str, inputs: list[str] | None = None, progress: Callable[[str, dict], None] | None = None) -> dict:
    """Process what remains, append results and errors of this session, and write the manifest. inputs: what the run was given; a resumed run must name all of them. progress: called with
    a step's name and its counts when it has ended; the manifest is written after each step too, so a session cut short leaves what it knew."""
    told = progress or (lambda step, counts: None)
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    manifest_path = out / "run_manifest.json"
    with lock(out):
        config = extractor.config.to_dict()
        manifest = json.loads(manifest_path.read_text()) if manifest_path.exists() else {"run_id": new_run_id(), "config": config, "sessions": []}
        if changed := [k for k in IDENTITY if manifest["config"].get(k) != config.get(k)]:
            raise ValueError(f"this run was begun with another {', '.join(changed)}")
        began, started, session = time.monotonic(), now(), len(manifest["sessions"]) + 1
        todo = remaining(docs, done(spark, out))
        # a session's folder appears when its job commits, so a killed session leaves nothing half written
        as_json(extractor.results(todo).drop("doc_seq")).write.mode("error").text(str(out / "results" / f"session={session}"))
        if inputs is not None:
            earlier = manifest.get("inputs", [])
            if lost := missing_inputs(earlier, inputs):
                raise ValueError(f"earlier inputs that this session doesn't name: {', '.join(lost)}")
            manifest["inputs"] = list(inputs)
        as_known = manifest | {"open_session": {"session": session, "started": started, "extracted_at": now()}}
        write_json(as_known, manifest_path)
        told("extracted", as_known["open_session"])
        errors.withColumn("session", F.lit(session)).write.mode("append").json(str(out / "errors"))
        kept = spark.read.schema("doc_id string, mentions array<struct<start:int>>").json(str(out / "results" / f"session={session}"))
        counted = run_counters(docs, kept.select(F.explode("mentions")), errors).first().asDict()
        written = kept.count()
        types = {r["error_type"]: r["n"] for r in errors.groupBy("error_type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "error_type").limit(20).collect()}  # the commonest, as the manifest shows them
        seconds = time.monotonic() - began
        manifest["sessions"].append({"session": session, "started": started, "ended": now(), "processed": written, "skipped": counted["documents"] - written, "seconds": round(seconds, 2), "documents_per_second": round(written / max(seconds, 1e-9), 2), "error_types": types, **counted})
        told("counted", manifest["sessions"][-1])
        manifest["config"] = config
        write_json(manifest, manifest_path)
    return manifest


def read_manifest(path: str) -> dict:
    """The manifest at a path, or of the run folder there."""
    place = Path(path)
    return json.loads((place / "run_manifest.json" if place.is_dir() else place).read_text(encoding="utf-8"))


def manifest_summary(manifest: dict) -> list[str]:
    """A manifest in a few lines: the run, its settings that aren't defaults, its sessions and exports."""
    from .config import DEFAULTS

    plain = {k: list(v) if isinstance(v, tuple) else v for k, v in DEFAULTS.items()}
    changed = {k: v for k, v in manifest.get("config", {}).items() if v != plain.get(k)}
    sessions = [f"session {s['session']}: {s['processed']} processed, {s['skipped']} skipped, {s['errors']} errors, {s['documents_per_second']} documents a second" for s in manifest.get("sessions", [])]
    return [f"run {manifest.get('run_id')}", *(f"{k} = {v}" for k, v in changed.items()), *sessions, *(f"export {e['format']}: {e['output']}" for e in manifest.get("exports", []))]


def outstanding_errors(errors: DataFrame, results: DataFrame) -> DataFrame:
    """Errors of documents that no later session finished."""
    return errors.join(results.select(F.col("doc_id").alias("doc_key")).distinct(), "doc_key", "left_anti")


def recorded_inputs(now: DataFrame, folder: str) -> DataFrame:
    """(path, length, modificationTime, sha256) of the inputs (path, length, modificationTime), kept with the run.

    Only inputs that are new or changed since an earlier session are read and hashed.
    """
    spark, place = now.sparkSession, str(Path(folder) / "inputs")
    if Path(place).exists():
        before = spark.read.parquet(place).dropDuplicates(["path", "length", "modificationTime"])
        fresh = now.join(before, ["path", "length", "modificationTime"], "left_anti")
    else:
        fresh = now
    paths = [r["path"] for r in fresh.select("path").collect()]  # as many as the files of one session
    if paths:
        from .sources.readers import input_files

        input_files(spark, paths).write.mode("append").parquet(place)
    return spark.read.parquet(place).dropDuplicates(["path", "length", "modificationTime"]) if Path(place).exists() else fresh.withColumn("sha256", F.lit(None).cast("string"))


def missing_inputs(before: list[str], current: list[str]) -> list[str]:
    """Earlier inputs that a resumed run no longer names."""
    return sorted(set(before) - set(current))


def resolve(path: str) -> Path:
    """The results of a run folder, or the path itself."""
    p = Path(path)
    return p / "results" if (p / "run_manifest.json").exists() else p


def kind_of(spark: SparkSession, path: str) -> str:
    """What is at a path: a "run" folder, a "results" file of JSON lines (its first record has mentions and a key), or "notes"."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.sc().hadoopConfiguration())
    if not files.exists(target):
        raise FileNotFoundError(f"nothing at {path}")
    if files.getFileStatus(target).isDirectory():
        return "run" if files.exists(spark._jvm.org.apache.hadoop.fs.Path(target, "run_manifest.json")) else "notes"
    if not path.lower().endswith((".jsonl", ".jsonl.gz")):
        return "notes"
    first = spark.read.text(path).where("trim(value) <> ''").first()
    try:
        record = json.loads(first["value"]) if first else None
    except json.JSONDecodeError:
        return "notes"
    return "results" if isinstance(record, dict) and {"mentions", "doc_id"} <= record.keys() else "notes"


def peak_rss_mb() -> float:
    import resource

    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / (1 if os.uname().sysname == "Darwin" else 1024)
