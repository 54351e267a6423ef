"""Command line: extract, export, summarize, matrix, search, review, agreement, build-terminology, build-omop-vocab, evaluate, gold, serve, mcp, inspect-manifest, info."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import UTC, datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

import notegrain

from . import reports, run as runs, server
from .config import DEFAULTS, PREFIX, Config, load
from .extractor import Extractor
from .operators import cohort, evaluate, gold, omop
from .operators.spans import group_filter
from .operators.terminology import CODE_SYSTEMS, TerminologyStore, build
from .sinks import writers
from .sources import readers, references


def session() -> SparkSession:
    return SparkSession.builder.appName("notegrain").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="notegrain", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--config")
    for name in DEFAULTS:
        if name != "extra":
            shared.add_argument(f"--{name.replace('_', '-')}", dest=name)
    c = sub.add_parser("extract", parents=[shared])
    c.add_argument("inputs", nargs="+")
    c.add_argument("--out-dir")
    c.add_argument("--out")
    c.add_argument("--limit", type=int)
    c = sub.add_parser("export", parents=[shared])
    c.add_argument("inputs", nargs="+")
    c.add_argument("--out", required=True)
    c.add_argument("--omop-vocab")
    ids = c.add_mutually_exclusive_group()
    ids.add_argument("--note-ids")
    ids.add_argument("--note-id-from-doc-id", action="store_true")
    c.add_argument("--id-scheme", default="sequential", choices=("sequential", "hash63"))
    c = sub.add_parser("build-terminology")
    for a in ("mrconso", "mrrank", "out"):
        c.add_argument(a)
    c.add_argument("--mrrel")
    c.add_argument("--sources", default=",".join(CODE_SYSTEMS))
    c.add_argument("--include-suppressed", action="store_true")
    c.add_argument("--hierarchy-max-depth", type=int)
    c.add_argument("--release")
    c = sub.add_parser("build-omop-vocab")
    c.add_argument("folder")
    c.add_argument("out")
    c = sub.add_parser("evaluate", parents=[shared])
    c.add_argument("reference")
    c.add_argument("--format", default="own")
    c.add_argument("--corpus")
    c.add_argument("--modes")
    c.add_argument("--scope", default="clinical", choices=("clinical", "all"))
    c.add_argument("--out")
    c = sub.add_parser("gold")
    c.add_argument("action", choices=("convert", "validate"))
    c.add_argument("path")
    c.add_argument("--notes")
    c.add_argument("--out")
    for name, what in (("summarize", "each note's concepts"), ("matrix", "a column for each concept"), ("search", "notes by status of target concepts"), ("review", "a blind review of labels")):
        c = sub.add_parser(name, parents=[shared], help=what)
        c.add_argument("inputs", nargs="+")
        c.add_argument("--out", required=True)
        c.add_argument("--groups")
        if name == "summarize":
            c.add_argument("--json", action="store_true")
        if name == "matrix":
            c.add_argument("--min-docs", type=int, default=1)
        if name == "search":
            c.add_argument("--term", action="append", default=[])
            c.add_argument("--cui", action="append", default=[])
        if name == "review":
            c.add_argument("--modes")
            c.add_argument("--per-cell", type=int, default=50)
            c.add_argument("--seed", type=int, default=0)
    c = sub.add_parser("agreement")
    c.add_argument("a")
    c.add_argument("b")
    c.add_argument("--out", required=True)
    c.add_argument("--disagreements")
    c = sub.add_parser("serve", parents=[shared])
    c.add_argument("--host", default="127.0.0.1")
    c.add_argument("--port", type=int, default=8000)
    sub.add_parser("mcp", parents=[shared])
    c = sub.add_parser("inspect-manifest")
    c.add_argument("path")
    sub.add_parser("info", parents=[shared])
    return p


def _config(args: argparse.Namespace) -> Config:
    return load({k: getattr(args, k) for k in DEFAULTS if k != "extra"}, file=args.config)


def extractor(spark: SparkSession, config: Config) -> Extractor:
    if not config.lexicon:
        raise ValueError("a lexicon table is needed: --lexicon")
    store = TerminologyStore.open(spark, config.terminology) if config.terminology else None
    return Extractor(config, spark.read.parquet(config.lexicon), store=store)


def run_evaluation(reference: tuple, modes: list[str], config: Config, make, groups: list[str] | None) -> list[dict]:
    """Exact, overlap and concept scores of every mode, and its attributes', against one reference."""
    docs, wanted = reference
    out = []
    for mode in modes:
        c = Config(**config.to_dict() | {"mode": mode, "profile": "strict", "code_systems": (), "ancestor_depth": 0, "include_ingredients": False})
        found = references.scope(make(c).mentions(docs), groups)
        pairs = evaluate.overlap_pairs(wanted, found)
        for name, counts in (("exact", evaluate.score_exact(wanted, found)), ("overlap", evaluate.score_overlap(wanted, found, pairs)), ("concepts", evaluate.score_concepts(wanted, found))):
            out.append({"mode": mode, "measure": name} | evaluate.with_scores(counts).first().asDict())
        for row in evaluate.with_scores(evaluate.score_attributes(wanted, found, pairs)).orderBy("attribute").collect():
            r = row.asDict()
            out.append({"mode": mode, "measure": r.pop("attribute")} | {k: r[k] for k in ("tp", "fp", "fn", "precision", "recall", "f1")})
    return out


def _report(spark: SparkSession, args: argparse.Namespace, config: Config, docs: DataFrame, errors: DataFrame) -> int:
    groups = [g.strip() for g in args.groups.split(",")] if args.groups else None
    if args.command == "review":
        modes = (args.modes or config.mode).split(",")
        found = [extractor(spark, Config(**config.to_dict() | {"mode": m, "profile": "strict"})).mentions(docs).select("doc_seq", "doc_id", "start", "end", "cui", "semantic_group", "negated", "subject", "history_of", "uncertain", F.lit(m).alias("mode")) for m in modes]
        labelled = reduce(DataFrame.unionByName, found)
        sheet, key, totals = reports.blind_review(docs, group_filter(labelled, groups or list(gold.GROUPS)), per_cell=args.per_cell, seed=args.seed)
        Path(args.out).mkdir(parents=True)
        writers.write_csv(sheet, f"{args.out}/worksheet.csv", ["item"])
        writers.write_csv(key, f"{args.out}/key.csv", ["item", "mode"])
        cells = [r.asDict() for r in totals.orderBy("mode", "attribute", "engine_positive").collect()]
        writers.write_json({"notes": docs.count(), "per_cell": args.per_cell, "seed": args.seed, "totals": cells}, f"{args.out}/strata.json")
        return 0
    mentions = extractor(spark, config).mentions(docs)
    mentions = group_filter(mentions, groups) if groups else mentions
    if args.command == "summarize":
        if args.json:
            writers.write_one_jsonl(reports.summary_records(docs, mentions), args.out)
        else:
            writers.write_lines(reports.summary_lines(docs, mentions), args.out, ["doc_seq", "line_no"])
    elif args.command == "matrix":
        writers.write_csv(cohort.matrix(docs, mentions, args.min_docs), args.out, ["row_key"])
        writers.write_csv(reports.concept_dictionary(mentions, args.min_docs), str(Path(args.out).with_suffix(".concepts.csv")), ["cui"])
    else:
        lexicon = spark.read.parquet(config.lexicon)
        wanted = lexicon.where(F.col("term").isin(*(t.strip().lower() for t in args.term)) | F.col("cui").isin(*(c.strip().upper() for c in args.cui))).select("cui", "preferred_name").distinct()
        classified = cohort.classify(docs, mentions, wanted, errors.select(F.col("doc_key").alias("doc_id")))
        counts = {r["status"]: r["documents"] for r in cohort.cohort_counts(classified).collect()}
        lines = [f"{s}: {counts.get(s, 0)}" for s in ("affirmed", "excluded", "absent", "error")]
        query = " ".join([*(f"term:{t}" for t in args.term), *(f"cui:{c}" for c in args.cui)])
        reports.Searches(spark, args.out).save(classified, wanted, query=query, sources=args.inputs, mode=config.mode, console=lines, errors=errors.select(F.col("doc_key").alias("doc_id"), "error_type"))
        print("\n".join(lines))
    return int(not errors.isEmpty())


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        return _run(args)
    except (ValueError, FileExistsError, FileNotFoundError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


def _run(args: argparse.Namespace) -> int:
    if args.command == "inspect-manifest":
        print("\n".join(runs.manifest_summary(runs.read_manifest(args.path))))
        return 0
    if args.command == "info":
        print(json.dumps(_config(args).to_dict(), indent=2))
        return 0
    spark = session()
    if args.command == "build-terminology":
        store = build(spark, args.mrconso, args.mrrank, args.out, mrrel=args.mrrel, sources=tuple(args.sources.split(",")), include_suppressed=args.include_suppressed, max_depth=args.hierarchy_max_depth, release=args.release)
        print(json.dumps(store.build_info, default=str))
        return 0
    if args.command == "build-omop-vocab":
        print(omop.build(spark, args.folder, args.out).count())
        return 0
    if args.command == "gold":
        if args.action == "validate":
            docs = spark.read.schema(references._OWN).json(args.path).withColumn("doc_seq", F.monotonically_increasing_id())
            records = docs.withColumn("mentions", F.transform("mentions", lambda m: F.struct(*(m[c].alias(c) for c in ("start", "end", "text", "cui", "group", "tuis")), *(m["assertions"][c].alias(c) for c in ("negated", "subject", "history_of", "uncertain", "conditional", "generic")))))
            problems = gold.validate(records).collect()
        else:
            records, bad = gold.convert(readers.read_worksheet(spark, args.path), readers.read_files(spark, [args.notes]).select(F.regexp_extract("doc_id", r"([^/]+?)\.[^./]+$", 1).alias("doc_id"), "text"))
            problems = bad.collect()
            if not problems:
                writers.write_one_jsonl(records.withColumn("doc_seq", F.monotonically_increasing_id()), args.out)
        for p in problems:
            print(p.asDict(), file=sys.stderr)
        return int(any(p.asDict().get("severity", "error") == "error" for p in problems))
    if args.command == "agreement":
        (docs, a), (_, b) = references.own(spark, args.a), references.own(spark, args.b)
        by_key = docs.select("doc_id", "doc_seq")  # the second file's documents are the first's, by key
        b = b.drop("doc_seq").join(by_key, "doc_id")
        names = (Path(args.a).stem, Path(args.b).stem)
        with writers.appearing(args.out) as part:
            part.write_text(reports.agreement_report(docs, a, b, names), encoding="utf-8")
        if args.disagreements:
            writers.write_csv(reports.disagreements(docs, a, b, names), args.disagreements, ["doc_id", "start", "end"])
        return 0
    config = _config(args)
    if args.command == "evaluate":
        rows = run_evaluation(references.load(spark, args.reference, args.format, args.corpus), (args.modes or config.mode).split(","), config, lambda c: extractor(spark, c), list(gold.GROUPS) if args.scope == "clinical" else None)
        text = writers.report_markdown("Evaluation", rows)
        if args.out:
            writers.write_json(rows, Path(args.out).with_suffix(".json"))
            Path(args.out).with_suffix(".md").write_text(text)
        print(text)
        return 0
    if args.command in ("serve", "mcp"):
        store = TerminologyStore.open(spark, config.terminology) if config.terminology else None
        what = server.Service(spark, extractor(spark, config), spark.read.parquet(config.lexicon), store)
        if args.command == "mcp":
            server.stdio_server(what, sys.stdin, sys.stdout)
        else:
            server.http_server(what, args.host, args.port, os.environ.get(f"{PREFIX}TOKEN") or None).serve_forever()
        return 0
    docs, errors = readers.read_documents(spark, args.inputs)
    if args.command in ("summarize", "matrix", "search", "review"):
        return _report(spark, args, config, docs, errors)
    ex = extractor(spark, config)
    if args.command == "extract":
        docs = readers.limited(docs, args.limit) if args.limit else docs
        if args.out_dir:
            manifest = runs.run(spark, ex, docs, errors, args.out_dir, inputs=args.inputs)
            print(json.dumps(manifest["sessions"][-1], default=str))
        else:
            writers.write_one_jsonl(ex.results(docs), args.out) if args.out else [print(r["value"]) for r in writers.as_json(ex.results(docs)).toLocalIterator()]
        return int(not errors.isEmpty())
    kind = writers.format_for(args.out)
    mentions = ex.mentions(docs)
    counted = docs.agg(F.count("*").alias("n")).first()["n"]
    summary = {"version": notegrain.__version__, "exported_at": runs.now(), "format": kind, "inputs": args.inputs, "output": args.out, "documents": counted}
    if kind in writers.WRITERS:
        writers.WRITERS[kind](docs, mentions, args.out)
    elif kind == "jsonl":
        writers.write_one_jsonl(ex.results(docs), args.out)
    else:
        ids = readers.load_note_ids(spark, args.note_ids) if args.note_ids else omop.note_id_from_key(docs)
        rows = omop.note_nlp(mentions, docs, ids, spark.read.parquet(args.omop_vocab), started=datetime.now(UTC), ids=args.id_scheme)
        writers.write_note_nlp(rows, args.out)
        missing = omop.missing_note_ids(docs, ids).count()
        done = spark.read.option("header", True).csv(args.out)
        totals = done.agg(F.count("*").alias("rows"), F.count_if(F.col("note_nlp_concept_id") != "0").alias("with_concept")).first()
        writers.write_sidecar(args.out, summary | {"rows": totals["rows"], "rows_with_concept_id": totals["with_concept"], "missing_note_id": missing, "note_nlp_id": args.id_scheme})
        return int(missing > 0)
    writers.write_sidecar(args.out, summary)
    return 0


if __name__ == "__main__":
    sys.exit(main())
