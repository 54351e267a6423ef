from __future__ import annotations

import contextlib
import csv
import gzip
import json
import sqlite3
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from notegrain import __main__ as cli, config, model, run as runs
from notegrain.extractor import Extractor, python_engine
from notegrain.operators import omop
from notegrain.sinks import sqlite_file, writers
from notegrain.sources import readers, references
from notegrain.streaming import resume

LEXICON = [("chest pain", "C0008031", "Chest Pain", "FINDING"), ("pain", "C0030193", "Pain", "FINDING"), ("diabetes", "C0011849", "Diabetes Mellitus", "DISORDER"), ("metformin", "C0025598", "metformin", "DRUG")]


def lexicon(spark):
    return spark.createDataFrame([(*r, ["T047"]) for r in LEXICON], "term string, cui string, preferred_name string, semantic_group string, semantic_types array<string>")


def docs_of(spark, *texts):
    return spark.createDataFrame([(k, f"d{k}", t, 0) for k, t in enumerate(texts)], "doc_seq long, doc_id string, text string, replaced int")


def test_files_keep_line_ends_and_count_replacements(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"line one\r\nchest pain\r\n")
    (tmp_path / "sub" / "b.TEXT").write_bytes(b"\xef\xbb\xbfHPI")
    (tmp_path / "bad.txt").write_bytes("caf� ".encode() + b"caf\xe9 and \xff\xfe ok \xe2\x82")
    (tmp_path / "out.jsonl").write_text("{}")
    docs, errors = readers.read_documents(spark, [str(tmp_path)])
    got = {r.doc_id.rsplit("/", 1)[-1]: (r.text, r.replaced) for r in docs.collect()}
    raw = (tmp_path / "bad.txt").read_bytes()
    assert got["a.txt"] == ("line one\r\nchest pain\r\n", 0) and got["a.txt"][0].index("chest") == 10
    assert got["b.TEXT"] == ("HPI", 0) and got["bad.txt"] == (raw.decode(errors="replace"), 4) and len(got) == 3
    assert errors.count() == 0 and [r.path.rsplit("/", 1)[-1] for r in readers.skipped_in_folders(spark, [str(tmp_path)]).collect()] == ["out.jsonl"]


def test_json_lines_keys_and_errors(spark, tmp_path):
    lines = [b'\xef\xbb\xbf{"id": "a", "text": "ok"}', b'{"id": "b", "text": "SECRET', b'{"id": "c"}', b'["no", "object"]', b'{"id": "e", "text": "caf\xe9"}', b"  ", b'{"id": 0, "text": "z"}', b'{"id": "", "doc_id": "x", "text": "y"}', b'{"text": "w"}', b'{"id": 1, "text": 5}']
    path = tmp_path / "in.jsonl"
    path.write_bytes(b"\n".join(lines) + b"\n")
    with gzip.open(tmp_path / "in.JSONL.gz", "wb") as f:
        f.write(b'{"text": "packed"}\n')
    docs, errors = readers.read_lines(spark, str(path))
    assert sorted((r.doc_id, r.text, r.replaced) for r in docs.collect()) == [("0", "z", 0), ("a", "ok", 0), ("e", "caf�", 1), ("in.jsonl:9", "w", 0), ("x", "y", 0)]
    assert sorted((r.doc_key.rsplit(":", 1)[1], r.error_type) for r in errors.collect()) == [("10", "TypeError"), ("2", "JSONDecodeError"), ("3", "KeyError"), ("4", "TypeError")]
    with pytest.raises(ValueError, match="JSONDecodeError|KeyError|TypeError") as e:
        readers.read_documents(spark, [str(path)], strict=True)
    assert "SECRET" not in str(e.value)
    assert [r.doc_id for r in readers.read_documents(spark, [str(tmp_path / "in.JSONL.gz")])[0].collect()] == ["in.JSONL.gz:1"]


def test_note_ids(spark, tmp_path):
    (tmp_path / "ids.csv").write_text("doc_id,note_id\na,1\na,1\nb,2\n")
    assert {tuple(r) for r in readers.load_note_ids(spark, str(tmp_path / "ids.csv")).collect()} == {("a", 1), ("b", 2)}
    (tmp_path / "bad.csv").write_text("doc_id,note_id\na,1\na,2\n")
    with pytest.raises(ValueError, match="note ids"):
        readers.load_note_ids(spark, str(tmp_path / "bad.csv"))


def test_auto_ids_count_every_document(spark):
    docs = spark.createDataFrame([(0, None), (1, "mine"), (2, None)], "doc_seq long, doc_id string")
    assert [r.doc_id for r in readers.auto_ids(docs).orderBy("doc_seq").collect()] == ["doc-000001", "mine", "doc-000003"]


def test_modes_end_to_end(spark):
    docs = docs_of(spark, "No chest pain. Diabetes on metformin.", "Mother with diabetes.", "", None)
    for mode in config.MODES:
        rows = {r.doc_id: r for r in Extractor(config.Config(mode=mode, overlaps="longest"), lexicon(spark)).results(docs).collect()}
        assert len(rows) == 4 and not rows["d2"].mentions and "text" not in rows["d0"].asDict()
        assert [(m.cui, m.assertions.negated) for m in rows["d0"].mentions] == [("C0008031", True), ("C0011849", False), ("C0025598", False)]
        subject = rows["d1"].mentions[0].assertions.subject
        assert subject == (None if mode == "single:broad" else "family_member")


def test_a_failing_document_is_a_row_without_its_text(spark):
    def make():
        def engine(text, key):
            if "boom" in text:
                raise RuntimeError("quotes " + text)
            return [{"start": 0, "end": 2, "cui": "C1"}]

        return engine

    rows = python_engine(make, "start int, end int, cui string")(docs_of(spark, "ok", "boom SECRET")).orderBy("doc_seq").collect()
    assert [(r.doc_id, r.error_type, r.cui) for r in rows] == [("d0", None, "C1"), ("d1", "RuntimeError", None)]


def test_run_resumes_and_refuses_another_configuration(spark, tmp_path):
    ex = Extractor(config.Config(), lexicon(spark))
    none = spark.createDataFrame([], "doc_key string, stage string, error_type string")
    first = runs.run(spark, ex, docs_of(spark, "chest pain", "none"), none, str(tmp_path / "r"))
    assert first["sessions"][0]["processed"] == 2 and first["sessions"][0]["mentions"] == 2
    again = runs.run(spark, ex, docs_of(spark, "chest pain", "changed", "new pain"), none, str(tmp_path / "r"))["sessions"][1]
    assert (again["processed"], again["skipped"]) == (2, 1)
    with pytest.raises(ValueError, match="another mode"):
        runs.run(spark, Extractor(config.Config(mode="single:broad"), lexicon(spark)), docs_of(spark, "x"), none, str(tmp_path / "r"))
    assert runs.missing_inputs(["a", "b"], ["b"]) == ["a"]


def test_writers(spark, tmp_path):
    docs = docs_of(spark, "Denies chest pain. Takes metformin.", "")
    ex = Extractor(config.Config(overlaps="longest"), lexicon(spark))
    m = ex.mentions(docs)
    writers.write_parquet(m, str(tmp_path / "p.parquet"))
    back = spark.read.parquet(str(tmp_path / "p.parquet"))
    assert back.count() == 2 and back.select("assertions.negated", "assertions.generic").orderBy("negated").collect() == [(False, None), (True, None)]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        writers.write_parquet(m, str(tmp_path / "p.parquet"))
    assert writers.write_one_jsonl(ex.results(docs), str(tmp_path / "r.jsonl")) == 2
    lines = [json.loads(x) for x in (tmp_path / "r.jsonl").read_text().splitlines()]
    assert lines[0]["mentions"][0]["assertions"]["generic"] is None and lines[1]["mentions"] is None
    with pytest.raises(FileExistsError):
        writers.write_one_jsonl(ex.results(docs), str(tmp_path / "r.jsonl"))
    writers.write_sqlite(docs, m, str(tmp_path / "r.db"))
    with sqlite3.connect(tmp_path / "r.db") as db:
        assert db.execute("SELECT count(*), sum(negated), count(generic) FROM annotations").fetchone() == (2, 1, 0) and db.execute("SELECT count(*) FROM documents").fetchone() == (2,)
    assert not list(tmp_path.glob(".partial*")) and writers.format_for("x.JSONL.gz") == "jsonl"
    assert writers.export_texts(docs, str(tmp_path / "texts")) == 2
    page = writers.highlight_page("a<b", [{"start": 0, "end": 1, "cuis": ["C"]}, {"start": 1, "end": 3, "cuis": []}])
    assert '<mark title="C">a</mark>&lt;b' in page


def test_note_nlp_rows(spark, tmp_path):
    docs = docs_of(spark, "Denies chest pain. Takes metformin.", "No pain").withColumn("doc_id", F.concat("doc_seq", F.lit("")))
    code = F.array(F.struct(F.lit("SNOMEDCT_US").alias("system"), F.lit("1").alias("code"), F.lit(True).alias("is_preferred")), F.struct(F.lit("ICD10CM").alias("system"), F.lit("2").alias("code"), F.lit(True).alias("is_preferred")))
    m = Extractor(config.Config(overlaps="longest"), lexicon(spark)).mentions(docs).withColumn("codes", code)
    found = spark.createDataFrame([("SNOMEDCT_US", "1", 111, 0), ("ICD10CM", "2", 222, 77670)], "sab string, code string, source_concept_id int, concept_id int")
    ids = omop.note_id_from_key(docs)
    rows = omop.note_nlp(m, docs, ids, found, started=datetime(2026, 1, 2, tzinfo=UTC))
    got = rows.orderBy("note_nlp_id").collect()
    assert [r.note_nlp_id for r in got] == [1, 2, 3] and [r.term_exists for r in got] == ["N", "Y", "N"] and tuple(rows.columns) == omop.NOTE_NLP
    assert {(r.note_nlp_concept_id, r.note_nlp_source_concept_id) for r in got} == {(77670, 222)}
    assert json.loads(got[0].term_modifiers) == {"cui": "C0008031", "negated": True, "subject": "patient", "uncertain": False, "conditional": None}
    assert all(0 < r.note_nlp_id < 2**63 for r in omop.note_nlp(m, docs, ids, found, started=datetime(2026, 1, 2, tzinfo=UTC), ids="hash63").collect())
    writers.write_note_nlp(rows, str(tmp_path / "nlp"))
    part = next((tmp_path / "nlp").glob("*.csv"))
    assert next(csv.reader(part.open()))[0] == "note_nlp_id"


def test_note_nlp_rows_of_codes_given_once(spark):
    """Each concept's codes given once, instead of carried by its mentions, choose the same concepts; numbering deals no row out again."""
    docs = docs_of(spark, "Denies chest pain. Takes metformin.", "No pain").withColumn("doc_id", F.concat("doc_seq", F.lit("")))
    code = F.array(F.struct(F.lit("SNOMEDCT_US").alias("system"), F.col("cui").alias("code"), F.lit(True).alias("is_preferred")))
    m = Extractor(config.Config(overlaps="longest"), lexicon(spark)).mentions(docs)
    codes = m.select("cui").distinct().withColumn("codes", code)
    found = m.select(F.lit("SNOMEDCT_US").alias("sab"), F.col("cui").alias("code"), F.expr("cast(substring(cui, 2) as int)").alias("source_concept_id"), F.lit(7).alias("concept_id")).distinct()
    of = lambda mentions, **more: omop.note_nlp(mentions, docs, omop.note_id_from_key(docs), found, started=datetime(2026, 1, 2, tzinfo=UTC), **more)
    given = of(m, codes=codes)
    assert sorted(given.collect()) == sorted(of(m.withColumn("codes", code)).collect()) and given.count() == 3
    assert "SortMergeJoin [__part" not in given._jdf.queryExecution().executedPlan().toString()


def test_references(spark, tmp_path):
    (tmp_path / "own.jsonl").write_text(json.dumps({"doc_id": "a", "text": "x pain", "source": "human", "mentions": [{"start": 2, "end": 6, "cui": "C1", "group": "FINDING", "assertions": {"negated": True}}]}) + "\n")
    docs, m = references.load(spark, str(tmp_path / "own.jsonl"), "own")
    row = m.first()
    assert (row.cui, row.negated, row.uncertain, row.is_human, docs.count()) == ("C1", True, None, True, 1)
    (tmp_path / "silver.jsonl").write_text(json.dumps({"source_file": "a", "text": "x", "mentions": [{"begin": 0, "end": 1, "negated": False, "concepts": [{"cui": "C1", "tui": "T2"}, {"cui": "C1", "tui": "T1"}, {"cui": "C2", "tui": "T1"}]}]}) + "\n")
    assert [(r.cui, r.semantic_types, r.ord) for r in references.load(spark, str(tmp_path / "silver.jsonl"), "silver")[1].orderBy("ord").collect()] == [("C1", ["T1", "T2"], 0), ("C2", ["T1"], 1)]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "n1.json").write_text(json.dumps([{"start": 0, "length": 1, "evlist": [{"conceptinfo": {"cui": "C1", "semantictypes": ["x"]}}, {"conceptinfo": {"cui": "C1", "semantictypes": ["y"]}}]}]))
    (tmp_path / "f" / "n1.txt").write_text("abc")
    assert [(r.doc_id, r.cui, r.end, r.semantic_types) for r in references.load(spark, str(tmp_path / "f"), "matcher", str(tmp_path / "f"))[1].collect()] == [("n1", "C1", 1, ["x"])]
    with pytest.raises(ValueError, match="unknown reference format"):
        references.load(spark, "x", "other")


def test_stream_takes_only_what_is_new(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    ex = Extractor(config.Config(), lexicon(spark))
    for n, name in enumerate(("a.txt", "b.txt"), 1):
        (tmp_path / "in" / name).write_text("chest pain")
        resume.process_new(resume.text_stream(spark, source), ex.results, out, mark).awaitTermination()
        assert spark.read.parquet(out).count() == n


def test_configuration_layers(tmp_path):
    file = tmp_path / "c.toml"
    file.write_text('mode = "single:broad"\nlexicon = "lex.parquet"\nsemantic_groups = ["DRUG"]\n')
    c = config.load({"overlaps": "longest", "negation": None}, file=file, environ={"NOTEGRAIN_MODE": "ensemble:union", "NOTEGRAIN_INCLUDE_TEXT": "yes", "NOTEGRAIN_PROFILE": ""})
    assert (c.mode, c.overlaps, c.include_text, c.lexicon, c.semantic_groups) == ("ensemble:union", "longest", True, str(tmp_path / "lex.parquet"), ("DRUG",))
    assert config.load({"profile": "high_precision"}, environ={}).mode == "ensemble:consensus"
    for bad in ({"mode": "x"}, {"profile": "x"}, {"unknown": 1}, {"code_systems": "X"}, {"ancestor_depth": 1}, {"include_text": "maybe"}, {"ancestor_depth": "1.5"}):
        with pytest.raises(ValueError):
            config.load(bad, environ={})
    with pytest.raises(ValueError, match="none of its presets"):
        config.Config(profile="high_precision")


def test_configuration_files_and_errors(tmp_path, monkeypatch):
    import pickle

    (tmp_path / "notegrain.toml").write_text('[notegrain]\nprofile = "high_precision"\nterminology = "store"\n')
    monkeypatch.chdir(tmp_path)
    c = config.load(environ={"NOTEGRAIN_OVERLAPS": "keep"})
    assert (c.mode, c.overlaps, c.terminology) == ("ensemble:consensus", "keep", str(tmp_path / "store"))
    assert pickle.loads(pickle.dumps(c)) == c and hash(c) == hash(config.load(environ={"NOTEGRAIN_OVERLAPS": "keep"}))
    with pytest.raises(ValueError, match="ancestor_depth.*mode.*odd: no such setting"):
        config.load({"mode": "x", "odd": 1, "ancestor_depth": -1}, environ={})
    with pytest.raises(AttributeError):
        c.mode = "x"


def test_command_line(spark, tmp_path, capsys):
    lexicon(spark).write.parquet(str(tmp_path / "lex"))
    (tmp_path / "n.txt").write_text("No chest pain.")
    assert cli.main(["extract", str(tmp_path / "n.txt"), "--lexicon", str(tmp_path / "lex"), "--out", str(tmp_path / "o.jsonl"), "--overlaps", "longest"]) == 0
    assert json.loads((tmp_path / "o.jsonl").read_text())["mentions"][0]["cui"] == "C0008031"
    assert cli.main(["extract", str(tmp_path / "n.txt")]) == 2 and "lexicon" in capsys.readouterr().err
    assert cli.main(["info", "--mode", "single:broad"]) == 0
    (tmp_path / "ref.jsonl").write_text(json.dumps({"doc_id": "a", "text": "No chest pain. Diabetes on metformin.", "source": "human", "mentions": [{"start": 3, "end": 13, "cui": "C0008031", "group": "FINDING", "assertions": {"negated": True}}]}) + "\n")
    assert cli.main(["evaluate", str(tmp_path / "ref.jsonl"), "--lexicon", str(tmp_path / "lex"), "--overlaps", "longest", "--out", str(tmp_path / "report")]) == 0
    rows = {r["measure"]: r for r in json.loads((tmp_path / "report.json").read_text())}
    assert (rows["overlap"]["tp"], rows["overlap"]["fp"], rows["negated"]["f1"]) == (1, 2, 1.0)


def test_ids_equal_pythons(spark):
    import hashlib

    row = spark.createDataFrame([("d|x", 3, 13, "C1")], "doc_id string, start int, end int, cui string").select(model.mention_id("doc_id", "start", "end", "cui"), model.hash63(F.col("doc_id"))).first()
    assert row[0] == hashlib.sha256("d|x\x1f3\x1f13\x1fC1".encode()).hexdigest()[:16]
    assert row[1] == int.from_bytes(hashlib.sha256(b"d|x").digest()[:8], "big") & (2**63 - 1)


def test_numbers_and_lines_hold_on_both_sides_of_a_join(spark, tmp_path):
    """Many small blocks and partitions, no broadcast: a document has one number, wherever it is read."""
    keep = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
        spark.conf.set("spark.sql.files.openCostInBytes", 1000)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        for name in ("b 1.jsonl", "a.jsonl"):
            (tmp_path / name).write_text("".join(json.dumps({"text": f"{name} {k} " + "x" * (k % 50)}) + "\n" for k in range(3000)))
        docs, _ = readers.read_documents(spark, [str(tmp_path / "b 1.jsonl"), str(tmp_path / "a.jsonl")])
        other = docs.groupBy("doc_seq").agg(F.min("text").alias("other"), F.count("*").alias("n"))
        both = docs.repartition(5, "text").join(other, "doc_seq", "full").collect()
        assert len(both) == 6000 and all(r.text == r.other and r.n == 1 for r in both)
        assert all(r.line_no == int(r.text.rsplit(" ", 2)[-2]) + 1 for r in both)
        in_order = [r.text.rsplit(" ", 2)[0] for r in sorted(both, key=lambda r: r.doc_seq)]
        assert in_order == ["b 1.jsonl"] * 3000 + ["a.jsonl"] * 3000
    finally:
        for k, v in keep.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_folder_and_a_named_file(spark, tmp_path):
    folder = tmp_path / "v1.2 notes"
    (folder / "deep").mkdir(parents=True)
    for name, text in (("deep/b.txt", "B"), ("a.TXT", "A"), ("c.md", "C"), ("d.csv", "D")):
        (folder / name).write_text(text)
    (tmp_path / "x.md").write_text("X")
    found = lambda *paths: [r.text for r in readers.read_documents(spark, list(paths))[0].orderBy("doc_seq").collect()]
    assert found(str(folder)) == ["A", "B"]
    assert found(str(tmp_path / "x.md"), str(folder), str(folder / "c.md")) == ["X", "A", "C", "B"]
    assert found(str(folder), str(folder / "a.TXT"), str(tmp_path / "x.md")) == ["A", "B", "X"]
    with pytest.raises(FileNotFoundError):
        readers.read_documents(spark, [str(tmp_path / "none.txt")])


def test_sequential_ids_number_every_row_once(spark):
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 16)
        rows = spark.range(400_000).select(F.expr("id * 7919 % 400009 doc_seq"), F.lit(0).alias("ord"), F.repeat(F.lit("x"), F.expr("int(id % 40)")).alias("pad"))
        out = omop.sequential_ids(rows, ["doc_seq", "ord"])
        assert out.count() == 400_000
        again = out.select(F.col("note_nlp_id").alias("n"), "doc_seq").join(out.select("note_nlp_id", F.col("doc_seq").alias("d")), F.col("n") == F.col("note_nlp_id"))
        row = again.agg(F.count("*"), F.min("n"), F.max("n"), F.count_if(F.col("d") == F.col("doc_seq"))).first()
        assert tuple(row) == (400_000, 1, 400_000, 400_000)
        falls = out.orderBy("note_nlp_id").select("doc_seq").toPandas()["doc_seq"]
        assert falls.is_monotonic_increasing
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", keep)


def test_manifest_in_a_few_lines(tmp_path):
    (tmp_path / "run_manifest.json").write_text(json.dumps({"run_id": "r", "config": {"mode": "single:broad", "overlaps": "keep"}, "sessions": [{"session": 1, "processed": 2, "skipped": 0, "errors": 1, "documents_per_second": 3.5}], "exports": [{"format": "csv", "output": "o"}]}))
    assert runs.manifest_summary(runs.read_manifest(str(tmp_path))) == ["run r", "mode = single:broad", "session 1: 2 processed, 0 skipped, 1 errors, 3.5 documents a second", "export csv: o"]


def _sqlite(path, tables, indexes):
    """The same rows by SQLite itself."""
    with sqlite3.connect(path) as db:
        for name, (columns, rows) in tables.items():
            db.execute(f"CREATE TABLE {name} ({', '.join(columns)})")
            db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(columns))})", rows)
            for c in indexes[name]:
                db.execute(f"CREATE INDEX {name}_{c} ON {name} ({c})")


@pytest.mark.parametrize("n", [0, 1, 2, 700, 1500, 60_000])
def test_sqlite_pages_made_from_cells(spark, tmp_path, n):
    """Trees of no, one and several levels, values of every width, texts beyond a page: whole by SQLite's own check, and the rows that it would write."""
    schema = "a long, b int, c boolean, d double, k string, t string, raw binary"
    wide = [0, 1, 2, -1, 127, -128, 128, -129, 32767, 32768, 8388607, -8388609, 2**31 - 1, 2**31, 2**47 - 1, 2**47, 2**63 - 1, -(2**63)]
    rows = [(wide[i % 18], i, [None, True, False][i % 3], i / 4 if i % 5 else None, f"k{i * 7919 % n}é" * (1 + i % 3) if i % 11 else None, "tü\0" * (30_000 if i % 600 == 3 else i % 7), bytes(i % 4) or None) for i in range(n)]
    if n > 2:
        rows[2] = rows[2][:4] + ("long " * 5000, *rows[2][5:])  # a key that an index page can't hold either
    df = spark.createDataFrame(rows, schema).repartition(3)
    sqlite_file.write({"x": df, "y": df.select("b", "k").where("b % 2 = 0")}, {"x": ["k", "a"], "y": []}, tmp_path / "x.db")
    _sqlite(tmp_path / "y.db", {"x": (["a", "b", "c", "d", "k", "t", "raw"], rows), "y": (["b", "k"], [(r[1], r[4]) for r in rows if r[1] % 2 == 0])}, {"x": ["k", "a"], "y": []})
    with contextlib.closing(sqlite3.connect(tmp_path / "x.db")) as ours, contextlib.closing(sqlite3.connect(tmp_path / "y.db")) as theirs:
        assert ours.execute("PRAGMA integrity_check").fetchall() == [("ok",)]
        for sql in ("SELECT * FROM x ORDER BY b", "SELECT * FROM y ORDER BY b", "SELECT b, typeof(a), typeof(c), typeof(d), typeof(t), typeof(raw) FROM x ORDER BY b", "SELECT k, count(*) FROM x INDEXED BY x_k WHERE k > 'k3' GROUP BY k", "SELECT a, count(*) FROM x WHERE a IN (0, 128, -129) GROUP BY a"):
            assert ours.execute(sql).fetchall() == theirs.execute(sql).fetchall()
        ours.execute("INSERT INTO x (a, k) VALUES (5, 'new')")
        ours.execute("DELETE FROM x WHERE b % 3 = 0")
        assert ours.execute("PRAGMA integrity_check").fetchall() == [("ok",)]


def test_sqlite_leaves_out_the_page_that_is_locked(tmp_path):
    size = sqlite_file.PAGE
    with (tmp_path / "f").open("w+b") as f:
        pages = sqlite_file.Pages(f, size, sqlite_file.LOCKED // size - 1)
        assert pages.coming(3) == [pages.last + 1, pages.last + 3, pages.last + 4]
        assert [pages.add(b"x" * size) for _ in range(2)] == [sqlite_file.LOCKED // size, sqlite_file.LOCKED // size + 2]
        f.seek(sqlite_file.LOCKED)
        assert f.read(size + 1) == bytes(size) + b"x"


def test_sqlite_rows_do_not_pass_through_the_driver_one_by_one(spark, tmp_path, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("rows sent to the driver")

    docs = docs_of(spark, "Denies chest pain. Takes metformin.", "")
    m = Extractor(config.Config(overlaps="longest"), lexicon(spark)).mentions(docs)
    for name in ("toLocalIterator", "collect"):
        monkeypatch.setattr(type(m), name, refuse)
    writers.write_sqlite(docs, m, str(tmp_path / "r.db"))
    with contextlib.closing(sqlite3.connect(tmp_path / "r.db")) as db:
        assert db.execute("SELECT count(*) FROM annotations JOIN documents USING (doc_seq)").fetchone() == (2,)
        assert {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'index'")} == {"documents_doc_id", *(f"annotations_{c}" for c in ("doc_id", "mention_id", "cui", "semantic_group"))}
