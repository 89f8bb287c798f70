"""Markdown files on disk: reading them, every check over them, golden sets and summaries."""

import difflib
import json
import os

import pytest
from pyspark.sql import functions as F

from quillspark.operators import backfill, evaluation, health, summaries
from quillspark.sources import notes as sources


def put(root, files):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(text) if isinstance(text, bytes) else (root / path).write_text(text)


def front(body="", **fields):
    return "---\n" + "".join(f"{k}: {v}\n" for k, v in fields.items()) + f"---\n{body}"


def note(name, body, **more):
    return front(body, id=name, created="2024-01-01T00:00:00Z", updated=more.pop("updated", "2024-01-01T00:00:00Z"), **more)


VAULT = {
    "A.md": note("a", "See [[B]] and [[Nobody]].\n\n```\n[[Fenced]]\n```\n`[[Ticked]]` ![[pic.png]]", updated="2025-06-01T00:00:00Z"),
    "B.md": note("b", "Back to [[A]] and [[C|there]]."), "plain.md": "Only a body with [[A]] in it.", "sub/C.md": note("c", " short ", aliases="[see, Sea]", tags="x, y"),
    "times.md": front("A link to [[A]] again here.", id="t", created="some day", updated="2024-01-01T00:00:00", date="2024-05-01"), "null.md": front("Null fields and [[Sea]] here.", id="", created="", updated=""),
    "one.md": note("same", "[[two]] is linked from here."), "two.md": note("same", "[[one]] is linked from here."), "alone.md": note("l", "No link leads out of here or in."),
    "old.md": note("o", "# Q\n\nanswer\n\n### sources\n- [[A]]\n- [[Gone]]\n## More\n[[B]]", type="distilled"), "new.md": note("n", "## Sources\n- [[A]]\n", type="distilled", updated="2025-12-01T00:00:00Z"),
    "marked.md": note("m", "## Sources\n- [[Missing Note]]\n", provenance="Distilled"), "clip.md": note("p", "A clipping that has [[A]].", provenance="reference"), "chat.md": note("q", "A saved reply on [[A]].", provenance="llm", source_url="https://x.example"),
    "A 2.md": note("a2", "\n  See [[B]] and [[Nobody]].\n\n```\n[[Fenced]]\n```\n`[[Ticked]]` ![[pic.png]]\n\n"), "B 1.md": note("b1", "Back to [[A]], and elsewhere."), "C 1.md": note("x", "No note C lies beside [[A]]."),
    "broken.md": "---\nid: [\n---\nText after a broken block, with [[A]].", "list.md": "---\n- a\n- b\n---\nA list is no mapping, see [[A]].", "sub/2024-01-05.md": "A daily note on [[A]].",
    "drawing.excalidraw.md": "draw", "sub/plugin.md": front("x", **{"excalidraw-plugin": ""}), "tagged.md": "text #ignore", "fronted.md": front("x", tags="['#IGNORE']"), ".hidden/h.md": "no", "pic.png": b"p", "bad.md": b"\xff\xfe",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("vaults")
    put(base / "vault", VAULT)
    put(base, {"outside.md": "secret"})
    return base / "vault"


@pytest.fixture(scope="module")
def notes(spark, root):
    return sources.read_vault(spark, str(root)).cache()


def test_scan(spark, root, notes):
    gone = {"drawing.excalidraw.md", "sub/plugin.md", "tagged.md", "fronted.md", ".hidden/h.md", "pic.png", "bad.md"}
    got = {r.path: r for r in notes.collect()}
    assert set(got) == set(VAULT) - gone
    counts = sources.vault_counts(sources.scan_vault(spark, str(root))).first()
    assert (counts.notes, counts.ignored) == (len(got), 4)
    assert got["A.md"].note_id == got["A.md"].id == "a" and got["plain.md"].id is None and got["plain.md"].note_id != got["null.md"].note_id
    assert got["broken.md"].body == VAULT["broken.md"] and got["broken.md"].unparsed and got["broken.md"].frontmatter_text == ""
    assert got["list.md"].body == "A list is no mapping, see [[A]]." and not got["list.md"].unparsed
    assert got["sub/C.md"].tags == ["x", "y"] and got["sub/C.md"].aliases == ["see", "Sea"] and got["marked.md"].provenance == "distilled"
    assert got["times.md"].recency.year == 2024 and got["plain.md"].recency is None and got["sub/2024-01-05.md"].date.startswith("2024-01-05")
    assert {r.path for r in sources.read_attachments(spark, str(root)).collect()} == {"drawing.excalidraw.md", "pic.png"}
    assert sources.read_note(notes, "../outside.md").count() == 0 == sources.read_note(notes, "tagged.md").count() and sources.read_note(notes, "sub/C.md").count() == 1


def test_every_check(spark, root, notes):
    found = health.all_checks(notes, sources.read_attachments(spark, str(root)))
    rows = {k: [r.asDict() for r in v.collect()] for k, v in found.items()}
    paths = {k: sorted(r["path"] for r in v) for k, v in rows.items() if v and "path" in v[0]}
    lacking = sorted(["plain.md", "broken.md", "list.md", "sub/2024-01-05.md"])
    assert paths["missing_frontmatter_fields"] == lacking and {tuple(r["missing"]) for r in rows["missing_frontmatter_fields"]} == {("id", "created", "updated")}
    assert sorted((r["path"], r["field"], r["problem"]) for r in rows["invalid_timestamps"]) == [
        ("null.md", "created", "unparseable"), ("null.md", "updated", "unparseable"), ("times.md", "created", "unparseable"), ("times.md", "date", "naive"), ("times.md", "updated", "naive"),
    ]
    assert [(r["id"], r["paths"]) for r in rows["duplicate_ids"]] == [("same", ["one.md", "two.md"])]
    assert sorted((r["path"], r["target"]) for r in rows["broken_wikilinks"]) == [("A 2.md", "Nobody"), ("A.md", "Nobody"), ("marked.md", "Missing Note"), ("old.md", "Gone")]
    assert {r["target"]: r["links"] for r in rows["dangling_targets"]} == {"Nobody": 2, "Missing Note": 1, "Gone": 1}
    assert [(r["path"], r["chars"], r["inbound"]) for r in rows["empty_notes"]] == [("sub/C.md", 5, 2), ("new.md", 18, 0)]
    alike = lambda a, b: round(difflib.SequenceMatcher(None, VAULT[a].split("---\n", 2)[2].strip(), VAULT[b].split("---\n", 2)[2].strip()).ratio(), 3)
    assert [(r["path"], r["base_path"], r["similarity"]) for r in rows["conflict_copies"]] == [("A 2.md", "A.md", 1.0), ("B 1.md", "B.md", alike("B.md", "B 1.md"))]
    assert [(r["path"], r["provenance"]) for r in rows["imported_missing_source"]] == [("clip.md", "reference")]
    assert paths["orphans"] == ["alone.md"]
    assert sorted((r["path"], r["kind"], r["sources"]) for r in rows["stale_distilled"]) == [("marked.md", "unresolvable", ["Missing Note"]), ("old.md", "stale", ["A.md"]), ("old.md", "unresolvable", ["Gone"])]
    assert {r.name: r.n for r in health.summary(found).collect()} == {k: len(v) for k, v in rows.items()}
    with pytest.raises(ValueError, match="field_names"):
        health.all_checks(notes.drop("field_names"))


def test_backfill(spark, root, notes):
    rows = notes.withColumns({"first_commit": F.lit(None).cast("timestamp"), "last_commit": F.lit(None).cast("timestamp"), "birth": F.lit(None).cast("timestamp")})
    assert {(r.path, r.reason) for r in backfill.manual(rows).collect()} == {
        ("broken.md", "frontmatter present but failed to parse"), ("list.md", "frontmatter present but failed to parse"), ("times.md", "created value does not parse"), ("null.md", "created value does not parse"),
        ("one.md", "duplicate id shared across notes"), ("two.md", "duplicate id shared across notes"),
    }
    changes = backfill.resolution(rows).cache()
    assert {(r.path, r.field, r.source, r.confidence) for r in changes.collect()} == {(p, *x) for p in ("plain.md", "sub/2024-01-05.md") for x in (("id", "generated", "high"), ("created", "mtime", "low"), ("updated", "mtime", "medium"))}
    text = {r.path: r.text for r in backfill.filled_in(rows, changes).collect()}["plain.md"]
    assert text.startswith("---\nid: 01") and text.endswith("---\n" + VAULT["plain.md"]) and text.count("\n") == 5
    inside = spark.createDataFrame([("---\na: 1\n---\nx", "b: $2"), ("---\n---\nx", "b: 2"), ("x", "b: 2"), ("x", "")], "raw string, added string")
    assert [r.t for r in inside.select(backfill.apply_changes(F.col("raw"), F.col("added")).alias("t")).collect()] == ["---\na: 1\nb: $2\n---\nx", "---\nb: 2\n---\nx", "---\nb: 2\n---\nx", "x"]
    made = spark.range(1).select(backfill.ulid(F.lit(1469918176385), F.lit("0123456789abcdef0123")).alias("u")).first().u
    number = sum(backfill.BASE32.index(c) << 5 * k for k, c in enumerate(reversed(made)))
    assert len(made) == 26 and number == (1469918176385 << 80) + 0x0123456789ABCDEF0123


GOLD = {
    "id": "q", "query": "x", "answerable": True, "category": "c", "slices": ["s"], "relevant_evidence": [{"note_id": "a", "path": "A.md", "heading": "", "grade": 3}], "required_evidence_groups": [["a#"]],
    "gold_facts": ["f"], "forbidden_facts": [],
}


def test_golden_form(spark, tmp_path):
    odd = [
        GOLD | {"slices": [1]}, GOLD | {"answerable": 1}, {k: v for k, v in GOLD.items() if k != "category"}, GOLD | {"relevant_evidence": [{"note_id": "a"}]}, GOLD | {"required_evidence_groups": [["a"]]},
        GOLD | {"filters": {"colour": "red"}}, GOLD | {"relevant_evidence": [GOLD["relevant_evidence"][0] | {"grade": True}]}, GOLD | {"filters": {"tags": "x"}}, GOLD | {"filters": {"tags": ["x"], "since": "2024-01-01"}},
    ]
    path = tmp_path / "g.jsonl"
    path.write_text("\n".join([json.dumps(GOLD), "", "{broken", "[1]", *map(json.dumps, odd)]) + "\n")
    got = [(r.line, r.problem) for r in sources.golden_problems(spark, str(path)).orderBy("line").collect()]
    assert got == [
        (3, "no JSON"), (4, "no JSON object"), (5, "slices is no list of texts"), (6, "answerable is no boolean"), (7, "missing: category"), (8, "label 0 is no object with note_id, path, heading, grade"),
        (9, "group 0 is no list of note#heading"), (10, "filters has other keys than type, folder, tags, since, until"), (11, "label 0 has a grade that is none of 0 to 3"), (12, "a filter is no text, or tags no list of texts"),
    ]
    assert sum(r._corrupt_record is not None for r in sources.read_golden(spark, str(path)).collect()) >= 1


def test_golden_meaning(spark, tmp_path):
    rows = [
        GOLD, GOLD | {"id": "two", "relevant_evidence": [GOLD["relevant_evidence"][0] | {"grade": 1}] * 2}, GOLD | {"id": "no", "answerable": False}, GOLD | {"id": "q"},
        GOLD | {"id": "far", "relevant_evidence": [{"note_id": "z", "path": "Z.md", "heading": "", "grade": 3}, {"note_id": "c", "path": "A.md", "heading": "H", "grade": 3}], "required_evidence_groups": [["z#", "y#"]]},
    ]
    path = tmp_path / "g.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)))
    corpus = spark.createDataFrame([("a", "A.md"), ("b", "B.md"), ("b", "C.md")], "note_id string, path string")
    bad = evaluation.validate(sources.read_golden(spark, str(path)), corpus, spark.createDataFrame([("A.md", "")], "path string, heading string"), {"notes": 3, "queries": 4})
    assert {(r.id, r.problem, r.level) for r in bad.collect()} == {
        ("two", "answerable without a grade 3", "error"), ("two", "group member below grade 2: a#", "error"), ("two", "label given twice: a#", "warning"), ("no", "unanswerable with labels, groups or facts", "error"),
        ("q", "repeated id", "error"), ("far", "no such path: Z.md", "error"), ("far", "other id at: A.md", "error"), ("far", "no such heading: A.md#H", "error"), ("far", "group member without label: y#", "error"),
        (None, "note id used twice: b", "error"), (None, "4 queries expected, not 5", "error"),
    }
    stats = evaluation.dataset_stats(sources.read_golden(spark, str(path)), corpus).first()
    assert (stats.queries, stats.answerable, stats.labelled_notes, stats.distractors) == (5, 4, 2, 2)


def test_manifest(spark, tmp_path):
    good = "eval_schema_version: 1\nname: n\ncorpus_root: notes\nqueries_file: q.jsonl\nextra: 1\n"
    (tmp_path / "dataset.yaml").write_text(good)
    found, odd = sources.read_manifest(spark, str(tmp_path))
    assert found["corpus_root"] == f"{tmp_path}/notes" and odd == ["extra"]
    for text, why in ((good.replace("1", "9", 1), "version"), ("- a", "mapping"), ("a: [", "YAML"), ("name: n", "lacks")):
        (tmp_path / "dataset.yaml").write_text(text)
        with pytest.raises(ValueError, match=why):
            sources.read_manifest(spark, str(tmp_path / "dataset.yaml"))


def test_summaries(spark, notes):
    rows = notes.filter("path = 'A.md'")
    prints = {r.note_id: r.fingerprint for r in summaries.fingerprinted(rows).collect()}
    incoming = spark.createDataFrame([(1, "a", prints["a"], "  good  one ")], "schema_version int, note_id string, source_fingerprint string, summary string")
    assert summaries.imported(incoming, rows).first().summary == "good one"
    with pytest.raises(ValueError, match="no such note"):
        summaries.imported(incoming.withColumn("note_id", F.lit("zz")), rows)


def test_linked_file_outside(spark, tmp_path):
    put(tmp_path / "v", {"a.md": "inside"})
    put(tmp_path, {"out.md": "outside"})
    os.symlink(tmp_path / "out.md", tmp_path / "v" / "link.md")
    assert "a.md" in {r.path for r in sources.read_vault(spark, str(tmp_path / "v")).collect()}
