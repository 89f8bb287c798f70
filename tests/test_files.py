import datetime
import json
import os

import pytest

from quillspark.operators import files
from quillspark.operators.edits import EditError

NOW = datetime.datetime(2024, 1, 2, 3, 4, 5, tzinfo=datetime.UTC)


def test_paths(tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "out.md").write_text("x")
    os.symlink(tmp_path / "out.md", tmp_path / "v" / "link.md")
    for bad in ("../out.md", "/a.md", "a//b.md", "a\\b.md", "a.txt", "./a.md", "", "link.md"):
        with pytest.raises(files.NoteError):
            files.read_note(str(tmp_path / "v"), bad)


def test_one_note(tmp_path):
    root = str(tmp_path)
    first = files.create_note(root, "sub/a.md", "one two\n", {"tags": ["x"]}, NOW, "id1")
    with pytest.raises(files.NoteError, match="already"):
        files.create_note(root, "sub/a.md", "other")
    fields, body, now = files.read_note(root, "sub/a.md")
    assert fields == {"id": "id1", "created": "2024-01-02T03:04:05+00:00", "updated": "2024-01-02T03:04:05+00:00", "tags": ["x"]} and body == "one two\n" and now == first
    assert files.parse_note(files.render_note(fields, body)) == (fields, body)
    change = json.dumps([{"old_text": "two", "new_text": "three"}])
    assert "+one three" in files.edit_note(root, "sub/a.md", change, first, dry=True) and files.read_note(root, "sub/a.md")[2] == first
    files.edit_note(root, "sub/a.md", change, first, NOW + datetime.timedelta(days=1))
    fields, body, now = files.read_note(root, "sub/a.md")
    assert body == "one three\n" and str(fields["updated"]).startswith("2024-01-03")
    with pytest.raises(files.NoteError, match="changed"):
        files.edit_note(root, "sub/a.md", change, first)
    with pytest.raises(EditError):
        files.edit_note(root, "sub/a.md", change)
    with pytest.raises(files.NoteError, match="changed"):
        files.replace_note(root, "sub/a.md", "x", first)
    assert files.merge_frontmatter(root, "sub/a.md", {"id": "other", "tags": ["y"], "type": "idea"})["id"] == "id1"
    fields = files.read_note(root, "sub/a.md")[0]
    assert fields["type"] == "idea" and "y" in fields["tags"]
    files.create_note(root, "b.md", "taken")
    with pytest.raises(files.NoteError, match="already"):
        files.move_note(root, "sub/a.md", "b.md")
    files.move_note(root, "sub/a.md", "c/d.md")
    assert files.read_note(root, "c/d.md")[1] == "one three\n" and not (tmp_path / "sub/a.md").exists()


def test_parse():
    assert files.parse_note("plain") == ({}, "plain")
    assert files.parse_note("---\na: [\n---\nx") == ({}, "---\na: [\n---\nx")
    assert files.parse_note("---\n---\n\nx") == ({}, "x")
    assert files.render_note({}, "x") == "x"


def test_json(tmp_path):
    assert files.envelope("sync", {"b": 1, "a": "é"}) == '{"command":"sync","ok":true,"result":{"a":"é","b":1},"warnings":[]}'
    assert json.loads(files.envelope("x", error=("invalid_arguments", "no"))) == {"command": "x", "ok": False, "error": {"type": "invalid_arguments", "message": "no"}, "warnings": []}
    files.write_results(str(tmp_path / "r" / "out.json"), {"b": [1], "a": 2})
    assert (tmp_path / "r" / "out.json").read_text() == '{\n  "a": 2,\n  "b": [\n    1\n  ]\n}\n' and os.listdir(tmp_path / "r") == ["out.json"]
