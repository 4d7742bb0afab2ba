import json

import pytest

from lodestone.engine import Engine, Settings
from lodestone.sources import files, parse

PY = 'import json as j\n\n\nclass Box(Base):\n    """A box."""\n\n    def save(self, x: int = 1) -> str:\n        if x and self:\n            return j.dumps(x)\n\n\nasync def run(a):\n    return [b for b in a]\n'
JS = "import React from 'react';\nclass A extends B {\n  get v() { return '}' }\n  load(x) { return x }\n}\nconst add = (a, b) => a + b;\nfunction go() { return 1 }\n"


def test_python_chunks():
    found = {c["name"]: c for c in parse.parsed("app/box.py", "python", PY)}
    assert list(found) == ["save", "Box", "run"]
    assert found["save"]["type"] == "method" and found["save"]["parent"] == "Box" and found["save"]["dependencies"] == ["json"]
    assert found["save"]["complexity"] == 3 and found["Box"]["docstring"] == "A box." and found["Box"]["qualified_name"] == "box.Box"
    assert found["run"]["signature"] == "async def run(a):"


def test_bad_python_has_no_chunks():
    assert parse.parsed("a.py", "python", "def (") == []


def test_javascript_chunks():
    found = [(c["type"], c["name"], c["parent"]) for c in parse.parsed("a.js", "javascript", JS)]
    assert found == [("import", "react", None), ("class", "A", None), ("getter", "v", "A"), ("method", "load", "A"), ("variable", "add", None), ("function", "go", None)]


def test_css_and_html_chunks():
    assert [c["name"] for c in parse.parsed("a.css", "css", "/* x */ .a { b: c }\n@media (x) { .d { e: f } }")] == [".a", "@media (x)", ".d"]
    long = "x" * 60
    assert [c["name"] for c in parse.parsed("a.html", "html", f"<div id='m'><p>{long}</p><br></div>")] == ["m"]
    assert [c["type"] for c in parse.parsed("a.html", "html", "<p>short</p>")] == ["html_file"]


def test_empty_file_has_no_chunks():
    assert parse.parsed("a.txt", "text", " \n") == []


@pytest.mark.parametrize(("glob", "path", "hit"), [("node_modules", "a/node_modules/b.js", True), ("*.pyc", "a/b.pyc", True), ("/build", "a/build/x.py", False), ("docs/*.py", "docs/a.py", True), ("docs/*.py", "docs/b/a.py", False)])
def test_ignore_patterns(glob, path, hit):
    import re

    assert bool(re.search(files.pattern(glob), path)) is hit


def test_project_to_answer(spark, tmp_path):
    root = tmp_path / "src"
    (root / "node_modules").mkdir(parents=True)
    (root / "box.py").write_text(PY)
    (root / "a.js").write_text(JS)
    (root / "node_modules" / "x.js").write_text(JS)
    engine = Engine(spark, Settings(str(tmp_path / "home")))
    engine.ingest(str(root))
    engine.preprocess()
    first = engine.index().count()
    assert first == engine.index().count() > 5  # nothing is indexed twice
    best = engine.retrieve(["save x json dumps"], 3).orderBy("rank").collect()
    assert best and best[0]["rank"] == 1
    assert "### Question:\nsave x" in engine.prompts(["save x"]).collect()[0]["prompt"]


def test_chunk_files_in_both_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"total": 1, "chunks": [{"id": "1", "code": "x"}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"id": "1", "code": "x"}]))
    assert files.chunk_file(spark, str(tmp_path / "a.json")).collect()[0]["code"] == "x"
    assert files.chunk_file(spark, str(tmp_path / "b.json")).collect()[0]["code"] == "x"


def test_prompts_and_results(spark, tmp_path):
    (tmp_path / "p.txt").write_text("one\n\n  two \n")
    found = files.prompts(spark, str(tmp_path / "p.txt"))
    assert [r["prompt"] for r in found.orderBy("seq").collect()] == ["one", "two"]
    files.write_results(found, str(tmp_path / "out"), "csv")
    with pytest.raises(ValueError):
        files.write_results(found, str(tmp_path / "out"), "xml")
    with pytest.raises(ValueError):
        files.table_name("a; drop")
