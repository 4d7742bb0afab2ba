"""Steps of a project: readers, writers, states, validation, prompts, providers, commands."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import __main__
from lodestone.engine import Engine, Settings
from lodestone.operators import ann, enhance, prompts, providers, search, store, validate
from lodestone.sources import files, parse

PY = 'from django.contrib import admin\nimport json\n\n\nclass Note(models.Model):\n    text = models.CharField(max_length=9)\n\n\nclass NoteView(View):\n    @login_required\n    def get(self, request):\n        return json.dumps(1)\n\n    def setup(self):\n        pass\n\n\nadmin.site.register(Note)\n\n\ndef main():\n    return Note()\n'


@pytest.fixture
def root(tmp_path):
    root = tmp_path / "src"
    (root / "kept").mkdir(parents=True)
    (root / ".gitignore").write_text("# made\nmade/\n*.gen.py\n!good.gen.py\n")
    (root / "notes.py").write_text(PY)
    (root / "kept" / "good.gen.py").write_text("def good(a):\n    return a\n")
    (root / "kept" / "bad.gen.py").write_text("def bad(a):\n    return a\n")
    (root / "broken.py").write_text("def (")
    (root / "made").mkdir()
    (root / "made" / "x.py").write_text(PY)
    return root


def test_gitignore_and_errors(spark, root):
    found = files.project(spark, str(root))
    assert {r["file_path"] for r in found.collect()} == {"notes.py", "kept/good.gen.py", "broken.py"}
    assert [(r["file_path"], r["error"][:11]) for r in parse.errors(found).collect()] == [("broken.py", "SyntaxError")]


def test_django_details():
    own = {c["name"]: c for c in parse.parsed("notes.py", "python", PY)}
    assert own["NoteView"]["metadata"]["fields"] == {"get": "method @login_required", "setup": "method"}
    assert own["Note"]["metadata"]["fields"]["registered"] == "admin.site"


def test_whole_project(spark, root, tmp_path):
    engine = Engine(spark, Settings(str(tmp_path / "home")), score=providers.overlap_score)
    assert engine.run(str(root)) == store.STEPS and engine.run(str(root)) == []
    points = engine.index().count()
    assert points == engine.table("points").count() == engine.table("embedded").count() > 3
    report = engine.validate(str(tmp_path / "report"), 2)
    assert report.count() == points and {"overall", "passed", "rejection_reasons", "recommendations", "validation"} <= set(report.columns)
    assert "embedding" not in spark.read.json(str(tmp_path / "report")).columns and spark.read.json(str(tmp_path / "report")).count() == 2
    engine.hybrid_setup()
    best = engine.retrieve(["json dumps request"], 3, collection="func").orderBy("rank").collect()
    assert best and best[0]["cross_score"] >= best[-1]["cross_score"]
    assert engine.enrich().count() == points == engine.enrich().count()
    assert engine.providers_health() == {"embed": True, "generate": True, "score": True}
    assert engine.health()["points"] == points
    assert [c["name"] for c in engine.parse_file("a.py", "def f(): pass")] == ["f"]


def test_search_goes_on_without_the_sparse_leg(spark, root, tmp_path, monkeypatch, capsys):
    engine = Engine(spark, Settings(str(tmp_path / "home")))
    engine.run(str(root))
    monkeypatch.setattr(engine, "terms", lambda points: 1 / 0)
    assert engine.retrieve(["json dumps"], 3).count() and "dense search only" in capsys.readouterr().out


def test_embedded_file(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"chunks": [{"id": "1", "type": "class", "code": "x", "embedding": [0.5] * 3 + [0.1]}, {"id": "2", "type": "class", "code": "y", "embedding": [1.0]}]}))
    engine = Engine(spark, Settings(str(tmp_path / "home"), dim=4))
    assert engine.index_embedded(str(tmp_path / "none.json")) is None
    assert [r["collection"] for r in engine.index_embedded(str(tmp_path / "e.json")).collect()] == ["classes"]


def test_envelope_symbols_and_texts(spark, tmp_path):
    chunks = spark.createDataFrame([("1", "python", "class"), ("2", "python", "function"), ("3", None, "class")], "id string, language string, type string")
    files.write_envelope(chunks, str(tmp_path / "env"), project="p")
    row = spark.read.json(str(tmp_path / "env" / "envelope")).first()
    assert (row["project"], row["total_chunks"], row["by_language"]["python"], row["by_type"]["class"]) == ("p", 3, 2, 2)
    assert files.chunk_file(spark, str(tmp_path / "env")).count() == 3
    (tmp_path / "s.json").write_text(json.dumps({"a": [{"file": "f.py", "line": 3, "kind": "class"}], "b": []}))
    assert [(r["name"], r["line"]) for r in files.symbol_index(spark, str(tmp_path / "s.json")).collect()] == [("a", 3)]
    assert files.symbol_index(spark, str(tmp_path / "none.json")) is None
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.md").write_text("# A\n\ntext")
    (tmp_path / "t" / "b.csv").write_text("x,y\n1,2\n")
    got = files.texts(spark, str(tmp_path / "t")).collect()
    assert sorted((r["type"], r["content"]) for r in got) == [("csv", "1,2"), ("csv", "x,y"), ("markdown", "# A\n\ntext")]
    assert files.save(chunks, str(tmp_path / "d"), "parse", "python").endswith("/parse/python/csv")


def test_states_and_catalog(spark):
    control = store.marked(store.states(spark), "p", "parsed")
    assert [r["step"] for r in store.pending(control, spark.createDataFrame([("p",)], "project string")).orderBy("nth").collect()] == store.STEPS[1:]
    again = store.marked(control, "p", "parsed", False)
    assert again.count() == 1 and store.pending(again, spark.createDataFrame([("p",)], "project string")).count() == 4
    with pytest.raises(ValueError):
        store.marked(control, "p", "eaten")
    assert store.matching(["a", "b"], ["b", "c"]) == ["b"]
    assert store.with_column(control, "step", "string").columns == control.columns


def test_providers(spark):
    tries = []

    def shaky(texts):
        tries.append(1)
        if len(tries) < 3:
            raise OSError("down")
        return texts

    assert providers.retried(shaky, wait=0)(["x"]) == ["x"] and len(tries) == 3
    with pytest.raises(OSError):
        providers.retried(lambda: (_ for _ in ()).throw(OSError("down")), wait=0)()
    rows = spark.createDataFrame([("a b", "b a"), ("a", None), (None, "z")], "query string, text string")
    assert [r["cross_score"] for r in providers.cross_encoded(rows).collect()] == [pytest.approx(1.0), 0.0, 0.0]
    assert providers.cross_encoded(rows, None).filter("cross_score IS NULL").count() == 3
    assert [r["est"] for r in providers.token_counts(rows, "query", {"est": providers.estimated}).collect()] == [0, 0, 0]
    asked = spark.createDataFrame([("one\ntwo",)], "prompt string")
    assert providers.answered(asked, providers.echo).first()["response"] == "one"
    with pytest.raises(Exception, match="Error processing prompt"):
        providers.answered(asked, lambda texts: 1 / 0).collect()
    assert providers.Client(provider="other").provider == "ollama" and validate.batches(33, 16) == 3


def test_validation_of_bad_vectors(spark):
    rows = [("zero", [0.0] * 64), ("short", [1.0, 2.0]), ("none", None), ("good", [float(np.sin(i)) for i in range(64)])]
    chunks = spark.createDataFrame([(i, v, "import json\nx = json.dumps(1)", "python", ["json"]) for i, v in rows], "id string, embedding array<double>, code string, language string, dependencies array<string>")
    got = {r["id"]: r for r in validate.validated(chunks).collect()}
    assert len(got) == 4 and not any(got[k]["passed"] for k in ("zero", "short", "none"))
    assert "Zero vector detected - model may have failed to generate embedding" in got["zero"]["recommendations"]
    assert "Embedding dimension mismatch - check model configuration" in got["short"]["recommendations"]
    assert got["good"]["scores"]["dimensionality"] == 1.0 and got["good"]["scores"]["dependency"] == 1.0


def test_prompts_with_everything(spark):
    chunk = {"id": "1", "type": "method", "name": "go", "language": "rust", "file_path": "x.rs", "code": " fn go() {} ", "dependencies": ["a", "b"], "qualified_name": "x.go", "start_line": 1, "end_line": 2}
    schema = "id string, type string, name string, language string, file_path string, code string, dependencies array<string>, qualified_name string, start_line int, end_line int, relationships struct<imports:array<string>,called_functions:array<string>,references:array<string>>, metadata struct<decorators:array<string>,base_classes:array<string>>"
    rows = spark.createDataFrame([(*chunk.values(), (["i"] * 5, [], ["r"]), (["@d"], []))], schema)
    symbols = spark.createDataFrame([("b", "q/y.rs", 7, "struct")], "name string, file string, line int, kind string")
    text = prompts.summary_prompts(rows, symbols).first()["prompt"]
    for part in ("specializing in rust and", "Module: root module", "Location: Lines 1-2", "Decorators: @d", "- b: Struct defined in y.rs:7", "Relationships:\nImports: i, i, i; References: r", "ownership system", "```rust\nfn go() {}\n```"):
        assert part in text
    assert text.endswith(prompts.SUMMARY_END)


def test_enhancement_of_missing_parts(spark):
    rows = spark.createDataFrame([("1", "main", "import os\nos.path.join(1)", "python", None, "old")], "id string, name string, code string, language string, dependencies array<string>, context string")
    out = enhance.normalized(rows).first()
    assert (out["dependencies"], out["references"], out["qualified_name"], out["context"]["summary"]) == ([], [], "main", "old")
    known = spark.createDataFrame([("1", "join")], "id string, symbol string")
    out = enhance.filled_in(enhance.normalized(rows), known).first()
    assert out["dependencies"] == ["os"] and out["references"] == ["join"]
    assert enhance.with_defaults(rows).first()["is_entry_point"]


def test_approximate_search_finds_most(spark):
    rng = np.random.default_rng(2)
    heads = rng.normal(size=(20, 16))
    rows = [(i, (heads[i % 20] + 0.4 * rng.normal(size=16)).tolist()) for i in range(2000)] + [(5000, None), (5001, [1.0])]
    points = spark.createDataFrame(rows, "id long, vector array<double>").repartition(4)
    queries = points.filter("id % 50 = 0").selectExpr("id AS query_id", "vector AS query")
    exact = {(r["query_id"], r["id"]) for r in search.dense(points, queries, 10).collect()}
    sample = ann.sampled(points)
    centers = ann.fitted(sample, 16)
    probes = ann.probes_for(sample, centers, 0.95)
    assert 1 <= probes < 8
    own = ann.index(points, centers)
    assert own.count() == 2000
    got = {(r["query_id"], r["id"]) for r in search.best(ann.nearest(own, centers, queries, 10, probes), 10, "query_id").collect()}
    assert len(got & exact) >= 0.9 * len(exact)
    assert ann.nearest(own, centers, queries.limit(0), 10, probes).count() == 0


def test_settings(monkeypatch):
    one = Settings("h", dim=8, ignored=["a"])
    assert Settings.loaded(one.saved()) == one and Settings.loaded('{"home": "x", "other": 1}').home == "x"
    monkeypatch.setenv("LODESTONE_DIM", "32")
    monkeypatch.setenv("LODESTONE_LEAST_QUALITY", "0.5")
    assert (Settings.from_env("h").dim, Settings.from_env("h").least_quality) == (32, 0.5)


def test_commands(spark, root, tmp_path, capsys):
    home = str(tmp_path / "home")
    assert __main__.main([home, "run", str(root)]) == store.STEPS
    for command in ("hybrid_setup", "validate_embeddings", "health", "enrich"):
        assert __main__.main([home, command])
    (tmp_path / "p.txt").write_text("one\ntwo\n")
    assert __main__.main([home, "batch", str(tmp_path / "p.txt"), str(tmp_path / "out")]) == 2
    __main__.main([home, "advanced_rag", "json dumps"])
    assert "query_id" in capsys.readouterr().out


def test_tree_dump():
    assert parse.tree("python", "x = 1")[:3] == ["Module", "  Assign", "    Name"]
    assert parse.tree("html", "<div><p>a</p></div><p>b</p>") == ["div", "  p", "p"]


def test_regular_expressions_hold_no_braces():
    code = "const r = s.match(/[{]x/g);\nfunction go() { return /}/.test(r) }\nfunction two() { return 4 / 2 / 1 }\n"
    assert [(c["name"], c["start_line"]) for c in parse.parsed("a.js", "javascript", code) if c["type"] == "function"] == [("go", 2), ("two", 3)]


def test_import_lines_by_language(spark):
    rows = spark.createDataFrame([(" import a\nx", "python"), ("export b\nrequire('c')", "typescript"), ("import d", "css")], "code string, language string")
    from lodestone.functions import text as T

    assert [r[0] for r in rows.select(T.import_lines_of(F.col("code"), F.col("language"))).collect()] == [["import a"], ["export b", "require('c')"], []]


def test_requests(spark, root, tmp_path):
    import threading
    import urllib.request

    from lodestone import server

    engine = Engine(spark, Settings(str(tmp_path / "home")))
    running = server.server(engine, 0)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    place = f"http://127.0.0.1:{running.server_port}"

    def post(where, **given):
        return json.loads(urllib.request.urlopen(urllib.request.Request(place + where, json.dumps(given).encode())).read())

    assert post("/parse-project", root=str(root))["rows"] > 3
    for path in ("/preprocess-chunks", "/embed-chunks", "/index-chunks", "/api/hybrid-setup"):
        assert post(path)["rows"] > 0
    assert post("/parse-file", path="a.py", content="def f(): pass")["chunks"][0]["name"] == "f"
    assert post("/retrieve", questions=["json dumps"], most=2)["hits"]
    assert json.loads(urllib.request.urlopen(place + "/").read())["tables"]["points"] > 0
    assert server.answer(engine, "POST", "/none", b"")[0] == 404 and server.answer(engine, "POST", "/parse-file", b"{}")[0] == 400
    running.shutdown()
