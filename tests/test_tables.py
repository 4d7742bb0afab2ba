"""Table functions of SQL, parsing in one pass, and prompts in the order of their lines."""

from lodestone.sources import files, parse, tables

GOOD, BAD = "def f(x):\n    return x\n\nclass A:\n    def g(self):\n        pass\n", "def f(:\n"
ROWS = [("a/x.py", "python", GOOD), ("a/bad.py", "python", BAD), ("b/s.css", "css", "p { margin: 0 }\n@media print { a { b: c } }"), ("c.html", "html", "<div>" + "word " * 20 + "</div>"), ("n.py", "python", None), ("e.txt", "text", " \n")]


def source(spark):
    return spark.createDataFrame(ROWS, "file_path string, language string, content string").repartition(3)


def test_lateral_gives_what_the_parser_gives(spark):
    tables.register(spark)
    found = spark.sql("SELECT f.file_path, c.* FROM {f} f, LATERAL parse_chunks(f.file_path, f.language, f.content) c", f=source(spark)).collect()
    want = [(p, *(c[k] for k in tables.CHUNK_ROW)) for p, lang, text in ROWS for c in parse.parsed(p, lang, text or "")]
    assert sorted(map(str, [tuple(r)[:-1] for r in found if r["error"] is None])) == sorted(map(str, want)) and len(want) >= 6
    assert [(r["file_path"], r["error"].split(":")[0]) for r in found if r["error"]] == [("a/bad.py", "SyntaxError")]


def test_figures_of_partitions(spark):
    tables.register(spark)
    got = spark.sql("SELECT * FROM parse_figures(TABLE(SELECT * FROM {f}) PARTITION BY language)", f=source(spark)).collect()
    assert sorted(map(tuple, got)) == [("css", 1, 0, 3, 1), ("html", 1, 0, 1, 1), ("python", 3, 1, len(parse.parsed("a/x.py", "python", GOOD)), 3), ("text", 1, 0, 0, 0)]


def test_chunks_and_errors_of_one_pass(spark):
    both = parse.outcomes(source(spark))
    chunks = both.filter("error IS NULL").drop("error")
    assert chunks.schema == parse.chunks(source(spark)).schema
    assert sorted(map(str, chunks.collect())) == sorted(map(str, parse.chunks(source(spark)).collect()))
    errors = both.filter("error IS NOT NULL").select("file_path", "language", "error")
    assert sorted(map(tuple, errors.collect())) == sorted(map(tuple, parse.errors(source(spark)).collect()))


def test_prompts_are_numbered_by_their_lines(spark, tmp_path):
    (tmp_path / "one.txt").write_text("first\n\n third \r\nfourth")
    (tmp_path / "two.txt").write_text("only\n")
    got = sorted((r["file"].rsplit("/", 1)[-1], r["seq"], r["prompt"]) for r in files.prompts(spark, str(tmp_path)).collect())
    assert got == [("one.txt", 1, "first"), ("one.txt", 3, "third"), ("one.txt", 4, "fourth"), ("two.txt", 1, "only")]
