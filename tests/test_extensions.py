import pytest
from pyspark.sql import functions as F

from lodestone.operators.registry import Registry, Tool, encoder, reranker
from lodestone.sources import reports
from lodestone.sources.files import evaluation_set, routed, scan
from lodestone.sources.web import pages


def hits(spark):
    return spark.createDataFrame([(1, 1, 0.5, 1)], "query_id int, chunk_id int, score double, rank int")


def test_tools_are_retried_by_kind_of_failure(spark):
    calls = []

    def flaky(queries, k):
        calls.append(k)
        if len(calls) == 1:
            raise TimeoutError("slow")
        return hits(spark)

    def broken(queries, k):
        raise ValueError("no")

    def lost(queries, k):
        raise ConnectionError("gone")

    r = Registry()
    for name, f in (("flaky", flaky), ("broken", broken), ("lost", lost)):
        r.register(Tool(name, f, max_results=7))
    with pytest.raises(ValueError):
        r.register(Tool("flaky", flaky))
    one = r.execute("flaky", hits(spark), 50)
    assert (one.status, one.attempts, calls) == ("completed", 2, [7, 7])
    two = r.execute("broken", hits(spark), 5)
    assert (two.status, two.attempts, two.error_type, two.retryable) == ("failed", 1, "internal", False)
    three = r.execute("lost", hits(spark), 5)
    assert (three.status, three.attempts, three.error_type, three.retryable) == ("failed", 2, "connection", True)
    assert (r.execute("none", hits(spark), 5).attempts, r.execute("lost", hits(spark), 0).error_type) == (0, "validation")


def test_injected_models(spark):
    encode = encoder(lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], 2, prefix="q: ")
    assert spark.createDataFrame([("abc",)], "t string").select(encode("t")).first()[0] == [6.0, 1.0]
    score = reranker(lambda: lambda pairs: [float(len(c)) for _, c in pairs])
    rows = score(spark.createDataFrame([(1, 5, "q", "xx")], "query_id int, chunk_id int, question string, content string")).collect()
    assert rows[0].raw == 2.0


def test_scan_and_route(spark, tmp_path):
    for name, text in {"a/x.py": "class A:\n    def f(self):\n        pass\n", "b.md": "# T\nbody\n", "c.txt": "one\ntwo\n", "d.go": "func Go() {\n}\n", "bad.py": "def (:\n", ".env": "SECRET=1", "e.bin": "no"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(text)
    found = scan(spark, str(tmp_path))
    assert {r.path for r in found.collect()} == {"a/x.py", "b.md", "c.txt", "d.go", "bad.py"}
    got = {(r.path, r.heading, r.start_line, r.end_line, r.block_type) for r in routed(found).collect()}
    assert got == {("a/x.py", "A", 1, 3, "class"), ("a/x.py", "A.f", 2, 3, "function"), ("b.md", "T", 1, 2, "section"), ("c.txt", None, 1, 2, "text"), ("d.go", "Go", 1, 2, "symbol"), ("bad.py", None, 1, 1, "code")}


def test_pages_with_unsafe_addresses_go(spark):
    rows = [("https://example.org/a", "<title>T</title><p>x"), ("http://127.0.0.1/", "x"), ("http://[::1]/", "x"), ("http://10.1.2.3:80/x", "x"), ("http://localhost/", "x"), ("file:///etc", "x")]
    got = pages(spark.createDataFrame(rows, "url string, html string")).collect()
    assert [(r.url, r.title) for r in got] == [("https://example.org/a", "T")]


def test_reports_are_not_overwritten(spark, tmp_path):
    report = spark.createDataFrame([(1, [1, 2])], "id int, xs array<int>")
    reports.write(report, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/json")).count() == 1
    with pytest.raises(Exception, match="exist"):
        reports.write(report, str(tmp_path / "r"))
    assert [r.line for r in reports.markdown(report.select("id")).orderBy("n").collect()] == ["| id |", "|-|", "| 1 |"]


def test_evaluation_set(spark, tmp_path):
    (tmp_path / "q.json").write_text('[{"id": "1", "question": "q?", "required_evidence": ["x"], "answerable": true}]')
    row = evaluation_set(spark, str(tmp_path / "q.json")).first()
    assert (row.id, row.required_evidence, row.category) == ("1", ["x"], None)
    assert reports.synthetic_files(spark, 3).select(F.max("path")).first()[0] == "src/module_0002.py"
