import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.python import bootstrap_mean, fact_coverage, read_page, symbols_of
from reference_search import terms

EDGE = ["向量检索", "使用BM25检索v2.0接口", "字", "Hello 世界 foo-bar a", "測a試", "x² ½ é ‿ ZWJ‍x", "a.b/c#d", "", "İx", "٣٤ abc"]


def test_tokenizer_equals_plain_python(spark):
    rows = spark.createDataFrame([(t,) for t in EDGE], "t string").select("t", T.tokenize("t").alias("x")).collect()
    for r in rows:
        if "İ" not in r.t:
            assert r.x == terms(r.t), r.t


def test_null_text_has_no_terms(spark):
    assert spark.createDataFrame([(None,)], "t string").select(T.tokenize("t")).first()[0] == []


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize("given, wanted", [("<think>a\nb</think> ok", "ok"), ("ok <THINK>rest", "ok"), ("plain", "plain")])
def test_reasoning_is_stripped(spark, given, wanted):
    assert one(spark, given, T.strip_reasoning) == wanted


def test_subquestions(spark):
    assert one(spark, "What is x? and how; why；z", T.subquestions) == ["What is x", "how", "why"]
    assert one(spark, "", T.subquestions) == [""]


def test_routing(spark):
    assert one(spark, "fix the Bug in class", T.evidence_type) == "issues"
    assert one(spark, "subclassing", T.evidence_type) == "code"
    assert one(spark, "hello", T.evidence_type) == "mixed"


def test_rewrites(spark):
    assert one(spark, "GitHub Repo 避免每次全量重建", lambda c: T.rewrite(c, 1)).startswith("file hash")
    assert one(spark, "q", lambda c: T.rewrite(c, 1)).endswith("exact terminology")
    assert one(spark, "q", lambda c: T.rewrite(c, 5)).endswith("evidence source")


def test_lines(spark):
    assert one(spark, "a\r\nb\rc\fd\n", T.lines) == ["a", "b", "c", "d"]
    assert one(spark, "", T.lines) == []


def test_facts(spark):
    rows = [([["KV cache", "x"], ["Ｖｌｌｍ"]], "the kv-cache of VLLM"), ([["nope"]], "y"), ([], "z")]
    got = spark.createDataFrame(rows, "f array<array<string>>, a string").select(fact_coverage("f", "a").alias("c")).collect()
    assert [r.c for r in got] == [1.0, 0.0, 0.0]


def test_pages():
    title, text = read_page("<title> A  b</title><style>x</style><h2>Head</h2><p>One<br>two</p><ul><li>i<li>j</ul><script>no</script>&amp;")
    assert title == "A b"
    assert "## Head" in text and "- i" in text and "no" not in text and text.endswith("&")


def test_symbols():
    found = symbols_of("class A:\n    def f(self):\n        def g():\n            pass\nasync def h():\n    pass\n")
    assert [(s["name"], s["kind"], s["start_line"], s["end_line"]) for s in found] == [("A", "class", 1, 4), ("A.f", "function", 2, 4), ("h", "function", 5, 6)]
    assert symbols_of("def (") == []


def test_bootstrap():
    assert bootstrap_mean([], 1) == (0.0, 0.0)
    assert bootstrap_mean([0.5, 0.5], 1) == (0.5, 0.5)
    low, high = bootstrap_mean([0.0, 1.0, 1.0, 0.0, 1.0], 3)
    assert low <= 0.6 <= high and (low, high) == bootstrap_mean([0.0, 1.0, 1.0, 0.0, 1.0], 3)
