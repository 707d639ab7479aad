"""A loop whose own searches fail has no answers: it raises what failed, whatever the mode, instead of answering without their hits."""

import os
from types import SimpleNamespace

import pytest
from py4j.protocol import Py4JError, Py4JNetworkError

from lodestone.operators import common, registry
from lodestone.operators.registry import Registry, Tool, attempted
from lodestone.plans import agent, evidence
from test_agent import CHUNK, corpus

SF = "/root/testdata/sf0.001"


def tables(spark):
    chunks, issues, questions = corpus()
    return spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(issues, "chunk_id long, content string"), spark.createDataFrame(questions, "query_id long, question string")


def lost(rows):
    os._exit(3)
    yield


@pytest.mark.parametrize("problem", [TimeoutError("late"), ConnectionError("gone"), MemoryError("full")])
def test_agentic_loop_raises_what_a_channel_raised(spark, problem):
    def fails(*_):
        raise problem

    with pytest.raises(type(problem)):
        agent.run(*tables(spark), "agentic", lexical=fails)
    with pytest.raises(type(problem)):
        agent.run(*tables(spark), "agentic", embedded=fails)
    with pytest.raises(ValueError, match="1 to 100"):  # more candidates than a call may ask for
        agent.run(*tables(spark), "agentic", candidates=101)


def test_agentic_loop_query_raises(spark, monkeypatch):
    def fails(*_):
        raise RuntimeError("no index")

    monkeypatch.setattr(evidence, "lexical", fails)
    with pytest.raises(RuntimeError, match="no index"):
        evidence.Q["agentic_loop"](spark, SF)


def test_fixed_loop_query_raises_when_hits_are_not_written(spark, monkeypatch):
    def full(df):
        raise OSError("no space left")

    monkeypatch.setattr(registry, "settled", full)
    with pytest.raises(OSError, match="no space left"):
        evidence.Q["fixed_loop"](spark, SF)


def test_a_table_whose_files_are_nowhere_is_not_empty(spark, tmp_path, monkeypatch):
    """What executors wrote to folders of their own, which the driver does not see."""
    assert common.settled(spark.range(0)).count() == 0 and common.settled(spark.range(3)).count() == 3
    folder = SimpleNamespace(parquet=lambda path: os.makedirs(path))
    unseen = SimpleNamespace(sparkSession=spark, schema=spark.range(1).schema, write=SimpleNamespace(option=lambda *_: folder))
    monkeypatch.setattr(common, "shared_folder", lambda _: str(tmp_path))
    with pytest.raises(RuntimeError, match="no file"):
        common.settled(unseen)


def test_naive_loop_query_raises_when_workers_are_lost(spark, monkeypatch):
    def search(spark, sf, k, queries):
        return queries.select("query_id").mapInPandas(lost, "query_id long, chunk_id long, score double, rank int")

    monkeypatch.setattr(evidence, "lexical", search)
    with pytest.raises(Py4JError):
        evidence.Q["naive_loop"](spark, SF)


def test_a_lost_job_is_no_outcome_of_a_given_tool(spark):
    """What a tool's own Python raises in a task is still its outcome."""

    def raises(rows):
        raise ValueError("its own")
        yield

    def gone():
        raise Py4JNetworkError("gone")

    hits, r = "query_id long, chunk_id long, score double, rank int", Registry()
    for name, f in (("lost", lost), ("raises", raises)):
        r.register(Tool(name, lambda q, k, f=f: q.select("query_id").mapInPandas(f, hits)))
    asked = spark.createDataFrame([(1, "q")], "query_id long, question string")
    with pytest.raises(Py4JError):
        r.execute("lost", asked, 5)
    with pytest.raises(Py4JError):
        attempted(gone, 1, 30.0)
    out = r.execute("raises", asked, 5)
    assert (out.status, out.error_type) == ("failed", "internal") and "its own" in out.error
    with pytest.raises(Py4JError):
        agent.run(*tables(spark), "naive", reranker=lambda pairs: pairs.mapInPandas(lost, "query_id long, chunk_id long, raw double, error string"))
