"""Extension points: tools, encoders and rerankers are functions of DataFrames or of Arrow batches, registered by name."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import settled


@dataclass
class Tool:
    """queries (query_id, question), k -> hits (query_id, chunk_id, score, rank)."""

    name: str
    run: Callable[[DataFrame, int], DataFrame]
    description: str = ""
    max_results: int = 20
    max_retries: int = 1
    timeout_seconds: float = 30.0
    #: Whether a failure is the outcome of its calls; else it ends the job, for without its hits there is no result.
    isolated: bool = True


@dataclass
class Outcome:
    status: str
    attempts: int
    hits: DataFrame | None = None
    error: str | None = None
    error_type: str | None = None
    retryable: bool = False


@dataclass
class Registry:
    """Tools by name. A run materialises its hits, so that failures and the time it took show at once."""

    tools: dict[str, Tool] = field(default_factory=dict)

    def register(self, tool: Tool) -> None:
        if tool.name in self.tools:
            raise ValueError(f"{tool.name} is registered already")
        self.tools[tool.name] = tool

    def execute(self, name: str, queries: DataFrame, k: int) -> Outcome:
        """Invalid calls are not attempted; timeouts and lost connections are tried again; a late result counts as a timeout. What a tool that is not isolated raises is raised."""
        tool = self.tools.get(name)
        if tool is None or not 1 <= k <= 100:
            said = f"no tool {name}" if tool is None else "k must be 1 to 100"
            if tool is not None and not tool.isolated:
                raise ValueError(said)
            return Outcome("failed", 0, error=said, error_type="validation")
        if not tool.isolated:
            return Outcome("completed", 1, settled(tool.run(queries, min(k, tool.max_results))))
        hits, call = attempted(lambda: [settled(tool.run(queries, min(k, tool.max_results)))], tool.max_retries, tool.timeout_seconds)
        return Outcome(call[0], call[1], hits[0] if hits else None, *call[2:])


#: What a call of a tool for one question came to.
CALL = "status string, attempts int, error string, error_type string, retryable boolean"


def attempted(function: Callable[[], list], max_retries: int, timeout_seconds: float) -> tuple[list, tuple]:
    """A call's results and its CALL: timeouts and lost connections are tried again, a late result counts as a timeout, other errors end it.

    A Spark job that was lost (memory, disk, executors) is no outcome of a call: it is raised. What a tool's own Python raises inside a task is the tool's.
    """
    for attempt in range(1, max_retries + 2):
        began = time.monotonic()
        try:
            found = list(function())
            if time.monotonic() - began > timeout_seconds:
                raise TimeoutError(f"took more than {timeout_seconds} s")
            return found, ("completed", attempt, None, None, False)
        except TimeoutError as problem:
            last = ("failed", attempt, str(problem)[:500], "timeout", True)
        except ConnectionError as problem:
            last = ("failed", attempt, str(problem)[:500], "connection", True)
        except Py4JError:
            raise
        except Exception as problem:  # whatever a tool raises is its outcome
            return [], ("failed", attempt, str(problem)[:500], "internal", False)
    return [], last


def per_question(name: str, load: Callable[[], Callable[[str, int], list[tuple]]], key: str = "long", max_retries: int = 1, timeout_seconds: float = 30.0, **more) -> Tool:
    """A tool of a Python function: question, k -> (chunk_id, score, source_id, content) of its hits, best first.

    Each question is a call of its own: its errors are caught where it runs and come back as its row, so that other questions
    of the table keep their hits. load makes the function once in each task. key: the type of chunk_id.
    """

    def run(queries: DataFrame, k: int) -> DataFrame:
        def ask(batches):
            function = load()
            for b in batches:
                rows = []
                for query_id, question in zip(b["query_id"], b["question"], strict=True):
                    found, call = attempted(lambda q=question: function(q, k), max_retries, timeout_seconds)
                    rows += [(query_id, *hit, i, *call) for i, hit in enumerate(found[:k], 1)] or [(query_id, None, None, None, None, 0, *call)]
                yield pd.DataFrame(rows, columns=["query_id", "chunk_id", "score", "source_id", "content", "rank", "status", "attempts", "error", "error_type", "retryable"], dtype=object)

        id_type = queries.schema["query_id"].dataType.simpleString()
        return queries.select("query_id", "question").mapInPandas(ask, f"query_id {id_type}, chunk_id {key}, score double, source_id string, content string, rank int, {CALL}")

    return Tool(name, run, max_retries=0, **more)


def encoder(load: Callable[[], Callable[[list[str]], list[list[float]]]], dimensions: int, prefix: str = "passage: "):
    """A Column function from text to vector. load makes a model once in each worker; its vectors must have that many dimensions."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            vectors = model([prefix + t for t in texts])
            if any(len(v) != dimensions for v in vectors):
                raise ValueError(f"the model's vectors don't have {dimensions} dimensions")
            yield pd.Series(vectors)

    return encode


def reranker(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]):
    """hits with question and content -> query_id, chunk_id, raw and error, by a model loaded once in each task.

    A question's hits are scored together; where that fails they have no score and the error. A question's hits are few: pools of tools.
    """

    def run(hits: DataFrame) -> DataFrame:
        kind = lambda c: hits.schema[c].dataType.simpleString()
        held: list = []

        def score(rows: pd.DataFrame) -> pd.DataFrame:
            raw, error = [None] * len(rows), None
            try:
                if not held:
                    held.append(load())
                raw = [float(s) for s in held[0](list(zip(rows["question"], rows["content"], strict=True)))]
                if len(raw) != len(rows):
                    raise ValueError("the model gave another number of scores")
            except Exception as problem:  # a question whose reranking fails keeps its order
                raw, error = [None] * len(rows), str(problem)[:500]
            return pd.DataFrame({"query_id": rows["query_id"], "chunk_id": rows["chunk_id"], "raw": pd.Series(raw, index=rows.index, dtype="float64"), "error": error})

        return hits.groupBy("query_id").applyInPandas(score, f"query_id {kind('query_id')}, chunk_id {kind('chunk_id')}, raw double, error string")

    return run
