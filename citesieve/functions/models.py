"""Adapters that turn user-supplied models into Arrow-batched columns.

Every adapter takes a ``load`` function that builds the model; it runs once per Python worker
and task, not once per row. Results are marked non-deterministic so Spark never evaluates a
model twice for one reference; write or checkpoint them before reuse.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citesieve.functions.text import col

COMPLETION = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("completion", T.StringType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("error", T.StringType()),
    T.StructField("elapsed_seconds", T.DoubleType()),
])


class PairScorer:
    """``load()`` gives ``f(list_a, list_b) -> array [n, width]`` (or [n]): a classifier or a cross-encoder."""

    def __init__(self, load: Callable[[], Callable]):
        self.load = load

    def score(self, first, second) -> Column:
        """One array of scores per pair of texts; a null text is not scored."""
        load = self.load

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = load()
            for a, b in batches:
                wanted = np.flatnonzero((a.notna() & b.notna()).to_numpy())
                out = np.full(len(a), None, dtype=object)
                if len(wanted):
                    scores = np.asarray(model(a.iloc[wanted].tolist(), b.iloc[wanted].tolist()), dtype=float)
                    if len(scores) != len(wanted):
                        raise ValueError("The pair scorer returned a wrong number of rows")
                    for position, values in zip(wanted, scores.reshape(len(wanted), -1)):
                        out[position] = values
                yield pd.Series(out)

        return run.asNondeterministic()(col(first), col(second))

    def score_each(self, text, statements: list[str], skip) -> Column:
        """Score one text against a fixed list of statements; ``skip`` is an array of flags in list order.

        The batch is flattened to pairs for the model and folded back, so no row leaves its partition.
        """
        load = self.load

        @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = load()
            for texts, skips in batches:
                pairs = [(i, j) for i, (t, s) in enumerate(zip(texts, skips)) if t is not None
                         for j in range(len(statements)) if not s[j]]
                out = [None if t is None else [None] * len(statements) for t in texts]
                if pairs:
                    scores = np.asarray(model([texts.iloc[i] for i, _ in pairs], [statements[j] for _, j in pairs]))
                    if len(scores) != len(pairs):
                        raise ValueError("The pair scorer returned a wrong number of rows")
                    for (i, j), values in zip(pairs, scores):
                        out[i][j] = np.asarray(values, dtype=float).tolist()
                yield pd.Series(out, dtype=object)

        return run.asNondeterministic()(col(text), col(skip))


class Encoder:
    """``load()`` gives ``f(list_of_texts) -> array [n, dim]``."""

    def __init__(self, load: Callable[[], Callable], doc_prefix: str = "", query_prefix: str = "", batch: int = 32):
        self.load, self.doc_prefix, self.query_prefix, self.batch = load, doc_prefix, query_prefix, batch

    def _encode(self, text: Column, prefix: str) -> Column:
        load, batch = self.load, self.batch

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                values = texts.tolist()
                out = []
                for start in range(0, len(values), batch):
                    out.extend(np.asarray(model(values[start:start + batch]), dtype=np.float32))
                yield pd.Series(out, dtype=object)

        return run.asNondeterministic()(F.concat(F.lit(prefix), text))

    def encode_docs(self, text) -> Column:
        return self._encode(col(text), self.doc_prefix)

    def encode_queries(self, text) -> Column:
        return self._encode(col(text), self.query_prefix)


class SparseEncoder:
    """``load()`` gives ``f(list_of_texts) -> list of {term: weight}``."""

    def __init__(self, load: Callable[[], Callable], batch: int = 16):
        self.load, self.batch = load, batch

    def encode(self, text) -> Column:
        load, batch = self.load, self.batch

        @F.pandas_udf(T.MapType(T.StringType(), T.DoubleType()))
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                values = texts.tolist()
                out = []
                for start in range(0, len(values), batch):
                    out.extend(model(values[start:start + batch]))
                yield pd.Series(out, dtype=object)

        return run.asNondeterministic()(col(text))


class Completer:
    """``load()`` gives ``f(system, user, max_tokens)`` returning text, or a dict with the keys
    ``text``, ``completion`` (complete, output_limit, refused, incomplete), ``input_tokens`` and
    ``output_tokens``. A call that raises fills ``error`` of its row and harms no other row.
    ``name`` tells models and their versions apart where replies are kept for later runs.
    """

    def __init__(self, load: Callable[[], Callable], name: str = ""):
        self.load, self.name = load, name

    def complete(self, system, user, max_tokens) -> Column:
        load = self.load

        @F.pandas_udf(COMPLETION)
        def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            model = load()
            for systems, users, limits in batches:
                rows = []
                for one_system, one_user, limit in zip(systems, users, limits):
                    start = time.perf_counter()
                    row = {"completion": "complete"}
                    try:
                        reply = model(one_system, one_user, int(limit))
                        row.update(reply if isinstance(reply, dict) else {"text": reply})
                    except Exception as error:
                        row.update(error=str(error) or type(error).__name__, completion="error")
                    row["elapsed_seconds"] = time.perf_counter() - start
                    rows.append(row)
                yield pd.DataFrame({name: pd.Series([r.get(name) for r in rows], dtype=object)
                                    for name in COMPLETION.fieldNames()})

        return run.asNondeterministic()(col(system), col(user), F.lit(max_tokens) if isinstance(max_tokens, int) else max_tokens)


def text_function(function: Callable[[str], object], returns: str) -> Callable[[Column], Column]:
    """Turn a plain ``text -> value`` function (token counter, stemmer, splitter) into a column function."""

    @F.pandas_udf(returns)
    def run(texts: pd.Series) -> pd.Series:
        known: dict = {}
        return texts.map(lambda t: None if t is None else known[t] if t in known else known.setdefault(t, function(t)))

    return lambda c: run(col(c))
