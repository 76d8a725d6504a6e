"""Conflict resolution as an interface: what a resolver decides for a symbol, or for all at once, and the rows that follow.

A resolver of symbols sees one symbol at a time with each agent's predictions as an iterator; symbols stream through partitions that are
sorted by key, so nothing is held for a symbol but what the resolver keeps. A resolver of tables gets each agent's predictions for all
symbols of the reference, nulls where there is none. Either way each symbol of the reference has exactly one row: symbols that get no answer
stay, unresolved, with the methods that took part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import SELECT_KEY
from ..shipping import ship
from .resolve import DEFAULT_ORDER
from .select import assert_unique, first_per

RESOLVED = "anno string, method string"


@dataclass(frozen=True)
class Prediction:
    agent: str
    anno: str | None
    method: str
    topn: int


class SymbolResolver(Protocol):
    """Decides symbol by symbol, on the executors."""

    def forward(self, symbol: tuple, predictions: Iterator[Prediction]) -> tuple[str | None, str] | None:
        """Annotation and method for a symbol (the values of its keys), or None for no answer. Predictions come by agent, in the order of agents,
        each agent's by rank, null annotations too; they can be read once."""


class TableResolver(Protocol):
    """Decides all symbols by operations on tables."""

    def forward(self, agents: dict[str, DataFrame]) -> DataFrame:
        """Keys, anno and method of the symbols that it has an answer for. agents: per agent the keys, anno, method and topn of its predictions, a row of
        nulls for a symbol that it has none for."""


def tagged(agents: dict[str, DataFrame]) -> DataFrame:
    """The predictions of all agents in one table, with their agent."""
    frames = [df.withColumn("agent", F.lit(name)) for name, df in agents.items()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def by_symbol(resolver: SymbolResolver, predictions: DataFrame, reference: DataFrame, order: tuple[str, ...] = DEFAULT_ORDER, ties: tuple[str, ...] = (), keys: list[str] = SELECT_KEY) -> DataFrame:
    """predictions: keys, agent, anno, method, topn. reference: keys; a symbol that stands twice in it is an error. Predictions for
    symbols that it lacks don't count, and of several of an agent with one rank `ties` tell the order. Keys, anno, method."""
    ship(reference.sparkSession)
    rank = F.coalesce(*(F.when(F.col("agent") == a, k) for k, a in enumerate(order)))
    said = predictions.withColumn("__rank", rank).filter("__rank is not null").select(*keys, "__rank", "topn", *(t for t in ties if t not in ("anno", "method")), "anno", "method")
    symbols = reference.select(*keys, F.lit(-1).alias("__rank"))
    n = int(reference.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = symbols.unionByName(said, allowMissingColumns=True).repartition(n, *keys).sortWithinPartitions(*keys, "__rank", "topn", *ties).select(*keys, "__rank", "topn", "anno", "method")
    k = len(keys)

    def stream(batches):
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def over(batches):
        import pyarrow as pa

        out = []
        for key, own in groupby(stream(batches), lambda r: r[:k]):
            first = next(own)
            if first[k] >= 0:  # not in the reference
                continue
            present: dict[str, str] = {}

            def predictions_of(key=key, own=own, present=present):
                for r in own:
                    if r[k] < 0:
                        raise ValueError(f"a symbol stands twice in the reference: {key}")
                    present.setdefault(order[r[k]], r[k + 3] or order[r[k]])
                    yield Prediction(order[r[k]], r[k + 2], r[k + 3], r[k + 1])

            left = predictions_of()
            answer = resolver.forward(key, left)
            for _ in left:  # the rest of the symbol's rows
                pass
            out.append((*key, *(answer if answer is not None else (None, "+".join(present.values())))))
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructField, StructType

    kinds = StructType([*(reference.schema[c] for c in keys), StructField("anno", StringType()), StructField("method", StringType())])
    names, schema = kinds.names, to_arrow_schema(kinds)
    return rows.mapInArrow(over, kinds)


def by_table(resolver: TableResolver, agents: dict[str, DataFrame], reference: DataFrame, keys: list[str] = SELECT_KEY) -> DataFrame:
    """agents: predictions by agent; one that is missing has none. Keys, anno, method: the resolver's answers, of several for a symbol the first
    by method and annotation, and unresolved rows for all other symbols, with the agents' methods joined by +."""
    symbols = reference.select(*keys)
    aligned = {a: df.select(*keys, "anno", "method", "topn").join(symbols, keys, "right") for a, df in agents.items()}
    answers = first_per(resolver.forward(aligned).select(*keys, "anno", "method"), keys, "method", "anno").withColumn("__answer", F.lit(True))
    names = "+".join(agents)
    out = symbols.join(answers, keys, "left").withColumn("method", F.when(F.col("__answer"), F.col("method")).otherwise(names)).drop("__answer")
    return assert_unique(out, keys)


class FirstOf:
    """Delegation as a resolver of symbols: the first agent's first annotation."""

    def forward(self, symbol, predictions):
        return next(((p.anno, p.agent) for p in predictions if p.anno is not None), None)


class Agreement:
    """The annotation that the agents' first predictions agree on, if at least `votes` agents have one."""

    def __init__(self, votes: int = 2):
        self.votes = votes

    def forward(self, symbol, predictions):
        best: dict[str, str] = {}
        for p in predictions:
            if p.anno is not None:
                best.setdefault(p.agent, p.anno)
        if len(best) < self.votes or len(set(best.values())) > 1:
            return None
        return next(iter(best.values())), "+".join(best)
