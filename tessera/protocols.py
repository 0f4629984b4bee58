"""What can be plugged in: strategies, tools, connectors, stores, validators; and the registry and cache that hold them."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame


@dataclass
class Answer:
    """Rows with the confidence of the strategy that found them."""

    rows: DataFrame | None
    confidence: float = 0.0
    sql: str = ""
    found: int | None = None
    notes: dict = field(default_factory=dict)

    def is_miss(self) -> bool:
        """Nothing found with little confidence, or SQL that selects no variable of use."""
        return self.rows is None or (self.found == 0 and self.confidence < 0.3) or "uselessVariable" in self.sql


@runtime_checkable
class Strategy(Protocol):
    name: str

    def resolve(self, query: str, namespace: str, context: dict) -> Answer: ...


@runtime_checkable
class Tool(Protocol):
    name: str
    schema: dict

    def invoke(self, **arguments: Any) -> DataFrame: ...


@runtime_checkable
class Connector(Protocol):
    def test_connection(self) -> bool: ...

    def discover_metadata(self) -> DataFrame: ...


@runtime_checkable
class GraphStore(Protocol):
    def triples(self, graph: str) -> DataFrame: ...

    def store(self, rows: DataFrame) -> None: ...

    def search(self, text: str) -> DataFrame: ...


@runtime_checkable
class VectorStore(Protocol):
    def store(self, rows: DataFrame) -> None: ...

    def search_nearest(self, vector: list[float], k: int) -> DataFrame: ...


@runtime_checkable
class LexicalStore(Protocol):
    def class_nodes(self) -> DataFrame: ...

    def class_relations(self) -> DataFrame: ...

    def facts(self, entities: DataFrame) -> DataFrame: ...


@runtime_checkable
class Induction(Protocol):
    def induce(self, tables: DataFrame) -> DataFrame: ...


@runtime_checkable
class Validator(Protocol):
    def validate(self, graph: DataFrame) -> DataFrame: ...


class Registry:
    """Named plug-ins of one protocol."""

    def __init__(self, kind: type):
        self.kind, self.held = kind, {}

    def add(self, item) -> None:
        if not isinstance(item, self.kind):
            raise TypeError(f"{item!r} is no {self.kind.__name__}")
        if item.name in self.held:
            raise ValueError(f"{item.name} is registered twice")
        self.held[item.name] = item

    def get(self, name: str):
        return self.held[name]

    def names(self) -> list[str]:
        return sorted(self.held)


def first_answer(strategies: list[Strategy], query: str, namespace: str = "", context: dict | None = None) -> tuple[str, Answer] | None:
    """The first strategy's answer that is no miss."""
    for s in strategies:
        a = s.resolve(query, namespace, context or {})
        if not a.is_miss():
            return s.name, a
    return None


def best_answer(strategies: list[Strategy], query: str, namespace: str = "", context: dict | None = None, seconds: float = 90.0) -> tuple[str, Answer] | None:
    """All strategies at once, as concurrent Spark jobs; of those in time the one of highest precedence (their order),
    then of highest confidence."""
    pool = ThreadPoolExecutor(max_workers=max(1, len(strategies)))
    try:
        jobs = {pool.submit(s.resolve, query, namespace, dict(context or {})): i for i, s in enumerate(strategies)}
        done, _ = wait(jobs, timeout=seconds)
        answers = [(jobs[f], f.result()) for f in done if f.exception() is None]
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
    good = sorted(((i, -a.confidence, a) for i, a in answers if not a.is_miss()), key=lambda x: x[:2])
    return (strategies[good[0][0]].name, good[0][2]) if good else None


class TtlCache:
    """The most recently used entries, each for a limited time."""

    def __init__(self, size: int = 128, seconds: float = 120.0, clock: Callable[[], float] = time.monotonic):
        self.size, self.seconds, self.clock = size, seconds, clock
        self.held: OrderedDict = OrderedDict()
        self.lock = threading.Lock()

    def get(self, key, make: Callable[[], Any]):
        with self.lock:
            if key in self.held and self.clock() - self.held[key][0] < self.seconds:
                self.held.move_to_end(key)
                return self.held[key][1]
        value = make()
        with self.lock:
            self.held[key] = (self.clock(), value)
            self.held.move_to_end(key)
            while len(self.held) > self.size:
                self.held.popitem(last=False)
        return value
