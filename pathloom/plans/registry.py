"""Registry of named queries and, where SQL can say the same thing, the SQL each one must agree with."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pathloom.operators.rounds import dealt

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
SUITES = (
    "scalar", "filters", "polylines", "quality", "selection", "account", "providers", "spatial",
    "paths", "transit", "search", "streams", "sinks",
)

Query = Callable[["Tables"], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one scale-factor directory."""

    def __init__(self, spark: SparkSession, directory: str) -> None:
        self.spark = spark
        self.directory = directory

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    def sql(self, text: str, **keys: str) -> DataFrame:
        """Run SQL over the tables; only the ones named in the text are opened, those given a key dealt by it."""
        used = {name: self[name] for name in TABLES if re.search(rf"\b{name}\b", text)}
        used |= {name: dealt(used[name], key) for name, key in keys.items()}
        for name in used:
            text = re.sub(rf"\b{name}\b", "{" + name + "}", text)
        return self.spark.sql(text, **used)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = function
        if oracle is not None:
            _ORACLES[name] = oracle
        return function

    return register


def _load() -> None:
    for suite in SUITES:
        importlib.import_module(f"pathloom.plans.{suite}")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(function: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, directory: function(Tables(spark, directory))

    return {name: bind(function) for name, function in _QUERIES.items()}


def all_oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
