"""Saving and loading of taggers and chunkers.

A model is a folder: ``metadata.json`` (kind, parameters, back-off) and Parquet
tables of its weights or dictionary. Kinds are looked up in a registry that
callers can extend.
"""

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

LOADERS: dict[str, Callable] = {}


def register(kind: str):
    """Adds a loader ``(spark, path, metadata) -> model`` under a kind."""

    def add(loader):
        LOADERS[kind] = loader
        return loader

    return add


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def save(spark: SparkSession, path: str, metadata: dict, tables: dict[str, DataFrame], backoff=None) -> None:
    """Writes a model; a back-off model goes into a folder of its own inside."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    _write_text(spark, f"{path}/metadata.json", json.dumps(metadata | {"backoff": backoff is not None}, sort_keys=True))
    if backoff is not None:
        backoff.save(spark, f"{path}/backoff")


def load(spark: SparkSession, path: str, loaders: dict[str, Callable] | None = None):
    """Reads the model at a path, with its back-off."""
    metadata = json.loads(spark.read.text(f"{path}/metadata.json").first()[0])
    table = LOADERS if loaders is None else loaders
    if metadata["kind"] not in table:
        raise ValueError(f"no loader for models of kind {metadata['kind']!r}")
    model = table[metadata["kind"]](spark, path, metadata)
    if metadata["backoff"]:
        model.backoff = load(spark, f"{path}/backoff", loaders)
    return model
