"""Extractors by language: a source file goes to the one that is registered for its language."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from importlib import metadata

import pandas as pd
from pyspark.sql import DataFrame

from factweave.extract import python

#: Function of (file_path, module_name, content) that gives (relation, fact) pairs.
Extractor = Callable[[str, str, str], list[tuple[str, dict]]]
EXTRACTORS: dict[str, Extractor] = {"python": python.facts_of}
#: Group under which other packages name their extractors.
GROUP = "factweave.extractors"


def register(language: str, extractor: Extractor) -> None:
    EXTRACTORS[language] = extractor


def discovered() -> dict[str, Extractor]:
    """Registered extractors, and those that installed packages name; the registered ones win."""
    return {e.name: e.load() for e in metadata.entry_points(group=GROUP)} | EXTRACTORS


def extracted(files: DataFrame, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """relation and fact (JSON) of every file (file_path, module_name, content, language); languages without an extractor give an `error` row."""
    known = dict(extractors or discovered())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for row in part.itertuples(index=False):
                of = known.get(row.language)
                facts = of(row.file_path, row.module_name, row.content or "") if of else [("error", {"file_path": row.file_path, "message": f"no extractor for {row.language}"})]
                rows += [(r, json.dumps(f)) for r, f in facts]
            yield pd.DataFrame(rows, columns=["relation", "fact"])

    return files.select("file_path", "module_name", "content", "language").mapInPandas(run, "relation string, fact string")
