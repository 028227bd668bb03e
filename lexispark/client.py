"""A client of one index, whichever way it is stored."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import SparkSession

from .operators.search import Facet, Hit, Options, Result, Searcher
from .plans import store
from .plans.index import LexicalIndex
from .sources import shards


class SearchClient:
    """``index`` is a LexicalIndex, the folder of a saved one, or the URL or path of
    exported JSON shards (a manifest.json, or ``form="json"``)."""

    def __init__(self, spark: SparkSession, index: LexicalIndex | str, form: str | None = None, cross_origin: bool = False, strict: bool = False, cache: bool = True):
        if isinstance(index, str):
            as_json = form == "json" or (form is None and index.endswith("manifest.json"))
            index = shards.load(spark, index, cross_origin, strict) if as_json else store.load(spark, index)
        self.index = index.cache() if cache else index
        self.searcher = Searcher(self.index)

    def search(self, query: str, options: Options | None = None, **how: Any) -> Result:
        return self.searcher.search(query, options or Options(**how))

    def search_stream(self, query: str, options: Options | None = None, **how: Any) -> Iterator[Result]:
        return self.searcher.stream(query, options or Options(**how))

    def facet_values(self, field: str, filters: dict[str, Any] | None = None) -> Facet:
        return self.searcher.facet_values(field, filters)

    def get_documents(self, ids: Iterable[int]) -> list[Hit]:
        return self.searcher.get_documents(list(ids))

    def retrieve(self, ids: Iterable[int]) -> list[Hit]:
        warnings.warn("retrieve is called get_documents now", DeprecationWarning, stacklevel=2)
        return self.get_documents(ids)

    def close(self) -> None:
        """Drop what is cached of the index."""
        for name in store.TABLES:
            df = getattr(self.index, name)
            if df is not None:
                df.unpersist()
