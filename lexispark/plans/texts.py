"""What an index that isn't written yet takes from its documents' texts, when it is asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .invert import COUNT, OCCURRENCE, POSTING, flat_texts, inverter, lean
from .scratch import stored

#: So many searches of an index that isn't written read the texts for their terms; the next one writes all postings.
SCANS = 2


class Later:
    """A table that is made when it is first asked for."""

    def __init__(self, make: Callable[[], DataFrame]):
        self.make = make


class Texts:
    """Passes over the texts of documents (lang, doc_id, boost, indexed), each of them over all of them.

    The whole postings are one table, written once it is asked for. The terms counted, and the
    postings of the few terms of a query, need neither it nor any exchange of it.
    """

    def __init__(self, docs: DataFrame, fields: Iterable[str], langs: Iterable[str], normalise: bool = True, fallback: bool = False):
        self.by = inverter(fields, langs, normalise, fallback)
        self.flat = flat_texts(docs, self.by.fields)
        self.scratch: list[DataFrame] = []
        self.scans: list[tuple[str, frozenset[str], frozenset[str], DataFrame]] = []

    def _kept(self, rows: DataFrame, what: str) -> DataFrame:
        self.scratch.append(stored(rows, what))
        return self.scratch[-1]

    @cached_property
    def inverted(self) -> DataFrame:
        """POSTING rows of every term."""
        return self._kept(self.flat.mapInArrow(lean(self.by.run), POSTING), "inverted")

    @cached_property
    def _counts(self) -> DataFrame:
        rows = self.flat.mapInArrow(lean(self.by.counts), COUNT)
        return self._kept(rows.groupBy("lang", "term", "field").agg(F.sum("n").alias("n")), "counts")

    @cached_property
    def dictionary(self) -> DataFrame:
        """(lang, term, df)."""
        if "inverted" in self.__dict__:
            return self._kept(self.inverted.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("df")), "dictionary")
        return self._counts.where(F.col("term").isNotNull()).select("lang", "term", F.col("n").alias("df"))

    @property
    def occurrences(self) -> DataFrame:
        """OCCURRENCE rows of every term, which are written nowhere."""
        return self.flat.mapInArrow(lean(self.by.occurrences), OCCURRENCE)

    def lengths(self) -> DataFrame:
        """(lang, field, total): the words of each field, from whichever pass has been made."""
        if "_counts" not in self.__dict__ and "inverted" in self.__dict__:
            parts = self.inverted.select("lang", F.explode(F.arrays_zip(F.col("fields.field").alias("field"), F.col("fields.tf").alias("tf"))).alias("f"))
            return parts.groupBy("lang", F.col("f.field").alias("field")).agg(F.sum("f.tf").alias("total"))
        if "_counts" in self.__dict__:
            return self._counts.where(F.col("term").isNull()).select("lang", "field", F.col("n").alias("total"))
        if not self.scans:
            self.some("", [], [])
        rows = self.scans[0][3].where(F.col("term").isNull()).select("lang", F.explode("fields").alias("f"))
        return rows.groupBy("lang", F.col("f.field").alias("field")).agg(F.sum("f.tf").alias("total"))

    def some(self, lang: str, terms: Iterable[str], starts: Iterable[str]) -> DataFrame | None:
        """POSTING rows that hold those of some terms of a language, and others; None once whole postings are due."""
        exact, heads = frozenset(terms), frozenset(starts)
        if "inverted" in self.__dict__:
            return None
        for code, e, h, rows in self.scans:
            if code == lang and exact <= e and heads <= h:
                return rows
        if sum(bool(e or h) for _, e, h, _ in self.scans) >= SCANS:
            return None
        rows = self._kept(self.flat.mapInArrow(lean(self.by.found(lang, exact, tuple(sorted(heads)))), POSTING), "found")
        self.scans.append((lang, exact, heads, rows))
        return rows
