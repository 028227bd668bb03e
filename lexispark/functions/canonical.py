"""Canonical JSON and content hashes."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(value) -> str:
    """Keys sorted at every level, no blanks, text not escaped beyond need."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def file_hash(content: str | bytes) -> str:
    return hashlib.sha256(content.encode() if isinstance(content, str) else content).hexdigest()[:8]


def document_hash(indexed: dict, stored: dict, metadata, language: str, boost: float) -> str:
    """Hash of what a document says; ids and URL are no part of it."""
    content = {"boost": boost, "indexedFields": indexed, "language": language, "metadata": metadata, "storedFields": stored}
    return "sha256:" + hashlib.sha256(canonical_json(content).encode()).hexdigest()


def content_hash(indexed: Column, stored: Column, metadata: Column, lang: Column, boost: Column) -> Column:
    @F.pandas_udf("string")
    def run(i: pd.Series, s: pd.Series, m: pd.Series, lang_: pd.Series, b: pd.Series) -> pd.Series:
        rows = zip(i, s, m, lang_, b)
        return pd.Series([document_hash(dict(x or {}), dict(y or {}), None if z is None else json.loads(z), w, int(v) if v == int(v) else v) for x, y, z, w, v in rows])

    return run(indexed, stored, metadata, lang, boost)
