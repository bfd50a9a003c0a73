"""Stable keys: ids by place, signatures by content, digests of settings."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: element_signature of a book without elements.
OF_NOTHING = hashlib.md5(b"[]").hexdigest()


def uid(kind: Column, resource: Column, key: Column) -> Column:
    """Where an element stands; its content plays no part."""
    return F.md5(F.concat_ws(":", F.lit("v2"), kind, resource, key.cast("string")).cast("binary"))


def signature(kind: Column, resource: Column, key: Column, raw: Column, original: Column) -> Column:
    """What an element holds, and where."""
    return F.md5(F.concat_ws("\x00", F.lit("v2"), kind, resource, key.cast("string"), raw, original).cast("binary"))


def uid_of(kind: str, resource: str, key: object) -> str:
    return hashlib.md5(f"v2:{kind}:{resource}:{key}".encode()).hexdigest()


def signature_of(kind: str, resource: str, key: object, raw: str, original: str) -> str:
    return hashlib.md5("\x00".join(["v2", kind, resource, str(key), raw, original]).encode()).hexdigest()


def element_signature(elements: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by..., element_signature): digest over a book's elements in order, of the JSON [[id, kind, page, signature], ...].

    Each element is digested text of under 200 bytes, so a book of a million of
    them is one value of 200 MB at most; that is the digest's definition.
    """
    item = F.to_json(F.array("id", "kind", "page", "signature"))
    one = F.struct(*order, item.alias("j"))
    whole = F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["j"]), ","), F.lit("]"))
    return elements.groupBy(*by).agg(F.md5(whole.cast("binary")).alias("element_signature"))


def canonical_json(value: object) -> str:
    """JSON with sorted keys, ", " and ": " between, and characters beyond ASCII as they are."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


def cache_key(settings: dict) -> str:
    """Key of a checkpoint: a digest of all settings that change its content."""
    return hashlib.md5(canonical_json(settings).encode()).hexdigest()
