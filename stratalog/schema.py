"""The change log: one row per write, and what a key or value may be."""

from __future__ import annotations

from pyspark.sql import types as T

CHANGE_LOG = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("version", T.LongType()),
    T.StructField("tombstone", T.BooleanType()), T.StructField("value", T.StringType()),
])
#: The change log as it lies in runs: where a record came from decides between two of the same key and version.
RUN_LOG = T.StructType([*CHANGE_LOG.fields, T.StructField("level", T.IntegerType()), T.StructField("seq", T.LongType())])

#: The greatest size of a key and of a value in UTF-8 bytes, and the version that means "now".
MAX_KEY_BYTES, MAX_VALUE_BYTES, NEWEST = 10 << 20, 100 << 20, 2**63 - 1


def utf8_size(text: str) -> int:
    """Bytes of the text; a text with an unpaired surrogate has none and is refused."""
    try:
        return len(text.encode("utf-8"))
    except UnicodeEncodeError as e:
        raise ValueError("text with an unpaired surrogate can't be stored") from e


def check_key(key: str | None) -> str:
    if not isinstance(key, str):
        raise ValueError("a key must be a string")
    if utf8_size(key) > MAX_KEY_BYTES:
        raise ValueError("key too long")
    return key


def check_value(value: str | None) -> str:
    if not isinstance(value, str):
        raise ValueError("a value must be a string")
    if utf8_size(value) > MAX_VALUE_BYTES:
        raise ValueError("value too long")
    return value


def check_bound(bound: str | None) -> str | None:
    return None if bound is None else check_key(bound)
