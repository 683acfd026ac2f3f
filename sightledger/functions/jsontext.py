"""One JSON object out of reviewer text: clean text in the JVM, the rest by a bracket scan."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

_RESULT = T.StructType([T.StructField("payload", T.StringType()), T.StructField("error", T.StringType())])
_FENCED = r"(?s)^```[^\n]*\n(.*?)\s*```$"


def _closing(text: str, start: int) -> int:
    """Index after the bracket that closes the one at ``start``; -1 if none does. Brackets in strings do not count."""
    depth, quoted, at = 0, False, start
    while at < len(text):
        c = text[at]
        if quoted:
            at += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth == 0:
                return at + 1
        at += 1
    return -1


def embedded_object(text: str) -> tuple[str | None, str | None]:
    """(compact JSON, None) of the object at the first opening brace, or (None, error code)."""
    start = text.find("{")
    if start < 0:
        return None, "no_json_object"
    end = _closing(text, start)
    try:
        value = json.loads(text[start:end]) if end > 0 else None
    except ValueError:
        value = None
    if value is None:
        return None, "invalid_json"
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")), None


@F.pandas_udf(_RESULT)
def _scan(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if t is None else embedded_object(t) for t in text], columns=["payload", "error"])


def extract_json_object(text: Column | str) -> Column:
    """struct(payload, error) of a text: the object it is, fenced or not, or the first one inside it.

    Text that parses as a whole never leaves the JVM; other JSON values are ``not_an_object``. Only
    the remaining texts go to Python. Keys of the payload are sorted. Null has ``no_json_object``.
    """
    raw = F.trim(F.col(text) if isinstance(text, str) else text)
    inner = F.regexp_extract(raw, _FENCED, 1)
    body = F.when(F.startswith(raw, F.lit("```")) & (inner != ""), F.trim(inner)).otherwise(raw)
    whole = F.try_parse_json(body)
    scanned = _scan(F.when(whole.isNull(), body))
    is_object = F.startswith(F.schema_of_variant(whole), F.lit("OBJECT"))
    return (
        F.when(raw.isNull(), F.struct(F.lit(None).cast("string").alias("payload"), F.lit("no_json_object").alias("error")))
        .when(whole.isNotNull() & is_object, F.struct(F.to_json(whole).alias("payload"), F.lit(None).cast("string").alias("error")))
        .when(whole.isNotNull(), F.struct(F.lit(None).cast("string").alias("payload"), F.lit("not_an_object").alias("error")))
        .otherwise(F.struct(scanned["payload"].alias("payload"), scanned["error"].alias("error")))
    )
