"""Checks of names, ids, vectors and attributes, for driver-side values and for whole DataFrames."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import refuse

# Limits of the data model.
MAX_ID_BYTES = 256
MAX_DIM = 8192
MAX_ATTRS_UNITS = 65_536
MAX_BATCH_ROWS = 10_000
MAX_FETCH_IDS = 1_000
MAX_PAGE = 1_000
DEFAULT_PAGE = 100
MAX_TOP_K = 1_000
DEFAULT_TOP_K = 10
DEFAULT_NPROBE = 8
NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]{0,63}")


def check_name(name: object) -> str:
    if not isinstance(name, str) or not NAME.fullmatch(name):
        refuse(f"{name!r} is no name of a namespace; these match {NAME.pattern}")
    return name


def check_id(row_id: object) -> str:
    if not isinstance(row_id, str) or not row_id:
        refuse(f"{row_id!r} is no id; ids are text and not empty")
    if len(row_id.encode()) > MAX_ID_BYTES:
        refuse(f"an id takes {len(row_id.encode())} bytes in UTF-8; the limit is {MAX_ID_BYTES}")
    return row_id


def check_vector(vector: object, dim: int | None) -> list[float]:
    """The components rounded to float32; ``dim`` is the namespace's, or None before the first vector."""
    if isinstance(vector, np.ndarray):
        vector = vector.tolist()
    if not isinstance(vector, Sequence) or isinstance(vector, str) or not len(vector):
        refuse("a vector is missing or has no components")
    if not len(vector) <= MAX_DIM or len(vector) != (dim or len(vector)):
        refuse(wrong_size(len(vector), dim))
    for i, x in enumerate(vector):
        if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) or abs(x) >= 3.4028235677973366e38:
            refuse(f"component {i} of a vector is no finite float32: {x!r}")
    return np.asarray(vector, np.float32).astype(float).tolist()


def wrong_size(n: int, dim: int | None) -> str:
    return f"a vector of {n} components does not fit: " + (f"those of the namespace have {dim}" if dim else f"the limit is {MAX_DIM}")


def check_attributes(attributes: object) -> str | None:
    """Minified JSON of an object, or None."""
    if attributes is None:
        return None
    if not isinstance(attributes, dict):
        refuse(f"attributes are a JSON object, not {type(attributes).__name__}")
    try:
        text = json.dumps(attributes, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
    except (TypeError, ValueError) as e:
        refuse(f"attributes cannot be written as JSON: {e}")
    if len(text.encode("utf-16-le", "surrogatepass")) // 2 > MAX_ATTRS_UNITS:
        refuse(f"attributes take more than {MAX_ATTRS_UNITS} UTF-16 units as JSON")
    return text


def check_batch(rows: object, what: str = "rows", limit: int = MAX_BATCH_ROWS) -> list:
    if not isinstance(rows, (list, tuple)) or not rows:
        refuse(f"the request names no {what}")
    if len(rows) > limit:
        refuse(f"the request holds {len(rows)} {what}; the limit is {limit}")
    return list(rows)


def clamp_page(limit: object) -> int:
    """1 to 1000; nothing, zero or not a number means the default."""
    number = limit if isinstance(limit, (int, float)) and not isinstance(limit, bool) and limit == limit else 0
    return int(min(max(1, number or DEFAULT_PAGE), MAX_PAGE))


def clamp_top_k(top_k: object) -> int:
    if top_k is None:
        return DEFAULT_TOP_K
    if isinstance(top_k, bool) or not isinstance(top_k, (int, float)) or top_k != top_k:
        refuse(f"{top_k!r} cannot be a number of results")
    return int(min(max(1, top_k), MAX_TOP_K))


def clamp_nprobe(nprobe: object) -> int:
    """A whole number from 1 on; nothing means the default."""
    if nprobe is None:
        return DEFAULT_NPROBE
    if isinstance(nprobe, bool) or not isinstance(nprobe, (int, float)) or nprobe != nprobe:
        refuse(f"{nprobe!r} cannot be a number of clusters")
    return int(min(max(1, nprobe), 1 << 31))


def bad_row(dim: Column, allow_null_vector: bool = False) -> Column:
    """Message for a row (id, vector as float32, attrs as JSON text) that breaks a limit, else null."""
    size = F.size("vector")
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    parsed = F.try_parse_json("attrs")
    kind = F.schema_of_variant(parsed)
    units = F.octet_length(F.encode("attrs", "UTF-16LE")) / 2
    return (
        F.when(F.col("id").isNull() | (F.col("id") == ""), F.lit("an id is missing or empty"))
        .when(F.octet_length("id") > MAX_ID_BYTES, F.lit(f"an id takes more than {MAX_ID_BYTES} bytes in UTF-8"))
        .when(F.col("vector").isNull() | (size == 0), F.lit("a vector is missing or has no components"))
        .when(size > MAX_DIM, F.lit(f"a vector has more than {MAX_DIM} components"))
        .when(size != dim, F.lit("a vector is not as long as those of the namespace"))
        .when(~whole, F.lit("a component of a vector is no finite float32"))
        .when(F.col("attrs").isNotNull() & ~F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False)), F.lit("attributes are not a JSON object"))
        .when(units > MAX_ATTRS_UNITS, F.lit(f"attributes take more than {MAX_ATTRS_UNITS} UTF-16 units as JSON"))
    )
