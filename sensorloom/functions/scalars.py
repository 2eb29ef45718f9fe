"""Scalar column functions: names, ids, paths, time units.

All are built-in expressions (codegen, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the reference naming rules.
STREAM_SUFFIXES = ("_raw", "_cleansed", "_imputed", "_normalized", "_processed")
CONNECTOR_PREFIX = "mongo-sink-"
IRI_BASE = "https://example.com/ids/"
DEFAULT_NS = "ns=2;s="
DEFAULT_DATATYPE = "String"
INTERNAL_TOPIC_PREFIXES = ("__", "agentic_ksql")
TOPIC_PATTERN = r"^([^.]+)\.(.+)\.(raw|processed)$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stream_base(topic) -> Column:
    """Topic -> stream base name: ``.`` and ``-`` become ``_``."""
    return F.translate(_c(topic), ".-", "__")


def stream_name(topic, suffix: str) -> Column:
    if suffix not in STREAM_SUFFIXES:
        raise ValueError(f"unknown stream suffix {suffix}")
    return F.concat(stream_base(topic), F.lit(suffix))


def connector_name(topic) -> Column:
    """Sink connector name: ``mongo-sink-`` + topic with ``.`` -> ``-``."""
    return F.concat(F.lit(CONNECTOR_PREFIX), F.replace(_c(topic), F.lit("."), F.lit("-")))


def topic_name(protocol, asset, stage) -> Column:
    """``<protocol>.<asset>.<raw|processed>``."""
    return F.concat_ws(".", _c(protocol), _c(asset), _c(stage))


def topic_parts(topic) -> dict[str, Column]:
    t = _c(topic)
    return {p: F.nullif(F.regexp_extract(t, TOPIC_PATTERN, i), F.lit("")) for i, p in
            ((1, "protocol"), (2, "asset"), (3, "stage"))}


def is_internal_topic(topic) -> Column:
    t = _c(topic)
    return t.startswith(INTERNAL_TOPIC_PREFIXES[0]) | t.startswith(INTERNAL_TOPIC_PREFIXES[1])


def b64url_id(iri) -> Column:
    """UTF-8 -> Base64 -> URL-safe alphabet, no padding.  Spark chunks
    Base64 output with CR/LF every 76 characters; those are removed."""
    b = F.base64(F.encode(_c(iri), "UTF-8"))
    return F.translate(b, "+/\r\n=", "-_")


def numeric_iri(hex16, is_submodel: bool | Column = True) -> Column:
    """``https://example.com/ids/{sm|aas}/dddd_dddd_dddd_dddd`` from 16 hex
    digits: each 4-digit group as an integer mod 10000, zero padded."""
    h = _c(hex16)
    groups = [F.lpad((F.conv(F.substring(h, 1 + 4 * i, 4), 16, 10).cast("int") % 10000).cast("string"), 4, "0")
              for i in range(4)]
    kind = (F.when(is_submodel, "sm").otherwise("aas") if isinstance(is_submodel, Column)
            else F.lit("sm" if is_submodel else "aas"))
    return F.concat(F.lit(IRI_BASE), kind, F.lit("/"), F.concat_ws("_", *groups))


def repeatable_numeric_iri(key, is_submodel: bool | Column = True) -> Column:
    """Same form from the first 16 hex digits of ``md5(key)`` (repeatable;
    the reference draws a random UUID)."""
    return numeric_iri(F.substring(F.md5(_c(key).cast("string")), 1, 16), is_submodel)


def safe_filename(name) -> Column:
    """Last ``/`` segment (trailing ``/`` ignored), characters outside
    ``[\\w\\-.]`` replaced by ``_``; empty -> ``unnamed``."""
    last = F.substring_index(F.regexp_replace(_c(name), "/+$", ""), "/", -1)
    return F.coalesce(F.nullif(F.regexp_replace(last, r"(?U)[^\w\-.]", "_"), F.lit("")), F.lit("unnamed"))


def node_path(path) -> Column:
    """Prefix ``ns=2;s=`` unless the path already names a namespace."""
    p = _c(path)
    return F.when(p.startswith("ns="), p).otherwise(F.concat(F.lit(DEFAULT_NS), p))


def node_topic(path, datatype=None) -> Column:
    dt = F.coalesce(_c(datatype), F.lit(DEFAULT_DATATYPE)) if datatype is not None else F.lit(DEFAULT_DATATYPE)
    return F.concat(node_path(path), F.lit(";datatype="), dt)


def display_name(path) -> Column:
    """Last ``/`` segment, then the part after the last ``=``."""
    return F.substring_index(F.substring_index(node_path(path), "/", -1), "=", -1)


def ms_to_seconds(ms) -> Column:
    """Whole seconds, truncated toward zero (``int(ms / 1000)``)."""
    m = _c(ms)
    return F.when(m >= 0, F.floor(m / 1000)).otherwise(F.ceil(m / 1000)).cast("long")
