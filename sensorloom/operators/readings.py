"""Readings preprocessing: cleansing -> imputation -> normalisation -> transformation.

Every step is a stateless projection/filter, so the whole chain fuses into
one whole-stage-codegen span with no shuffle, in batch and in streaming
alike.  Columns other than the six reading fields (keys, offsets, event
time) pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the reference chain.
DEG_TO_RAD = 0.0174533          # factor used by the transformation step
RAD_DIGITS = 6                  # rounding of the transformed value
BAD_QUALITY = "bad"
IMPUTED_QUALITY = "imputed"
IMPUTED_VALUE = "0.0"           # kept as text: the value column stays STRING
UNKNOWN = "unknown"

STEP_RAW = "raw stream registered"
STEP_CLEANSING = "cleansing applied"
STEP_IMPUTATION = "imputation applied"
STEP_NORMALIZATION = "normalization applied"
STEP_TRANSFORMATION = "transformation applied"
STEP_OUTPUT = "output stream created"


def _replace(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """Replace columns in place (keeps column order)."""
    return df.select(*[exprs[c].alias(c) if c in exprs else F.col(c) for c in df.columns])


def cleanse(df: DataFrame, source_schema: dict | None = None) -> DataFrame:
    """Keep ``quality != 'bad'``; NULL quality is dropped too (three-valued
    logic), plus ``field IS NOT NULL`` for every field of ``source_schema``."""
    cond = F.col("quality") != BAD_QUALITY
    for field in (source_schema or {}):
        cond = cond & F.col(field).isNotNull()
    return df.where(cond)


def null_checks(df: DataFrame, fields) -> DataFrame:
    """AND of ``field IS NOT NULL``; no-op for an empty field list."""
    fields = list(fields)
    if not fields:
        return df
    return df.where(reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in fields]))


def impute(df: DataFrame) -> DataFrame:
    return _replace(df, {
        "quality": F.coalesce(F.col("quality"), F.lit(IMPUTED_QUALITY)),
        "value": F.coalesce(F.col("value"), F.lit(IMPUTED_VALUE)),
        "unit": F.coalesce(F.col("unit"), F.lit(UNKNOWN)),
    })


def normalize(df: DataFrame) -> DataFrame:
    return _replace(df, {
        "source_type": F.coalesce(F.col("source_type"), F.lit(UNKNOWN)),
        "asset_id": F.coalesce(F.col("asset_id"), F.lit(UNKNOWN)),
    })


def value_num(value: Column | str = "value") -> Column:
    """Numeric view of the text value; text/boolean values give NULL."""
    v = F.col(value) if isinstance(value, str) else value
    return v.try_cast("double")


def to_radians(value: Column | str = "value", factor: float = DEG_TO_RAD,
               digits: int = RAD_DIGITS) -> Column:
    return F.round(value_num(value) * F.lit(factor), digits)


def transform(df: DataFrame, factor: float = DEG_TO_RAD, unit_filter: str | None = None) -> DataFrame:
    """``value`` -> ``value_deg`` (text) and ``value_rad`` (rounded double).

    Applied to every row like the reference; ``unit_filter`` optionally
    limits the conversion to one unit (other rows get NULL ``value_rad``)."""
    rad = to_radians("value", factor)
    if unit_filter is not None:
        rad = F.when(F.col("unit") == unit_filter, rad)
    out = []
    for c in df.columns:
        if c == "value":
            out += [F.col("value").alias("value_deg"), rad.alias("value_rad")]
        else:
            out.append(F.col(c))
    return df.select(*out)


@dataclass
class ChainResult:
    df: DataFrame
    steps: list[str]


def preprocess(df: DataFrame, *, cleansing: bool = False, imputation: bool = False,
               normalization: bool = False, transformation: bool = False,
               source_schema: dict | None = None) -> ChainResult:
    """The composed chain in its fixed order; each flag is independent.

    Returns the processed DataFrame and the list of applied steps."""
    steps = [STEP_RAW]
    if cleansing:
        df = cleanse(df, source_schema)
        steps.append(STEP_CLEANSING)
    if imputation:
        df = impute(df)
        steps.append(STEP_IMPUTATION)
    if normalization:
        df = normalize(df)
        steps.append(STEP_NORMALIZATION)
    if transformation:
        df = transform(df)
        steps.append(STEP_TRANSFORMATION)
    else:
        steps.append(STEP_OUTPUT)
    return ChainResult(df, steps)


def preprocess_by_flags(readings: DataFrame, flags: DataFrame, key: str = "asset_id",
                        eager_size_check: bool = False) -> DataFrame:
    """Per-asset chain: each asset's flags choose its steps, one plan for all.

    ``flags`` has ``key, cleansing, imputation, normalize, transformation``
    (booleans; NULL = off).  Only readings of configured assets flow.

    Join strategy: by default AQE decides at run time from the measured size
    of the flags side (broadcast below the adaptive threshold, otherwise a
    sort-merge join whose skewed asset partitions AQE splits); no extra pass
    is spent on a derived flags table.  ``eager_size_check=True`` instead
    counts a small base table up front (``join_small``)."""
    from .joins import join_small

    f = flags.select(key, *[F.coalesce(F.col(c), F.lit(False)).alias(f"_f_{c}")
                            for c in ("cleansing", "imputation", "normalize", "transformation")])
    j = join_small(readings, f, key, "inner") if eager_size_check else readings.join(f, key, "inner")
    on = {c: F.col(f"_f_{c}") for c in ("cleansing", "imputation", "normalize", "transformation")}
    j = j.where(~on["cleansing"] | (F.col("quality") != BAD_QUALITY))
    imp = on["imputation"]
    j = _replace(j, {
        "quality": F.when(imp, F.coalesce(F.col("quality"), F.lit(IMPUTED_QUALITY))).otherwise(F.col("quality")),
        "value": F.when(imp, F.coalesce(F.col("value"), F.lit(IMPUTED_VALUE))).otherwise(F.col("value")),
        "unit": F.when(imp, F.coalesce(F.col("unit"), F.lit(UNKNOWN))).otherwise(F.col("unit")),
        "source_type": F.when(on["normalize"], F.coalesce(F.col("source_type"), F.lit(UNKNOWN)))
                        .otherwise(F.col("source_type")),
    })
    j = j.withColumn("value_rad", F.when(on["transformation"], to_radians("value")))
    return j.drop(*[f"_f_{c}" for c in on])


def unassigned(readings: DataFrame, flags: DataFrame, key: str = "asset_id") -> DataFrame:
    """Readings that ``preprocess_by_flags`` leaves out: NULL key, or a key without flags."""
    return readings.join(flags.select(key), key, "left_anti").select(*readings.columns)
