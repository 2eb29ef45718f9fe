"""Schemas of the data model (StructTypes)."""

from pyspark.sql import types as T

# The canonical reading: six nullable strings.  JSON numbers and booleans
# are kept as their text so one topic can carry mixed value types.
READING_FIELDS = ("source_type", "asset_id", "timestamp", "quality", "value", "unit")
READING = T.StructType([T.StructField(f, T.StringType(), True) for f in READING_FIELDS])

REVIEW_ISSUE = T.StructType([
    T.StructField("severity", T.StringType()),
    T.StructField("criterion", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("line_hint", T.StringType()),
    T.StructField("fix", T.StringType()),
])
REVIEW = T.StructType([
    T.StructField("approved", T.BooleanType()),
    T.StructField("summary", T.StringType()),
    T.StructField("issues", T.ArrayType(REVIEW_ISSUE)),
    T.StructField("strengths", T.ArrayType(T.StringType())),
])

PLAN = T.StructType([
    T.StructField("technology_lower", T.StringType()),
    T.StructField("clarification_questions", T.ArrayType(T.StringType())),
])
