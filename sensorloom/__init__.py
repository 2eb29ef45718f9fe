"""sensorloom: industrial readings and asset-model operators on PySpark.

Every operator is a ``DataFrame -> DataFrame`` function built from
``pyspark.sql.functions`` so Catalyst can push filters into the scans,
prune columns and fuse the steps into one whole-stage-codegen span.
"""

__version__ = "0.1.0"
