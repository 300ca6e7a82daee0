"""Declared record schemas (fixed values: the field names of the input); nothing is inferred, so an all-digit identifier stays a string."""

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


APP_RECORD = _strings("appId", "package", "appName", "description")
TRAINING_RECORD = _strings("appId", "package", "appName", "description", "segment")
CORRUPT_COLUMN = "_corrupt_record"
