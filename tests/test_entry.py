"""The entry module imports without Spark's jars and without starting a session."""

import os
import subprocess
import sys

from pyspark.ml.feature import StopWordsRemover

from tagloom.functions.stopwords import ENGLISH

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

NO_JARS = """
import builtins, glob, zipfile
def refused(*args, **kwargs):
    raise AssertionError("no jar, zip or folder listing at import")
zipfile.ZipFile.__init__ = refused
glob.glob = refused
import __spark_entry__ as entry
assert len(entry.queries()) >= 57 and len(entry.oracle_sql()) >= 54
from pyspark import SparkContext
assert SparkContext._active_spark_context is None
"""


def test_entry_imports_without_jars():
    env = os.environ | {"SPARK_HOME": "/nonexistent", "PYTHONPATH": ROOT}
    subprocess.run([sys.executable, "-c", NO_JARS], cwd=ROOT, env=env, check=True, timeout=120)


def test_stop_words_are_sparks(spark):
    assert list(ENGLISH) == list(StopWordsRemover.loadDefaultStopWords("english"))
