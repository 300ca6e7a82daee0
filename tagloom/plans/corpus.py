"""Clean a folder of documents into a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.text import clean_text, default_stop_words
from tagloom.sources import folders
from tagloom.sources.readers import read_html_folder
from tagloom.sources.writers import write_documents


def cleaned(
    docs: DataFrame, id_col: str, text_col: str, stop_words: Sequence[str] | None = None
) -> DataFrame:
    """``(id, cleaned)``. Markup is not parsed: only its punctuation goes."""
    stop_words = default_stop_words() if stop_words is None else stop_words
    return docs.select(id_col, clean_text(F.col(text_col), stop_words).alias("cleaned"))


def clean_folder(
    spark: SparkSession, source: str, target: str, stop_words: Sequence[str] | None = None
) -> None:
    """Every ``*.html`` file of ``source`` as a row ``(file, cleaned)`` of the table ``target``."""
    write_documents(cleaned(read_html_folder(spark, source), "file", "text", stop_words), target)


def clean_folder_parts(
    spark: SparkSession,
    source: str,
    target: str,
    pattern: str = "*.html",
    recursive: bool = False,
    stop_words: Sequence[str] | None = None,
    task_bytes: int = folders.TASK_BYTES,
) -> None:
    """The same for folders of many small files, in tasks of like size; a second run leaves the same rows."""
    files = folders.read_packed(spark, source, pattern, recursive, task_bytes)
    folders.write_parts(cleaned(files, "file", "text", stop_words), target, "file")
