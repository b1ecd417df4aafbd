"""Functions of this package for use in SQL text: the table function chunk_text and scalar functions in its columns."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="piece int, words int, text string")
class ChunkText:
    """The pieces of at most ``most`` words of a text, numbered from 0, words set apart by one blank. A null text has none, one without words an empty one."""

    def eval(self, text: str | None, most: int) -> Iterator[tuple[int, int, str]]:
        if text is None:
            return
        words = text.split()
        for k, at in enumerate(range(0, max(1, len(words)), most)):
            part = words[at : at + most]
            yield k, len(part), " ".join(part)


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session's SQL."""
    spark.udtf.register("chunk_text", ChunkText)
    spark.sql("create or replace temporary function plain_numbers(t string) returns string return regexp_replace(regexp_replace(t, '(?<=[0-9]),(?=[0-9]{3})', ''), '(?<=[0-9]),(?=[0-9]{2})', '')")
    spark.sql("create or replace temporary function percent(t string) returns string return if(t rlike '^[0-9]+([.][0-9]+)?$', concat(t, '%'), t)")
