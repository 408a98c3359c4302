"""Scores under names that SQL can use: scalar functions, and a table function whose scorers are chosen by name."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tallymill.functions import ratios

#: What a scorer is called.
SCORERS = {"token_sort": ratios.token_sort, "token_set": ratios.token_set, "sequence": ratios.sequence}
_COLUMNS = {"token_sort_ratio": ratios.token_sort_ratio, "token_set_ratio": ratios.token_set_ratio, "sequence_ratio": ratios.sequence_ratio}


class _Scores:
    def eval(self, scorers: str, a: str, b: str) -> Iterator[tuple[str, float]]:
        """A row for each of the scorers, named with commas between them; none for a null, and an error for a name that there isn't."""
        for name in (scorers or "").split(","):
            score = SCORERS[name.strip()]
            if a is not None and b is not None:
                yield name.strip(), score(a, b)


def register(spark: SparkSession) -> None:
    """For this session: token_sort_ratio(a, b), token_set_ratio(a, b), sequence_ratio(a, b), and the table function text_scores(scorers, a, b) with (scorer, score)."""
    for name, function in _COLUMNS.items():
        spark.udf.register(name, function)
    spark.udtf.register("text_scores", udtf(_Scores, returnType="scorer string, score double"))
