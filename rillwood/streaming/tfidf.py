"""TF-IDF of documents as they come: document frequencies are a count-min table that grows with each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwood.functions.countmin import CountMin, document_cells, merge_cells, tfidf_counted

from .versions import Versioned


class StreamingTfidf(Versioned):
    """Weights in ``path``/weights, a folder a batch; a document is weighed by all that came up to its own batch's end."""

    columns = "row int, cell int, n long"

    def __init__(self, spark: SparkSession, path: str, key: str, text: str, settings: CountMin = CountMin(), **weighing):
        super().__init__(spark, path)
        self.key, self.text, self.settings, self.weighing = key, text, settings, weighing

    def fold(self, before: DataFrame, batch: DataFrame) -> DataFrame:
        return merge_cells(before, document_cells(batch, self.text, self.settings))

    def written(self, batch: DataFrame, batch_id: int, now: DataFrame) -> None:
        tfidf_counted(batch, self.key, self.text, now, self.settings, **self.weighing).write.mode("overwrite").parquet(f"{self.path}/weights/batch={batch_id}")

    def weights(self) -> DataFrame:
        """(key, term, tf, df, weight, batch) so far."""
        return self.spark.read.option("basePath", f"{self.path}/weights").parquet(f"{self.path}/weights")

    def estimated(self, terms: DataFrame, term: str) -> DataFrame:
        """``terms`` with the documents that each is in, by the table so far."""
        return self.settings.estimated(terms, F.col(term), self.state(), "n_docs")
