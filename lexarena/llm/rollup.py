"""Token totals kept by deltas: signed sums of inserts, deletes and revised counts, committed once per batch.

A batch is summed by source, language and tokenizer version and written as one folder of deltas; a row
in the ledger then commits it. Each try has a folder of its own, and totals read one committed try of each
batch: a try that died half way counts nothing, a batch that is applied again changes nothing, and of two
writers of one batch one counts.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("source", "lang", "tokenizer")


class TokenTotals:
    """Totals of documents and tokens by source, lang and tokenizer, kept in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def committed(self) -> DataFrame:
        """(batch, attempt) of every batch that was committed, with the try that counts."""
        try:
            ledger = self.spark.read.schema("batch string, attempt string").parquet(f"{self.path}/ledger")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            ledger = self.spark.createDataFrame([], "batch string, attempt string")  # no batch yet
        return ledger.groupBy("batch").agg(F.min("attempt").alias("attempt"))

    def _commit(self, batch: str, deltas: DataFrame) -> None:
        attempt = uuid.uuid4().hex
        deltas.write.parquet(f"{self.path}/deltas/{batch}/{attempt}")
        self.spark.createDataFrame([(batch, attempt)], "batch string, attempt string").coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit one batch of changes; False if it was committed before.

        changes: source, lang, tokenizer, change ('insert', 'delete' or 'revise'), n_tokens and, for a
        revision, old_tokens. Null keys are the level ''; null counts are 0; a null or other change is
        refused as a whole: the batch raises and commits nothing. Repeated rows count as often as they
        occur; extra columns are not read; an empty batch commits without deltas.
        """
        if not batch or "/" in batch:
            raise ValueError("a batch needs a name without '/'")
        if not self.committed().where(F.col("batch") == batch).isEmpty():
            return False
        sign = F.when(F.col("change") == "insert", 1).when(F.col("change") == "delete", -1).when(F.col("change") == "revise", 0)
        sign = F.coalesce(sign, F.raise_error(F.concat(F.lit("unknown change "), F.coalesce("change", F.lit("null")))).cast("int"))
        count = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
        tokens = F.when(F.col("change") == "revise", count("n_tokens") - count("old_tokens")).otherwise(sign * count("n_tokens"))
        keys = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in KEY]
        deltas = changes.groupBy(*keys).agg(F.sum(sign).cast("long").alias("docs"), F.sum(tokens).cast("long").alias("tokens"))
        self._commit(batch, deltas)
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens of the committed batches; keys that are back to 0 are left out.

        The names of the batches come to the driver, their rows don't.
        """
        names = sorted(f"{r['batch']}/{r['attempt']}" for r in self.committed().collect())
        if not names:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, docs long, tokens long")
        deltas = self.spark.read.schema("source string, lang string, tokenizer string, docs long, tokens long").parquet(*(f"{self.path}/deltas/{n}" for n in names))
        out = deltas.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return out.where("docs <> 0 OR tokens <> 0")

    def compact(self, name: str) -> bool:
        """Write the totals as one batch of another folder's first state, and return whether it was new there."""
        fresh = TokenTotals(self.spark, f"{self.path}-{name}")
        if not fresh.committed().where(F.col("batch") == name).isEmpty():
            return False
        fresh._commit(name, self.totals())
        return True


def n_pieces(text: Column) -> Column:
    """Runs of letters, runs of digits, and other single characters that are not white space."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"\p{L}+|\p{Nd}+|[^\p{L}\p{Nd}\x20\x09-\x0D]")).cast("long")
