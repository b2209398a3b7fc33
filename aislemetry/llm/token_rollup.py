"""Token counts as delta-maintained rollups.

Totals per source, language and tokenizer version are additive, so they never need the corpus again: a change is a set
of signed rows (documents and tokens). A batch is summed per key and written below `ledger/batch=<id>`, which replaces
what an earlier attempt of the same batch left; a batch that is already there is not applied again. Totals are the
sums over the ledger; `compact` folds old batches into one.

* insert: the rows of the documents, positive; delete: the same, negative;
* revise: old counts negative and new counts positive, whatever the tokenizer versions are.

Defined results: null and empty texts count as documents of zero tokens; repeated rows count each; a null source or
language is a key of its own; keys whose totals are zero documents leave the report; empty tables give no rows.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "version")

#: Tokenizer versions: words between blanks; runs of ASCII letters and digits with single other marks.
VERSIONS: dict[str, Callable[[Column], Column]] = {
    "words-1": lambda text: F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")),
    "pieces-2": lambda text: F.regexp_count(text, F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]")),
}


def measured(docs: DataFrame, versions=tuple(VERSIONS), keep=(), text="text") -> DataFrame:
    """source, lang, kept columns and n: tokens by tokenizer version. All that deltas need; texts stay behind."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select("source", "lang", *keep, F.create_map(*[x for v in versions for x in (
        F.lit(v), VERSIONS[v](body).cast("long"))]).alias("n"))


def signed(numbers: DataFrame, version, sign=1) -> DataFrame:
    """Signed rows (source, lang, version, n_docs, n_tokens) of measured documents; `version` may be a column."""
    version = F.lit(version) if isinstance(version, str) else version
    return numbers.select("source", "lang", version.alias("version"), F.lit(sign).cast("long").alias("n_docs"),
                          (F.lit(sign) * F.element_at("n", version)).cast("long").alias("n_tokens"))


def counts(docs: DataFrame, version: str, sign=1, text="text") -> DataFrame:
    """Signed rows of documents under one tokenizer version."""
    return signed(measured(docs, (version,), text=text), version, sign)


def moved(numbers: DataFrame, old: str, new: str) -> DataFrame:
    """Signed rows that move measured documents from one tokenizer version to another."""
    return signed(numbers, old, -1).unionByName(signed(numbers, new, 1))


def revised(docs: DataFrame, old: str, new: str, text="text") -> DataFrame:
    """`moved` for documents that are not measured yet."""
    return moved(measured(docs, (old, new), text=text), old, new)


def added(deltas: DataFrame) -> DataFrame:
    """Sums per key; combined before the shuffle, so a hot key is a few rows per task."""
    return deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


_SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long"


class Ledger:
    """Committed batches below a shared folder that Spark reads and writes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, batch: str) -> str:
        if not batch or not all(c.isalnum() or c in "-_." for c in batch):
            raise ValueError(f"batch id {batch!r} is not a plain name")
        return f"{self.folder}/ledger/batch={batch}"

    def _complete(self, batch: str) -> bool:
        """Whether the writer's success mark is there; a batch of a lost job has none."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._path(batch)}/_SUCCESS")
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Apply a batch once; False if it was there already."""
        if self._complete(batch):
            return False
        added(deltas).write.mode("overwrite").parquet(self._path(batch))
        return True

    def totals(self, batches: list[str]) -> DataFrame:
        """Totals over the named batches."""
        rows = self.spark.createDataFrame([], _SCHEMA)
        for batch in dict.fromkeys(batches):
            rows = rows.unionByName(self.spark.read.schema(_SCHEMA).parquet(self._path(batch)))
        return added(rows).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self, batches: list[str], into: str) -> None:
        """One batch with the sums of several; use it in their place."""
        self.commit(into, self.totals(batches))
