"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

A change has the count of a document before and after: no count before is an insert, none after a delete, both a
revision.  A batch adds up what its changes mean to each total and is committed once: its rows go to a folder of its own
under a temporary name, which is renamed when they are whole.  A batch that is committed again, after a retry or by two
writers, changes nothing.  Totals are sums over all committed batches and so do not depend on their order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "version"]
SCHEMA = "source string, lang string, version string, documents long, tokens long"


def deltas(changes: DataFrame) -> DataFrame:
    """documents and tokens to add to each total, from rows of source, lang, version, before and after (token counts or null).

    Null keys are a total of their own.  Rows with neither count add nothing.  Totals to which a batch adds nothing are
    left out.  Other columns are not read.  A hot total is combined before the shuffle.
    """
    there = lambda c: F.col(c).isNotNull().cast("long")
    count = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    summed = changes.groupBy(*KEYS).agg(F.sum(there("after") - there("before")).alias("documents"), F.sum(count("after") - count("before")).alias("tokens"))
    return summed.where("documents <> 0 or tokens <> 0").select(*(F.col(k).cast("string").alias(k) for k in KEYS), "documents", "tokens")


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def committed(spark: SparkSession, root: str, batch: str) -> bool:
    files, where = _files(spark, f"{root}/batch={batch}")
    return files.exists(where)


def commit(root: str, batch: str, changes: DataFrame) -> bool:
    """Adds a batch of changes to the totals at root; False, and nothing done, if it is there already.

    batch: a name of letters, digits, - and _.  If the job dies, nothing is committed and the batch can be run again; of
    two writers of one batch, the one that renames first counts.
    """
    if not batch or not batch.replace("-", "").replace("_", "").isalnum():
        raise ValueError(f"not a name for a batch: {batch!r}")
    spark = changes.sparkSession
    if committed(spark, root, batch):
        return False
    made = f"{root}/.making-{uuid.uuid4().hex}"
    deltas(changes).write.parquet(made)
    files, source = _files(spark, made)
    _, target = _files(spark, f"{root}/batch={batch}")
    # a rename onto an existing folder fails or moves into it, so it is looked for again just before
    done = not files.exists(target) and files.rename(source, target)
    if not done:
        files.delete(source, True)
    return bool(done)


def totals(spark: SparkSession, root: str) -> DataFrame:
    """source, lang, version, documents and tokens over all committed batches; totals without documents are left out."""
    files, where = _files(spark, root)
    names = sorted(s.getPath().toString() for s in (files.listStatus(where) if files.exists(where) else []) if s.getPath().getName().startswith("batch="))
    rows = spark.read.schema(SCHEMA).parquet(*names) if names else spark.createDataFrame([], SCHEMA)
    summed = rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
    return summed.where("documents <> 0 or tokens <> 0")


def counted(docs: DataFrame, versions: dict[str, Column], source_col: str = "source", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """source, lang, version and tokens (and `keep`) for each document and tokenizer version, read in one pass."""
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("version"), c.cast("long").alias("tokens")) for v, c in versions.items())))
    return docs.select(*keep, F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), each.alias("c")).select(*keep, "source", "lang", "c.version", "c.tokens")
