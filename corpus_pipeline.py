"""A corpus in five stages, from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.  All but the last return the
columns of documents, whatever these are besides doc_id, text and source.  Stages are written and read again between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flocktrace.llm import bpe, jaccard, mixing, repeats, rules
from flocktrace.llm.common import fresh, staged
from flocktrace.llm.queries import tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the decision list learned from labels keep.

    The list is learned from the labelled ones of docs.  Rows are judged each on its own text.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return rules.passed(docs, rules.fit(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (5-word shingles, similarity 0.8): that with the least id.

    Null ids count as greater than all others; of different texts with one id the one with the lesser hash stays, and of
    rows alike in both the one whose columns sort first.  Documents without words link with nothing and stay, all of them.
    """
    tag = fresh("_tag", docs)
    found = staged(jaccard.join(docs, classes=True), "classes")
    place = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("first")
    kept = found.where("class is not null").groupBy("class").agg(place).select("first.doc_id", "first.tag")
    kept = staged(kept.unionByName(found.where("class is null").select("doc_id", "tag").distinct()), "kept")
    several = found.where("class is not null").groupBy("doc_id", "tag").agg(F.count("*").alias("n")).where("n > 1")
    several = staged(several.alias("s").join(kept.alias("k"), _alike("s", "doc_id", "tag", "k", "tag"), "left_semi"), "several")
    tagged = docs.withColumn(tag, F.xxhash64("text")).alias("d")
    left = tagged.join(kept.alias("k"), _alike("d", "doc_id", tag, "k", "tag"), "left_semi")
    if several.isEmpty():
        return left.drop(tag)
    same = _alike("d", "doc_id", tag, "k", "tag")
    once = left.alias("d").join(several.alias("k"), same, "left_semi").groupBy("doc_id", tag).agg(F.min(F.struct(*docs.columns)).alias(tag + "_")).select(f"{tag}_.*")
    return left.alias("d").join(several.alias("k"), same, "left_anti").drop(tag).unionByName(once)


def _alike(left: str, left_id: str, left_tag: str, right: str, right_tag: str) -> Column:
    """Whether rows of two tables have the same id, null or not, and the same tag."""
    return F.col(f"{left}.{left_id}").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.{left_tag}") == F.col(f"{right}.{right_tag}"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what repeats an earlier string of 100 bytes; documents of which no word is left go.

    Characters are kept whole, so up to three bytes at an end of a passage may stay.  n_chars, where it is a column,
    follows the text.  Texts that lose nothing stay as they are, null and empty ones too.
    """
    tag = fresh("_tag", docs)
    spanned = repeats.spans(docs)
    left = repeats.without(spanned, whole_characters=True).where("n_removed > 0").select("doc_id", "tag", F.col("kept").cast("string").alias("left"))
    left = staged(left, "left").dropDuplicates(["doc_id", "tag"])
    tagged = docs.withColumn(tag, F.xxhash64(F.coalesce("text", F.lit("")))).alias("d")
    changed = tagged.join(left.alias("l"), _alike("d", "doc_id", tag, "l", "tag"), "left")
    text = F.when(F.col("l.tag").isNotNull(), F.col("l.left")).otherwise(F.col("d.text"))
    columns = {c: F.col(f"d.{c}") for c in docs.columns} | {"text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("l.tag").isNotNull(), F.char_length("l.left")).otherwise(F.col("d.n_chars")).cast(docs.schema["n_chars"].dataType)
    gone = F.col("l.tag").isNotNull() & ~F.col("l.left").rlike(r"[^\x20\x09-\x0D]")
    return changed.where(~gone).select(*(columns[c].alias(c) for c in docs.columns))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: whole epochs of its source, and one more time for those drawn first.

    The document at a target's edge comes whole if at least half of it fits.  Of rows alike in id and text those whose
    columns sort first come more often, if not all come alike.
    """
    tag, copies = fresh("_tag", docs), fresh("_copies", docs)
    read = docs.select("doc_id", "text", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_tag"))
    taken = mixing.mix(read, whole=True, row_col="row_tag")
    times = F.sum(F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0)).cast("long").alias("times")
    drawn = staged(taken.groupBy("doc_id", "row_tag").agg(times, F.count("*").alias("rows")).where("times > 0"), "copies")
    tagged = docs.withColumn(tag, F.xxhash64(F.coalesce("text", F.lit("")))).alias("d")
    several, same = drawn.where("rows > 1"), _alike("d", "doc_id", tag, "c", "row_tag")
    out = tagged.join(drawn.where("rows = 1").alias("c"), same).select("d.*", F.col("c.times").alias(copies))
    if not several.isEmpty():
        # rows alike in everything are one with a count, so that a document with very many copies is combined before the shuffle
        counted, number, before = (fresh(n, docs) for n in ("_n", "_number", "_before"))
        variants = tagged.join(several.alias("c"), same, "left_semi").groupBy(*docs.columns, tag).agg(F.count("*").alias(counted))
        upto = Window.partitionBy("doc_id", tag).orderBy(*docs.columns).rowsBetween(Window.unboundedPreceding, -1)
        placed = variants.withColumn(before, F.coalesce(F.sum(counted).over(upto), F.lit(0))).alias("d").join(several.alias("c"), same)
        each = F.floor(F.col("c.times") / F.col("c.rows"))
        more = F.greatest(F.lit(0), F.least(F.col(counted), F.col("c.times") - each * F.col("c.rows") - F.col(before)))
        out = out.unionByName(placed.withColumn(number, each * F.col(counted) + more).where(F.col(number) > 0).select(*(f"d.{c}" for c in docs.columns), tag, F.col(number).cast("long").alias(copies)))
    return out.withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row, by the byte-level tokenizer."""
    return bpe.encode(docs, tokenizer_file("byte_bpe_50k.json")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mixed_sources),
    ("BPE encoding and decoding", token_ids),
]

#: Learned rules, suffix arrays and BPE cannot be said in SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
