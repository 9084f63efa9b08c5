"""The corpus pipeline: five stages over ``documents``, each written and read again by the next.

Each function takes (spark, docs, sf_dir). All but the last return the columns of documents, and
pass on any other column of docs unread, whatever its name. Null texts count as empty, rows that
agree in id and text as one document; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matloom.llm import queries as llm
from matloom.llm.common import fresh, materialize, quoted, release, scratch_scope, sift
from matloom.llm.decontam import find_contamination
from matloom.llm.line_dedup import rewritten
from matloom.llm.packing import pack
from matloom.llm.quality import accepted, fit_quality
from matloom.llm.simhash import near_copies


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hashes(docs: DataFrame) -> tuple[str, DataFrame]:
    """docs with a struct of (doc_id, k1, k2), by which a row is known, under a name that no column has."""
    key, doc, text = fresh(docs.columns, "key"), F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashes = F.struct(doc.alias("doc_id"), F.xxhash64(doc, text).alias("k1"), F.xxhash64(text, F.lit(1), doc).alias("k2"))
    return key, docs.withColumn(key, hashes)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more; the rules are fitted on the labelled rows among docs.

    Rows with a null id are scored like others but not fitted on; without labels of both kinds all
    rows get the share of good ones as their score.
    """
    model = fit_quality(docs, _table(spark, sf_dir, "labels"))
    return accepted(docs, model, 0.3)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three consecutive lines; documents of nothing else go.

    n_chars follows the text where lines went, null texts come back empty. A document that had no
    visible line before stays as it is.
    """
    same, changed = rewritten(docs, keep=tuple(docs.columns))
    every = same.withColumn("n_removed", F.lit(0).cast("bigint")).unionByName(changed.where("n_lines = 0 or n_removed < n_lines").drop("n_lines"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kept = F.col("kept").getField("n_chars")
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(kept)
    return every.select(*(new.get(c, F.col("kept").getField(c)).alias(c) for c in docs.columns))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: five-word shingles, similarity 0.8 or more.

    The first is that of the smallest doc_id, null ids last, and among equal ids that of the least
    hash of id and text; of repeated rows one stays. Texts without words are one group.
    """
    key, keyed = _hashes(docs)
    marks = materialize(near_copies(docs), "pipeline-copies").withColumnsRenamed({"doc_id": "d", "k1": "j1", "k2": "j2"})
    rest, some = sift(keyed, F.col(key).getField("k1"), marks, "j1")
    # what may be marked meets the marks as one struct, so that no name can clash
    row = some.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), f"{key}.*")
    met = row.join(marks.hint("merge"), F.expr("k1 = j1 and k2 = j2 and doc_id <=> d"), "left").where("again or again is null")
    nth = F.row_number().over(Window.partitionBy("k1", "k2", "doc_id").orderBy(F.lit(0)))
    once = met.withColumn("nth", F.when(F.col("again"), nth).otherwise(1)).where("nth = 1")
    return rest.select(*docs.columns).unionByName(once.select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten words of a benchmark item occurs; texts without words have none."""
    key, keyed = _hashes(docs)
    k1 = F.col(key).getField("k1")
    found = find_contamination(keyed.select(k1.alias("doc_id"), "text"), _table(spark, sf_dir, "benchmark")).where(F.size("spans") > 0)
    hits = materialize(found.select(F.col("doc_id").alias("hit")).distinct(), "pipeline-leaks")
    rest, some = sift(keyed, k1, hits, "hit")
    row = some.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), k1.alias("k1"))
    left = row.join(hits.hint("merge"), F.col("k1") == F.col("hit"), "left_anti")
    return rest.select(*docs.columns).unionByName(left.select("row.*"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 2048 ids.

    Null and empty texts are a piece of the end id alone; repeated rows and null ids are packed like others.
    """
    return pack(docs, llm.tokenizer_path())


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

#: A fitted model and tokenizer ids are beyond SQL: the tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what a stage returns is written as Parquet and read by the next."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch_scope() as kept:
            made = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
            kept.append(made)
        release(docs)
        docs = made
    return docs
