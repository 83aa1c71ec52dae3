"""A training-data pipeline over ``documents``.

Five stages, each a function of (spark, docs, sf_dir) whose result is written and read
again as the next one's ``docs``:

1. language ID: documents that it rejects go (no letter, or far from every language);
2. near-dedup: of each group of documents with a similarity of 0.8 or more on five-word shingles, the
   one with the smallest id stays;
3. decontamination: documents that repeat benchmark passages go;
4. personal data: spans are replaced by their kind in brackets;
5. byte-pair encoding: token ids are added, and whether they decode to the text.

All but the last return the columns of documents. Every stage works on all it is given,
keeps whatever else the rows hold, and gives an empty result for an empty table. Rows
that share an id are one document to stage 2; rows without id are kept by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, language, near_documents, personal_data
from plumbline.llm.common import all_but, table, written

#: SQL can express neither the first stage nor those that follow from it.
ORACLE_SQL = None
ROW = "_row"


def _packed(docs: DataFrame) -> DataFrame:
    """Each row as one column beside its text, so that no column of it can clash."""
    return docs.select(F.struct(*["`" + c.replace("`", "``") + "`" for c in docs.columns]).alias(ROW), docs["text"].alias("text"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.learn(docs.select("text", "lang"))
    return language.identify(_packed(docs), model).where("not rejected").select(f"{ROW}.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_documents.near_documents(docs.select("doc_id", "text"), shingle=5)
    kept = written(found.where("kept and doc_id is not null").groupBy("doc_id").count(), "kept")
    # Merged at every size: the ids kept are never few for long.
    single = kept.where("count = 1").select("doc_id").hint("merge")
    once = docs.join(single, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    repeated = kept.where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return once
    return once.unionByName(docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    gone = written(found.where("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")), "contaminated")
    key = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (key == gone["_key"]), "left_anti")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = personal_data.find(_packed(docs), personal_data.learn(docs))
    text = personal_data.redacted(F.col("text"), F.col("spans"))
    rows = found.select(F.col(ROW), text.alias("_text")).select(f"{ROW}.*", "_text")
    changed = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_text").isNull(), F.col("n_chars")).otherwise(F.length("_text").cast(docs.schema["n_chars"].dataType))
    return rows.withColumns(changed).drop("_text")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(_packed(docs), bpe.public_vocabulary())
    rows = coded.select(
        f"{ROW}.*",
        F.col("token_ids").alias("_ids"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("_same"),
    )
    rows = all_but(rows, ("token_ids", "n_tokens", "round_trip"))
    return rows.withColumns({"n_tokens": F.size("_ids").cast("long"), "round_trip": F.col("_same"), "token_ids": F.col("_ids")}).drop("_ids", "_same")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
