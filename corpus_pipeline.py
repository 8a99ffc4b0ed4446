"""The corpus pipeline: five stages over documents, each on all that the one
before it kept.  Every stage is (spark, docs, sf_dir) -> DataFrame; all but the
last return the columns of documents.

What holds for all stages: an empty table gives an empty result, texts of any
length are worked on whole, and columns beyond doc_id and text are carried along
whatever their names (n_chars is counted anew where a text is changed)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import decontaminate, ngram_join, packing, quality_resample, substring_dedup

#: No SQL: stages 1, 4 and 5 have none.  tests/llm/test_pipeline.py checks every stage by brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws; the others go.

    A null or empty text has weight 0, which is that of a middling document.  Equal
    weights are told apart by noise made of doc_id and a fixed seed; rows that repeat
    a doc_id have one noise, and null ids share one."""
    return quality_resample.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the least doc_id.

    Rows that share a doc_id are one document and stay or go together; a row
    without doc_id stays; null and empty texts are like nothing and stay."""
    groups = ngram_join.near_duplicates(docs.select("doc_id", "text"))
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[docs[f"`{c}`"] for c in docs.columns])


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller doc_id has too;
    documents of which nothing is left go.

    A null doc_id counts as larger than every other; rows with equal doc_id take
    nothing from each other; null texts and texts without words stay as they are."""
    return substring_dedup.cleaned(docs).select(*[f"`{c}`" for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts and items match nothing; rows that repeat are judged alike;
    an empty benchmark leaves all documents."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences.

    A null text counts as empty and still has its end token; a null id stays null;
    rows that repeat are packed as rows of their own."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontamination", decontamination),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared
    checkpoint folder as Parquet and read again."""
    import uuid

    from siltstone.session import checkpoint_dir

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        place = f"{checkpoint_dir(spark)}/corpus-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return STAGES[-1][1](spark, docs, sf_dir)
