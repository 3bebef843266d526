"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last keep the columns of documents.

1. language_id: documents whose language can't be told (no text or no letter) go;
2. line_dedup: lines that ten documents or more share go from all of them;
3. near_dedup: of documents whose sets of five-word shingles are 0.8 similar or more, the one with the smallest id stays;
4. decontamination: documents that hold an item of the benchmark go;
5. packing: the rest is cut into pieces and packed into sequences.

Null texts go in the first stage; a text that loses all its lines stays as an empty one; null ids and extra columns,
whatever their names, pass through all stages but the last; rows of one id stay or go together in the stages that look
for duplicates and items; no documents give no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontamination, language_id, line_dedup, minhash, packing
from lodestone.llm.common import new_folder, quoted, ship, unused


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    lang, score = unused(docs.columns, "lang_pred", "score")
    found = language_id.predict(docs, language_id.fit(docs), (lang, score))
    return found.where(F.col(lang) != language_id.UNKNOWN).select(*quoted(docs.columns))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    lines, dropped = unused(docs.columns, "n_lines", "n_dropped")
    kept = line_dedup.drop_common_lines(docs, counts=(lines, dropped))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*quoted(docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs.select("doc_id", "text"), tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: No SQL: the first, third and last stage are a trained model, a randomised search and a packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; gives the packed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
