"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import decontaminate, language_id, line_dedup, near_dedup, sentencepiece_codec
from lodestack.llm.common import BROADCAST_ROWS, content_key, materialize, shared_path, small, unused
from lodestack.llm.entries import PIECE_MODEL


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose (doc, text_hash) are in ``gone``; null ids compare as equal."""
    gone, own = small(materialize(gone.distinct(), "gone"), BROADCAST_ROWS).alias("g"), unused("hash", docs)
    d = docs.withColumn(own, content_key()[1]).alias("d")
    return d.join(gone, F.col("d.doc_id").eqNullSafe(F.col("g.doc")) & (F.col(f"d.{own}") == F.col("g.text_hash")), "left_anti").select(*docs.columns)


def _each_once(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each (id, text) that repeats; only rows that repeat are shuffled."""
    own = unused("hash", docs)
    keyed = docs.withColumn(own, content_key()[1])
    again = materialize(keyed.groupBy("doc_id", own).count().where("count > 1").select(F.col("doc_id").alias("doc"), F.col(own).alias("text_hash")), "again")
    if again.isEmpty():
        return docs
    k, a = keyed.alias("k"), small(again, BROADCAST_ROWS).alias("a")
    same = F.col("k.doc_id").eqNullSafe(F.col("a.doc")) & (F.col(f"k.{own}") == F.col("a.text_hash"))
    one = k.join(a, same, "left_semi").dropDuplicates(["doc_id", own])
    return k.join(a, same, "left_anti").unionByName(one).select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model does not reject, with lang as predicted.

    It learns from the documents' own labels; a null text, or one without a letter, is rejected.
    """
    model, own = language_id.fit(docs), unused("said", docs)
    said = docs.withColumn(own, model.predict(F.col("text"))).where(~F.col(f"{own}.rejected"))
    return said.select(*[F.col(f"{own}.lang").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those of which no letter is left go. n_chars is that of the new text.

    A null or an empty text has no lines and stays; of equal lines the one of the smallest id stays, a null id first.
    """
    mine = [c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")]  # the operator would replace them
    kept = {c: unused(f"own_{c}", docs) for c in mine}
    out = line_dedup.dedup_lines(docs.withColumnsRenamed(kept)).where((F.col("n_dropped") == 0) | F.regexp_like("text", F.lit(r"\p{L}")))
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(kept.get(c, c)).alias(c) for c in docs.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more, the smallest id.

    Rows that repeat an id and its text are one document, with a null id, too; other rows with a null id stay, and so do
    null and empty texts, which are like nothing.
    """
    docs, doc = _each_once(docs), unused("doc", docs)
    found = near_dedup.near_duplicates(docs, shingle=5, percent=80).where("not kept").select(F.col("doc_id").alias(doc)).distinct()
    gone = small(materialize(found, "gone"), BROADCAST_ROWS)
    return docs.join(gone, docs["doc_id"] == gone[doc], "left_anti")


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window; null and empty texts have none and stay."""
    found = decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("n_hit > 0").select(F.col("doc_id").alias("doc"), "text_hash"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, n_tokens and SentencePiece ids of what is left, and whether they decode to the text; a null text has no ids."""
    own = unused("coded", docs)
    coded = docs.withColumn(own, sentencepiece_codec.encode_checked(spark, F.col("text"), sentencepiece_codec.load(PIECE_MODEL)))
    return coded.select("doc_id", "lang", F.size(f"{own}.ids").cast("long").alias("n_tokens"), f"{own}.ids", f"{own}.round_trip")


STAGES = [
    ("language id", identify_language),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_documents),
    ("decontamination", remove_benchmark),
    ("sentencepiece", encode_pieces),
]

#: SQL expresses none of these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
