"""From raw documents to piece ids: language, near duplicates, benchmark leaks, personal data, pieces.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and
returns a DataFrame; all but the last return the columns of ``documents``. ``run``
writes each result to the shared folder as Parquet and reads it back for the next.

Defined results: a null text is an empty one; it has no letter, so the language stage rejects it. Null ids and sources are
values like others; of a group of near duplicates a row with an id stays before one without. Equal rows are copies, of which
one stays. A table without a single labelled text teaches no language, so all of it is rejected; an empty table gives no rows
in any stage. Further columns are carried by every stage but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oficina.llm import decontaminate, jaccard, langid, pieces, pii
from oficina.llm.common import documents, remainder, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough certainty; the model learns from these docs."""
    learn = docs.where(F.coalesce(remainder("doc_id", 3) != 1, F.lit(True)))
    model = langid.train(learn, "text", "lang", "doc_id")
    return langid.predict(docs, model, "text", docs.columns).where("accepted").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return jaccard.keep_one(docs, "doc_id", "text")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in whose text no benchmark item stands."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "doc_id", "text")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced; n_chars follows the new text."""
    out = pii.sanitized(docs, "doc_id", "text")
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of all documents, and whether decoding gives the text back."""
    return pieces.encode(docs, ["doc_id", "lang", "source"], "text")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("sentence_pieces", sentence_pieces),
]

#: SQL cannot express the first and the last stage; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
