"""From documents to packed training sequences: language, lines, near duplicates, packing.

Edge cases, of every stage: null and empty texts have no language and go in the first stage, and a later stage keeps them; a very long
text is one document like others; ties go to the lesser id; an empty table gives no rows; columns beside those of documents are left out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Stages
are written and read again between one another. Rows with a null doc_id, and those that repeat one, are documents of their own,
which are decided on by themselves and count as later than all others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.common import by_row, materialise, read
from chunkloom.llm.jaccard import jaccard_components
from chunkloom.llm.language import UNKNOWN, fit, held_out, predict
from chunkloom.llm.lines import dedup_lines
from chunkloom.llm.packing import pack_documents, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose language is less certain than this is rejected.
LEAST_SCORE = 0.34


def numbered(docs: DataFrame) -> DataFrame:
    return by_row(docs.select(*COLUMNS), "doc_id", list(COLUMNS))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages; those without a letter or without a clear language go."""
    docs = numbered(docs)
    found = predict(docs, fit(docs.where(~held_out())), id_col="_row")
    good = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("_row")
    return docs.join(good, "_row", "left_semi").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are similar to earlier ones; those of which no word is left go."""
    docs = numbered(docs)
    cut = dedup_lines(docs, id_col="_row").select("_row", F.col("text").alias("_text"), "n_removed")
    left = (F.col("n_removed") == 0) | (F.length(F.trim(F.translate("_text", "\n\t\r", "   "))) > 0)
    joined = docs.drop("text").join(cut, "_row").where(left)
    return joined.select("doc_id", F.col("_text").alias("text"), "lang", "source", F.length("_text").cast("long").alias("n_chars"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates; documents without words are in no group."""
    docs = numbered(docs)
    found = jaccard_components(docs, id_col="_row").where(F.col("component_id").isNull() | (F.col("_row") == F.col("component_id"))).select("_row")
    return docs.join(found, "_row", "left_semi").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences of 4096 tokens."""
    return pack_documents(docs, vocabulary())


STAGES = [("language", keep_known_languages), ("lines", drop_repeated_lines), ("near_duplicates", keep_one_of_each), ("packing", pack)]
#: No stage but the join of lines could be said in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
