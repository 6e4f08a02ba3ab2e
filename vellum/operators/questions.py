"""Search over generated questions: each chunk answers with its best question."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vellum.functions import text as T
from vellum.operators import vectors


def best_question_per_chunk(questions: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, question_id, score): top ``k`` chunks by their best question.

    Per query the maximum per chunk is an aggregate, so a chunk owning very many questions is reduced
    before the shuffle.
    """
    flat = vectors.all_scores(questions, queries, "chunk_id", "question_id")
    best = flat.groupBy("query_id", "chunk_id").agg(F.max(F.struct("score", -F.col("question_id"))).alias("m"))
    best = best.select("query_id", "chunk_id", F.col("m.score").alias("score"), (-F.col("m.col2")).alias("question_id"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return best.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select(
        "query_id", "chunk_id", "question_id", "score")


def replace_questions(stored: DataFrame, chunk_questions: DataFrame) -> DataFrame:
    """Replace a chunk's questions with parallel arrays of questions and vectors.

    A chunk that comes without questions or without vectors keeps what is stored.
    """
    given = chunk_questions.where((F.size("questions") > 0) & (F.size("embeddings") > 0))
    bad = F.size("questions") != F.size("embeddings")
    checked = given.withColumn("_ok", F.when(bad, F.raise_error(F.lit(
        "questions and embeddings differ in length"))).otherwise(F.lit(True))).where("_ok")
    new = checked.select("chunk_id", F.explode(F.arrays_zip("questions", "embeddings")).alias("z")).select(
        "chunk_id", F.col("z.questions").alias("question"), F.col("z.embeddings").alias("embedding"))
    return stored.join(checked.select("chunk_id"), "chunk_id", "left_anti").unionByName(new)


def usable(question: str):
    return F.length(T.strip(F.col(question))) > 0
