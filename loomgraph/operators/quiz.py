"""Quizzes: flattening, checking, tallying, grading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import choice_number

DONT_KNOW = 5
CHOICES = 5


def tally(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(qnum, term, complaint, correct, dont_know): questions (qnum, term, question, answer) against a sheet (qnum, term, question, user_ans).

    Checks in order: missing, other term, other question, blank, out of range;
    answers to no question are reported as extra.
    """
    q, a = questions.alias("q"), answers.alias("a")
    rows = q.join(a, F.col("q.qnum") == F.col("a.qnum"), "full_outer")
    chosen = choice_number(F.col("a.user_ans"))
    complaint = (
        F.when(F.col("q.qnum").isNull(), "extra").when(F.col("a.qnum").isNull(), "missing").when(~F.col("q.term").eqNullSafe(F.col("a.term")), "term")
        .when(~F.col("q.question").eqNullSafe(F.col("a.question")), "question").when(F.coalesce(F.trim("a.user_ans"), F.lit("")) == "", "blank").when(chosen.isNull() | (chosen < 1) | (chosen > CHOICES), "range")
    )
    good = complaint.isNull()
    return rows.select(
        F.coalesce("q.qnum", "a.qnum").alias("qnum"), F.coalesce("q.term", "a.term").alias("term"), complaint.alias("complaint"),
        F.when(good & (chosen == F.col("q.answer")), 1).otherwise(0).alias("correct"), F.when(good & (chosen == DONT_KNOW), 1).otherwise(0).alias("dont_know"),
    )


def grade(counts: DataFrame) -> DataFrame:
    """(term, correct, dont_know, rate, mental) of three questions a term."""
    sums = counts.filter("complaint is null").groupBy("term").agg(F.sum("correct").alias("correct"), F.sum("dont_know").alias("dont_know"))
    rate = F.floor(F.col("correct") / 3 * 100 + 0.5).cast("int")
    mental = F.when(F.col("dont_know") >= 2, "unknown").when(F.col("correct") >= 2, "certain").otherwise("unknown")
    return sums.select("term", "correct", "dont_know", rate.alias("rate"), mental.alias("mental"))


def records(graded: DataFrame, means: DataFrame) -> DataFrame:
    """(term, TermMeans, UserMentalValue) of every graded term, certain or not; what isn't known is the empty text.

    means (term, means) may lack terms, have others and say null; of several
    meanings of a term the least is taken, so no term comes twice.
    """
    told = means.groupBy("term").agg(F.min("means").alias("means"))
    return graded.join(told, "term", "left").select("term", F.coalesce("means", F.lit("")).alias("TermMeans"), F.coalesce("mental", F.lit("")).alias("UserMentalValue"))


def study_note(graded: DataFrame) -> DataFrame:
    """Terms that aren't certain, the weakest first."""
    return graded.filter("mental <> 'certain'").orderBy("rate", "term").select("term", "rate")


def position_complaint(questions: DataFrame, least: int = 6) -> DataFrame:
    """One row that says whether all of at least six answers share a position."""
    return questions.agg(((F.count("*") >= least) & (F.countDistinct("answer") == 1)).alias("same_position"))


def answer_sheet(questions: DataFrame) -> DataFrame:
    """Questions with numbered choices; the answer is withheld."""
    return questions.select("qnum", "term", "question", F.map_from_entries(F.transform("choices", lambda c, i: F.struct(i + 1, c))).alias("choices"))
