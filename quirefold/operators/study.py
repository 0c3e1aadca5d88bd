"""Study analytics: quiz grading, spaced repetition, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold import fixed_values as fv
from quirefold.functions.text import let

DAY_US = 86_400_000_000
SLICE_US = 3_600_000_000


def grade_quizzes(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Per question the chosen and right option texts and whether they agree.

    ``questions``: question_id, options, correct_index. ``answers``: question_id, chosen.
    Unanswered is wrong; an index outside the options reads "None" (right option: blank).
    """
    joined = questions.join(answers, "question_id", "left")

    def option(index: str, none: str) -> Column:
        return F.coalesce(F.get("options", F.when(F.col(index) >= 0, F.col(index)).cast("int")), F.lit(none))

    right = F.coalesce(F.col("chosen") == F.col("correct_index"), F.lit(False))
    return joined.select(
        *questions.columns, "chosen", option("chosen", "None").alias("selected_text"), option("correct_index", "").alias("correct_text"),
        right.alias("is_correct"),
    )


def quiz_scores(graded: DataFrame, *keys: str) -> DataFrame:
    """Correct answers, total, percent to one decimal, and pass."""
    out = graded.groupBy(*keys).agg(F.count_if("is_correct").alias("n_correct"), F.count(F.lit(1)).alias("n_total"))
    score = F.round(F.col("n_correct") / F.greatest(F.lit(1), F.col("n_total")) * 100.0, 1)
    return out.withColumn("score", score).withColumn("passed", F.col("score") >= fv.PASS_MARK)


CODES = {"again": "0", "hard": "1", "good": "2", "easy": "3"}


def rating_code(rating: Column) -> Column:
    """One character per known rating; others change nothing but the review time."""
    r = F.lower(F.trim(rating))
    code = F.lit("-")
    for name, c in CODES.items():
        code = F.when(r == name, c).otherwise(code)
    return code


def sm2_step(s: Column, us: Column, code: Column) -> Column:
    """One review: ``s`` has ease, interval_days, reps, last_us and rejected.

    A review whose next date lies beyond the last date there is changes nothing but the count of rejected ones.
    """
    ease, days, reps = s["ease"], s["interval_days"], s["reps"] + 1

    def state(e: Column, d: Column, n: Column) -> Column:
        return F.struct(e.cast("double").alias("ease"), d.cast("double").alias("days"), n.cast("int").alias("reps"))

    def grown(factor: Column) -> Column:
        return F.greatest(F.lit(1.0), F.floor(factor).cast("double"))

    good = F.when(reps == 1, 1.0).when(reps == 2, 6.0).otherwise(grown(days * ease))
    easy = F.when(reps == 1, 3.0).when(reps == 2, 10.0).otherwise(grown(days * ease * 1.3))
    rated = (
        F.when(code == "0", state(F.greatest(F.lit(fv.MIN_EASE), ease - 0.2), F.lit(1), F.lit(0)))
        .when(code == "1", state(F.greatest(F.lit(fv.MIN_EASE), ease - 0.15), grown(days * F.lit(1.2)), reps))
        .when(code == "2", state(ease, good, reps))
        .when(code == "3", state(ease + 0.15, easy, reps))
        .otherwise(state(ease, days, s["reps"]))
    )
    left = F.lit(fv.LAST_DATE_US) - us
    room = (left - F.pmod(left, F.lit(DAY_US))) / DAY_US

    def settled(r: Column) -> Column:
        fits = r["days"] <= room
        return F.struct(
            F.when(fits, r["ease"]).otherwise(ease).alias("ease"),
            F.when(fits, r["days"].cast("int")).otherwise(days).alias("interval_days"),
            F.when(fits, r["reps"]).otherwise(s["reps"]).alias("reps"),
            F.when(fits, us).otherwise(s["last_us"]).alias("last_us"),
            F.when(fits, s["rejected"]).otherwise(s["rejected"] + 1).alias("rejected"),
        )

    return let(rated, settled)


def sm2_replay(reviews: DataFrame) -> DataFrame:
    """Card state after its whole review log (card_id, us, review_id, rating).

    The fold is sequential per card, so its input is made small first: reviews of one card
    and hour are ordered in their own group and keep only a time and one character each.
    A much reviewed card is thereby sorted in many tasks. Intervals grow without a cap;
    ``n_rejected`` counts the reviews whose next date could not be held.
    """
    hour = F.floor(F.col("us") / SLICE_US)
    coded = reviews.select("card_id", hour.alias("hour"), "us", "review_id", rating_code(F.col("rating")).alias("c"))
    ordered = F.array_sort(F.collect_list(F.struct("us", "review_id", "c")))
    slices = coded.groupBy("card_id", "hour").agg(
        F.transform(ordered, lambda r: F.struct(r["us"].alias("us"), r["c"].alias("c"))).alias("log"), F.count(F.lit(1)).alias("n"),
    )
    in_order = F.array_sort(F.collect_list(F.struct("hour", "log")))
    cards = slices.groupBy("card_id").agg(in_order.alias("slices"), F.sum("n").alias("n_reviews"))
    start = F.struct(
        F.lit(fv.START_EASE).alias("ease"), F.lit(1).alias("interval_days"), F.lit(0).alias("reps"),
        F.lit(None).cast("long").alias("last_us"), F.lit(0).cast("long").alias("rejected"),
    )

    def one_slice(state: Column, part: Column) -> Column:
        return F.aggregate(part["log"], state, lambda s, r: sm2_step(s, r["us"], r["c"]))

    out = cards.withColumn("s", F.aggregate("slices", start, one_slice))
    return out.select(
        "card_id", "n_reviews", F.col("s.rejected").alias("n_rejected"), "s.reps", "s.interval_days", F.round("s.ease", 2).alias("ease"),
        F.col("s.last_us").alias("last_reviewed_us"),
        (F.col("s.last_us") + F.col("s.interval_days").cast("long") * DAY_US).alias("next_review_us"),
    )


def review_sessions(reviews: DataFrame, topic: Column | None = None) -> DataFrame:
    """A study session per review: right for good and easy, fifteen seconds."""
    right = F.lower(F.trim("rating")).isin("good", "easy")
    return reviews.select(
        *reviews.columns,
        F.lit("FLASHCARD").alias("session_type"), F.lit(1).alias("total_items"), right.cast("int").alias("correct_items"),
        F.when(right, 100.0).otherwise(0.0).alias("score"),
        (F.lit("Cardiology") if topic is None else F.coalesce(topic, F.lit("Cardiology"))).alias("session_topic"),
        F.lit(fv.REVIEW_SECONDS).alias("seconds"),
    )


def first_filled(*columns: str) -> Column:
    """The first column that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def user_stats(sessions: DataFrame) -> DataFrame:
    """Per user in one pass: quizzes, mean score, cards, minutes."""
    quiz = F.col("session_type") == "QUIZ"
    out = sessions.groupBy("user_id").agg(
        F.count_if(quiz).alias("n_quizzes"),
        F.round(F.coalesce(F.avg(F.when(quiz, F.col("score"))), F.lit(0.0)), 1).alias("avg_score"),
        F.count_if(F.col("session_type") == "FLASHCARD").alias("n_cards"),
    )
    minutes = F.bround((F.col("n_quizzes") * fv.QUIZ_SECONDS + F.col("n_cards") * fv.CARD_SECONDS) / 60).cast("long")
    return out.withColumn("minutes", minutes)


def topic_breakdown(sessions: DataFrame) -> DataFrame:
    """Accuracy per user and topic over quiz sessions; a blank topic reads General."""
    topic = F.coalesce(first_filled("topic"), F.lit("General"))
    out = sessions.filter("session_type = 'QUIZ'").groupBy("user_id", topic.alias("topic")).agg(
        F.sum("correct_items").alias("correct"), F.sum("total_items").alias("total_questions")
    )
    accuracy = F.round(F.col("correct") / F.greatest(F.lit(1), F.col("total_questions")) * 100.0, 1)
    return out.select("user_id", "topic", accuracy.alias("accuracy"), "total_questions")


def item_counts(parents: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Items per parent, zero included."""
    counts = items.groupBy(key).agg(F.count(F.lit(1)).alias("n_items"))
    return parents.join(counts, key, "left").select(*parents.columns, F.coalesce("n_items", F.lit(0)).alias("n_items"))


def mastery_bands(breakdown: DataFrame) -> DataFrame:
    band = F.when(F.col("accuracy") < 70, "weak").when(F.col("accuracy") < 85, "fair").otherwise("strong")
    return breakdown.select(band.alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("n"))
