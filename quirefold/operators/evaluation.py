"""Retrieval quality: hit rate, faithfulness, citation accuracy, run history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold import fixed_values as fv
from quirefold.functions.text import strip, words
from quirefold.session import written


def _names_in(content: Column, entities: Column) -> Column:
    return F.exists(entities, lambda e: F.contains(content, F.lower(e)))


def hits_at_k(golden: DataFrame, found: DataFrame, k: int = fv.FINAL_K) -> DataFrame:
    """Per question whether one of its top k chunks has the expected page or names an expected entity.

    ``golden``: query_id, expected_answer, expected_page, expected_entities (array).
    ``found``: query_id, rank, content, page_number. Both are keyed by the question, so the
    text test is a residual of an equi-join.
    """
    top = found.filter(F.col("rank") <= k).join(golden, "query_id")
    page = F.coalesce(F.col("page_number") == F.col("expected_page"), F.lit(False))
    hit = page | _names_in(F.lower("content"), F.col("expected_entities"))
    per = top.groupBy("query_id").agg(F.max(hit).alias("hit"))
    return golden.select("query_id").join(per, "query_id", "left").select("query_id", F.coalesce("hit", F.lit(False)).alias("is_hit"))


def _word_text(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " ")


def claim_entailment(golden: DataFrame, found: DataFrame, k: int = fv.FINAL_K) -> DataFrame:
    """One row per sentence of the expected answer: share of its content words found in the top-k text."""
    parts = F.array_sort(F.collect_list(F.struct("rank", "content")))
    context = found.filter(F.col("rank") <= k).groupBy("query_id").agg(
        _word_text(F.array_join(F.transform(parts, lambda r: r["content"]), " ")).alias("context")
    )
    pieces = F.filter(F.transform(F.split("expected_answer", r"\. "), strip), lambda s: s != "")
    claims = golden.select("query_id", F.posexplode(pieces).alias("claim_no", "claim"))
    stop = fv.ENTAILMENT_STOP_WORDS
    content = F.filter(words(_word_text(F.col("claim"))), lambda w: (F.length(w) > 1) & ~w.isin(stop))
    joined = claims.withColumn("w", content).join(context, "query_id", "left")
    text = F.coalesce("context", F.lit(""))
    ratio = F.when(F.size("w") == 0, 1.0).otherwise(F.size(F.filter("w", lambda w: F.contains(text, w))) / F.size("w"))
    return joined.select("query_id", "claim_no", ratio.alias("ratio")).withColumn("entailed", F.col("ratio") >= fv.ENTAILMENT_RATIO)


def citations_valid(golden: DataFrame, found: DataFrame) -> DataFrame:
    """Per question whether its first chunk names an expected entity; none expected counts, no chunk does not."""
    first = found.filter(F.col("rank") == 1).select("query_id", F.lower("content").alias("first"))
    joined = golden.join(first, "query_id", "left")
    ok = F.col("first").isNotNull() & ((F.size("expected_entities") <= 0) | _names_in(F.col("first"), F.col("expected_entities")))
    return joined.select("query_id", F.coalesce(ok, F.lit(False)).alias("is_valid"))


def _share(flag: str) -> Column:
    n = F.count(F.lit(1))
    return F.round(F.count_if(F.col(flag)) / F.greatest(F.lit(1), n), 4)


def hit_rate(hits: DataFrame) -> DataFrame:
    return hits.agg(_share("is_hit").alias("hit_rate"), F.count(F.lit(1)).alias("n_questions"))


def faithfulness(entailment: DataFrame) -> DataFrame:
    return entailment.agg(_share("entailed").alias("faithfulness"), F.count(F.lit(1)).alias("n_claims"))


def citation_accuracy(valid: DataFrame) -> DataFrame:
    return valid.agg(_share("is_valid").alias("citation_accuracy"), F.count(F.lit(1)).alias("n_questions"))


def eval_details(golden: DataFrame, found: DataFrame, gate: DataFrame, first: int | None = None) -> DataFrame:
    """Per question: hit, best score, claims and entailed claims; ``first`` keeps a report's head."""
    claims = claim_entailment(golden, found).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_claims"), F.count_if("entailed").alias("n_entailed")
    )
    out = (
        hits_at_k(golden, found)
        .join(gate.select("query_id", "best_score"), "query_id", "left")
        .join(claims, "query_id", "left")
        .select("query_id", "is_hit", "best_score", F.coalesce("n_claims", F.lit(0)).alias("n_claims"), F.coalesce("n_entailed", F.lit(0)).alias("n_entailed"))
    )
    return out if first is None else out.orderBy("query_id").limit(first)


def benchmark_run(golden: DataFrame, found: DataFrame, run_id: str, models: dict[str, str] | None = None) -> DataFrame:
    """One row of run history from the three measures."""
    one = (
        hit_rate(hits_at_k(golden, found)).select(F.col("n_questions").alias("total_samples"), "hit_rate", F.lit(1).alias("_"))
        .join(faithfulness(claim_entailment(golden, found)).select("faithfulness", F.lit(1).alias("_")), "_")
        .join(citation_accuracy(citations_valid(golden, found)).select("citation_accuracy", F.lit(1).alias("_")), "_")
    )
    extra = [F.lit(v).alias(k) for k, v in (models or {}).items()]
    return one.select(F.lit(run_id).alias("run_id"), F.current_timestamp().alias("ran_at"), "total_samples", "hit_rate", "faithfulness", "citation_accuracy", *extra)


def run_deltas(runs: DataFrame, order: str, metrics: list[str]) -> DataFrame:
    """Each run's change of every metric against the run before it, 0.0 for the first.

    The history is range-partitioned on its order. Each part looks back inside itself, and
    the last row of a part (one summary row per part) serves the first row of the next, so
    no task sees the whole history.
    """
    parted = runs.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    parted = written(parted)  # both reads below must see the same parts
    inside = Window.partitionBy("_part").orderBy(order)
    row = F.struct(*metrics)
    looked = parted.withColumn("_prev", F.lag(row).over(inside))
    ends = parted.groupBy("_part").agg(F.max_by(row, order).alias("_end"))
    before = ends.select("_part", F.lag("_end").over(Window.orderBy("_part")).alias("_carry"))
    joined = looked.join(F.broadcast(before), "_part", "left").withColumn("_prev", F.coalesce("_prev", "_carry"))
    deltas = [F.coalesce(F.round(F.col(m) - F.col(f"_prev.{m}"), 4), F.lit(0.0)).alias(f"delta_{m}") for m in metrics]
    return joined.select(*runs.columns, *deltas)


def eval_summary(runs: DataFrame, golden: DataFrame, order: str, metrics: list[str]) -> DataFrame:
    """One row: latest run, number of runs, size of the golden set, whether any run exists."""
    latest = runs.agg(F.max_by(F.struct(order, *metrics), order).alias("r"), F.count(F.lit(1)).alias("total_runs"))
    n = golden.agg(F.count(F.lit(1)).alias("n")).scalar()
    return latest.select((F.col("total_runs") > 0).alias("has_runs"), "total_runs", n.alias("golden_count"), "r.*")
