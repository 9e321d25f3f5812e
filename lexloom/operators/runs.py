"""Planning of model runs and their ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions import text as T


def job_matrix(pages: DataFrame, prompts: DataFrame, models: DataFrame, repeats: int) -> DataFrame:
    """page x prompt x model x repeat with the output's name; the dimensions are small by nature."""
    m = pages.select("page").crossJoin(F.broadcast(prompts.select("prompt"))).crossJoin(F.broadcast(models.select("model")))
    m = m.select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))
    return m.withColumn("name", F.concat(T.run_name(F.col("page"), F.col("prompt"), F.col("model"), F.col("repeat")), F.lit(".xml")))


def pending(jobs: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return jobs.join(done.select(*key), key, "left_anti")


def progress(jobs: DataFrame, done: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """by..., total, done, pending."""
    d = done.select(*key).distinct().withColumn("_done", F.lit(True))
    return jobs.join(d, key, "left").groupBy(*by).agg(F.count("*").alias("total"), F.count("_done").alias("done"), (F.count("*") - F.count("_done")).alias("pending"))


def next_run_number(runs: DataFrame, combination: list[str], run: str = "run") -> DataFrame:
    """combination..., next: the smallest run number from 1 that isn't used."""
    r = runs.select(*combination, run).filter(F.col(run) >= 1).distinct()
    r = r.withColumn("n", F.row_number().over(Window.partitionBy(*combination).orderBy(run)))
    return r.groupBy(*combination).agg(F.coalesce(F.min(F.when(F.col(run) != F.col("n"), F.col("n"))), F.max("n") + 1).cast("long").alias("next"))


def planned_runs(next_: DataFrame, n: int) -> DataFrame:
    """The n consecutive run numbers from each next one."""
    return next_.select("*", F.explode(F.sequence(F.col("next"), F.col("next") + n - 1)).alias("run"))


LEDGER = "output_name string, image string, prompt string, model string, variant string, repeat int, input_tokens long, output_tokens long, cost double"


def ledger(rows: DataFrame) -> DataFrame:
    """Usage rows in the ledger's types; other columns are left out."""
    fields = [x.strip().split(" ") for x in LEDGER.split(",")]
    return rows.select(*[F.col(n).cast(t).alias(n) for n, t in fields])


def run_summary(attempts: DataFrame, by: list[str], ok: Column, error: Column) -> DataFrame:
    """by..., attempts, succeeded, errors, failed (neither)."""
    return attempts.groupBy(*by).agg(F.count("*").alias("attempts"), F.count_if(ok & ~error).alias("succeeded"), F.count_if(error).alias("errors"), F.count_if(~ok & ~error).alias("failed"))


def cost_rollup(usage: DataFrame, by: list[str], cost: str = "cost") -> DataFrame:
    """Totals at every level of by..., with the level (0: all columns given)."""
    return usage.rollup(*by).agg(F.count("*").alias("runs"), F.round(F.sum(cost), 6).alias("cost"), F.grouping_id(*by).alias("level"))


def prompt_lookup(bank: DataFrame, column: str, value: str, text: str) -> DataFrame:
    """The prompts of a work group or name."""
    return bank.filter(F.trim(column) == value).select(column, text)
