"""External models: an injectable callable on Arrow batches, a cache, validation and a fallback. The network stays off."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.model_text import clean_output, output_problems, worst

Model = Callable[[list[str]], list[str | None]]


def disabled(prompts: list[str]) -> list[str | None]:
    """The default model: no answer, so every row takes its fallback."""
    return [None] * len(prompts)


def answers(df: DataFrame, prompt: str, model: Model = disabled, parallel: int | None = None, batch: int = 32) -> DataFrame:
    """Rows with ``answer`` and ``error``; a failing batch gives errors, not an exception. ``parallel`` bounds the calls at a time."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", answer string, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                try:
                    yield part.assign(answer=model(part[prompt].tolist()), error=None)
                except Exception as e:  # one batch, not the job
                    yield part.assign(answer=None, error=f"{type(e).__name__}: {e}"[:200])

    return (df.repartition(parallel) if parallel else df).mapInPandas(run, schema)


def with_cache(df: DataFrame, cache: DataFrame, key: Column, prompt: str, model: Model = disabled) -> DataFrame:
    """Cached answers where the key is known, the model for the rest."""
    keyed = df.withColumn("cache_key", key)
    known = keyed.join(cache.select("cache_key", "answer").dropDuplicates(["cache_key"]), "cache_key").withColumn("error", F.lit(None).cast("string"))
    asked = answers(keyed.join(cache, "cache_key", "left_anti"), prompt, model)
    return known.select(*asked.columns).unionByName(asked)


def accepted(df: DataFrame, source: str, answer: str, fallback: Column) -> DataFrame:
    """Answers that pass validation, the fallback for the others, with severity and codes."""
    made = df.withColumn("_clean", clean_output(F.col(answer))).withColumn("problems", output_problems(F.col(source), F.col("_clean")))
    level = F.when(F.col(answer).isNull(), "critical").otherwise(worst(F.col("problems")))
    return made.withColumn("severity", level).withColumn("accepted", level != "critical").withColumn("output", F.when(level != "critical", F.col("_clean")).otherwise(fallback)).withColumn("codes", F.transform("problems", lambda p: p["code"])).drop("_clean", "problems")


def expression_rules(df: DataFrame, ident: list[str], text: str, rules: list[dict]) -> DataFrame:
    """Rules as data (``pattern, problem, suggestion``): one row a rule that hits."""
    hits = F.array_compact(F.array(*(F.when(F.col(text).rlike("(?iu)" + r["pattern"]), F.struct(F.lit(r.get("problem")).alias("problem"), F.lit(r.get("suggestion")).alias("suggestion"))) for r in rules)))
    return df.select(*ident, F.explode(hits).alias("x")).select(*ident, "x.*")


def prompts(df: DataFrame, instruction: Column, text: Column, language: Column) -> DataFrame:
    return df.withColumn("prompt", F.format_string("%s\n\nLanguage: %s\n\n%s", instruction, F.coalesce(language, F.lit("-")), text))
