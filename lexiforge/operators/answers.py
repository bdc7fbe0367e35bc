"""From questions to judged answers: the message to the answerer, a dry run, and the run itself as one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.mathtext import cost
from lexiforge.functions.text import REFUSAL
from lexiforge.operators.context import checked_answers
from lexiforge.operators.evaluate import auto_checks
from lexiforge.operators.service import verdicts

#: What is said of the collections that are searched; nothing is said of the core alone.
SCOPE = {
    ("user",): "Scope: documents the user uploaded (ids u01, u02, ...), not the 19 core papers.",
    ("core", "user"): "Scope: the 19 core papers plus documents the user uploaded (ids u..).",
}
#: What a dry run answers and costs.
DRY_REFUSAL, DRY_VERDICT = f"{REFUSAL} It covers related topics.", '{"correctness": 2, "faithfulness": 2, "reason": "dry run"}'
DRY_TOKENS, DRY_JUDGE_IN = (4500, 350), 5000
VERDICT = "correctness int, faithfulness int, reason string"

Step = Callable[[DataFrame], DataFrame]


def scope_note(collections: Column) -> Column:
    """What is said of an array of collections; null and empty mean the core."""
    given, note = F.array_sort(F.coalesce(collections, F.array().cast("array<string>"))), F.lit(None).cast("string")
    for names, said in SCOPE.items():
        note = F.when(given == F.array(*map(F.lit, names)), said).otherwise(note)
    return note


def messages(asked: DataFrame) -> DataFrame:
    """asked(question, context, collections, …) with message, as an answerer gets it."""
    head = F.coalesce(F.concat(scope_note(F.col("collections")), F.lit("\n\n")), F.lit(""))
    return asked.withColumn("message", F.concat(head, F.lit("Passages:\n\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), F.col("question")))


def dry_answers(asked: DataFrame) -> DataFrame:
    """asked(type, gold, …) with text, tokens_in and tokens_out: the expected answer, or a refusal where there is none."""
    text = F.when(F.col("type") == "unanswerable", DRY_REFUSAL).otherwise(F.concat("gold", F.lit(" [1]")))
    return asked.withColumns({"text": text, "tokens_in": F.lit(DRY_TOKENS[0]), "tokens_out": F.lit(DRY_TOKENS[1])})


def dry_verdicts(answered: DataFrame) -> DataFrame:
    """answered with verdict, judge_in and judge_out."""
    return answered.withColumns({"verdict": F.lit(DRY_VERDICT), "judge_in": F.lit(DRY_JUDGE_IN), "judge_out": F.lit(150)})


def run(asked: DataFrame, prices: dict[str, tuple[float, float]], answer: Step = dry_answers, judge: Step | None = dry_verdicts, model: str = "dry", judge_model: str = "dry") -> DataFrame:
    """asked(qid, type, question, gold, context, collections, n_passages, must_include, no_metric) answered, checked, judged and priced, a row for a question.

    answer adds text, tokens_in and tokens_out; judge adds verdict (JSON), judge_in and judge_out. A verdict that can't be read
    leaves its reason in error and no scores; without a judge they are null.
    """
    rows = auto_checks(checked_answers(answer(messages(asked))))
    price = lambda name, i, o: cost(F.lit(name), F.col(i), F.col(o), prices)
    rows = rows.withColumn("cost", price(model, "tokens_in", "tokens_out"))
    if judge is None:
        fields = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in VERDICT.split(", ")}
        return rows.withColumns({**fields, "error": F.lit(None).cast("string"), "judge_cost": F.lit(0.0)})
    judged = judge(rows).withColumn("judge_cost", price(judge_model, "judge_in", "judge_out")).withColumnsRenamed({"text": "answer", "verdict": "text"})
    return verdicts(judged, VERDICT).withColumnsRenamed({"text": "verdict", "answer": "text"})
