"""A resumable ledger of requests to an external verifier.

Requests are asked offline, in rounds, by whatever answers prompts.  The ledger has one row per
distinct prompt, however many findings share it: how often it was asked, what was answered, and
whether it is ``open``, ``answered`` or ``given up``.  A round's answers are merged as the next
version of the ledger; a round that is merged again changes nothing.  An answer that holds no
verdict counts as an attempt; after ``most_attempts`` of them a prompt is given up, and its
findings keep the heuristic's verdict.

Every step is a join on the prompt's digest; answers are reduced to one per digest first, so a
prompt that very many findings share is one row on both sides.

A prompt is a page of text and never changes, so versions of the ledger may be kept without
it: ``enrolled`` and ``merged`` take a ledger that has no ``prompt``, and ``to_ask`` then takes
the texts from where they lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve.functions import verdict as V
from credsieve.functions.text import pin
from credsieve.operators.joins import skewed_join
from credsieve.operators.verify import heuristic_verdicts, prompt_of_finding

#: Times that a prompt is asked.
MOST_ATTEMPTS = 3

VERDICT = "struct<is_real_secret: boolean, confidence: string, reasoning: string, recommendation: string>"
LEDGER = f"digest string, prompt string, attempts int, last_round int, status string, verdict {VERDICT}"
OPEN, ANSWERED, GIVEN_UP = "open", "answered", "given up"


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def with_digest(findings: DataFrame) -> DataFrame:
    """Findings of ``scan_with_code`` with the ``prompt`` that asks for them and its ``digest``."""
    return pin(findings, prompt=prompt_of_finding()).withColumn("digest", F.sha2("prompt", 256))


def enrolled(ledger: DataFrame, findings: DataFrame) -> DataFrame:
    """The ledger with a row for each prompt of the findings that it does not have."""
    texts = [F.first("prompt").alias("prompt")] if "prompt" in ledger.columns else []
    by_digest = findings.groupBy("digest")
    prompts = by_digest.agg(*texts) if texts else findings.select("digest").distinct()
    new = prompts.join(ledger.select("digest"), "digest", "left_anti")
    rows = new.selectExpr(*prompts.columns, "0 as attempts", "0 as last_round", f"'{OPEN}' as status", f"cast(null as {VERDICT}) as verdict")
    return ledger.unionByName(rows)


def to_ask(ledger: DataFrame, prompts: DataFrame | None = None) -> DataFrame:
    """(``digest``, ``prompt``) of what is still open, each prompt once.

    ``prompts`` holds the texts of a ledger that is kept without them, each digest once.
    """
    still = ledger.where(f"status = '{OPEN}'")
    return still.select("digest", "prompt") if prompts is None else prompts.select("digest", "prompt").join(still.select("digest"), "digest", "left_semi")


def merged(ledger: DataFrame, answers: DataFrame, number: int, *, most_attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """The ledger after round ``number`` (from 1) with its (``digest``, ``content``) answers.

    All that was open was asked in the round; what has no answer, or one without a verdict, was
    asked in vain.  Of several answers to one prompt the least verdict counts.  A round that a
    row has seen already leaves the row as it is.
    """
    decoded = pin(answers.select("digest", "content"), verdict=V.response("content")).where("verdict is not null")
    given = decoded.groupBy("digest").agg(F.min(F.struct("verdict.is_real_secret", "verdict.confidence", "verdict.reasoning", "verdict.recommendation")).alias("_given"))
    asked = f"status = '{OPEN}' and last_round < {number}"
    met = ledger.join(given, "digest", "left").withColumn("_asked", F.expr(asked))
    return met.selectExpr(
        *[c for c in ("digest", "prompt") if c in ledger.columns],
        "if(_asked, attempts + 1, attempts) as attempts",
        f"if(_asked, {number}, last_round) as last_round",
        f"case when not _asked then status when _given is not null then '{ANSWERED}'"
        f" when attempts + 1 >= {most_attempts} then '{GIVEN_UP}' else status end as status",
        f"cast(if(_asked, _given, verdict) as {VERDICT}) as verdict",
    )


def judged(findings: DataFrame, ledger: DataFrame) -> DataFrame:
    """Findings (with ``digest``) with the ledger's ``verdict``; the heuristic's where there is none yet or ever."""
    known = ledger.selectExpr("digest", "verdict as _given")
    own = heuristic_verdicts(skewed_join(findings, known, ["digest"], "left"))
    return own.withColumn("verdict", F.coalesce(F.col("_given"), F.col("verdict"))).drop("_given")
