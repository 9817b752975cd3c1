"""Optional review of contested pairs by a judge, with votes and a verdict table."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unpaired.functions.hashing import hash52
from unpaired.functions.numeric import rounded

VERDICTS = ("safe_negative", "suspected_false_negative", "uncertain")
VOTES = 5
VOTE_SCHEMA = "u string, v string, vote_no int, verdict string, confidence double, rationale string, evidence array<string>"
CARD_SCHEMA = "verdict string, confidence double, rationale string, evidence array<string>"


@dataclass(frozen=True)
class JudgeConfig:
    """Who judges, and how patiently; a provider plug-in reads it."""

    provider: str = "offline"
    model: str = "offline"
    votes: int = VOTES
    timeout_s: float = 60.0
    retries: int = 3
    at_once: int = 8

    def backoff(self, attempt: int) -> float:
        return min(2.0 * 2**attempt, 15.0)


class Judge(Protocol):
    def judge(self, pairs: DataFrame) -> DataFrame:
        """Votes (``VOTE_SCHEMA``) on pairs (u, v, ...); a pair may lack votes."""


class OfflineJudge:
    """Deterministic votes by hash, in proportion to the pair's ``confidence``."""

    def __init__(self, config: JudgeConfig = JudgeConfig(), seed: int = 0) -> None:
        self.config, self.seed = config, seed

    def judge(self, pairs: DataFrame) -> DataFrame:
        votes = pairs.select("u", "v", "confidence", F.explode(F.sequence(F.lit(0), F.lit(self.config.votes - 1))).alias("vote_no"))
        draw = hash52(self.seed, F.col("u"), F.col("v"), F.col("vote_no")) % 1000 / 1000.0
        verdict = F.when(draw < F.col("confidence") * 0.8, VERDICTS[0]).when(draw < F.col("confidence") * 0.8 + 0.1, VERDICTS[2]).otherwise(VERDICTS[1])
        said = rounded(0.5 + draw / 2)
        return votes.select("u", "v", "vote_no", verdict.alias("verdict"), said.alias("confidence"), F.lit("offline").alias("rationale"), F.array().cast("array<string>").alias("evidence"))


def prompt(fields: dict[str, Column]) -> Column:
    """The question put to a judge about a pair, from what is known of it; unknown fields are left out."""
    known = F.filter(F.array(*[F.when(c.isNotNull(), F.concat(F.lit(f"- {name}: "), c.cast("string"))) for name, c in fields.items()]), lambda x: x.isNotNull())
    context = F.when(F.size(known) > 0, F.concat(F.lit("What is known of them:\n"), F.array_join(known, "\n"), F.lit("\n"))).otherwise("")
    verdicts = ", ".join(f'"{v}"' for v in VERDICTS)
    return F.concat(
        F.lit("Two entities are proposed as a pair that does not interact: "), F.col("u"), F.lit(" and "), F.col("v"), F.lit(".\n"), context,
        F.lit(f"Say whether they can serve as a negative. Answer with one JSON object: verdict (one of {verdicts}), confidence (0 to 1), rationale, evidence (a list of strings)."),
    )


#: Columns of a described pair and what a prompt calls them.
TOLD = {"name_u": "name of the first", "name_v": "name of the second", "t_u": "type of the first", "t_v": "type of the second", "k_u": "known partners of the first", "k_v": "known partners of the second", "confidence": "confidence so far"}


class CallableJudge:
    """A judge made of a Python function that answers a dict with text.

    The dict has the pair's columns, ``vote_no`` and ``prompt`` (:func:`prompt`). A batch is asked
    by ``at_once`` threads; a call that fails or takes longer than ``timeout_s`` is tried again
    after a pause (``retries`` times), and then leaves its vote out.
    """

    def __init__(self, ask: Callable[[dict], str], votes: int = VOTES, config: JudgeConfig | None = None) -> None:
        self.ask, self.config = ask, replace(config or JudgeConfig(provider="callable", model="callable"), votes=votes)
        self.votes = votes

    def judge(self, pairs: DataFrame) -> DataFrame:
        ask, config = self.ask, self.config

        def patient(row: dict) -> str | None:
            for attempt in range(config.retries + 1):
                if attempt:
                    time.sleep(config.backoff(attempt - 1))
                answer: list[str] = []
                call = threading.Thread(target=lambda a=answer: a.append(_quiet(ask, row)), daemon=True)
                call.start()
                call.join(config.timeout_s)
                if answer and answer[0] is not None:
                    return answer[0]
            return None

        def reply(batches):
            with ThreadPoolExecutor(config.at_once) as pool:
                for rows in batches:
                    yield rows[["u", "v", "vote_no"]].assign(reply=list(pool.map(patient, rows.to_dict("records"))))

        asked = pairs.withColumn("prompt", prompt({what: F.col(c) for c, what in TOLD.items() if c in pairs.columns}))
        asked = asked.withColumn("vote_no", F.explode(F.sequence(F.lit(0), F.lit(self.votes - 1))))
        replies = asked.mapInPandas(reply, "u string, v string, vote_no int, reply string")
        card = parse_card(F.col("reply"))
        return replies.select("u", "v", "vote_no", card.alias("c")).where("c.verdict is not null").select("u", "v", "vote_no", "c.*")


def _quiet(ask: Callable[[dict], str], row: dict) -> str | None:
    try:
        return ask(row)
    except Exception:  # noqa: BLE001  a provider's failure is tried again, then an abstention
        return None


def extract_json(reply: Column) -> Column:
    """The JSON text of a reply: all of it, a fenced block, or the outermost braces."""
    whole = F.when(F.trim(reply).startswith("{") & F.trim(reply).endswith("}"), F.trim(reply))
    fenced = F.nullif(F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.coalesce(whole, fenced, braces)


def parse_card(reply: Column) -> Column:
    """A card from a reply: unknown verdicts are ``uncertain``, a missing confidence 0; null without JSON."""
    found = F.from_json(extract_json(reply), CARD_SCHEMA)
    known = F.when(found["verdict"].isin(*VERDICTS), found["verdict"]).otherwise(VERDICTS[2])
    card = F.struct(known.alias("verdict"), F.coalesce(found["confidence"], F.lit(0.0)).alias("confidence"), F.coalesce(found["rationale"], F.lit("")).alias("rationale"), F.coalesce(found["evidence"], F.array().cast("array<string>")).alias("evidence"))
    return F.when(extract_json(reply).isNotNull(), card)


def majority(votes: DataFrame) -> DataFrame:
    """One card for each pair: the verdict with most votes, its mean confidence, and the agreement.

    A tie is ``uncertain`` (confidence 0.5 if nobody voted so). The most confident vote
    of the winning verdict gives rationale and evidence.
    """
    by = votes.groupBy("u", "v", "verdict").agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean"), F.max_by(F.struct("rationale", "evidence"), F.struct("confidence", (-F.col("vote_no")).alias("o"))).alias("said")
    )
    all_ = by.groupBy("u", "v").agg(F.sum("n").alias("n_votes"), F.max("n").alias("_top"), F.collect_list(F.struct("verdict", "n", "mean", "said")).alias("_by"))
    best = F.filter("_by", lambda x: x["n"] == F.col("_top"))
    unsure = F.filter("_by", lambda x: x["verdict"] == VERDICTS[2])
    won = F.when(F.size(best) == 1, best[0]["verdict"]).otherwise(VERDICTS[2])
    mine = F.when(F.size(best) == 1, best).otherwise(unsure)
    return all_.select(
        "u", "v", won.alias("verdict"),
        rounded(F.coalesce(F.get(mine, F.lit(0))["mean"], F.lit(0.5))).alias("confidence"),
        F.coalesce(F.get(mine, F.lit(0))["said"]["rationale"], F.lit("")).alias("rationale"),
        F.coalesce(F.get(mine, F.lit(0))["said"]["evidence"], F.array().cast("array<string>")).alias("evidence"),
        F.col("n_votes"),
        rounded(F.coalesce(F.get(mine, F.lit(0))["n"], F.lit(0)) / F.col("n_votes"), 3).alias("agreement"),
        F.map_from_arrays(F.transform("_by", lambda x: x["verdict"]), F.transform("_by", lambda x: x["n"])).alias("vote_counts"),
    )


def card_value(verdict: Column, confidence: Column) -> Column:
    """A verdict as a stream value: null if uncertain."""
    return F.when(verdict == VERDICTS[0], confidence).when(verdict == VERDICTS[1], 1 - confidence)


def feature_key(*parts: Column) -> Column:
    """Cache key: SHA-1 of the JSON of everything the judge sees (ends sorted)."""
    return F.sha1(F.to_json(F.struct(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"), *parts)).cast("binary"))


def verdict_histogram(cards: DataFrame) -> DataFrame:
    return cards.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
