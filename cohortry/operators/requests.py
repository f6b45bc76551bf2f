"""Audits of a question log: screening, repeats, admission."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.functions.text import question_key
from cohortry.sources.tables import settle

# Phrases that mark an attempt to redirect the answering system.
INJECTION_PATTERNS = (
    r"ignore (all |the )?previous",
    r"disregard (all |the )?(previous|above)",
    r"system prompt",
    r"reveal your (instructions|prompt)",
    r"you are now",
    r"act as",
    r"jailbreak",
)

# Words that mark a question as one about these metrics.
DOMAIN_WORDS = (
    "acquired", "acquisition", "adjusted", "adopted", "adoption", "card", "cohort", "conversion", "credit", "funnel",
    "metric", "msa", "rate", "retain", "retention", "segment", "segmento", "size", "time", "vintage", "window",
)

LENGTH_CAP = 500


def screen_text(
    df: DataFrame,
    column: str,
    vocabulary: Iterable[str] = DOMAIN_WORDS,
    patterns: Sequence[str] = INJECTION_PATTERNS,
    cap: int = LENGTH_CAP,
) -> DataFrame:
    """Adds ``screen``: too_long, injection, off_topic or on_topic, tested in this order.

    Words are runs of a-z; one of them must be in the vocabulary. A projection over whole texts.
    """
    words = sorted(vocabulary)
    if not all(re.fullmatch("[a-z]+", w) for w in words):
        raise ValueError("vocabulary words are runs of a-z")
    text = F.lower(column)
    suspicious = "|".join(f"(?:{p})" for p in patterns)
    known_word = f"(?<![a-z])(?:{'|'.join(words)})(?![a-z])"
    screen = (
        F.when(F.length(column) > cap, F.lit("too_long"))
        .when(text.rlike(suspicious), F.lit("injection"))
        .when(text.rlike(known_word), F.lit("on_topic"))
        .otherwise(F.lit("off_topic"))
    )
    return df.withColumn("screen", screen)


def mark_repeats(df: DataFrame, column: str, arrival: Sequence[str]) -> DataFrame:
    """Adds ``question_key`` (a digest of the normalised text) and ``is_repeat``.

    ``arrival`` orders the rows and identifies each; NULL is a value like any other and comes first. The
    first arrival per key is found by a combining aggregate and joined back on the arrival columns, which
    are unique: a question asked a billion times is neither gathered in one group nor a hot join key. Keys
    are computed once, in a narrow table that both sides of that join read.
    """
    names = [f"_arrival_{i}" for i in range(len(arrival))]
    keyed = settle(df.select(*[F.col(a).alias(n) for a, n in zip(arrival, names, strict=True)], F.sha2(question_key(F.col(column)), 256).alias("question_key")))
    first = keyed.groupBy("question_key").agg(F.min(F.struct(*names)).alias("first"))
    firsts = first.select(*[F.col(f"first.{n}").alias(f"{n}_first") for n in names], F.lit(True).alias("_first"))
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{n}_first")) for n in names])
    marks = keyed.join(firsts, same, "left").select(*names, "question_key", F.col("_first").isNull().alias("is_repeat"))
    if list(df.columns) == list(arrival):
        return marks.select(*[F.col(n).alias(a) for n, a in zip(names, arrival, strict=True)], "question_key", "is_repeat")
    back = reduce(lambda a, b: a & b, [df[a].eqNullSafe(F.col(n)) for a, n in zip(arrival, names, strict=True)])
    return df.join(marks, back).select(*[df[c] for c in df.columns], "question_key", "is_repeat")


# parts into which every client and bucket is split while its first requests are found
SPREAD = 64


def bucket_start(df: DataFrame, ts: str, bucket: str) -> Column:
    """Start of the time bucket, aligned to the epoch; NULL where there is no time."""
    epoch = "timestamp_ntz'1970-01-01'" if isinstance(df.schema[ts].dataType, T.TimestampNTZType) else "timestamp_seconds(0)"
    length = f"timestampdiff(MICROSECOND, timestamp_seconds(0), timestamp_seconds(0) + interval {bucket})"
    into = f"pmod(timestampdiff(MICROSECOND, {epoch}, `{ts}`), {length})"
    return F.expr(f"`{ts}` - make_dt_interval(0, 0, 0, cast({into} / 1000000d as decimal(18, 6)))")


def first_of_each(df: DataFrame, keys: Sequence[str], arrival: Sequence[str], cap: int) -> DataFrame:
    """The first ``cap`` rows of every key by arrival.

    Each key is split into parts by a hash of its rows; a part ranks its own and passes on at most
    ``cap`` of them, so a key that holds most rows is never ranked as a whole.
    """
    part = F.pmod(F.xxhash64(*arrival), F.lit(SPREAD)).alias("_part")
    split = df.select("*", part)
    for by in ([*keys, "_part"], keys):
        rank = F.row_number().over(W.partitionBy(*by).orderBy(*arrival))
        split = split.withColumn("_rank", rank).filter(F.col("_rank") <= cap).drop("_rank")
    return split.drop("_part")


def admitted_requests(
    df: DataFrame, ts: str, request: str, client: str, bucket: str, per_client: int, global_cap: int
) -> DataFrame:
    """Requests let through: per bucket the first ``per_client`` of every client, and of these the
    first ``global_cap``. A refused request uses up nothing. Requests without a time are not let through.
    """
    slots = df.withColumn("bucket", bucket_start(df, ts, bucket)).filter(F.col("bucket").isNotNull())
    within_client = first_of_each(slots, ["bucket", client], [ts, request], per_client)
    return first_of_each(within_client, ["bucket"], [ts, request], global_cap)


def admission(
    df: DataFrame, ts: str, request: str, client: str, bucket: str, per_client: int, global_cap: int
) -> DataFrame:
    """The whole log with its ``bucket`` and whether each request was ``admitted``.

    Buckets are aligned to the epoch; ``request`` identifies a row. A request without a time has no
    bucket and is not admitted. The admitted set holds at most ``global_cap`` rows per bucket; its
    measured size decides how it is joined back.
    """
    passed = admitted_requests(df.select(ts, request, client), ts, request, client, bucket, per_client, global_cap)
    marks = passed.select(request, F.lit(True).alias("_passed"))
    return df.join(marks, request, "left").select(
        *df.columns, bucket_start(df, ts, bucket).alias("bucket"), F.col("_passed").isNotNull().alias("admitted")
    )


def client_counts(df: DataFrame, ts: str, client: str, bucket: str) -> DataFrame:
    """(bucket, client, n) of the requests that have a time."""
    timed = df.filter(F.col(ts).isNotNull())
    return timed.groupBy(bucket_start(df, ts, bucket).alias("bucket"), F.col(client).alias("client")).agg(F.count("*").alias("n"))


def counts_per_bucket(clients: DataFrame, per_client: int, global_cap: int) -> DataFrame:
    """Per bucket: requests, those within the client cap, and those admitted. Counts only, no ranks."""
    within = F.sum(F.least("n", F.lit(per_client).cast("bigint")))
    return clients.groupBy("bucket").agg(
        F.sum("n").alias("requests"),
        within.alias("within_client_cap"),
        F.least(within, F.lit(global_cap).cast("bigint")).alias("admitted"),
    )


def admission_counts(
    df: DataFrame, ts: str, client: str, bucket: str, per_client: int, global_cap: int
) -> DataFrame:
    """``counts_per_bucket`` of a whole log."""
    return counts_per_bucket(client_counts(df, ts, client, bucket), per_client, global_cap)
