"""Quality rules with host-level verdicts, built from DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, checked, materialize, spread

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW_WORDS = 10, 20, 5
#: A host is rejected if its shrunken failure rate is above this.
MAX_HOST_RATE = 0.5
#: Bounds of the prior's strength, in documents.
LEAST_PRIOR, MOST_PRIOR = 1.0, 1e6
BASE = ["word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def word_array(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null: none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to ``docs``.

    A null or empty text has no words, so it fails; columns of ``docs`` with one of these names are replaced.
    Windows of five words are compared by two 64-bit hashes, and sorted with their positions only in texts where the
    first hash repeats, so the cost stays near linear in the text's length.
    """
    body, tail = F.col(f"`{text}`"), WINDOW_WORDS - 1
    made = ["n_words", *BASE, "base_failed"]
    df = docs.drop(*[c for c in made if c != text]).withColumn("__w", word_array(body))
    window = lambda i, step: [F.col("__w")[i + (k if step > 0 else tail - k)] for k in range(WINDOW_WORDS)]
    df = df.withColumn("__g", F.when(F.size("__w") > tail, F.transform(F.sequence(F.lit(0), F.size("__w") - F.lit(WINDOW_WORDS)), lambda i: F.xxhash64(*window(i, 1)))).otherwise(F.array().cast("array<bigint>")))
    twice = F.size(F.array_distinct("__g")) < F.size("__g")
    df = df.withColumn("__s", F.when(twice, F.sort_array(F.transform("__g", lambda h, i: F.struct(h.alias("h"), F.xxhash64(*window(i, -1)).alias("h2"), i.alias("i"))))))
    same = lambda x, y: (x["h"] == y["h"]) & (x["h2"] == y["h2"])
    df = df.withColumn("__p", F.sort_array(F.transform(F.filter("__s", lambda x, j: same(x, F.get("__s", j - 1)) | same(x, F.get("__s", j + 1))), lambda x: x["i"])))
    covered = F.aggregate(F.transform("__p", lambda p, j: F.least(F.lit(WINDOW_WORDS), F.coalesce(F.get("__p", j + 1) - p, F.lit(WINDOW_WORDS))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    lines = F.filter(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    df = df.withColumn("__l", lines)
    df = df.withColumns({
        "n_words": F.size("__w").cast("long"), "word_chars": F.length(F.array_join("__w", "")).cast("long"), "n_symbols": F.coalesce(F.regexp_count(body, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"), "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    }).drop("__w", "__g", "__s", "__p", "__l")
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_rates(flagged: DataFrame, host: str, failed: str) -> DataFrame:
    """Per host (null: one of its own): n, fails and the failure rate shrunk towards an empirical beta prior.

    The prior's mean is the overall rate; its strength follows from the variance of the host rates beyond what
    sampling alone gives. Only four scalars of the host table come to the driver.
    """
    hosts = materialize(flagged.groupBy(F.col(f"`{host}`").alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(failed).cast("long")).alias("fails")), "hosts")
    k, n, fails = hosts.agg(F.count(F.lit(1)), F.sum("n"), F.sum("fails")).first()
    mean = fails / n if n else 0.0
    spread = hosts.agg(F.sum(F.col("n") * (F.col("fails") / F.col("n") - F.lit(mean)) ** 2)).first()[0] or 0.0
    between = spread / n - mean * (1 - mean) * (k - 1) / n if n else 0.0
    strength = min(MOST_PRIOR, max(LEAST_PRIOR, mean * (1 - mean) / between - 1)) if between > 0 else MOST_PRIOR
    return hosts.withColumn("rate", (F.col("fails") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength)))


def judge(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """``docs`` without its text, with the measures, base_failed, host_rate and kept.

    kept is false if base_failed, else true unless the host's shrunken rate is above MAX_HOST_RATE. Repeated rows are
    judged one by one; an empty table gives an empty table.
    """
    feats = materialize(measure(spread(docs), text).drop(text), "quality")
    rates = host_rates(feats, host, "base_failed").select(F.col("host").alias("__host"), F.col("rate").alias("host_rate"))
    joined = feats.drop("host_rate", "kept").join(checked(rates), F.col(f"`{host}`").eqNullSafe(F.col("__host")), "left").drop("__host")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= MAX_HOST_RATE))


def keep_good(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules and the host verdicts keep, with the columns of ``docs``.

    The measures are taken once: survivors are written with their texts, failures with the host only.
    """
    taken = measure(spread(docs).withColumn("__text", F.col(f"`{text}`")).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "__text", F.col(f"`{host}`").alias("__host")), "__text")
    table = materialize(taken.select(F.when(~F.col("base_failed"), F.col("__row")).alias("__row"), "__host", F.col("base_failed").alias("__failed")), "quality")
    bad = host_rates(table, "__host", "__failed").filter(F.col("rate") > MAX_HOST_RATE).select(F.col("host").alias("__bad"))
    return table.filter(~F.col("__failed")).join(checked(bad), F.col("__host").eqNullSafe(F.col("__bad")), "left_anti").select("__row.*")
