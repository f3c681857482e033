"""URL filter: rules first, then the likelihood ratio of two character models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerbeam.llm.common import join_groups, stored

START = "\u0002"  # stands before the first character
CONTEXT = 5  # longest context in characters
GRAM = CONTEXT + 1
BROADCAST_BYTES = 128 * 1024 * 1024  # the table of log-ratios is copied up to this size
_GRAM_BYTES = 150  # what a row of that table costs in a map of texts
STRENGTH = 4.0  # how many sightings a context needs to outweigh the next shorter one
HELD_BACK = "012"  # first MD5 digits of the URLs that calibrate instead of being counted
STEPS = 100  # thresholds tried per nat


@dataclass(frozen=True)
class Rule:
    """A decision for a host with its subdomains, below a path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host follows the first ``://`` and ends at ``/``, ``?``, ``#`` or the end; the
    path runs on to ``?``, ``#`` or the end. Without ``://``, or for NULL, both are empty."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    address = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    host = F.substring_index(address, "/", 1)
    path = F.substring(address, F.length(host) + 1, F.length(address))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct of name and verdict, or NULL."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(
            path, F.lit(rule.path)
        )
        found = F.when(
            fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        ).otherwise(found)
    return found


def model_text(url: Column) -> Column:
    """What the models read: the URL behind its scheme, A-Z lower-cased."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(url)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(rest, upper, upper.lower())


def _grams(text: Column) -> Column:
    padded = F.concat(F.lit(START * CONTEXT), text)
    starts = F.sequence(F.lit(1), F.length(text))
    return F.when(
        F.length(text) > 0, F.transform(starts, lambda i: F.substring(padded, i, F.lit(GRAM)))
    )


def _counts(urls: DataFrame) -> DataFrame:
    """How often each gram occurs at all (``seen``) and in counted URLs of either class."""
    counted = F.when(~F.col("held_back"), F.col("label"))
    return (
        urls.select(counted.alias("label"), F.explode(_grams(F.col("text"))).alias("gram"))
        .groupBy("gram")
        .agg(
            F.count("*").alias("seen"),
            F.count_if(F.col("label") == 1).alias("accepted"),
            F.count_if(F.col("label") == 0).alias("rejected"),
        )
    )


def _log_ratios(counts: DataFrame) -> DataFrame:
    """Each gram's log probability under the accepted model less that under the rejected.

    ``p_k(c | context) = (n(context c) + STRENGTH p_(k-1)(c | shorter context)) /
    (n(context) + STRENGTH)``, up to ``CONTEXT`` characters of context and down to the uniform
    distribution over all characters that occur, and one more.

    ``counts`` is a stored table. The shortest strings come first; those with one character
    more are joined to their context and to their shorter end. A key of such a join has at
    most one row per character, so none is hot however many grams there are.
    """
    sides = ("accepted", "rejected")

    def summed(first: int, length: int, *prefix: str) -> DataFrame:
        return counts.groupBy(F.substring("gram", first, length).alias(prefix[0])).agg(
            *(F.sum(side).alias(prefix[1] + side) for side in sides)
        )

    letters = summed(GRAM, 1, "string", "n_")
    total = letters.agg(
        *(F.coalesce(F.sum(f"n_{side}"), F.lit(0)).alias(f"all_{side}") for side in sides),
        (F.count("*") + 1).alias("characters"),
        F.lit(1).alias("one"),
    )
    known = letters.join(F.broadcast(total), F.lit(1) == F.col("one")).select(
        F.col("string").alias("end"),
        *(
            ((F.col(f"n_{s}") + F.lit(STRENGTH) / F.col("characters"))
             / (F.col(f"all_{s}") + STRENGTH)).alias(f"p_{s}")
            for s in sides
        ),
    )
    for k in range(1, CONTEXT + 1):
        at = GRAM - k
        longer = counts.select(F.col("gram").alias("string"), *(F.col(s).alias(f"n_{s}") for s in sides))
        if k < CONTEXT:
            longer = summed(at, k + 1, "string", "n_")
        known = (
            longer.withColumn("context", F.substring("string", 1, k))
            .withColumn("end", F.substring("string", 2, k))
            .join(summed(at, k, "context", "all_"), "context")
            .join(known, "end")
            .select(
                F.col("string").alias("end"),
                *(
                    ((F.col(f"n_{s}") + STRENGTH * F.col(f"p_{s}"))
                     / (F.col(f"all_{s}") + STRENGTH)).alias(f"p_{s}")
                    for s in sides
                ),
            )
        )
    return known.select(
        F.col("end").alias("gram"), (F.log("p_accepted") - F.log("p_rejected")).alias("log_ratio")
    )


def _scored(urls: DataFrame, ratios: DataFrame, broadcast_bytes: int) -> DataFrame:
    """``urls`` with the mean log-ratio of their grams.

    The table of ratios is copied to the executors while its measured size allows, and no gram
    is shuffled then. Otherwise only grams so frequent that they would crowd one task are
    copied; the others are shuffled with the number of their URL.
    """
    mean = F.round(F.avg("log_ratio"), 6).alias("score")
    if ratios.count() * _GRAM_BYTES <= broadcast_bytes:
        grams = urls.select("*", F.explode(_grams(F.col("text"))).alias("gram"))
        return (
            grams.join(F.broadcast(ratios), "gram")
            .groupBy("number", "text", "label", "held_back", "pages")
            .agg(mean)
        )
    grams = urls.select("number", F.explode(_grams(F.col("text"))).alias("gram"))
    scores = join_groups(grams, ratios, ["gram"], "seen").groupBy("number").agg(mean)
    return urls.join(scores, "number")


def _threshold(scored: DataFrame) -> DataFrame:
    """The threshold with the fewest wrong decisions, each class weighing the same.

    Held-back URLs are counted per step of the score, a few thousand numbers whatever the
    size of the data. Ties go to the threshold nearest zero, then the smaller. Without
    held-back URLs of both classes it is zero.
    """
    step = F.floor(F.col("score") * STEPS).cast("int")
    steps = (
        scored.filter("held_back")
        .select(F.greatest(F.least(step, F.lit(20 * STEPS)), F.lit(-20 * STEPS)).alias("step"),
                "label")
        .groupBy("step")
        .agg(
            F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("bad"),
        )
    )
    below = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy(F.lit(1))
    wrong = F.coalesce(F.sum("good").over(below), F.lit(0)) / F.sum("good").over(everywhere) + (
        F.sum("bad").over(everywhere) - F.coalesce(F.sum("bad").over(below), F.lit(0))
    ) / F.sum("bad").over(everywhere)
    usable = (F.sum("good").over(everywhere) > 0) & (F.sum("bad").over(everywhere) > 0)
    best = (
        steps.select("step", F.when(usable, F.round(wrong, 9)).alias("wrong"))
        .filter("wrong IS NOT NULL")
        .agg(F.min(F.struct("wrong", F.abs("step").alias("far"), "step")).alias("best"))
    )
    return best.select(
        F.coalesce(F.col("best.step") / F.lit(float(STEPS)), F.lit(0.0)).alias("threshold"),
        F.lit(1).alias("one"),
    )


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Allow or block each row of ``pages`` (page_id, url).

    The longest fitting rule decides. URLs that the rules allow are the examples of the
    accepted model, those they block of the rejected one. All other URLs are allowed if
    the difference of the two models' mean log-likelihood per character, rounded to
    six places, reaches a threshold calibrated on labelled URLs that were not counted.

    The models tell all characters apart and look at up to ``CONTEXT`` characters before each.
    Counts cover all URLs; equal ones are merged first and count once. One threshold is
    broadcast, and the log-ratios of all sequences of ``GRAM`` characters while they are
    measured to take at most ``broadcast_bytes``; beyond that they are joined by a shuffle, with
    the same result. A URL of many rows is joined to its score without a shuffle of these
    rows. No Python runs: everything is an expression.

    Returned: page_id, host, path, rule (NULL if the models decided), verdict, score
    (NULL if a rule decided or there is no text). A NULL url, or one without ``://``, has
    neither host nor path, so no rule fits it. A URL without text scores as 0. Repeated
    rows are judged one by one. Other columns are not read, whatever their names.
    """
    host, path = host_and_path(pages["url"])
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn(
        "match", matching_rule(F.col("host"), F.col("path"), rules)
    )
    label = F.when(F.col("match.verdict") == "allow", 1).when(
        F.col("match.verdict") == "block", 0
    )
    text = model_text(F.col("url"))
    urls = stored(
        judged.select(text.alias("text"), label.alias("label"))
        .filter("text <> ''")
        .groupBy("text", "label")
        .agg(F.count("*").alias("pages"))
        .withColumn("held_back", F.col("label").isNotNull()
                    & F.substring(F.md5("text"), 1, 1).isin(*HELD_BACK))
        .withColumn("number", F.monotonically_increasing_id())
    )
    counts = stored(_counts(urls))
    ratios = stored(_log_ratios(counts).join(counts.select("gram", "seen"), "gram"))
    scored = stored(_scored(urls.filter("label IS NULL OR held_back"), ratios, broadcast_bytes))
    open_rows = judged.filter("match IS NULL").withColumn("text", text)
    without_text = open_rows.filter("text = ''").withColumn("score", F.lit(None).cast("double"))
    scores = scored.filter("label IS NULL").select("text", "pages", "score")
    with_text = join_groups(open_rows.filter("text <> ''"), scores, ["text"], "pages")
    asked = with_text.drop("pages").unionByName(without_text).join(
        F.broadcast(_threshold(scored)), F.lit(1) == F.col("one")
    )
    by_model = F.when(F.coalesce("score", F.lit(0.0)) >= F.col("threshold"), "allow").otherwise(
        "block"
    )
    ruled = judged.filter("match IS NOT NULL").select(
        "page_id", "host", "path", "match.*", F.lit(None).cast("double").alias("score")
    )
    return ruled.unionByName(
        asked.select(
            "page_id",
            "host",
            "path",
            F.lit(None).cast("string").alias("rule"),
            by_model.alias("verdict"),
            "score",
        )
    )
