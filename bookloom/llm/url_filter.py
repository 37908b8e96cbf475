"""URL filter: host and path rules, and a character model where no rule fits.

URLs that rules allow or block train two smoothed Markov models of variable
order over characters. A URL without a rule is judged by the difference of its
log-likelihoods per character; the cut is calibrated on labelled URLs kept out
of the models. DataFrame functions throughout.

Everything is counted per distinct URL and per distinct run of characters, with
partial sums before each shuffle; hot runs are joined between stored tables, so
adaptive execution can split them. Log-likelihoods are summed as whole
millionths, so the result does not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookloom.llm.common import ascii_lower, boxed, stored, unboxed

# Characters before the one that is predicted.
ORDER = 4
# Weight of the next shorter context, in observations.
STRENGTH = 3.0
# Marks before the first and after the last character.
START, END = "\x02", "\x03"
MILLION = 1_000_000
# Differences per character are calibrated in steps of a thousandth up to here.
WIDEST = 16

Rule = tuple[str, str, str]  # verdict, host, path


def host(url: str) -> Column:
    """After the first ``://`` up to / ? # or the end, A-Z lower-cased; else empty."""
    return ascii_lower(_part(url, 1))


def path(url: str) -> Column:
    """What follows the host up to ? # or the end; else empty."""
    return _part(url, 2)


def _part(url: str, group: int) -> Column:
    found = F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)([^?#]*)", group)
    return F.coalesce(found, F.lit(""))


def matching_rule(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; nulls if none fits."""
    name = verdict = F.lit(None).cast("string")
    for kind, site, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(start)
        name = F.when(fits, site + start).otherwise(name)
        verdict = F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _runs(urls: DataFrame, *keep: str) -> DataFrame:
    """Each character of ``_url`` and its end with the ORDER characters before (``_run``)."""
    padded = F.split(F.concat(F.lit(START * ORDER), F.col("_url"), F.lit(END)), "")
    n = F.length("_url") + 1
    shifted = [F.slice(padded, i + 1, n).alias(f"c{i}") for i in range(ORDER + 1)]
    chars = urls.select(*keep, F.explode(F.arrays_zip(*shifted)).alias("_c"))
    return chars.select(*keep, F.concat(*[f"_c.c{i}" for i in range(ORDER + 1)]).alias("_run"))


def _suffixes(runs: DataFrame, *keep: str) -> DataFrame:
    """Each run with its last 1 to ORDER + 1 characters (``_end``)."""
    ends = [F.substring("_run", -m, m) for m in range(1, ORDER + 2)]
    return runs.select(*keep, F.explode(F.array(*ends)).alias("_end"))


def run_scores(runs: DataFrame) -> DataFrame:
    """``_run`` and ``_micro``: millionths of log P(char | context), accepted less rejected.

    ``runs`` has each run once, with its counts among accepted (``_a``) and
    rejected (``_r``) URLs; zeros are fine. A context's estimate leans on that
    of the next shorter context with a fixed weight, down to an even guess.
    """
    counts = _suffixes(runs, "_a", "_r").groupBy("_end").agg(
        F.sum("_a").alias("_a"), F.sum("_r").alias("_r")
    )
    context = F.expr("substring(_end, 1, length(_end) - 1)")
    m = F.length("_end")
    counts = stored(counts.select("_end", "_a", "_r", context.alias("_ctx"), m.alias("_m")), "url-counts")
    totals = stored(
        counts.groupBy("_ctx", "_m").agg(F.sum("_a").alias("_ta"), F.sum("_r").alias("_tr")),
        "url-totals",
    )
    model = stored(counts.join(totals, ["_ctx", "_m"]).drop("_ctx"), "url-model")
    levels = stored(_suffixes(runs, "_run"), "url-ends").join(model, "_end")
    chains = levels.groupBy("_run").agg(
        F.array_sort(F.collect_list(F.struct("_m", "_a", "_ta", "_r", "_tr"))).alias("_chain")
    )

    def likelihood(n: str, total: str) -> Column:
        return F.aggregate(
            "_chain",
            F.lit(1 / 256),
            lambda p, level: (level[n] + STRENGTH * p) / (level[total] + STRENGTH),
        )

    ratio = F.log(likelihood("_a", "_ta")) - F.log(likelihood("_r", "_tr"))
    return chains.select("_run", F.round(ratio * MILLION).cast("long").alias("_micro"))


def _cut(scored: DataFrame) -> DataFrame:
    """One row: the cut between accepted and rejected with the least sum of error rates.

    Counts per thousandth, so at most 2000 * WIDEST rows meet in the last step.
    """
    step = F.greatest(F.least(F.floor(F.col("_score") * 1000), F.lit(1000 * WIDEST)), F.lit(-1000 * WIDEST))
    steps = scored.groupBy(step.cast("long").alias("_step")).agg(
        F.sum(F.when(F.col("_label") == 1, F.col("_n")).otherwise(0)).alias("_good"),
        F.sum(F.when(F.col("_label") == 0, F.col("_n")).otherwise(0)).alias("_bad"),
    )
    below = Window.orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    # Without URLs of a verdict there is no error of that kind.
    lost = F.try_divide(F.coalesce(F.sum("_good").over(below), F.lit(0)), F.sum("_good").over(whole))
    kept = 1 - F.try_divide(F.coalesce(F.sum("_bad").over(below), F.lit(0)), F.sum("_bad").over(whole))
    errors = steps.select("_step", (F.coalesce(lost, F.lit(0)) + F.coalesce(kept, F.lit(0))).alias("_e"))
    best = F.min(F.struct(F.round("_e", 9), F.abs("_step"), F.col("_step").alias("at")))
    return errors.agg((F.coalesce(best["at"], F.lit(0)) / 1000).alias("_cut"))


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict`` and ``score`` to every row.

    ``verdict`` is the longest fitting rule's, else allow if ``score``, the log
    of the likelihood ratio per character, is at least the calibrated cut. The
    columns replace input columns of the same name, in any case.

    A null URL is scored as the empty one; a URL without ``://`` has an empty
    host and path, so no rule fits. Repeated URLs are counted as often as they
    occur and get the same verdict. Where no rule has both verdicts among the
    URLs, there is nothing to tell apart and the cut is as low as the scores. Of
    rules of equal length that fit, the last one counts. A very long URL is scored
    whole. No rows give no rows.
    """
    added = ("host", "path", "rule", "verdict", "score")
    names, row = boxed(pages, added)
    body = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    sites = pages.select(body.alias("_url")).groupBy("_url").agg(F.count("*").alias("_n"))
    _, verdict = matching_rule(rules, host("_url"), path("_url"))
    label = F.when(verdict == "allow", 1).when(verdict == "block", 0)
    sites = stored(
        sites.select(
            F.monotonically_increasing_id().alias("_id"),
            "_url",
            "_n",
            label.alias("_label"),
            (F.pmod(F.xxhash64("_url"), F.lit(4)) == 0).alias("_held"),
        ),
        "urls",
    )
    learned = F.when(~F.col("_held"), F.col("_label"))
    counted = _runs(sites.withColumn("_learn", learned), "_n", "_learn").groupBy("_run").agg(
        F.sum(F.when(F.col("_learn") == 1, F.col("_n")).otherwise(0)).alias("_a"),
        F.sum(F.when(F.col("_learn") == 0, F.col("_n")).otherwise(0)).alias("_r"),
    )
    scores = stored(run_scores(stored(counted, "url-runs")), "url-run-scores")
    summed = (
        _runs(sites, "_id")
        .join(scores, "_run")
        .groupBy("_id")
        .agg((F.sum("_micro") / F.count("*") / MILLION).alias("_score"))
    )
    scored = stored(sites.join(summed, "_id"), "url-scores")
    cut = _cut(scored.where(F.col("_held") & F.col("_label").isNotNull()).select("_score", "_label", "_n"))
    rule, verdict = matching_rule(rules, host("_url"), path("_url"))
    judged = scored.select(
        "_url",
        host("_url").alias("host"),
        path("_url").alias("path"),
        rule.alias("rule"),
        F.coalesce(
            verdict, F.when(F.col("_score") >= cut.scalar(), "allow").otherwise("block")
        ).alias("verdict"),
        F.col("_score").alias("score"),
    )
    keyed = pages.select(row, body.alias("_url"))
    return keyed.join(stored(judged, "url-verdicts"), "_url").select(*unboxed(names), *added)
