"""Per-author features of time-stamped messages: one aggregate or one window for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

DAY = 86_400_000_000
#: Confidence tiers as (tier, least messages, least active days).
TIERS = (("high", 100, 7), ("medium", 30, 2))
#: Quiet hours lie below this share of the peak hour; local sleep is centred at half past three.
QUIET_SHARE, SLEEP_CENTRE, QUIET_WIDTH = 0.10, 3.5, 7
#: Length classes by median words, variance classes by the sample coefficient of variation.
SHORT, MEDIUM, LONG, TIGHT, VARIED, LEAST_MESSAGES = 5, 20, 50, 0.5, 1.5, 5


def tier(total: Column, active_days: Column) -> Column:
    out = F.lit("low")
    for name, least, days in reversed(TIERS):
        out = F.when((total >= least) & (active_days >= days), name).otherwise(out)
    return out


def meta_stats(messages: DataFrame, actor: str, ts: str) -> DataFrame:
    """Totals, span, rate, active UTC days, density and confidence tier of each actor; rates are null for a zero span."""
    seen = messages.groupBy(F.col(actor).alias("actor")).agg(
        F.count("*").alias("total_messages"),
        F.min(ts).alias("first_seen"),
        F.max(ts).alias("last_seen"),
        F.countDistinct(F.to_date(ts)).alias("active_days"),
    )
    span = (F.unix_micros("last_seen") - F.unix_micros("first_seen")) / F.lit(DAY)
    return (
        seen.withColumn("span_days", F.round(span, 6))
        .withColumn("per_day", F.round(F.try_divide(F.col("total_messages").cast("double"), span), 6))
        .withColumn("density", F.when(span > 0, F.round(F.least(F.lit(1.0), F.col("active_days") / span), 6)))
        .withColumn("confidence", tier(F.col("total_messages"), F.col("active_days")))
    )


def histogram(messages: DataFrame, actor: str, bin_: Column, bins: int) -> DataFrame:
    """(actor, bin, share) for every bin, empty ones included."""
    counts = messages.groupBy(F.col(actor).alias("actor"), bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("actor").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("by"))
    full = totals.select("actor", "total", "by", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return full.select("actor", "bin", F.round(F.coalesce(F.try_element_at("by", F.col("bin")), F.lit(0)) / F.col("total"), 6).alias("share"))


def hour_counts(messages: DataFrame, actor: str, ts: str) -> DataFrame:
    """(actor, h): the counts of the 24 UTC hours as an array."""
    sums = [F.count_if(F.hour(ts) == k) for k in range(24)]
    return messages.groupBy(F.col(actor).alias("actor")).agg(F.array(*sums).alias("h"))


def quiet_span(counts: DataFrame) -> DataFrame:
    """(actor, quiet_start, quiet_hours): the longest circular run of hours below a tenth of the peak.

    Equal runs: the one that holds the least busy hour, else the first after the first busy hour. Null where no hour or
    every hour is quiet.
    """
    day = F.sequence(F.lit(0), F.lit(23))
    low = F.array_max("h") * QUIET_SHARE
    quiet = lambda i: F.get("h", i % 24) < low
    first = F.array_position(F.transform("h", lambda c: c >= F.array_max("h") * QUIET_SHARE), True) - 1
    step = counts.withColumn("offset", first.cast("int"))
    # a run starts where the hour before is busy; its length is the distance to the next busy hour
    starts = F.filter(F.transform(day, lambda i: (F.col("offset") + i) % 24), lambda i: quiet(i) & ~quiet(i + 23))
    length = lambda s: F.array_min(F.filter(F.sequence(F.lit(1), F.lit(24)), lambda k: ~quiet(s + k)))
    least = (F.array_position("h", F.array_min("h")) - 1).cast("int")
    step = step.withColumn("least", least).withColumn(
        "runs",
        F.transform(starts, lambda s, i: F.struct(length(s).alias("n"), ((F.col("least") - s + 24) % 24 < length(s)).alias("holds"), (-i).alias("nth"), s.alias("start"))),
    )
    best = F.array_max("runs")
    return step.select("actor", best["start"].cast("int").alias("quiet_start"), best["n"].cast("int").alias("quiet_hours"))


def min_density_window(counts: DataFrame, width: int = QUIET_WIDTH) -> DataFrame:
    """(actor, start, total): the first circular window of `width` hours with the fewest messages."""
    total = lambda s: F.aggregate(F.slice(F.concat("h", "h"), s + 1, width), F.lit(0).cast("long"), lambda a, b: a + b)
    sums = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda s: F.struct(total(s).alias("total"), s.alias("start")))
    return counts.withColumn("best", F.array_min(sums)).select("actor", F.col("best.start").cast("int").alias("start"), F.col("best.total").alias("total"))


def utc_offset(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """(actor, utc_offset, gated): local sleep centre less the quiet midpoint, folded to -12..14; the window stands in for a missing span."""
    both = windows.join(spans, "actor", "left").withColumn("gated", F.col("quiet_start").isNotNull())
    start, hours = F.coalesce("quiet_start", "start"), F.coalesce("quiet_hours", F.lit(QUIET_WIDTH))
    raw = F.bround(F.lit(SLEEP_CENTRE) - (start + hours / 2) % 24).cast("int")
    folded = F.when(raw > 14, raw - 24).when(raw < -12, raw + 24).otherwise(raw)
    return both.select("actor", folded.alias("utc_offset"), "gated")


def gap_stats(messages: DataFrame, actor: str, ts: str, tie: str) -> DataFrame:
    """(actor, n_gaps, gap_median, gap_cv): seconds between consecutive messages, positive ones only; population CV."""
    before = F.lag(ts).over(W.partitionBy(actor).orderBy(ts, tie))
    gap = (F.unix_micros(ts) - F.unix_micros(before)) / F.lit(1e6)
    gaps = messages.select(F.col(actor).alias("actor"), gap.alias("gap")).where("gap > 0")
    return gaps.groupBy("actor").agg(
        F.count("*").alias("n_gaps"),
        F.round(F.median("gap"), 4).alias("gap_median"),
        F.round(F.try_divide(F.stddev_pop("gap"), F.avg("gap")), 4).alias("gap_cv"),
    )


def halves(messages: DataFrame, actor: str, ts: str, tie: str, interleaved: bool = False) -> DataFrame:
    """messages with half (0 or 1): the first n // 2 by time, or every other one."""
    own = W.partitionBy(actor)
    nth = F.row_number().over(own.orderBy(ts, tie)) - 1
    second = nth % 2 == 1 if interleaved else nth >= F.floor(F.count("*").over(own) / 2)
    return messages.withColumn("half", second.cast("int"))


def length_classes(texts: DataFrame, actor: str, text: str) -> DataFrame:
    """(actor, length_class, variance_class) from words per message; actors with few messages have none."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    seen = texts.groupBy(F.col(actor).alias("actor")).agg(
        F.count("*").alias("n"), F.median(words).alias("mid"), F.avg(words).alias("mean"), F.stddev_samp(words).alias("sd")
    ).where(F.col("n") >= LEAST_MESSAGES)
    cv = F.col("sd") / F.col("mean")
    length = F.when(F.col("mid") <= SHORT, "short").when(F.col("mid") <= MEDIUM, "medium").when(F.col("mid") <= LONG, "long").otherwise("paragraph")
    spread = F.when((F.col("mean") == 0) | (cv < TIGHT), "tight").when(cv < VARIED, "varied").otherwise("bimodal")
    return seen.select("actor", length.alias("length_class"), spread.alias("variance_class"))


#: Fixed values of the role recipes, in the order that breaks ties.
LURKER_PER_DAY, LURKER_SPAN, LURKER_OBSERVED, CHATTY_MESSAGES, CHATTY_OBSERVED = 2.0, 7.0, 20, 195, 20
LURKER_INITIATION, BOT_INITIATION, BOT_OBSERVED = 0.20, 0.95, 30


def roles(stats: DataFrame) -> DataFrame:
    """(actor, role, confidence) of the best matching recipe, from total_messages, per_day, span_days and, if present, initiation_rate and variance_class."""
    have = set(stats.columns)
    total, none = F.col("total_messages"), F.lit(None).cast("double")
    init = F.col("initiation_rate") if "initiation_rate" in have else none
    tight = (F.col("variance_class") == "tight") if "variance_class" in have else F.lit(False)
    share = lambda most: F.least(F.lit(1.0), total / F.lit(float(most)))
    passive = F.when(init <= LURKER_INITIATION, 1 - init / LURKER_INITIATION)
    sparse = F.when((F.col("per_day") <= LURKER_PER_DAY) & (F.col("span_days") >= LURKER_SPAN), 1 - F.col("per_day") / LURKER_PER_DAY)
    lurker = share(LURKER_OBSERVED) * F.greatest(passive, sparse)
    bot = F.when((init >= BOT_INITIATION) & tight, share(BOT_OBSERVED) * ((init - BOT_INITIATION) / (1 - BOT_INITIATION) + 1) / 2)
    chatty = F.when(total >= CHATTY_MESSAGES, share(CHATTY_OBSERVED) * F.least(F.lit(1.0), total / F.lit(CHATTY_MESSAGES * 5.0)))
    ranked = [F.struct(F.round(F.coalesce(c, F.lit(0.0)), 4).alias("confidence"), F.lit(-i).alias("nth"), F.lit(n).alias("role")) for i, (n, c) in enumerate((("lurker_or_observer", lurker), ("bot_or_automated_poster", bot), ("chatty_member", chatty)))]
    best = stats.withColumn("best", F.array_max(F.array(*ranked))).where("best.confidence > 0")
    return best.select("actor", "best.role", "best.confidence")
