"""Profiles by versions: an observation makes a new version of its actor's profile only if a slot's value differs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonde.plans.parts import Parts

#: The primitives that fill each block of a profile; a slot has its primitive's last name unless NAMED gives another.
BLOCKS = {
    "stylometric_summary": (
        "stylometric.function_word_distribution_top50", "stylometric.character_ngram_simhash", "stylometric.message_length_class",
        "stylometric.message_length_variance_class", "stylometric.punctuation_style", "stylometric.typo_signature", "stylometric.pos_ngram_signature",
    ),
    "lexical_summary": (
        "stylometric.distinctive_vocabulary_signature", "lexical.vocabulary_richness", "lexical.dialect_region", "lexical.evaluative_morphology_density",
        "lexical.optional_grammar_signature",
    ),
    "interaction_summary": ("interaction.conversation_initiation_rate",),
    "temporal_summary": (
        "meta.total_messages", "meta.corpus_span_days", "meta.msg_per_day", "meta.active_days", "meta.activity_density", "meta.first_seen_ts", "meta.last_seen_ts",
        "meta.fingerprint_confidence", "circadian.hour_histogram", "circadian.dow_histogram", "circadian.hour_dow_histogram", "circadian.quiet_span_utc",
    ),
}
NAMED = {
    "stylometric.function_word_distribution_top50": "function_word_simhash",
    "stylometric.character_ngram_simhash": "char_ngram_simhash",
    "stylometric.distinctive_vocabulary_signature": "distinctive_vocab",
    "lexical.vocabulary_richness": "mattr",
    "meta.total_messages": "message_count",
}
#: Primitives whose source may end in #language, and the languages known.
SPOKEN = ("stylometric.function_word_distribution_top50", "stylometric.pos_ngram_signature", "lexical.optional_grammar_signature")
LANGUAGES = ("en", "es")

SLOTS = "actor long, block string, slot string, value string, language string, version long, step long"
VERSIONS = "actor long, version long, block string, slot string, value string, language string, role string, us long, id long"


def slot_map(spark: SparkSession) -> DataFrame:
    """primitive, block, slot."""
    rows = [(p, block, NAMED.get(p, p.split(".", 1)[1])) for block, names in BLOCKS.items() for p in names]
    return spark.createDataFrame(rows, "primitive string, block string, slot string")


def language(source: Column, primitive: Column) -> Column:
    """The language a source ends with, for primitives that have one."""
    code = F.lower(F.btrim(F.substring_index(source, "#", -1)))
    return F.when(primitive.isin(*SPOKEN) & F.contains(source, F.lit("#")) & code.isin(*LANGUAGES), code)


class ProfileVersions:
    """roles: (role, {slot: least number}) in order; the first whose slots all reach their number is an actor's role."""

    def __init__(self, spark: SparkSession, path: str, roles: list[tuple[str, dict[str, float]]], most_parts: int = 8) -> None:
        self.spark, self.parts, self.roles, self.most_parts = spark, Parts(spark, path), roles, most_parts

    def current(self) -> DataFrame:
        """The newest value of every slot, and the version that brought it."""
        rows = self.parts.read(SLOTS, "slots")
        newest = rows.groupBy("actor", "block", "slot").agg(F.max_by(F.struct("value", "language", "version", "step"), "step").alias("s"))
        return newest.select("actor", "block", "slot", "s.*")

    def versions(self) -> DataFrame:
        return self.parts.read(VERSIONS, "versions")

    def fold(self, observations: DataFrame, batch: int, source: str = "stream") -> bool:
        """Observations (actor, us, id, primitive, value string, source) of a batch; False if it was folded before.

        An unknown primitive is left out, and an empty value counts as none. Within a batch the order is that of us and id.
        """
        if self.parts.applied(source, batch):
            return False
        now = self.current()
        named = observations.join(F.broadcast(slot_map(self.spark)), "primitive").select(
            "actor", "us", "id", "block", "slot", F.nullif(F.col("value"), F.lit("")).alias("value"), language(F.col("source"), F.col("primitive")).alias("language")
        )
        before = now.select("actor", "block", "slot", F.col("value").alias("stored"))
        heads = now.groupBy("actor").agg(F.max("version").alias("head"))
        own = W.partitionBy("actor", "block", "slot").orderBy("us", "id")
        rows = named.join(before, ["actor", "block", "slot"], "left").join(heads, "actor", "left")
        earlier = F.when(F.row_number().over(own) == 1, F.col("stored")).otherwise(F.lag("value").over(own))
        # the first observation of an actor without a profile makes one, whatever its value
        first = F.struct("us", "id") == F.min(F.struct("us", "id")).over(W.partitionBy("actor"))
        changed = rows.withColumn("earlier", earlier).withColumn("opens", F.col("head").isNull() & first).where("opens OR NOT (value <=> earlier)")
        order = W.partitionBy("actor").orderBy("us", "id")
        numbered = changed.withColumn("version", F.coalesce("head", F.lit(0)) + F.row_number().over(order))
        versions = self._with_roles(numbered, now, order)
        versions_part = self.parts.write(versions.select(*[c.split()[0] for c in VERSIONS.split(", ")]))
        found = self.spark.read.schema(VERSIONS).parquet(versions_part)
        step = F.lit(self.parts.manifest()["number"] + 1).cast("long").alias("step")
        slots = found.groupBy("actor", "block", "slot").agg(F.max_by(F.struct("value", "language", "version"), "version").alias("s")).select("actor", "block", "slot", "s.*", step)
        self.parts.commit({"versions": [versions_part], "slots": [self.parts.write(slots)]}, source, batch)
        return True

    def _with_roles(self, numbered: DataFrame, now: DataFrame, order: W) -> DataFrame:
        """The role that the slots give as they stand at each version."""
        used = sorted({slot for _, limits in self.roles for slot in limits})
        if not used:
            return numbered.withColumn("role", F.lit(None).cast("string"))
        held = now.groupBy("actor").agg(*[F.max(F.when(F.col("slot") == s, F.col("value"))).alias(f"held_{s}") for s in used])
        rows = numbered.join(held, "actor", "left")
        # a slot that was emptied is none again, so what is carried on is a pair, not the value alone
        at = {}
        for s in used:
            last = F.last(F.when(F.col("slot") == s, F.struct("value")), ignorenulls=True).over(order)
            at[s] = F.when(last.isNotNull(), last["value"]).otherwise(F.col(f"held_{s}")).try_cast("double")
        role = F.lit(None).cast("string")
        for name, limits in reversed(self.roles):
            holds = F.lit(True)
            for slot, least in limits.items():
                holds = holds & F.coalesce(at[slot] >= least, F.lit(False))
            role = F.when(holds, F.lit(name)).otherwise(role)
        return rows.withColumn("role", role)
