"""The queries of this subpackage, each over its whole tables with the parameters used in production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import encode, handwritten, mixing, spam, splits, stable, syntax, targets, topn
from plumbline.session import stored
from plumbline.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Findings among the first 3 of their plugin, file and class."""
    return topn.top_findings(spark, folder, 3).select("finding_id").distinct()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records and the smallest record they belong together with."""
    return splits.record_groups(spark, folder).where("node <> root").select(F.col("root").alias("group_id"), F.col("node").alias("record_id"))


def p2_splits(spark: SparkSession, folder: str) -> DataFrame:
    """The split of every record: 80 % train, 10 % validation, 10 % test, groups undivided."""
    done = splits.split_groups(splits.record_groups(spark, folder), {"test": 0.1, "validation": 0.1})
    return done.select(F.col("node").alias("record_id"), F.col("root").alias("group_id"), "split")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Plan rows whose class has fewer findings than wanted."""
    told = targets.report(targets.plans_of(spark, folder), targets.cells(targets.units(spark, folder)))
    return told.where("unmet").select("plan_id", "vuln_class").distinct()


def p3_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The findings drawn for every plan."""
    return targets.drawn(spark, folder)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Findings kept because an earlier sample named them."""
    return stable.sampled_findings(spark, folder).where("by_earlier").select("finding_id").distinct()


def p6_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The whole sample: 5 % of identifiers, and every earlier selected finding."""
    return stable.sampled_findings(spark, folder).where("selected").groupBy("finding_id").agg(F.max("by_rate").alias("by_rate"), F.max("by_earlier").alias("by_earlier"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of every document's text."""
    return encode.encode(table(spark, folder, "documents", "doc_id", "text"), keep=["doc_id"])


def p7_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose ids don't decode to their text: none."""
    done = encode.encode(table(spark, folder, "documents", "doc_id", "text"))
    return done.where(encode.decode(F.col("ids")) != F.coalesce("text", F.lit(""))).select("doc_id")


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The mixes and what was planned for them; the corpus is encoded once, for its lengths."""
    docs = encode.counted(table(spark, folder, "documents", "doc_id", "source", "text").where("source IS NOT NULL"))
    sizes = docs.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    planned = stored(mixing.plan(table(spark, folder, "mix_targets"), sizes), "mix-plan")
    return mixing.mix(docs, planned), planned


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Targets that the finished mix could not fill: every text of the source is in it as often as allowed, and tokens are wanting."""
    return mixing.shortfalls(*_mixed(spark, folder)).distinct()


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of every mix with their copies."""
    return _mixed(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares that the mixes reached."""
    return mixing.shares(*_mixed(spark, folder))


def _kinds(spark: SparkSession, folder: str) -> DataFrame:
    library = [r["content"] for r in table(spark, folder, "vendor_library", "content").where("content IS NOT NULL").collect()]  # 48 files, a fixed table
    return handwritten.kinds(table(spark, folder, "source_files", "file_id", "slug", "path", "content"), library)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files that their plugin's makers did not write by hand."""
    return _kinds(spark, folder).where("kind IS NOT NULL").select("file_id").distinct()


def p4_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """What these files are."""
    return _kinds(spark, folder).where("kind IS NOT NULL").select("file_id", "kind")


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.faults(table(spark, folder, "source_files", "file_id", "slug", "path", "content"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files that are not valid source of the language their name claims."""
    return _judged(spark, folder).where("NOT valid").select("file_id").distinct()


def p5_faults(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with them, and the languages they are valid in."""
    return _judged(spark, folder).where("NOT valid OR fault IS NOT NULL").select("file_id", "claimed", "fault", "parses_as", "wrong", "accepts")


def p5_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Files by claimed language, the language they are read as, and all that accept them."""
    return _judged(spark, folder).groupBy("claimed", "parses_as", "accepts").agg(F.count(F.lit(1)).alias("files"))


def p5_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rates by plugin and claimed language."""
    return syntax.rates(_judged(spark, folder))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return spam.score(table(spark, folder, "documents", "doc_id", "slug", "text"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are mostly stuffed keywords, links or product entries."""
    return _scored(spark, folder).where("score >= 0.5").select("doc_id").distinct()


def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The score of every document and of its host."""
    return _scored(spark, folder).select("doc_id", "slug", F.round("page", 4).alias("page"), F.round("host_rate", 4).alias("host_rate"), F.round("score", 4).alias("score"))


def p2_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the splits: all records in one, no group divided, each share as near to its target as a whole group allows."""
    done = stored(p2_splits(spark, folder), "splits")
    groups = done.groupBy("group_id").agg(F.count_distinct("split").alias("splits"), F.count(F.lit(1)).alias("size"))
    n = done.groupBy().agg(F.count(F.lit(1)).alias("records"), F.count_distinct("record_id").alias("distinct_records"), *[F.count_if(F.col("split") == x).alias(x) for x in ("test", "validation")])
    g = groups.agg(F.count_if(F.col("splits") > 1).alias("divided"), F.count_if(F.col("size") == 1).alias("single"))
    near = lambda x: (F.abs(F.col(x) - F.round(F.col("records") * 0.1)) <= F.when(F.col("single") > 0.2 * F.col("records"), 0).otherwise(1)).alias(f"{x}_near")
    return n.crossJoin(F.broadcast(g)).select("records", "distinct_records", "divided", near("test"), near("validation"))  # one row each


def p3_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Plans without a gap: the size they ask for (their floors' sum where that is more), and whether the sample has it to one row."""
    told = targets.report(targets.plans_of(spark, folder), targets.cells(targets.units(spark, folder)))
    whole = told.groupBy("plan_id").agg(F.bool_or("unmet").alias("gap"), F.round(F.greatest(F.sum("target"), F.sum("floor"))).cast("long").alias("asked")).where("NOT gap")
    n = p3_sample(spark, folder).groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"))
    return whole.join(n, "plan_id", "left").select("plan_id", "asked", (F.abs(F.coalesce("n", F.lit(0)) - F.col("asked")) <= 1).alias("kept"))


def p6_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the sample: every earlier finding is in it, and the rate is met within four standard deviations."""
    rows = stable.sampled_findings(spark, folder).groupBy("finding_id").agg(F.max("by_rate").alias("by_rate"), F.max("by_earlier").alias("by_earlier"), F.max("selected").alias("selected"))
    n = rows.agg(F.count(F.lit(1)).alias("findings"), F.count_if("by_earlier").alias("earlier"), F.count_if(F.col("by_earlier") & ~F.col("selected")).alias("lost"), F.count_if("by_rate").alias("r"))
    return n.select("findings", "earlier", "lost", (F.abs(F.col("r") - 0.05 * F.col("findings")) <= 4 * F.sqrt(0.05 * 0.95 * F.col("findings"))).alias("rate_met"))


def p8_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Every target of every mix, whether no text is used more often than allowed, and whether the tokens given are met to two texts."""
    mixed, planned = _mixed(spark, folder)
    most = mixed.groupBy("mix_id", "source").agg(F.max("copies").alias("copies"), F.max("tokens").alias("longest"))
    rows = mixing.shares(mixed, planned).join(planned.select("mix_id", "source", "max_repeats"), ["mix_id", "source"]).join(most, ["mix_id", "source"], "left")
    return rows.select("mix_id", "source", (F.coalesce("copies", F.lit(0)) <= F.col("max_repeats")).alias("within_cap"), (F.abs(F.col("tokens") - F.col("given")) <= 2 * F.coalesce("longest", F.lit(0)) + 1).alias("met"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p2_found, p2_splits, p2_checks, p3_found, p3_sample, p3_checks, p4_found, p4_kinds, p5_found, p5_faults, p5_languages, p5_rates, p6_found, p6_sample, p6_checks, p7_ids, p7_roundtrip, p8_found, p8_mix, p8_shares, p8_checks, p9_found, p9_scores)}
