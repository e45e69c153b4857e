"""The everyday jobs, put together from the operators: build the corpus, plan and record versions, audit links."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosopon.functions import citations
from prosopon.operators import audit, enrich, extract, versioning
from prosopon.profile import Profile
from prosopon.session import cut_lineage
from prosopon.sinks import exports
from prosopon.sources import corpus, docx, keyvalue

CARRIED = ("relative_path", "title", "image_key", "digest")


@dataclass
class Corpus:
    """The entry table that was written, and what a build reports."""

    entries: DataFrame
    duplicates: DataFrame
    warnings: list[str]
    tally: DataFrame  # (code, field, severity, n), as `audit.warning_tally`, counted while the table was written


def build_corpus(spark: SparkSession, base: str, target: str, profile: Profile, forms: Sequence[tuple[str, str]], pattern: str = "*.docx") -> Corpus:
    """All Word files below `base` into the entry table at `target`.

    Of several files with one id the last path stays; which files win is settled from names, before any is read.
    """
    files, warnings = corpus.scan_or_empty(spark, base, pattern)
    files = files.where(~F.startswith(F.element_at(F.split("relative_path", "/"), -1), F.lit("~$")))
    winners = files.groupBy("doc_id").agg(F.max("relative_path").alias("relative_path"), F.count("*").alias("copies"))
    chosen = files.join(winners.select("doc_id", "relative_path"), ["doc_id", "relative_path"], "left_semi")
    bios = extract.extract_all(docx.decode(chosen, CARRIED), profile, forms, CARRIED)
    watched, tally = audit.observed(bios)
    exports.write_store(watched, target)
    entries = spark.read.schema(bios.schema).parquet(target)
    return Corpus(entries, winners.where("copies > 1"), warnings, tally())


def write_feed(entries: DataFrame, path: str) -> None:
    exports.write_feed(versioning.entry_feed(entries), path)


@dataclass
class Plan:
    rows: DataFrame
    tally: DataFrame
    report: DataFrame
    not_found: DataFrame  # slugs asked for by `only` that the feed does not have


def plan_versions(
    spark: SparkSession, feed_path: str, state_path: str, profile: Profile, today: str, *,
    env: str = "sandbox", confirmed: bool = False, only: list[str] | DataFrame | None = None, limit: int | None = None, force: bool = False,
) -> Plan:
    """What to create, re-version or skip, with the report of a dry run; changes nothing.

    State is kept per environment, so that test identifiers and permanent ones never meet.
    """
    versioning.check_environment(env, confirmed)
    state = keyvalue.read_keyed(spark, exports.current_state_folder(spark, f"{state_path}/{env}"))
    feed = keyvalue.read_feed(spark, feed_path)
    rows = cut_lineage(versioning.version_plan(feed, state, profile, force=force, only=only, limit=limit), "plan")
    return Plan(rows, versioning.tally(rows), versioning.dry_run(rows, profile, today), versioning.not_found(feed, [] if only is None else only))


def record_outcomes(spark: SparkSession, outcomes: DataFrame, state_path: str, env: str, run: int) -> DataFrame:
    """Publish the state after run number `run`; returns successes, failures and exit status."""
    place = f"{state_path}/{env}"
    state = keyvalue.read_keyed(spark, exports.current_state_folder(spark, place))
    exports.publish_keyed(versioning.merge_outcomes(state, outcomes, env), place, run)
    return versioning.outcome_totals(outcomes)


def audit_images(entries: DataFrame, probes: DataFrame, target: str) -> DataFrame:
    """Image credits with link and status as a CSV file set; returns the tally."""
    credit = citations.image_credit(F.col("image_source"))
    links = entries.select(
        F.col("title").alias("entry"), F.coalesce("image_source", F.lit("")).alias("full_text"), F.coalesce(credit["href"], F.lit("")).alias("link")
    )
    audited = cut_lineage(enrich.link_audit(links, probes), "audited")
    exports.write_csv_audit_with_bom(audited.withColumnRenamed("full_text", "full text"), target)
    return audit.link_tally(audited)
