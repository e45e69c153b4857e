"""Change detection: what to create, re-version, skip, delete; state merging and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosopon.functions import citations, fingerprints, metadata, names
from prosopon.functions import diagnostics as dia
from prosopon.operators import ordering
from prosopon.profile import Profile
from prosopon.session import cut_lineage

ACTIONS = ("create", "newversion", "skip")


def entry_feed(bios: DataFrame) -> DataFrame:
    """The metadata feed with one content hash per entry."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")).alias(c)

    plain = ("first_name", "last_name", "summary", "life", "version", "authors", "nationality")
    signature = fingerprints.content_hash(
        html=F.col("html"), summary=F.col("summary"), life=F.col("life"), version=F.col("version"),
        authors=F.col("authors"), nationality=F.col("nationality"), roles=F.col("roles"),
    )
    return bios.select(
        F.col("doc_id").alias("slug"), *[text(c) for c in plain],
        fingerprints.canonical_roles(F.col("roles")).alias("roles"), signature.alias("content_hash"),
    )


def check_environment(env: str, confirmed: bool) -> None:
    """Permanent identifiers need an explicit confirmation."""
    if env not in ("sandbox", "production"):
        raise ValueError("env must be sandbox or production")
    if env == "production" and not confirmed:
        raise PermissionError("refusing to plan production identifiers without confirmation")


def named(like: DataFrame, only: list[str] | DataFrame) -> DataFrame:
    """A choice of entries as a table (slug); a list is one that a user has typed."""
    if isinstance(only, DataFrame):
        return only.select("slug").distinct()
    return like.sparkSession.createDataFrame([(s,) for s in dict.fromkeys(only)], "slug string")


def not_found(feed: DataFrame, only: list[str] | DataFrame) -> DataFrame:
    """(slug): chosen entries that the feed does not have."""
    return named(feed, only).join(feed, "slug", "left_anti")


def version_plan(feed: DataFrame, state: DataFrame, profile: Profile, *, force: bool = False, only: list[str] | DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """The feed with `state_hash` and `action`: create, newversion or skip.

    `only` chooses entries by slug, as a table or a list (`not_found` reports those that do not exist), `limit` takes the first of them.
    """
    if only is not None:
        feed = feed.join(named(feed, only), "slug", "left_semi")
    if limit is not None:
        feed = ordering.limit_rows(feed, [F.col("slug")], limit)
    known = state.select("slug", F.col("content_hash").alias("_known"), F.lit(True).alias("_has_state"))
    hashed = feed.withColumn(
        "state_hash",
        fingerprints.state_hash(F.col("content_hash"), profile.license, profile.publication_type, profile.render_version),
    )
    changed = F.lit(force) | ~F.col("_known").eqNullSafe(F.col("state_hash"))
    action = F.when(F.col("_has_state").isNull(), "create").when(changed, "newversion").otherwise("skip")
    return hashed.join(known, "slug", "left").withColumn("action", action).drop("_known", "_has_state")


def tally(plan: DataFrame) -> DataFrame:
    """One row with a count per action, zero included."""
    return plan.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ACTIONS])


def dry_run(plan: DataFrame, profile: Profile, today: str) -> DataFrame:
    """What a run would do: the report row of each entry that is not skipped."""
    m = F.col("m")
    defaulted = citations.publication_date(F.col("version")).isNull()
    return (
        plan.where(F.col("action") != "skip")
        .withColumn("m", metadata.deposit_metadata(profile, today))
        .select(
            "slug", "action", m["title"].alias("title"),
            F.array_join(F.transform(m["creators"], lambda c: c["name"]), "; ").alias("authors"),
            F.array_join(F.transform(m["contributors"], lambda c: c["name"]), "; ").alias("editors"),
            m["publication_date"].alias("date"), m["version"].alias("version"),
            F.array_join(F.transform(m["related_identifiers"], lambda r: F.concat(r["relation"], F.lit("→"), r["identifier"])), "  ").alias("relations"),
            dia.collect(dia.report("publication_date_defaulted", defaulted)).alias("diagnostics"),
        )
    )


def quarantine(plan: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Adds `reasons`: entries with an empty title or without an artifact are kept back, the rest goes on."""
    present = artifacts.select("slug", F.lit(True).alias("_present")).distinct()
    title = names.deposit_title(F.col("first_name"), F.col("last_name"))
    problems = dia.collect(
        dia.report("artifact_missing", F.col("_present").isNull()), dia.report("title_empty", title == "")
    )
    return plan.join(present, "slug", "left").withColumn("reasons", F.transform(problems, lambda d: d["code"])).drop("_present")


def merge_outcomes(state: DataFrame, outcomes: DataFrame, env: str) -> DataFrame:
    """State after a run: a success replaces the row, a failure leaves it as it was and is retried later.

    An outcome without a concept identifier keeps the earlier one.
    """
    done = outcomes.where("ok").select(
        "slug", "record_id", "concept_rec_id", "concept_doi", "version_doi", "content_hash",
        F.lit("published").alias("status"), "version", "minted_at", F.lit(env).alias("env"),
    )
    old, new = state.alias("old"), done.alias("new")
    columns = [c for c in done.columns if c != "slug"]
    is_new = F.col("new.status").isNotNull()

    def pick(c: str) -> Column:
        fresh = F.coalesce(f"new.{c}", f"old.{c}") if c == "concept_doi" else F.col(f"new.{c}")
        return F.when(is_new, fresh).otherwise(F.col(f"old.{c}")).alias(c)

    return old.join(new, "slug", "full").select("slug", *[pick(c) for c in columns])


def outcome_totals(outcomes: DataFrame) -> DataFrame:
    """Successes, failures and the exit status (1 as soon as something failed)."""
    return outcomes.agg(
        F.count_if("ok").alias("succeeded"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.max(F.when(F.col("ok"), 0).otherwise(1)).alias("exit_status"),
    )


def cache_plan(current: DataFrame, manifest: DataFrame, artifacts: DataFrame, key: str = "slug", digest: str = "digest") -> DataFrame:
    """`reuse` when the digest is the recorded one and the artifact is there, else `render`."""
    known = manifest.select(key, F.col(digest).alias("_recorded"))
    present = artifacts.select(key, F.lit(True).alias("_present")).distinct()
    fresh = F.coalesce((F.col("_recorded") == F.col(digest)) & F.col("_present"), F.lit(False))
    return (
        current.join(known, key, "left")
        .join(present, key, "left")
        .withColumn("action", F.when(fresh, "reuse").otherwise("render"))
        .drop("_recorded", "_present")
    )


def sync(current: DataFrame, store: DataFrame, key: str = "id", digest: str = "digest") -> DataFrame:
    """insert / update / unchanged / delete for two keyed snapshots."""
    new, old = current.select(key, F.col(digest).alias("_new")), store.select(key, F.col(digest).alias("_old"))
    action = (
        F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete")
        .when(F.col("_old") == F.col("_new"), "unchanged").otherwise("update")
    )
    return new.join(old, key, "full").select(key, action.alias("action"))


def version_history(snapshots: DataFrame, key: str, order: list[str], digest: str) -> DataFrame:
    """A version row per change of the digest along time, numbered per entry.

    Only entries, times and digests are ordered, by range, so an entry with very many snapshots is spread over tasks; neighbouring ranges hand their
    last digest over. What the change points carry besides joins them afterwards.
    """
    marked = snapshots.withColumn("_both", F.concat_ws("\0", F.col(key).cast("string"), F.col(digest)))
    rows, places = ordering.run_numbers(marked, [F.col(key), *map(F.col, order)], "_both")
    changes = rows.join(places.where(~F.col("continuation")).select("_row", "run"), "_row").drop("_row", "_both")
    first = changes.groupBy(key).agg(F.min("run").alias("_first_run"))
    return changes.join(first, key).withColumn("version_number", F.col("run") - F.col("_first_run") + 1).drop("run", "_first_run")


def set_fingerprint(files: DataFrame, group: list[str], path: Column, content: Column) -> DataFrame:
    """Fingerprint of a set of files of any size, per group.

    Each file is hashed where it lies; the digests are added up in three 48-bit lanes, which is independent of
    order and combines before the shuffle. For a handful of files in one row there is
    `fingerprints.ordered_set_fingerprint`.
    """
    one = F.sha2(F.concat(path, F.lit("\0"), content, F.lit("\0")), 256)
    lanes = [
        F.sum(F.conv(F.substring(one, 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").alias(f"_l{i}")
        for i in range(3)
    ]
    summed = files.groupBy(*group).agg(F.count("*").alias("files"), *lanes)
    joined = F.concat_ws(":", "files", *[F.col(f"_l{i}").cast("string") for i in range(3)])
    return summed.select(*group, "files", F.substring(F.sha2(joined, 256), 1, 16).alias("fingerprint"))


#: Children of a node of a fingerprint tree.
FANOUT = 64


def fingerprint_tree(files: DataFrame, group: list[str], path: Column, content: Column, fanout: int = FANOUT) -> DataFrame:
    """(group, level, node, digest): fingerprints of a set of files of any size in the order of their paths, per group.

    Level 0 has a digest per file, `sha256(path NUL content NUL)`, numbered along the paths (and digests, where a path comes twice); a node of a higher
    level has the digest of its up to `fanout` children, one after another. The last level has one node, at level 1 at least. Files are hashed where they lie;
    paths are ordered by range, and a task sees `fanout` digests of a node at most. A file that changes changes one node of each level.
    """
    leaves = files.select(*group, path.alias("_path"), F.sha2(F.concat(path, F.lit("\0"), content, F.lit("\0")), 256).alias("digest"))
    placed = ordering.with_position(leaves, [*map(F.col, group), F.col("_path"), F.col("digest")], "_at")
    first = placed.groupBy(*[F.col(g).alias(f"_{g}") for g in group]).agg(F.min("_at").alias("_first"), F.count("*").alias("_files"))
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]
    rows = placed.join(first, same) if group else placed.crossJoin(F.broadcast(first))
    level = cut_lineage(rows.select(*group, "_files", F.lit(0).alias("level"), (F.col("_at") - F.col("_first")).alias("node"), "digest"), "leaves")
    tree, number = level.select(*group, "level", "node", "digest"), 0
    while number == 0 or not level.isEmpty():
        number += 1
        children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda c: c["digest"]), "")
        parents = level.groupBy(*group, "_files", F.floor(F.col("node") / fanout).cast("bigint").alias("parent")).agg(F.sha2(children, 256).alias("digest"))
        level = cut_lineage(parents.select(*group, "_files", F.lit(number).alias("level"), F.col("parent").alias("node"), "digest"), "nodes")
        tree = tree.unionByName(level.select(*group, "level", "node", "digest"))
        level = level.where(F.col("_files") > fanout**number)  # the others have reached their root
    return tree


def ordered_fingerprint(tree: DataFrame, group: list[str]) -> DataFrame:
    """(group, files, fingerprint): number of files and the root's first 16 hex digits of each tree."""
    root = F.substring(F.max_by("digest", "level"), 1, 16)
    return tree.groupBy(*group).agg(F.count_if(F.col("level") == 0).alias("files"), root.alias("fingerprint"))


def changed_nodes(before: DataFrame, after: DataFrame, group: list[str]) -> DataFrame:
    """(group, level, node): nodes of two trees that are not the same in both."""
    keys = [*group, "level", "node"]
    old = before.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("digest").alias("_digest"))
    met = after.join(old, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "full")
    return met.where(~F.col("digest").eqNullSafe(F.col("_digest"))).select(*[F.coalesce(k, f"_{k}").alias(k) for k in keys])
