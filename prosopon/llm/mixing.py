"""Mix sources to target weights: hash-random order, prefix sums per source, a cut at each source's exact budget.

Every document gets a random key, the first 60 bits of an MD5 of seed and id. A source is read in key order; `budget_plan`
finds where its budget ends without sorting it: sums per source and key range (combined before the shuffle), running
sums over the ranges, and an exact running sum in the one range where the budget ends. `apply_plan` then decides
every document by itself, so no text moves. A budget above the source's size takes whole epochs first.

Defined results: a null or blank text has size 0 and is never taken; null sources form a source of their own; a null id
has a key like any other; rows that share source and id (repeated rows) share a key, and a cut that falls on them is
dealt out in proportion to their sizes, rounded down; an empty table gives an empty result; extra columns are kept, and
those that share a name with a result column are replaced. Targets are computed from one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosopon.llm.common import packed, unpacked, word_count
from prosopon.session import cut_lineage

#: Key ranges per source: the range that holds the cut has 1/4096 of the source's rows.
RANGE_BITS = 12
KEY_BITS = 60


def random_key(doc_id: Column, seed: str) -> Column:
    text = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def cyclic_weights(docs: DataFrame, weights: tuple[float, ...], source: str = "source") -> DataFrame:
    """(source, weight): the sources in code point order, null last, weigh `weights` in turn."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    values = F.array(*(F.lit(float(w)) for w in weights))
    return docs.select(F.col(source).alias("source")).distinct().select("source", F.get(values, turn).alias("weight"))


def fill(sizes: DataFrame, share: float, cap: float) -> DataFrame:
    """`target` for rows (source, source_size, weight): `share` of all sizes by weight, at most `cap` times a source's size.

    What a capped source cannot take goes to the others by weight until none is above its cap. In order of cap per weight,
    the capped sources are a prefix; the first source that stays below its cap gives the level of all after it.
    """
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    limit = F.col("source_size") * F.lit(float(cap))
    order = Window.orderBy("fullness", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = sizes.withColumn("limit", limit).withColumn("total", total).withColumn("fullness", F.col("limit") / F.col("weight"))
    levels = ranked.withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    level = F.min(F.when(F.col("fullness") >= F.col("level"), F.struct("fullness", F.col("source").isNull(), "source", "level"))).over(Window.partitionBy())
    return levels.withColumn("target", F.coalesce(F.least(F.col("limit"), F.col("weight") * level["level"]), F.col("limit"))).select(
        "source", "source_size", "target"
    )


def budget_plan(docs: DataFrame, weights: DataFrame, share: float = 1.5, cap: float = 2.0, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per source: size, target, epochs and the key at which the last epoch ends."""
    rows = cut_lineage(docs.select(F.col(source).alias("source"), random_key(F.col(doc_id), seed).alias("key"), word_count(F.col(text)).alias("size")), "mix")
    part = F.shiftright("key", KEY_BITS - RANGE_BITS)
    ranges = cut_lineage(rows.groupBy("source", part.alias("part")).agg(F.sum("size").alias("words")), "mix-ranges")
    sizes = ranges.groupBy("source").agg(F.sum("words").alias("source_size"))
    weighted = sizes.alias("a").join(weights.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "source_size", "weight")
    targets = fill(weighted, share, cap).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = cut_lineage(targets.withColumn("rest", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size")), "mix-targets")

    def cut(sums: DataFrame, along: str, rest: str) -> DataFrame:
        """The row of each source inside which its running sum passes `rest`, and what is left there."""
        order = Window.partitionBy("source").orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
        left = F.col(rest) - F.coalesce(F.sum("words").over(order), F.lit(0))
        return sums.withColumn("left", left).where((F.col("left") >= 0) & (F.col("left") < F.col("words")))

    def with_source(a: DataFrame, b: DataFrame, kind: str, *columns: str) -> DataFrame:
        return a.alias("a").join(b.select(F.col("source").alias("other"), *columns), F.col("a.source").eqNullSafe(F.col("other")), kind).drop("other")

    coarse = cut(with_source(ranges, targets, "inner", "rest"), "part", "rest").select("source", F.col("part").alias("cut_part"), F.col("left").alias("rest"))
    at_cut = with_source(rows.withColumn("part", part), cut_lineage(coarse, "mix-cut"), "inner", "cut_part", "rest").where("part = cut_part")
    keys = at_cut.groupBy("source", "key").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"))
    cuts = cut(keys, "key", "rest").select("source", F.col("key").alias("cut_key"), F.col("words").alias("tied_words"), "left")
    return cut_lineage(with_source(targets, cuts, "left", "cut_key", "tied_words", "left").drop("rest"), "mix-plan")


def apply_plan(docs: DataFrame, plan: DataFrame, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """`docs` with size, source_size, target and taken: the words that the mix takes, repeats counted."""
    rows = packed(docs, size=word_count(F.col(text)), key=random_key(F.col(doc_id), seed), of=F.col(source))
    joined = rows.join(plan, F.col("of").eqNullSafe(F.col("source")), "left")
    last = (
        F.when(F.col("key") < F.col("cut_key"), F.col("size"))
        .when(F.col("key") == F.col("cut_key"), F.floor(F.col("left").cast("decimal(19,0)") * F.col("size") / F.col("tied_words")).cast("long"))
        .otherwise(0)
    )
    taken = F.col("size") * F.col("epochs") + last
    return unpacked(joined, docs, size=F.col("size"), source_size=F.col("source_size"), target=F.col("target"), taken=taken)


def mix(docs: DataFrame, weights: DataFrame, share: float = 1.5, cap: float = 2.0, seed: str = "mix", **columns: str) -> DataFrame:
    return apply_plan(docs, budget_plan(docs, weights, share, cap, seed, **columns), seed, **columns)


def write_out(mixed: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The mix itself: each document as often as it is taken; the copy at the cut keeps its first words.

    Takes the result of `mix` and drops its columns. `n_chars`, where present, follows the text.
    """
    whole = F.floor(F.col("taken") / F.col("size"))
    part = F.col("taken") % F.col("size")
    rows = packed(mixed, whole=whole, part=part, words=F.col(text)).where("row.taken > 0")
    copies = rows.withColumn("copy", F.explode(F.expr("sequence(1L, whole + if(part > 0, 1, 0))")))
    pieces = F.slice(F.expr(r"split(regexp_replace(words, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+')"), F.lit(1), F.greatest(F.col("part"), F.lit(1)).cast("int"))
    cut = F.col("copy") > F.col("whole")
    changed = {text: F.when(cut, F.array_join(pieces, " ")).otherwise(F.col("words"))}
    if n_chars in mixed.columns:
        changed[n_chars] = F.when(cut, F.length(F.array_join(pieces, " "))).otherwise(F.col("row").getField(n_chars)).cast(mixed.schema[n_chars].dataType)
    names = [c for c in mixed.columns if c not in ("size", "source_size", "target", "taken")]
    return copies.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in names))
