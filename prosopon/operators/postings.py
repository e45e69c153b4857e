"""Batch search over a corpus by a table of postings.

A text's folded lower case gives its different runs of one to three letters, and so do the first letters of its words. Whatever ranks against a query
has one of these in common with it: a text that contains the query has all the query's runs, one whose acronym contains it has all of them
in its acronym, and one that has the query's letters in order has each of its letters. So each query is met with the postings of its rarest
run of each kind, and only the texts found there are ranked. The table is written once, bucketed by run, and searched as often as wanted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosopon.functions import search
from prosopon.operators import ordering
from prosopon.session import cut_lineage, new_table

#: Letters of the longest run.
LONGEST = 3
#: Kinds of runs: of the text, of its acronym.
TEXT, ACRONYM = "t", "a"


@dataclass
class Index:
    texts: DataFrame  # (id, text)
    postings: DataFrame  # (kind, run, id, letters), bucketed by kind and run
    sizes: DataFrame  # (kind, run, texts)


def runs(low: Column, lengths: range) -> Column:
    """Different runs of letters of a text, of each length."""
    each = [F.regexp_extract_all(low, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in lengths]
    return F.array_distinct(F.concat(*each))


def letters(low: Column) -> Column:
    """A bit per letter of the text (letters share bits)."""
    each = F.array_distinct(F.split(low, ""))
    return F.aggregate(each, F.lit(0).cast("bigint"), lambda a, c: F.when(c == "", a).otherwise(a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(c), F.lit(62)).cast("int")))))


def build(docs: DataFrame, id_column: str, text_column: str, buckets: int | None = None) -> Index:
    """The postings of `docs`, whose ids are unique; `buckets` is the session's number of shuffle partitions unless given."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    low = search.folded(F.col("text"))["low"]
    named = texts.select("id", low.alias("low")).select("id", "low", search.acronym(F.col("low")).alias("acronym"), letters(F.col("low")).alias("letters"))
    own = lambda kind, c: F.transform(F.concat(F.array(F.lit("")), runs(c, range(1, LONGEST + 1))), lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("run")))
    rows = named.select("id", "letters", F.explode(F.concat(own(TEXT, F.col("low")), own(ACRONYM, F.col("acronym")))).alias("p")).select("p.kind", "p.run", "id", "letters")
    postings = new_table(rows, "postings", buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "kind", "run")
    return Index(texts, postings, cut_lineage(postings.groupBy("kind", "run").agg(F.count("*").alias("texts")), "sizes"))


def candidates(index: Index, queries: DataFrame) -> DataFrame:
    """(query, id) of the texts that can rank against each of `queries` (query, asked)."""
    low = F.col("asked.low")
    longest = F.filter(runs(low, range(1, LONGEST + 1)), lambda r: F.length(r) == F.least(F.lit(LONGEST), F.length(low)))
    single = F.filter(F.array_distinct(F.split(low, "")), lambda c: c != "")
    way = lambda way, kind, rs: F.transform(rs, lambda r: F.struct(F.lit(way).alias("way"), F.lit(kind).alias("kind"), r.alias("run")))
    whole = F.when(F.length(low) == 0, F.array(F.lit(""))).otherwise(longest)
    ways = F.concat(way("contains", TEXT, whole), F.when(F.length(low) > 1, F.concat(way("acronym", ACRONYM, longest), way("letters", TEXT, single))).otherwise(F.array().cast("array<struct<way:string,kind:string,run:string>>")))
    asked = queries.select("query", letters(low).alias("wanted"), F.explode(ways).alias("w")).select("query", "wanted", "w.*")
    known = asked.join(index.sizes, ["kind", "run"], "left")
    # A run that no text has leaves its way without candidates.
    rarest = known.groupBy("query", "wanted", "way", "kind").agg(F.min_by("run", F.struct(F.coalesce("texts", F.lit(0)), "run")).alias("run"))
    met = rarest.join(index.postings, ["kind", "run"])
    fits = (F.col("way") != "letters") | (F.col("letters").bitwiseAND(F.col("wanted")) == F.col("wanted"))
    return met.where(fits).select("query", "id").distinct()


def find(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query, rank, id, text, place): the k best texts of each of `queries` (query), ties by id."""
    asked = queries.select("query").distinct().select("query", search.folded(F.col("query")).alias("asked"))
    met = candidates(index, asked).join(index.texts, "id").join(asked, "query")
    ranked = met.select("query", search.rank_of(search.folded(F.col("text")), F.col("asked")).alias("rank"), "id").where(F.col("rank") > 0)
    best = ordering.first_per_key(cut_lineage(ranked, "ranked"), "query", [F.col("rank").desc(), F.col("id")], k)
    return best.join(index.texts, "id").select("query", "rank", "id", "text", "place")
