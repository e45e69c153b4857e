"""A corpus of biographies written from the customer, orders and nation tables.

Each customer becomes one document with every block kind and every defect the extraction knows. One
aggregation with a fixed number of conditional aggregates feeds it, so a customer with a third of all orders
costs no more than any other: rows are combined before the shuffle and no list is collected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosopon.functions import roles as role_functions
from prosopon.operators.extract import extract_all
from prosopon.profile import Profile
from prosopon.sources import schemas

# Nation key → (country, feminine form, masculine form, spelling used in the texts).
NATIONS = [
    ("Algeria", "Algerian", "Algerian", "Algerian"), ("Argentina", "Argentine", "Argentine", "Argentinean"),
    ("Brazil", "Brazilian", "Brazilian", "Brazilian"), ("Canada", "Canadian", "Canadian", "Canadian"),
    ("Egypt", "Egyptian", "Egyptian", "Egyptian"), ("Ethiopia", "Ethiopian", "Ethiopian", "Ethiopian"),
    ("France", "French", "French", "French"), ("Germany", "German", "German", "German"),
    ("India", "Indian", "Indian", "Indian"), ("Indonesia", "Indonesian", "Indonesian", "Indonesian"),
    ("Iran", "Iranian", "Iranian", "Iranian"), ("Iraq", "Iraqi", "Iraqi", "Iraqi"),
    ("Japan", "Japanese", "Japanese", "Japanese"), ("Jordan", "Jordanian", "Jordanian", "Jordanian"),
    ("Kenya", "Kenyan", "Kenyan", "Kenyan"), ("Morocco", "Moroccan", "Moroccan", "Moroccan"),
    ("Mozambique", "Mozambican", "Mozambican", "Mozambican"), ("Peru", "Peruvian", "Peruvian", "Peruvian"),
    ("China", "Chinese", "Chinese", "Chinese"), ("Romania", "Romanian", "Romanian", "Romanian"),
    ("Saudi Arabia", "Saudi Arabian", "Saudi Arabian", "Saudi Arabian"), ("Vietnam", "Vietnamese", "Vietnamese", "Vietnamese"),
    ("Russia", "Russian", "Russian", "Russian"), ("Philippines", "Filipina", "Filipino", "Filipino"),
    ("United States", "American", "American", "American"),
]

FORMS = [(form, country) for country, f, m, _ in NATIONS for form in (f, m)]
PROFILE = Profile()
LONG_TEXT = "The archives hold the papers in full. "


def demonyms(spark: SparkSession) -> DataFrame:
    rows = [
        (i, country, form, word, True)
        for i, (country, f, m, _) in enumerate(NATIONS)
        for form, word in (("f", f), ("m", m))
    ]
    return spark.createDataFrame([*rows, (len(NATIONS), "Utopia", "f", "Japan", False)], schemas.DEMONYMS)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tasks(spark: SparkSession) -> int:
    """How many partitions heavy work on few files is dealt into: as many as the session shuffles with."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def people(spark: SparkSession, sf_dir: str, customers: DataFrame | None = None) -> DataFrame:
    """One row per customer with the facts the documents are written from; `customers` may be a stream."""
    day = F.col("o_orderdate")
    per_status = [
        agg
        for s in "FOP"
        for agg in (
            F.min(F.when(F.col("o_orderstatus") == s, F.year(day))).alias(f"{s}_from"),
            F.max(F.when(F.col("o_orderstatus") == s, F.year(day))).alias(f"{s}_to"),
            F.count_if(F.col("o_orderstatus") == s).alias(f"{s}_n"),
        )
    ]
    per_priority = [
        F.count_if(F.startswith("o_orderpriority", F.lit(str(p)))).alias(f"p{p}") for p in range(1, 6)
    ]
    facts = (
        read(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(F.max(day).alias("last_order"), *per_status, *per_priority)
    )
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    # The facts are already partitioned by customer. A broadcast would leave the heavy work that follows to the
    # few splits of the customer scan, so the join goes by partition.
    joined = (
        (read(spark, sf_dir, "customer") if customers is None else customers)
        .join(facts.hint("merge"), F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(nation.select("n_nationkey", "r_name"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    )
    stem = F.concat(F.lit("ka"), F.translate(F.col("c_custkey").cast("string"), "0123456789", "abcdefghij"))
    return joined.withColumn("stem", stem).withColumn("upper_stem", F.upper("stem"))


def by_segment(values: dict[str, Column], default: Column) -> Column:
    result = default
    for segment, value in values.items():
        result = F.when(F.col("c_mktsegment") == segment, value).otherwise(result)
    return result


def surname() -> Column:
    u = F.col("upper_stem")
    return by_segment(
        {
            "BUILDING": F.concat(u, F.lit("-LEE")),
            "FURNITURE": F.concat(F.lit("VAN "), u),
            "HOUSEHOLD": F.concat(F.lit("O’"), u),
            "MACHINERY": F.concat(F.lit("[VAN DER] É"), u),
        },
        u,
    )


def given() -> Column:
    return F.when(F.col("c_acctbal") < 3000, "Ana Lúcia").otherwise("Jan")


def paren() -> Column:
    return by_segment(
        {
            "BUILDING": F.lit(" (née Harlem)"),
            "FURNITURE": F.concat(F.lit(" (known as Van "), F.initcap(F.col("stem")), F.lit(")")),
            "HOUSEHOLD": F.lit(" (Bob)"),
            "MACHINERY": F.lit(" (called Ted)"),
        },
        F.lit(""),
    )


def spelling() -> Column:
    names = F.array(*[F.lit(row[3]) for row in NATIONS])
    return F.element_at(names, F.col("c_nationkey") + 1)


def ordinal(n: Column) -> Column:
    words = F.array(*[F.lit(w) for w in role_functions.ORDINALS])
    return F.element_at(words, F.least(n, F.lit(16)).cast("int"))


def clauses() -> Column:
    """The role clauses, one per order status that occurs."""
    region = F.col("r_name")

    def years(s: str, single: str, dash: str) -> Column:
        a, b = F.col(f"{s}_from"), F.col(f"{s}_to")
        return F.when(a == b, F.concat(F.lit(single), a.cast("string"))).otherwise(F.concat(a, F.lit(dash), b))

    first = F.when(
        F.col("F_n") > 0,
        F.concat(ordinal(F.col("F_n")), F.lit(" Secretary-General of the Organisation of "), region, F.lit(" States (OAS), "), years("F", "", "–")),
    )
    second = F.when(
        F.col("O_n") > 0,
        F.concat(F.lit("Director to the "), region, F.lit(" Commission (UN EC) Secretariat "), years("O", "in ", "-")),
    )
    third = F.when(
        F.col("P_n") > 0,
        F.concat(ordinal(F.col("P_n")), F.lit(" United Nations High Commissioner for Refugees "), years("P", "March-May ", " - ")),
    )
    return F.filter(F.array(first, second, third), lambda c: c.isNotNull())


def summary() -> Column:
    balance = F.col("c_acctbal")
    return (
        F.when(balance < -400, F.lit("Martian economist and former diplomat"))
        .when(balance < -200, F.lit("1995-1999"))
        .otherwise(
            F.concat(spelling(), F.lit(" lawyer and "), F.array_join(F.slice(clauses(), 1, 1), ""),
                     F.when(F.size(clauses()) > 1, F.concat(F.lit(" and "), F.array_join(F.slice(clauses(), 2, 2), ", "))).otherwise(F.lit("")))
        )
    )


def life() -> Column:
    return F.concat(F.lit("was born 1 January 1950 in "), F.col("r_name"), F.lit(" and died in Rome"))


def intro() -> Column:
    balance = F.col("c_acctbal")
    return (
        F.when(balance < -800, F.lit(""))
        .when(balance < -600, F.concat(surname(), F.lit(" has no readable vitals")))
        .otherwise(F.concat(surname(), F.lit(", "), given(), paren(), F.lit(", "), summary(), F.lit(", "), life()))
    )


def authors() -> Column:
    n = F.col("c_nationkey").cast("string")
    return by_segment(
        {
            "BUILDING": F.concat(F.lit("Ada N"), n, F.lit(", Jr. and Bo Ray")),
            "FURNITURE": F.concat(F.lit("Ada N"), n, F.lit(" & Cy Orr and Bo Ray")),
        },
        F.concat(F.lit("Ada N"), n),
    )


def version() -> Column:
    last = F.col("last_order")
    return by_segment(
        {"MACHINERY": F.concat(F.lit("Version "), F.year(last).cast("string")), "HOUSEHOLD": F.lit("Version 31 February 2019")},
        F.concat(F.lit("Version "), F.date_format(last, "d MMMM yyyy")),
    )


def archive_items() -> Column:
    items = [
        F.when(F.col(f"p{p}") > 0, F.concat(F.lit(f"Priority {p} papers, http://arch.example/;box="), F.col(f"p{p}").cast("string")))
        for p in range(1, 6)
    ]
    return F.filter(F.array(*items), lambda c: c.isNotNull())


def block(kind: str, *spans: tuple[Column, str], level: int | None = None) -> Column:
    """A block from (text, style letters) pairs; b, i and u are bold, italic and underline."""
    parts = [
        F.struct(text.alias("text"), F.lit("b" in style).alias("bold"), F.lit("i" in style).alias("italic"), F.lit("u" in style).alias("underline"))
        for text, style in spans
    ]
    return F.struct(
        F.lit(kind).alias("kind"), F.lit(level).cast("int").alias("level"),
        F.concat(*[text for text, _ in spans]).alias("text"), F.array(*parts).alias("spans"),
        F.lit(None).cast("string").alias("html"),
    )


def blocks() -> Column:
    lit, segment = F.lit, F.col("c_mktsegment")
    blank = block("paragraph", (lit(""), ""))
    items = archive_items()
    first_items = F.array_join(F.transform(F.slice(items, 1, 2), lambda i: F.concat(i, lit(";"))), " ")
    more_items = F.array_join(F.slice(items, 3, 3), ";  ")
    key = F.col("c_custkey").cast("string")
    cited = F.concat(authors(), lit(", ‘"), surname(), lit(", "), given(), lit("’ " + PROFILE.citation_marker + ", version 1"))
    parts = [
        block("paragraph", (intro(), "")),
        F.when(segment == "BUILDING", block("paragraph", (F.concat(lit(" Name changed in "), F.col("r_name"), lit(". ")), "i"))),
        blank,
        F.when(
            F.col("F_n") > 2,
            block("paragraph", (F.concat(lit("Source: Photograph by K. Stone – https://www.pics"), F.col("c_nationkey").cast("string"),
                                         lit(".example/p/"), key, lit("?a=1&b=2).")), "")),
        ),
        F.when(segment == "FURNITURE", block("paragraph", (lit("On film: see the newsreel"), ""))),
        blank,
        block("heading", (lit("Biography"), ""), level=2),
        block("paragraph", (F.concat(lit("Life & work in "), F.col("r_name"), lit(" <")), ""), (key, "bi"), (lit("> "), "u")),
        F.when(segment == "MACHINERY", block("paragraph", (F.repeat(lit(LONG_TEXT), 15), ""))),
        block("list", (F.concat(lit("Post "), key), "")),
        F.when(F.col("P_n") > 1, block("paragraph", (F.concat(lit("By "), F.upper(authors())), ""))),
        F.when(F.col("p1") > 0, block("paragraph", (lit("ARCHIVES"), "b"), (lit(":"), "b"), (F.concat(lit(" "), first_items), ""))),
        F.when(F.col("p1") > 0, block("paragraph", (F.concat(lit(" "), more_items, lit(". (all websites accessed 1 May 2020).")), ""))),
        F.when(F.col("O_n") > 2, block("paragraph", (lit("PUBLICATIONS"), "b"), (F.concat(lit(" On "), F.col("r_name"), lit(", 1999;; ; Memoirs,; ")), ""))),
        F.when(F.col("P_n") > 1, block("paragraph", (lit("LITERATURE"), "bi"), (lit(": "), ""), (F.concat(lit("Life of "), F.col("upper_stem"), lit(".")), ""))),
        F.when(F.col("last_order").isNotNull() & (segment != "AUTOMOBILE"), block("paragraph", (version(), "b"))),
        F.when(F.col("P_n") > 0, block("paragraph", (lit("How to cite this Lives Register entry?"), "b"))),
        F.when(F.col("P_n") > 0, block("paragraph", (cited, ""))),
    ]
    return F.filter(F.array(*parts), lambda b: b.isNotNull())


def attachments() -> Column:
    def one(name: Column, extension: Column, data: Column) -> Column:
        return F.struct(name.alias("name"), extension.alias("extension"), F.lit("image/*").alias("mime"), data.cast("binary").alias("data"))

    key = F.col("c_custkey").cast("string")
    ext = F.when(F.col("c_mktsegment") == "MACHINERY", "emf").otherwise("png")
    stub = one(F.lit("image"), F.lit(""), F.lit(""))
    photo = F.when(F.col("F_n") > 1, one(F.concat(F.lit("photo"), key, F.lit("."), ext), F.lit(""), F.concat(F.lit("bytes"), key)))
    return F.filter(F.array(stub, photo), lambda a: a.isNotNull())


_PLANS: dict[tuple[str, str, str], DataFrame] = {}


def _planned(kind: str, spark: SparkSession, sf_dir: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The lazy DataFrame of this kind, put together once per application; only the plan is kept, no rows."""
    key = (kind, spark.sparkContext.applicationId, sf_dir)
    if key not in _PLANS:
        _PLANS[key] = build()
    return _PLANS[key]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`doc_id, blocks, attachments`, one row per customer."""

    return _planned("documents", spark, sf_dir, lambda: written(people(spark, sf_dir)))


def written(persons: DataFrame) -> DataFrame:
    return persons.select(
        F.concat(F.lit("entry-"), F.col("c_custkey").cast("string")).alias("doc_id"),
        blocks().cast(schemas.BLOCKS).alias("blocks"),
        attachments().cast(schemas.ATTACHMENTS).alias("attachments"),
    )


def bios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extracted biographies of these documents."""
    return _planned("bios", spark, sf_dir, lambda: extract_all(documents(spark, sf_dir), PROFILE, FORMS))
