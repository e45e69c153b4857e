"""Corpora of files, plain text and HTML, all brought to the same document rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from prosopon.functions import markup
from prosopon.functions import text as t
from prosopon.session import new_folder
from prosopon.sources import schemas

BINARY_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
#: Bytes that a file counts for besides its own where files are dealt to tasks. Spark counts 4 MB, which makes a task of every 32 files, however small.
OPEN_COST = 64 << 10
_COST = "spark.sql.files.openCostInBytes"
#: Bytes of files, and names of a folder, that a task brings out at once.
BATCH_BYTES, _ROWS = 16 << 20, 10_000
_ENTRY = "name string, folder boolean, millis bigint, length bigint"


def relative_path(path: Column, base: str) -> Column:
    """Path below `base`, whatever scheme the file system put in front."""
    bare = base.split("://", 1)[-1].rstrip("/").removeprefix("file:")
    tail = F.element_at(F.split(path, F.lit("\\Q" + bare + "/\\E"), 2), -1)
    return F.url_decode(F.replace(tail, F.lit("+"), F.lit("%2B")))


def _files_of_driver(spark: SparkSession, base: str, pattern: str) -> DataFrame:
    """All files below `base` whose name matches, by Spark's reader, many small ones to a task. Every file is held in the driver.

    How files are dealt to tasks is a setting of the session that reads a folder: one beside the caller's does, with the caller's settings, and OPEN_COST unless
    the caller has an own value. The union with nothing brings the table back into the caller's session; the plan that runs has no part of it.
    """
    beside = spark.newSession()
    beside.conf.set(_COST, str(OPEN_COST))
    for key, value in spark.conf.getAll.items():
        if not key.startswith("spark.") or key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            beside.conf.set(key, value)
    found = beside.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(base)
    return spark.createDataFrame([], BINARY_SCHEMA).limit(0).union(found)


def _entries(top: str):
    """What lies in the folders of a batch, names from `top` on; the names that Spark's reader passes over are left out."""

    def listed(batches):
        import os
        from itertools import batched
        from stat import S_ISDIR, S_ISREG

        import pyarrow as pa

        def entries(folder):
            with os.scandir(f"{top}{folder}" or "/") as found:
                for entry in found:
                    name = entry.name
                    try:
                        facts = entry.stat()
                    except FileNotFoundError:  # a link to nothing, or deleted meanwhile
                        continue
                    if name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"):
                        if not (S_ISDIR(facts.st_mode) and name.startswith(("_metadata", "_common_metadata"))):
                            continue
                    if S_ISDIR(facts.st_mode) or S_ISREG(facts.st_mode):
                        yield f"{folder}/{name}", S_ISDIR(facts.st_mode), facts.st_mtime_ns // 1_000_000, facts.st_size

        kinds = pa.schema([("name", pa.string()), ("folder", pa.bool_()), ("millis", pa.int64()), ("length", pa.int64())])
        for batch in batches:
            for folder in batch.column("name").to_pylist():
                for some in batched(entries(folder), _ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), kinds, strict=True)], schema=kinds)

    return listed


def _place(spark: SparkSession, base: str) -> tuple[str, str] | None:
    """(name of the folder `base` on the tasks' disks, in the paths of its files); None if it is in another file system, or no folder that tasks see."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    path = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path)
    top = path.toUri().getPath().rstrip("/")

    def seen(_):
        import os

        return [os.path.isdir(top or "/")]

    if path.toUri().getScheme() != "file" or not spark.sparkContext.parallelize([top], 1).mapPartitions(seen).first():
        return None
    return top, path.toString().rstrip("/")


def _listed(spark: SparkSession, base: str, pattern: str) -> tuple[DataFrame, str, str] | None:
    """(path, modificationTime and length of all files below `base` whose name matches, and its `_place`); None where tasks cannot list it.

    Tasks list the folders of a level, into a table of the shared folder; the driver gets their number only. One task lists a folder, entry by entry.
    """
    try:
        place = _place(spark, base)
        into = new_folder(spark, "listing")
    except Exception:  # no such file system, no shared folder: Spark's reader may know better, and has the errors that callers expect
        return None
    if place is None:
        return None
    (top, shown), levels = place, []
    folders, waiting, most = spark.createDataFrame([("",)], "name string"), 1, int(spark.conf.get("spark.sql.shuffle.partitions"))
    while waiting:
        levels.append(f"{into}/level-{len(levels)}")
        folders.repartition(min(waiting, most)).mapInArrow(_entries(top), _ENTRY).write.parquet(levels[-1])
        folders = spark.read.schema(_ENTRY).parquet(levels[-1]).where("folder").select("name")
        waiting = folders.count()
    glob = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
    matches = F.element_at(F.split("name", "/"), -1).rlike(rf"(?s)\A(?:{glob})\z")
    found = spark.read.schema(_ENTRY).parquet(*levels).where(~F.col("folder") & (F.col("length") > 0) & matches)
    return found.select(F.concat(F.lit(shown), "name").alias("path"), F.timestamp_millis("millis").alias("modificationTime"), "length"), top, shown


def _content(top: str, shown: str, missing: bool):
    """Content of the files with these paths. Not deterministic, so that no filter behind it opens them a second time."""

    @F.pandas_udf("binary")
    def content(paths: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in paths:
            held, size = [], 0
            for path in series:
                try:
                    with open(top + path.removeprefix(shown), "rb") as file:
                        held.append(file.read())
                except FileNotFoundError:
                    if not missing:
                        raise
                    held.append(None)
                size += len(held[-1] or b"")
                if size >= BATCH_BYTES:
                    yield pd.Series(held, dtype=object)
                    held, size = [], 0
            if held:
                yield pd.Series(held, dtype=object)

    return content.asNondeterministic()


def _tasks(spark: SparkSession, files: DataFrame) -> int:
    """How many tasks Spark's reader would deal these files to, at OPEN_COST a file unless the session has an own value."""
    settings, conf = spark.conf.getAll, spark._jsparkSession.sessionState().conf()
    cost = conf.filesOpenCostInBytes() if _COST in settings else OPEN_COST
    count, length = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    least = int(settings.get("spark.sql.files.minPartitionNum") or settings.get("spark.sql.leafNodeDefaultParallelism") or spark.sparkContext.defaultParallelism)
    share = min(conf.filesMaxPartitionBytes(), max(cost, (length + count * cost) // least))
    return max(1, min(count, int(settings.get("spark.sql.files.maxPartitionNum") or count), -(-(length + count * cost) // share)))


def listing(spark: SparkSession, base: str, pattern: str = "*.docx") -> DataFrame:
    """(path below `base`, modified, length) of all files whose name matches; no file is opened."""
    listed = _listed(spark, base, pattern)
    files = _files_of_driver(spark, base, pattern) if listed is None else listed[0]
    return files.select(relative_path(F.col("path"), base).alias("path"), F.col("modificationTime").alias("modified"), "length")


def with_identity(files: DataFrame, base: str) -> DataFrame:
    """Adds relative path, title (file stem), id (slugs of the path), image key and content digest."""
    relative = relative_path(F.col("path"), base)
    stem = t.path_stem(F.col("relative_path"))
    return files.withColumn("relative_path", relative).withColumns(
        {
            "title": stem,
            "doc_id": t.path_id(F.col("relative_path")),
            "image_key": t.image_key(stem),
            "digest": F.sha2("content", 256),
        }
    )


def scan(spark: SparkSession, base: str, pattern: str = "*.docx", among: DataFrame | None = None) -> DataFrame:
    """All files below `base` whose name matches, or those `among` (path, modified; from a `listing`); a missing folder is an error here, not a warning.

    Tasks find and open the files of a local or mounted folder; others are listed by the driver, in its memory. A file is opened only if what is made of it asks
    for its content. Of files `among` others, the driver's way opens all that are as new as the oldest.
    """
    found = _listed(spark, base, pattern)
    wanted = None if among is None else among.select(F.col("path").alias("relative_path"))
    if found is None:
        files = with_identity(_files_of_driver(spark, base, pattern), base)
        if wanted is None:
            return files
        oldest = among.agg(F.min("modified")).first()[0]
        recent = files.where(F.col("modificationTime") >= F.lit(oldest).cast("timestamp"))  # none among: no file
        return recent.join(wanted, "relative_path", "left_semi").select(*files.columns)
    listed, top, shown = found
    if wanted is not None:
        listed = listed.withColumn("relative_path", relative_path(F.col("path"), base)).join(wanted, "relative_path", "left_semi").drop("relative_path")
    missing = spark.conf.get("spark.sql.files.ignoreMissingFiles").lower() == "true"
    files = listed.repartition(_tasks(spark, listed)).withColumn("content", _content(top, shown, missing)(F.col("path")))
    return with_identity(files.where(F.col("content").isNotNull()) if missing else files, base)


def scan_or_empty(spark: SparkSession, base: str, pattern: str = "*.docx") -> tuple[DataFrame, list[str]]:
    """(files, warnings): a missing folder or a pattern without matches gives an empty table and a warning."""
    try:
        found = scan(spark, base, pattern)
    except Exception as err:  # the reader has no exception type of its own for a missing path
        if "PATH_NOT_FOUND" not in str(err):
            raise
        return with_identity(spark.createDataFrame([], BINARY_SCHEMA), base), [f'The base directory "{base}" does not exist.']
    if not found.select("length").take(1):  # isEmpty() would run every task
        return found, [f'No files found matching "{pattern}" in directory "{base}"']
    return found, []


def _plain_block(kind: Column, level: Column, text: Column) -> Column:
    span = F.struct(text.alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit(False).alias("underline"))
    return F.struct(
        kind.alias("kind"), level.cast("int").alias("level"), text.alias("text"), F.array(span).alias("spans"),
        F.lit(None).cast("string").alias("html"),
    )


def _documents(df: DataFrame, id_column: str, blocks: Column) -> DataFrame:
    return df.select(
        F.col(id_column).cast("string").alias("doc_id"),
        blocks.cast(schemas.BLOCKS).alias("blocks"),
        F.array().cast(schemas.ATTACHMENTS).alias("attachments"),
        F.lit(None).cast("string").alias("problem"),
    )


def dealt(df: DataFrame, partitions: int | None) -> DataFrame:
    """`df` in as many partitions as the caller asks for: few large files would otherwise be read, and worked on, by few tasks."""
    return df if partitions is None else df.repartition(partitions)


def from_text(df: DataFrame, id_column: str, text_column: str, partitions: int | None = None) -> DataFrame:
    """One paragraph block per line; `partitions` deals the rows out anew first."""
    df = dealt(df.select(id_column, text_column), partitions)
    lines = F.split(F.col(text_column), "\n")
    return _documents(df, id_column, F.transform(lines, lambda s: _plain_block(F.lit("paragraph"), F.lit(None), s)))


def from_html(df: DataFrame, id_column: str, html_column: str, partitions: int | None = None) -> DataFrame:
    """Paragraph, heading and list-item blocks in page order; `partitions` deals the rows out anew first."""
    df = dealt(df.select(id_column, html_column), partitions)

    def block(piece: Column) -> Column:
        tag = F.lower(F.regexp_extract(piece, r"^<([A-Za-z0-9]+)", 1))
        kind = F.when(tag == "p", "paragraph").when(tag == "li", "list").otherwise("heading")
        return _plain_block(kind, F.when(kind == "heading", F.substring(tag, 2, 1)), markup.visible_text(piece))

    return _documents(df, id_column, F.transform(markup.html_pieces(F.col(html_column)), block))


def blocks_table(documents: DataFrame) -> DataFrame:
    """One row per block: doc_id, idx, kind, level, text, html, lead_bold."""
    from prosopon.operators.segments import lead_bold

    rows = documents.select("doc_id", F.posexplode_outer("blocks").alias("idx", "b")).where(F.col("idx").isNotNull())
    b = F.col("b")
    return rows.select(
        "doc_id", "idx", "b.kind", "b.level", "b.text", markup.render_block(b).alias("html"), lead_bold(b).alias("lead_bold")
    )


def attachments_table(documents: DataFrame) -> DataFrame:
    rows = documents.select("doc_id", F.posexplode_outer("attachments").alias("pos", "a")).where(F.col("pos").isNotNull())
    return rows.select("doc_id", "pos", "a.*")


@F.pandas_udf(ArrayType(StringType()))
def anchors(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Per page the anchors of its slugs, in one pass: a slug's next number is kept, numbers that another heading has taken are skipped."""

    def of(slugs):
        taken, following, found = set(), {}, []
        for slug in () if slugs is None else slugs:
            anchor = slug
            while anchor in taken:
                following[slug] = following.get(slug, 0) + 1
                anchor = f"{slug}-{following[slug]}"
            taken.add(anchor)
            found.append(anchor)
        return found

    for series in pages:
        yield series.map(of)


def heading_anchors(documents: DataFrame, kinds: tuple[str, ...] = ("heading",)) -> DataFrame:
    """Anchor per heading: its slug, or the first of `-1`, `-2` ... that no earlier heading of the page has taken."""
    blocks = F.filter(F.transform("blocks", lambda b, i: F.struct(i.alias("idx"), b["kind"].alias("kind"), b["text"].alias("text"))), lambda b: b["kind"].isin(list(kinds)))
    named = F.transform(blocks, lambda b: F.struct(b["idx"].alias("idx"), b["text"].alias("text"), t.slugify(b["text"]).alias("slug")))
    numbered = documents.select("doc_id", named.alias("named")).select("doc_id", "named", anchors(F.col("named.slug")).alias("anchors"))
    # The outer form: the plain one infers a filter that would take the pages apart a second time.
    rows = numbered.select("doc_id", F.explode_outer(F.arrays_zip("named", "anchors")).alias("h")).where(F.col("h").isNotNull())
    return rows.select("doc_id", "h.named.idx", "h.named.text", F.col("h.anchors").alias("anchor"))
