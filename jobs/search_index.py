"""A search index of notes, kept up to date: postings for ranked search, and the list of notes that they are of.

Each run compares the notes with those of the last run by their contents' hashes. Notes of a vault are dealt over
slices by their paths; a slice in which a note is new, changed or gone is made anew from its notes' texts, and other
slices aren't touched. The list of notes is written last, and only then counts: a run that failed leaves the old
list, or parts of none, and the next one finds the same slices to do again.

    python -m jobs.search_index jobs/search_index.toml

Texts are read twice, to hash them and, those of the slices concerned only, to index them; they are shuffled once, by
slice, and postings are made where a slice lies, sorted by term, so that a reader of some terms skips most of a file. A
posting has its note's hash and state, so that reading the index back joins and moves nothing.
Set `slices` so that a vault's slice is some 100 MB. A note that is gone stays on the list as deleted.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs._run import main, overwrite, read_if_there
from quillspark.operators.diff import EFFECTS, content_hash, report, scan_diff
from quillspark.operators.ranked import Index, plain_rows
from quillspark.sources import adapters

NOTES = "path string, content_hash string, state string, vault string, slice int"
POSTINGS = "path string, state string, content_hash string, term string, positions array<int>, dl long, vault string, slice int"
KEY = ["vault", "slice", "path"]
#: Notes that a task indexes and a file holds: few enough to sort their postings in memory, and for dictionaries of their
#: paths and hashes in the file.
NOTES_A_FILE = 5000
log = logging.getLogger("search_index")


def run(spark: SparkSession, source: str, out: str, work: str, slices: int = 16) -> dict[str, int]:
    """Brings the index (out/postings and out/notes, by vault and slice) up to the documents in the folder source.

    work: a folder for the comparison, which a run needs several times. Returns how many notes were new, changed, the
    same and gone. Of rows with the same vault and path the one with the smallest hash is the note; a null text is an
    empty one; rows without a vault or a path aren't notes.
    """
    out, work = out.rstrip("/"), work.rstrip("/")
    place = F.pmod(F.xxhash64("path"), F.lit(slices)).cast("int")
    content = F.coalesce(F.col("content"), F.lit(""))
    notes = adapters.files(spark, source).where("vault is not null and path is not null").select("vault", "path", place.alias("slice"), content.alias("content"), content_hash(content).alias("content_hash"))
    known = read_if_there(spark, f"{out}/notes", NOTES)

    listing = notes.groupBy("vault", "path").agg(F.min("content_hash").alias("content_hash"))
    stat = {"size": F.lit(0), "mtime": F.lit(None).cast("string")}  # nothing is known of either, so the hash decides
    found = scan_diff(listing.withColumns(stat), known.where("state = 'live'").withColumns(stat)).withColumn("slice", place)
    found.write.mode("overwrite").parquet(f"{work}/changes")
    changes = spark.read.schema(found.schema).parquet(f"{work}/changes")
    sums = report(changes).agg(*[F.coalesce(F.sum(e), F.lit(0)).alias(e) for e in EFFECTS]).first()
    log.info("read %s and %s: %s", source, f"{out}/notes", sums.asDict())

    concerned = changes.where(F.col("effect").isin("inserted", "updated", "deleted")).select("vault", "slice").distinct()
    n, notes_in, most = changes.join(concerned, ["vault", "slice"], "left_semi").groupBy("vault", "slice").agg(F.count("*").alias("n")).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if n:
        touched = lambda df: df.join(concerned, ["vault", "slice"], "left_semi")
        gone = changes.where("effect = 'deleted'").select(*KEY, F.lit(None).cast("string").alias("content"), F.col("previous_hash").alias("content_hash"))
        overwrite(_postings(touched(notes).unionByName(gone), notes_in, most), f"{out}/postings", "vault", "slice")
        overwrite(_notes(touched(changes), touched(known)), f"{out}/notes", "vault", "slice")
    log.info("wrote %d slices of %s and %s", n, f"{out}/postings", f"{out}/notes")
    return sums.asDict()


def _postings(notes: DataFrame, count: int, most: int) -> DataFrame:
    """Postings of whole slices; also of a note that is gone there is a row, without a term and a length.

    count, most: notes in all, and in a slice; a slice is dealt by path over as many files as it calls for.
    """
    part = F.pmod(F.xxhash64("path", F.lit("part")), F.lit(most // NOTES_A_FILE + 1)).cast("int")
    tasks = max(int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * count // NOTES_A_FILE)
    first = F.row_number().over(Window.partitionBy(*KEY, "part").orderBy("content_hash"))
    dealt = notes.withColumn("part", part).repartition(tasks, "vault", "slice", "part").withColumn("copy", first).where("copy = 1")
    state = F.when(F.col("content").isNull(), "deleted").otherwise("live").alias("state")
    rows = plain_rows(dealt.select(*KEY, state, "content_hash", "content"), [*KEY, "state", "content_hash"])
    return rows.sortWithinPartitions("vault", "slice", "term", "path")


def _notes(changes: DataFrame, known: DataFrame) -> DataFrame:
    """The list of whole slices: the notes of this run, those that it found gone, and those gone before."""
    now = changes.select(*KEY, F.coalesce("content_hash", "previous_hash").alias("content_hash"), F.when(F.col("effect") == "deleted", "deleted").otherwise("live").alias("state"))
    before = known.where("state = 'deleted'").join(now, KEY, "left_anti")
    return now.unionByName(before).repartition("vault", "slice")


def read(spark: SparkSession, out: str) -> DataFrame:
    """The whole index: a row for each term of a note, and one without a term for the note itself."""
    postings = read_if_there(spark, f"{out.rstrip('/')}/postings", POSTINGS)
    return postings.select("vault", "path", "state", "content_hash", "term", F.size("positions").alias("tf"), "dl")


def open_index(spark: SparkSession, out: str) -> Index:
    """The index as ranked search reads it."""
    postings = read_if_there(spark, f"{out.rstrip('/')}/postings", POSTINGS)
    return Index(postings.where("term is not null").select("vault", "term", "path", "positions"), postings.where("term is null and dl is not null").select("vault", "path", "dl"), False)


if __name__ == "__main__":
    main("search_index", run)
