"""Line deduplication over levelled sorted runs of line hashes.

Documents come in batches, those of the largest ids first. A batch's line hashes are
merged with the runs of the batches before it: a hash that no run holds is settled by this
batch (the anti-join), the others only add to the count. The batch's own hashes become a
sorted run, bucketed by hash, so that the next merge neither shuffles nor rereads lines;
``FANOUT`` runs of a level are compacted into one run of the next. At the end the runs
give each hash its number of documents and the document that keeps it.

Keys are told apart by 128 bits of hash. Everything runs on DataFrame functions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetscope.llm.common import KEY, lower_ascii, partitions, row_key, whole_row
from sheetscope.session import cut_lineage, shared_folder

#: A line counts from so many code points of its key on, and is repeated from so many documents on.
CHARS = 40
DOCUMENTS = 5
#: Batches the documents come in, and runs of a level that are compacted into one.
BATCHES = 6
FANOUT = 3
#: A hash with at least the ``HEAVY``-th part of all lines is joined by broadcast: there
#: can't be more than ``HEAVY`` of them, whatever the input. No other hash is hot.
HEAVY = 10_000

HASH = ("h0", "h1")
_RUN = "h0 bigint, h1 bigint, docs bigint, keep bigint"
_SPACES = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """A line with spaces stripped at both ends and A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(_SPACES)))


def long_lines(docs: DataFrame, chars: int = CHARS) -> DataFrame:
    """``KEY``, place and ``HASH`` of every line whose key has ``chars`` code points."""
    lines = docs.select(*row_key(F.col("doc_id"), F.col("text")), F.posexplode(_lines(F.col("text"))).alias("place", "line"))
    stripped = lines.withColumn("line", F.btrim("line", F.lit(_SPACES))).filter(F.char_length("line") >= chars)
    key = lower_ascii(F.col("line"))
    return stripped.select(*KEY, "place", F.xxhash64(key).alias("h0"), F.xxhash64(F.lit("line"), key).alias("h1"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


class LineRuns:
    """Sorted runs ``(h0, h1, docs, keep)`` of line hashes on levels.

    Runs are external tables in the shared folder, bucketed and sorted by hash. ``keep`` is
    the largest document of the first batch that held the hash, and null in later runs.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = [[]]
        self.buckets = partitions(spark)
        self.folder = shared_folder(spark)

    def runs(self) -> list[DataFrame]:
        """All runs, the most compacted first."""
        return [self.spark.table(name) for level in reversed(self.levels) for name in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Merge a batch of ``KEY`` and ``HASH`` rows in; the hashes that no earlier batch held.

        A document counts once for a hash, however often it holds the line.
        """
        once = lines.groupBy(*HASH, *KEY).agg(F.lit(1).alias("one"))
        met = once.groupBy(*HASH).agg(F.count("*").alias("docs"), F.max(KEY[0]).alias("keep"))
        runs = self.runs()
        for i, run in enumerate(runs):
            known = run.select(*HASH, F.lit(True).alias(f"_met{i}"))
            met = met.join(known.hint("merge"), list(HASH), "left")
        fresh = F.coalesce(*(F.col(f"_met{i}") for i in range(len(runs))), F.lit(False)) == F.lit(False)
        own = self._write(met.select(*HASH, "docs", F.when(fresh, F.col("keep")).alias("keep")))
        self.levels[0].append(own)
        self._compact()
        return self._files([own]).filter("keep is not null")

    def totals(self) -> DataFrame:
        """``(h0, h1, docs, keep)`` of every hash over all runs."""
        return self._merged([name for level in self.levels for name in level])

    def drop(self) -> None:
        """Forget the runs' tables; their files lie in the checkpoint folder."""
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels = [[]]

    def _compact(self) -> None:
        for at in range(len(self.levels)):
            full = self.levels[at]
            if len(full) < self.fanout:
                return
            if at + 1 == len(self.levels):
                self.levels.append([])
            self.levels[at + 1].append(self._write(self._merged(full)))
            self.levels[at] = []
            for name in full:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _merged(self, names: list[str]) -> DataFrame:
        # Their plain files: Spark 4.1 takes a union of bucketed scans for hashed as they are, which
        # it is not, and leaves equal hashes apart.
        return self._files(names).groupBy(*HASH).agg(F.sum("docs").alias("docs"), F.max("keep").alias("keep"))

    def _files(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(_RUN).parquet(*(f"{self.folder}/{name}" for name in names))

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = run.write.format("parquet").option("path", f"{self.folder}/{name}")
        writer.bucketBy(self.buckets, *HASH).sortBy(*HASH).saveAsTable(name)
        return name


def _batched(lines: DataFrame, batches: int) -> tuple[DataFrame, int]:
    """``lines`` written by batch, and the number of batches; the largest ids are batch 0."""
    shares = [i / batches for i in range(1, batches)]
    bounds = lines.agg(F.percentile_approx(KEY[0], shares, 1000).alias("b")).head().b if shares else None
    bounds = sorted(set(bounds or []))
    batch = sum((F.when(F.col(KEY[0]) < b, 1).otherwise(0) for b in bounds), F.lit(0))
    spark = lines.sparkSession
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    lines.withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    schema = lines.withColumn("batch", batch.cast("int")).schema
    return spark.read.schema(schema).parquet(path), len(bounds) + 1


def repeated_hashes(lines: DataFrame, count: int, documents: int = DOCUMENTS, fanout: int = FANOUT) -> DataFrame:
    """``(h0, h1, docs, keep)`` of hashes in at least ``documents`` documents.

    ``lines`` has a column ``batch`` with values below ``count``.
    """
    runs = LineRuns(lines.sparkSession, fanout)
    for i in range(count):
        runs.add(lines.filter(F.col("batch") == i))
    found = cut_lineage(runs.totals().filter(F.col("docs") >= documents))
    runs.drop()
    return found


def repeated_lines(
    docs: DataFrame, chars: int = CHARS, documents: int = DOCUMENTS, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """Each row of ``docs`` as ``row``, with ``n_lines``, ``n_dropped`` and the ``kept`` text.

    A key of at least ``chars`` code points in at least ``documents`` documents loses its
    lines in all but the document of the largest id that holds it.

    Rows that repeat both id and text are one document; rows of one id and other texts are
    several, and all rows of the largest id keep the line. A null id lies below all others.
    A null or empty text is one empty line. Other columns pass through, whatever their
    names. An empty table gives no rows.
    """
    lines, count = _batched(long_lines(docs.select("doc_id", "text"), chars), batches)
    repeated = repeated_hashes(lines, count, documents, fanout)
    n_lines = lines.count()
    heavy = F.col("docs") >= max(documents, n_lines / HEAVY)
    # At most HEAVY rows: a hash counts a document once, so its lines are no fewer than its documents.
    hot = F.broadcast(repeated.filter(heavy).select(*HASH, F.col("keep").alias("hot_keep")))
    rest = repeated.filter(~heavy).select(*HASH, "keep")
    hit = lines.select(*KEY, "place", *HASH).join(hot, list(HASH), "left")
    dropped = (
        hit.filter("hot_keep is not null")
        .select(*KEY, "place", F.col("hot_keep").alias("keep"))
        .unionByName(hit.filter("hot_keep is null").join(rest, list(HASH)).select(*KEY, "place", "keep"))
    )
    places = dropped.filter(F.col(KEY[0]) != F.col("keep")).select(*KEY, "place").distinct()
    places = cut_lineage(places.groupBy(*KEY).agg(F.sort_array(F.collect_list("place")).alias("places")))
    keyed = docs.select(whole_row(docs).alias("row"), *row_key(F.col("doc_id"), F.col("text")))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    own = keyed.join(places, list(KEY), "left").select("row", F.size(_lines(text)).alias("_n"), "places")
    kept = F.array_join(F.zip_with(_lines(text), _kept_mask(F.col("places"), F.col("_n")), lambda line, keep: F.when(keep, line)), "\n")
    return own.select(
        "row",
        F.col("_n").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("places").isNull(), text).otherwise(kept).alias("kept"),
    )


def _kept_mask(places: Column, n: Column) -> Column:
    """One boolean a line from the sorted places of dropped ones, in time linear in the lines."""
    before = F.concat(F.array(F.lit(-1)), places)

    def stretch(place: Column, last: Column) -> Column:
        own = F.concat(F.array_repeat(F.lit(True), place - last - 1), F.array(F.lit(False)))
        return F.when(place.isNull(), F.array_repeat(F.lit(True), n - 1 - last)).otherwise(own)

    return F.flatten(F.zip_with(places, before, stretch))


def drop_repeated_lines(docs: DataFrame, **limits: int) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; its columns stay."""
    cut = repeated_lines(docs, **limits)
    return cut.select(F.col("row").withField("text", F.col("kept")).alias("row")).select("row.*")


def lines_report(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_dropped`` and ``kept_sha256`` of every row."""
    cut = repeated_lines(docs.select("doc_id", "text"))
    return cut.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def lines_sql() -> str:
    """The same rows in SQL."""
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT r, doc_id, i, lines[i] AS line,
    translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM d, range(1, len(lines) + 1) AS t(i)
), k AS (
  SELECT key, max(doc_id) AS keep FROM l WHERE length(key) >= {CHARS} GROUP BY key HAVING count(DISTINCT r) >= {DOCUMENTS}
), j AS (
  SELECT r, l.doc_id, i, line, keep IS NOT NULL AND keep <> l.doc_id AS gone FROM l LEFT JOIN k USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY r, doc_id
"""
