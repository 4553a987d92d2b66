"""Operator 9: line dedup with levelled, sorted runs of line hashes.

A run is a written table of (line hash, smallest doc_id), bucketed and sorted by hash,
so that two runs meet bucket by bucket in a merge, without a shuffle and without a
sort.  Documents come in batches of ascending doc_id, each twice as large as the one
before.  A batch's own hashes are written as a sorted run; a merge anti join with every
run that is there keeps the new ones, and these are added as a run of level 0.  When a
level is full, its runs are merged into one of the next level.  As batches ascend, the
doc_id in the runs is the smallest that holds the line.

Lines that hold a noticeable share of all lines would meet in one task when all lines
look up their owner.  There are few of them by counting (see ``hot_keys``), so their
owners are broadcast, and only the other lines are shuffled.

Only DataFrame functions are used.  Line hashes are 128 bits.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recoflow.llm.common import hot_keys, shared_dir, table, whole_row, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters 0x20 and 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"
HASH = ["h1", "h2"]
#: Documents of the first batch.
BATCH_DOCS = 16_384


def line_key(line: Column) -> Column:
    """The line without blanks at its ends and with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


@contextmanager
def sorted_scans(spark: SparkSession):
    """Let scans of bucketed tables tell that a bucket of one file is sorted."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """The levelled runs; ``add`` takes a batch of (h1, h2, doc), later than all before.

    Runs are external bucketed tables in ``folder``, one bucket for each shuffle
    partition; ``close`` takes their names out of the catalogue and leaves the files.
    """

    def __init__(self, spark: SparkSession, folder: str, fanout: int = 4):
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.names: list[str] = []
        #: key, n of the hashes that are frequent in some batch.
        self.frequent: list[DataFrame] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _write(self, run: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        self.names.append(name)
        run.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{self.folder}/{name}").saveAsTable(name)
        return self.spark.read.table(name)

    def add(self, lines: DataFrame) -> None:
        batch = self._write(lines.groupBy(*HASH).agg(F.min("doc").alias("owner"), F.count("*").alias("n")))
        total = batch.agg(F.sum("n")).first()[0] or 0
        self.frequent.append(hot_keys(batch, "n", total).select(*HASH))
        run = batch.select(*HASH, "owner")
        for old in self.runs():
            run = run.join(old.select(*HASH).hint("merge"), HASH, "left_anti")
        run, level = self._write(run) if self.runs() else run, 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            run, self.levels[level] = self._write(self._merged(self.levels[level])), []
            level += 1

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """One run of several that share no hash."""
        both = lambda a, b: a.hint("merge").join(b.withColumnRenamed("owner", "other").hint("merge"), HASH, "full").select(*HASH, F.coalesce("owner", "other").alias("owner"))
        return reduce(both, runs)

    def owners_of(self, lines: DataFrame) -> DataFrame:
        """The lines with their ``owner``, the smallest doc that holds them.  Hashes that
        are hot in all lines are so in some batch, so ``frequent`` has them: less than
        HOT_KEYS for each batch, and batches grow with the logarithm of the documents."""
        frequent = reduce(DataFrame.union, self.frequent).distinct()
        runs = [run.withColumnRenamed("owner", f"owner_{k}") for k, run in enumerate(self.runs())]
        owner = F.coalesce(*[F.col(f"owner_{k}") for k in range(len(runs))]).alias("owner")

        def looked_up(some: DataFrame, how: str) -> DataFrame:
            for run in runs:
                some = some.join(run.hint(how), HASH, "left")
            return some

        hot = written(looked_up(frequent, "merge").select(*HASH, owner))
        few = lines.join(F.broadcast(hot), HASH)
        many = looked_up(lines.join(F.broadcast(hot.select(*HASH)), HASH, "left_anti"), "merge").select(*lines.columns, owner)
        return few.select(*lines.columns, "owner").unionByName(many)

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _edges(docs: DataFrame, doc: Column, batches: int | None) -> list[int]:
    """Last doc of each batch but the last one: ``batches`` of equal size, or the first of
    BATCH_DOCS documents and each next one twice as large."""
    if batches is None:
        n, ends = docs.count(), []
        while (end := BATCH_DOCS * (2 ** (len(ends) + 1) - 1)) < n:
            ends.append(end / n)
    else:
        ends = [k / batches for k in range(1, batches)]
    return sorted(set(docs.select(F.percentile_approx(doc, ends, 10_000)).first()[0] or [])) if ends else []


def deduplicated(docs: DataFrame, min_chars: int = 10, batches: int | None = None, fanout: int = 4) -> DataFrame:
    """row (a struct of all columns of ``docs``, with ``text`` rewritten), n_lines,
    n_dropped (long) of every row: see ``drop_lines``."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    doc, text = F.coalesce("doc_id", F.lit(2**63 - 1)), F.coalesce("text", F.lit(""))
    edges = F.array(*[F.lit(e) for e in _edges(docs, doc, batches)]).cast("array<bigint>")
    # a row is known by its doc_id and the hash of its text
    lines = docs.select(doc.alias("doc"), F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    lines = lines.select("doc", "row", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    lines = lines.select("doc", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), F.size(F.filter(edges, lambda e: e < F.col("doc"))).alias("batch"))
    lines.write.partitionBy("batch").parquet(f"{folder}/lines")
    lines = spark.read.schema(lines.schema).parquet(f"{folder}/lines")

    runs = LineRuns(spark, folder, fanout)
    with sorted_scans(spark):
        for (batch,) in sorted(lines.select("batch").distinct().collect()):
            runs.add(lines.where(F.col("batch") == batch))
        if runs.runs():
            lost = runs.owners_of(lines.select("doc", "row", "pos", *HASH)).where(F.col("owner") < F.col("doc"))
        else:
            lost = lines.select("doc", "row", "pos")
        lost = written(lost.groupBy("doc", "row").agg(F.collect_set("pos").alias("lost")))
    runs.close()
    joined = docs.select(whole_row(docs, "whole"), doc.alias("doc"), F.xxhash64(text).alias("row"))
    joined = joined.join(lost, ["doc", "row"], "left").withColumn("lines", F.split(F.coalesce("whole.text", F.lit("")), "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "lost")
    kept = F.array_join(F.when(F.col("lost").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.get("lines", i))), "\n")
    row = F.struct(*[kept.alias("text") if c == "text" else F.col(f"whole.`{c}`") for c in docs.columns])
    dropped = F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost"))
    return joined.select(row.alias("row"), F.size("lines").cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))


def drop_lines(docs: DataFrame, min_chars: int = 10, batches: int | None = None, fanout: int = 4) -> DataFrame:
    """Documents without the lines that an earlier document (smaller doc_id) has.

    Lines whose key has at least ``min_chars`` code points and stands in two documents
    or more stay only in the document of the smallest doc_id, there as often as they
    occur.  All columns of ``docs`` stay, with ``text`` rewritten (null: empty), and
    n_lines and n_dropped follow (a column of such a name is replaced;
    ``without_repeated_lines`` adds none).  A null doc_id counts as larger than all
    others and as one document; rows that repeat a doc_id are parts of one document and
    lose no line to each other.  An empty table gives no rows.  A text is split in one
    task, so memory grows with the longest text only.
    """
    out = deduplicated(docs, min_chars, batches, fanout)
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")


def without_repeated_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``drop_lines`` with the columns of ``docs`` and no others."""
    return deduplicated(docs, min_chars).select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), owners AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key
), marked AS (
  SELECT k.doc_id, k.pos, k.line, o.owner IS NOT NULL AND o.owner < k.doc_id AS gone
  FROM keyed k LEFT JOIN owners o ON k.key = o.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
