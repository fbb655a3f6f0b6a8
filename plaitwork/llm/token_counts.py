"""Token counts as delta-maintained rollups by source, language and tokenizer version.

State lives in a shared folder:

    entries/batch=B/bucket=K   signed counts of single documents: +1 and +n for what a batch adds, -1 and -n for what it takes
    rollups/batch=B            the batch's entries summed by source, lang and tokenizer_version
    commits/B                  an empty file, made last: only batches that have one count

Totals are the sums of the committed rollups, so a batch costs what it changes. Entries are in ``BUCKETS`` buckets by hash of
the document id; a batch that deletes or revises reads the buckets of those ids alone. A batch that fails leaves no
commit; run again, it overwrites its own folders. A batch that is committed already changes nothing when applied again.

Changes are rows (change, doc_id, source, lang, tokenizer_version, n_tokens), with or without seq, a long:

    insert   adds the row's count
    revise   takes back all of the document's counts of that version so far, then adds the row's
    delete   takes back all of the document's counts so far, of one version or, where that is null, of all

"So far" holds inside a batch, too: its changes act in order of seq (null or no seq: 0); of equal seq, inserts come first,
then revisions, in order of source, lang and n_tokens, then deletions. A revision that stands twice counts once.

Null ids, sources and languages are values like any other. Repeated inserts each count. Deletes and
revisions of unknown documents take back nothing. Null texts have no tokens but are documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaitwork.llm import bpe
from plaitwork.llm._util import staged, words

KEYS = ("source", "lang", "tokenizer_version")
BUCKETS = 16
ENTRIES = "doc_id long, source string, lang string, tokenizer_version string, docs long, tokens long"
CHANGES = "change string, doc_id long, source string, lang string, tokenizer_version string, n_tokens long"


def count_bpe(docs: DataFrame, version: str, ranks_path: str, pattern: str) -> DataFrame:
    """Insert changes with the number of BPE ids of each whole text."""
    ids = bpe.encode(docs, ranks_path, pattern, carry=("source", "lang"))
    return ids.select(F.lit("insert").alias("change"), "doc_id", "source", "lang", F.lit(version).alias("tokenizer_version"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"))


def count_words(docs: DataFrame, version: str) -> DataFrame:
    """Insert changes with the number of words of each whole text."""
    return docs.select(F.lit("insert").alias("change"), "doc_id", "source", "lang", F.lit(version).alias("tokenizer_version"), F.size(words(F.col("text"))).cast("long").alias("n_tokens"))


class Totals:
    """The rollups in one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, kind: str, batch: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}/{batch}")

    def _fs(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        top = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        fs = self._fs(top)
        return sorted(s.getPath().getName() for s in fs.listStatus(top)) if fs.exists(top) else []

    def _read(self, kind: str, schema: str, columns: str) -> DataFrame:
        """The committed batches' rows, by one scan of the kind's folder."""
        spark, top, done = self.spark, f"{self.folder}/{kind}", self.committed()
        if not done:
            return spark.createDataFrame([], f"{schema}, {columns}")
        return spark.read.schema(f"{schema}, {columns}").parquet(top).where(F.col("batch").isin(done))

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commits a batch; False if it was there already."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch's name has letters, digits, - and _")
        mark = self._path("commits", batch)
        if self._fs(mark).exists(mark):
            return False
        seq = F.coalesce(F.col("seq").cast("long"), F.lit(0)) if "seq" in changes.columns else F.lit(0).cast("long")
        kind = F.when(F.col("change") == "insert", 0).when(F.col("change") == "revise", 1).otherwise(2)
        tokens = F.coalesce("n_tokens", F.lit(0)).cast("long")
        place = F.struct(seq.alias("seq"), kind.alias("kind"), *[F.when(kind == 1, F.col(c)).alias(c) for c in ("source", "lang")], F.when(kind == 1, tokens).alias("n"))
        known = changes.where(F.col("change").isin("insert", "revise", "delete")).select("change", F.col("doc_id").cast("long").alias("doc_id"), *KEYS, tokens.alias("tokens"), place.alias("place"))
        # The last taking back of each document and version (null: of all): a row for each, however many changes there are.
        version = F.when((F.col("change") == "revise") | F.col("tokenizer_version").isNotNull(), F.struct("tokenizer_version")).alias("version")
        taking = known.where("change <> 'insert'").groupBy(F.col("doc_id").alias("g_id"), version).agg(F.max("place").alias("last"))
        taking = staged(taking.groupBy("g_id").agg(F.collect_list(F.struct("version", "last")).alias("takes")), "token-takes")
        hit = lambda v: v["version"].isNull() | v["version"]["tokenizer_version"].eqNullSafe(F.col("tokenizer_version"))
        added = known.where("change = 'insert'").unionByName(known.where("change = 'revise'").distinct())
        own = added.join(taking, F.col("doc_id").eqNullSafe(F.col("g_id")), "left").where(~F.coalesce(F.exists("takes", lambda v: hit(v) & (v["last"] > F.col("place"))), F.lit(False)))
        entries = own.select("doc_id", *KEYS, F.lit(1).cast("long").alias("docs"), "tokens")
        bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")
        touched = [r["b"] for r in taking.select(bucket("g_id").alias("b")).distinct().collect()]  # at most BUCKETS
        if touched:
            ledger = self._read("entries", ENTRIES, "batch string, bucket int").where(F.col("bucket").isin(touched))
            held = ledger.groupBy("doc_id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")
            taken = held.join(taking, F.col("doc_id").eqNullSafe(F.col("g_id"))).where(F.exists("takes", hit))
            entries = entries.unionByName(taken.select("doc_id", *KEYS, *[(-F.col(c)).alias(c) for c in ("docs", "tokens")]))
        path = f"{self.folder}/entries/batch={batch}"
        # A bucket is written by a few tasks, so that one id in many rows is no hot task.
        dealt = entries.withColumn("bucket", bucket("doc_id")).repartition("bucket", F.pmod(F.xxhash64(*KEYS, "docs", "tokens"), F.lit(8)))
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)
        written = self.spark.read.schema(f"{ENTRIES}, bucket int").parquet(path)
        sums = written.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{self.folder}/rollups/batch={batch}")
        self._fs(mark).create(mark, False).close()
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer_version, n_docs, n_tokens) of all committed batches."""
        rollups = self._read("rollups", "source string, lang string, tokenizer_version string, docs long, tokens long", "batch string")
        sums = rollups.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")


def copies(docs: DataFrame, version: str | None = None) -> DataFrame:
    """Delete changes for all documents whose text has a smaller id."""
    hashed = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("md5"))
    # A written table: the other side of a text in many rows is then split.
    first = staged(hashed.groupBy("md5").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first-copies")
    gone = hashed.join(first, "md5").where("doc_id <> first")
    none = F.lit(None).cast("string")
    return gone.select(F.lit("delete").alias("change"), "doc_id", none.alias("source"), none.alias("lang"), F.lit(version).cast("string").alias("tokenizer_version"), F.lit(None).cast("long").alias("n_tokens"))
