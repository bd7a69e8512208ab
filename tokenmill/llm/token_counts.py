"""Token counts as delta-maintained rollups.

A batch of changes names documents to insert, delete or revise, with their counts for each tokenizer version. It is committed as two
folders of the store: a ledger of signed rows (an insert adds, a delete takes back what the ledger holds, a revision takes that back and
adds the new count, also under a new source or language) and their sums by source, language and version. Totals are the sums of all committed
batches; no batch reads a text again that it does not change. The ledger lies in buckets by a hash of the id, and a batch reads those of its own
ids. A commit is idempotent: a batch whose commit mark is there is left alone, one that broke off before its mark is written anew in
a folder of its own, and readers look at marked folders only. A mark is one file that appears under its name by a rename, whole or not at all; whatever a
broken commit leaves beside it is passed over.

Defined results: null texts count zero tokens; a null source or language is a group of its own; a change without an id is left out;
inserting a present id revises it; deleting or revising an absent one does nothing or inserts; of several rows for one id in a batch
the one with the most tokens, then the last in order, counts, and a delete beats them. An empty batch is committed and changes nothing.
A change may stand for several equal rows (`copies`, 1 without that column). The query counts every row: its ids are hashes of whole rows,
so rows without an id and rows that share one are kept apart, and equal ones are copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.llm.common import folder

INSERT, DELETE, REVISE = "insert", "delete", "revise"
TOKENIZERS = {"words-1": r"[^\x20\x09-\x0D]+", "pieces-2": r"[A-Za-z\x{80}-\x{10FFFF}]+|[0-9]|[^A-Za-z0-9\x{80}-\x{10FFFF}\x20\x09-\x0D]"}
LEDGER = "doc_id long, source string, lang string, tokenizer string, documents long, tokens long"
BUCKETS = 64  # of the ledger


def changes(df: DataFrame, action: str, tokenizers: dict[str, str], text: Column | None = None) -> DataFrame:
    """Rows of a batch: doc_id, action, source, lang and the counts of each tokenizer version."""
    text = F.coalesce(F.col("text") if text is None else text, F.lit(""))
    counts = F.array(*[F.regexp_count(text, F.lit(p)).cast("bigint") for p in tokenizers.values()])
    return df.select("doc_id", F.lit(action).alias("action"), "source", "lang", counts.alias("counts"))


class Rollup:
    """A store under a shared folder: `ledger` and `sums`, a folder in each for every batch."""

    def __init__(self, spark: SparkSession, path: str, tokenizers: dict[str, str] | None = None):
        self.spark, self.path, self.tokenizers = spark, path, dict(tokenizers or TOKENIZERS)

    def _files(self):
        """Hadoop's path class and the store's file system."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path, path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _committed(self) -> dict[str, str]:
        """Attempt by batch: marks are files named batch-attempt."""
        path, files = self._files()
        if not files.exists(path(f"{self.path}/commits")):
            return {}
        names = [s.getPath().getName() for s in files.listStatus(path(f"{self.path}/commits")) if s.isFile()]
        return dict(tuple(name.rsplit("@", 1)) for name in sorted(names, reverse=True) if "@" in name and not name.startswith("."))

    def _mark(self, batch: str, attempt: str) -> None:
        path, files = self._files()
        files.mkdirs(path(f"{self.path}/commits"))
        draft, mark = path(f"{self.path}/commits/.{batch}@{attempt}"), path(f"{self.path}/commits/{batch}@{attempt}")
        files.create(draft, True).close()
        if not files.rename(draft, mark):
            raise RuntimeError(f"the mark of batch {batch} could not be written")

    def _place(self, part: str, batch: str, attempt: str) -> str:
        return f"{self.path}/{part}/part={batch}-{attempt}"

    def _read(self, part: str, schema: str) -> DataFrame:
        paths = [self._place(part, batch, attempt) for batch, attempt in sorted(self._committed().items())]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{part}").parquet(*paths).drop("part")

    def ledger(self) -> DataFrame:
        return self._read("ledger", f"{LEDGER}, bucket int")

    def totals(self) -> DataFrame:
        """Documents and tokens by source, language and tokenizer version; groups that hold nothing any more are gone."""
        sums = self._read("sums", LEDGER.removeprefix("doc_id long, ")).groupBy("source", "lang", "tokenizer")
        return sums.agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 or tokens <> 0")

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Applies a batch unless it has been; tells whether it did."""
        if batch in self._committed():
            return False
        attempt = folder(self.spark, "attempt").rpartition("-")[2]
        # one change for each document: the struct that is largest, a delete over all others
        copies = F.col("copies") if "copies" in rows.columns else F.lit(1).cast("bigint").alias("copies")
        order = F.struct((F.col("action") == DELETE).alias("gone"), "counts", F.col("source"), F.col("lang"), copies)
        last = rows.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(order).alias("x")).select("doc_id", "x.*")
        versions = F.array(*[F.lit(v) for v in self.tokenizers])
        last = last.withColumn("t", F.explode(F.arrays_zip(versions.alias("tokenizer"), F.col("counts").alias("tokens"))))
        last = last.select("doc_id", "gone", "source", "lang", "copies", F.col("t.tokenizer").alias("tokenizer"), (F.col("t.tokens") * F.col("copies")).alias("tokens"))
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")
        own = [r["bucket"] for r in last.select(bucket.alias("bucket")).distinct().collect()]  # BUCKETS rows at most
        held = self.ledger().where(F.col("bucket").isin(own)).join(last.select("doc_id", "tokenizer"), ["doc_id", "tokenizer"], "left_semi")
        held = held.groupBy("doc_id", "source", "lang", "tokenizer").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 or tokens <> 0")
        back = held.select("doc_id", "source", "lang", "tokenizer", (-F.col("documents")).alias("documents"), (-F.col("tokens")).alias("tokens"))
        new = last.where("not gone").select("doc_id", "source", "lang", "tokenizer", F.col("copies").alias("documents"), "tokens")
        signed = back.unionByName(new).withColumn("bucket", bucket)
        signed.repartition("bucket").write.partitionBy("bucket").parquet(self._place("ledger", batch, attempt))
        written = self.spark.read.schema(LEDGER).parquet(self._place("ledger", batch, attempt))
        sums = written.groupBy("source", "lang", "tokenizer").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        sums.write.parquet(self._place("sums", batch, attempt))
        self._mark(batch, attempt)  # comes last
        return True


def op3(spark, sf_dir: str) -> DataFrame:
    """Inserts all documents, deletes those of fewer than 20 characters, revises those with numbers, which are masked; one batch comes twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    docs = docs.withColumn("doc_id", F.xxhash64(*[x for c in docs.columns for x in (F.col(c).isNull(), F.col(c))]))
    rollup = Rollup(spark, folder(spark, "token-counts"))
    size = F.coalesce(F.length("text"), F.lit(0))

    def with_copies(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))

    rollup.commit("1-insert", with_copies(changes(docs, INSERT, rollup.tokenizers)))
    for _ in range(2):
        rollup.commit("2-delete", with_copies(changes(docs.where(size < 20), DELETE, rollup.tokenizers)))
    rollup.commit("3-revise", with_copies(changes(docs.where((size >= 20) & F.col("text").rlike("[0-9]")), REVISE, rollup.tokenizers, F.regexp_replace("text", "[0-9]+", " "))))
    return rollup.totals().select("source", "lang", "tokenizer", "documents", "tokens")


_SQL_PATTERNS = {"words-1": r"[^\x20\x09-\x0D]+", "pieces-2": r"[A-Za-z\x{80}-\x{10FFFF}]+|[0-9]|[^A-Za-z0-9\x{80}-\x{10FFFF}\x20\x09-\x0D]"}
OP3_SQL = f"""
WITH d AS (SELECT source, lang, regexp_replace(text, '[0-9]+', ' ', 'g') AS t FROM documents WHERE length(text) >= 20),
c AS ({" UNION ALL ".join(f"SELECT source, lang, '{v}' AS tokenizer, len(regexp_extract_all(t, '{p}')) AS n FROM d" for v, p in _SQL_PATTERNS.items())})
SELECT source, lang, tokenizer, count(*) AS documents, CAST(sum(n) AS BIGINT) AS tokens FROM c GROUP BY ALL
"""
