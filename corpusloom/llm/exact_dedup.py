"""Exact deduplication as a stream over keyed state.

Arriving documents are appended to a content store. A streaming aggregation keeps, in
RocksDB and without expiry, one state row per digest of a normalised text: which
document stays, where its content lies in the store (arrival and row), and how many were
seen. Each micro-batch writes the state rows that it changed and, where a digest was hit
more than once, compares the full bytes of every hit with those of the document that
stays; texts that differ although their digests agree are told apart by their bytes.

Documents may arrive in any number of calls on one folder. A call that failed is
repeated under its number: what it stored is kept or replaced, never counted twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpusloom.llm.shared import freed, shared_folder

SPACE = r"[\x20\x09-\x0D]+"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = {
    PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
BATCH_BYTES = 64 << 30  # of the store, read in one micro-batch


def normalised(text: Column) -> Column:
    """The text without space, tab, line feed, vertical tab, form feed and return."""
    return F.regexp_replace(text, SPACE, "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_duplicates(docs: DataFrame, digest=sha256, folder: str | None = None, arrival: int = 0) -> DataFrame:
    """One row per row of `docs` and of earlier arrivals in `folder`: doc_id, keep_id,
    group_size, kept, digest, place.

    Texts are equal if they are without white space; null counts as empty. Of equal
    texts the row with the most code points, then the smallest doc_id, stays; a null
    doc_id comes last. Of rows that also repeat the doc_id one is marked as kept. Other
    columns are ignored. `digest` maps normalised text to bytes, the same for all
    arrivals; if it is weak, groups are still exact. `arrival` numbers the calls on a
    folder; a number that was stored before adds nothing."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    store = content_store(docs, digest, f"{folder}/store", arrival)
    return _split(spark, store, decisions(spark, store, folder), folder)


def content_store(docs: DataFrame, digest, path: str, arrival: int = 0) -> str:
    """Store an arrival: content and what the state needs of it. The arrival and `row`
    are the locator; once written they never change."""
    spark = docs.sparkSession
    part = f"{path}/arrival={arrival}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{part}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        text = F.coalesce("text", F.lit(""))
        rows = docs.select("doc_id", text.alias("text"), digest(normalised(text)).alias("digest"), F.length(text).cast("long").alias("chars"))
        rows.withColumn("row", F.monotonically_increasing_id()).write.mode("overwrite").parquet(part)
    return path


def contents(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(store).withColumn("place", F.struct("arrival", "row")).drop("arrival", "row")


def _first() -> Column:
    """Smallest for the row that stays."""
    return F.struct((-F.col("chars")).alias("order"), F.col("doc_id").isNull().alias("none"), "doc_id", "place")


def decisions(spark: SparkSession, store: str, folder: str) -> DataFrame:
    """digest, keep_id, keep_place, group_size of all documents in the store. The
    stream takes what is new since it ran last in this folder."""
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    try:
        for k, v in ROCKSDB.items():
            spark.conf.set(k, v)
        schema = spark.read.parquet(store).drop("text").schema
        # a file of any age is new until it was read
        arriving = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(BATCH_BYTES)).option("maxFileAge", "36500d").parquet(store)
        arriving = arriving.withColumn("place", F.struct("arrival", "row"))
        state = arriving.groupBy("digest").agg(F.min(_first()).alias("first"), F.count(F.lit(1)).alias("group_size"))

        def changed(batch: DataFrame, number: int) -> None:
            # a batch that runs again replaces what it wrote
            rows = batch.select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.place").alias("keep_place"), "group_size")
            path = f"{folder}/changed/batch={number}"
            rows.write.mode("overwrite").parquet(path)
            # in the caller's session, which may plan adaptively
            several = spark.read.schema(rows.schema).parquet(path).filter("group_size > 1")
            freed(spark)
            hits = _hits(contents(spark, store), several)
            path = f"{folder}/hits/batch={number}"
            hits.write.mode("overwrite").parquet(path)
            _differing(spark.read.schema(hits.schema).parquet(path)).write.mode("overwrite").parquet(f"{folder}/differ/batch={number}")

        state.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/progress").foreachBatch(changed).trigger(
            availableNow=True
        ).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kind = schema["doc_id"].dataType.simpleString()
    columns = f"digest binary, keep_id {kind}, keep_place struct<arrival: int, row: bigint>, group_size bigint"
    latest = F.max_by(F.struct("keep_id", "keep_place", "group_size"), "batch")
    return _batches(spark, f"{folder}/changed", columns).groupBy("digest").agg(latest.alias("d")).select("digest", "d.*")


def _batches(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """What the micro-batches wrote, also if there were none."""
    schema = f"{columns}, batch bigint"
    spark.createDataFrame([], schema).write.partitionBy("batch").mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _hits(store: DataFrame, several: DataFrame) -> DataFrame:
    """The normalised bytes of all documents under the given digests."""
    return store.join(several, "digest").select("digest", (F.col("place") == F.col("keep_place")).alias("stays"), normalised(F.col("text")).alias("bytes"))


def _differing(hits: DataFrame) -> DataFrame:
    """Digests under which a text is not that of the document that stays."""
    stays = hits.filter("stays").select("digest", F.col("bytes").alias("first_bytes"))
    return hits.join(stays, "digest").filter("bytes != first_bytes").select("digest").distinct()


def _split(spark: SparkSession, store: str, decided: DataFrame, folder: str) -> DataFrame:
    """The decision for each row; digests of several texts are split by bytes."""
    out = ["doc_id", "keep_id", "keep_place", "group_size", "digest", "place"]
    rows = contents(spark, store).select("doc_id", "digest", "place").join(decided, "digest").select(*out)
    differ = _batches(spark, f"{folder}/differ", "digest binary").select("digest").distinct()
    if not differ.isEmpty():
        split = contents(spark, store).join(differ, "digest", "left_semi").withColumn("bytes", normalised(F.col("text")))
        groups = split.groupBy("digest", "bytes").agg(F.min(_first()).alias("first"), F.count(F.lit(1)).alias("group_size"))
        split = split.join(groups, ["digest", "bytes"]).select(
            "doc_id", F.col("first.doc_id").alias("keep_id"), F.col("first.place").alias("keep_place"), "group_size", "digest", "place"
        )
        rows = rows.join(differ, "digest", "left_anti").unionByName(split)
    return rows.withColumn("kept", F.col("place") == F.col("keep_place")).drop("keep_place")


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one of each group."""
    kept = exact_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    # a row's columns stay inside a struct, so their names clash with none here
    own = docs.select(F.struct(*docs.columns).alias("row"), sha256(normalised(F.coalesce("text", F.lit("")))).alias("own"))
    joined = own.join(kept, (F.col("own") == F.col("_digest")) & F.col("row.doc_id").eqNullSafe(F.col("_id")))
    # rows that repeat a doc_id and a normalised text
    longest = Window.partitionBy("own", "row.doc_id").orderBy(F.length("row.text").desc())
    return joined.withColumn("n", F.row_number().over(longest)).filter("n = 1").select("row.*")
