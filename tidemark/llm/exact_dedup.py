"""Exact deduplication as a stateful stream, with JVM operators only.

Documents are reduced to (digest, id, locator) rows and streamed through a keyed aggregation whose
state lives in RocksDB on disk and never expires: for every digest it holds the smallest id, its locator
(the file that holds the content) and the number of copies. Copies are combined before the shuffle, so a
digest that a third of all rows share is no hot key. After the last micro-batch the state itself is read
back as a table. With a ``state_path`` the state outlives the call: a later call streams its documents
into it and finds copies of all documents that came before.

Hits are checked on full bytes. Texts are fetched for hits only: a bitmap of fixed size over the ids of
hits tells others apart while texts are read (a text it takes wrongly meets no other), and those of
earlier calls are fetched from the files their locators name. Digest groups are salted, neighbours within
a salt are compared, and one row of each salt is compared again across salts. A digest whose texts differ
is resolved by its texts.

Defined cases: null text counts as empty, and equals every other empty text; of repeated rows with
one id and equal texts all report that id as keep_id; ids that are null sort last; an empty table gives an
empty result; other columns of the input are ignored. Rows that come from no file have no locator: they
are compared on bytes within their call, and by digest with other calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import SEP, fresh, shared_dir, staged, table_path, text_or_empty, without_ids
from .components import join_hot

SALTS = 64
#: Bits of the bitmap of hits: 16 MB in pieces of 32768 bits, whatever the size of the input.
BITS, PIECE = 1 << 27, 1 << 15
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SEP, " ")


def dedup_stream(rows: DataFrame) -> DataFrame:
    """Streaming (or batch) rows (digest, id, locator) to keyed state (digest, first, copies)."""
    return rows.groupBy("digest").agg(F.min(F.struct("id_null", "id", "locator")).alias("first"), F.count(F.lit(1)).alias("copies"))


def _run_stream(spark, schema, folder: str, at: str, files_per_trigger: int | None) -> DataFrame:
    """Stream what is new in the folder through the keyed state and return the state as a table."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # many small stores: no preallocated files
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "128")
    session.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")  # stores leave memory once written
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    reader = session.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    query = (
        dedup_stream(reader.parquet(folder)).writeStream.outputMode("update").format("noop")
        .option("checkpointLocation", at).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    state = session.read.format("statestore").load(at)
    value = {f.name: F.col(f"value.`{f.name}`") for f in state.schema["value"].dataType.fields}
    first, copies = list(value.values())[:2]
    path = table_path(spark, "dedup-keys")
    state.select(F.col("key.digest").alias("digest"), first.alias("first"), copies.alias("copies")).write.parquet(path)
    return spark.read.parquet(path)


def _bit(col: str) -> tuple[Column, Column]:
    """Piece of the bitmap and place in it of a value; null has a place too."""
    n = F.pmod(F.xxhash64(col), F.lit(BITS))
    return F.floor(n / PIECE).cast("int"), (n % PIECE).cast("int")


def only_hits(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (id, body) whose id may be among ``ids`` (column id): all that are, and few others."""
    piece, place = _bit("id")
    pieces = ids.select(piece.alias("piece"), place.cast("long").alias("place")).groupBy("piece").agg(F.bitmap_construct_agg("place").alias("bits"))
    pieces = staged(pieces, "dedup-bits")  # at most BITS / PIECE rows
    marked = texts.join(F.broadcast(pieces), piece == F.col("piece"))
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return marked.where(F.getbit(byte, place % 8) == 1).select(*texts.columns)


def _broken(suspects: DataFrame) -> DataFrame:
    """Digests whose texts differ, of (digest, id, body)."""
    salted = suspects.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    lag = F.lag("body").over(W.partitionBy("digest", "salt").orderBy("id"))
    chain = salted.select("digest", "salt", "body", lag.alias("previous"))
    odd = F.col("previous").isNotNull() & (F.col("previous") != F.col("body"))
    # within a salt: a differing neighbour, or the salt's first text, which goes on to the check across salts
    kept = staged(chain.where(odd | F.col("previous").isNull()).select("digest", "salt", odd.alias("odd"), "body"), "dedup-check")
    heads = kept.where("not odd").select("digest", "body", F.lag("body").over(W.partitionBy("digest").orderBy("salt")).alias("previous"))
    return staged(kept.where("odd").select("digest").union(heads.where(F.col("previous") != F.col("body")).select("digest")).distinct(), "dedup-broken")


def _earlier(members: DataFrame, text, id_col: str, every: bool) -> DataFrame:
    """digest, id, body of documents of earlier calls, one a digest or ``every`` one, from the files their locators name."""
    spark = members.sparkSession
    if not every:
        members = members.groupBy("digest").agg(F.min(F.struct("id", "locator")).alias("m")).select("digest", "m.id", "m.locator")
    members = staged(members, "dedup-earlier")
    files = [r.locator for r in members.where("locator <> ''").select("locator").distinct().collect()]  # names of input files, as Spark lists them
    if not files:
        return members.select("digest", "id", F.lit("").alias("body")).limit(0)
    found = spark.read.parquet(*files)
    found = found.select(F.col(id_col).alias("id"), F.input_file_name().alias("locator"), text(found).alias("body"))
    return found.join(members, (found["id"].eqNullSafe(members["id"])) & (found["locator"] == members["locator"])).select(members["digest"], found["id"], "body")


def verdicts(docs: DataFrame, normalise, digest, files_per_trigger: int | None, id_col: str, text_col: str, state_path: str | None) -> DataFrame:
    """As ``exact_duplicates``, with ``content``: SHA-256 of the text where a digest alone doesn't tell it, else null."""
    spark = docs.sparkSession
    shared_dir(spark)
    text = lambda d: normalise(text_or_empty(text_col))
    texts = docs.select(F.col(id_col).alias("id"), text(docs).alias("body"))
    keyed = lambda t: t.withColumn("digest", digest(F.col("body")))
    rows = keyed(texts).select("digest", F.col("id").isNull().alias("id_null"), "id", F.input_file_name().alias("locator"))
    if state_path is None:
        state_path = table_path(spark, "dedup-state")
    folder = f"{state_path}/rows"
    before = spark.read.schema(rows.schema).parquet(folder).inputFiles() if _exists(spark, folder) else []
    rows.write.mode("append").parquet(folder, compression="zstd")
    everything = spark.read.schema(rows.schema).parquet(folder)
    new = [f for f in everything.inputFiles() if f not in set(before)]
    mine = spark.read.schema(rows.schema).parquet(*new) if before and new else everything if new else rows.limit(0)
    keys = _run_stream(spark, rows.schema, folder, f"{state_path}/checkpoint", files_per_trigger) if new else dedup_stream(rows.limit(0))

    found = join_hot(mine.select("digest", "id"), keys, "digest", "copies", mine.count())
    out = staged(found.select(F.col("id").alias("doc_id"), F.col("first.id").alias("keep_id"), F.col("copies").alias("group_size"), "digest", F.col("first.locator").alias("locator")), "dedup-found")
    suspects = keyed(only_hits(texts, out.where("group_size > 1").select(F.col("doc_id").alias("id")))).select("digest", "id", "body")
    old = None
    if before:
        hits = out.where("group_size > 1").select("digest").distinct()
        old = spark.read.schema(rows.schema).parquet(*before).join(hits, "digest", "left_semi").select("digest", "id", "locator")
        suspects = suspects.unionByName(_earlier(old, text, id_col, False))
    broken = _broken(suspects)
    same = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    if broken.isEmpty():
        return out.select("doc_id", "keep_id", "group_size", same, "digest", "locator", F.lit(None).cast("string").alias("content"))
    # unequal texts under one digest: such digests are resolved by digest and text
    ours = keyed(texts).join(broken, "digest", "left_semi").select("digest", "id", "body")
    members = ours if old is None else ours.unionByName(_earlier(old.join(broken, "digest", "left_semi"), text, id_col, True))
    firsts = members.groupBy("digest", "body").agg(F.min(F.struct(F.col("id").isNull().alias("id_null"), "id")).alias("first"), F.count(F.lit(1)).alias("group_size"))
    again = ours.join(firsts, ["digest", "body"]).select(F.col("id").alias("doc_id"), F.col("first.id").alias("keep_id"), "group_size", "digest", F.lit(None).cast("string").alias("locator"), F.sha2("body", 256).alias("content"))
    out = out.join(broken, "digest", "left_anti").withColumn("content", F.lit(None).cast("string")).unionByName(again)
    return out.select("doc_id", "keep_id", "group_size", same, "digest", "locator", "content")


def _exists(spark, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def exact_duplicates(
    docs: DataFrame,
    normalise=normalised,
    digest=sha256,
    files_per_trigger: int | None = 1000,
    id_col: str = "doc_id",
    text_col: str = "text",
    state_path: str | None = None,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest, locator: one row a document.

    ``locator`` tells where the kept document's content lies (input file). ``digest`` may be replaced,
    for instance by a short one in tests: the byte check makes the result exact all the same. ``state_path``
    is a folder on shared storage for state that outlives the call: groups then reach over all calls.
    """
    return verdicts(docs, normalise, digest, files_per_trigger, id_col, text_col, state_path).drop("content")


def deduplicated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=normalised, digest=sha256, files_per_trigger: int | None = 1000, state_path: str | None = None
) -> DataFrame:
    """Rows of ``docs`` that stay, all columns: of rows with equal texts one with the smallest id, also if ids repeat or are null."""
    found = staged(verdicts(docs, normalise, digest, files_per_trigger, id_col, text_col, state_path), "dedup-verdict")
    repeated = found.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if repeated.isEmpty():
        return without_ids(docs, found.where("not kept").select(F.col("doc_id").alias("gone")), id_col)
    # an id doesn't tell a row: decide by id and text
    mark, content = fresh(docs, "dedup_digest"), fresh(docs, "dedup_content")
    body = normalise(text_or_empty(text_col))
    marked = docs.withColumn(mark, digest(body)).withColumn(content, F.sha2(body, 256))
    stays = found.where("kept").select(F.col("doc_id").alias("stay_id"), F.col("digest").alias("stay_digest"), F.col("content").alias("stay_content")).distinct()
    same = marked[id_col].eqNullSafe(stays["stay_id"]) & (marked[mark] == stays["stay_digest"]) & (stays["stay_content"].isNull() | (stays["stay_content"] == marked[content]))
    return marked.join(stays, same, "left_semi").dropDuplicates([id_col, content]).select(*[f"`{c}`" for c in docs.columns])
