"""Exact dedup by a stateful stream.

Arrivals are written to a store of contents and streamed through a keyed state on disk (RocksDB, checkpointed to
the shared folder) that never expires: for each digest the stable identifier that stays, the locator of its
content, and how many rows have come. Rows are combined before they reach the state, so a large group of copies
is no hot key. Where a digest has come before, the content at the state's locator is fetched and compared byte for
byte with what came; texts that only share a digest are put into groups of their own.

A locator is the number of the ingest, which names a folder of the store, and a number whose high bits name the
file in it and whose low 33 bits the row. State and store live in one folder, which can be opened again later.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._common import new_path, staged

#: Bytes in a row group of the store, which a writer holds in memory.
BLOCK_BYTES = 16 << 20
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # else every partition's store takes megabytes of disk before it holds a row
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # a partition's store is closed when its task ends, so that an executor holds as many as it has tasks
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def fold(arrivals: DataFrame) -> DataFrame:
    """Keyed state of arrivals(digest, id, ingest, seq), streaming or not: by digest the last of (id, ingest, seq) and the number of rows."""
    return arrivals.groupBy("digest").agg(F.max(F.struct("id", "ingest", "seq")).alias("last"), F.count("*").alias("n"))


class DedupState:
    """A dedup state in a folder; ingest() goes on where the last one ended, also after a failure and in another session.

    An ingest is open from when its arrivals are written until it is marked done, after all its hits are checked. A
    call that finds an open one finishes it first: arrivals are never written or counted twice.
    """

    def __init__(self, spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256):
        self.spark, self.path, self.digest = spark, path, digest

    def _whole(self, kind: str) -> list[str]:
        """Folders of a kind that were written to their end, in order."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/n*/_SUCCESS")
        found = top.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(top) or []
        return sorted(x.getPath().getParent().toString() for x in found)

    def _done(self) -> list[tuple[str | None, int, int, int]]:
        """(name, number, epoch, base) of finished ingests in order: the last epoch of updates that is worked in, and the ingest whose groups hold it, -1 for none."""
        paths = self._whole("done")
        rows = self.spark.read.schema("name string, number int, epoch long, base int").parquet(*paths).collect() if paths else []
        return sorted(map(tuple, rows), key=lambda r: r[1])

    def _close(self, name: str | None, number: int, epoch: int, base: int) -> None:
        row = self.spark.createDataFrame([(name, number, epoch, base)], "name string, number int, epoch long, base int")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/done/n{number:06d}")

    @staticmethod
    def _sign(rows: DataFrame):
        """What tells the rows (id, digest) of one input from another's, in any order."""
        h = F.xxhash64("id", "digest")
        return tuple(rows.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int = 64, name: str | None = None) -> int:
        """Takes docs in and checks every hit; returns the number of the ingest. Without a row there is nothing to take in, and -1 is returned.

        name, if given, is the ingest's own: one that is done under it already is not taken in again. Without a
        name a call after a failure is the failed one again if it has the same rows.
        """
        done = self._done()
        for told, number, _, base in done if name is not None else []:
            if told == name:
                return number if base == number else -1
        number = len(self._whole("arrivals"))
        rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
        rows = rows.select("id", self.digest(F.col("t")).alias("digest"), F.lit(number).alias("ingest"), F.monotonically_increasing_id().alias("seq"), "t")
        if number > len(done):
            # arrivals that are whole and were not finished
            named = self.spark.read.schema("name string").parquet(f"{self.path}/names/n{number - 1:06d}").first()["name"]
            self._finish(rows.drop("t").schema, number - 1, files_per_batch, named)
            if name == named and (name is not None or self._sign(rows) == self._sign(self.arrivals(number - 1))):
                return number - 1
            done = self._done()
        place = f"{self.path}/arrivals/n{number:06d}"
        self.spark.createDataFrame([(name,)], "name string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/names/n{number:06d}")
        rows.write.mode("overwrite").option("parquet.block.size", BLOCK_BYTES).parquet(place)
        if self.spark.read.schema(rows.schema).parquet(place).isEmpty():
            self._close(name, number, *(done[-1][2:] if done else (-1, -1)))
            return -1
        self._finish(rows.drop("t").schema, number, files_per_batch, name)
        return number

    def _finish(self, schema, number: int, files_per_batch: int, name: str | None) -> None:
        """All that follows the arrivals; each step may be made again."""
        self._stream(schema, files_per_batch)
        self._check(self.arrivals(number), number)
        epochs = self._epochs()
        epoch = max(epochs)
        before = [base for _, _, _, base in self._done() if base >= 0]
        self._close(name, number, epoch, number)
        # what the newest groups hold is not asked for again; the groups before may still be read by an earlier result
        for e in epochs:
            self._remove(f"{self.path}/updates/epoch={e}")
        for base in sorted(set(before))[:-1]:
            self._remove(f"{self.path}/groups/n{base:06d}")

    def _epochs(self) -> list[int]:
        """Batches of the stream whose updates are there."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/updates/epoch=*")
        found = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(place) or []
        return [int(x.getPath().getName().removeprefix("epoch=")) for x in found]

    def _remove(self, place: str) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def _stream(self, schema, files_per_batch: int) -> None:
        """Streams what is new in the store through the state and stops. Replayed batches overwrite their own output."""
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in STATE_CONF}
        for k, v in STATE_CONF.items():
            conf.set(k, v)
        try:
            arrivals = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{self.path}/arrivals/n*")

            def save(batch: DataFrame, epoch: int) -> None:
                batch.write.mode("overwrite").parquet(f"{self.path}/updates/epoch={epoch}")

            stream = fold(arrivals).writeStream.outputMode("update").option("checkpointLocation", f"{self.path}/checkpoint")
            stream.foreachBatch(save).trigger(availableNow=True).start().awaitTermination()
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)

    def _groups_of(self, number: int) -> DataFrame:
        return self.spark.read.schema(self._group_schema()).parquet(f"{self.path}/groups/n{number:06d}")

    def _group_schema(self):
        ids = self.spark.read.parquet(self._whole("arrivals")[0]).select("digest", F.col("id").alias("keep_id"), F.col("ingest").alias("keep_ingest"), F.col("seq").alias("keep_seq"), F.col("seq").alias("n"))
        return ids.schema

    def groups(self) -> DataFrame:
        """(digest, keep_id, keep_ingest, keep_seq, n): the newest update of each digest, as its count only grows: of those since the last finished ingest, and of the groups that it left."""
        _, _, epoch, base = (self._done() or [(None, -1, -1, -1)])[-1]
        last = F.struct(F.col("last.id").alias("id"), F.col("last.ingest").alias("ingest"), F.col("last.seq").alias("seq"))
        updates = None
        if self._epochs():
            updates = self.spark.read.parquet(f"{self.path}/updates")
            updates = updates.where(F.col("epoch") > epoch).select("digest", "n", last.alias("last"))
        if base >= 0:
            old = self._groups_of(base).select("digest", "n", F.struct(F.col("keep_id").alias("id"), F.col("keep_ingest").alias("ingest"), F.col("keep_seq").alias("seq")).alias("last"))
            updates = old if updates is None else old.unionByName(updates)
        newest = updates.groupBy("digest").agg(F.max(F.struct("n", "last")).alias("u"))
        return newest.select("digest", F.col("u.last.id").alias("keep_id"), F.col("u.last.ingest").alias("keep_ingest"), F.col("u.last.seq").alias("keep_seq"), F.col("u.n").alias("n"))

    def _check(self, new: DataFrame, number: int) -> None:
        """Compares the bytes of every hit among new rows with the content that the state locates; keeps the digests where they differ."""
        self.groups().write.mode("overwrite").parquet(f"{self.path}/groups/n{number:06d}")
        self.known = self._groups_of(number)
        # the rows with their texts are streamed past a hash table of a partition's hits, not sorted
        many = self.known.where("n > 1").drop("n", "keep_id").hint("shuffle_hash")
        located = (F.col("ingest") == F.col("keep_ingest")) & (F.col("seq") == F.col("keep_seq"))
        hits = staged(new.join(many, "digest").select("digest", "t", located.alias("located"), "keep_ingest", "keep_seq"), "dedup-hits")
        content = hits.where("located").select("digest", F.col("t").alias("content"))
        if number:
            # contents of earlier ingests, from the folders that the locators name
            asked = staged(hits.where(F.col("keep_ingest") < number).select("digest", F.col("keep_ingest").alias("ingest"), F.col("keep_seq").alias("seq")).distinct(), "dedup-located")
            folders = sorted(r["ingest"] for r in asked.select("ingest").distinct().collect())
            if folders:
                old = self.spark.read.parquet(*[f"{self.path}/arrivals/n{n:06d}" for n in folders]).select("ingest", "seq", F.col("t").alias("content"))
                content = content.union(old.join(asked, ["ingest", "seq"]).select("digest", "content"))
        content = staged(content, "dedup-content")
        # made distinct only after the table is cut, so that the join may be split where one text has very many copies
        false = staged(hits.join(content, "digest").where("t <> content").select("digest"), "dedup-false")
        false.distinct().write.mode("overwrite").parquet(f"{self.path}/collisions/n{number:06d}")

    def arrivals(self, number: int | None = None) -> DataFrame:
        """The store's rows (id, digest, ingest, seq, t), of one ingest or of all."""
        found = self._whole("arrivals")
        return self.spark.read.parquet(*(found if number is None else [f"{self.path}/arrivals/n{number:06d}"]))

    def decisions(self, number: int) -> DataFrame:
        """(id, digest, keep_id, group_size, kept) for the rows of an ingest; groups hold the rows of all ingests so far."""
        groups = self.known if hasattr(self, "known") else self.groups()
        own = self.arrivals(number).select("id", "digest", "ingest", "seq")
        kept = (F.col("ingest") == F.col("keep_ingest")) & (F.col("seq") == F.col("keep_seq"))
        done = own.join(groups, "digest").select("id", "digest", "keep_id", F.col("n").alias("group_size"), kept.alias("kept"))
        false = self.spark.read.schema("digest string").parquet(*self._whole("collisions")).distinct()
        if false.isEmpty():
            return done
        again = staged(self.arrivals().join(false, "digest", "left_semi"), "dedup-again")
        regrouped = again.groupBy("digest", "t").agg(F.max(F.struct("id", "ingest", "seq")).alias("last"), F.count("*").alias("group_size"))
        mine = again.where(F.col("ingest") == number).join(regrouped, ["digest", "t"])
        same = (F.col("ingest") == F.col("last.ingest")) & (F.col("seq") == F.col("last.seq"))
        return done.join(false, "digest", "left_anti").unionByName(mine.select("id", "digest", F.col("last.id").alias("keep_id"), "group_size", same.alias("kept")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, files_per_batch: int = 64, state_path: str | None = None, name: str | None = None) -> DataFrame:
    """One row per input row: id_col, digest, keep_id, group_size, kept.

    Texts are equal when all bytes are; null counts as empty. Of equal texts the row with the largest id stays
    (null ids are below all others); of rows that repeat that id as well, one. With state_path, the folder of a
    state that may hold earlier rows, groups hold these as well, and a row that stayed before may have to go;
    without, the state is new. A call that failed may be made again with the same rows, or with the same name: they
    are counted once. Texts of any length are stored and compared whole. Other columns are not read,
    whatever their names; an empty table gives an empty result.
    """
    state = DedupState(docs.sparkSession, state_path or new_path(docs.sparkSession, "exact-dedup"), digest)
    number = state.ingest(docs, id_col, text_col, files_per_batch, name)
    if number < 0:
        none = docs.select(F.col(id_col).alias("id"), F.lit("").alias("digest")).where(F.lit(False))
        return none.select(F.col("id").alias(id_col), "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return state.decisions(number).withColumnRenamed("id", id_col)
