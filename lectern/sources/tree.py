"""Snapshots of a tree of files: contents are kept once, by their hash, and a new snapshot copies only what is new.

Executors list, read and hash the files through Spark's file source, so a tree may lie on any storage. Of a file
whose size and time are those of the snapshot before, nothing is read. A folder's hash is made of those of what it
holds, so two trees are equal if the hashes of their roots are, and where they differ, only folders that differ lead
to the files.
"""

from __future__ import annotations

import hashlib
import json
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import materialise
from lectern.sources.hdfs import Files

#: Files that are asked for by their paths.
LISTED = 10_000
#: The hash of an empty file, whose contents need no copy.
EMPTY = hashlib.sha256(b"").hexdigest()
TREE = "rel_path string, size long, modified timestamp, hash string"


def files_of(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel_path, size, modified) of all files below a folder; none if there is no folder. No content is read."""
    files = Files(spark)
    if not root or not files.exists(root):
        return spark.createDataFrame([], "path string, rel_path string, size long, modified timestamp")
    base = files.plain(root) + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.substr("path", F.instr("path", base) + F.lit(len(base)))
    listed = found.select("path", rel.alias("rel_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    names = [unquote(p).split(base, 1)[1] for p in found.inputFiles()]
    if len(names) == listed.count():
        return listed
    # Spark's index knows empty files, but its scans leave them out.
    scanned = {r["rel_path"] for r in listed.select("rel_path").toLocalIterator()}
    empty = [(f"{root.rstrip('/')}/{n}", n, 0, files.modified(f"{root.rstrip('/')}/{n}")) for n in names if n not in scanned]
    return listed.union(spark.createDataFrame(empty, listed.schema))


def snapshot(spark: SparkSession, root: str, sets: str, name: str, before: str | None = None) -> dict:
    """Take the snapshot `name` of the tree at `root` below `sets`; {files, bytes, copied, reused, root_hash}.

    `before` names an earlier snapshot there, which has to be kept as long as this one, as the contents of unchanged
    files stay there. An empty tree or none gives a snapshot without files; a file is 2 GB at most. The note of a snapshot is written last, so one without a note is not whole.
    """
    files = Files(spark)
    old = tree(spark, sets, before) if before else spark.createDataFrame([], TREE)
    listed = files_of(spark, root)
    same = old.select("rel_path", F.col("size").alias("old_size"), F.col("modified").alias("old_modified"), F.col("hash").alias("old_hash"))
    met = listed.join(same, "rel_path", "left").withColumn("known", F.coalesce((F.col("size") == F.col("old_size")) & (F.col("modified") == F.col("old_modified")), F.lit(False)))
    met = materialise(met.select("path", "rel_path", "size", "modified", F.when(F.col("size") == 0, EMPTY).when(F.col("known"), F.col("old_hash")).alias("hash")), "listed")
    here, wanted = f"{sets}/{name}", met.filter("hash is null").select("path")
    count = wanted.count()
    if count:
        # A few files are asked for by their paths; of many the tree is read, as one list on the driver would be.
        few = count <= LISTED
        source = spark.read.format("binaryFile")
        read = source.load([escaped(r["path"]) for r in wanted.collect()]) if few else source.option("recursiveFileLookup", "true").load(root).join(wanted, "path", "left_semi")
        fresh = read.select("path", F.sha2("content", 256).alias("new_hash"), "content")
        fresh.write.parquet(f"{here}/read")
        fresh = spark.read.parquet(f"{here}/read")
        hashed = met.join(fresh.select("path", "new_hash"), "path", "left").withColumn("hash", F.coalesce("hash", "new_hash"))
        known = old.select(F.col("hash").alias("new_hash")).distinct()
        blobs = fresh.join(known, "new_hash", "left_anti").groupBy("new_hash").agg(F.min("path").alias("path"))
        fresh.join(blobs, ["new_hash", "path"], "left_semi").select(F.col("new_hash").alias("hash"), "content").write.parquet(f"{here}/blobs")
    else:
        hashed = met
    hashed.select("rel_path", "size", "modified", "hash").write.parquet(f"{here}/tree")
    files.delete(f"{here}/read")
    done = spark.read.schema(TREE).parquet(f"{here}/tree")
    total = done.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    copied = spark.read.parquet(f"{here}/blobs").count() if files.exists(f"{here}/blobs") else 0
    top = folders(done).filter("folder = ''").first()
    note = {"files": total["files"], "bytes": total["bytes"], "copied": copied, "reused": total["files"] - count, "root_hash": top["hash"] if top else None, "before": before}
    files.write_new(f"{here}/note.json", json.dumps(note))
    return note


def escaped(path: str) -> str:
    """A path that the reader takes as it is, not as a pattern."""
    return "".join("\\" + c if c in "{}[]*?\\" else c for c in path)


def note(spark: SparkSession, sets: str, name: str) -> dict:
    return json.loads(Files(spark).read(f"{sets}/{name}/note.json"))


def tree(spark: SparkSession, sets: str, name: str) -> DataFrame:
    """(rel_path, size, modified, hash) of a whole snapshot."""
    note(spark, sets, name)
    return spark.read.schema(TREE).parquet(f"{sets}/{name}/tree")


def contents(spark: SparkSession, sets: str, name: str) -> DataFrame:
    """(rel_path, content): a snapshot with its files' contents, which may lie in snapshots before it."""
    files, chain, at = Files(spark), [], name
    while at:
        if files.exists(f"{sets}/{at}/blobs"):
            chain.append(f"{sets}/{at}/blobs")
        at = note(spark, sets, at)["before"]
    blobs = spark.read.schema("hash string, content binary").parquet(*chain).dropDuplicates(["hash"]) if chain else spark.createDataFrame([], "hash string, content binary")
    nothing = spark.createDataFrame([(EMPTY, bytearray())], "hash string, content binary")
    return tree(spark, sets, name).join(blobs.union(nothing), "hash").select("rel_path", "content")


def folders(files: DataFrame) -> DataFrame:
    """(folder, depth, hash, files): the hash of each folder, of the names and hashes in it at any depth; the root is ''.

    A hash is a sum over all that a folder holds, so large folders are added up in parts.
    """
    parts = F.split("rel_path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    inside = files.select(F.explode(above).alias("folder"), F.sha2(F.concat_ws("\0", "rel_path", "hash"), 256).alias("leaf"))
    lane = lambda k: F.sum(F.conv(F.substring("leaf", 15 * k + 1, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{k}")
    sums = inside.groupBy("folder").agg(F.count("*").alias("files"), *[lane(k) for k in range(4)])
    digest = F.sha2(F.concat_ws(",", "files", *[F.col(f"s{k}").cast("string") for k in range(4)]), 256)
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    return sums.select("folder", depth.alias("depth"), digest.alias("hash"), "files")


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(rel_path, change): what was added, changed or deleted; only files below folders whose hashes differ are compared."""
    o, n = folders(old).select("folder", F.col("hash").alias("was")), folders(new).select("folder", F.col("hash").alias("now"))
    differ = o.join(n, "folder", "full").filter(~F.col("was").eqNullSafe(F.col("now"))).select("folder")
    within = lambda t: t.withColumn("folder", F.regexp_replace("rel_path", "/?[^/]*$", "")).join(differ, "folder", "left_semi")
    both = within(old).select("rel_path", F.col("hash").alias("was")).join(within(new).select("rel_path", F.col("hash").alias("now")), "rel_path", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "changed")
    return both.select("rel_path", change.alias("change")).filter("change is not null")
