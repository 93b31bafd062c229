"""What the operators of this subpackage share: the shared work folder, tables
written there, and the bounded sample of labelled rows that fits a classifier."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: keys that carried() takes as one range
KEYS = 1024

_own_dirs: dict[str, str] = {}
_paths: dict[int, tuple[weakref.ref, str]] = {}


def work_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where that is unset, a local run (as in tests) gets a folder of its own; on a
    cluster that is an error, as executors do not see each other's disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="tracewell-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there,
    so that a lost executor costs no recomputation of what stands before."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out), path)
    return out


def discard(*frames: DataFrame) -> None:
    """Remove tables that saved() wrote and that nothing will read again."""
    for frame in frames:
        held, path = _paths.pop(id(frame), (None, ""))
        if held is not None and held() is frame:
            store, at = fs.FileSystem.from_uri(path)
            store.delete_dir(at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def carried(df: DataFrame, key: str, sums: dict[str, str] | None = None, maxima: dict[str, str] | None = None) -> DataFrame:
    """``df``, one row for each ``key`` (long, from 0), with a column for each name: the sum (0 at first) or maximum (null at
    first) of its column over all lesser keys. Ranges of KEYS keys are carried first, so no task orders all rows."""
    made = {name: (F.sum, F.lit(0), c) for name, c in (sums or {}).items()} | {name: (F.max, F.lit(None), c) for name, c in (maxima or {}).items()}
    ranged = df.withColumn("_range", F.expr(f"{key} div {KEYS}"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    tops = ranged.groupBy("_range").agg(*[fn(c).alias(f"_{name}") for name, (fn, _, c) in made.items()])
    tops = tops.select("_range", *[F.coalesce(fn(f"_{name}").over(before), start).alias(f"_{name}") for name, (fn, start, _) in made.items()])
    within = W.partitionBy("_range").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    own = ranged.select("*", *[fn(c).over(within).alias(f"_own_{name}") for name, (fn, _, c) in made.items()]).join(tops, "_range")
    total = lambda fn, name: F.coalesce(F.col(f"_own_{name}"), F.lit(0)) + F.col(f"_{name}") if fn is F.sum else F.greatest(f"_own_{name}", f"_{name}")
    return own.select(*df.columns, *[total(fn, name).alias(name) for name, (fn, _, _) in made.items()])


def held_out(mod: int, rem: int):
    """Whether crc32 of the doc_id's text leaves ``rem``; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rem, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, rem: int, per_class: int, max_chars: int) -> tuple[list[str], list[int]]:
    """At most ``per_class`` texts of each label, none held out, for fitting on the driver.

    The sample is fixed by a hash of doc_id. A doc_id with several label rows
    takes the highest; texts over ``max_chars`` are left out before the sample is
    drawn, so it holds at most 2 * per_class * max_chars characters whatever the
    input's size, and that many texts where there are so many.
    """
    texts = docs.select("doc_id", "text").where(F.length("text") <= max_chars)
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).where(~held_out(mod, rem)).withColumn("h", F.xxhash64("doc_id"))
    known = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    chosen = [known.where(F.col("y") == y).orderBy("h", "doc_id").limit(per_class) for y in (0, 1)]
    ids = chosen[0].unionByName(chosen[1])
    rows = texts.join(F.broadcast(ids), "doc_id").orderBy("h", "doc_id", "text").limit(2 * per_class).select("text", "y").collect()
    return [r.text for r in rows], [r.y for r in rows]
