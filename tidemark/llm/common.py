"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parts that the rows of one key are dealt over where they meet a decision about the key.
PARTS = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and Spark runs in one process, as in tests,
    a temporary folder is made and set; on a cluster that is an error, as executors would not see it.
    """
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder once and go on from there, so that nothing before is run again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def bounded_sample(df: DataFrame, keys: list[str], bound: int, seed: int) -> DataFrame:
    """About `bound` rows of df at most, the same each time: of the distinct values of `keys` a share by their hash, one row of each.

    Null and repeated keys can't carry it beyond the bound, as rows of equal keys count once; a table of fewer distinct keys gives one row of each.
    The number of distinct keys is an estimate of some 5 %.
    """
    hashed = df.withColumn("_hashed", F.xxhash64(F.lit(seed), *keys))
    distinct = hashed.agg(F.approx_count_distinct("_hashed")).first()[0]
    share = int(min(1.0, bound / max(1, distinct)) * 2**30)
    return hashed.filter(F.pmod("_hashed", F.lit(2**30)) < share).dropDuplicates(["_hashed"]).drop("_hashed")


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str, most_rows: int, seed: int) -> DataFrame:
    """(text, label) of about `most_rows` labelled documents where `learn` (over `id`) holds; of several labels of an id the largest.

    Ids are sampled first, so the side that is broadcast has about most_rows rows of 12 bytes; documents that share an id are sampled again by id and text.
    """
    by = F.max(F.col(label_col).cast("int")).alias("label")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col)).filter(F.col(label_col).isNotNull() & F.col("id").isNotNull()).withColumn("use", learn)
    few = cut(bounded_sample(known.filter("use").groupBy("id").agg(by), ["id"], most_rows, seed))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), "id")
    return cut(bounded_sample(rows, ["id", "text"], most_rows, seed + 1).select("text", "label"))


def with_total(rows: DataFrame, key: str, spread: str, own: Column, total: Callable[[str], Column], name: str) -> DataFrame:
    """rows with a total of their key, as `own` gives it for a part of the key's rows and `total` for the parts' values.

    Rows meet it by key and one of PARTS parts, dealt by a hash of `spread`, so that a hot key lies in several tasks; only its entries, one
    a part, meet by key alone. The rows move once: both uses of them read one exchange.
    """
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(spread), F.lit(PARTS))).repartition(key, "part")
    entries = dealt.groupBy(key, "part").agg(own.alias(name))
    totals = entries.withColumn(name, total(name).over(Window.partitionBy(key)))
    return dealt.join(totals, [key, "part"]).drop("part")
