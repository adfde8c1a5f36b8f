"""Shared-folder helpers: checkpoints and written tables that every executor can read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a temporary one in local mode; on a cluster, an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return named or sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: lineage ends here and a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Paths that ``written`` made inside the open ``scratch`` blocks, innermost last.
_scratch: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written once as Parquet in the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scratch:
        _scratch[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that nothing reads any more, wherever they lie."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession):
    """Tables written inside are deleted at the end but for the last one, the result; gives the list of their paths, of which the result's stays."""
    paths: list[str] = []
    _scratch.append(paths)
    try:
        yield paths
    finally:
        _scratch.pop()
        remove(spark, paths[:-1])
        del paths[:-1]


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the table does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    return next(n for i in count() if (n := stem + "_" * i) not in taken)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(df: DataFrame, seed: int = 0) -> Column:
    """A 64-bit hash of a whole row: equal rows share it, rows that differ anywhere do not but for collisions, of which 10^10 rows have about three. Columns of maps and variants are left out. Another seed gives another hash."""
    plain = [F.col(f"`{f.name}`") for f in df.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    return F.xxhash64(*([F.lit(seed)] if seed else []), *plain)


def filter_bits(hashes: DataFrame, bits: int, places) -> np.ndarray:
    """A bit map of fixed size over all partitions: each sends its blocks that have bits set, and blocks are joined by OR.

    ``places(uint64 array)`` lists the arrays of bit numbers that hashes (one long column) set.
    """
    block = 1 << 16

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(bits >> 3, np.uint8)
        for f in frames:
            for at in places(f.iloc[:, 0].to_numpy().view(np.uint64)):
                np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
        found = [(i, out[i : i + block].tobytes()) for i in range(0, len(out), block) if out[i : i + block].any()]
        yield pd.DataFrame(found, columns=["start", "bits"]).astype({"start": "int32"})

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"start": [key[0]], "bits": [np.bitwise_or.reduce(np.stack([np.frombuffer(x, np.uint8) for x in rows["bits"]])).tobytes()]})

    out = np.zeros(bits >> 3, np.uint8)
    for row in hashes.mapInPandas(mark, "start int, bits binary").groupBy("start").applyInPandas(merge, "start int, bits binary").toLocalIterator():  # bits / 8 bytes in all
        out[row["start"] : row["start"] + block] = np.frombuffer(row["bits"], np.uint8)
    return out


def word_count(text):
    """Number of words of a text column; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
