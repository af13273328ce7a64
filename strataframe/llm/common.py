"""Shared pieces of the training-data operators: the shared folder, block sizes and text tokens."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import inspect
import itertools
import re
import struct
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Lower-casing touches A-Z alone, as a byte table and as the arguments of translate().
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(spark_col: Column, n: int) -> Column:
    """The fold of an id: crc32 of its decimal text modulo n; a null id is in fold 0."""
    return F.coalesce(F.crc32(spark_col.cast("string").cast("binary")) % n, F.lit(0)).cast("int")


def fold_of(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


#: Spark's setting that removes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """Tables of one run in the folder that spark.checkpoint.dir names, read back without lineage.

    Where that setting is missing, a temporary folder of this machine is used if all of Spark
    runs on it, as in tests; on a cluster it is an error. Written tables survive lost executors.
    ``drop`` removes one that no later stage reads, and ``clean_up`` what results have read.
    """

    made: ClassVar[list[Workspace]] = []

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
            root = held.get() if held.isDefined() else None
        if not root:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = f"file://{tempfile.gettempdir()}/strataframe-checkpoints"
        self.spark, self.root = spark, f"{root}/{name}-{uuid.uuid4().hex}"
        Workspace.made.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """The table, written and read again. Once it is written nothing needs the shuffle files that made it."""
        conf, held = self.spark.conf, self.spark.conf.get(CLEANUP, "false")
        conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", codec).parquet(self.path(name))
        finally:
            conf.set(CLEANUP, held)
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Removes tables; without names, all of them."""
        for name in names or ("",):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name).rstrip("/"))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def clean_up(spark: SparkSession) -> None:
    """Removes the tables of all operators of this session; for when their results have been written."""
    for work in [w for w in Workspace.made if w.spark is spark]:
        work.drop()
        Workspace.made.remove(work)


@contextlib.contextmanager
def lean() -> Iterator[None]:
    """A worker's task without cycle collection, which returns its free memory to the system at its end.

    Workers are reused: what one stage's arrays have taken would else count beside the next one's.
    """
    gc.disable()  # no cycles are made here, and tracing many short lists costs a fifth of the time
    try:
        yield
    finally:
        gc.enable()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


def leanly(run):
    """A function of batches, or of one group's table or of two, under ``lean``."""

    def batches(rows):
        with lean():
            yield from run(rows)

    def held(*tables):
        if sum(t.nbytes for t in tables) < 4_000_000:  # too little to be worth it
            return run(*tables)
        with lean():
            return run(*tables)

    if inspect.isgeneratorfunction(run):
        return batches
    return (lambda one: held(one)) if run.__code__.co_argcount == 1 else (lambda one, two: held(one, two))


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The whole texts of a batch; null is the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def columns(df: DataFrame, *names: str, text: str | None = None) -> DataFrame:
    """The named columns alone, so that a caller's further columns can't clash with an operator's own."""
    return df.select(*[df[f"`{n}`"] for n in names], *([F.coalesce(df[f"`{text}`"], F.lit("")).alias("text")] if text else []))


def runs_of_texts(rows: list[str], most: int = 2_000_000):
    """Index ranges of consecutive texts of about ``most`` characters; a longer text is alone."""
    start = held = 0
    for i, x in enumerate(rows):
        if held and held + len(x) > most:
            yield start, i
            start, held = i, 0
        held += len(x)
    if start < len(rows):
        yield start, len(rows)


_CODEC = pa.Codec("zstd", compression_level=1)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; ``unpack`` returns them with their types."""
    parts = []
    for a in arrays:
        raw = np.ascontiguousarray(a).tobytes()
        made = _CODEC.compress(raw, asbytes=True) if raw else b""
        parts.append(struct.pack("<4sQQ", a.dtype.str[1:].encode(), len(raw), len(made)) + made)
    return b"".join(parts)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, size, held = struct.unpack_from("<4sQQ", data, at)
        at += 20
        raw = _CODEC.decompress(data[at : at + held], size, asbytes=True) if size else b""
        out.append(np.frombuffer(raw, kind.rstrip(b"\0").decode()))
        at += held
    return out


MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of runs: start, start + 1, ... of each."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class WordRows:
    """Words that a worker remembers, each with a row of ids of its own in one flat array.

    ``learn`` gives the ids of new words, end to end, and their numbers. Beyond ``most`` words
    only those of the batch at hand stay.
    """

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int):
        self.learn, self.most = learn, most
        self.row: dict[bytes, int] = {}
        self.flat, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.start = self.size

    def _take(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.flat, self.size = np.concatenate([self.flat, flat.astype(np.uint32)]), np.concatenate([self.size, size])
        self.start = np.cumsum(self.size) - self.size

    def rows(self, split: list[list[bytes]]) -> np.ndarray:
        """The row of each word, one text after another."""
        wanted = set().union(*split)
        new = list(wanted - self.row.keys())
        if len(self.row) + len(new) > self.most:
            stay = [w for w in wanted if w in self.row]
            at = np.array([self.row[w] for w in stay], np.int64)
            flat, size = self.flat[ragged(self.start[at], self.size[at])], self.size[at]
            self.row, self.flat, self.size = dict(zip(stay, range(len(stay)), strict=True)), flat[:0], size[:0]
            self._take(flat, size)
        if new:
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
            self._take(*self.learn(new))
        return np.fromiter(map(self.row.__getitem__, itertools.chain.from_iterable(split)), np.int64, sum(map(len, split)))

    def ids(self, split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and the number of each text's."""
        at = self.rows(split)
        ends = np.cumsum([0, *map(len, split)])
        n = np.concatenate([[0], np.cumsum(self.size[at])])
        return self.flat[ragged(self.start[at], self.size[at])], np.diff(n[ends])


def hashed_words(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, one after another, and the number of words of each text."""
    import xxhash

    split = [(t.encode().translate(LOWER_TABLE) if lower else t.encode()).split() for t in texts]
    size = np.fromiter(map(len, split), np.int64, len(split))
    words = list(set().union(*split))
    held = dict(zip(words, map(xxhash.xxh3_64_intdigest, words), strict=True))
    get = held.__getitem__
    return np.fromiter((get(w) for s in split for w in s), np.uint64, int(size.sum())), size
