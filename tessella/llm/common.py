"""What the corpus operators share: reading tables, words, hashes and tables cut from their lineage."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
BATCH = 1000  # rows
WHITE = re.compile(rb"[ \t-\r]")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the corpus, by Spark's own reader, so that the folder may be in any store."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. Only where everything is one process may it be left unnamed, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_made: list[list[str]] = []  # the tables written inside each open temporary_tables()


def cut(df: DataFrame, outlives: bool = False) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends here, and a lost executor costs no recomputation of it. It may outlive the innermost temporary_tables()."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    for made in _made[-2:-1] if outlives else _made[-1:]:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """What cut() writes inside is deleted at the end, but for tables that outlive it."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def mapped(df: DataFrame, run: Callable, schema, remembers: bool = False) -> DataFrame:
    """df.mapInArrow(run, schema) for rows that hold texts: a batch has at most BATCH of them, since the JVM and Python each hold whole batches. Unless run uses kept(), it first drops what earlier work remembers in its worker."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf.set(name, str(min(BATCH, int(conf.get(name))) if int(conf.get(name)) > 0 else BATCH))

    def alone(batches):
        forget()
        yield from run(batches)

    return df.mapInArrow(run if remembers else alone, schema)


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches in parts of about `most` bytes of a column (or one longer value), so that what a worker holds at once stays small."""
    for b in batches:
        c = b.column(column)
        sizes = np.asarray(pc.fill_null(pc.binary_length(c), 0), np.int64)
        part = np.cumsum(sizes) // most
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.empty(0, np.int64)
        for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(part)], strict=True):
            yield b.slice(x, y - x)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def binary_text(text: str = "text") -> Column:
    """The text's UTF-8; null stays null."""
    return F.col(text).cast("binary")


def words(text: bytes | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ : bytes.split() splits at just these characters."""
    return text.split() if text else []


#: Of every byte a random number, and whether it parts words.
BYTE_CODE = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)
PARTS_WORDS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
TO_SPACES = bytes(0x20 if x else k for k, x in enumerate(PARTS_WORDS))
PLACE_CODE = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, U64), dtype=U64)
TOGETHER, APART = 1 << 16, 1 << 20  # bytes of short texts that are hashed at once, and of the parts of a long one


@dataclass
class Words:
    """The words of some texts in a row: hashes, the text that each is of, where it begins and ends there, and the words of each text."""

    hashes: np.ndarray
    owner: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    sizes: np.ndarray


def _coded(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of data: hashes, first bytes and ends. A word's hash is the sum of its bytes' codes, each times its place's."""
    a = np.frombuffer(data, np.uint8)
    inside = ~PARTS_WORDS[a]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begin, end = edges[::2], edges[1::2]
    if not len(begin):
        return np.empty(0, U64), begin, end
    size = end - begin
    first = np.cumsum(size) - size
    letters = a[inside]
    place = np.arange(len(letters)) - np.repeat(first, size)
    return mix(np.add.reduceat(BYTE_CODE[letters] * PLACE_CODE[place & len(PLACE_CODE) - 1], first)), begin, end


def word_table(texts: list[bytes | None]) -> Words:
    """All words [^\\x20\\x09-\\x0D]+ of the texts, hashed together. Equal words have equal hashes in every text."""
    found, group, held = [], [], 0

    def flush() -> None:
        nonlocal group, held
        if group:
            h, begin, end = _coded(b" ".join(t for _, t, _ in group))
            size = np.array([len(t) + 1 for _, t, _ in group])
            at = np.cumsum(size) - size
            which = np.searchsorted(at, begin, "right") - 1
            shift = (np.array([s for _, _, s in group]) - at)[which]
            found.append((h, np.array([k for k, _, _ in group])[which], begin + shift, end + shift))
        group, held = [], 0

    for k, text in enumerate(texts):
        text, start = text or b"", 0
        while len(text) - start > APART:  # cut a long text between words, if it has any
            gap = WHITE.search(text, start + APART)
            stop = gap.start() if gap else len(text)
            group.append((k, text[start:stop], start))
            flush()
            start = stop
        group.append((k, text[start:], start))
        held += len(text) - start
        if held > TOGETHER:
            flush()
    flush()
    none = np.empty(0, np.int64)
    h, owner, begin, end = (np.concatenate(x) for x in zip((np.empty(0, U64), none, none, none), *found, strict=True))
    return Words(h, owner, begin, end, np.bincount(owner, minlength=len(texts)))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n-grams that start at each word; empty if there are fewer than n words."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, U64)
    acc = np.zeros(m, U64)
    for i in range(n):
        acc = acc * U64(0x9E3779B97F4A7C15) + h[i : i + m]
    return mix(acc)


class Recent(dict):
    """A bounded memo in two generations: words in use stay, others go when it is full. Long keys are not kept, so its bytes are bounded too."""

    def __init__(self, make: Callable, most: int = 400_000, longest: int = 100):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(key) > self.longest:
            return
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value


_kept: dict = {}
_with_kept: list[Callable] = []  # what else goes when kept() drops something, such as caches of vocabularies


def kept(make: Callable, *args):
    """make(*args), kept by the Python worker until another is asked for, so that the memos of earlier stages don't add up."""
    if (make, *args) not in _kept:
        forget()
        _kept[make, *args] = make(*args)
    return _kept[make, *args]


def forget() -> None:
    """Drops what kept() holds, and gives its memory back to the system, in tasks that need memory for something else."""
    if _kept:
        _kept.clear()
        for clear in _with_kept:
            clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the C library keeps freed memory otherwise
            trim(0)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of the hash space each hash is in."""
    return ((h >> U64(32)) * U64(n)) >> U64(32)


def is_train(doc_id: str = "doc_id", held: int = 1) -> Column:
    """False where crc32(doc_id as text) mod 5 is the held-out remainder; a null id is training data."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != held, F.lit(True))
