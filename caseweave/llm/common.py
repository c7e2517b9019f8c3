"""What the operators of this subpackage share: staging in the shared folder, skew-proof joins, word scanning."""

from __future__ import annotations

import sys
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Where the tables of this process were staged, for `release`.
_staged: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only on a local master, as in tests, a new temporary one is taken where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="caseweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage, survives lost executors."""
    return stage_at(df, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}", codec)


def stage_at(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    """`stage` with a path of the caller's, which may `remove` it when nothing reads it any more."""
    df.write.option("compression", codec).parquet(path)
    _staged.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged table."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    if path in _staged:
        _staged.remove(path)


def release(spark: SparkSession) -> None:
    """Delete all tables that this process has staged; for after the results that read them are written."""
    for path in list(_staged):
        remove(spark, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores before it that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Ranges at most: their first keys are the only thing that `range_buckets` brings to the driver.
MOST_RANGES = 1 << 20


def range_buckets(df: DataFrame, key: str, load: Column, most: int, salt: Column, name: str) -> DataFrame:
    """Add `name`, ascending by key (a long): the number of the key range that a row is in; null keys come last.

    A range holds about `most` of `load` (at least 1 / MOST_RANGES of all). Rows of one key stay in one range
    unless they are more than two loads; then parts of it, in order of the hash `salt`, get numbers of their own.
    """
    from pyspark.ml.feature import Bucketizer

    spark = df.sparkSession
    sized = df.select(F.col(key).cast("long").alias("k"), load.cast("long").alias("n"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    most = max(most, -(-total // MOST_RANGES))

    def cut(batches):
        import pyarrow as pa

        first, last, held = None, None, 0
        for batch in batches:
            rows = []
            for k, n in zip(batch.column("k").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if first is None or (k != last and held >= most):
                    if first is not None:
                        rows.append((first, last, held))
                    first, held = k, 0
                last, held = k, held + n
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 3, names=["first", "last", "held"])
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (first, last, held)], names=["first", "last", "held"])

    tasks = max(1, min(-(-total // most), partitions(spark)))
    per_key = sized.where(F.col("k").isNotNull()).groupBy("k").agg(F.sum("n").alias("n"))
    ranges = per_key.repartitionByRange(tasks, "k").sortWithinPartitions("k").mapInArrow(cut, "first long, last long, held long").collect()
    merged: dict[float, list] = {}  # ids beyond 2**53 that are one double are one range
    for r in sorted(ranges, key=lambda r: r["first"]):
        have = merged.setdefault(float(r["first"]), [r["first"], r["last"], 0])
        have[1:] = [r["last"], have[2] + r["held"]]
    split = [(j, -(-held // most)) for j, (first, last, held) in enumerate(merged.values()) if first == last and held > 2 * most]
    blank = sized.where(F.col("k").isNull()).agg(F.sum("n")).first()[0] or 0
    splits = [float("-inf"), *(list(merged)[1:] or [sys.float_info.max]), float("inf")]  # two ranges at least
    if blank > 2 * most:
        split.append((len(splits) - 1, -(-blank // most)))  # the bucket after the last is for NaN
    number = unused(df, "_number")
    typed = df.withColumn(number, F.coalesce(F.col(key).cast("double"), F.lit(float("nan"))))
    found = Bucketizer(splits=splits, inputCol=number, outputCol=name, handleInvalid="keep").transform(typed).drop(number)
    found = found.withColumn(name, F.col(name).cast("int"))
    if not split:
        return found.withColumn(name, F.col(name).cast("long")).drop(number)
    rows, at, parts = [], 0, dict(split)
    for j in range(len(splits)):
        n = min(parts.get(j, 1), 1 << 20)
        rows.append((j, at, n))
        at += n
    table = F.broadcast(spark.createDataFrame(rows, f"{name} int, {number} long, {number}_n long"))  # a row for each range
    part = F.shiftrightunsigned(F.shiftrightunsigned(salt, 44) * F.col(f"{number}_n"), 20)
    return found.join(table, name).withColumn(name, F.col(number) + part).drop(number, f"{number}_n")


def hot_rows(rows: int) -> int:
    """Rows of a key from which on `join_hot` broadcasts it: a thousandth of all, so that there are a thousand such keys at most."""
    return max(1, rows // 1000)


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: Column, hot: int) -> DataFrame:
    """Left join on a key unique in `right`, safe when some keys hold a large share of `left`.

    `weight` (over right's columns) is the number of left rows of a key. Keys with at least `hot` rows, of
    which there are at most count(left) / hot, are broadcast; the others shuffle. Null keys find nothing, and
    their rows stay in their tasks, as a shuffle would bring them all to one.
    """
    heavy = right.where(weight >= hot)
    light = right.where(weight < hot)
    marks = F.broadcast(heavy.select(F.col(key).alias("_hot_key"), F.lit(True).alias("_hot")))
    marked = left.join(marks, left[key].eqNullSafe(F.col("_hot_key")), "left").drop("_hot_key")
    stays = F.col("_hot").isNotNull() | F.col(key).isNull()
    a = marked.where(stays).drop("_hot").join(F.broadcast(heavy), key, "left")
    b = marked.where(~stays).drop("_hot").join(light, key, "left")
    return a.unionByName(b)


#: Seeds and odd multipliers of two independent hashes, and those of a 64-bit mixer (fixed values).
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
ODDS = (0xD1B54A32D192ED03, 0x9FB21C651E98DF25)
MIX_A, MIX_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Words are read in steps of eight bytes by all together, up to so many bytes; the rest of longer ones one by one.
TOGETHER = 512
#: Masks of the first bytes of eight.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as an integer, zeros beyond the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lanes: int = 1) -> list[np.ndarray]:
    """One or two independent 64-bit hashes of data[start:end] for each pair: every eight bytes are mixed into a state, so no pattern of bytes cancels out."""
    import xxhash

    eights, size = _eights(data), ends - starts
    found = [mix(size.astype(np.uint64) + np.uint64(SEEDS[k])) for k in range(lanes)]
    at, where, left = slice(None), starts, size
    for done in range(0, TOGETHER, 8):
        part = eights[where] & FIRST[np.minimum(left, 8)]
        for k, h in enumerate(found):
            h[at] = mix((h[at] ^ part) * np.uint64(ODDS[k]))
        more = np.flatnonzero(left > 8)
        if not len(more):
            return found
        at = more if done == 0 else at[more]
        where, left = starts[at] + done + 8, left[more] - 8
    for j in at.tolist():
        rest = data[starts[j] + TOGETHER : ends[j]].tobytes()
        for k, h in enumerate(found):
            h[j] = mix(h[j : j + 1] ^ np.uint64(xxhash.xxh3_64_intdigest(rest, SEEDS[k])))[0]
    return found


def same_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, twins: np.ndarray) -> np.ndarray:
    """Whether the bytes of each word are those of the word numbered in `twins`."""
    eights, size = _eights(data), ends - starts
    good = size == size[twins]
    at = np.flatnonzero(good & (twins != np.arange(len(twins))))
    for done in range(0, TOGETHER, 8):
        left = size[at] - done
        good[at] &= ((eights[starts[at] + done] ^ eights[starts[twins[at]] + done]) & FIRST[np.clip(left, 0, 8)]) == 0
        at = at[left > 8]
        if not len(at):
            return good
    for j in at.tolist():
        good[j] &= bool((data[starts[j] : ends[j]] == data[starts[twins[j]] : ends[twins[j]]]).all())
    return good


def run_hashes(words: np.ndarray, width: int, lane: int) -> np.ndarray:
    """A hash of each run of `width` words by theirs: joined in pairs, pairs of pairs and so on, each time mixed."""

    def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return mix((mix(x + np.uint64(SEEDS[lane])) + y) * np.uint64(ODDS[lane]))

    runs = len(words) - width + 1
    if runs < 1:
        return np.zeros(0, np.uint64)
    out, covered, power, size = None, 0, words, 1
    while True:
        if width & size:
            part = power[covered : covered + runs]
            out = part if out is None else joined(out, part)
            covered += size
        if 2 * size > width:
            return out
        power, size = joined(power[:-size], power[size:]), 2 * size


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts laid end to end (text i is data[offsets[i]:offsets[i + 1]], UTF-8).

    A word is a longest run without the bytes 32 and 9 to 13. Gives start and end of each word, and for each
    text the index of its first word (with one more entry for the end).
    """
    n = len(data)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[n - 1 :] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array, nulls as empty texts."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = column.buffers()[2]
    data = np.frombuffer(whole, dtype=np.uint8)[offsets[0] : offsets[-1]] if whole is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(column) else np.zeros(1, np.int64)


def slices(offsets: np.ndarray, most: int):
    """Ranges (a, b) of texts, each of about `most` bytes or a single text."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = b
