"""Helpers shared by the operators: plain input columns, Arrow passes over texts, worker caches, components."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.session import forget, stored

# Entries of each of the two generations of a worker's memo, and the longest key that is remembered, which bound its memory.
CACHE_ENTRIES, CACHE_KEY = 150_000, 64
# Values that a worker keeps side by side from task to task; any other is kept alone.
TOGETHER = {"word_hashes", "characters", "powers"}
# Edges up to which components are found by joins that Spark may broadcast; what is stored looks smaller to it than it is.
BROADCAST = 500_000
# Rows that are Python objects at once; Spark's batches hold ten thousand.
ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the id and the text, null text as empty: other columns, whatever their names, cannot clash."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def row_key() -> list:
    """What tells rows apart where a document id is null or repeated: the id and two hashes of the text. Rows that agree in
    it are the same row repeated; operators join results back by it with ``same_row`` and so return every repetition."""
    return [F.col("doc_id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]


KEY = ["doc_id", "h1", "h2"]


def same_row(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on the row key, null ids matching null ids; the right side has one row per key."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in KEY})
    on = (F.col("h1") == F.col("__h1")) & (F.col("h2") == F.col("__h2")) & F.col("doc_id").eqNullSafe(F.col("__doc_id"))
    joined = left.join(renamed, on, how)  # semi and anti joins have no columns of the right side
    return joined.drop(*[f"__{k}" for k in KEY]) if how in ("left", "inner") else joined


def parts(batches: Iterator) -> Iterator[dict]:
    """The rows of Arrow batches, at most ``ROWS`` at a time, as dicts of Python lists; empty batches give none."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS).to_pydict()


def over_texts(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """Run ``make()`` once per task and the function it returns once per part of an Arrow batch: (columns of the part as a dict
    of Python lists) -> dict of columns or None."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        work, into = None, None
        for part in parts(batches):
            work = work or make()
            out = work(part)
            if out is None:
                continue
            into = into or arrow_schema
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in into], schema=into)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    arrow_schema = to_arrow_schema(kind)
    return df.mapInArrow(run, kind)


def over_partition(df: DataFrame, make: Callable[[], tuple[Callable, Callable]], schema: str) -> DataFrame:
    """Like ``over_texts`` for sums: (step, finish); ``step`` sees each part, ``finish`` returns the columns of the task. A step
    may return columns too, if there are many to hold: what is summed so far."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        step, finish = make()
        told = lambda out: pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow_schema], schema=arrow_schema)
        for part in parts(batches):
            if (out := step(part)) is not None:
                yield told(out)
        yield told(finish())

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    arrow_schema = to_arrow_schema(kind)
    return df.mapInArrow(run, kind)


def over_groups(df: DataFrame, by: list[str], make: Callable[[], Callable], schema: str) -> DataFrame:
    """Run a function on each group of rows with equal ``by``; it gets a dict of lists and returns a dict of lists. Groups have
    to be of bounded size; they are hashed to partitions, sorted and streamed, so many small ones cost little."""

    names = df.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        work = make()
        key, group = None, None
        out: dict[str, list] = {f.name: [] for f in arrow_schema}

        def flush():
            for name, values in work(group).items():
                out[name].extend(values)

        def emit():
            batch = pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow_schema], schema=arrow_schema)
            for values in out.values():
                values.clear()
            return batch

        for columns in parts(batches):
            for row in zip(*[columns[n] for n in names]):
                now = tuple(row[i] for i in at)
                if now != key:
                    if group is not None:
                        flush()
                    key, group = now, {n: [] for n in names}
                for n, value in zip(names, row):
                    group[n].append(value)
            if len(out[arrow_schema[0].name]) > 20_000:
                yield emit()
        if group is not None:
            flush()
        yield emit()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    at = [names.index(k) for k in by]
    kind = StructType.fromDDL(schema)
    arrow_schema = to_arrow_schema(kind)
    return df.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, kind)


def worker_cache(name: str, build: Callable[[], object]) -> object:
    """A value that lives on in the Python worker, so tables and memos survive from task to task. What an earlier operator or an
    earlier model left there goes before another is built, so a worker that serves a whole pipeline holds one at a time."""
    keep = sys.modules.setdefault("docket_worker_cache", types.ModuleType("docket_worker_cache")).__dict__.setdefault("kept", {})
    value = keep.pop(name, None)
    if value is None:
        gone = [other for other in keep if not {name, other} <= TOGETHER]
        for other in gone:
            del keep[other]
        if gone:
            release()
        value = build()
    keep[name] = value
    return value


def release() -> None:
    """Give back what dropped values held, Arrow's pool included."""
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()


class Memo(dict):
    """key -> ``work(key)``, remembered unless the key is a long text. When full it becomes the old generation and a new one starts, so what is met often
    stays and memory is bounded by two generations."""

    def __init__(self, work: Callable, size: int = CACHE_ENTRIES):
        super().__init__()
        self.work, self.size, self.old = work, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.work(key)
        if isinstance(key, str) and len(key) > CACHE_KEY:
            return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def word_hashes() -> Memo:
    """word -> 64-bit hash, remembered per worker."""

    def build():
        import xxhash

        return Memo(xxhash.xxh3_64_intdigest)

    return worker_cache("word_hashes", build)


def hash_words(words: Sequence[str], cache: dict):
    import numpy as np

    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


class Words:
    """The words (runs of letters, digits and underscores) of several lower-cased texts: their hashes, the texts' characters
    side by side, and where each word and each text's words begin and end in them."""

    def __init__(self, texts: Sequence[str]):
        import numpy as np

        value, is_word = worker_cache("characters", _characters)
        low = [t.lower() for t in texts]
        self.joined = "\n".join(low)
        points = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        edge = np.diff(is_word[points], prepend=np.int8(0), append=np.int8(0))
        self.start, self.end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        powers, inverse = _powers(len(points))
        # A polynomial over random values of the characters, modulo 2 ** 64: differences of running sums, shifted back.
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[points] * powers[: len(points)])])
            mixed = (sums[self.end] - sums[self.start]) * inverse[self.start]
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            self.hashes = mixed ^ (mixed >> np.uint64(32))
        begins = np.cumsum([0] + [len(t) + 1 for t in low])
        self.first = np.searchsorted(self.start, begins)  # of text i: words first[i] up to first[i + 1]

    def left(self):
        """How many words of its text are left from each word on."""
        import numpy as np

        sizes = np.diff(self.first)
        return np.repeat(self.first[1:], sizes) - np.arange(len(self.start))

    def texts(self, low: int, high: int) -> list[str]:
        return [self.joined[a:b] for a, b in zip(self.start[low:high].tolist(), self.end[low:high].tolist())]


def _characters():
    import numpy as np

    value = np.random.default_rng(7).integers(1, 2**63, 0x110000, np.uint64)
    return value, np.array([chr(i).isalnum() or i == 95 for i in range(0x110000)], np.int8)


def _powers(size: int):
    """Powers of an odd base and of its inverse modulo 2 ** 64, at least ``size`` of each."""
    import numpy as np

    base = 0x9E3779B97F4A7C15
    keep = worker_cache("powers", dict)
    if "powers" not in keep or len(keep["powers"]) < size:
        for name, by in (("powers", base), ("inverse", pow(base, -1, 2**64))):
            steps = np.full(max(size, 2**20), by, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                keep[name] = np.multiply.accumulate(steps)
    return keep["powers"], keep["inverse"]


def in_parts(texts: Sequence[str], chars: int = 500_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters together; a longer text is a range of its own."""
    start, total = 0, 0
    for i, text in enumerate(texts):
        if total and total + len(text) > chars:
            yield start, i
            start, total = i, 0
        total += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def ngram_hashes(hashes, n: int):
    """64-bit hashes of all n-grams of a row of word hashes; fewer than ``n`` words give none."""
    import numpy as np

    count = len(hashes) - n + 1
    if count <= 0:
        return hashes[:0]
    with np.errstate(over="ignore"):
        out = np.full(count, n, np.uint64)
        for i in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + count]
            out ^= out >> np.uint64(29)
        out = out * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a long, b long): (node, root), root the smallest node of the component.

    Each round every node takes the smallest root among its neighbours and then the root of that root (pointer jumping), so a
    chain of n nodes needs about log n rounds. Every round is written to the shared folder; a hub's edges are summed partially
    before they meet, and only one number per round comes to the driver. Roots only fall, so the rounds end."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    label = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    joined = (lambda df: df) if both.count() <= BROADCAST else (lambda df: df.hint("merge"))
    while True:
        near = both.join(joined(label), both.b == label.node).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        own = label.join(joined(near), "node").select("node", "root", F.least("root", "near").alias("low"))
        # The old root learns of the smaller one too, so whole trees hook together.
        hooks = own.select(F.col("root").alias("node"), "low").union(own.select("node", "low"))
        hooked = stored(hooks.groupBy("node").agg(F.min("low").alias("root")))
        jump = hooked.alias("x").join(joined(hooked.alias("y")), F.col("x.root") == F.col("y.node"), "left")
        after = stored(jump.select("x.node", F.least(F.col("x.root"), F.coalesce("y.root", "x.root")).alias("root")))
        changed = after.join(joined(label.withColumnRenamed("root", "was")), "node").filter("root <> was").limit(1).count()
        forget(hooked, label)
        label = after
        if not changed:
            forget(both)
            return label
