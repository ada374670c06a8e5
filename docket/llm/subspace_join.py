"""Near-duplicate vectors by a subspace pigeonhole join: rotated vectors are cut into blocks of few dimensions, each block is
range-joined under its share of the squared distance, and what any block lets through is verified exactly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.llm.common import components, table
from docket.session import forget, stored

SIMILAR = 0.93
WIDTH = 32  # dimensions of a block
GRID = 2  # leading dimensions of a block whose cells the range join meets in
CHUNK = 32_768  # vectors of one cell that are compared at once, with as many others
NUMBERS = 2**21  # numbers that the vectors of a chunk, or of pairs that are verified at once, hold together at most
STRIP = 2**22  # pairs of a chunk whose coarse distances are looked at at once
SLACK = 1e-9  # added to squared distances, against rounding; verification is exact
DENSE = 16  # where one pair of so many passes that look, all pairs of a strip are compared by products
COARSE = 1e-4  # added to squared distances in single precision, which are off by less


def usable(rows: DataFrame) -> DataFrame:
    """(row, label, size, vec) of rows with a label and a vector that is not null, empty or zero and holds finite numbers only."""
    sound = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0)
    return rows.filter(F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))


def over_arrays(df: DataFrame, size: int, make: Callable[[], tuple[Callable, Callable]], schema: str) -> DataFrame:
    """``make()`` once per task gives (step, finish). ``step`` sees the columns of each Arrow batch as numpy arrays, the vectors
    ``vec`` of any length as rows of ``size`` doubles with zeros at their ends, which keeps lengths and distances, and their
    ``length``. Both return columns or None."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def arrays(batch) -> dict:
            out = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns) if n != "vec"}
            vec = batch.column("vec")
            ends = vec.offsets.to_numpy()
            flat, length = vec.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], np.diff(ends)
            out["vec"], out["length"] = np.zeros((len(length), size)), length
            place = np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], length)
            out["vec"][np.repeat(np.arange(len(length)), length), place] = flat
            return out

        step, finish = make()
        told = lambda out: pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow_schema], schema=arrow_schema)
        for batch in batches:
            if batch.num_rows and (out := step(arrays(batch))) is not None:
                yield told(out)
        if (out := finish()) is not None:
            yield told(out)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    arrow_schema = to_arrow_schema(kind)
    return df.mapInArrow(run, kind)


def axes(vectors: DataFrame, size: int):
    """An orthogonal matrix whose columns are the main directions of the unit vectors, dealt to blocks back and forth so that
    each block gets its part of the large ones first; and the blocks' columns. Only size x size sums reach the driver."""

    def make():
        import numpy as np

        total = np.zeros((size, size))

        def step(batch: dict) -> None:
            nonlocal total
            units = unit(batch["vec"])
            total += units.T @ units

        def finish() -> dict:
            i, j = np.divmod(np.arange(size * size), size)
            return {"i": i, "j": j, "total": total.ravel()}

        return step, finish

    import numpy as np

    sums = over_arrays(vectors.select("vec"), size, make, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))
    moments = np.zeros((size, size))
    for row in sums.toLocalIterator():
        moments[row.i, row.j] = row.total
    main = np.linalg.eigh((moments + moments.T) / 2)[1][:, ::-1]
    count = max(1, size // WIDTH)
    dealt: list[list[int]] = [[] for _ in range(count)]
    for at in range(size):
        turn, place = divmod(at, count)
        dealt[place if turn % 2 == 0 else count - 1 - place].append(at)
    return main, dealt


def unit(rows):
    import numpy as np

    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares stay within range
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def placed(nodes: DataFrame, main, dealt: list[list[int]], size: int, radius2: float) -> DataFrame:
    """(node, label, block, cell, home): each vector in its own cell of each block, and as a guest in those cells around it,
    of a lower place, that lie within the block's radius; so two vectors within the radius meet in one cell exactly."""

    def make():
        from itertools import product

        import numpy as np

        steps = {g: [s for s in product((-1, 0, 1), repeat=g) if s < (0,) * g] for g in range(1, GRID + 1)}

        def work(batch: dict) -> dict:
            turned = unit(batch["vec"]) @ main
            node, label = batch["node"], batch["label"]
            out: dict[str, list] = {"node": [], "label": [], "block": [], "cell": [], "home": []}
            for b, columns in enumerate(dealt):
                width = np.sqrt(radius2 * len(columns) / size + SLACK)
                x = turned[:, columns[:GRID]] / width
                cell = np.floor(x).astype(np.int64)
                inside = x - cell

                def add(which, cells, home):
                    out["node"].append(node[which])
                    out["label"].append(label[which])
                    out["block"].append(np.full(len(cells), b, np.int32))
                    code = np.zeros(len(cells), np.int64)
                    for column in cells.T:
                        code = code * 2**20 + column + 2**19
                    out["cell"].append(code)
                    out["home"].append(np.full(len(cells), home))

                add(slice(None), cell, True)
                for step in steps[cell.shape[1]]:
                    s = np.array(step)
                    gap = np.where(s < 0, inside, np.where(s > 0, 1 - inside, 0.0))
                    near = np.nonzero((gap * gap).sum(axis=1) <= 1 + SLACK)[0]
                    add(near, cell[near] + s, False)
            return {k: np.concatenate(v) for k, v in out.items()}

        return work, lambda: None

    return over_arrays(nodes.select("node", "label", "vec"), size, make, "node long, label long, block int, cell long, home boolean")


def linked(rows: DataFrame, main, dealt: list[list[int]], size: int, similar: float, radius2: float) -> DataFrame:
    """(node, root, links) per vector and pair of chunks of a cell: links found there, counted in rows of the table, and a
    vector that stands for all which links join within the pair. A pair is counted in the first block that lets it through only."""
    by = ["label", "block", "cell", "lo", "hi"]

    def make():
        import numpy as np

        budgets = [radius2 * len(c) / size + SLACK for c in dealt]
        most = max(1, NUMBERS // size)
        key, held = None, []
        out: dict[str, list] = {"node": [], "root": [], "links": []}

        def work(block: int, within: bool, g: dict) -> dict:
            scaled = g["vec"] / np.abs(g["vec"]).max(axis=1, keepdims=True)
            norm, turned = np.sqrt((scaled * scaled).sum(axis=1)), unit(g["vec"]) @ main
            parts = [turned[:, c] for c in dealt[: block + 1]]
            side, home, node, weight, length = (g[n] for n in ("side", "home", "node", "size", "length"))
            # Products of these rows are squared distances in the block, halved and below zero.
            own = parts[block]
            half, one = -(own * own).sum(axis=1, keepdims=True) / 2, np.ones((len(own), 1))
            here, there = (np.hstack(x).astype(np.float32) for x in ((own, half, one), (own, one, half)))
            least = -(budgets[block] + COARSE) / 2
            links, root = np.zeros(len(node), np.int64), np.arange(len(node))
            found_i, found_j, measured = [], [], None

            def fits(i, j):
                part = own[i] - own[j]
                keep = ((part * part).sum(axis=1) <= budgets[block]) & (length[i] == length[j])
                i, j = i[keep], j[keep]
                for b in range(block):
                    part = parts[b][i] - parts[b][j]
                    later = (part * part).sum(axis=1) > budgets[b]
                    i, j = i[later], j[later]
                cosine = np.einsum("ij,ij->i", scaled[i], scaled[j]) / (norm[i] * norm[j])
                return i[cosine >= similar], j[cosine >= similar]

            def measures():
                """(rows, halves, least, sign): where products of rows, less both halves, are more than least, or with a sign
                of -1 less, a pair fits in that respect."""
                blocks = [(p, (p * p).sum(axis=1) / 2, -budgets[b] / 2, 1 if b == block else -1) for b, p in enumerate(parts)]
                return [*blocks, (scaled / norm[:, None], np.zeros(len(norm)), similar, 1)]

            def crowded(these, those, first, measured, against):
                """Which pairs surely fit, and those too close to a limit for products, which are looked at one by one."""
                sure = length[these][:, None] == length[those]
                close = np.zeros(sure.shape, bool)
                for (part, half, least, sign), (to, other) in zip(measured, against):
                    over = part[these] @ to[:, first:]
                    over -= half[these][:, None] + least
                    over -= other[first:]
                    close |= np.abs(over) <= SLACK
                    sure &= over * sign > 0
                return sure & ~close, np.nonzero(close)

            def count(i, j):
                """Links between the vectors at ``i`` and ``j``, of which those that join trees are kept."""
                nonlocal root
                apart = root[i] != root[j]
                found_i.append(i[apart])
                found_j.append(j[apart])
                if sum(map(len, found_i)) > STRIP // 4:
                    root = joined()

            def joined():
                i, j = np.concatenate([np.arange(len(root)), *found_i]), np.concatenate([root, *found_j])
                found_i.clear()
                found_j.clear()
                return _tree(len(root), i, j)

            def one_by_one(i, j):
                for at in range(0, len(i), most):
                    a, b = fits(i[at : at + most], j[at : at + most])
                    np.add.at(links, a, weight[b])
                    np.add.at(links, b, weight[a])
                    count(a, b)

            # Two guests of a cell meet in another.
            who = lambda s, h: np.nonzero((side == s) & (home == h))[0]
            if within:
                homes = who(0, True)
                meet = [(homes, homes), (homes, who(0, False))]
            else:
                meet = [(who(0, True), who(1, True)), (who(0, True), who(1, False)), (who(0, False), who(1, True))]
            for rows, columns in meet:
                from_, to = here[rows], there[columns].T
                strip, against = max(1, STRIP // max(1, len(columns))), None
                for start in range(0, len(rows) if len(columns) else 0, strip):
                    first = start if columns is rows else 0
                    may = from_[start : start + strip] @ to[:, first:] >= least
                    if np.count_nonzero(may) * DENSE < may.size:
                        i, j = np.nonzero(may)
                        i, j = rows[i + start], columns[j + first]
                        one_by_one(*((i[i < j], j[i < j]) if columns is rows else (i, j)))
                        continue
                    measured = measured or measures()
                    against = against or [(part[columns].T, half[columns]) for part, half, _, _ in measured]
                    few = max(1, strip // 4)
                    for at in range(start, min(start + strip, len(rows)), few):
                        these, those = rows[at : min(at + few, start + strip)], columns[first:]
                        sure, (i, j) = crowded(these, those, first, measured, against)
                        i, j = these[i], those[j]
                        if columns is rows:
                            sure &= these[:, None] < those
                            i, j = i[i < j], j[i < j]
                        one_by_one(i, j)
                        links[these] += (sure @ weight[those].astype(float)).astype(np.int64)
                        links[those] += (weight[these].astype(float) @ sure).astype(np.int64)
                        i, j = np.nonzero(sure)
                        count(these[i], those[j])
            root = joined()
            some = np.nonzero(links)[0]
            return {"node": node[some], "root": node[root[some]], "links": links[some]}

        def flush() -> None:
            if held:
                _, block, _, lo, hi = key
                for name, values in work(int(block), lo == hi, {n: np.concatenate([h[n] for h in held]) for n in held[0]}).items():
                    out[name].append(values)
                held.clear()

        def emit() -> dict | None:
            told = {n: np.concatenate(v) for n, v in out.items()} if out["node"] else None
            for values in out.values():
                values.clear()
            return told

        def step(batch: dict) -> dict | None:
            nonlocal key
            keys = np.stack([batch.pop(n).astype(np.int64) for n in by], axis=1)
            cuts = [*(np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1).tolist(), len(keys)]
            for start, end in zip([0, *cuts], cuts):
                now = tuple(keys[start].tolist())
                if now != key:
                    flush()
                    key = now
                held.append({n: v[start:end] for n, v in batch.items()})
            return emit() if sum(map(len, out["node"])) > 20_000 else None

        def finish() -> dict | None:
            flush()
            return emit()

        return step, finish

    from docket.llm.jaccard_join import _tree

    dealt_out = rows.select(*by, "side", "home", "node", "size", "vec").repartition(*by).sortWithinPartitions(*by)
    return over_arrays(dealt_out, size, make, "node long, root long, links long")


def near_vectors(vectors: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors`` (vec_id, embedding, label).

    Two rows are linked when their labels are equal and not null, their vectors have the same length, and the cosine of these
    in double precision is at least ``similar``. ``component_id`` is the smallest vec_id that links reach, nulls passed over;
    ``kept`` marks the rows that hold it, of repeated ids all. A row without a label, or whose vector is null, empty, zero or
    holds null or non-finite numbers, links with nothing. Other columns are not looked at; an empty table gives no rows.

    Equal vectors of a label are one node with their number. Unit vectors at ``similar`` are sqrt(2 - 2 similar) apart at most, so
    one block of a rotation at least keeps them within its share of that squared distance, by its dimensions. Cells of a grid
    over a block's leading dimensions bring those together; crowded cells are compared in pairs of chunks, each a group of
    bounded size. Links are counted where they are found and passed on as one row per vector, so a family of m vectors gives
    rows in proportion to m."""
    spark = vectors.sparkSession
    number = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    vec = F.col("embedding").cast(f"array<{number}>").alias("vec")
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vec)
    rows = stored(named.withColumn("row", F.monotonically_increasing_id()))
    # -0.0 and 0.0 are one number.
    same = usable(rows).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0).cast(number)))
    nodes = stored(same.groupBy("label", "vec").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("first")))
    size = nodes.agg(F.max(F.size("vec"))).first()[0]
    if size is None:
        links = spark.createDataFrame([], "row long, n_links long, component_id long")
    else:
        radius2 = 2 - 2 * similar
        main, dealt = axes(nodes, size)
        cells = stored(placed(nodes, main, dealt, size, radius2))
        key = ["label", "block", "cell"]
        crowd = cells.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("homes")).filter("n > 1 AND homes > 0")
        chunk = max(1, min(CHUNK, NUMBERS // size))
        # Stored columns and exploded rows look smaller to Spark than they are, so these joins are told not to broadcast.
        chunked = cells.join(crowd.select(*key, F.ceil(F.col("n") / chunk).cast("int").alias("chunks")).hint("merge"), key)
        own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
        both = chunked.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        met = both.select(
            *key, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
            (F.col("own") > F.col("other")).cast("int").alias("side"), "home", "node",
        )
        found = stored(linked(met.join(nodes.select("node", "size", "vec").hint("merge"), "node"), main, dealt, size, similar, radius2))
        forget(cells)
        roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        counts = found.groupBy("node").agg(F.sum("links").alias("links"))
        every = nodes.join(roots.hint("merge"), "node", "left").join(counts.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        first = every.groupBy("root").agg(F.min("first").alias("component_id"))
        facts = every.join(first.hint("merge"), "root").select(
            "label", "vec", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id"
        )
        links = same.select("row", "label", "vec").join(facts.hint("merge"), ["label", "vec"]).select("row", "n_links", "component_id")
    alone = F.col("n_links").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.join(links.hint("merge"), "row", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"),
    )


def op12_subspace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all vectors of each label."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


CHECKS = {
    "op12_subspace_join": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda e: e * e))) AS norm
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
sound AS (SELECT * FROM v WHERE norm > 0 AND isfinite(norm) AND len(list_filter(x, lambda e: e IS NULL)) = 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound AS a JOIN sound AS b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.x, b.x) / (a.norm * b.norm) >= {SIMILAR}),
reach AS (SELECT a, b FROM pairs UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
low AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, COALESCE(n.n, 0)::BIGINT AS n_links, LEAST(vec_id, COALESCE(low, vec_id))::BIGINT AS component_id,
  vec_id = LEAST(vec_id, COALESCE(low, vec_id)) AS kept
FROM embeddings LEFT JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id
""",
}
