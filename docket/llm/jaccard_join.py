"""N-gram Jaccard join: MinHash bands propose pairs, a Bayesian test drops most of them early, the rest is verified exactly."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.llm.common import KEY, components, hash_words, ngram_hashes, over_groups, over_texts, plain, row_key, same_row, table, word_hashes
from docket.session import forget, stored

SHINGLE = 5
SIMILAR = 0.8
# 32 bands of 4 values miss a pair at 0.8 with probability (1 - 0.8 ** 4) ** 32 = 5e-8.
BANDS, ROWS = 32, 4
STEP = 16  # MinHash values compared between two tests
TOLERANCE = 1e-7  # a pair is dropped when the posterior chance of reaching the threshold is below
BLOCK = 512  # signatures compared with each other at once
MIXES = 2  # times that bands are dealt into blocks before blocks are paired
VERIFY_SETS, VERIFY_SHINGLES = 512, 250_000  # sets of a block that is verified against another, and about their elements
WORD = re.compile(r"\w+")


def shingles(text: str, cache, n: int = SHINGLE):
    """Sorted distinct hashes of the word n-grams of a whole text, lower-cased; a text of fewer words has one of all its words."""
    import numpy as np

    words = hash_words(WORD.findall(text.lower()), cache)
    return np.unique(ngram_hashes(words, min(n, len(words)))) if len(words) else words


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(row key, node, n, sig, keys) of every row: ``node`` stands for its shingle set, ``n`` is the set's size, ``sig`` the
    MinHash values (16 bits each), ``keys`` one long per band. Without words ``n`` is 0."""
    count = bands * rows

    def make():
        import numpy as np
        import xxhash

        cache = word_hashes()
        random = np.random.default_rng(20)
        a = random.integers(0, 2**32, count, np.uint32) | np.uint32(1)
        b = random.integers(0, 2**32, count, np.uint32)
        weight = random.integers(0, 2**63, (bands, rows), np.uint64) | np.uint64(1)
        seed = random.integers(0, 2**63, bands, np.uint64)

        def work(batch: dict) -> dict:
            nodes, sizes, sigs, keys = [], [], [], []
            with np.errstate(over="ignore"):
                for text in batch["text"]:
                    found = shingles(text, cache, shingle)
                    low = np.full(count, 0xFFFFFFFF, np.uint32)
                    half = (found >> np.uint64(32)).astype(np.uint32)
                    for at in range(0, len(half), 512):
                        np.minimum(low, (half[at : at + 512, None] * a + b).min(axis=0), out=low)
                    sig = low.astype("<u2")
                    band = (sig.reshape(bands, rows).astype(np.uint64) * weight).sum(axis=1) + seed
                    band = (band ^ (band >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                    nodes.append(xxhash.xxh3_64_intdigest(found.tobytes()) - 2**63)
                    sizes.append(len(found))
                    sigs.append(sig.tobytes())
                    keys.append((band ^ (band >> np.uint64(32))).view(np.int64))
            return {k: batch[k] for k in KEY} | {"node": nodes, "n": sizes, "sig": sigs, "keys": keys}

        return work

    keyed = plain(docs).select(*row_key(), "text")
    return over_texts(keyed, make, "doc_id long, h1 long, h2 long, node long, n int, sig binary, keys array<long>")


def needed(count: int, similar: float, tolerance: float) -> int:
    """Fewest matches among ``count`` MinHash values at which the posterior chance (uniform prior) that the similarity reaches
    ``similar`` is at least ``tolerance``: the chance equals that of at most so many successes in count + 1 trials."""
    from math import comb

    total = 0.0
    for m in range(count + 1):
        total += comb(count + 1, m) * similar**m * (1 - similar) ** (count + 1 - m)
        if total >= tolerance:
            return m
    return count


def _tree(size: int, i, j):
    """The smallest member of the own component for each of ``size`` members under pairs (i, j)."""
    import numpy as np

    root = np.arange(size)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _pairs(sides: list[int]):
    """Index pairs to compare: all within one block, or those across two."""
    import numpy as np

    side = np.array(sides)
    if side.max() == 0:
        return np.triu_indices(len(side), 1)
    i, j = np.meshgrid(np.nonzero(side == 0)[0], np.nonzero(side == 1)[0], indexing="ij")
    return i.ravel(), j.ravel()


def blocked(members: DataFrame, blocks: DataFrame, by: list[str]) -> DataFrame:
    """Cut groups into pairs of blocks: (by, lo, hi, side, node). ``blocks`` says into how many blocks a group is dealt by hash;
    each pair of them becomes a group of its own, so a task holds two blocks at most however large the group is, and every pair
    of members meets exactly once."""
    dealt = members.join(blocks.select(*by, "blocks"), by)
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    both = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    return both.select(*by, lo.alias("lo"), hi.alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node")


def unsettled(met: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, root): the rows of those bands that still hold two clusters or more."""
    rooted = met.join(labels, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    open_ = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    return rooted.join(open_, "key")


def mixed(rows: DataFrame, seed: int) -> DataFrame:
    """(key, lo, hi, side, node, root): every band dealt into blocks under ``seed``, each a group of its own."""
    sizes = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64(F.lit(seed), "node"), F.col("blocks")).cast("int")
    return rows.join(sizes, "key").select("key", own.alias("lo"), own.alias("hi"), F.lit(0).alias("side"), "node", "root")


def across(rows: DataFrame) -> DataFrame:
    """(key, lo, hi, side, node, root): blocks in pairs, so that every two members of different clusters meet. A cluster of more
    than a block has blocks of its own, which are not paired with each other; the others share blocks whole."""
    sizes = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
    large = F.col("size") > BLOCK
    pool = sizes.groupBy("key").agg(F.ceil(F.sum(F.when(~large, F.col("size")).otherwise(0)) / BLOCK).cast("int").alias("pool"))
    dealt = rows.join(sizes, ["key", "root"]).join(pool, "key")
    part = F.when(large, F.xxhash64("root", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK)))).otherwise(F.pmod(F.xxhash64("root"), F.col("pool")))
    dealt = stored(dealt.select("key", "node", "root", F.when(large, F.col("root")).alias("whole"), part.alias("part")))
    parts = dealt.groupBy("key", "part").agg(F.first("whole").alias("whole"))
    other = parts.select("key", F.col("part").alias("other"), F.col("whole").alias("theirs"))
    pairs = parts.join(other, "key").filter("NOT coalesce(whole = theirs, false)").select("key", "part", "other")
    lo, hi = F.least("part", "other"), F.greatest("part", "other")
    return dealt.join(pairs, ["key", "part"]).select(
        "key", lo.alias("lo"), hi.alias("hi"), (F.col("part") > F.col("other")).cast("int").alias("side"), "node", "root"
    )


def compared(rows: DataFrame, sets: DataFrame, similar: float, tolerance: float, count: int) -> DataFrame:
    """Edges (a, b) between clusters, one for each pair of a spanning forest per group, of which two members pass the Bayesian
    test. Bands of one family mostly hold the same members: equal groups are compared once."""
    lists = rows.groupBy("key", "lo", "hi").agg(F.sort_array(F.collect_list(F.struct("side", "node", "root"))).alias("members"))
    group = lists.select(F.xxhash64("members").alias("group"), "members").filter("size(members) > 1").dropDuplicates(["group"])
    rowwise = group.select("group", F.inline("members")).join(sets.select("node", "sig"), "node")
    least = {n: needed(n, similar, tolerance) for n in range(STEP, count + 1, STEP)}

    def make():
        import numpy as np

        def work(g: dict) -> dict:
            sig = np.frombuffer(b"".join(g["sig"]), "<u2").reshape(len(g["node"]), count)
            name, root = np.unique(np.array(g["root"], np.int64), return_inverse=True)
            i, j = _pairs(g["side"])
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
            same = np.zeros(len(i), np.int32)
            for n, fewest in least.items():
                part = slice(n - STEP, n)
                same += (sig[i, part] == sig[j, part]).sum(axis=1, dtype=np.int32)
                alive = same >= fewest
                i, j, same = i[alive], j[alive], same[alive]
            low = _tree(len(name), root[i], root[j])
            moved = np.nonzero(low != np.arange(len(low)))[0]
            return {"a": name[moved].tolist(), "b": name[low[moved]].tolist()}

        return work

    return over_groups(rowwise.select("group", "side", "node", "root", "sig"), ["group"], make, "a long, b long")


def candidates(sets: DataFrame, similar: float, tolerance: float, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(node, root): clusters of sets of which every two that share a band and pass the Bayesian test are in one.

    A band's members are first compared within blocks, then, where clusters remain apart, within blocks dealt anew, and at last
    between the clusters that are still apart. A family of any size is one cluster after the first two steps and leaves, so
    rows and edges grow with its members, not with their pairs; no pair that could join two clusters is left out."""
    marked = sets.select("node", F.explode("keys").alias("key"))
    shared = marked.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key")
    met = stored(marked.join(shared, "key").select("key", "node"))
    labels = met.select("node", F.col("node").alias("root")).limit(0)
    for step in range(MIXES + 1):
        open_ = stored(unsettled(met, labels))
        groups = across(open_) if step == MIXES else mixed(open_, step)
        edges = stored(compared(groups, sets, similar, tolerance, bands * rows))
        joined = components(edges)
        # Clusters are named by their smallest member; edges are between clusters, so old names lead to new ones.
        moved = joined.select(F.col("node").alias("root"), F.col("root").alias("new"))
        kept = labels.join(moved, "root", "left").select("node", F.coalesce("new", "root").alias("root"))
        fresh = joined.join(labels.select("node"), "node", "left_anti")
        labels = stored(kept.union(fresh))
        forget(open_, edges, joined)
    forget(met)
    return labels


def verify(docs: DataFrame, sets: DataFrame, clusters: DataFrame, similar: float, shingle: int = SHINGLE) -> DataFrame:
    """(node, root, links) per node and pair of blocks of its cluster: verified similarity of all pairs within the cluster, from
    whole texts. ``links`` counts the documents of the linked sets, ``root`` is the smallest linked set of the block pair."""
    wanted = clusters.join(sets.select("node", "rep"), "node").select("rep.*").dropDuplicates()
    texts = same_row(plain(docs).select(*row_key(), "text"), wanted, "left_semi")

    def make_sets():
        import xxhash

        cache = word_hashes()

        def work(batch: dict) -> dict:
            found = [shingles(t, cache, shingle).tobytes() for t in batch["text"]]
            return {"node": [xxhash.xxh3_64_intdigest(f) - 2**63 for f in found], "found": found}

        return work

    found = over_texts(texts.select("text"), make_sets, "node long, found binary").dropDuplicates(["node"])
    found = stored(found.join(sets.select("node", "size"), "node"))
    held = clusters.join(sets.select("node", "n"), "node").groupBy("root").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("elements"))
    blocks = F.ceil(F.greatest(F.col("sets") / VERIFY_SETS, F.col("elements") / VERIFY_SHINGLES)).cast("int")
    rowwise = blocked(clusters.select("root", "node"), held.select("root", blocks.alias("blocks")), ["root"]).join(found, "node")

    def make():
        import numpy as np

        def work(g: dict) -> dict:
            count = len(g["node"])
            each = [np.frombuffer(f, np.uint64) for f in g["found"]]
            n = np.array([len(e) for e in each])
            values, place, times = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
            column = np.cumsum(times > 1) - 1
            use = times[place] > 1
            owner, column = np.repeat(np.arange(count), n)[use], column[place[use]]
            order = np.argsort(column, kind="stable")
            owner, column = owner[order], column[order]
            common = np.zeros((count, count), np.float64)
            last = int(column[-1]) + 1 if len(column) else 0
            for at in range(0, last, 4096):
                part = slice(*np.searchsorted(column, [at, at + 4096]))
                shown = np.zeros((count, min(4096, last - at)), np.float32)
                shown[owner[part], column[part] - at] = 1
                common += shown @ shown.T
            i, j = _pairs(g["side"])
            both = common[i, j]
            linked = both >= similar * (n[i] + n[j] - both) - 1e-9
            i, j = i[linked], j[linked]
            size = np.array(g["size"], np.int64)
            links = np.zeros(count, np.int64)
            np.add.at(links, i, size[j])
            np.add.at(links, j, size[i])
            some = np.nonzero(links)[0]
            node, root = np.array(g["node"], np.int64), _tree(count, i, j)
            return {"node": node[some].tolist(), "root": node[root[some]].tolist(), "links": links[some].tolist()}

        return work

    columns = ["root", "lo", "hi", "side", "node", "found", "size"]
    return over_groups(rowwise.select(*columns), ["root", "lo", "hi"], make, "node long, root long, links long")


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, tolerance: float = TOLERANCE, shingle: int = SHINGLE) -> DataFrame:
    """(row key, class_id, n_links, n_shingles, stays), one row per row of ``docs``.

    Two rows are linked when the Jaccard similarity of their sets of word shingles is at least ``similar``; ``n_links`` counts a
    row's links, to rows with the same set as well. ``class_id`` is the smallest id among the rows that links connect (null ids
    come first), and ``stays`` marks one row of each class, that with the smallest key. A null, empty or wordless text has no
    shingles, no links and a class of its own; repeated rows are linked to each other, and all of them stay if one does. Other
    columns are ignored; an empty table gives no rows.

    Rows with equal sets are one node, so copies cost nothing. Nodes that share a band are compared block by block until their
    clusters are settled; within each cluster all pairs of blocks are verified from whole texts. Links are counted where they are
    found, so a family of m texts gives m rows per block, not m squared."""
    prints = stored(fingerprints(docs, shingle))
    sets = stored(
        prints.filter("n > 0").groupBy("node").agg(
            F.min(F.struct(*KEY)).alias("rep"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("keys").alias("keys")
        )
    )
    clusters = candidates(sets, similar, tolerance)
    checked = stored(verify(docs, sets, clusters, similar, shingle))
    linked = components(checked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    known = sets.select("node", "rep", "size").join(linked, "node", "left").join(links, "node", "left")
    known = stored(known.withColumn("root", F.coalesce("root", "node")))
    first = known.groupBy("root").agg(F.min("rep").alias("first"))
    facts = known.join(first, "root").select("node", "first", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"))
    own = F.struct(*KEY)
    out = prints.select(*KEY, "node", "n").join(facts, "node", "left")
    empty = F.col("n") == 0
    return out.select(
        *KEY,
        F.when(empty, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.when(empty, 0).otherwise(F.col("links")).cast("long").alias("n_links"),
        F.col("n").alias("n_shingles"),
        (empty | own.eqNullSafe(F.col("first"))).alias("stays"),
    )


def one_of_each(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``docs`` with all columns, without the rows that do not stay. Rows without words, null and empty ones too, all stay, and so
    do the repetitions of a row that stays; an empty table stays empty."""
    gone = near_duplicates(docs, similar).filter("NOT stays").select(*KEY).dropDuplicates()
    whole = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    return same_row(whole.select("row", *row_key()), gone, "left_anti").select("row.*")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents: class and number of links of each."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_shingles", "stays")
