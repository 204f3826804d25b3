"""Near-duplicate documents: hash minima, banding, verification, connected components.

1. A text's words are lower-cased (A-Z) and hashed; its set is the distinct shingles of
   ``width`` words (a shorter text is one shingle). ``bands`` x ``rows`` universal hash
   functions give its minima, and each band of minima one key.
2. Documents with equal sets are one class, stood for by its smallest id. Where an id stands for
   several classes, as it has several texts, all but one of them get numbers of their own.
3. Classes that share a band key are a bucket. Buckets with the same members count once.
   A bucket's members are compared with its pivot first: linear in the bucket's size.
4. Links are confirmed: the share of equal minima rules out pairs far below the limit,
   then the full sets of shingles are compared, exactly as integers.
5. Where a bucket's members fall into several components, every member outside the
   largest is compared with all members of the bucket, in pairs of tiles that give a
   spanning forest of their links. Members of one component need no comparison, so
   no link between different components is lost, and no bucket is cut or gathered whole.
6. Components come from alternating large-star and small-star.

Null and empty texts have no set and are linked with nothing. Different texts of one id are
documents of their own: each is linked by its own set, and one text of a component is kept. A
component is named by the id of its class with the smallest number. A null id is returned with
its own counts. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadframes.llm.common import bounded_batches, over_batches, texts
from roadframes.llm.components import components
from roadframes.llm.embedding_dedup import Forest
from roadframes.llm.textscan import MIX_A, NOT_SPACE, U64, Chunk, chunks, mixed
from roadframes.session import materialise

WIDTH, BANDS, ROWS = 5, 20, 4
#: Pairs whose share of equal minima is this far below the limit are ruled out: six deviations of
#: the estimate from 80 minima at a similarity of 0.8.
MARGIN = 0.27
#: Members of a tile, and seed of the universal hash functions.
TILE, SEED = 256, 20261


def universal(n: int) -> np.ndarray:
    """Four odd 32-bit numbers for each of ``n`` hash functions."""
    return np.random.default_rng(SEED).integers(0, 2**31, (n, 4), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(chunk: Chunk, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, document after document, and the offsets of the documents."""
    words = chunk.runs(NOT_SPACE)
    h = chunk.hasher(fold=True)(words.start, words.end)
    n = np.bincount(words.doc, minlength=chunk.n)
    first = np.concatenate([[0], np.cumsum(n)])
    if len(h) >= width:
        key = h[: len(h) - width + 1].copy()
        for k in range(1, width):
            key = mixed(key + h[k : len(h) - width + 1 + k])
        at = np.flatnonzero(words.doc[width - 1 :] == words.doc[: len(h) - width + 1])
        key, doc = key[at], words.doc[at]
    else:
        key, doc = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        whole = []
        for d in short:
            x = U64(n[d])
            for v in h[first[d] : first[d + 1]]:
                x = mixed(np.array([x]) + v)[0]
            whole.append(x)
        key, doc = np.concatenate([key, np.array(whole, dtype=U64)]), np.concatenate([doc, short])
    out, sizes = [], np.zeros(chunk.n, dtype=np.int64)
    order = np.argsort(doc, kind="stable")
    key, bounds = key[order], np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=chunk.n))])
    for d in range(chunk.n):
        own = np.unique(key[bounds[d] : bounds[d + 1]])
        sizes[d] = len(own)
        out.append(own)
    return (np.concatenate(out) if out else key), np.concatenate([[0], np.cumsum(sizes)])


def minima(sets: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """The minima of each non-empty set under ``n`` hash functions; zeros for empty sets."""
    filled = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, n), dtype=np.uint32)
    if not len(filled):
        return out
    # a low + b high + c mod 2**32 of the halves of a shingle's hash, then a finish; 32 bits are vectorised
    low, high = sets.astype(np.uint32), (sets >> U64(32)).astype(np.uint32)
    value, other = np.empty_like(low), np.empty_like(low)
    for k, (a, b, c, d) in enumerate(universal(n)):
        np.multiply(low, a, out=value)
        np.multiply(high, b, out=other)
        value += other
        value += c
        np.right_shift(value, np.uint32(15), out=other)
        value ^= other
        value *= d
        out[filled, k] = np.minimum.reduceat(value, bounds[:-1][filled])
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of a signature."""
    parts = signature.reshape(len(signature), bands, -1).astype(U64)
    key = np.broadcast_to(np.arange(bands, dtype=U64) * U64(MIX_A), parts.shape[:2])
    for k in range(parts.shape[2]):
        key = mixed(key + parts[:, :, k])
    return key


def keyed_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text, text_key``: the key tells the texts of one id apart."""
    return texts(docs).withColumn("text_key", F.xxhash64("text"))


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, text_key, n_shingles``, a digest of the set, its minima as bytes, and its band keys."""

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, digests, minis, keys = [], [], [], []
        for chunk in chunks(batch.column("text")):
            sets, bounds = shingle_sets(chunk, width)
            size = np.diff(bounds)
            filled = np.flatnonzero(size)
            digest = np.zeros((chunk.n, 2), dtype=U64)
            if len(filled):
                digest[filled, 0] = np.add.reduceat(mixed(sets), bounds[:-1][filled])
                digest[filled, 1] = np.add.reduceat(mixed(sets ^ U64(MIX_A)), bounds[:-1][filled])
            mini = minima(sets, bounds, bands * rows)
            sizes.append(size)
            digests += [d.tobytes() if n else None for d, n in zip(digest, size, strict=True)]
            minis += [m.astype("<u4").tobytes() for m in mini]
            keys.append(band_keys(mini, bands).view(np.int64))
        flat = np.concatenate(keys)
        lists = pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * bands, pa.array(flat.ravel()))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(np.concatenate(sizes)),
             pa.array(digests, pa.binary()), pa.array(minis, pa.binary()), lists],
            ["doc_id", "text_key", "n_shingles", "digest", "minima", "bands"])

    return over_batches(keyed_texts(docs), sign, "doc_id long, text_key long, n_shingles long, digest binary, "
                                                 "minima binary, bands array<long>")


class Sets:
    """The sets of some texts, made when first asked for."""

    def __init__(self, column: pa.Array, width: int):
        self.column, self.width = column, width
        self.made: dict[int, np.ndarray] = {}

    def __getitem__(self, i: int) -> np.ndarray:
        if i not in self.made:
            chunk = next(chunks(self.column.slice(i, 1)))
            self.made[i] = shingle_sets(chunk, self.width)[0]
        return self.made[i]


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 x intersection >= percent x union, in integers."""
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return 100 * both >= percent * (len(a) + len(b) - both)


def _minima_of(column: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(-1, n)


def _confirm(percent: int, width: int, n: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        same = (_minima_of(batch.column("minima"), n) == _minima_of(batch.column("pivot_minima"), n)).mean(axis=1)
        maybe = np.flatnonzero(same >= percent / 100 - MARGIN)
        u, v = batch.column("u").to_numpy(), batch.column("v").to_numpy()
        own, pivots, made = Sets(batch.column("text"), width), Sets(batch.column("pivot_text"), width), {}
        links = []
        for i in maybe:
            if v[i] not in made:  # rows come in no order, but few pivots have most of them
                if len(made) > 64:
                    made.clear()
                made[v[i]] = pivots[i]
                pivots.made.clear()
            if alike(own[i], made[v[i]], percent):
                links.append(i)
            own.made.clear()
        return pa.RecordBatch.from_arrays([pa.array(u[links], pa.int64()), pa.array(v[links], pa.int64())], ["u", "v"])

    return run


def _tile_links(percent: int, width: int, n: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, comp, role = (group.column(c).to_numpy() for c in ("node", "component", "role"))
        mini, sets = _minima_of(group.column("minima").combine_chunks(), n), Sets(group.column("text").combine_chunks(), width)
        forest, first, edges = Forest(len(ids)), {}, []
        for i, c in enumerate(comp.tolist()):
            forest.join(first.setdefault(c, i), i)
        left, right = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        for i in left.tolist():
            same = (mini[right] == mini[i]).mean(axis=1)
            near = right[same >= percent / 100 - MARGIN]
            for j in near[np.argsort(-same[same >= percent / 100 - MARGIN], kind="stable")].tolist():
                if ids[i] != ids[j] and forest.root(i) != forest.root(j) and alike(sets[i], sets[j], percent):
                    forest.join(i, j)
                    edges.append((ids[i], ids[j]))
        return pa.table({"u": pa.array([e[0] for e in edges], pa.int64()), "v": pa.array([e[1] for e in edges], pa.int64())})

    return run


def _buckets(classes: DataFrame) -> DataFrame:
    """``bucket, pivot, node`` for the members of buckets of two or more, one bucket for each set of members."""
    banded = classes.select("node", F.explode("bands").alias("key"))
    kept = banded.groupBy("key").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark"),
        F.min("node").alias("pivot")).where("n > 1")
    kept = kept.groupBy("n", "mark", "pivot").agg(F.min("key").alias("key")).select("key", "pivot")
    return materialise(banded.join(kept, "key").select(F.col("key").alias("bucket"), "pivot", "node"), "buckets")


def _open_buckets(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """``bucket, node, component, outside`` of buckets whose members are in several components;
    outside: not in the bucket's largest one."""
    named = buckets.select("bucket", "node").join(labels, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    sizes = named.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("bucket").agg(
        F.max(F.struct("n", "component"))["component"].alias("main"), F.count("*").alias("parts")).where("parts > 1")
    return named.join(largest, "bucket").select(
        "bucket", "node", "component", (F.col("component") != F.col("main")).alias("outside"))


def _tiled(open_buckets: DataFrame, tile: int = TILE) -> DataFrame:
    """Members dealt to pairs of tiles: tiles of the outsiders (role 0) against tiles of all members (role 1)."""
    sizes = open_buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.col("outside").cast("int")).alias("m"))
    rows = open_buckets.join(sizes, "bucket").withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")).withColumn(
        "strips", F.ceil(F.col("m") / tile).cast("int"))
    at = F.xxhash64("node")
    everyone = rows.select("bucket", "node", "component", F.lit(1).alias("role"), F.pmod(at, "tiles").alias("tile"),
                           F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("strip"))
    outside = rows.where("outside").select(
        "bucket", "node", "component", F.lit(0).alias("role"),
        F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.pmod(at, "strips").alias("strip"))
    return everyone.unionByName(outside.select(everyone.columns))


def _classes(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, digest, rep, rep_key, minima, bands`` of every set, and ``node, rep`` of the sets
    whose number is not the id of the text that stands for them."""
    least = materialise(
        signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(
            F.min(F.struct("doc_id", "text_key")).alias("r")).select(
            "digest", F.col("r.doc_id").alias("rep"), F.col("r.text_key").alias("rep_key")), "least")
    shared = materialise(
        least.groupBy("rep").agg(F.min("digest").alias("main"), F.count("*").alias("n")).where("n > 1").drop("n"), "shared")
    own = F.lit(2**62) + F.shiftrightunsigned(F.xxhash64("digest"), 2)
    named = least.join(shared, "rep", "left").withColumn(
        "node", F.when(F.coalesce(F.col("main") == F.col("digest"), F.lit(True)), F.col("rep")).otherwise(own)).drop("main")
    bodies = signed.select("digest", F.col("doc_id").alias("rep"), F.col("text_key").alias("rep_key"), "minima", "bands")
    classes = materialise(
        named.join(bodies, ["digest", "rep", "rep_key"]).dropDuplicates(["digest"]), "classes")
    extra = materialise(classes.where("node <> rep").select("node", "rep"), "extra")
    return classes, extra


def minhash_dedup(docs: DataFrame, percent: int = 80, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    return near_copies(docs, percent, width, bands, rows).drop("text_key")


def near_copies(docs: DataFrame, percent: int = 80, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id, kept`` for every row of ``docs``; the key is that of ``keyed_texts``."""
    bounded_batches(docs.sparkSession)
    n = bands * rows
    signed = materialise(signatures(docs, width, bands, rows), "signatures")
    classes, extra = _classes(signed)
    buckets = _buckets(classes)
    members = buckets.select("node").distinct()
    # a class's text is the one whose digest it has, by its key, as an id may stand on several rows
    wanted = classes.select("node", F.col("rep").alias("doc_id"), F.col("rep_key").alias("text_key"), "minima").join(
        members, "node", "leftsemi")
    bodies = materialise(
        keyed_texts(docs).join(wanted, ["doc_id", "text_key"]).dropDuplicates(["node"]).select(
            "node", "text", "minima"), "bodies")
    pivots = bodies.select(
        F.col("node").alias("v"), F.col("text").alias("pivot_text"), F.col("minima").alias("pivot_minima"))
    pairs = buckets.where("node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct()
    joined = pairs.join(bodies.withColumnRenamed("node", "u"), "u").join(pivots, "v")
    links = materialise(over_batches(joined, _confirm(percent, width, n), "u long, v long"), "links")
    labels = materialise(components(links), "labels")
    tiled = materialise(_tiled(materialise(_open_buckets(buckets, labels), "open_buckets")), "tiles")
    bounded = tiled.join(bodies, "node").groupBy("bucket", "tile", "strip").applyInArrow(
        _tile_links(percent, width, n), "u long, v long")
    more = materialise(bounded, "more_links")
    same = classes.select("node", "digest", "rep", "rep_key")
    parts = components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))
    named = same.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # a component is named by the smallest id in it; a set whose number is no id may have a smaller id than the smallest number
    others = extra.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")).groupBy("component").agg(
        F.min(F.struct("rep", "node")).alias("other"), F.max(F.col("node") == F.col("component")).alias("no_id"))
    smallest = F.struct(F.col("component").alias("rep"), F.col("component").alias("node"))
    name = F.when(F.col("no_id"), F.col("other")).otherwise(F.least(smallest, F.coalesce("other", smallest)))
    named = named.join(others, "component", "left").withColumn("name", name).select(
        "digest", "rep", "rep_key", F.col("name.rep").alias("component_id"), (F.col("node") == F.col("name.node")).alias("lead"))
    out = signed.select("doc_id", "text_key", "n_shingles", "digest").join(named, "digest", "left")
    first = F.col("lead") & (F.col("doc_id") == F.col("rep")) & (F.col("text_key") == F.col("rep_key"))
    return out.select(
        "doc_id", "text_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.when(F.col("digest").isNull(), F.col("doc_id").isNotNull()).otherwise(first), F.lit(False)).alias("kept"))
