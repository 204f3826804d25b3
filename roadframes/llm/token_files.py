"""Token ids in grammar-compressed shards with random access.

Documents are dealt to ranges of ascending id. In each range, runs of documents with
up to ``block_tokens`` ids form a block, compressed by Re-Pair: the most frequent pairs
of neighbouring symbols are replaced by new symbols, again and again, until no pair is
frequent enough. A pair never crosses the end of a document, so each document has its
own run of symbols and can be decoded alone.

A dataset is a folder of Parquet files that Spark's committer writes, so a lost executor
leaves no half block. A row is a block: ``shard``, ``block`` (numbers in id order),
``doc_ids`` (little-endian int64), ``symbol_ends`` (int64: end of each document's symbols),
``token_ends`` (int64: end of each document's ids), ``base`` (ids below it are tokens),
``rules`` (pairs of uint32; rule k makes symbol base + k), ``lengths`` (uint32: ids that
each rule expands to) and ``symbols`` (uint32).

Null texts are empty; an empty text has the end id alone. Null ids come first. Repeated
rows are kept, those of one id ordered by text. An empty table gives an empty dataset.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadframes.llm.common import bounded_batches, over_batches, texts
from roadframes.llm.tokenids import encoder, gathered

BLOCK = ("shard int, block int, doc_ids binary, symbol_ends binary, token_ends binary, base long, rules binary, "
         "lengths binary, symbols binary, n_tokens long")
#: No pair is formed with this symbol: it marks the end of a document while pairs are sought.
WALL = np.uint32(0xFFFFFFFF)
#: Slots in which pairs are first counted, and an odd number that spreads pairs over them.
SLOT_BITS, SLOT_MIX = 20, np.uint64(0x9E3779B97F4A7C15)


def repair(symbols: np.ndarray, base: int, least: int = 16, per_round: int = 1 << 14):
    """Re-Pair over a sequence with walls: the rules (n x 2) and the shorter sequence.

    A round counts all neighbouring pairs and takes the most frequent ones, ``per_round`` at a
    time; rounds go on until no pair is seen ``least`` times. Where chosen pairs overlap, the
    more frequent one has the place, and the left one among equals. A round replaces the first pair somewhere, so the
    sequence gets shorter and the rounds end.
    """
    rules: list[np.ndarray] = []
    made, some = base, None  # some: the places at which a frequent pair may stand, None for all
    which = np.full(1 << SLOT_BITS, -1, dtype=np.int32)
    while len(symbols) >= 2:
        if some is None:
            left, right = symbols[:-1], symbols[1:]
        else:
            left, right = symbols[some], symbols[some + 1]
        pair = left.astype(np.uint64)
        pair <<= np.uint64(32)
        pair |= right
        # a pair is seen no more often than all pairs of its slot: only those of full slots are sorted
        mixed = pair * SLOT_MIX
        mixed >>= np.uint64(64 - SLOT_BITS)
        slot = mixed.view(np.int64)
        fine = (np.bincount(slot, minlength=1 << SLOT_BITS) >= least)[slot]
        fine &= left != WALL
        fine &= right != WALL
        ordered = np.sort(pair[fine])
        if not len(ordered):
            break
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        n = np.diff(np.concatenate([edge, [len(ordered)]]))
        often = np.flatnonzero(n >= least)
        if not len(often):
            break
        all_taken = len(often) <= per_round
        often = often[np.argsort(-n[often], kind="stable")][:per_round]
        chosen = ordered[edge[often]]
        at, rank = _places(pair, slot, chosen, which)
        if some is not None:
            at = some[at]
        # of neighbouring places the better rank wins; a run of equal ranks is taken from the left
        taken = _disjoint(at, rank)
        hit, at, rank = at, at[taken], rank[taken]
        used = np.flatnonzero(np.bincount(rank, minlength=len(often)))
        number = np.zeros(len(often), dtype=np.uint32)
        number[used] = np.arange(made, made + len(used))
        rules.append(np.stack([chosen[used] >> np.uint64(32), chosen[used] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        symbols = symbols.copy()
        symbols[at] = number[rank]
        made += len(used)
        stays = np.ones(len(symbols), dtype=bool)
        stays[at + 1] = False
        some = None
        if all_taken:
            # a pair that was not chosen was rare and stays so: a frequent one has a new symbol or lost its place to another
            maybe = np.zeros(len(symbols), dtype=bool)
            maybe[hit] = True
            maybe[at[at > 0] - 1] = True
            some = np.flatnonzero(maybe[stays])
        symbols = symbols[stays]
        if some is not None:
            some = some[some < len(symbols) - 1]
    return (np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.uint32)), symbols


def _places(pair: np.ndarray, slot: np.ndarray, chosen: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the chosen pairs, and the rank of the pair at each; ``which`` is a table of -1 for each slot, and is left so.

    A slot holds one chosen pair, and the others of a slot are looked up in sorted order."""
    own = (chosen * SLOT_MIX >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    which[own] = np.arange(len(chosen), dtype=np.int32)
    rank = which[slot]
    at = np.flatnonzero(rank >= 0)
    rank, here = rank[at], pair[at]
    hit = chosen[rank] == here
    others = np.flatnonzero(which[own] != np.arange(len(chosen)))
    if len(others):
        others = others[np.argsort(chosen[others])]
        missed = np.flatnonzero(~hit)
        place = np.minimum(np.searchsorted(chosen[others], here[missed]), len(others) - 1)
        found = chosen[others][place] == here[missed]
        rank[missed[found]], hit[missed[found]] = others[place[found]], True
    which[own] = -1
    return at[hit], rank[hit]


def _disjoint(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of which no two are neighbours: in turn, those better than both neighbours, the left
    one among equals, until nothing is left beside a taken one."""
    taken = np.zeros(len(at), dtype=bool)
    same = np.zeros(len(at), dtype=bool)
    same[1:] = (at[1:] - at[:-1] == 1) & (rank[1:] == rank[:-1])
    alone = ~same
    # in a run of equal ranks every second place is alive, counted from the left
    for_run = np.flatnonzero(same)
    if len(for_run):
        place = np.flatnonzero(alone)
        alone[for_run] = (for_run - place[np.searchsorted(place, for_run) - 1]) % 2 == 0
    alive = np.flatnonzero(alone)
    while len(alive):
        a, r = at[alive], rank[alive]
        beside = a[1:] - a[:-1] == 1
        better = r[1:] < r[:-1]
        best = np.ones(len(alive), dtype=bool)
        best[1:] = ~beside | better
        best[:-1] &= ~(beside & better)
        if not best.any():
            break
        taken[alive[best]] = True
        rest = ~best
        rest[1:] &= ~(best[:-1] & beside)
        rest[:-1] &= ~(best[1:] & beside)
        alive = alive[rest]
    return taken


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule expands to."""
    out = np.zeros(len(rules), dtype=np.uint32)
    for k, (a, b) in enumerate(rules.tolist()):
        out[k] = (out[a - base] if a >= base else 1) + (out[b - base] if b >= base else 1)
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The ids behind some symbols: all rules of a level are opened at once."""
    while True:
        is_rule = symbols >= base
        if not is_rule.any():
            return symbols
        size = 1 + is_rule
        at = np.cumsum(size) - size
        out = np.empty(int(size.sum()), dtype=np.uint32)
        out[at] = symbols
        rule = symbols[is_rule].astype(np.int64) - base
        out[at[is_rule]], out[at[is_rule] + 1] = rules[rule, 0], rules[rule, 1]
        symbols = out


def expand_all(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The ids behind all symbols of a block: every rule is opened once, then copied to its places."""
    opened = expand(rules.ravel(), rules, lengths, base)
    source = np.concatenate([opened, np.arange(base, dtype=np.uint32)])
    start = np.concatenate([np.arange(base) + len(opened), np.cumsum(lengths, dtype=np.int64) - lengths])[symbols]
    size = np.concatenate([np.ones(base, dtype=np.int64), lengths])[symbols]
    return gathered(source, start, size)


def read_document(block: dict, at: int) -> np.ndarray:
    """Ids of one document of a block, without expanding the others."""
    ends = np.frombuffer(block["symbol_ends"], dtype="<i8")
    rules = np.frombuffer(block["rules"], dtype="<u4").reshape(-1, 2)
    own = np.frombuffer(block["symbols"], dtype="<u4")[ends[at - 1] if at else 0 : ends[at]]
    return expand(own, rules, np.frombuffer(block["lengths"], dtype="<u4"), block["base"])


def token_at(block: dict, at: int, place: int) -> int:
    """The id at a place of a document: expansion lengths lead down one path of the grammar."""
    ends = np.frombuffer(block["symbol_ends"], dtype="<i8")
    rules = np.frombuffer(block["rules"], dtype="<u4").reshape(-1, 2)
    lengths, base = np.frombuffer(block["lengths"], dtype="<u4"), block["base"]
    own = np.frombuffer(block["symbols"], dtype="<u4")[ends[at - 1] if at else 0 : ends[at]].astype(np.int64)
    size = np.ones(len(own), dtype=np.int64)
    size[own >= base] = lengths[own[own >= base] - base]
    stops = np.cumsum(size)
    k = int(np.searchsorted(stops, place, "right"))
    symbol, place = int(own[k]), place - int(stops[k] - size[k])
    while symbol >= base:
        a, b = (int(x) for x in rules[symbol - base])
        n = int(lengths[a - base]) if a >= base else 1
        symbol, place = (a, place) if place < n else (b, place - n)
    return symbol


def _block(shard: int, number: int, doc_ids: list, ids: list[bytes], base: int) -> dict:
    sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
    ends = np.cumsum(sizes)
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    walled = np.insert(flat, ends, WALL)
    rules, symbols = repair(walled, base)
    walls = np.flatnonzero(symbols == WALL)
    missing = np.iinfo(np.int64).min
    return {
        "shard": shard, "block": number,
        "doc_ids": np.array([missing if d is None else d for d in doc_ids], dtype="<i8").tobytes(),
        "symbol_ends": (walls - np.arange(len(walls))).astype("<i8").tobytes(), "token_ends": ends.astype("<i8").tobytes(),
        "base": base, "rules": rules.astype("<u4").tobytes(), "lengths": rule_lengths(rules, base).astype("<u4").tobytes(),
        "symbols": symbols[symbols != WALL].astype("<u4").tobytes(), "n_tokens": int(ends[-1])}


def token_blocks(docs: DataFrame, kind: str = "word", path: str | None = None, end_id: int = 2, base: int = 1 << 17,
                 block_tokens: int = 1 << 21, shard_bytes: int = 24 << 20) -> DataFrame:
    """The blocks of the documents, in ranges of ascending id."""
    from pyspark import TaskContext

    spark = docs.sparkSession
    bounded_batches(spark)
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    end = np.array([end_id], dtype="<u4").tobytes()

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, rows, ids, n = TaskContext.get().partitionId(), 0, [], [], 0
        tokens = encoder(kind, path)
        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), *(
            (c, pa.binary()) for c in ("doc_ids", "symbol_ends", "token_ends")), ("base", pa.int64()), *(
            (c, pa.binary()) for c in ("rules", "lengths", "symbols")), ("n_tokens", pa.int64())])
        for batch in batches:
            encoded = tokens.encode_all(batch.column("text"))
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                rows.append(doc_id)
                ids.append(own + end)
                n += len(ids[-1]) // 4
                if n >= block_tokens:
                    yield pa.RecordBatch.from_pylist([_block(shard, number, rows, ids, base)], schema=schema)
                    number, rows, ids, n = number + 1, [], [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([_block(shard, number, rows, ids, base)], schema=schema)
        pa.default_memory_pool().release_unused()

    ranged = texts(docs).repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    return ranged.mapInArrow(compress, BLOCK)


def write_token_files(docs: DataFrame, path: str, **options) -> None:
    token_blocks(docs, **options).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files.

    ``start`` adds the ids of earlier shards, earlier blocks of the shard and earlier
    documents of the block. The sums over shards have one row for each shard.
    """
    blocks = spark.read.schema(BLOCK).parquet(path)
    sums = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    inside = blocks.select("shard", "block", (F.sum("n_tokens").over(
        Window.partitionBy("shard").orderBy("block")) - F.col("n_tokens")).alias("inside"))
    starts = inside.join(before, "shard").select("shard", "block", (F.col("inside") + F.col("before")).alias("block_start"))

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = {"doc_id": [], "place": [], "n_tokens": [], "ids_crc32": []}
        shard, block = [], []
        for row in batch.to_pylist():
            rules = np.frombuffer(row["rules"], dtype="<u4").reshape(-1, 2)
            lengths = np.frombuffer(row["lengths"], dtype="<u4")
            symbols = np.frombuffer(row["symbols"], dtype="<u4")
            ids = expand_all(symbols, rules, lengths, row["base"]).astype("<u4").tobytes()
            ends = np.frombuffer(row["token_ends"], dtype="<i8")
            first = np.concatenate([[0], ends[:-1]])
            out["doc_id"] += np.frombuffer(row["doc_ids"], dtype="<i8").tolist()
            out["place"] += first.tolist()
            out["n_tokens"] += (ends - first).tolist()
            out["ids_crc32"] += [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
            shard += [row["shard"]] * len(ends)
            block += [row["block"]] * len(ends)
        return pa.RecordBatch.from_pydict({
            "shard": pa.array(shard, pa.int32()), "block": pa.array(block, pa.int32()),
            **{k: pa.array(v, pa.int64()) for k, v in out.items()}})

    bounded_batches(spark)
    decoded = over_batches(
        blocks, digest, "shard int, block int, doc_id long, place long, n_tokens long, ids_crc32 long")
    missing = F.lit(int(np.iinfo(np.int64).min))
    return decoded.join(starts, ["shard", "block"]).select(
        F.nullif("doc_id", missing).alias("doc_id"), (F.col("place") + F.col("block_start")).alias("start"),
        "n_tokens", "ids_crc32")
