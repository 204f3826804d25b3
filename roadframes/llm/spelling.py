"""Groups of spelling variants by reduced-alphabet generation.

1. Letter runs of all texts are counted: words of at least ``least_points`` code points that stand
   at least ``least_n`` times. One in ``97`` (document, run) pairs loses a letter first, by a rule.
2. Letters are hashed to ``symbols`` symbols, so a word becomes a reduced word. Words one edit
   apart have reduced words that are equal or one edit apart.
3. Each word makes the full one-edit neighbourhood of its reduced word: itself, every deletion,
   every replacement and every insertion of a symbol, each as a 64-bit hash worked out from sums
   over the word before and after the edit; so a neighbour costs the same however long the word is.
   Two symbols side by side that are equal give one deletion, and an insertion of a symbol after an
   equal one is left out: these are the neighbours made twice.
4. Neighbours are joined with the reduced vocabulary by hash, and pairs of original words are
   verified by edit distance. Hashes that collide cost a verification and nothing else.

Nearly all neighbours of a word are no words. A bit table over the hashes of the reduced
vocabulary, of a fixed size whatever the vocabulary, turns them away before they are shuffled.
The join's keys are reduced words; the rows of a key are words within one reduced edit of it, so no
key grows with the texts. A pair is seen from both sides, so a word's near words meet at the word's own key.

A word's form is its near word of the largest n (ties: the smallest in code-point order), if that is at
least twice the word's own n. So n at least doubles along forms, there are no circles, and chains are short:
roots come from joins that double the distance each time.

Null texts have no words; null ids count as empty text in the rule that drops letters. Repeated rows
count as often as they stand. Texts are read in pieces that end between words, so only one word has to
fit in memory. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadframes.llm.common import bounded_batches, over_batches, texts
from roadframes.llm.process import kept
from roadframes.llm.textscan import CHUNK_BYTES, FOLD, LOWER, POINT, U64, UPPER, Chunk, chunks, mixed
from roadframes.session import materialise

#: One (document, run) pair in so many loses a code point.
DROP = 97
#: Longest word whose checksum comes from tables; distinct words that a task counts before it sends them on.
TABLE_BYTES, MOST_WORDS = 64, 200_000
#: Bits of the table of reduced words, and bits of one row of it as Spark makes them.
FILTER_BITS, ROW_BITS = 27, 1 << 15
#: Symbols of reduced words, and letters that are worked on at a time.
SYMBOLS, LETTERS = 16, 1 << 15
BASE = 0xD6E8FEB86659FD93
BASE_INVERSE = pow(BASE, -1, 2**64)
ASCII = LOWER | UPPER


def _shift_tables() -> np.ndarray:
    """By length, byte place and byte: what becomes of that byte of a CRC-32 when so many bytes follow."""
    if "crc_shift" not in kept():
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
        out = np.zeros((TABLE_BYTES + 1, 4, 256), dtype=np.uint32)
        out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        for n in range(TABLE_BYTES):
            out[n + 1] = (out[n] >> 8) ^ step[out[n] & 0xFF]
        kept()["crc_shift"] = out
    return kept()["crc_shift"]


def crc_joined(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of two byte strings one after the other, from their own; the second has ``size`` <= TABLE_BYTES bytes."""
    t, out = _shift_tables(), second.astype(np.uint32)
    for k in range(4):
        out = out ^ t[size, k, (first >> np.uint32(8 * k)) & np.uint32(0xFF)]
    return out


def _letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters A-Z, a-z and U+00C0 to U+00FF (the lead byte C3 and what follows it)."""
    lead = data == 0xC3
    inside = ASCII[data] | lead
    inside[1:] |= lead[:-1]
    return inside


def _pieces(chunk: Chunk, limit: int) -> Iterator[Chunk]:
    """A chunk of one long text in pieces that end between words; any other chunk whole."""
    if chunk.n > 1 or len(chunk.data) <= limit:
        yield chunk
        return
    start, n = 0, len(chunk.data)
    while start < n:
        stop, reach = min(start + limit, n), start + limit
        while stop < n:  # on to the next byte that is no part of a letter
            reach = min(reach + limit, n)
            outside = np.flatnonzero(~_letters(chunk.data[stop - 1 : reach])[1:])
            if len(outside):
                stop += int(outside[0])
                break
            stop = reach
        yield Chunk(chunk.first, chunk.data[start:stop], np.array([0, stop - start]))
        start = stop


def count_words(chunk: Chunk, prefixes: np.ndarray, least_points: int, words: Counter) -> None:
    """Add the words of a chunk to a counter of their UTF-8 bytes; ``prefixes`` has the CRC-32 of ``<doc_id>:`` by document."""
    if not len(chunk.data):
        return
    inside = _letters(chunk.data)
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[chunk.offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    points = np.concatenate([[0], np.cumsum(POINT[chunk.data])])
    long = points[end] - points[start] >= least_points
    start, end = start[long], end[long]
    if not len(start):
        return
    doc = np.searchsorted(chunk.offsets, start, "right") - 1
    _, first, which = np.unique(chunk.hasher(fold=True)(start, end), return_index=True, return_inverse=True)
    raw = FOLD[chunk.data].tobytes()
    found = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
    size = end - start
    crc = np.array([zlib.crc32(w) for w in found], dtype=np.uint32)[which]
    h = crc_joined(prefixes[doc], crc, np.minimum(size, TABLE_BYTES))
    for k in np.flatnonzero(size > TABLE_BYTES).tolist():
        h[k] = zlib.crc32(found[which[k]], int(prefixes[doc[k]]))
    drop = h % DROP == 0
    for w, n in zip(found, np.bincount(which[~drop], minlength=len(found)).tolist(), strict=True):
        if n:
            words[w] += n
    for k in np.flatnonzero(drop).tolist():
        word = found[which[k]].decode()
        at = int(h[k]) % len(word)
        word = word[:at] + word[at + 1 :]
        if len(word) >= least_points:
            words[word.encode()] += 1


def word_counts(docs: DataFrame, least_points: int = 5) -> DataFrame:
    """``word, n``: parts of the counts, added up within tasks only."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(words), pa.binary()).cast(pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])
            words.clear()
            return batch

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            prefixes = np.array([zlib.crc32(b"%s:" % (b"" if i is None else b"%d" % i)) for i in ids], dtype=np.uint32)
            for chunk in chunks(batch.column("text")):
                for piece in _pieces(chunk, 2 * CHUNK_BYTES):
                    count_words(piece, prefixes[chunk.first : chunk.first + chunk.n], least_points, words)
                    if len(words) >= MOST_WORDS:
                        yield out()
        if words:
            yield out()
        pa.default_memory_pool().release_unused()

    return texts(docs).mapInArrow(run, "word string, n long")


def symbol_of(points: np.ndarray, symbols: int) -> np.ndarray:
    """The symbol of each letter: a multiplicative hash of its code point."""
    return (((points.astype(np.uint64) * U64(0x9E3779B97F4A7C15)) >> U64(32)) % U64(symbols)).astype(np.int64)


class Reduced:
    """Reduced words of some words, one after the other, with the hashes of their neighbours."""

    def __init__(self, words: list[str], symbols: int = SYMBOLS):
        self.size = np.array([len(w) for w in words], dtype=np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.symbols = symbols
        self.symbol = symbol_of(np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4"), symbols)
        self.word = np.repeat(np.arange(len(words)), self.size)
        longest = int(self.size.max(initial=0))
        self.power = np.ones(longest + 1, dtype=U64)
        self.power[1:] = U64(BASE)
        np.cumprod(self.power, out=self.power)
        self.place = np.arange(len(self.symbol)) - self.first[self.word]
        self.term = (self.symbol + 1).astype(U64) * self.power[self.place]
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(self.term, dtype=U64)])
        self.whole = sums[self.first + self.size] - sums[self.first]
        self.before = sums[:-1] - sums[self.first][self.word]

    def keys(self) -> np.ndarray:
        return mixed(self.whole)

    def neighbours(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, key) of every neighbour, each once, some letters at a time."""
        yield np.arange(len(self.size)), mixed(self.whole)
        every = np.arange(self.symbols)
        for a in range(0, len(self.symbol), LETTERS):
            s = slice(a, a + LETTERS)
            own, symbol, before, place = self.word[s], self.symbol[s], self.before[s], self.place[s]
            power, whole = self.power[place], self.whole[own]
            rest = whole - before
            after_equal = np.zeros(len(own), dtype=bool)
            previous = self.symbol[np.maximum(np.arange(a, a + len(own)) - 1, 0)]
            after_equal = (place > 0) & (previous == symbol)
            one = ~after_equal
            yield own[one], mixed((before + (rest - self.term[s]) * U64(BASE_INVERSE))[one])
            change = (every[None, :] - symbol[:, None]).astype(U64) * power[:, None] + whole[:, None]
            other = every[None, :] != symbol[:, None]
            yield np.broadcast_to(own[:, None], other.shape)[other], mixed(change[other])
            added = (every + 1).astype(U64)[None, :] * power[:, None] + (before + rest * U64(BASE))[:, None]
            new = (place == 0)[:, None] | (every[None, :] != previous[:, None])
            yield np.broadcast_to(own[:, None], new.shape)[new], mixed(added[new])
        last = self.symbol[self.first + self.size - 1]  # at the end of each word
        added = (every + 1).astype(U64)[None, :] * self.power[self.size][:, None] + self.whole[:, None]
        new = every[None, :] != last[:, None]
        yield np.broadcast_to(np.arange(len(self.size))[:, None], new.shape)[new], mixed(added[new])


def _batches_of(words: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of words with about so many letters together."""
    a, n = 0, 0
    for k, w in enumerate(words):
        n += len(w)
        if n >= most:
            yield a, k + 1
            a, n = k + 1, 0
    if a < len(words):
        yield a, len(words)


def vocabulary(docs: DataFrame, least_points: int, least_n: int, symbols: int) -> DataFrame:
    """``word, n, key``: the words that count, with the hash of their reduced words."""
    counted = word_counts(docs, least_points).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = Reduced(batch.column("word").to_pylist(), symbols).keys()
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.view(np.int64))], ["word", "n", "key"])

    return over_batches(counted, run, "word string, n long, key long")


def key_table(words: DataFrame) -> np.ndarray:
    """The bit table over the words' keys: 2**FILTER_BITS bits, whatever the number of words."""
    bit = F.shiftrightunsigned("key", 64 - FILTER_BITS) + 1  # Spark numbers bits from 1
    rows = words.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("row")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    table = np.zeros((1 << FILTER_BITS) // 8, dtype=np.uint8)
    for r in rows.toLocalIterator():
        table[(r["row"] - 1) * ROW_BITS // 8 :][: ROW_BITS // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return table


def reduced_neighbours(words: DataFrame, symbols: int) -> DataFrame:
    """``near, near_n, key``: each word at the keys of its neighbours that may be reduced words."""
    spark = words.sparkSession
    table = spark.sparkContext.broadcast(key_table(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            column, n = batch.column("word"), batch.column("n")
            listed = column.to_pylist()
            for a, b in _batches_of(listed, LETTERS):
                for own, keys in Reduced(listed[a:b], symbols).neighbours():
                    bit = keys >> U64(64 - FILTER_BITS)
                    hit = np.flatnonzero(bits[(bit >> U64(3)).astype(np.int64)] >> (bit & U64(7)).astype(np.uint8) & 1)
                    if len(hit):
                        at = pa.array(own[hit] + a)
                        yield pa.RecordBatch.from_arrays(
                            [column.take(at), n.take(at), pa.array(keys[hit].view(np.int64))], ["near", "near_n", "key"])
        pa.default_memory_pool().release_unused()

    bounded_batches(spark)
    return words.select("word", "n").mapInArrow(run, "near string, near_n long, key long")


def _roots(forms: DataFrame, most_rounds: int = 8) -> DataFrame:
    """``word, root`` of the words that have a form: each round doubles how far a word has followed forms."""
    reach = forms.select("word", F.col("form").alias("root"))
    for _ in range(most_rounds):
        ahead = reach.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        joined = reach.join(ahead, "root", "left")
        moved = materialise(joined.select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        reach = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return reach
    raise RuntimeError("n doubles along forms, so 2**8 steps are more than any 64-bit count allows")


def spelling_variants(docs: DataFrame, least_points: int = 5, least_n: int = 3, symbols: int = SYMBOLS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the texts."""
    words = materialise(vocabulary(docs, least_points, least_n, symbols), "words")
    found = words.join(reduced_neighbours(words, symbols), "key", "left")
    near = F.levenshtein("word", "near", 1) == 1
    best = F.min(F.when(near, F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))))
    judged = found.groupBy("key", "word", "n").agg(F.count_if(F.coalesce(near, F.lit(False))).alias("n_near"), best.alias("best"))
    formed = F.col("best.n") * -1 >= 2 * F.col("n")
    judged = materialise(judged.select(
        "word", "n", "n_near", F.when(formed, F.col("best.word")).alias("form"), F.when(formed, -F.col("best.n")).alias("form_n")), "near_words")
    roots = _roots(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
