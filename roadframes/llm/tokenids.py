"""Token ids of whole texts by the tokenizers library, with a cache of their pieces.

A text is cut where both kinds of tokenizer end a pre-token anyway: at a single space
between two visible signs, at a single line break, and between a word of Latin letters and the plain
punctuation that follows it up to the next space or line break. Pieces repeat, so their ids are
kept, found again by a 64-bit hash of the piece (equal but for collisions). Of the
other pieces, those of letters with a tail of punctuation go to the tokenizer's own
model, pre-token by pre-token, and the rest to the whole tokenizer, always many at once,
as one text whose ids are dealt to them by their places. Texts in which spaces or line
breaks meet are encoded whole. The ids are those of encoding each whole text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from roadframes.llm.process import kept
from roadframes.llm.textscan import MIX_B, U64, Chunk, byte_table, chunks, mixed

#: Slots of the cache (a newer piece takes the slot of an older one), ids it holds (then it starts
#: anew), bytes of a piece that enters, and pre-tokens that are encoded together.
SLOT_BITS, POOL, LONGEST, TOGETHER = 20, 1 << 22, 64, 256
SEPARATOR = byte_table(b" \n")
#: First bytes of signs beyond Latin-1: pieces that have one are not folded, for marks may join with a letter.
BEYOND = byte_table(bytes(range(0xC4, 0xF8)))
#: Bytes of letters whose normal form, case and class both tokenizers treat alike (those beyond ASCII, À to ÿ but for × and ÷, have
#: one lead byte), and of a tail of plain punctuation.
PLAIN_LETTER = byte_table(bytes(b for b in [*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)] if b not in (0x97, 0xB7)))
PLAIN_TAIL = byte_table(bytes([*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
KINDS = {"word": "word_bpe_49k.json", "byte": "byte_bpe_50k.json"}


def _byte_signs() -> dict[int, str]:
    """The printable sign that a byte-level tokenizer writes for each byte: visible Latin-1
    signs stand for themselves, the others for signs from 256 on, in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


SIGNS = np.array([ord(sign) for _, sign in sorted(_byte_signs().items())], dtype="<u4")
#: Bytes of plain letters in lower case: the second byte of À to Þ moves as A to Z do.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[0x80:0x9F] += 32


def gathered(source: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The parts of an array that begin at ``start``, one after the other."""
    first = np.cumsum(size) - size
    return source[np.arange(int(size.sum())) + np.repeat(start - first, size)]


def without_tails(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs with those of letters and a tail cut in two: starts, ends, the run that each part is of, which parts are tails, and
    which are letters alone."""
    letters, tails = (np.concatenate([[0], np.cumsum(t[data], dtype=np.int64)]) for t in (PLAIN_LETTER, PLAIN_TAIL))
    middle = start + letters[end] - letters[start]
    plain = middle == end
    # few runs have a tail, so only those that are not letters alone are looked at
    odd = np.flatnonzero(~plain)
    a, m, b = start[odd], middle[odd], end[odd]
    cut = odd[(m > a) & (letters[m] - letters[a] == m - a) & (tails[b] - tails[m] == b - m)]
    parts = np.ones(len(start), dtype=np.int64)
    parts[cut] = 2
    own = np.repeat(np.arange(len(start)), parts)
    tails_at = cut + np.arange(1, len(cut) + 1)
    tail = np.zeros(len(own), dtype=bool)
    tail[tails_at] = True
    start, end, plain = start[own], end[own], plain[own]
    start[tails_at] = end[tails_at - 1] = middle[cut]
    plain[tails_at - 1] = True
    return start, end, own, tail, plain


class _Cache:
    """Ids of pieces by the hash of the piece."""

    def __init__(self):
        self.keys = np.zeros(1 << SLOT_BITS, dtype=U64)
        self.start = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        self.size = np.zeros(1 << SLOT_BITS, dtype=np.int32)
        self.pool, self.used = np.zeros(POOL, dtype=np.uint32), 0

    def add(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        if len(ids) > POOL:
            return
        if self.used + len(ids) > POOL:
            self.keys[:], self.used = 0, 0
        slot = (keys >> U64(64 - SLOT_BITS)).astype(np.int64)
        self.pool[self.used : self.used + len(ids)] = ids
        _, one = np.unique(slot, return_index=True)  # of several new pieces of a slot, one enters
        slot = slot[one]
        self.keys[slot], self.size[slot] = keys[one], size[one]
        self.start[slot] = (self.used + np.cumsum(size) - size)[one]
        self.used += len(ids)


class Encoder:
    """One of the public tokenizers; ``kind`` is "word" (white space dropped) or "byte"."""

    def __init__(self, kind: str, path: str | None = None):
        from tokenizers import Tokenizer, pre_tokenizers

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(KINDS[kind])
        self.kind, self.tokenizer = kind, Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # texts go one by one: a pool of threads would only wait
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        ending = self.tokenizer.model.end_of_word_suffix or ""
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.signs = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)  # of a text, that an id stands for
        for token, number in vocabulary.items():
            self.signs[number] = len(token) - (len(ending) if ending and token.endswith(ending) else 0)
        self.cache = _Cache()

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _plain(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs of plain letters, one after the other, and how many each has. The model gets the pre-tokens in its signs, a
        space after each; as a token stands for so many signs, the places where a run's ids end are found by counting signs."""
        n = end - start
        if self.kind == "word":
            table, before = SIGNS[LOWER], np.zeros(len(n), dtype=np.int64)
        else:  # a space is a part of its word, a line break a pre-token of its own
            table, before = SIGNS, np.select([lead == 32, lead == 10], [1, 2], 0)
        size = before + n + 1
        stop = np.cumsum(size)
        at = stop - size
        text = np.full(int(size.sum()), 32, dtype="<u4")
        text[at[before == 1]], text[at[before == 2]] = SIGNS[32], SIGNS[10]
        text[np.arange(int(n.sum())) + np.repeat(at + before - (np.cumsum(n) - n), n)] = table[gathered(data, start, n)]
        ids, sizes = [], []
        for k in range(0, len(n), TOGETHER):
            some = slice(k, k + TOGETHER)
            words = text[at[some][0] : stop[some][-1]].tobytes().decode("utf-32-le")
            found = np.asarray(self.model.encode_batch_fast([words], add_special_tokens=False)[0].ids, dtype=np.uint32)
            told, ends = np.cumsum(self.signs[found]), np.cumsum(n[some] + (before[some] > 0))
            last = np.searchsorted(told, ends)
            if last[-1] != len(told) - 1 or (told[last] != ends).any():
                raise ValueError("the tokenizer's ids do not add up to the signs of the words")
            ids.append(found)
            sizes.append(np.diff(last, prepend=-1))
        return (np.concatenate(ids), np.concatenate(sizes)) if ids else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _pieces(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, lead: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after the other, and how many each has. A piece begins with its separator, if it has one."""
        ids, size = self._plain(data, start[plain], end[plain], lead[plain])
        if plain.all():
            return ids, size
        odd, signs = np.flatnonzero(~plain), {0: "", 10: "\n", 32: " "}
        rest = [self.whole(signs[v] + data[a:b].tobytes().decode()) for v, a, b in zip(
            lead[odd].tolist(), start[odd].tolist(), end[odd].tolist(), strict=True)]
        sizes, starts = np.zeros((2, len(plain)), dtype=np.int64)
        sizes[plain], sizes[odd] = size, [len(r) for r in rest]
        starts[plain], starts[odd] = np.cumsum(size) - size, len(ids) + np.cumsum(sizes[odd]) - sizes[odd]
        return gathered(np.concatenate([ids, *rest]), starts, sizes), sizes

    def _hashes(self, chunk: Chunk, start: np.ndarray, end: np.ndarray, lead: np.ndarray) -> np.ndarray:
        if self.kind == "byte":  # the separator before a piece is a part of it
            return mixed(chunk.hasher()(start, end) + lead.astype(U64) * U64(MIX_B))
        keys = chunk.hasher(fold=True)(start, end)
        beyond = chunk.totals(BEYOND)
        odd = beyond[end] > beyond[start]
        if odd.any():
            keys[odd] = mixed(chunk.hasher()(start[odd], end[odd]) + U64(MIX_B))
        return keys

    def _chunk(self, chunk: Chunk) -> Iterator[bytes]:
        data, offsets = chunk.data, chunk.offsets
        between = SEPARATOR[data]
        filled = np.flatnonzero(np.diff(offsets))
        uncut = np.zeros(chunk.n, dtype=bool)
        uncut[filled] = between[offsets[filled]] | between[offsets[filled + 1] - 1]
        meet = np.flatnonzero(between[:-1] & between[1:])
        uncut[np.searchsorted(offsets, meet, "right") - 1] = True  # a text that ends with a separator is there already
        runs = chunk.runs(~SEPARATOR)
        cut = ~uncut[runs.doc]
        start, end, doc = runs.start[cut], runs.end[cut], runs.doc[cut]
        lead = np.where(start > offsets[doc], data[start - 1], 0)
        start, end, own, tail, plain = without_tails(data, start, end)
        lead, doc = np.where(tail, 0, lead[own]), doc[own]
        keys = self._hashes(chunk, start, end, lead)
        cache, slot = self.cache, (keys >> U64(64 - SLOT_BITS)).astype(np.int64)
        known = cache.keys[slot] == keys
        size, place = np.where(known, cache.size[slot], 0).astype(np.int64), cache.start[slot]
        new, first, which = np.unique(keys[~known], return_index=True, return_inverse=True)
        at, raw = np.flatnonzero(~known)[first], data.tobytes()
        made, many = self._pieces(data, start[at], end[at], lead[at], plain[at])
        size[~known], place[~known] = many[which], (np.cumsum(many) - many)[which]
        ids = np.empty(int(size.sum()), dtype=np.uint32)
        old = np.repeat(known, size)
        ids[old] = gathered(cache.pool, place[known], size[known])
        ids[~old] = gathered(made, place[~known], size[~known])
        short = end[at] - start[at] <= LONGEST
        cache.add(new[short], gathered(made, (np.cumsum(many) - many)[short], many[short]), many[short])
        out, stops = ids.astype("<u4").tobytes(), np.cumsum(np.bincount(doc, weights=size, minlength=chunk.n).astype(np.int64))
        a = 0
        for d, b in enumerate((4 * stops).tolist()):
            if uncut[d]:
                yield self.whole(raw[offsets[d] : offsets[d + 1]].decode()).astype("<u4").tobytes()
            else:
                yield out[a:b]
            a = b

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit bytes, in their order."""
        for chunk in chunks(texts):
            yield from self._chunk(chunk)

    def encode(self, text: str) -> bytes:
        return next(self.encode_all(pa.array([text], pa.string())))


def encoder(kind: str, path: str | None = None) -> Encoder:
    """The process's encoder: a worker keeps its cache from task to task."""
    key = "encoder", kind, path
    if key not in kept():
        kept()[key] = Encoder(kind, path)
    return kept()[key]
