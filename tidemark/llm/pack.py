"""Lexical retrieval packing: a sharded BM25 index returns unused neighbours of each seed document, which fill its window.

Documents are dealt to shards by content: a document's key is that of its terms which is first in a random order weighted
by idf, so two documents have the same key with a probability that is their idf-weighted Jaccard similarity, and a shard is
a run of keys with about as many words as every other. So a seed finds its neighbours in its own shard at any number of
shards. Everything is done on arrays of bytes, hashes and codes; no string is made of a word, but of rare ones.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from pathlib import Path
from typing import TYPE_CHECKING, NamedTuple
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_bytes

if TYPE_CHECKING:
    import pyarrow as pa

#: Words are hashed to so many terms, which bounds the tables of document frequencies and keys that every task gets.
TERM_BITS = 18
TERMS = 1 << TERM_BITS
#: Words in one shard, about; a shard's index and token ids are held by one task.
SHARD_WORDS = 500_000
#: Neighbours that are sorted at once; the others are sorted when those are used up.
NEIGHBOURS = 64
K1, B = 1.2, 0.75
#: A term that so large a share of a shard's documents has is kept as a column, not as postings.
DENSE = 0.1
#: Rows of a batch looked at together where texts pass through.
ROWS = 500
#: Bytes hashed at once, and the multipliers of two independent hashes of a word.
BLOCK = 1 << 18
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Marks that end words here; a run of them is one piece to the tokenizer. The apostrophe isn't among them: it may begin a piece.
MARKS = b"".join(bytes([c]) for c in range(33, 127) if not chr(c).isalnum() and c != ord("'"))
#: Letters below this code point are composed and have one form under any version of Unicode.
LATIN = 0x250
#: Bytes of the longest word whose merges are made in bulk.
LONGEST = 48
#: Words, and marks after words, whose ids a worker keeps from shard to shard; one shard's own always have room.
KNOWN = 1 << 20

_byte = np.arange(256)
SPACE = (_byte == 32) | (_byte >= 9) & (_byte <= 13)
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
LETTER = (_byte >= 97) & (_byte <= 122)
MARK = np.isin(_byte, list(MARKS))


class Known(NamedTuple):
    """Pieces of text whose ids are known: two hashes, sorted by the first; where their ids start and how many there are, -1: not to be read as letters."""

    hash: np.ndarray = np.zeros(0, np.uint64)
    second: np.ndarray = np.zeros(0, np.uint64)
    at: np.ndarray = np.zeros(0, np.int32)
    count: np.ndarray = np.zeros(0, np.int32)
    ids: np.ndarray = np.zeros(0, "<u2")

    def find(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, found) of pieces with these hashes."""
        place = np.minimum(np.searchsorted(self.hash, first), max(len(self.hash) - 1, 0))
        return place, (self.hash[place] == first) & (self.second[place] == second) if len(self.hash) else np.zeros(len(first), bool)

    def more(self, first: np.ndarray, second: np.ndarray, count: np.ndarray, ids: np.ndarray) -> Known:
        held = np.maximum(count, 0)
        order = np.argsort(np.concatenate([self.hash, first]), kind="stable")
        both = lambda x, y: np.concatenate([x, y])[order]
        at = len(self.ids) + np.cumsum(held) - held
        return Known(both(self.hash, first), both(self.second, second), both(self.at, at.astype(np.int32)), both(self.count, count.astype(np.int32)), np.concatenate([self.ids, ids]))


#: What a worker knows, by the tokenizer file's digest: some 30 MB, kept when a task ends, unlike the tokenizer's tables.
_known: dict[bytes, Known] = {}


class Words(NamedTuple):
    """Words of some texts in order: lower-cased bytes, where each word starts and ends in them, its text and its hash."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray

    @property
    def term(self) -> np.ndarray:
        return (self.hash >> np.uint64(64 - TERM_BITS)).astype(np.int64)


@cache
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    made = []
    for x in (base, inverse):
        p = np.full(size, x, np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    return made[0], made[1]


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A polynomial in the bytes of each word, modulo 2^64, stirred; from differences of prefix sums, block by block."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        first = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, first + BLOCK, "right")))
        last = int(end[to - 1])
        size = last - first
        up, down = _powers(base, BLOCK) if size <= BLOCK else _powers.__wrapped__(base, size)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((data[first:last].astype(np.uint64) + np.uint64(1)) * up[:size], out=sums[1:])
        s = start[at:to] - first
        out[at:to] = (sums[end[at:to] - first] - sums[s]) * down[s]
        at = to
    out ^= out >> np.uint64(32)
    out *= np.uint64(BASES[1])
    out ^= out >> np.uint64(29)
    return out * np.uint64(BASES[0])


def words(texts: pa.Array) -> Words:
    raw, ends = text_bytes(texts)
    data = LOWER[raw]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    # Two texts that follow each other without white space are two words.
    step = np.diff(inside)
    joint = ends[(ends > 0) & (ends < len(data))]
    joint = joint[(inside[joint] == 1) & (inside[joint + 1] == 1)]
    joint = joint[np.append(True, joint[1:] != joint[:-1])[: len(joint)]]  # empty texts end where the one before does
    short = np.int32 if len(data) < 1 << 31 else np.int64
    start, end = (np.concatenate([np.flatnonzero(step == k).astype(short), joint.astype(short)]) for k in (1, -1))
    if len(joint):
        start.sort()
        end.sort()
    row = np.searchsorted(ends, start, "right").astype(np.int32)
    return Words(data, start, end, row, hashes(data, start, end, BASES[0]))


def distinct(have: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first, code): a place of each distinct word, and every word's number among them; 128 bits of hashes decide."""
    _, first, code = np.unique(have.hash, return_index=True, return_inverse=True)
    second = hashes(have.data, have.start, have.end, BASES[1])
    if (second[first][code] != second).any():
        _, first, code = np.unique(np.stack([have.hash, second], 1), axis=0, return_index=True, return_inverse=True)
    return first, code.ravel()


def slices(column: pa.Array) -> Iterator[pa.Array]:
    """The column in parts of ROWS rows, so that the arrays made of a batch's words stay small."""
    return (column.slice(k, ROWS) for k in range(0, len(column), ROWS))


class Merges:
    """The tokenizer file's merges, applied to many words at once; every step merges the best pair of every word."""

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel

        model = json.loads(Path(path).read_text())["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        # A letter's bytes stand in the vocabulary as the characters that the library shows for them.
        shown = {b: c for char in map(chr, range(LATIN)) for b, c in zip(char.encode(), ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(char)[0][0], strict=True)}
        self.inner, self.last = np.zeros(256, np.int32), np.zeros(256, np.int32)
        for b, c in shown.items():
            self.inner[b], self.last[b] = vocab[c], vocab[c + suffix]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.width, self.none = max(vocab.values()) + 1, len(pairs)
        key = np.array([vocab[x] * self.width + vocab[y] for x, y in pairs], np.int64)
        self.made = np.array([vocab[x + y] for x, y in pairs], np.int32)
        self.key, self.order = self._table(key)

    def _table(self, key: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Tables by a hash of the key, each for the keys that found their slot taken in those before."""
        keys, orders, left = [], [], np.arange(len(key))
        while len(left):
            slot = self._slot(key[left], len(keys))
            _, first = np.unique(slot, return_index=True)
            k, o = np.full(self.SLOTS, -1, np.int64), np.full(self.SLOTS, self.none, np.int32)
            k[slot[first]], o[slot[first]] = key[left[first]], left[first]
            keys.append(k)
            orders.append(o)
            left = np.delete(left, first)
        return keys, orders

    SLOTS = 1 << 18

    def _slot(self, key: np.ndarray, table: int) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(BASES[0] + 2 * table)) >> np.uint64(46)).astype(np.int64)

    def rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = (x.astype(np.int64) * self.width + y).ravel()
        out, left = np.full(len(key), self.none, np.int32), np.arange(len(key))
        for k, (known, order) in enumerate(zip(self.key, self.order, strict=True)):
            slot = self._slot(key, k)
            there = known[slot]
            hit = there == key
            out[left[hit]] = order[slot[hit]]
            # A key is in a later table only if its slot was taken by another in this one.
            more = ~hit & (there >= 0)
            key, left = key[more], left[more]
            if not len(key):
                break
        return out.reshape(x.shape)

    def encode(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count) of the rows of raw, bytes of words of one size: a row's first count ids are its word's."""
        size = raw.shape[1]
        now = self.inner[raw]
        now[:, -1] = self.last[raw[:, -1]]
        rank = self.rank(now[:, :-1], now[:, 1:])
        count, out, row = np.full(len(raw), size), now.astype("<u2"), np.arange(len(raw))
        while rank.shape[1]:
            at = rank.argmin(1)
            best = rank[np.arange(len(row)), at]
            more = best < self.none
            if not more.all():
                out[row[~more], : now.shape[1]] = now[~more]
                now, rank, at, best, row = now[more], rank[more], at[more], best[more], row[more]
            if not len(row):
                break
            count[row] -= 1
            i, columns = np.arange(len(row)), np.arange(now.shape[1] - 1)
            now[i, at] = self.made[best]
            now = np.take_along_axis(now, columns + (columns > at[:, None]), 1)
            rank = np.take_along_axis(rank, columns[:-1] + (columns[:-1] >= at[:, None]), 1) if len(columns) > 1 else rank[:, :0]
            for side in (at - 1, at):
                have = (side >= 0) & (side < rank.shape[1])
                j, k = i[have], side[have]
                rank[j, k] = self.rank(now[j, k], now[j, k + 1])
            out[row, : now.shape[1]] = now
        return out, count


class Tokens:
    """Token ids of words: the tokenizer drops white space and never joins what it separates.

    Words of small Latin letters, which are nearly all of the distinct ones, take the file's merges in bulk; a word
    that ends in marks is read as its letters and the marks, as the tokenizer does; any other word is given to the library.
    What was read once is known by 128 bits of hashes, for the words of later shards and tasks.
    """

    def __init__(self, path: str, merges: Merges | None = None):
        from tokenizers import Tokenizer

        self.merges = merges or Merges(path)
        self.tokenizer = Tokenizer.from_file(path)
        #: Texts that hold one of these, in any case, are the library's.
        self.special = [x.content.lower().encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.digest = sha256(Path(path).read_bytes()).digest()
        self.known = _known.get(self.digest, Known())

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u2") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _read(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, ids) of different pieces of the data, ids one after the other; count -1: of kind 2, but not Latin letters."""
        size, n = end - start, len(start)
        count = np.zeros(n, np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # pieces, ids of each

        def merge(rows: np.ndarray, raw: np.ndarray) -> None:
            ids, count[rows] = self.merges.encode(raw)
            parts.append((rows, ids[np.arange(raw.shape[1]) < count[rows][:, None]]))

        letters = np.flatnonzero(kind > 0)
        letters = letters[np.argsort(size[letters], kind="stable")]
        odd: list[int] = []
        for rows in np.split(letters, np.flatnonzero(np.diff(size[letters])) + 1) if len(letters) else []:
            raw = data[start[rows][:, None] + np.arange(size[rows[0]])]
            some = kind[rows] == 2
            if some.any():
                # Of two bytes, the first 0xC3: letters but for the signs of times and division, large up to 0x9E.
                after = np.zeros(raw.shape, bool)
                after[:, 1:] = raw[:, :-1] == 0xC3
                good = (LETTER[raw] | (raw == 0xC3) | after & (raw != 0x97) & (raw != 0xB7)).all(1)
                odd += rows[~good].tolist()
                rows, raw, after = rows[good], raw[good], after[good]
                raw = np.where(after & (raw <= 0x9E), raw + np.uint8(32), raw)
            if len(rows):
                merge(rows, raw)
        latin: dict[int, list[tuple[int, bytes]]] = {}
        for k in odd:
            char = data[start[k] : end[k]].tobytes().decode()
            low = char.lower()
            if low.isalpha() and max(char) < chr(LATIN) and len(low) == len(char):
                own = low.encode()
                latin.setdefault(len(own), []).append((k, own))
            else:
                count[k] = -1
        for width, some in latin.items():
            merge(np.array([k for k, _ in some]), np.frombuffer(b"".join(x for _, x in some), np.uint8).reshape(-1, width))
        other = np.flatnonzero(kind == 0)
        if len(other):
            own = self.library([data[start[k] : end[k]].tobytes().decode() for k in other.tolist()])
            count[other] = [len(x) for x in own]
            parts.append((other, np.concatenate(own)))
        held = np.maximum(count, 0)
        at = np.cumsum(held) - held
        ids = np.empty(held.sum(), "<u2")
        for rows, own in parts:
            ids[_spread(at[rows], held[rows])] = own
        return count, ids

    def _find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(at, count) in the known ids of pieces of the data, in order; kind 1: small letters, 2: other letters, 0: anything, for the library."""
        salt = np.where(kind == 0, np.uint64(BASES[1]), np.uint64(0))
        first, second = (hashes(data, start, end, base) ^ salt for base in BASES)
        place, found = self.known.find(first, second)
        new = np.flatnonzero(~found)
        if len(new):
            own = new[np.unique(first[new], return_index=True)[1]]
            count, ids = self._read(data, start[own], end[own], kind[own])
            self.known = self.known.more(first[own], second[own], count, ids)
            place, found = self.known.find(first, second)
        at, count = self.known.at[place].astype(np.int64), self.known.count[place].astype(np.int64)
        left = np.flatnonzero(~found)
        if len(left):  # another piece with the same first hash stands there
            count[left], ids = self._read(data, start[left], end[left], kind[left])
            at[left] = len(self.known.ids) + np.cumsum(np.maximum(count[left], 0)) - np.maximum(count[left], 0)
            self.known = self.known._replace(ids=np.concatenate([self.known.ids, ids]))
        return at, count

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of words given by their places in lower-cased bytes: word k has the ids from ends[k] to ends[k + 1]."""
        n = len(start)
        if not n:
            return np.zeros(0, "<u2"), np.zeros(1, np.int64)
        if len(self.known.hash) + n > KNOWN:
            self.known = Known()
        by_place = np.argsort(start, kind="stable")
        start, end = start[by_place].astype(np.int64), end[by_place].astype(np.int64)
        # A word's marks at its end go off; the rest is small letters (kind 1), other letters (2), or the whole is the library's (0).
        last = np.maximum.accumulate(np.where(MARK[data], -1, np.arange(len(data))))
        core = np.maximum(last[end - 1] + 1, start)
        among = lambda bad: np.concatenate([[0], np.cumsum(bad, dtype=np.int64)])
        none = lambda bad: bad[core] == bad[start]
        kind = np.where(none(among(~LETTER[data])), 1, np.where(none(among(~LETTER[data] & (data < 128))), 2, 0))
        kind[(core == start) | MARK[data[start]] | (end - start > LONGEST)] = 0
        core = np.where(kind > 0, core, end)
        at, count = self._find(data, start, core, kind)
        whole = np.flatnonzero(count < 0)
        if len(whole):
            core[whole] = end[whole]
            at[whole], count[whole] = self._find(data, start[whole], end[whole], np.zeros(len(whole), np.int64))
        marked = np.flatnonzero(core < end)
        more_at, more = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if len(marked):
            more_at[marked], more[marked] = self._find(data, core[marked], end[marked], np.zeros(len(marked), np.int64))
        total = np.empty(n, np.int64)
        total[by_place] = count + more
        ends = np.concatenate([[0], np.cumsum(total)])
        to, ids = ends[by_place], np.empty(ends[-1], "<u2")
        ids[_spread(to, count)] = self.known.ids[_spread(at, count)]
        ids[_spread(to + count, more)] = self.known.ids[_spread(more_at, more)]
        _known[self.digest] = self.known
        return ids, ends


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] of them, then the same of the next."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())


def document_ids(texts: pa.Array, have: Words, first: np.ndarray, code: np.ndarray, mine: Tokens, end: int) -> list[np.ndarray]:
    """Token ids of every text and then `end`."""
    ids, at = mine.encode(have.data, have.start[first], have.end[first])
    count = np.diff(at)[code]
    # A text's end stands before the words of the next.
    to = np.concatenate([[0], np.cumsum(count)])
    every = np.full(to[-1] + len(texts), end, "<u2")
    every[_spread(to[:-1] + have.row, count)] = ids[_spread(at[code], count)]
    edge = to[np.searchsorted(have.row, np.arange(len(texts) + 1))] + np.arange(len(texts) + 1)
    out = [every[a:b] for a, b in zip(edge.tolist(), edge[1:].tolist(), strict=False)]
    lower, ends = have.data.tobytes(), text_bytes(texts)[1]
    theirs = set()
    for mark in mine.special:
        k = lower.find(mark)
        while k >= 0:
            theirs.add(int(np.searchsorted(ends, k, "right")))
            k = lower.find(mark, k + 1)
    for row in theirs:
        out[row] = np.append(mine.library([texts[row].as_py() or ""])[0], np.uint16(end))
    return out


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int, int]:
    """Over all documents: how many have each hashed term, their number and their words. The result has TERMS + 2 rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        count, n, total = np.zeros(TERMS, np.int64), 0, 0
        for batch in batches:
            for part in slices(batch.column(0)):
                have = words(part)
                n, total = n + len(part), total + len(have.start)
                pair = np.sort(have.row.astype(np.int64) * TERMS + have.term)
                count += np.bincount(pair[np.append(True, pair[1:] != pair[:-1])[: len(pair)]] % TERMS, minlength=TERMS)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([some, [-1, -2]])), pa.array(np.concatenate([count[some], [n, total]]))], names=["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    count = np.zeros(TERMS, np.int64)
    terms, n = rows["term"].to_numpy(), rows["n"].to_numpy()
    count[terms[terms >= 0]] = n[terms >= 0]
    return count, int(n[terms == -1].sum()), int(n[terms == -2].sum())


def places(frequency: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Every term's place in the order that keys are taken from; terms that only one document has come last."""
    x = (np.arange(1, TERMS + 1, dtype=np.uint64) * np.uint64(BASES[0])) ^ np.uint64(BASES[1])
    x ^= x >> np.uint64(31)
    x *= np.uint64(BASES[1])
    u = ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
    late = np.where(frequency > 1, -np.log(u) / np.maximum(idf, 1e-6), np.inf)
    out = np.empty(TERMS, np.int64)
    out[np.argsort(late, kind="stable")] = np.arange(TERMS)
    return out


def keys(texts: pa.Array, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, words) of every text; TERMS is the key of texts without words."""
    have = words(texts)
    n = np.bincount(have.row, minlength=len(texts))
    key = np.full(len(texts), TERMS)
    if len(have.row):
        at = np.flatnonzero(np.diff(have.row, prepend=-1))
        key[have.row[at]] = np.minimum.reduceat(place[have.term], at)
    return key, n


def deal(docs: DataFrame, frequency: np.ndarray, idf: np.ndarray, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, text, shard): shards are runs of keys with about shard_words words each; a key with more has several, by row.

    The driver gets a row for each key, TERMS + 1 at most.
    """
    context = docs.sparkSession.sparkContext
    order = context.broadcast(places(frequency, idf).astype(np.int32))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("tie"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        total = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            for part in slices(batch.column(0)):
                key, n = keys(part, order.value)
                np.add.at(total, key, n + 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["key", "n"])

    found = docs.select("text").mapInArrow(weigh, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    size = np.zeros(TERMS + 1, np.int64)
    size[found["key"].to_numpy()] = found["n"].to_numpy()
    first = (np.cumsum(size) - size) // shard_words
    spans = context.broadcast((first.astype(np.int32), np.maximum(1, size // shard_words).astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            key = np.concatenate([np.zeros(0, np.int64), *(keys(x, order.value)[0] for x in slices(batch.column(1)))])
            start, many = spans.value
            shard = start[key] + batch.column(2).to_numpy() % many[key]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shard.astype(np.int64))], names=["doc_id", "text", "shard"])

    return rows.mapInArrow(run, "doc_id long, text string, shard long")


class Index:
    """BM25 weights of one shard's documents, by hashed term: postings, and whole columns for terms that many documents have."""

    def __init__(self, row: np.ndarray, term: np.ndarray, n: int, idf: np.ndarray, mean: float):
        pair, tf = np.unique(row.astype(np.int64) * TERMS + term, return_counts=True)
        docs, terms = pair // TERMS, pair % TERMS
        length = np.bincount(row, minlength=n)
        weight = (idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[docs] / max(mean, 1.0)))).astype(np.float32)
        self.terms, self.edge = terms, np.searchsorted(docs, np.arange(n + 1))
        count = np.bincount(terms, minlength=TERMS)
        self.column = np.full(TERMS, -1)
        many = np.flatnonzero(count >= max(DENSE * n, 8))
        self.column[many] = np.arange(len(many))
        dense = self.column[terms] >= 0
        self.dense = np.zeros((len(many), n), np.float32)
        self.dense[self.column[terms[dense]], docs[dense]] = weight[dense]
        docs, terms, weight = docs[~dense], terms[~dense], weight[~dense]
        order = np.argsort(terms, kind="stable")
        self.docs, self.weight = docs[order], weight[order]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=TERMS))])
        self.n = n

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for all terms of the seed."""
        terms = self.terms[self.edge[seed] : self.edge[seed + 1]]
        column = self.column[terms]
        rare = terms[column < 0]
        total = self.dense[column[column >= 0]].sum(0, dtype=np.float64)
        a, b = self.at[rare], self.at[rare + 1]
        some = _spread(a, b - a)
        return total + np.bincount(self.docs[some], self.weight[some], self.n)

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """All unused documents that share terms with the seed, best first, ties in order."""
        score = self.scores(seed) * unused
        some = np.flatnonzero(score)
        if len(some) > NEIGHBOURS:
            least = np.partition(score[some], -NEIGHBOURS)[-NEIGHBOURS]
            best = some[score[some] >= least]
            yield from best[np.argsort(-score[best], kind="stable")].tolist()
            some = some[score[some] < least]
        yield from some[np.argsort(-score[some], kind="stable")].tolist()


def fill(sizes: np.ndarray, index: Index, window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset): every window but the last is full.

    A document too long for its window goes on in the next and is that one's seed. Once a seed ends its neighbours follow,
    best first; when it has none left, the next unused document in order is the window's new seed.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    unused = np.ones(len(sizes), bool)
    nxt, sequence, offset = 0, 0, 0
    near: Iterator[int] = iter(())
    for _ in range(len(sizes)):
        doc = next(near, -1)
        if doc < 0:
            while not unused[nxt]:
                nxt += 1
            doc = nxt
        unused[doc] = False
        seeds = offset == 0 or doc == nxt
        start = 0
        while start < sizes[doc]:
            n = int(min(sizes[doc] - start, window - offset))
            pieces.append((doc, start, n, sequence, offset))
            start, offset = start + n, offset + n
            if offset == window:
                sequence, offset, seeds = sequence + 1, 0, True
        if offset == 0:
            near = iter(())  # the window is full, and the next begins with a document in order
        elif seeds:
            near = index.neighbours(doc, unused)
    return pieces


def pack(docs: DataFrame, tokenizer: str, end: int = 2, window: int = 4096, with_ids: bool = False, shard_words: int = SHARD_WORDS) -> DataFrame:
    """All rows of docs (doc_id, text) as pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document is its token ids (null text: none) and then `end`; every id lies in exactly one piece. Pieces lie without
    gaps in sequences of `window` ids; only the last sequence of a shard is shorter and would be padded. Shards are dealt by
    content (see deal), and neither source, key nor group of copies makes one large; idf and mean length are those of all
    documents. with_ids adds the ids (array<int>). Repeated rows are packed apart; ties go by doc_id (null last), then text.
    Other columns of docs play no part. An empty table gives an empty result.
    """
    frequency, n, total = document_frequencies(docs)
    idf = np.log1p((n - frequency + 0.5) / (frequency + 0.5)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    merges = docs.sparkSession.sparkContext.broadcast(Merges(tokenizer))
    mean = total / max(n, 1)
    held: list[Tokens] = []  # a task unpickles its own, so the tokenizer's tables go when the task ends
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def run(part: pa.Table) -> pa.Table:
        import pyarrow as pa

        part = part.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        texts, shard = part.column("text").combine_chunks(), part.column("shard")[0].as_py()
        have = words(texts)
        first, code = distinct(have)
        if not held:
            held.append(Tokens(tokenizer, merges.value))
        ids = document_ids(texts, have, first, code, held[0], end)
        sizes = np.array([len(x) for x in ids])
        pieces = np.array(fill(sizes, Index(have.row, have.term, len(texts), shared.value, mean), window), np.int64).reshape(-1, 5)
        doc, start, length, sequence, offset = pieces.T
        own = [ids[d][s : s + k].astype("<u4") for d, s, k in zip(doc, start, length, strict=True)]
        crc = np.array([crc32(x) for x in own], np.int64)
        out = [part.column("doc_id").take(pa.array(doc)), start, length, crc, sizes[doc], shard << 32 | sequence, offset]
        if with_ids:
            out.append(pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())))
        return pa.table(out, names=[x.split()[0] for x in schema.split(", ")])

    return deal(docs, frequency, idf, shard_words).groupBy("shard").applyInArrow(run, schema)
