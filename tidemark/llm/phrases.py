"""Phrases whose words stand together more often than by chance, counted level by level with double-array tries.

Texts are lower-cased (A-Z), split into pieces at `.,;:!?` and line ends, and pieces into words at spaces and tabs. A
phrase of k words is a candidate only if it occurs and both its parts of k - 1 words are frequent (Apriori), so:

1. words are counted, and frequent ones get numbers; texts are written once as numbers, with 0 for all else;
2. pairs of frequent words are counted where they are found: nothing smaller than all of them is safe;
3. for k = 3, 4, 5 the trie of frequent (k - 1)-phrases finds the words that follow them, first to count them in hashed
   buckets, of which few are full, then to list those of full buckets and how often a task saw them; a join keeps the phrases whose second part is frequent too and that were seen often enough, and their trie is
   broadcast: numpy moves the states of all text positions on by one word at a time, counts the accepting states, and
   the shards' counts are summed.

Words and candidates go to tasks in shards of bounded size, one after the other, so no broadcast grows with the data.
A word is known by 64 bits; if two words are found to share them, other hashes are taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, join_sized, ordered, stored

if TYPE_CHECKING:
    import pyarrow as pa

#: Occurrences from which a phrase counts, and words of the longest phrase.
LEAST, LONGEST = 100, 5
#: Words that one broadcast numbers, and phrases that one broadcast trie holds.
WORDS, PHRASES = 1 << 20, 1 << 19
#: Bytes of text looked at together; longer texts are cut at ends of pieces. Positions looked at together.
BLOCK, POSITIONS = 1 << 20, 1 << 20
#: Sums that a task holds before it gives them away.
HELD = 1_000_000
#: Counters of hashed phrases, and of a row of them.
BUCKETS, ROW = 1 << 21, 1 << 16
#: Attempts with other hashes if two words should have the same.
SEEDS = (42, 43, 44, 45)
#: What stands for a null language.
NO_LANG = "und"

_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[[*b".,;:!?", *range(10, 14)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_END = re.compile(rb"[.,;:!?\x0a-\x0d]")


def blocks(texts: list[str | None]) -> Iterator[bytes]:
    """The texts one after the other with a line end between, in blocks of about BLOCK bytes that begin and end with pieces."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        data, at = (text or "").encode(), 0
        while len(data) - at > BLOCK:
            end = _END.search(data, at + BLOCK)
            if not end:
                break
            yield data[at : end.end()]
            at = end.end()
        held.append(data[at:])
        size += len(held[-1])
        if size >= BLOCK:
            yield b"\n".join(held)
            held, size = [], 0
    if held:
        yield b"\n".join(held)


class Hashes:
    """Hashes of all words of a block at once: differences of prefix sums of a polynomial modulo 2^64."""

    def __init__(self, seed: int) -> None:
        self.base = np.uint64(int(np.random.default_rng(seed).integers(1 << 62)) * 4 + 3)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def words(self, block: bytes, lang: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(lower-cased bytes, starts, ends, hashes, whether the word begins a piece) of a block's words."""
        data = _LOWER[np.frombuffer(block, np.uint8)]
        if len(self.powers) <= len(data):
            self.powers, self.inverses = (np.cumprod(np.r_[np.uint64(1), np.full(max(len(data), BLOCK), x, np.uint64)]) for x in (self.base, self.inverse))
        kind = _KIND[data]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = kind == 0
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=sums[1:])
        h = (sums[end] - sums[start]) * self.inverses[start] + np.uint64(lang)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        breaks = np.concatenate([[0], np.cumsum(kind == 2)])
        first = np.ones(len(start), bool)
        first[1:] = breaks[start[1:]] > breaks[start[:-1]]
        return data, start, end, h.view(np.int64), first


def _number(lang: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(lang.encode(), 7)


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, block) of batches (lang, text)."""
    import pyarrow as pa

    for batch in batches:
        lang = np.array(batch.column(0).to_pylist(), object)
        for x in dict.fromkeys(lang):
            for block in blocks(batch.column(1).take(pa.array(np.flatnonzero(lang == x))).to_pylist()):
                yield x, block


class Sums:
    """Sums by key of what a task has seen, given away when they are many."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.n: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> bool:
        """Whether so many are held that they should be taken."""
        self.keys.append(keys)
        self.n.append(n)
        self.size += len(keys)
        if self.size < HELD:
            return False
        keys, n = self.take()
        self.keys, self.n, self.size = [keys], [n], len(keys)
        return self.size >= HELD // 2

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = np.concatenate([np.zeros(0, np.int64), *self.keys]), np.concatenate([np.zeros(0, np.int64), *self.n])
        self.keys, self.n, self.size = [], [], 0
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        return keys[first], np.add.reduceat(n[order], first) if len(first) else n


def words(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, word, h, n) of all words of docs (lang, text); n is their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        hashes = Hashes(seed)
        spelt: dict[int, tuple[str, bytes]] = {}
        sums = Sums()

        def give() -> pa.RecordBatch:
            h, n = sums.take()
            found = [spelt[x] for x in h.tolist()]
            spelt.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.binary()).cast(pa.string()), pa.array(h), pa.array(n)], names=["lang", "word", "h", "n"])

        for lang, block in _by_lang(batches):
            data, start, end, h, _ = hashes.words(block, _number(lang))
            h, at, n = np.unique(h, return_index=True, return_counts=True)
            raw = data.tobytes()
            for x, a, b in zip(h.tolist(), start[at].tolist(), end[at].tolist(), strict=True):
                if x not in spelt:
                    spelt[x] = (lang, raw[a:b])
            sums.add(h, n.astype(np.int64))
            if len(spelt) >= HELD // 5:
                yield give()
        yield give()

    rows = docs.mapInArrow(run, "lang string, word string, h long, n long")
    return rows.groupBy("lang", "word").agg(F.max("h").alias("h"), F.sum("n").alias("n"))


def _apart(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Numbers with a 0 before each piece, and one 0 where several would stand."""
    out = np.zeros(len(codes) + int(first.sum()), np.int32)
    out[np.arange(len(codes)) + np.cumsum(first)] = codes
    keep = out != 0
    keep[1:] |= keep[:-1].copy()
    return out[keep] if not len(out) or keep[0] else np.r_[np.int32(0), out[keep]]


def numbered(docs: DataFrame, known: list[np.ndarray], seed: int) -> DataFrame:
    """(codes binary): the texts as int32 numbers of known words, with 0 between what doesn't stand together.

    known: sorted hashes in shards; a word's number is its place in all of them, from 1. Where there are several shards,
    the texts pass by once for each, together with the numbers found so far.
    """

    def step(shard: np.ndarray, before: int, last: bool):  # noqa: ANN202
        shared = docs.sparkSession.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import pyarrow as pa

            hashes = Hashes(seed)
            rows = ((x, block, None) for x, block in _by_lang(batches)) if not before else (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
            for lang, block, old in rows:
                _, _, _, h, first = hashes.words(block, _number(lang))
                codes = np.zeros(len(h), np.int32)
                if len(shared.value):
                    at = np.searchsorted(shared.value[:-1], h)
                    codes = np.where(shared.value[at] == h, at + before + 1, 0).astype(np.int32)
                codes = codes if old is None else np.maximum(codes, np.frombuffer(old, np.int32))
                out = [(None, None, _apart(codes, first).tobytes())] if last else [(lang, block, codes.tobytes())]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.binary(), pa.binary()), strict=True)], names=["lang", "block", "codes"])

        return run

    rows, before = docs, 0
    for k, shard in enumerate(known):
        rows = stored(rows.mapInArrow(step(shard, before, k == len(known) - 1), "lang string, block binary, codes binary"))
        before += len(shard)
    return rows.select("codes")


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The numbers of many rows together."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for x in batch.column(0):
            held.append(np.frombuffer(x.as_buffer(), np.int32))
            size += len(held[-1])
            if size >= POSITIONS:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def pairs(texts: DataFrame, least: int) -> DataFrame:
    """(w0, w1, a) of the pairs of known words that stand together at least so often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        sums = Sums()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(x) for x in sums.take()], names=["code", "n"])
        for c in _positions(batches):
            both = (c[:-1] > 0) & (c[1:] > 0)
            code, n = np.unique((c[:-1][both].astype(np.int64) << 32) | c[1:][both], return_counts=True)
            if sums.add(code, n.astype(np.int64)):
                yield give()
        yield give()

    # Tasks have added up what they could, so there is nothing to combine before the shuffle.
    rows = texts.mapInArrow(run, "code long, n long").repartition("code").groupBy("code").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    return rows.select(F.shiftright("code", 32).cast("int").alias("w0"), F.col("code").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("w1"), "a")


@dataclass
class Trie:
    """A double array: from state s a word w leads to base[s] + w if check says that this place belongs to s. phrases: (m, k), sorted; number: of a state that accepts."""

    base: np.ndarray
    check: np.ndarray
    number: np.ndarray
    phrases: np.ndarray

    def find(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, phrase's number) of all occurrences; all positions go on by one word at a time."""
        k = self.phrases.shape[1]
        c = np.where(c <= self.phrases.max(initial=0), c, 0)  # larger words are in no phrase, and no place is theirs
        at = np.flatnonzero(c[: max(len(c) - k + 1, 0)])
        state = np.zeros(len(at), np.int32)
        for d in range(k):
            to = self.base[state] + c[at + d]
            go = self.check[to] == state
            at, state = at[go], to[go]
        return at, self.number[state]


def trie(phrases: np.ndarray) -> Trie:
    """The double array of distinct phrases (m, k), of words from 1. Large nodes are placed first, at random places that are free."""
    phrases = np.unique(phrases.astype(np.int32).reshape(len(phrases), -1), axis=0)
    m, k = phrases.shape
    new = np.ones((m, k), bool)  # where a phrase has a node of its own at each depth
    new[1:] = np.logical_or.accumulate(phrases[1:] != phrases[:-1], axis=1)
    node = np.zeros((m, k + 1), np.int64)  # numbers of nodes, the root being 0
    node[:, 1:] = np.cumsum(new, axis=0) + np.concatenate([[0], np.cumsum(new.sum(0))[:-1]])
    row, depth = np.nonzero(new)
    parent, word, child = node[row, depth], phrases[row, depth].astype(np.int64), node[row, depth + 1]
    order = np.lexsort((word, parent))
    parent, word, child = parent[order], word[order], child[order]
    top = int(word.max(initial=0)) + 1
    parents, first, n = np.unique(parent, return_index=True, return_counts=True)
    base = np.zeros(len(child) + 1, np.int64)
    taken = np.zeros(4 * len(child) + 3 * top + 16, bool)
    taken[0] = True
    rng = np.random.default_rng(1)
    for i in np.argsort(-n, kind="stable")[: int((n > 1).sum())].tolist():
        words_ = word[first[i] : first[i] + n[i]]
        for _ in range(64):
            tries = rng.integers(0, len(taken) - top, 16)
            free = ~taken[tries[:, None] + words_].any(1)
            if free.any():
                b = int(tries[free.argmax()])
                break
        else:
            b = len(taken)
            taken = np.concatenate([taken, np.zeros(2 * top, bool)])
        taken[b + words_] = True
        base[parents[i]] = b
    one = first[n == 1]
    spare = np.flatnonzero(~taken[top : len(taken) - top])[: len(one)] + top
    base[parent[one]] = spare - word[one]
    place = np.zeros(len(base), np.int64)
    for d in range(k):
        some = depth[order] == d
        place[child[some]] = base[parent[some]] + word[some]
    bases, check, number = (np.full(len(taken), x, np.int32) for x in (0, -1, -1))
    bases[place] = base
    check[place[child]] = place[parent]
    number[place[node[:, k]]] = np.arange(m)
    return Trie(bases, check, number, phrases)


def _tries(phrases: DataFrame, k: int) -> Iterator[tuple[Trie, bool]]:
    """Tries of all phrases (w0, ...), and whether there is only one; each holds about PHRASES at most."""
    names = [f"w{j}" for j in range(k)]
    shards = -(-phrases.count() // PHRASES)
    for s in range(shards):
        part = phrases.where(F.pmod(F.xxhash64(*names), F.lit(shards)) == s).select(*names).toPandas().to_numpy()
        if len(part):
            yield trie(part), shards == 1


def _columns(found: np.ndarray, *more: np.ndarray) -> list[pa.Array]:
    import pyarrow as pa

    return [pa.array(np.ascontiguousarray(x)) for x in (*found.T, *more)]


def _follows(t: Trie, whole: bool, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, word): the phrases of the trie that stand in c with the word after each; if the trie is whole, where it accepts the next k - 1 words too."""
    at, number = t.find(c)
    word = np.append(c, np.zeros(k, np.int32))[at + k - 1]
    ok = word > 0
    if whole:
        begins = np.zeros(len(c) + 1, bool)
        begins[at] = True
        ok &= begins[at + 1]
    return number[ok].astype(np.int64), word[ok].astype(np.int64)


def _bucket(number: np.ndarray, word: np.ndarray, buckets: int) -> np.ndarray:
    h = (number.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)).astype(np.int64) % buckets


def _full(texts: DataFrame, shared, whole: bool, k: int, least: int) -> np.ndarray:  # noqa: ANN001
    """Which buckets of hashed phrases of k words have at least so many occurrences: a phrase of another bucket has fewer.

    Each task counts in a table of one size, and tables are added up row by row.
    """

    kind = np.uint8 if least < 256 else np.int32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        n = np.zeros(BUCKETS, np.int32)
        for c in _positions(batches):
            bucket, found = np.unique(_bucket(*_follows(shared.value, whole, c, k), BUCKETS), return_counts=True)
            n[bucket] += found.astype(np.int32)
        n = np.minimum(n, least).astype(kind).reshape(-1, min(ROW, BUCKETS))  # what is enough once is enough
        some = np.flatnonzero(n.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([n[i].tobytes() for i in some], pa.binary())], names=["row", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, n in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[row] = sums.get(row, 0) + np.frombuffer(n.as_buffer(), kind).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([np.packbits(x >= least).tobytes() for x in sums.values()], pa.binary())], names=["row", "full"])

    rows = texts.mapInArrow(count, "row long, n binary").repartition("row").mapInArrow(add, "row long, full binary")
    full = np.zeros((BUCKETS // min(ROW, BUCKETS), min(ROW, BUCKETS)), bool)
    for r in rows.collect():  # BUCKETS bits
        full[r.row] = np.unpackbits(np.frombuffer(r.full, np.uint8))[: full.shape[1]]
    return full.ravel()


def longer(texts: DataFrame, some: DataFrame, k: int, least: int) -> DataFrame:
    """(w0, ...) phrases of k words whose parts of k - 1 words are all in some, and that tasks together saw at least so often."""
    names = [f"w{j}" for j in range(k)]
    listed = []
    wide = texts.coalesce(-(-texts.rdd.getNumPartitions() // 2))  # fewer tasks list a frequent phrase fewer times
    for t, whole in _tries(some, k - 1):
        shared = texts.sparkSession.sparkContext.broadcast(t)
        full = texts.sparkSession.sparkContext.broadcast(_full(texts, shared, whole, k, least))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, full=full, whole=whole) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            import pyarrow as pa

            sums = Sums()

            def give() -> pa.RecordBatch:
                code, n = sums.take()
                return pa.RecordBatch.from_arrays(_columns(shared.value.phrases[code >> 32], (code & 0xFFFFFFFF).astype(np.int32), n), names=[*names, "n"])

            for c in _positions(batches):
                number, word = _follows(shared.value, whole, c, k)
                ok = full.value[_bucket(number, word, len(full.value))]
                code, n = np.unique((number[ok] << 32) | word[ok], return_counts=True)
                if sums.add(code, n.astype(np.int64)):
                    yield give()
            yield give()

        rows = wide.mapInArrow(run, ", ".join([*(f"{x} int" for x in names), "n long"]))
        listed.append(cut(rows.groupBy(*names).agg(F.sum("n").alias("n")).where(F.col("n") >= least).select(*names)))
        shared.unpersist()
    if not listed:
        return some.select("*", F.lit(0).alias(names[-1])).select(*names).limit(0)
    last = some.select(*[F.col(f"w{j}").alias(f"w{j + 1}") for j in range(k - 1)])
    return cut(reduce(DataFrame.union, listed).join(last, names[1:], "left_semi").select(*names))


def counted(texts: DataFrame, phrases: DataFrame, k: int, least: int) -> DataFrame:
    """(w0, ..., a) of those phrases that occur at least so often."""
    names = [f"w{j}" for j in range(k)]
    sums = []
    for t, _ in _tries(phrases, k):
        shared = texts.sparkSession.sparkContext.broadcast(t)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            import pyarrow as pa

            total = np.zeros(len(shared.value.phrases), np.int64)
            for c in _positions(batches):
                total += np.bincount(shared.value.find(c)[1], minlength=len(total))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(_columns(shared.value.phrases[some], total[some]), names=[*names, "n"])

        rows = texts.mapInArrow(run, ", ".join([*(f"{x} int" for x in names), "n long"]))
        sums.append(cut(rows.groupBy(*names).agg(F.sum("n").alias("a")).where(F.col("a") >= least)))
        shared.unpersist()
    return reduce(DataFrame.union, sums) if sums else phrases.select(*names, F.lit(0).cast("long").alias("a")).limit(0)


def _scored(found: DataFrame, parts: DataFrame, totals: DataFrame) -> DataFrame:
    """found (lang, p, phrase, a) with l, r, n, score of its lowest-scoring cut; parts: (p, f) of all frequent phrases."""
    exact = lambda x: F.col(x).cast("decimal(19,0)")
    cuts = found.withColumn("j", F.explode(F.sequence(F.lit(1), F.size("p") - 1)))
    cuts = cuts.withColumns({"x": F.slice("p", F.lit(1), F.col("j")), "y": F.slice("p", F.col("j") + 1, F.size("p") - F.col("j"))})
    cuts = cuts.join(parts.select(F.col("p").alias("x"), F.col("f").alias("l")), "x").join(parts.select(F.col("p").alias("y"), F.col("f").alias("r")), "y")
    cuts = join_sized(cuts, totals, ["lang"], "inner", totals.count()).withColumns({"over": exact("a") * exact("n") * 1000, "under": exact("l") * exact("r")})
    cuts = cuts.withColumn("score", F.expr("over div under"))
    return cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "j", "l", "r")).alias("least")).select("lang", "phrase", "a", "n", "least.l", "least.r", "least.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int | None = 2000) -> DataFrame:
    """Each language's phrases of 2 to LONGEST words by score: (lang, rank, phrase, a, l, r, n, score).

    docs: (text, lang), read whole. a: the phrase's occurrences, at least `least`; n: all words of the language; l, r:
    occurrences of the two parts of the cut that scores lowest, the first such; score: floor(1000 * a * n / (l * r)),
    exactly. A phrase that never occurs outside a longer one goes. Ranks go by score, occurrences (both descending) and
    phrase (bytes); top: how many of a language come back, None for all. A null text is empty, a null language `und`;
    rows count as often as they stand there; other columns aren't read. An empty table gives an empty result.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), "text")
    for seed in SEEDS:
        every = cut(words(rows, seed))
        if every.groupBy("h").count().where("count > 1").isEmpty():
            break
    else:
        raise ValueError("words share hashes under all seeds")
    totals = cut(every.groupBy("lang").agg(F.sum("n").alias("n")))
    frequent = ordered(every.where(F.col("n") >= least), "number", "h").withColumn("number", (F.col("number") + 1).cast("int"))
    amount = frequent.count()
    shard = lambda s: frequent.where(F.col("number").between(s + 1, s + WORDS)).orderBy("number").select("h").toPandas()["h"].to_numpy(np.int64)
    texts = numbered(rows, [shard(s) for s in range(0, max(amount, 1), WORDS)], seed)
    levels = [frequent.select(F.col("number").alias("w0"), F.col("n").alias("a")), cut(pairs(texts, least))]
    for k in range(3, LONGEST + 1):
        levels.append(counted(texts, longer(texts, levels[-1], k, least), k, least))
    parts = cut(reduce(DataFrame.union, [x.select(F.array(*[f"w{j}" for j in range(k)]).alias("p"), F.col("a").alias("f")) for k, x in enumerate(levels, 1)]))
    found = parts.where(F.size("p") > 1)
    wider = parts.where(F.size("p") > 2).select(F.explode(F.array(F.expr("slice(p, 1, size(p) - 1)"), F.expr("slice(p, 2, size(p) - 1)"))).alias("p"), "f")
    found = found.join(wider, ["p", "f"], "left_anti")  # a longer phrase has at most as many occurrences
    spelt = found.select("p", F.col("f").alias("a"), F.posexplode("p").alias("j", "number"))
    spelt = join_sized(spelt, frequent.select("number", "lang", "word"), ["number"], "inner", amount)
    spelt = spelt.groupBy("p", "a").agg(F.max("lang").alias("lang"), F.array_join(F.array_sort(F.collect_list(F.struct("j", "word"))).getField("word"), " ").alias("phrase"))
    scored = _scored(spelt, parts, totals)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = scored.withColumn("rank", rank.cast("long"))
    return (ranked if top is None else ranked.where(F.col("rank") <= top)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
