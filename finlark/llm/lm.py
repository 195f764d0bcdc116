"""Language-model scores from an Elias-Fano trie of word n-grams (orders one to three).

The corpus is dealt by a hash of the row into blocks of bounded size, exchanged once in compressed pieces. The model is
dealt into shards by a hash of an n-gram's first word; a word too frequent
for one shard is spread over several by a hash of the second word, a pair too frequent by a hash of the third. A block sends each shard
that it has something for its distinct words, pairs and triples with their training
counts, as sorted and compressed columns; a shard sums them up, builds its part of the trie and
answers each block's entries in the block's own order; the block then scores
its texts. So no task holds more than a shard or a block. Rows
exchanged: one for each block and shard that share an n-gram, so never more than there are n-grams.
In what is sent the COMMON most frequent words stand for their hashes by rank.

Smoothing (interpolated absolute discounting): P(w | u, v) = (c(u,v,w) - D) / c(u,v) for triples seen
``min_count`` times or more, plus the mass that this leaves times P(w | v), which is
made of pairs in the same way, with the add-one unigram P(w) beneath it.
"""

from __future__ import annotations

import functools
import itertools
import mmap
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finlark.llm.common import SLICE, Tokens, cut, mix

START, END = np.uint64(0x5F3759DF12345678), np.uint64(0xC0FFEE0DDBA11E5D)
FOLLOWER_BITS = np.uint64(38)
FOLLOWER = np.uint64((1 << 38) - 1)
ABSENT = 0xFFFF
STEP = 8 / 65_000  # of the quantised log10 probabilities
WINDOW = 1 << 18
MOST_HOT = 1_000_000
COMMON = 1 << 16
HELD = 1 << 22
OFTEN = 16
HEAD = 10  # bytes that tell of one array of a piece
SMALL = 1 << 14


class Mapped:
    """Arrays laid out in one anonymous memory map."""

    def __init__(self, **arrays: np.ndarray):
        spaces = {k: (a.nbytes + 7) // 8 * 8 for k, a in arrays.items()}
        self.map = mmap.mmap(-1, max(8, sum(spaces.values())))
        at = 0
        for k, a in arrays.items():
            view = np.frombuffer(self.map, a.dtype, len(a), at)
            view[:] = a
            setattr(self, k, view)
            at += spaces[k]


class EliasFano:
    """An ascending sequence of uint64 in about 2 + log2(range / length) bits each.

    The low bits are packed; the high bits are in unary in a bit vector, with
    the number of ones before each of its words kept for rank and select.
    """

    def __init__(self, values: np.ndarray, top: int):
        self.n = len(values)
        self.low_bits = max(0, (top // max(1, self.n)).bit_length() - 1)
        low = values & np.uint64((1 << self.low_bits) - 1)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        at = high + np.arange(self.n)
        words = np.zeros(((top >> self.low_bits) + self.n) // 64 + 2, np.uint64)
        np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
        self.data = Mapped(words=words, ones=ones, low=pack(low, self.low_bits))

    def ones_before_zero(self, k: np.ndarray) -> np.ndarray:
        """How many values have a high part below k (the ones before the k-th zero, from 0 on at the start)."""
        zeros = 64 * np.arange(len(self.data.ones), dtype=np.int64) - self.data.ones
        word = np.searchsorted(zeros, k, side="left") - 1  # the last word with fewer than k zeros before it
        word = np.maximum(word, 0)
        left = k - zeros[word]
        bits = ~self.data.words[word]
        place = np.zeros(len(k), np.int64)
        # Halving: skip 32, 16, ... bits while they hold fewer zeros than are left.
        for width in (32, 16, 8, 4, 2, 1):
            some = np.bitwise_count((bits >> place.astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.int64)
            skip = some < left
            left = np.where(skip, left - some, left)
            place = np.where(skip, place + width, place)
        return np.where(k > 0, word * 64 + place + 1 - k, 0)

    def decoded(self, begin: int, end: int) -> np.ndarray:
        """The values at the places from ``begin`` to ``end``."""
        if begin >= end:
            return np.zeros(0, np.uint64)
        first, last = np.searchsorted(self.data.ones, [begin, end - 1], side="right") - 1
        bits = np.flatnonzero(np.unpackbits(self.data.words[first : last + 1].view(np.uint8), bitorder="little"))
        skip = begin - int(self.data.ones[first])
        places = np.arange(begin, end)
        high = (64 * first + bits[skip : skip + end - begin] - places).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | unpack(self.data.low, self.low_bits, places)

    def find(self, targets: np.ndarray) -> np.ndarray:
        """Places of the targets; -1 for those that aren't there. The successor of each is looked for among the values of its high part."""
        if not self.n:
            return np.full(len(targets), -1)
        high = (targets >> np.uint64(self.low_bits)).astype(np.int64)
        at, end = self.ones_before_zero(high), self.ones_before_zero(high + 1)
        want = targets & np.uint64((1 << self.low_bits) - 1)
        # The low parts of one high part ascend: halve the range until it is one place.
        last = end.copy()
        while len(live := np.flatnonzero(at < end)):
            middle = (at[live] + end[live]) >> 1
            less = unpack(self.data.low, self.low_bits, middle) < want[live]
            at[live[less]] = middle[less] + 1
            end[live[~less]] = middle[~less]
        inside = np.flatnonzero(at < last)
        hit = unpack(self.data.low, self.low_bits, at[inside]) == want[inside]
        found = np.full(len(targets), -1)
        found[inside[hit]] = at[inside[hit]]
        return found


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Values of so many bits each, end to end in uint64 words."""
    out = np.zeros(len(values) * bits // 64 + 2, np.uint64)
    if bits:
        at = np.arange(len(values), dtype=np.int64) * bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        np.bitwise_or.at(out, word, values << shift)
        over = shift + np.uint64(bits) > 64
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return out


def unpack(words: np.ndarray, bits: int, places: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(places), np.uint64)
    at = places.astype(np.int64) * bits
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return (low | high) & np.uint64((1 << bits) - 1)


def quantised(logs: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-logs / STEP), ABSENT - 1).astype(np.uint16)


def unquantised(codes: np.ndarray, absent: float) -> np.ndarray:
    return np.where(codes == ABSENT, absent, 10.0 ** (-STEP * codes))


def distances(codes: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """How far codes are below the expected ones, and of such distances the codes again; ABSENT stays."""
    return np.where(codes == ABSENT, ABSENT, (expected.astype(np.int32) + ABSENT - codes) % ABSENT).astype(np.uint16)


class Expected:
    """The codes that most n-grams have: of a follower seen once, and of the mass left by a word or pair with one follower.

    An answer holds ranks of distances from these, small numbers, as the codes themselves differ with how often the word or pair is seen.
    under and left_under: those codes beneath a pair, by the distance of the pair's own code, which tells how often it is seen.
    order: all distances, at first those of followers seen n times and of n followers, n from 1 on; rank: the place of each in it.
    """

    def __init__(self, discount: float):
        self.taken, self.given = max(1 - discount, 1e-8), max(discount, 1e-8)
        seen = np.rint(self.taken * 10.0 ** (STEP * np.arange(ABSENT + 1)) + discount)
        self.under, self.left_under = self.once(seen), self.left(seen)
        n = np.arange(1, 1 << 12)
        likely = np.rint(np.log10(np.stack((n, np.maximum((n - discount) / self.taken, 1)), 1)) / STEP).astype(np.int64)
        every = np.concatenate(([0, ABSENT], ((likely.reshape(-1, 1) + [0, -1, 1]) % ABSENT).ravel(), np.arange(ABSENT + 1)))
        self.order = every[np.sort(np.unique(every, return_index=True)[1])].astype(np.uint16)
        self.rank = np.empty(ABSENT + 1, np.uint32)
        self.rank[self.order] = np.arange(ABSENT + 1)

    @staticmethod
    @functools.cache
    def of(discount: float) -> Expected:
        return Expected(discount)

    def once(self, seen: np.ndarray) -> np.ndarray:
        return quantised(np.log10(self.taken / np.maximum(1, seen)))

    def left(self, seen: np.ndarray) -> np.ndarray:
        return quantised(np.log10(self.given / np.maximum(1, seen)))


@dataclass
class Level:
    """The children of all nodes of the level above.

    pointers: where each node's children begin, and at last their number; followers: the children, each
    with its parent's number in the bits above it, so that the sequence ascends; data: the quantised share of the child and the
    mass that its own children leave.
    """

    pointers: EliasFano
    followers: EliasFano
    data: Mapped  # code, rest

    @classmethod
    def build(cls, nodes: int, keys: np.ndarray, share: np.ndarray, left: np.ndarray) -> Level:
        """keys: the parent's number times 2**38 plus the follower, ascending."""
        begins = np.searchsorted(keys >> FOLLOWER_BITS, np.arange(nodes + 1, dtype=np.uint64))
        data = Mapped(code=quantised(np.log10(share)), rest=quantised(np.log10(np.maximum(left, 1e-8))))
        return cls(EliasFano(begins.astype(np.uint64), max(1, len(keys))), EliasFano(keys, max(1, nodes) << int(FOLLOWER_BITS)), data)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Place of each of some ascending keys, -1 where there is none: the successor among its parent's children.

        A window of keys after another: the pointers of its parents say which stretch to decode.
        """
        found = np.full(len(keys), -1)
        for at in range(0, len(keys), WINDOW):
            want = keys[at : at + WINDOW]
            parent = (want >> FOLLOWER_BITS).astype(np.int64)
            low = int(parent[0])
            pointers = self.pointers.decoded(low, int(parent[-1]) + 2).astype(np.int64)
            begin, end = pointers[parent - low], pointers[parent - low + 1]
            children = self.followers.decoded(int(pointers[0]), int(pointers[-1]))
            place = np.clip(np.searchsorted(children, want) + pointers[0], begin, end)
            inside = np.flatnonzero(place < end)
            hit = inside[children[place[inside] - pointers[0]] == want[inside]]
            found[at + hit] = place[hit]
        return found


@dataclass(frozen=True)
class Hot:
    """Words too frequent for one shard: hashes (ascending), training counts, and over how many shards each is spread.

    And pairs too frequent for one, whose first word is such a word: its place and the follower in one key (ascending), and the same figures.
    """

    words: np.ndarray
    counts: np.ndarray
    spread: np.ndarray
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    pair_counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    pair_spread: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @classmethod
    def of(cls, rows: list[tuple[int, int]], limit: int) -> Hot:
        words, counts = np.array([h for h, _ in rows], np.int64).view(np.uint64), np.array([c for _, c in rows], np.int64)
        order = np.argsort(words)
        return cls(words[order], counts[order], -(-counts[order] // limit))

    def place(self, words: np.ndarray) -> np.ndarray:
        """Place of each word; -1 where it isn't hot."""
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, -1)

    def seen(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The words' training counts, of hot words the whole ones, whatever a shard holds of them."""
        at = self.place(words)
        return np.where(at >= 0, self.counts[at], counts) if len(self.words) else counts

    def with_pairs(self, keys: list[int], counts: list[int], limit: int) -> Hot:
        order = np.argsort(np.array(keys, np.uint64))
        counts = np.array(counts, np.int64)[order]
        return replace(self, pairs=np.array(keys, np.uint64)[order], pair_counts=counts, pair_spread=-(-counts // limit))

    def pair_place(self, words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Place of each pair (ascending; place of its first word in ``words``, and follower); -1 where it isn't hot."""
        found = np.full(len(pairs), -1)
        if len(self.pairs) and len(pairs):
            first = self.words[(self.pairs >> FOLLOWER_BITS).astype(np.int64)]
            at = np.minimum(np.searchsorted(words, first), len(words) - 1)
            keys = (at.astype(np.uint64) << FOLLOWER_BITS) | (self.pairs & FOLLOWER)
            place = np.minimum(np.searchsorted(pairs, keys), len(pairs) - 1)
            hit = (words[at] == first) & (pairs[place] == keys)
            found[place[hit]] = np.flatnonzero(hit)
        return found


@dataclass
class Trie:
    """A shard: words, the words that follow each, and those that follow each pair."""

    words: EliasFano
    pairs: Level
    triples: Level
    data: Mapped  # counts; rest, of words that aren't hot

    @classmethod
    def build(cls, words: np.ndarray, counts: np.ndarray, pairs: np.ndarray, seen2: np.ndarray, triples: np.ndarray, seen3: np.ndarray, hot: Hot, discount: float, min_count: int) -> Trie:
        """pairs: number of the first word and follower; triples: number of the pair and follower; both ascending, with those never seen in training."""
        first, least = (pairs >> FOLLOWER_BITS).astype(np.int64), max(1, min_count)
        total = np.bincount(first, seen2, len(words))
        at = hot.place(words)
        total[at >= 0] = hot.counts[at[at >= 0]]
        # Of a hot pair a shard may hold some followers only.
        at = hot.pair_place(words, pairs)
        seen2 = np.where(at >= 0, hot.pair_counts[at], seen2) if len(hot.pairs) else seen2
        keep2, keep3 = seen2 >= least, seen3 >= least
        share2 = (seen2[keep2] - discount) / total[first[keep2]]
        kept = np.bincount(first[keep2], share2, len(words))
        under = (triples >> FOLLOWER_BITS).astype(np.int64)
        total = np.bincount(under, seen3, len(pairs))
        total[at >= 0] = hot.pair_counts[at[at >= 0]]
        share3 = (seen3[keep3] - discount) / total[under[keep3]]
        left2 = 1 - np.bincount(under[keep3], share3, len(pairs))
        # A triple isn't seen more often than its pair, so its pair is kept too.
        number = (np.cumsum(keep2) - 1).astype(np.uint64)
        keys3 = (number[under[keep3]] << FOLLOWER_BITS) | (triples[keep3] & FOLLOWER)
        data = Mapped(counts=counts.astype(np.int64), rest=quantised(np.log10(np.maximum(1 - kept, 1e-8))))
        level2, level3 = Level.build(len(words), pairs[keep2], share2, left2[keep2]), Level.build(int(keep2.sum()), keys3, share3, np.ones(len(share3)))
        return cls(EliasFano(words, 1 << 64), level2, level3, data)

    def codes(self, pairs: np.ndarray, triples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes and rests of ascending pairs, codes of ascending triples (number of the pair in ``pairs``, and follower)."""
        at = self.pairs.places(pairs)
        there = at >= 0
        code, rest, code3 = np.full(len(pairs), ABSENT, np.uint16), np.full(len(pairs), ABSENT, np.uint16), np.full(len(triples), ABSENT, np.uint16)
        code[there], rest[there] = self.pairs.data.code[at[there]], self.pairs.data.rest[at[there]]
        parent = at[(triples >> FOLLOWER_BITS).astype(np.int64)] if len(triples) else np.zeros(0, np.int64)
        asked = np.flatnonzero(parent >= 0)
        place = self.triples.places((parent[asked].astype(np.uint64) << FOLLOWER_BITS) | (triples[asked] & FOLLOWER))
        code3[asked[place >= 0]] = self.triples.data.code[place[place >= 0]]
        return code, rest, code3


@dataclass
class Block:
    """The distinct words (sorted hashes), pairs and triples (sorted keys) of some texts, and where each token's stand in them."""

    words: np.ndarray
    pairs: np.ndarray  # place of the first word, and follower
    triples: np.ndarray  # place of the pair, and follower
    token: np.ndarray
    pair: np.ndarray
    triple: np.ndarray  # -1 for the first of a text
    row: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Block:
        tokens = Tokens(texts)
        hashes = tokens.hashes()
        words, local = np.unique(np.concatenate((hashes, np.array([START, END]))), return_inverse=True)
        local = local[: len(hashes)].astype(np.int32)
        start, end = np.searchsorted(words, START), np.searchsorted(words, END)
        n = len(tokens.rows)
        token = np.empty(len(tokens.codes) + n, np.int32)
        row = np.repeat(np.arange(n, dtype=np.int32), tokens.rows + 1)
        is_end = np.zeros(len(token), bool)
        is_end[np.cumsum(tokens.rows + 1) - 1] = True
        token[is_end] = end
        token[~is_end] = local[tokens.codes]
        first = np.concatenate((np.ones(min(1, n), bool), is_end[:-1]))
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[first] = start
        follower = (words >> np.uint64(64 - int(FOLLOWER_BITS)))[token]
        pairs, pair = np.unique((before.astype(np.uint64) << FOLLOWER_BITS) | follower, return_inverse=True)
        later = np.flatnonzero(~first)
        triples, own = np.unique((pair[later - 1].astype(np.uint64) << FOLLOWER_BITS) | follower[later], return_inverse=True)
        triple = np.full(len(token), -1, np.int32)
        triple[later] = own
        return cls(words, pairs, triples, token, pair.astype(np.int32), triple, row)

    def follower_ranks(self, common: Common) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the pairs' and the triples' followers; each distinct word is looked up once."""
        rank = common.ranks(self.words >> np.uint64(64 - int(FOLLOWER_BITS)))[self.token]
        rank2, rank3 = np.empty(len(self.pairs), np.int32), np.empty(len(self.triples), np.int32)
        rank2[self.pair] = rank
        rank3[self.triple[self.triple >= 0]] = rank[self.triple >= 0]
        return rank2, rank3

    def first(self) -> np.ndarray:
        return (self.pairs >> FOLLOWER_BITS).astype(np.int64)

    def pair_homes(self, shards: int, hot: Hot) -> np.ndarray:
        """The shard that answers for each pair: its first word's, or by follower where that is hot."""
        first = self.first()
        where, at = shard_of(self.words, shards)[first], hot.place(self.words)[first]
        some = np.flatnonzero(at >= 0)
        part = (self.pairs[some] & FOLLOWER) % hot.spread[at[some]].astype(np.uint64) if len(some) else np.zeros(0, np.uint64)
        where[some] = shard_of(mix(self.words[first[some]] + part + np.uint64(1)), shards)
        return where

    def spread_triples(self, shards: int, hot: Hot) -> tuple[np.ndarray, np.ndarray]:
        """The triples of hot pairs, and the shard of each, by pair and follower."""
        parent = (self.triples >> FOLLOWER_BITS).astype(np.int64)
        at = hot.pair_place(self.words, self.pairs)[parent] if len(hot.pairs) else np.zeros(0, np.int64)
        some = np.flatnonzero(at >= 0)
        own = parent[some]
        part = (self.triples[some] & FOLLOWER) % hot.pair_spread[at[some]].astype(np.uint64) if len(some) else np.zeros(0, np.uint64)
        return some, shard_of(mix(mix(self.words[self.first()[own]] ^ (self.pairs[own] & FOLLOWER)) + part + np.uint64(1)), shards)

    def shares(self, shards: int, hot: Hot) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """What each shard gets, if anything: its number; places of words, their numbers of pairs, places of pairs, their numbers of triples, places of triples."""
        home, first, where = shard_of(self.words, shards), self.first(), self.pair_homes(shards, hot)
        order = np.argsort(where, kind="stable")
        begins, ends = np.searchsorted(where[order], np.arange(shards)), np.searchsorted(where[order], np.arange(shards), side="right")
        own = np.searchsorted(home, np.arange(shards + 1))
        parent = (self.triples >> FOLLOWER_BITS).astype(np.int64)
        children = np.bincount(parent, minlength=len(self.pairs))
        starts = np.cumsum(children) - children
        apart, away = self.spread_triples(shards, hot)
        children[parent[apart]] = 0
        for s in np.unique(np.concatenate((where, home, away))):
            pairs = order[begins[s] : ends[s]]
            counts = children[pairs]
            triples = np.repeat(starts[pairs] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            guests = apart[away == s]
            if len(guests):
                pairs, triples = np.union1d(pairs, parent[guests]), np.sort(np.concatenate((triples, guests)))
                counts = np.bincount(np.searchsorted(pairs, parent[triples]), minlength=len(pairs))
            words, parents = np.arange(own[s], own[s + 1]), first[pairs]
            if len(parents) and (parents[0] < own[s] or parents[-1] >= own[s + 1]):  # of hot words, at home elsewhere
                words = np.union1d(words, parents)
            yield int(s), words, np.bincount(np.searchsorted(words, parents), minlength=len(words)), pairs, counts, triples


def shard_of(words: np.ndarray, shards: int) -> np.ndarray:
    return ((words >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


@functools.cache
def compressor(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level)


def packed(*arrays: np.ndarray, level: int = 3) -> bytes:
    """Arrays in one piece. Whole numbers of more than 16 bits have as many bytes as the largest needs, byte by byte of all values.

    Each is compressed by itself, as its values are like each other; those of a piece under SMALL bytes are compressed together, as beginnings of streams would be most of it.
    """
    heads, parts = [], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        kind, used = b"p", a.itemsize
        if a.dtype != np.uint16 and a.dtype.kind in "iu" and a.itemsize > 1 and len(a) and a.min() >= 0:
            kind, used = b"w", max(1, (int(a.max()).bit_length() + 7) // 8)
        parts.append((np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize)[:, :used].T) if kind == b"w" else a).tobytes())
        heads.append(a.dtype.str.encode() + kind + bytes([used]) + len(a).to_bytes(5, "little"))
    parts = [b"".join(parts)] if sum(map(len, parts)) < SMALL else parts
    parts = [compressor(level).compress(part) for part in parts]
    return b"".join([bytes([len(arrays), len(parts)]), *heads, *(len(part).to_bytes(5, "little") for part in parts), *parts])


def unpacked(data: bytes) -> list[np.ndarray]:
    n, m = data[0], data[1]
    at, coder, parts, found = 2 + HEAD * n + 5 * m, zstandard.ZstdDecompressor(), [], []
    for k in range(m):
        begin = 2 + HEAD * n + 5 * k
        size = int.from_bytes(data[begin : begin + 5], "little")
        parts.append(coder.decompress(data[at : at + size]))
        at += size
    at = 0
    for k in range(n):
        head = data[2 + HEAD * k : 2 + HEAD * (k + 1)]
        dtype, kind, used, size = np.dtype(head[:3].decode()), head[3:4], head[4], int.from_bytes(head[5:], "little")
        plain = parts[k] if m == n else parts[0][at : at + used * size]
        at += used * size
        if kind == b"p":
            found.append(np.frombuffer(plain, dtype, size))
            continue
        wide = np.zeros((size, dtype.itemsize), np.uint8)
        wide[:, :used] = np.frombuffer(plain, np.uint8).reshape(used, size).T
        found.append(wide.reshape(-1).view(dtype))
    return found


class Common:
    """Followers that go by their rank instead of their hash."""

    def __init__(self, words: np.ndarray):
        """words: hashes, the most frequent first."""
        followers = words >> np.uint64(64 - int(FOLLOWER_BITS))
        self.table = followers[np.sort(np.unique(followers, return_index=True)[1])]
        self.rank = np.argsort(self.table)
        self.sorted = self.table[self.rank]

    def ranks(self, followers: np.ndarray) -> np.ndarray:
        """Rank of each; -1 where it isn't common."""
        if not len(self.table):
            return np.full(len(followers), -1, np.int32)
        at = np.minimum(np.searchsorted(self.sorted, followers), len(self.sorted) - 1)
        return np.where(self.sorted[at] == followers, self.rank[at], -1).astype(np.int32)

    def coded(self, followers: np.ndarray, ranks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits that tell the common ones, their ranks, and the others."""
        ranks = self.ranks(followers) if ranks is None else ranks
        common = ranks >= 0
        return np.packbits(common), ranks[common].astype(np.uint16), followers[~common]

    def decoded(self, n: int, bits: np.ndarray, ranks: np.ndarray, others: np.ndarray) -> np.ndarray:
        common, found = np.unpackbits(bits, count=n).astype(bool), np.empty(n, np.uint64)
        found[common] = self.table[ranks] if len(ranks) else ranks
        found[~common] = others
        return found


PIECE = 1 << 25
BLOCKS = "block bigint, body binary"
SENT = "shard bigint, block bigint, body binary"
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block and body: a task's rows of each block in a compressed piece, some PIECE bytes of text at a time."""
    def closed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).sort_by("block").combine_chunks()
        block = np.asarray(table.column("block"))
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(block)]))
        key, train, texts = table.column("doc_id").combine_chunks(), np.asarray(table.column("train"), dtype=bool), table.column("text").combine_chunks().cast(pa.large_string())
        ids, none = np.asarray(key.fill_null(0)), np.asarray(key.is_null())
        ends, data = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset), texts.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        bodies = [packed(ids[a:b], none[a:b].astype(np.uint8), train[a:b].astype(np.uint8), np.diff(ends[a : b + 1]), data[ends[a] : ends[b]], level=6) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]]), pa.array(bodies, pa.binary())], ["block", "body"])

    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            held.append(batch.slice(at, SLICE))
            size += held[-1].column("text").nbytes
            if size > PIECE:
                yield closed(held)
                held, size = [], 0
    if size or any(b.num_rows for b in held):
        yield closed(held)


def opened(bodies: list[bytes]) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Keys and texts of a block's pieces, and which of them are for training."""
    ids, none, train, sizes, data = (np.concatenate(c) for c in zip(*map(unpacked, bodies), strict=True))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    texts = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    return pa.array(ids, pa.int64(), mask=none.astype(bool)), texts.cast(pa.string()) if len(data) < 1 << 31 else texts, train.astype(bool)


def summed(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and sums of their counts; given out when more than HELD keys are there."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for k, c in parts:
        keys, at = np.unique(np.concatenate((keys, k)), return_inverse=True)
        counts = np.bincount(at, np.concatenate((counts, c)), len(keys)).astype(np.int64)
        if len(keys) > HELD:
            yield keys, counts
            keys, counts = keys[:0], counts[:0]
    yield keys, counts


def counted(texts: pa.Array, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Training counts of the texts' words, of ends and of starts."""
    tokens = Tokens(texts)
    counts = np.bincount(tokens.codes, train[tokens.row_of()], len(tokens.words)).astype(np.int64)
    words = np.concatenate((tokens.hashes(), np.array([END, START])))
    counts = np.concatenate((counts, np.full(2, train.sum())))
    return words[counts > 0], counts[counts > 0]


def often(sent: pa.Table) -> pa.Table:
    """A shard's words that are seen OFTEN times or more, then its tokens and kinds, starts left out."""
    words, counts = (np.concatenate(c) for c in zip(*(unpacked(x) for x in sent.column("body").to_pylist()), strict=True))
    words, at = np.unique(words, return_inverse=True)
    counts = np.bincount(at, counts, len(words)).astype(np.int64)
    own, some = words != START, counts >= OFTEN
    h = pa.array([*words[some].view(np.int64).tolist(), None], pa.int64())
    return pa.table({"h": h, "c": pa.array(np.append(counts[some], counts[own].sum())), "kinds": pa.array(np.append(np.zeros(some.sum(), np.int64), own.sum()))})


def lines(texts: pa.Array, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes; places in them of all training texts' starts, words and ends; which places of the line are ends."""
    tokens = Tokens(texts.filter(pa.array(train)))
    hashes = np.concatenate((tokens.hashes(), np.array([END, START])))
    line = np.full(len(tokens.codes) + 2 * len(tokens.rows), len(hashes) - 1)
    ends = np.cumsum(tokens.rows + 2) - 1
    line[ends] = len(hashes) - 2
    inner = np.ones(len(line), bool)
    inner[ends] = inner[ends - tokens.rows - 1] = False
    line[inner] = tokens.codes
    return hashes, line, ends


def hot_places(hashes: np.ndarray, line: np.ndarray, ends: np.ndarray, hot: Hot) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where hot words stand, each one's pair (place of the word, follower), and all followers of the hashes."""
    at = hot.place(hashes)[line]
    at[ends] = -1
    some, followers = np.flatnonzero(at >= 0), hashes >> np.uint64(64 - int(FOLLOWER_BITS))
    return some, (at[some].astype(np.uint64) << FOLLOWER_BITS) | followers[line[some + 1]], followers


def hot_pairs(texts: pa.Array, train: np.ndarray, hot: Hot) -> tuple[np.ndarray, np.ndarray]:
    """Place of the hot word and follower, in one key, and training counts."""
    return np.unique(hot_places(*lines(texts, train), hot)[1], return_counts=True)


def hot_triples(texts: pa.Array, train: np.ndarray, hot: Hot) -> tuple[np.ndarray, np.ndarray]:
    """Place of the hot pair and follower, in one key, and training counts."""
    hashes, line, ends = lines(texts, train)
    some, pairs, followers = hot_places(hashes, line, ends, hot)
    at = np.minimum(np.searchsorted(hot.pairs, pairs), len(hot.pairs) - 1)
    last = np.zeros(len(line), bool)
    last[ends] = True
    goes_on = (hot.pairs[at] == pairs) & ~last[some + 1]
    return np.unique((at[goes_on].astype(np.uint64) << FOLLOWER_BITS) | followers[line[some[goes_on] + 2]], return_counts=True)


KEPT = "owner int, kept double, followers array<bigint>, counts array<bigint>"


def kept_of(rows: pa.Table, totals: np.ndarray, common: Common, discount: float, min_count: int, limit: int) -> pa.Table:
    """The mass that a hot word or pair gives to the followers that stand here; those of them seen more than ``limit`` times."""
    followers, counts = [], []
    for body in rows.column("body").to_pylist():
        n, *rest, seen = unpacked(body)
        followers.append(common.decoded(int(n[0]), *rest))
        counts.append(seen)
    known, at = np.unique(np.concatenate(followers), return_inverse=True)
    seen = np.bincount(at, np.concatenate(counts))
    many = seen > limit
    owner, kept = rows.column("owner")[0].as_py(), seen[seen >= max(1, min_count)]
    found = [pa.array([a[many].astype(np.int64).tolist()], pa.list_(pa.int64())) for a in (known, seen)]
    return pa.table({"owner": pa.array([owner], pa.int32()), "kept": [float((kept - discount).sum() / totals[owner])], "followers": found[0], "counts": found[1]})


def send(block: pa.Table, shards: int, hot: Hot, common: Common) -> pa.Table:
    """What the block has of each shard it has something of."""
    _, texts, train = opened(block.column("body").to_pylist())
    b = Block.of(texts)
    learnt = train[b.row]
    counts = np.bincount(b.token, learnt, len(b.words)).astype(np.uint32)
    seen2 = np.bincount(b.pair, learnt, len(b.pairs)).astype(np.uint32)
    seen3 = np.bincount(b.triple[b.triple >= 0], learnt[b.triple >= 0], len(b.triples)).astype(np.uint32)
    del texts, learnt
    rank2, rank3 = b.follower_ranks(common)
    home, pair_home, sent = shard_of(b.words, shards), b.pair_homes(shards, hot), []
    for s, words, n2, pairs, n3, triples in b.shares(shards, hot):
        own = np.where(home[words] == s, counts[words], 0).astype(np.uint32)
        sent.append((s, packed(np.diff(b.words[words], prepend=np.uint64(0)), own, n2.astype(np.uint32), *common.coded(b.pairs[pairs] & FOLLOWER, rank2[pairs]), np.where(pair_home[pairs] == s, seen2[pairs], 0).astype(np.uint32), n3.astype(np.uint32), *common.coded(b.triples[triples] & FOLLOWER, rank3[triples]), seen3[triples])))
    number = block.column("block")[0].as_py()
    return pa.table({"shard": pa.array([s for s, _ in sent], pa.int64()), "block": pa.array([number] * len(sent), pa.int64()), "body": pa.array([x for _, x in sent], pa.binary())})


def answer(sent: pa.Table, hot: Hot, common: Common, discount: float, min_count: int) -> pa.Table:
    """The shard's trie is built from all blocks' rows, then asked for each n-gram once. Its codes go as ranks of their distances from the expected ones."""
    blocks = sent.column("block").to_pylist()
    rows = []
    for words, counts, n2, *coded2, seen2, n3, bits3, ranks3, others3, seen3 in map(unpacked, sent.column("body").to_pylist()):
        rows.append((np.cumsum(words), counts, n2, common.decoded(len(seen2), *coded2), seen2, n3, common.decoded(len(seen3), bits3, ranks3, others3), seen3))
    columns = list(zip(*rows, strict=True))
    words, counts, n2, follower2, seen2, n3, follower3, seen3 = (np.concatenate(c) for c in columns)
    sizes = [np.cumsum([0, *map(len, columns[k])]) for k in (0, 3, 6)]
    del rows, columns
    known, place = np.unique(words, return_inverse=True)
    pairs, back2 = np.unique((np.repeat(place, n2).astype(np.uint64) << FOLLOWER_BITS) | follower2, return_inverse=True)
    triples, back3 = np.unique((np.repeat(back2, n3).astype(np.uint64) << FOLLOWER_BITS) | follower3, return_inverse=True)
    trie = Trie.build(known, np.bincount(place, counts, len(known)), pairs, np.bincount(back2, seen2, len(pairs)), triples, np.bincount(back3, seen3, len(triples)), hot, discount, min_count)
    code2, rest2, code3 = trie.codes(pairs, triples)
    at = trie.words.find(known)[place]
    counts, rest1, code2, rest2, code3 = trie.data.counts[at], trie.data.rest[at], code2[back2], rest2[back2], code3[back3]
    del trie, pairs, triples, back2, back3
    expected, seen = Expected.of(discount), hot.seen(words, counts)
    far2 = distances(code2, np.repeat(expected.once(seen), n2))
    columns = counts, *(expected.rank[far] for far in (distances(rest1, expected.left(seen)), far2, distances(rest2, expected.left_under[far2]), distances(code3, np.repeat(expected.under[far2], n3))))
    bodies = []
    for k in range(len(blocks)):
        w, p, t = (slice(s[k], s[k + 1]) for s in sizes)
        bodies.append(packed(*(c[part] for c, part in zip(columns, (w, w, p, p, t), strict=True))))
    shard = sent.column("shard")[0].as_py()
    return pa.table({"shard": pa.array([shard] * len(blocks), pa.int64()), "block": pa.array(blocks, pa.int64()), "body": pa.array(bodies, pa.binary())})


def finish(block: pa.Table, answers: pa.Table, shards: int, hot: Hot, hot_rest: np.ndarray, pair_rest: np.ndarray, tokens: int, kinds: int, discount: float) -> pa.Table:
    """The scores of a block's texts."""
    if not block.num_rows:
        return pa.table({f: pa.array([], t) for f, t in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})
    keys, texts, train = opened(block.column("body").to_pylist())
    b = Block.of(texts)
    got = dict(zip(answers.column("shard").to_pylist(), answers.column("body").to_pylist(), strict=True))
    expected = Expected.of(discount)
    counts, far1 = np.zeros(len(b.words), np.int64), np.zeros(len(b.words), np.uint16)
    far2, under2, far3 = np.full(len(b.pairs), ABSENT, np.uint16), np.full(len(b.pairs), ABSENT, np.uint16), np.full(len(b.triples), ABSENT, np.uint16)
    home, pair_home = shard_of(b.words, shards), b.pair_homes(shards, hot)
    for s, words, _, pairs, _, triples in b.shares(shards, hot):
        c, *ranks = unpacked(got[s])
        f1, f2, u2, far3[triples] = (expected.order[r] for r in ranks)
        own = pair_home[pairs] == s
        far2[pairs[own]], under2[pairs[own]] = f2[own], u2[own]
        own = home[words] == s
        counts[words[own]], far1[words[own]] = c[own], f1[own]
    # A hot pair has the same distance in each shard that its followers are spread over, as its counts and its word's are the whole ones there.
    seen = hot.seen(b.words, counts)
    rest1, code2 = distances(far1, expected.left(seen)), distances(far2, expected.once(seen)[b.first()])
    rest2, code3 = distances(under2, expected.left_under[far2]), distances(far3, expected.under[far2[(b.triples >> FOLLOWER_BITS).astype(np.int64)]])
    del far1, far2, under2, far3, seen
    unigram = (counts + 1) / (tokens + kinds + 1)
    left1 = unquantised(rest1, 1.0)
    at = hot.place(b.words)
    left1[at >= 0] = hot_rest[at[at >= 0]]
    left2, at = unquantised(rest2, 1.0), hot.pair_place(b.words, b.pairs)
    left2[at >= 0] = pair_rest[at[at >= 0]]
    score = (unquantised(code2, 0.0))[b.pair] + left1[b.first()][b.pair] * unigram[b.token]
    later = np.flatnonzero(b.triple >= 0)
    score[later] = unquantised(code3, 0.0)[b.triple[later]] + left2[b.pair[later - 1]] * score[later]
    n = len(texts)
    return pa.table({
        "doc_id": keys, "held_out": pa.array(~train), "n_tokens": np.bincount(b.row, minlength=n), "n_known": np.bincount(b.row, counts[b.token] > 0, n).astype(np.int64),
        "train_tokens": np.full(n, tokens), "base_score": np.bincount(b.row, np.log10(unigram)[b.token], n), "score": np.bincount(b.row, np.log10(score), n),
    })


def score(docs: DataFrame, train: Column, *, key: str = "doc_id", text: str = "text", block_chars: int = 6 << 20, discount: float = 0.75, min_count: int = 2, hot_tokens: int = 1 << 20) -> DataFrame:
    """Scores of every row, from a model of the rows where ``train`` holds.

    held_out: ``train`` doesn't hold (a null counts as true); n_tokens: words
    and one end; n_known: those with a training count; train_tokens: all in
    training; base_score: add-one unigram; score: the smoothed model. A null text is
    empty; an empty table gives none. Other columns are dropped.

    Blocks go by a hash of key and text and have about ``block_chars`` bytes. Words with more than ``hot_tokens``
    occurrences in training, or a millionth of all, are spread over shards; so
    those that go to every task are at most MOST_HOT. Pairs with as many are spread by what follows them. The mass that such
    a word or pair leaves is summed up beforehand, since no shard sees all its followers.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-chars // block_chars))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                yield batch.column("text"), np.asarray(batch.column("train"), dtype=bool)

    texts = rows.select("text", "train")

    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, c in summed(counted(*part) for part in parts(batches)):
            at = np.searchsorted(shard_of(h, shards), np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(at)):
                part = slice(at[s], at[s + 1])
                yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int64()), pa.array([packed(h[part], c[part])], pa.binary())], ["shard", "body"])

    # The words that are seen often, and in a row without a word what each shard has of tokens and of kinds.
    seen = cut(texts.mapInArrow(counting, "shard bigint, body binary").groupBy("shard").applyInArrow(often, "h bigint, c bigint, kinds bigint"))
    tokens, kinds = seen.where("h is null").agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    limit = max(hot_tokens, tokens // MOST_HOT)
    hot = Hot.of([(r.h, r.c) for r in seen.where(F.col("h").isNotNull() & (F.col("c") > limit)).collect()], limit)
    # As many of the most frequent words as fit, by steps of a tenth in frequency.
    step = F.floor(F.log2("c") * 8)
    steps, least = sorted(((r.s, r.n) for r in seen.where("h is not null").groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True), None
    for total, (s, _) in zip(itertools.accumulate(n for _, n in steps), steps, strict=True):
        least = s if total <= COMMON else least
    frequent = seen.where(F.col("h").isNotNull() & (step >= least)).collect() if least is not None else []
    common = Common(np.array([r.h for r in sorted(frequent, key=lambda r: (-r.c, r.h))], np.int64).view(np.uint64))
    spark = docs.sparkSession.sparkContext

    def left(found: Callable[[pa.Array, np.ndarray, Hot], tuple[np.ndarray, np.ndarray]], totals: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, list]:
        """The mass that each owner, a hot word or pair, leaves; its followers seen more than ``limit`` times."""
        held = spark.broadcast((hot, common, totals, spread))

        def dealing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hot, common, _, spread = held.value
            for keys, counts in summed(found(*part, hot) for part in parts(batches)):
                owner, follower = (keys >> FOLLOWER_BITS).astype(np.int64), keys & FOLLOWER
                part = (follower % spread[owner].astype(np.uint64)).astype(np.int64)
                order = np.lexsort((follower, part, owner))
                cuts = np.flatnonzero(np.diff(owner[order]) | np.diff(part[order])) + 1
                for own in np.split(order, cuts) if len(order) else ():
                    data = packed(np.array([len(own)]), *common.coded(follower[own]), counts[own])
                    yield pa.RecordBatch.from_arrays([pa.array([int(owner[own[0]])], pa.int32()), pa.array([int(part[own[0]])], pa.int64()), pa.array([data], pa.binary())], ["owner", "part", "body"])

        rest, many = np.ones(len(totals)), []
        if len(totals):
            kept = cut(texts.mapInArrow(dealing, "owner int, part bigint, body binary").groupBy("owner", "part").applyInArrow(lambda table: kept_of(table, held.value[2], held.value[1], discount, min_count, limit), KEPT))
            for r in kept.groupBy("owner").agg(F.sum("kept").alias("kept")).collect():
                rest[r.owner] = max(1 - r.kept, 1e-8)
            many = kept.select("owner", F.explode(F.arrays_zip("followers", "counts")).alias("f")).select("owner", "f.followers", "f.counts").collect()
        return rest, many

    hot_rest, many = left(hot_pairs, hot.counts, hot.spread)
    hot = hot.with_pairs([(r.owner << int(FOLLOWER_BITS)) | r.followers for r in many], [r.counts for r in many], limit)
    pair_rest, _ = left(hot_triples, hot.pair_counts, hot.pair_spread)
    held, rest = spark.broadcast((hot, common)), spark.broadcast((hot_rest, pair_rest))

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)))
    blocks = dealt.mapInArrow(pieces_of, BLOCKS).groupBy("block")
    sent = blocks.applyInArrow(lambda table: send(table, shards, *held.value), SENT)
    answers = sent.groupBy("shard").applyInArrow(lambda table: answer(table, *held.value, discount, min_count), SENT)
    return blocks.cogroup(answers.groupBy("block")).applyInArrow(lambda block, found: finish(block, found, shards, held.value[0], *rest.value, tokens, kinds, discount), SCORES)
