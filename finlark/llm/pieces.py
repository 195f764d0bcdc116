"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Normaliser, pieces and byte fallback are compiled from a model file:

- the normaliser: longest-match replacements of its character map, its space
  rules, and the symbols that it leaves as they are;
- the pieces: states of a prefix tree, an arc back to its root at each piece's end;
- byte fallback: an arc for each other character, with its bytes as output.

A text is composed with them lazily. States of the composition are (place in
the text, piece just read); the arcs from one are the pieces that begin at its
place, and one routine relaxes them in order of the places, which is a
shortest path in the tropical semiring (least sum), for both kinds of models:

- unigram: an arc weighs the negative score of its piece, whatever came before,
  so that the state needs no piece;
- BPE: an arc weighs nothing if the merge rules keep the last piece and the
  new one apart when they alone stand side by side, and is infinite if not.
  Merges inside a text go as inside each pair of neighbours of its result, so
  exactly one path has a finite weight: the one that merging would give.

So one state a place suffices for both. Where no piece of a BPE model holds a space mark after
another character, a text falls into chunks, each with its leading marks, that
are solved once and looked up after. Unigram texts are solved whole, since
sums of single precision, all that came before included, decide between equals.
"""

from __future__ import annotations

import functools
import math
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from finlark.llm.common import map_batches, with_fields

MARK = "▁"
NEVER = math.inf
CACHE, PAIRS = 100_000, 1_000_000
UNKNOWN_PENALTY = 10.0  # a fixed value of unigram models: what an unknown character scores under the least piece


FLOAT = struct.Struct("f")


def single(x: float) -> float:
    """Rounded as sums of unigram scores are, which decides between equals."""
    return FLOAT.unpack(FLOAT.pack(x))[0]


def character_map(data: bytes) -> dict[str, str]:
    """The replacements of a compiled character map: a double array of the keys' UTF-8 bytes, then the values, each ended by a zero byte."""
    if not data:
        return {}
    size = int.from_bytes(data[:4], "little")
    units = np.frombuffer(data[4 : 4 + size], "<u4").astype(np.int64)
    values = data[4 + size :]
    shift = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
    places, keys, found = shift(units[:1]), [b""], {}
    letters = np.arange(1, 256)
    while len(places):
        there = places[:, None] ^ letters
        held = units[np.minimum(there, len(units) - 1)]
        row, column = np.nonzero((there < len(units)) & ((held & (1 << 31 | 255)) == letters))
        held, there = held[row, column], there[row, column]
        places = there ^ shift(held)
        keys = [keys[r] + bytes([c + 1]) for r, c in zip(row, column, strict=True)]
        for k in np.flatnonzero((held >> 8) & 1):
            at = int(units[places[k]] & ((1 << 31) - 1))
            found[keys[k].decode()] = values[at : values.index(b"\0", at)].decode()
    return found


class Normaliser:
    """The first transducer: a text as the pieces read it."""

    def __init__(self, spec, symbols: list[str]):
        self.map = character_map(spec.precompiled_charsmap)
        self.collapse, self.dummy = spec.remove_extra_whitespaces, spec.add_dummy_prefix
        self.mark = MARK if spec.escape_whitespaces else " "
        self.longest: dict[str, int] = {}
        for key in self.map:
            self.longest[key[0]] = max(len(key), self.longest.get(key[0], 0))
        self.first = re.compile("[" + "".join(map(re.escape, sorted(self.longest))) + "]") if self.map else None
        self.symbols = re.compile("|".join(map(re.escape, sorted(symbols, key=lambda x: (-len(x), x))))) if symbols else None
        self.simple = not self.map and not self.collapse and not symbols

    def mapped(self, text: str) -> str:
        """The longest key at each place replaced."""
        if not self.map:
            return text
        out, at = [], 0
        for m in self.first.finditer(text):
            i = m.start()
            for n in range(min(self.longest[text[i]], len(text) - i) if i >= at else 0, 0, -1):
                value = self.map.get(text[i : i + n])
                if value is not None:
                    out += [text[at:i], value]
                    at = i + n
                    break
        return "".join([*out, text[at:]])

    def __call__(self, text: str) -> str:
        if self.symbols is None:
            made = self.mapped(text)
        else:
            out, at = [], 0
            for m in self.symbols.finditer(text):
                out += [self.mapped(text[at : m.start()]), m[0]]
                at = m.end()
            made = "".join([*out, self.mapped(text[at:])])
        if self.collapse:
            made = re.sub(" +", " ", made).lstrip(" ")
        if not made:
            return ""
        made = (self.mark if self.dummy else "") + made.replace(" ", self.mark)
        return made.rstrip(self.mark) if self.collapse else made


class Transducer:
    """The compiled model. ``encode`` and ``decode`` are exact; the Arrow forms work on columns.

    Models of whole words or single characters, and those with the space mark at words' ends, raise ValueError.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type not in (pb.TrainerSpec.BPE, pb.TrainerSpec.UNIGRAM) or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("neither a BPE nor a unigram model, or one with marks behind words")
        kinds = pb.ModelProto.SentencePiece
        self.bpe = model.trainer_spec.model_type == pb.TrainerSpec.BPE
        symbols = [p.piece for p in model.pieces if p.type == kinds.USER_DEFINED]
        self.normal = Normaliser(model.normalizer_spec, symbols)
        self.dummy, self.mark = self.normal.dummy, self.normal.mark
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        # Merges never cross a symbol of the user's; a unigram path always prefers it.
        self.frozen = frozenset(symbols) if self.bpe else frozenset()
        self.rank = {p: -model.pieces[i].score for p, i in self.ids.items() if p not in self.frozen}
        normal = [p.score for p in model.pieces if p.type == kinds.NORMAL]
        top, low = max(normal, default=0.0), min(normal, default=0.0)
        self.cost = {p: -model.pieces[i].score for p, i in self.ids.items()} | {p: 0.1 - len(p.encode()) * max(top, 0.0) for p in symbols}
        self.unknown_cost = single(UNKNOWN_PENALTY - low)
        self.bytes = [self.unknown] * 256
        self.out: list[bytes] = []
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
                self.out.append(bytes([int(p.piece[3:5], 16)]))
            else:
                self.out.append(b"" if p.type == kinds.CONTROL else " ⁇ ".encode() if p.type == kinds.UNKNOWN else p.piece.replace(MARK, " ").encode())
        self.byte_fallback = model.trainer_spec.byte_fallback
        self.tree: dict = {}
        for p in self.ids:
            node = self.tree
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        self.breaks = not any("\n" in p for p in self.ids)
        inner = any(self.mark in p.lstrip(self.mark) for p in self.ids)
        self.chunk = None if inner or not self.bpe else re.compile(rf"(?s)(?:{self.mark}+|.)[^{self.mark}{chr(10) if self.breaks else ''}]*")
        self.pairs: dict[str, dict[str, bool]] = {}
        self.held = 0
        self.known: dict[str, list[int]] = {}

    def merged(self, text: str) -> list[str]:
        """What the merge rules make of a short text: the best pair first, then the leftmost."""
        parts, rank = list(text), self.rank
        ranks = [rank.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < NEVER:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] + parts[i], NEVER)
            if i < len(ranks):
                ranks[i] = rank.get(parts[i] + parts[i + 1], NEVER)
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether the merge rules leave the two as they are; ``left`` is empty before the first piece."""
        row = self.pairs.setdefault(left, {})
        known = row.get(right)
        if known is None:
            if self.held >= PAIRS:
                self.pairs, self.held = {left: row}, 0
                row.clear()
            known = row[right] = self.merged(left + right) == ([left, right] if left else [right])
            self.held += 1
        return known

    def path(self, chunk: str) -> list[str]:
        """The pieces of the shortest path; of equals, place by place, the one whose last piece is longest."""
        n, bpe = len(chunk), self.bpe
        weights, came = [NEVER] * (n + 1), [""] * (n + 1)
        weights[0] = 0.0
        for at in range(n):
            weight = weights[at]
            if weight == NEVER:
                continue
            node, end, only = self.tree, at, True
            row = self.pairs.setdefault(came[at], {}) if bpe else None
            while end < n and (node := node.get(chunk[end])) is not None:
                end += 1
                piece = node.get("")
                if piece is None:
                    continue
                only = only and end > at + 1
                if bpe:
                    fits = row.get(piece)
                    if fits if fits is not None else self.fits(came[at], piece):
                        weights[end], came[end] = weight, piece
                elif (candidate := single(weight + self.cost[piece])) < weights[end]:
                    weights[end], came[end] = candidate, piece
            if only:  # an unknown character
                piece, end = chunk[at], at + 1
                if bpe:
                    if self.fits(came[at], piece):
                        weights[end], came[end] = weight, piece
                elif (candidate := single(weight + self.unknown_cost)) < weights[end]:
                    weights[end], came[end] = candidate, piece
        found, at = [], n
        while at:
            found.append(came[at])
            at -= len(came[at])
        return found[::-1]

    def encode_chunk(self, chunk: str) -> list[int]:
        ids = self.known.get(chunk)
        if ids is None:
            ids = []
            for piece in [chunk] if chunk in self.frozen else self.path(chunk):
                i = self.ids.get(piece)
                ids += [i] if i is not None else [self.bytes[b] for b in piece.encode()] if self.byte_fallback else [self.unknown]
            if self.chunk is not None:
                if len(self.known) >= CACHE:
                    self.known.clear()
                self.known[chunk] = ids
        return ids

    def split(self, text: str) -> list[str]:
        """Chunks of a text: runs of marks, or one character, with what follows; a line break begins a chunk if no piece holds one."""
        text = self.normal(text)
        parts = [text] if text else []
        if self.frozen and text:
            cuts = [x for m in self.normal.symbols.finditer(text) for x in m.span()]
            parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True) if a < b]
        return parts if self.chunk is None else [c for p in parts for c in ([p] if p in self.frozen else self.chunk.findall(p))]

    def encode(self, text: str) -> list[int]:
        ids = [i for c in self.split(text) for i in self.encode_chunk(c)]
        return ids if self.byte_fallback else [i for k, i in enumerate(ids) if i != self.unknown or not k or ids[k - 1] != i]

    def stripped(self, data: bytes) -> bytes:
        return data.lstrip(b" ") if self.normal.collapse else data.removeprefix(b" ") if self.dummy else data

    def decode(self, ids: list[int]) -> str:
        return self.stripped(b"".join(self.out[i] for i in ids)).decode(errors="replace")

    def encode_column(self, texts: pa.Array) -> pa.ListArray:
        """list<int32> of each text; nulls count as empty."""
        texts = texts.fill_null("")
        if not self.normal.simple or self.chunk is None or self.mark != MARK or not self.byte_fallback:
            return pa.array([self.encode(t) for t in texts.to_pylist()], pa.list_(pa.int32()))
        plain = pc.invert(pc.match_substring_regex(texts, "  |\x00|▁|^ | $| \n|^$|\r"))
        easy, hard = np.flatnonzero(np.asarray(plain)), np.flatnonzero(~np.asarray(plain))
        # In plain texts every space begins one chunk; \x00 marks those that begin with a line break.
        lines = pc.replace_substring(texts.take(pa.array(easy)), "\n", " \x00\n") if self.breaks else texts.take(pa.array(easy))
        parts = pc.split_pattern(lines, " ")
        counts, coded = [np.diff(np.asarray(parts.offsets))], parts.flatten().dictionary_encode()
        words = [w[1:] if w[:1] == "\x00" else MARK + w for w in coded.dictionary.to_pylist()]
        if not self.dummy:  # the first chunk of a text has no mark
            firsts = np.cumsum(counts[0]) - counts[0]
            raw = coded.dictionary.to_pylist()
            codes = np.asarray(coded.indices).copy()
            codes[firsts] = len(words) + np.arange(len(firsts))
            words += [raw[c] for c in np.asarray(coded.indices)[firsts]]
        else:
            codes = np.asarray(coded.indices)
        more, sizes = [], []
        for i in hard:
            chunks = self.split(texts[int(i)].as_py())
            sizes.append(len(chunks))
            more += range(len(words), len(words) + len(chunks))
            words += chunks
        codes = np.concatenate((codes, np.asarray(more, codes.dtype)))
        counts = np.concatenate((*counts, np.asarray(sizes, np.int64)))
        lists = [self.encode_chunk(w) for w in words]
        table = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32), pa.array([i for x in lists for i in x], pa.int32()))
        taken = table.take(pa.array(codes, pa.int32()))
        ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
        offsets = np.asarray(taken.offsets)[ends] - taken.offsets[0].as_py()
        inner = taken.flatten()
        made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)
        back = np.empty(len(texts), np.int64)
        back[np.concatenate((easy, hard))] = np.arange(len(texts))
        return made.take(pa.array(back))

    def decode_column(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list; nulls give empty texts."""
        offsets = np.asarray(ids.offsets)
        flat = pa.array(self.out, pa.binary()).take(ids.values.slice(offsets[0], offsets[-1] - offsets[0]))
        lists = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), flat)
        joined = pc.binary_join(lists, b"")
        return pa.array([self.stripped(v or b"").decode(errors="replace") for v in joined.to_pylist()], pa.string())


@functools.cache
def compiled(path: str) -> Transducer:
    return Transducer(path)


def encode(docs: DataFrame, model: str, *, text: str = "text") -> DataFrame:
    """Every row with ids, n_tokens and round_trip (decoding gives the text back).

    A null text is empty and has no ids. Columns of those names are replaced.
    ``model``: path of a model file that all executors can read.
    """
    rest = docs.drop("ids", "n_tokens", "round_trip")

    def run(batch: pa.RecordBatch) -> pa.Table:
        coder = compiled(model)
        texts = batch.column(text)
        ids = coder.encode_column(texts)
        same = pc.equal(coder.decode_column(ids), texts.cast(pa.string()).fill_null(""))
        out = pa.Table.from_batches([batch]).append_column("ids", ids)
        return out.append_column("n_tokens", pc.list_value_length(ids).cast(pa.int64())).append_column("round_trip", same)

    return map_batches(rest, run, with_fields(rest, "ids array<int>, n_tokens bigint, round_trip boolean"))


def decode(rows: DataFrame, model: str, *, ids: str = "ids") -> DataFrame:
    """Every row with ``decoded``, the text of its ids; a column of that name is replaced."""
    rest = rows.drop("decoded")

    def run(batch: pa.RecordBatch) -> pa.Table:
        return pa.Table.from_batches([batch]).append_column("decoded", compiled(model).decode_column(batch.column(ids)))

    return map_batches(rest, run, with_fields(rest, "decoded string"))
