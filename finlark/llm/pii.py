"""Personal data: candidates, gradient-boosted trees and calibrated thresholds.

Exact rules find the base spans. High-recall generators propose further,
overlapping spans; for each kind boosted trees judge a proposal by its format
and the words around it. They are trained here, on a bounded sample of the
corpus in which base spans are rewritten into forms that the rules miss: those
are right, and what else is proposed beside base spans is wrong. On texts held
back a threshold is set for each kind at which nearly all that is selected is
right. What passes and overlaps no base span is added.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finlark.llm.common import least_hashes, map_batches, with_fields

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DASHES = "‐‑‒–—―-"
NUMBERS = re.compile(rf"[0-9][0-9()./_|·•\s{DASHES}]*[0-9]")
GROUP = re.compile("[0-9]+")
LEFT, RIGHT, OTHERS = r"[(\[{<]\x20?", r"\x20?[)\]}>]", r"[^\s@＠<>()\[\]{}]"
# Written out, in brackets or, where a written dot follows, bare; spaced; plain.
AT = re.compile(rf"\x20?{LEFT}(?:at|AT|@){RIGHT}\x20?|\x20(?:at|AT)\x20(?={OTHERS}+\x20(?:dot|DOT)\x20)|\x20@\x20|[@＠]")
DOT = rf"\x20?{LEFT}(?:dot|DOT|\.){RIGHT}\x20?|\x20(?:dot|DOT)\x20"
DOTS = re.compile(rf"{DOT}|\.")
DOTTED = re.compile(rf"{OTHERS}+(?:(?:{DOT}){OTHERS}+)*")
OUTSIDE = re.compile(r"[\s@＠<>()\[\]{}]")
BETWEEN = rf"(?:{DOT}|\x20\.\x20|[-,:_/|·•])"
ADDRESSES = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:{BETWEEN}[0-9]{{1,3}}){{3}}(?![0-9])")
SOME = r"[0-9@\x{ff20}]|[(\[{<] ?(at|AT) ?[)\]}>]| (at|AT) \S+ (dot|DOT) "  # a text without it has no proposals; for Arrow
DIGITS = re.compile("[0-9]")
LAST_WORD = re.compile(r"([a-z]+)[^a-z]*$")
FEWEST, MOST = 7, 19  # digits of a number


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain.tld, found from each @ so that long runs without one cost nothing."""
    done = floor = 0
    for m in DOMAIN.finditer(text):
        begin = max(done, floor)
        start = begin + len(text[begin : m.start()].rstrip(LOCAL))
        floor = m.start() + 1
        if start < m.start():
            done = m.end()
            yield start, m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end), ordered so. A match that fails its kind's test is dropped, with no other try."""
    found = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if DIGITS.search(text):
        found += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
        if "+" in text:
            found += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return found


def numbers(text: str) -> Iterator[tuple[int, int]]:
    """In each run of digits and separators all stretches of groups with FEWEST to MOST digits, with a bracket or + before them."""
    for run in NUMBERS.finditer(text):
        groups = [m.span() for m in GROUP.finditer(text, *run.span())]
        for i, (start, _) in enumerate(groups):
            digits = 0
            begin = start - (start > 0 and text[start - 1] in "+(")
            for a, b in groups[i : i + MOST]:
                digits += b - a
                if digits > MOST:
                    break
                if digits >= FEWEST:
                    yield begin, b


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """What stands around an @, plain, spaced or written out; dots written out too."""
    floor = 0
    for m in AT.finditer(text):
        before = text[floor : m.start()]
        own = OUTSIDE.split(before)[-1]
        after = DOTTED.match(text, m.end())
        floor = m.end()
        if own and after and len(after[0]) > 2:
            yield m.start() - len(own), after.start() + len(after[0].rstrip(".,;:!?"))


def proposals(text: str) -> list[tuple[int, int]]:
    """Spans that may hold personal data, overlapping ones too."""
    found = {*numbers(text), *(m.span() for m in ADDRESSES.finditer(text))} if DIGITS.search(text) else set()
    return sorted(found | set(addresses(text)))


class Taken:
    """Stretches of a text, to ask whether another overlaps one."""

    def __init__(self, spans: Iterable[tuple[int, int]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        return bisect.bisect_right(self.ends, a) < bisect.bisect_left(self.starts, b)

    def take(self, a: int, b: int) -> None:
        """One that overlaps none."""
        at = bisect.bisect_left(self.starts, a)
        self.starts.insert(at, a)
        self.ends.insert(at, b)


def rewritten(text: str, base: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with personal data in forms that the rules miss, and where it is.

    Phones lose their + and often the country code, cards and phones get other separators, @ becomes [at] or (at), the dots of IPs
    get brackets, spaces or become something else. The span's own hash picks the form. Spans that overlap others stay as they are.
    """
    out, found, at, size = [], [], 0, 0
    spans = sorted((a, b, k) for k, a, b in base)
    for n, (a, b, k) in enumerate(spans):
        if any(a < y and x < b for x, y, _ in spans[max(0, n - 3) : n] + spans[n + 1 : n + 4]):
            continue
        span, pick = text[a:b], zlib.crc32(f"{a} {text[a:b]}".encode())
        groups = re.findall("[0-9]+", span)
        if k == 0:
            new = span.replace("@", ("[at]", " [at] ", "(at)", " (at) ")[pick % 4])
            new = new.replace(".", ("[dot]", " (dot) ")[pick // 8 % 2]) if pick // 4 % 2 else new
        elif k == 1:
            new = ("[.]", "(.)", " . ", "[dot]", "-", ",")[pick % 6].join(groups)
        elif k == 2:
            digits = "".join(groups)
            new = (".", "/", " - ", " / ")[pick % 4].join(digits[i : i + 4] for i in range(0, len(digits), 4))
        else:
            short = len(groups[0]) <= 3 and len("".join(groups[1:])) >= 8 and pick % 3 > 0
            if pick // 3 % 5 == 0:
                new = span[1 + len(groups[0]) * short :].lstrip(" .-)")
            else:
                new = (".", "-", " ", "/")[pick // 3 % 5 - 1].join(groups[short:])
        out += [text[at:a], new]
        size += a - at
        found.append((k, size, size + len(new)))
        size += len(new)
        at = b
    return "".join([*out, text[at:]]), found


def possible(kind: int, span: str) -> bool:
    """What the kind's rule asks of the digits holds."""
    digits = re.sub("[^0-9]", "", span)
    if kind == 1:
        parts = GROUP.findall(span)
        return len(parts) == 4 and all(int(p[:9]) <= 255 for p in parts)
    return kind == 0 or (16 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 8 <= len(digits) <= 15)


CUES = ("mail", "call", "phone", "tel", "card", "visa", "pay", "ip", "host", "addr", "contact", "fax", "no", "id", "token", "password")


def features(text: str, start: int, end: int) -> list[float]:
    """Format of the span, then of its surroundings. Separators count by class, so that one never seen in training is known by its like."""
    span = text[start:end]
    digits = re.sub("[^0-9]", "", span)
    groups = re.findall("[0-9]+", span)
    before = DIGITS.split(text[max(0, start - 24) : start].lower())[-1]  # what stands before an earlier number speaks for that
    ats = list(AT.finditer(span))
    plain = sum(m[0] in "@\uff20" for m in ats)
    tail = DOTS.split(span[ats[-1].end() :] if ats else span)
    blanks, dashes = sum(map(str.isspace, span)), sum(c in DASHES for c in span)
    marks = sum(not c.isalnum() for c in span) - blanks - dashes - sum(c in "()[]{}<>+@\uff20" for c in span)
    word = LAST_WORD.search(before)
    return [
        len(span), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0,
        marks, dashes, blanks, span.count("("), float(span[0] == "+"), plain, float(len(ats) > plain),
        sum(c.isalpha() for c in span), len(tail) - 1, len(tail[-1]), max((int(g[:9]) for g in groups), default=0), float(digits[:1] or -1),
        float(before[-1:].isalnum()), float(text[end : end + 1].isalnum()), float(before[-1:] in "=:\"'"), float(zlib.crc32(word[1].encode()) % 97 if word else -1), float(len(word[1]) if word else 0), *[float(c in before) for c in CUES],
    ]


@dataclass
class Boosted:
    """Logistic gradient boosting over trees of fixed depth on binned features."""

    rounds: int = 40
    depth: int = 3
    rate: float = 0.3
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    start: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 31))) for c in x.T]
        binned = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)], axis=1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        raw = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p) + 1e-9
            node = np.zeros(len(y), np.int64)
            inner = 2**self.depth - 1
            which, at = np.zeros(inner, np.int64), np.full(inner, np.inf)
            for n in range(inner):
                own = node == n
                best = 1e-6
                for f, c in enumerate(cuts):
                    sg, sh = np.bincount(binned[own, f], g[own], len(c) + 1), np.bincount(binned[own, f], h[own], len(c) + 1)
                    lg, lh = np.cumsum(sg)[:-1], np.cumsum(sh)[:-1]
                    if not len(lg):
                        continue
                    gain = lg**2 / (lh + 1) + (sg.sum() - lg) ** 2 / (sh.sum() - lh + 1) - sg.sum() ** 2 / (sh.sum() + 1)
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, which[n], at[n] = gain[k], f, c[k]
                node[own] = 2 * n + 1 + (x[own, which[n]] > at[n])
            leaf = node - inner
            value = self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
            self.trees.append((which, at, value))
            raw += value[leaf]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for which, at, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), which[node]] > at[node])
            total += value[node - len(which)]
        return total


def beside(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Proposals that overlap no base span."""
    taken = Taken((a, b) for _, a, b in base)
    return [(a, b) for a, b in proposals(text) if not taken.meets(a, b)]


@dataclass(frozen=True)
class PiiModel:
    """Trees and threshold by kind; a kind with too few examples has none and adds nothing."""

    kinds: dict[int, tuple[Boosted, float]]

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Further spans; of those that overlap the longest, of these the surest."""
        if not self.kinds:
            return []
        free = [(a, b) for a, b in beside(text, base) if any(possible(k, text[a:b]) for k in self.kinds)]
        if not free:
            return []
        x = np.array([features(text, a, b) for a, b in free])
        sure = sorted(((a - b, -float(r - bound), k, a, b) for k, (trees, bound) in self.kinds.items() for r, (a, b) in zip(trees.raw(x), free, strict=True) if r >= bound and possible(k, text[a:b])))
        found: list[tuple[int, int, int]] = []
        taken = Taken()
        for _, _, k, a, b in sure:
            if not taken.meets(a, b):
                taken.take(a, b)
                found.append((k, a, b))
        return sorted(found)


def calibrated(raw: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least bound from which on, counted from the top, at least ``precision`` are right: midway between two scores; infinite if none."""
    order = np.argsort(-raw)
    sorted_ = raw[order]
    share = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(sorted_[1:] < sorted_[:-1], True)  # of equal scores
    good = np.flatnonzero((share >= precision) & last & (np.arange(1, len(y) + 1) >= 10))
    if not len(good):
        return float("inf")
    at = good[-1]
    return float(sorted_[at] if at + 1 == len(y) else (sorted_[at] + sorted_[at + 1]) / 2)


def fit(docs: DataFrame, *, text: str = "text", max_docs: int = 4096, max_wrong: int = 64, precision: float = 0.995, least: int = 20) -> PiiModel:
    """Trees from the proposals in at most ``max_docs`` different texts with a digit or an @, those that hash least.

    A row of features comes to the driver for each right proposal, and for at most ``max_wrong`` wrong ones a text, picked by a hash. A kind with fewer than
    ``least`` right or wrong examples gets no trees. One text in three is held back for the thresholds.
    """
    rows = docs.select(F.col(text).alias("text")).where(F.col("text").rlike("[0-9@]")).withColumn("h", F.xxhash64("text"))
    last = least_hashes(rows.select("h").distinct(), "h", max_docs).agg(F.max("h")).first()[0]
    picked = rows.where(F.col("h") <= F.lit(last).cast("bigint")).groupBy("h").agg(F.min("text").alias("text")).select("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for value in batch.column("text").to_pylist():
            held = float(zlib.crc32(value.encode()) % 3 == 0)
            text, right = rewritten(value, base_spans(value))
            # As in PiiModel.added: only proposals beside what the rules still find.
            base = base_spans(text)
            ends = {(x + i, y + j): k for k, x, y in right for i in (-1, 0, 1) for j in (-2, -1, 0, 1, 2)}
            begins = [x for _, x, _ in sorted(right, key=lambda r: r[1])]
            until = dict((x, y) for _, x, y in right)
            picked, wrong = [], []
            for a, b in beside(text, base):
                # Right: the proposal is the rewritten span, but for a character or two at its ends. A part of one is neither right nor wrong.
                kind = ends.get((a, b))
                at = bisect.bisect_right(begins, a) - 1
                if kind is not None:
                    picked.append((kind, a, b))
                elif at < 0 or b > until[begins[at]]:
                    wrong.append((zlib.crc32(f"{a} {b} {text[a:b]}".encode()), a, b))
            for kind, a, b in [*picked, *((-1, a, b) for _, a, b in sorted(wrong)[:max_wrong])]:
                rows.append([held, *[float(k == kind) for k in range(len(KINDS))], *[float(possible(k, text[a:b])) for k in range(len(KINDS))], *features(text, a, b)])
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64()))], ["v"])

    got = map_batches(picked, run, "v array<double>").toPandas()["v"].tolist()
    if not got:
        return PiiModel({})
    data = np.array(sorted(map(tuple, got)))
    n, found = len(KINDS), {}
    for kind in range(n):
        # Where what the kind's rule asks of the digits holds, as for all that is added; with few wrong ones left all teach.
        own = data[data[:, 1 + n + kind] > 0]
        own = own if (own[:, 1 + kind] == 0).sum() >= least else data
        held, y, x = own[:, 0] > 0, own[:, 1 + kind], own[:, 1 + 2 * n :]
        if min(y.sum(), (1 - y).sum()) >= least and held.any() and not held.all():
            trees = Boosted().fit(x[~held], y[~held])
            bound = calibrated(trees.raw(x[held]), y[held], precision)
            if np.isfinite(bound):
                found[kind] = (trees, max(bound, 0.0))
    return PiiModel(found)


SPANS = "array<struct<kind:int,start:int,end:int>>"
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def judged(df: DataFrame, text: str, model: PiiModel, then: Callable[[pa.Table, list, list], pa.Table], schema: T.StructType) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.Table:
        texts = batch.column(text)
        some = np.asarray(pc.match_substring_regex(texts.fill_null(""), SOME))
        base: list[list] = [[] for _ in range(len(texts))]
        more: list[list] = [[] for _ in range(len(texts))]
        for i in np.flatnonzero(some):
            value = texts[int(i)].as_py()
            base[i] = base_spans(value)
            more[i] = model.added(value, base[i])
        return then(pa.Table.from_batches([batch]), base, more)

    return map_batches(df, run, schema)


def find(docs: DataFrame, model: PiiModel, *, text: str = "text") -> DataFrame:
    """Every row with base_spans and added_spans (kind's place in KINDS, start, end; code points).

    A null text is empty. Columns of those names are replaced.
    """
    rest = docs.drop("base_spans", "added_spans")

    def then(table: pa.Table, base: list, more: list) -> pa.Table:
        for name, spans in (("base_spans", base), ("added_spans", more)):
            table = table.append_column(name, pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in row] for row in spans], ARROW_SPANS))
        return table

    return judged(rest, text, model, then, with_fields(rest, f"base_spans {SPANS}, added_spans {SPANS}"))


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the first one's [KIND]."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: PiiModel, *, text: str = "text") -> DataFrame:
    """Every row, personal data in ``text`` replaced by its kind; null texts stay null."""

    def then(table: pa.Table, base: list, more: list) -> pa.Table:
        values = table.column(text).to_pylist()
        made = [redacted(v, [*b, *m]) if b or m else v for v, b, m in zip(values, base, more, strict=True)]
        return table.set_column(table.column_names.index(text), text, pa.array(made, pa.string()))

    return judged(docs, text, model, then, docs.schema)


def listed(column: str | Column) -> Column:
    """kind:start:end, comma-joined, by kind and start."""
    named = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(column), lambda s: F.concat_ws(":", F.element_at(named, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
