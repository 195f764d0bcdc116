"""Near-duplicate groups: MinHash bands, odd sketches, exact confirmation.

1. Each text becomes its set of word shingles, MinHash samples, band keys and
   an odd sketch (the samples' parities in a bitmap). Texts of equal sets meet
   under the set's hash and go on as one representative.
2. Representatives that share a band are compared by the XOR of their
   sketches; what comes out are trees of the pairs that look alike, never all
   pairs. The trees' components are small families.
3. Within a family full shingle sets are compared in the same way, and the
   trees of the true links give the result's components.

A large group (a band's, a family) is dealt into blocks. Each row goes to one
of them, but for a few pivots that go to all and tie the blocks together. The rows of a large band
go on as one family without comparing sketches, as a family need only hold all links.
In a family rows already in one component need no comparison. Those of different components meet in a second pass
if they share one of their rarest shingles, as links must: texts from one template that are alike
but not linked don't, and stay out of it.

A pair of likeness 0.85 misses all 25 bands of 5 rows with a chance of 4e-7,
one of 0.8 with 5e-5, and the sketch's bound with one of about 1e-5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finlark.llm.common import Tokens, cut, map_batches, mix, pair

ROWS, BANDS = 5, 25
SAMPLES = ROWS * BANDS
BITS = 512
BLOCK = 512  # rows
BLOCK_SHINGLES = 1 << 22
SIZE_STEP = 1.01  # ratio of neighbouring classes of set sizes
PIVOTS = 16  # about so many rows of a large group go to all its blocks
SLACK = 4.5  # standard errors of the sketch's estimate by which a pair may fall short
FACTORS = (np.random.default_rng(20).integers(0, 2**63, SAMPLES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
PLACES = np.random.default_rng(21).integers(0, 2**63, SAMPLES, dtype=np.uint64)


def shingles(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; fewer words than ``width`` make one; no words, none."""
    tokens = Tokens(texts)
    hashes = tokens.hashes()[tokens.codes]
    whole = hashes[: max(0, len(hashes) - width + 1)]
    for k in range(1, width):
        whole = pair(whole, hashes[k : len(hashes) - width + 1 + k])
    found = []
    for start, end in zip(tokens.starts, tokens.ends, strict=True):
        if end - start >= width:
            found.append(np.unique(whole[start : end - width + 1]))
        elif end > start:
            one = np.full(1, end - start, np.uint64)
            for h in hashes[start:end]:
                one = pair(one, np.full(1, h))
            found.append(one)
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def samples(hashes: np.ndarray) -> np.ndarray:
    """The least of each of SAMPLES products, over all of a set."""
    least = np.full(SAMPLES, np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 4096):
            np.minimum(least, (hashes[at : at + 4096, None] * FACTORS).min(axis=0), out=least)
    return least


def sketches(least: np.ndarray) -> np.ndarray:
    """Rows of BITS / 64 words: each sample flips one bit."""
    bits = (mix(least ^ PLACES) % np.uint64(BITS)).astype(np.int64)
    found = np.zeros((len(least), BITS), np.uint8)
    np.bitwise_xor.at(found, (np.arange(len(least))[:, None], bits), 1)
    return np.packbits(found, axis=1, bitorder="little").view(np.uint64)


def most_bits(percent: int) -> float:
    """How many bits of two sketches may differ if at least ``percent`` of the samples agree, less SLACK standard errors."""
    j = percent / 100
    low = max(0.05, j - SLACK * np.sqrt(j * (1 - j) / SAMPLES))
    mean = BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1 - low) / BITS))
    return mean + 2 * np.sqrt(mean * (1 - mean / BITS)) * 0.5


def signed(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (a hash of the set), bands and sketch of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingles(batch.column("text"), width)
        least = np.array([samples(s) for s in sets]).reshape(len(sets), SAMPLES)
        bands = np.zeros((len(sets), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
        for k in range(ROWS):
            bands = pair(bands, least[:, k::ROWS])
        flat = sketches(least)
        with np.errstate(over="ignore"):
            a = [int(s.sum(dtype=np.uint64)) - 2**63 for s in sets]
            b = [int(mix(s).sum(dtype=np.uint64)) - 2**63 for s in sets]
        full = np.array([len(s) for s in sets])
        lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(np.where(full > 0, BANDS, 0)))).astype(np.int32), pa.array(bands[full > 0].reshape(-1).view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(full, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), lists, pa.array([x.tobytes() for x in flat], pa.binary())], ["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"])

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return map_batches(rows, run, "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, sketch binary")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys of sorted batches, one table a run."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        starts = np.concatenate(([0], change, [batch.num_rows]))
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            now = tuple(c[a] for c in columns)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


Near = Callable[[int, np.ndarray], np.ndarray]


def tied(near: Near, label: np.ndarray, guest: np.ndarray | None) -> np.ndarray:
    """The labels after those of linked rows are made one; rows of one label are not compared.

    near: of a row and later ones, those that are linked with it. With ``guest``, only guests and others are compared.
    """
    label = label.copy()
    for x in range(len(label) - 1):
        apart = label[x + 1 :] != label[x]
        later = x + 1 + np.flatnonzero(apart if guest is None else apart & (guest[x + 1 :] != guest[x]))
        for y in near(x, later) if len(later) else ():
            if label[y] != label[x]:
                label[label == label[y]] = label[x]
    return label


def by_sketch(table: pa.Table, percent: int) -> Near:
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(table.num_rows, BITS // 64)
    bound = most_bits(percent)
    return lambda x, later: later[np.bitwise_count(sketch[later] ^ sketch[x]).sum(axis=1) <= bound]


def by_sets(table: pa.Table, percent: int) -> Near:
    """By sketch, then by the full sets: two by two for a few, with one pass over the block's shingles for many."""
    first = by_sketch(table, percent)
    sets = [np.frombuffer(w, np.uint64) for w in table.column("words").to_pylist()]
    size = np.array([len(s) for s in sets])
    coded: list[np.ndarray] = []

    def near(x: int, later: np.ndarray) -> np.ndarray:
        later = first(x, later)
        later = later[100 * np.minimum(size[later], size[x]) >= percent * np.maximum(size[later], size[x])]
        if len(later) * 16 < len(sets):
            return np.array([y for y in later if linked(sets[x], sets[y], percent)], np.int64)
        if not coded:
            coded.extend((np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(size) - size))
            coded.append(np.zeros(coded[0].max() + 1, np.int32))
        codes, starts, flags = coded
        own = codes[starts[x] : starts[x] + size[x]]
        flags[own] = 1
        both = np.add.reduceat(flags[codes], starts)[later]
        flags[own] = 0
        return later[100 * both >= percent * (size[x] + size[later] - both)]

    return near


def edges_of(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["a", "b"])


def compared(rows: DataFrame, keys: list[str], kernel: Callable[[pa.Table, int], Near], percent: int) -> DataFrame:
    """Edges (a, b) from the rows of equal keys: rep, label, guest and what the kernel reads.

    Each label that is tied to others gets one edge, to the least row of what it is tied to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for table in grouped(batches, keys):
            table = table.sort_by("rep")
            ids, guest, label = (np.asarray(table.column(c)) for c in ("rep", "guest", "label"))
            final = tied(kernel(table, percent), label, guest if guest.any() else None)
            _, least, place = np.unique(final, return_index=True, return_inverse=True)
            root, (_, once) = least[place], np.unique(label, return_index=True)
            more = once[label[once] != label[root[once]]]
            held.append((ids[root[more]], ids[more]))
            if len(held) > 1000:
                yield edges_of(held)
                del held[1:]
        yield edges_of(held)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint").distinct()


def dealt(rows: DataFrame, sizes: DataFrame, group: str) -> DataFrame:
    """Rows in the blocks of their group; sizes: ``group``, n, least (rep) and blocks of each group with several rows."""
    own = F.pmod(F.xxhash64("rep"), "blocks").cast("int")
    pivot = (F.col("blocks") > 1) & ((F.col("rep") == F.col("least")) | (F.pmod(F.xxhash64("rep", F.lit("pivot")), "n") < PIVOTS))
    places = F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    return rows.join(sizes, group).withColumns({"block": F.explode(places), "label": F.col("rep"), "guest": F.lit(False)}).drop("n", "least")


def sharing(rest: DataFrame, percent: int) -> DataFrame:
    """Edges of trees over the rows of a family that share a shingle which a link between two labels cannot lack.

    rest: rep, family, label and words. Sets that are linked have more in common than either leaves outside a certain
    prefix, in any one order of shingles; so their prefixes meet. In the order of rarity within a
    family prefixes mostly hold what sets one text apart. A prefix is the shorter the larger the other set is, so
    it is taken anew for each class of sizes that a partner may have.
    """

    def unpacked(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = batch.column("words")
        sizes = np.asarray(pc.binary_length(words)) // 8
        at = np.repeat(np.arange(batch.num_rows), sizes)
        family = np.asarray(batch.column("family")).view(np.uint64)[at]
        keys = pair(family, np.frombuffer(b"".join(words.to_pylist()), np.uint64)).view(np.int64)
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in ("rep", "label")), pa.array(keys)], ["rep", "label", "shingle"])

    # A shingle is one number with its family; should two share it, an order remains an order.
    single = map_batches(rest.select("rep", "family", "label", "words"), unpacked, "rep bigint, label bigint, shingle bigint")
    ties = (F.min("label") < F.max("label")).cast("int")
    counts = single.groupBy("shingle").agg((2 * F.count("*") + ties).alias("order"))
    sets = single.select("rep", "shingle").join(counts, "shingle").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("order", "shingle"))).alias("set"))
    ordered = sets.join(rest.select("rep", "label"), "rep")

    def size_class(n: Column) -> Column:
        return F.floor(F.log(n) / F.log(F.lit(SIZE_STEP)))

    n = F.size("set")
    least, most = F.ceil(n * percent / 100), F.floor(n * 100 / percent)
    classed = ordered.select("*", n.alias("n"), size_class(n).alias("own"), least.alias("least"), F.explode(F.sequence(size_class(least), size_class(most))).alias("other"))
    partner = F.greatest("least", F.floor(F.pow(F.lit(SIZE_STEP), "other")) - 1)  # no set of that class is smaller
    common = F.ceil((F.col("n") + partner) * percent / (100 + percent) - 1e-6)
    prefix = F.slice("set", F.lit(1), F.greatest(F.lit(0), F.col("n") - common + 1).cast("int"))
    place = ["low", "high", "shingle"]
    entries = cut(classed.select(F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.explode(F.transform(F.filter(prefix, lambda x: x["order"] % 2 == 1), lambda x: x["shingle"])).alias("shingle"), "rep", "label", "own"))
    both = (F.min("label") < F.max("label")) & (F.min("own") == F.col("low")) & (F.max("own") == F.col("high"))  # a partner is of the other class
    met = entries.groupBy(*place).agg(F.min("rep").alias("a"), both.alias("both")).where("both").drop("both")
    return entries.join(met, place).select("a", F.col("rep").alias("b")).where("a != b").distinct()


def second_pass(held: DataFrame, members: DataFrame, sizes: DataFrame, found: DataFrame, percent: int) -> DataFrame | None:
    """Edges that the blocks of large families hid from each other; none where the first pass left one component each.

    What may still be linked across components shares a shingle of both prefixes; the rows that do so fall into
    parts, and in each the rows outside its largest component are compared with all the rest.
    """
    large = sizes.where("blocks > 1").select("family")
    if not large.limit(1).count():
        return None
    roots = cut(components(found).select(F.col("node").alias("rep"), "root"))
    label = F.coalesce("root", "rep").alias("label")
    labels = members.select("family", "rep").join(large, "family").join(roots, "rep", "left").select("family", "rep", label)
    apart = labels.groupBy("family").agg(F.min("label").alias("first"), F.max("label").alias("last")).where("first < last").select("family")
    rest = cut(labels.join(apart, "family"))
    if not rest.limit(1).count():
        return None
    edges = cut(sharing(held.join(rest.select("rep", "label"), "rep"), percent))
    part = components(edges).select(F.col("node").alias("rep"), F.col("root").alias("part"))
    rows = held.drop("family").join(part, "rep").join(rest.select("rep", "label"), "rep")
    by_label = rows.groupBy("part", "label").agg(F.count("*").alias("c"), F.sum(F.length("words") / 8).alias("s"))
    tops = by_label.groupBy("part").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("n"), F.sum("s").alias("s"))
    tops = cut(tops.select("part", F.col("top.label").alias("main"), _blocks(F.col("n") - F.col("top.c")).alias("others"), _blocks(F.col("n"), F.col("s")).alias("blocks")))
    own = F.pmod(F.xxhash64("rep"), "blocks").cast("int")

    def at(block: Column, other: Column, guest: bool) -> Column:
        return F.struct(block.alias("block"), other.alias("other"), F.lit(guest).alias("guest"))

    member = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda k: at(own, k, False))
    guest = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: at(k, F.pmod(F.xxhash64("rep"), "others").cast("int"), True))
    spread = rows.join(tops, "part").withColumn("at", F.explode(F.when(F.col("label") == F.col("main"), member).otherwise(F.concat(member, guest)))).select(*rows.columns, "at.*")
    return cut(compared(spread, ["part", "block", "other"], by_sets, percent))


def _blocks(n: Column, shingles: Column | None = None) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / BLOCK), *([] if shingles is None else [F.ceil(shingles / BLOCK_SHINGLES)])).cast("int")


def all_alike(table: pa.Table, percent: int) -> Near:
    """Of a large band's block all rows; of others those whose sketches are alike."""
    return (lambda x, later: later) if table.column("blocks")[0].as_py() > 1 else by_sketch(table, percent)


def families(reps: DataFrame, percent: int) -> DataFrame:
    """Edges of trees over the representatives that share a band and look alike, or share a large band."""
    banded = reps.select("rep", "sketch", F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("least")).where("n > 1").withColumn("blocks", _blocks(F.col("n")))
    return compared(dealt(banded, sizes, "band"), ["band", "block"], all_alike, percent)


def true_links(docs: DataFrame, members: DataFrame, percent: int, width: int) -> DataFrame:
    """Edges of trees over the links of ``percent`` or more, confirmed on full sets, within each family.

    members: rep, sketch, n_shingles and family.
    """
    def expand(batch: pa.RecordBatch) -> pa.Table:
        sets = [s.tobytes() for s in shingles(batch.column("text"), width)]
        return pa.Table.from_batches([batch]).drop_columns("text").append_column("words", pa.array(sets, pa.large_binary()).cast(pa.binary()))

    held = cut(map_batches(docs.join(members, "rep").select("rep", "sketch", "family", "text"), expand, "rep bigint, sketch binary, family bigint, words binary"))
    sizes = cut(members.groupBy("family").agg(F.count("*").alias("n"), F.min("rep").alias("least"), F.sum("n_shingles").alias("s")).select("family", "n", "least", _blocks(F.col("n"), F.col("s")).alias("blocks")))
    found = cut(compared(dealt(held, sizes, "family").drop("blocks"), ["family", "block"], by_sets, percent))
    more = second_pass(held, members, sizes, found, percent)
    return found if more is None else found.unionByName(more)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct hashes."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node it reaches) of every node of the edges (a, b).

    Large-star and small-star rounds: each node's larger neighbours, then its
    smaller ones, are tied to the least of its neighbourhood, until all are stars.
    Nodes with over a thousandth of all edges, a thousand at most, get their least neighbour without an exchange of their edges.
    """
    def met(both: DataFrame) -> DataFrame:
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.join(least, "u")

    def large_star(ties: DataFrame) -> DataFrame:
        """ties: u, v with v < u."""
        many = max(ties.count() // 1000, 50)
        hubs = [r.v for r in ties.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > many).collect()]
        under = {r.u: r.m for r in ties.where(F.col("u").isin(hubs)).groupBy("u").agg(F.min("v").alias("m")).collect()} if hubs else {}
        both = ties.unionByName(ties.select(F.col("v").alias("u"), F.col("u").alias("v")))
        made = met(both.where(~F.col("u").isin(hubs))).where("v > u").select("u", "v", "m")
        if hubs:
            m = F.try_element_at(F.create_map(*[F.lit(x) for h in hubs for x in (h, under.get(h, h))]), F.col("u"))
            made = made.unionByName(both.where(F.col("u").isin(hubs) & (F.col("v") > F.col("u"))).select("u", "v", m.alias("m")))
        return made.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()

    def small_star(ties: DataFrame) -> DataFrame:
        made = met(ties).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        return made.where("u != v").distinct()

    def stars(ties: DataFrame) -> bool:
        """Every node has one root, and no root has another."""
        if ties.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
            return False
        return not ties.select("u").join(ties.select(F.col("v").alias("u")).distinct(), "u").limit(1).count()

    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not stars(now):
        now = cut(small_star(large_star(now)))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = 85, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links) and kept (it is its own) of every row.

    Rows without words or with a null text are linked with nothing. The key
    should be unique; rows of one key are told apart by their shingle sets. A
    null key is its own component and kept. Other columns are dropped.
    """
    made = cut(signed(docs, key, text, width))
    named = made.where("doc_id is not null and n_shingles > 0")
    # Equal sets have equal samples, so any row's bands and sketch serve.
    reps = cut(named.groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("bands", "sketch"), "doc_id").alias("s")).select("n_shingles", "set_a", "set_b", "rep", "s.*"))
    family = components(families(reps, percent))
    members = family.join(reps.select(F.col("rep").alias("node"), "sketch", "n_shingles"), "node").select(F.col("node").alias("rep"), "sketch", "n_shingles", F.col("root").alias("family"))
    body = docs.select(F.col(key).cast("bigint").alias("rep"), F.col(text).alias("text"))
    roots = components(true_links(body, cut(members), percent, width))
    tops = reps.join(roots, reps.rep == roots.node, "left").select("n_shingles", "set_a", "set_b", F.coalesce("root", "rep").alias("top"))
    out = named.select("doc_id", "n_shingles", "set_a", "set_b").join(tops, ["n_shingles", "set_a", "set_b"]).select("doc_id", "n_shingles", F.col("top").alias("component_id"))
    alone = made.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
