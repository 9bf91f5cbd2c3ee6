"""Near-duplicate detection with SetSketch registers: band register values, estimate jointly by likelihood, then verify.

Words are runs of bytes that are not white space, A-Z lower-cased; a text's set has its distinct five-word shingles (its
whole sequence if it has fewer words), each as a 64-bit hash. A sketch has ``REGISTERS`` registers. Every shingle's hash
seeds a stream of exponential arrivals that fall into random registers; a register keeps its least arrival on the
exponential scale ``floor(1 - log_b x)``, truncated to 16 bits. Sketches of parts merge by the maximum, and equal register
values become likelier with similarity. Since a stream stops once it is beyond every register, long texts cost about one
step a shingle.

The steps: (1) texts with equal sets become one class, (2) its register values are banded, (3) each member is compared
with the least of the first members of its buckets, so n members cost n pairs, (4) buckets that still hold several
components are compared in bounded blocks, strays (members outside the bucket's largest component) with all members:
first each stray's best pair is verified, then all that the sketches do not rule out, on full sets inside the block,
which gives a link only where it joins two components there, and (5) links become components: classes hang on the least
class that they are linked with, and roots take the place of classes until no link is left between them. A block of n
members so gives less than n rows, however many of its pairs fail; rejected pairs never leave it. Nothing is collected. A
pair at the threshold shares no band with probability 5e-6, and less beyond it.

Null and empty texts, and texts of white space, have empty sets, are linked with nothing and stay. Rows with a null id
are linked as others are; a component is named by the least id that is not null, and by null if there is none. Rows of
one id with different texts are rows of their own. Repeated rows (equal id and text) get equal answers. Ids may have any
type that sorts. Extra columns do not take part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, lend, row_digest, scratch, store, table, texts_of

WORDS = 5
#: Similarity from which two sets are linked, as a percentage.
PERCENT = 75
REGISTERS = 256
BANDS, ROWS = 32, 4
BASE, RATE = 1.001, 20.0
#: Pairs whose estimate is this far below the threshold (4.5 standard deviations of the estimate) are not verified.
SLACK = 4.5 * (0.75 * 0.25 / REGISTERS) ** 0.5
#: About the most members of one side of a block, and the most shingles that they have together (one member may have more).
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19
#: Pairs that are compared at once, and characters of texts that are cut into shingles at once.
PAIRS, CHUNK = 1 << 12, 1 << 19

BLOCK_KEYS = ["band", "value", "x", "y"]

_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, int, int]:
    """Random values of bytes (A-Z as a-z), whether a byte belongs to a word, and a multiplier with its inverse mod 2^64."""
    fold = np.arange(256, dtype=np.uint64)
    fold[65:91] += np.uint64(32)
    word = np.ones(256, bool)
    word[[0x20, *range(0x09, 0x0E)]] = False
    base = 0xD1342543DE82EF95
    return mix64((fold + np.uint64(1)) * _GOLD), word, base, pow(base, -1, 1 << 64)


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    _, _, base, inverse = _tables()
    run = lambda b: np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)]))
    return run(base), run(inverse)


def shingles(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    values, word, _, _ = _tables()
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.cumsum([0, *(len(r) + 1 for r in raws)])
    data = np.frombuffer(b" ".join([*raws, b""]), np.uint8)
    power, inverse = _powers(1 << max(16, int(len(data)).bit_length()))
    inside = np.concatenate([[False], word[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[data] * power[: len(data)])])
    hashed = mix64((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * _GOLD)
    firsts = np.searchsorted(start, offsets)
    weights = mix64((np.arange(WORDS, dtype=np.uint64) + np.uint64(1)) * _GOLD) | np.uint64(1)
    n = len(hashed)
    joined = np.zeros(max(0, n - WORDS + 1), np.uint64)
    for k in range(WORDS):
        joined += hashed[k : k + len(joined)] * weights[k]
    joined = mix64(joined)
    out = []
    for a, e in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        if e - a >= WORDS:
            out.append(np.unique(joined[a : e - WORDS + 1]))
        elif e > a:
            out.append(mix64((hashed[a:e] * weights[: e - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(e - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def chunks(texts: list[str], size: int = CHUNK) -> Iterator[list[str]]:
    part, total = [], 0
    for t in texts:
        if part and total + len(t) > size:
            yield part
            part, total = [], 0
        part.append(t)
        total += len(t)
    if part:
        yield part


def sketch(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """The registers (a row of 16-bit values for each set); an empty set's are 0."""
    counts = np.array([len(s) for s in sets])
    low = np.full(len(sets) * m, np.inf)
    seed = np.concatenate([*sets, np.zeros(0, np.uint64)])
    doc = np.repeat(np.arange(len(sets)), counts)
    at = np.zeros(len(seed))
    limit = np.full(len(sets), np.inf)
    step = 0
    while len(seed):
        seed = seed + _GOLD
        random = mix64(seed)
        at = at - np.log(((random >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) / (m * RATE)
        np.minimum.at(low, doc * m + (random & np.uint64(m - 1)).astype(np.int64), at)
        step += 1
        if step < 8 or step % 16 == 0:
            limit = low.reshape(-1, m).max(1)
        live = at < limit[doc]
        if not live.all():
            seed, doc, at = seed[live], doc[live], at[live]
    with np.errstate(divide="ignore"):
        value = np.floor(1 - np.log(low) / np.log(BASE))
    return np.where(np.isinf(low), 0, np.clip(value, 0, 65535)).astype(np.uint16).reshape(-1, m)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sketches' sets."""
    return np.maximum(a, b)


def _laws(j, u, v):
    """Chances that a register of the first set is above and below the second's, and their slopes, at similarity ``j``."""
    scale, log_base = (BASE - 1) / BASE, np.log(BASE)
    x, y = np.clip(u - v * j, 0, 1), np.clip(v - u * j, 0, 1)
    above, below = -np.log1p(-x * scale) / log_base, -np.log1p(-y * scale) / log_base
    return above, below, -v * scale / ((1 - x * scale) * log_base), -u * scale / ((1 - y * scale) * log_base)


def reaches(level: float, more: np.ndarray, less: np.ndarray, equal: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether ``estimate`` is at least ``level``: the likelihood is strictly concave, so its slope there tells."""
    u, v = na / (na + nb), nb / (na + nb)
    above, below, d_above, d_below = _laws(level, u, v)
    tiny = 1e-12
    slope = more * d_above / np.maximum(above, tiny) + less * d_below / np.maximum(below, tiny) - equal * (d_above + d_below) / np.maximum(1 - above - below, tiny)
    return (slope >= 0) & (np.minimum(u / v, v / u) >= level)


def estimate(more: np.ndarray, less: np.ndarray, equal: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The similarity that is likeliest for so many registers of a above, below and equal to b's, and the sets' sizes.

    The likelihood is strictly concave in the similarity, so a ternary search finds its top.
    """
    u, v = na / (na + nb), nb / (na + nb)
    log = lambda x: np.log(np.maximum(x, 1e-12))

    def likelihood(j):
        above, below, _, _ = _laws(j, u, v)
        return more * log(above) + less * log(below) + equal * log(1 - above - below)

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(36):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        up = likelihood(a) < likelihood(b)
        lo, hi = np.where(up, a, lo), np.where(up, hi, b)
    return (lo + hi) / 2


def counts(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many registers of each row of x are above, below and equal to those of y."""
    ones = lambda b: np.bitwise_count(np.packbits(b, axis=1)).sum(1, dtype=np.int64)
    more, equal = ones(x > y), ones(x == y)
    return more, x.shape[1] - more - equal, equal


def sketches(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(id, row, n, digest, registers): the size of each row's set, a digest of the set (null: empty), and its sketch.

    ``row`` tells rows apart by id and text.
    """
    slim = docs.select(F.col(key).alias("id"), row_digest(F.col(key), F.col("text")).alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digests, registers = [], [], []
            for part in chunks(texts_of(b)):
                sets = shingles(part)
                n += [len(s) for s in sets]
                digests += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                registers += [r.tobytes() if len(s) else None for r, s in zip(sketch(sets), sets)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(registers, pa.binary())], ["id", "row", "n", "digest", "registers"])

    return slim.mapInArrow(run, f"id {dict(slim.dtypes)['id']}, row binary, n bigint, digest binary, registers binary")


def bands(classes: DataFrame) -> DataFrame:
    """(band, value, c, n): the banded register values of each class."""
    step = ROWS * 2
    value = lambda i: F.xxhash64(F.substring(F.col("registers"), i * step + 1, step))
    return classes.select("c", "n", F.posexplode(F.array(*(value(i) for i in range(BANDS)))).alias("band", "value"))


def _size_fits(a, b):
    """100 * intersection >= PERCENT * union needs sizes that are near enough; for columns and for arrays."""
    return (100 * a >= PERCENT * b) & (100 * b >= PERCENT * a)


def registers_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def verified(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (a, b) that the sketches do not rule out and whose full sets are similar enough; ``members`` has (c, n,
    registers, text) of their classes."""
    sides = [members.select(*(F.col(c).alias(c + side if c != "c" else side) for c in ("c", "n", "registers", "text"))) for side in "ab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            col = dict(zip(t.schema.names, t.columns))
            x, y = (registers_of(col[c]) for c in ("registersa", "registersb"))
            may = np.flatnonzero(reaches(PERCENT / 100 - SLACK, *counts(x, y), *(col[c].to_numpy().astype(float) for c in ("na", "nb"))))
            ta, tb = (col[c].take(pa.array(may)).to_pylist() for c in ("texta", "textb"))
            keep = []
            for lo in range(0, len(may), 64):
                distinct = {x: i for i, x in enumerate(dict.fromkeys([*ta[lo : lo + 64], *tb[lo : lo + 64]]))}
                sets = [s for part in chunks(list(distinct)) for s in shingles(part)]
                for v, w in zip(ta[lo : lo + 64], tb[lo : lo + 64]):
                    p, q = sets[distinct[v]], sets[distinct[w]]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(100 * both >= PERCENT * (len(p) + len(q) - both) and both > 0)
            yield pa.record_batch([col["a"], col["b"]], ["a", "b"]).take(pa.array(may[np.array(keep, bool)]))

    met = pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b")
    return met.select("a", "b", "na", "nb", "registersa", "registersb", "texta", "textb").mapInArrow(run, "a bigint, b bigint")


def relabel(rows: DataFrame, comp: DataFrame, column: str) -> DataFrame:
    """Adds "c" + ``column``: the component of the class in ``column``, itself where it has no links."""
    c = comp.select(F.col("id").alias("_id"), F.col("component").alias("_component"))
    return rows.join(c, F.col(column) == F.col("_id"), "left").withColumn("c" + column, F.coalesce("_component", column)).drop("_id", "_component")


def roots(parents: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(id, component) of (id, component) that say what each id hangs on, always something less: its root. Every pass
    follows two steps at once."""
    while True:
        above = parents.select(F.col("id").alias("_id"), F.col("component").alias("_above"))
        step = parents.join(above, F.col("component") == F.col("_id"), "left")
        new = keep(step.select("id", F.coalesce("_above", "component").alias("component"), F.col("_above").isNotNull().alias("moved")), "roots")
        if new.where("moved").isEmpty():
            return new.select("id", "component")
        parents = new.select("id", "component")


class Linker:
    """Components of verified links (a, b): (id, component) of all linked ids but the components' own, each named by an id of
    its own. Ids hang on the least id that they are linked with, roots take the place of ids, and so on with the links that
    are left between roots."""

    def __init__(self, keep: Callable[[DataFrame, str], DataFrame], spark: SparkSession):
        self.keep, self.links, self.comp, self.empty = keep, [], spark.createDataFrame([], "id bigint, component bigint"), True

    def _between(self, links: DataFrame) -> DataFrame:
        """(u, v): the links that are left between components, the larger first."""
        met = links.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")) if self.empty else relabel(relabel(links.select("a", "b"), self.comp, "a"), self.comp, "b")
        return self.keep(met.where("ca <> cb").select(F.greatest("ca", "cb").alias("u"), F.least("ca", "cb").alias("v")).distinct(), "between")

    def _hang(self, edges: DataFrame) -> None:
        made = roots(edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")), self.keep)
        if not self.empty:
            old = relabel(self.comp, made, "component").select("id", F.col("ccomponent").alias("component"))
            made = self.keep(old.unionByName(made), "components")
        self.comp, self.empty = made, False

    def add(self, found: DataFrame) -> None:
        """Takes links; components join as far as one pass does it, which may leave some apart until ``finish``."""
        self.links.append(self.keep(found, "links"))
        edges = self._between(self.links[-1])
        if not edges.isEmpty():
            self._hang(edges)

    def finish(self) -> DataFrame:
        """The components by all links."""
        edges = None
        for links in self.links:
            edges = links if edges is None else edges.unionByName(links)
        while edges is not None and not (edges := self._between(edges)).isEmpty():
            self._hang(edges)
            edges = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
        return self.comp


def components(links: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = store) -> DataFrame:
    """(id, component) of every linked id but the least of each component: the least id that it reaches."""
    linker = Linker(keep, links.sparkSession)
    linker.add(links)
    return linker.finish()


def blocks(buckets: DataFrame, comp: DataFrame, classes: DataFrame) -> DataFrame:
    """(band, value, x, y, side, c, n, cc, registers): the buckets that hold several components, as blocks.

    Strays (side 0), the members outside a bucket's largest component, meet all members (side 1).
    """
    member = relabel(buckets, comp, "c")
    size = member.groupBy("band", "value", "cc").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("w"))
    size = size.groupBy("band", "value").agg(F.sum("k").alias("k"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("kinds"), F.max(F.struct("k", F.col("cc").alias("main"), "w")).alias("top"))
    parts = lambda k, w: F.ceil(F.greatest(k / F.lit(float(BLOCK)), w / F.lit(float(BLOCK_SHINGLES)))).cast("int")
    mixed = size.where("kinds > 1").select("band", "value", "top.main", parts(F.col("k"), F.col("w")).alias("all"), parts(F.col("k") - F.col("top.k"), F.col("w") - F.col("top.w")).alias("apart"))
    member = member.join(mixed, ["band", "value"]).join(classes.select("c", "registers"), "c")
    part = lambda n: F.pmod(F.xxhash64("c"), F.col(n).cast("bigint")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["band", "value", "c", "n", "cc", "registers"]
    left = member.where("cc <> main").select(*columns, F.lit(0).alias("side"), part("apart").alias("x"), each("all").alias("y"))
    right = member.select(*columns, F.lit(1).alias("side"), part("all").alias("y"), each("apart").alias("x"))
    return left.unionByName(right).select(*BLOCK_KEYS, "side", "c", "n", "cc", "registers")


def pairs_in(t: pa.Table, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, block): rows of strays and of members that may be similar enough, from whole blocks in order of their sides.

    A pair belongs to the first band that it shares; ``starts`` are the first rows of the blocks.
    """
    band, side, n, cc = (t.column(c).to_numpy() for c in ("band", "side", "n", "cc"))
    registers = registers_of(t.column("registers"))
    banded = registers[:, : BANDS * ROWS].copy().view(np.uint64)  # a band is one number
    block = np.searchsorted(starts, np.arange(t.num_rows), "right") - 1
    strays = np.flatnonzero(side == 0)
    n_strays = np.bincount(block[strays], minlength=len(starts))
    members = np.diff(np.append(starts, t.num_rows)) - n_strays
    lo, size = (starts + n_strays)[block[strays]], members[block[strays]]
    cut = np.searchsorted(np.cumsum(size), np.arange(PAIRS, size.sum() + PAIRS, PAIRS), "left") + 1
    for a, e in zip([0, *cut[:-1].tolist()], cut.tolist()):
        k, m = strays[a:e], size[a:e]
        if not m.sum():
            continue
        i, j = np.repeat(k, m), np.repeat(lo[a:e] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        for p in range(0, len(i), 4 * PAIRS):
            x, y = i[p : p + 4 * PAIRS], j[p : p + 4 * PAIRS]
            ok = (cc[x] != cc[y]) & _size_fits(n[x], n[y])
            x, y = x[ok], y[ok]
            ok = (banded[x] == banded[y]).argmax(1) == band[x]
            x, y = x[ok], y[ok]
            ok = reaches(PERCENT / 100 - SLACK, *counts(registers[x], registers[y]), n[x].astype(float), n[y].astype(float))
            if ok.any():
                yield x[ok], y[ok], block[x[ok]]


def by_block(rows: DataFrame, work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Brings the rows of each block together, strays first, and calls ``work`` with whole blocks and their first rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # a block that goes on in the next batch
        for b in chain(batches, [None]):
            new = [] if b is None or not b.num_rows else [pa.Table.from_batches([b])]
            t = pa.concat_tables(([] if held is None else [held]) + new) if new or held is not None else None
            if t is None or not t.num_rows:
                continue
            k = np.stack([t.column(c).to_numpy() for c in BLOCK_KEYS], 1)
            starts = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]).any(1)]))
            end = t.num_rows if b is None else int(starts[-1])
            held = None if b is None else t.slice(end)
            if end:
                yield from work(t.slice(0, end).combine_chunks(), starts[starts < end])

    return rows.repartition(*BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS, "side").mapInArrow(run, schema)


def best_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): each stray with the member of the largest estimate, of all its blocks."""

    def work(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        registers, n, c = registers_of(t.column("registers")), t.column("n").to_numpy().astype(float), t.column("c").to_numpy()
        for i, j, _ in pairs_in(t, starts):
            e = estimate(*counts(registers[i], registers[j]), n[i], n[j])
            order = np.lexsort((c[j], -e, i))
            first = order[np.concatenate([[True], np.diff(i[order]) > 0])]
            yield pa.record_batch([pa.array(c[i[first]]), pa.array(c[j[first]]), pa.array(e[first])], ["a", "b", "estimate"])

    found = by_block(rows, work, "a bigint, b bigint, estimate double")
    return found.groupBy("a").agg(F.max(F.struct("estimate", "b")).alias("best")).select("a", "best.b")


def in_question(rows: DataFrame) -> DataFrame:
    """The rows of blocks that have a pair that may be similar enough, without the others."""

    def work(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        some = np.zeros(t.num_rows, bool)
        for i, j, _ in pairs_in(t, starts):
            some[i], some[j] = True, True
        yield from t.filter(pa.array(some)).to_batches()

    return by_block(rows, work, rows.schema)


def links_in_blocks(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): verified links that join components inside a block, none that its other links imply."""

    def work(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a, e in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows]):
            part = t.slice(a, e - a).combine_chunks()
            found = join_block(part)
            if found:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

    return by_block(rows.join(texts, "c").select(*BLOCK_KEYS, "side", "c", "n", "cc", "registers", "text"), work, "a bigint, b bigint")


def join_block(t: pa.Table) -> list[tuple[int, int]]:
    """Links between the components of one block, on full sets, at most one less than there are components."""
    c, n, cc = (t.column(x).to_numpy() for x in ("c", "n", "cc"))
    _, number = np.unique(cc, return_inverse=True)
    root = np.arange(number.max() + 1)
    texts = t.column("text").to_pylist()
    distinct = {x: i for i, x in enumerate(dict.fromkeys(texts))}
    sets = [s for p in chunks(list(distinct)) for s in shingles(p)]
    own = np.array([distinct[x] for x in texts])
    sizes = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(flat.max() + 1, bool)
    out = []
    for i, j, _ in pairs_in(t, np.zeros(1, np.int64)):
        for k, lo, hi in zip(*((u := np.unique(i, return_index=True))[0].tolist(), u[1].tolist(), [*u[1][1:].tolist(), len(i)])):
            mine = flat[first[own[k]] : first[own[k] + 1]]
            mark[mine] = True
            rest, step = j[lo:hi], 8
            while len(rest := rest[root[number[rest]] != root[number[k]]]):
                now, rest, step = rest[:step], rest[step:], 2 * step
                both = np.array([np.count_nonzero(mark[flat[first[s] : first[s + 1]]]) for s in own[now].tolist()])
                for w in now[100 * both >= PERCENT * (len(mine) + sizes[own[now]] - both)].tolist():
                    if root[number[w]] != root[number[k]]:
                        root[root == root[number[w]]] = root[number[k]]
                        out.append((int(c[k]), int(c[w])))
            mark[mine] = False
    return out


def labelled(docs: DataFrame, key: str, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(id, row, n, digest, component) of every row, ``component`` a number for the classes that are linked (null: empty set)."""
    made = keep(sketches(docs, key), "sketches")
    classes = made.where("digest is not null").groupBy("digest").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    classes = keep(classes.withColumn("c", F.monotonically_increasing_id()), "classes")  # numbers of this run only
    banded = bands(classes)
    # Buckets of one member go; the first member of the others is compared with the rest.
    heads = banded.groupBy("band", "value").agg(F.min(F.struct("c", "n")).alias("head"), F.count(F.lit(1)).alias("members")).where("members > 1").select("band", "value", F.col("head.c").alias("a"), F.col("head.n").alias("na"))
    buckets = keep(banded.join(heads, ["band", "value"]), "buckets")
    involved = classes.join(buckets.select("c").distinct(), "c", "left_semi").select("c", "row", "n", "registers")
    members = docs.select(row_digest(F.col(key), F.col("text")).alias("row"), "text").join(involved, "row").dropDuplicates(["row"]).drop("row")
    members = keep(members, "members")
    linker = Linker(keep, docs.sparkSession)
    # One pair for each member, with the least of its buckets' first members; members of a crowd mostly share it.
    stars = buckets.where("c <> a").where(_size_fits(F.col("n"), F.col("na"))).groupBy(F.col("c").alias("b")).agg(F.min("a").alias("a"))
    linker.add(verified(stars, members))
    # Then the best pair of each stray: most strays of a crowd join its component by it, and their other pairs are spared.
    buckets, texts = buckets.select("band", "value", "c", "n"), members.select("c", "text")
    linker.add(verified(keep(best_pairs(blocks(buckets, linker.comp, members)), "best"), members))
    linker.add(links_in_blocks(keep(in_question(blocks(buckets, linker.comp, members)), "in-question"), texts))
    linker.finish()
    found = relabel(classes.select("digest", "c"), linker.comp, "c").select("digest", F.col("cc").alias("component"))
    return made.select("id", "row", "n", "digest").join(found, "digest", "left")


def near_duplicates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row."""
    with scratch(docs.sparkSession, "near-duplicates") as keep:
        rows = keep(labelled(docs, key, keep), "labelled")
        least = rows.where("component is not null").groupBy("component").agg(F.min("id").alias("least"))
        component = F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least"))
        out = rows.join(least, "component", "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
        return store(out, "near-duplicates")


def one_of_each(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row of each component, all columns as they are: that of the least id (null last), of rows with that id the one whose
    digest is least. Rows without shingles stay, but of repeated rows (equal id and text) one stays."""
    name = free_name(docs.columns, "row")
    with scratch(docs.sparkSession, "one-of-each") as keep:
        rows = keep(labelled(docs, key, keep), "labelled")
        chosen = rows.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("first")).select(F.col("first.row").alias(name))
        chosen = lend(chosen.unionByName(rows.where("component is null").select(F.col("row").alias(name)).distinct()), "chosen")
    return docs.withColumn(name, row_digest(F.col(key), F.col("text"))).join(chosen, name, "left_semi").dropDuplicates([name]).select(docs.columns)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles, component and survival of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
