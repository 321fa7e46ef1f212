"""N-gram Jaccard join by parity sketches.

Documents with the same shingle set form a class.  Within a size band the
shingles of a class are dealt to parts by hash and the hashes of each part
are XORed: two sets with symmetric difference d differ in at most d parts, so
by the pigeonhole principle any d + 1 parts hold an equal one.  Each class
gives the d + 1 parts that are rarest of its first d + 1 + s (s is fixed for
the band; parts that many documents share come last), classes that share a
part are candidates, a parity sketch (a bit per hash, flipped by each
shingle), whose Hamming distance can't exceed the symmetric difference, drops
most of them, and the exact sets decide the rest.

Why s may be dropped: of two sets, the one whose first d + 1 + s parts end
first shares at least s + 1 of them with the other; at most s can be hotter
than the coldest of these, so both sets keep that one.

Candidates are not all pairs of a group.  First every member of a part is
held against the group's first class; linked classes are united; groups whose
members still lie in different components then give the pairs with the closest
sketches that would join these; their other close pairs follow where they still
join components: kept from that pass if they are no more than ``LISTED_PAIRS`` a
row of the group, found anew if they are.

Long sketches travel folded to a quarter of their bits (a folded one's distance
can't exceed the symmetric difference either); the whole ones are only asked
for the pairs that pass.

Defined cases: a text without words (or null) has no shingles and links to
nothing; with fewer than five words the sequence is the only shingle;
repeated rows are one class; rows of one id with different texts are
different members; a null id takes part, but names no component unless no
other id is there; an empty table gives no rows; further columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import per_worker, plain_names, rows_to_batch, shuffle_partitions, text_blocks
from .components import bitmap, connected_components, in_bitmap

NGRAM = 5
SHARE = 75                   # per cent of the union that two sets have in common
BLOCK_CHARS = 3_000_000
BAND = 4                     # sizes of a band: 3*4^b up to 3*4^(b+1)
HOT_COUNT = 32               # a part in so many classes is worth putting off
HOT_LISTED = 200_000         # hottest parts that are broadcast (an order only)
PAIR_BLOCK = 1024            # members of a group that are paired at once
SKETCH_BITS = 4              # least bits of a sketch a shingle (a power of two)
LISTED_PAIRS = 8             # further close pairs a row of a group that are kept (about the bytes of a sketch)
WHOLE_WORDS = 4              # 64-bit words of a sketch that isn't folded to travel

_U = np.uint64
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M2
    x = (x ^ (x >> _U(27))) * _M3
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shingle_sets(texts: list[str | None], n: int = NGRAM) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    raw = [(t or "").encode().lower() for t in texts]  # A-Z only
    sizes = np.array([len(r) + 1 for r in raw], dtype=np.int64)
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    at = np.flatnonzero(first)
    if not len(at):
        return [np.zeros(0, dtype=np.uint64) for _ in texts]
    inner = np.flatnonzero(word)
    starts = np.searchsorted(inner, at)
    lengths = np.diff(np.r_[starts, len(inner)])
    place = np.arange(len(inner)) - np.repeat(starts, lengths)
    h = np.add.reduceat((data[inner].astype(np.uint64) + _U(1)) * _powers(0x100000001B3, int(lengths.max()))[place],
                        starts)
    h = _mix(h + lengths.astype(np.uint64) * _M1)
    doc = np.searchsorted(np.cumsum(sizes), at, side="right")
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    grams = np.zeros(0, dtype=np.uint64)
    coef = _mix(np.arange(1, n + 1, dtype=np.uint64) * _M1) | _U(1)
    if len(h) >= n:
        grams = h[:len(h) - n + 1] * coef[0]
        for k in range(1, n):
            grams = grams + h[k:len(h) - n + 1 + k] * coef[k]
        grams = _mix(grams)
    out = []
    for i in range(len(texts)):
        a, b = int(bounds[i]), int(bounds[i + 1])
        if b - a >= n:
            out.append(_distinct(grams[a:b - n + 1]))
        elif b > a:
            out.append(_mix(np.array([(h[a:b] * coef[:b - a]).sum() ^ _U(b - a)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def class_id(s: np.ndarray) -> int:
    """64-bit name of a set (0: the empty one)."""
    if not len(s):
        return 0
    total = _mix(s ^ _M1).sum(keepdims=True) + np.array([len(s)], dtype=np.uint64) * _M2
    return int(_mix(total).view(np.int64)[0])


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the shingles per bit, as 64-bit words; ``SKETCH_BITS`` to
    twice as many bits a shingle (fewer bits lose more of the difference)."""
    bits = max(64, SKETCH_BITS << int(len(s) - 1).bit_length())
    odd = np.bincount((_mix(s + _M3) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def band_of(n: int) -> int:
    b = 0
    while n >= 3 * BAND ** (b + 1):
        b += 1
    return b


def most_apart(n: int, partner: int) -> int:
    """Largest symmetric difference of linked sets of these sizes."""
    return (n + partner) * (100 - SHARE) // (100 + SHARE)


def bands_of(n: int) -> list[tuple[int, int]]:
    """(band, d) in which a set of ``n`` shingles meets its partners."""
    if n < 3:
        return []  # only equal sets link
    b = band_of(n)
    # a larger partner of the next band is met in this one, so d is not cut here
    out = [(b, most_apart(n, n * 100 // SHARE))]
    low = 3 * BAND ** b - 1
    if b and n * SHARE <= low * 100:
        out.append((b - 1, most_apart(n, low)))
    return out


def part_keys(s: np.ndarray, band: int, d: int) -> tuple[np.ndarray, int]:
    """The first d + 1 + spare part keys of a set in a band, and spare."""
    parts = max(16, 3 * BAND ** (band + 1) // 2)
    spare = max(2, 3 * BAND ** band // 6)
    spare = min(spare, parts - d - 1)
    p = ((_mix(s + _M2) >> _U(32)) * _U(parts)) >> _U(32)
    order = np.argsort(p, kind="stable")
    p, x = p[order], s[order]
    cut = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    tag = np.array([band + 1], dtype=np.uint64) * _M1
    keys = _mix(np.bitwise_xor.reduceat(_mix(x + tag), cut) + p[cut] * _M3 + tag)
    want = d + 1 + spare
    if len(keys) < want:  # empty parts come after all others
        empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), p[cut])[:want - len(keys)]
        keys = np.r_[keys, _mix(empty * _M3 + tag + _U(1))]
    return keys[:want], spare


class Rarity:
    """Counts of hot parts; 0 for the others."""

    def __init__(self, value: tuple[np.ndarray, np.ndarray]):
        self.keys, self.counts = value

    def rarest(self, keys: np.ndarray, spare: int) -> np.ndarray:
        """All but the ``spare`` hottest; equal counts go by key."""
        if spare <= 0:
            return keys
        hot = np.zeros(len(keys), dtype=np.int64)
        if len(self.keys):
            i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hot = np.where(self.keys[i] == keys, self.counts[i], 0)
        if not hot.any():
            return keys[np.argpartition(keys, len(keys) - spare)[:len(keys) - spare]]
        return keys[np.lexsort((keys, hot))[:len(keys) - spare]]


_SIGN = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()),
                   ("sk", pa.list_(pa.int64())), ("row", pa.int64())])


def _signatures():
    """kind 0: a document (its class, size, sketch and the name of its row);
    kind 1: a part key (``cls``) that ``n`` classes of the block share."""

    def run(batches):
        names: list = []

        def seen():
            for b in batches:
                names.extend(b.column(2).to_pylist())
                yield b

        for ids, texts in text_blocks(seen(), BLOCK_CHARS):
            row, names[:] = names[:len(ids)], names[len(ids):]
            cls, n, sk, parts, met = [], [], [], [], set()
            for s in shingle_sets(texts):
                c = class_id(s)
                cls.append(c)
                n.append(len(s))
                sk.append(sketch(s) if len(s) else None)
                if c in met:
                    continue
                met.add(c)
                parts += [part_keys(s, b, d)[0] for b, d in bands_of(len(s))]
            yield rows_to_batch({"kind": [0] * len(ids), "doc_id": ids, "n": n, "cls": cls, "sk": sk,
                                 "row": row}, _SIGN)
            if parts:
                k, c = np.unique(np.concatenate(parts), return_counts=True)
                k, c = k[c > 1].view(np.int64), c[c > 1]
                yield rows_to_batch({"kind": [1] * len(k), "doc_id": [None] * len(k), "n": c, "cls": k,
                                     "sk": [None] * len(k), "row": [None] * len(k)}, _SIGN)

    return run


def _part_rows(bc):
    """(part, cls) of the chosen parts; a class once a block."""
    schema = pa.schema([("part", pa.int64()), ("cls", pa.int64())])

    def run(batches):
        rarity = per_worker(bc, Rarity)
        for _, texts in text_blocks(batches, BLOCK_CHARS):
            keys, owners, met = [], [], set()
            for s in shingle_sets(texts):
                if len(s) < 3:
                    continue
                c = class_id(s)
                if c in met:
                    continue
                met.add(c)
                for b, d in bands_of(len(s)):
                    k = rarity.rarest(*part_keys(s, b, d))
                    keys.append(k)
                    owners.append(np.full(len(k), c, dtype=np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)),
                                                  pa.array(np.concatenate(owners))], schema=schema)

    return run


def _shared(batches):
    """Rows sorted by (part, cls) -> the parts that several classes share,
    with the group's first class."""
    schema = pa.schema([("part", pa.int64()), ("cls", pa.int64()), ("lead", pa.int64())])
    lead_part = lead = None
    last = None  # the newest row, not yet given out
    for b in batches:
        p, c = b.column(0).to_numpy(), b.column(1).to_numpy()
        if last is not None:
            p, c = np.r_[last[0], p], np.r_[last[1], c]
        if not len(p):
            continue
        keep = np.r_[True, (p[1:] != p[:-1]) | (c[1:] != c[:-1])]
        p, c = p[keep], c[keep]
        new = np.r_[True, p[1:] != p[:-1]]
        first = np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))
        leads = c[first].copy()
        if lead_part is not None:
            leads[p == lead_part] = lead
        alone = new & np.r_[new[1:], False] & (leads == c)
        out = ~alone
        out[-1] = False  # given out with the next rows
        last = (p[-1:], c[-1:])
        lead_part, lead = p[-1], leads[-1]
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (p, c, leads)], schema=schema)
    if last is not None and lead != last[1][0]:
        yield pa.RecordBatch.from_arrays([pa.array(last[0]), pa.array(last[1]), pa.array(np.array([lead]))],
                                         schema=schema)


def _hamming(a: Column, b: Column) -> Column:
    """Distance of two sketches; the longer one is folded, which keeps the
    parity of every bit."""
    xor = lambda x, y: x.bitwiseXOR(y)

    def fold(x: Column, n: Column) -> Column:
        return F.when(F.size(x) <= n, x).otherwise(F.zip_with(F.slice(x, 1, n), F.slice(x, n + 1, n), xor))

    n = F.least(F.size(a), F.size(b))
    bits = F.zip_with(fold(a, n), fold(b, n), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(bits, F.lit(0), lambda x, y: x + y)


def _folded(classes: DataFrame) -> DataFrame:
    """``classes`` with ``short``: the sketch of a quarter of the bits, by
    folding it twice; of no more than ``WHOLE_WORDS`` words it stays (short
    ones tell little apart)."""

    def once(c: str) -> Column:
        x = F.col(c)
        half = (F.size(x) / 2).cast("int")
        return F.when(F.size(x) <= WHOLE_WORDS, x).otherwise(
            F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v)))

    return classes.withColumn("_half", once("sk")).withColumn("short", once("_half")).drop("_half")


def _sized(pairs: DataFrame, classes: DataFrame, sk: str) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches ``sk`` allow a link."""
    one = lambda c: classes.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col(sk).alias(f"s{c}"))
    fits = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * SHARE)
    apart = F.floor((F.col("na") + F.col("nb")) * (100 - SHARE) / (100 + SHARE))
    return pairs.join(one("a"), "a").join(one("b"), "b").where(fits) \
        .where(_hamming(F.col("sa"), F.col("sb")) <= apart).select("a", "b")


def _set_rows(bc):
    """(cls, grams) of the documents whose id may be asked for."""
    schema = pa.schema([("cls", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def run(batches):
        bits = per_worker(bc, lambda v: v)
        for b in batches:
            ask = np.flatnonzero(in_bitmap(bits, b.column(2).to_numpy()))
            if not len(ask):
                continue
            for ids, texts in text_blocks([b.take(pa.array(ask))], BLOCK_CHARS):
                sets = shingle_sets(texts)
                yield rows_to_batch({"cls": [class_id(s) for s in sets], "grams": [s.view(np.int64) for s in sets]},
                                    schema)

    return run


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose sets link.  The texts asked for are found by a bitmap of
    fixed size in a scan, so no text is shuffled; only sets of candidates
    are."""
    pairs = materialize(pairs, "jaccard-pairs")
    ask = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    key = F.xxhash64(F.col("doc_id"))
    ids = ask.join(classes.select("cls", "rep"), "cls").select("cls", F.xxhash64("rep").alias("k"))
    bc = docs.sparkSession.sparkContext.broadcast({"value": bitmap(ids, "k")})
    sets = docs.select("doc_id", "text", key.alias("k")) \
        .mapInArrow(_set_rows(bc), "cls long, grams array<long>")
    sets = materialize(sets.join(ask, "cls", "left_semi").dropDuplicates(["cls"]), "jaccard-sets")
    right = sets.select(F.col("cls").alias("b"), F.col("grams").alias("gb"))
    left = sets.select(F.col("cls").alias("a"), F.col("grams").alias("ga"))
    both = F.size(F.array_intersect("ga", "gb"))
    return pairs.join(right, "b").join(left, "a") \
        .where(both * 100 >= (F.size("ga") + F.size("gb") - both) * SHARE).select("a", "b")


def _close_pairs(group: list[tuple], across: bool, forest: bool) -> tuple[set[tuple[int, int]], set[tuple[int, int]]]:
    """Pairs of a group (rows n, cls, comp, block, sketch, its bits) of
    different components, and of different blocks if ``across``, whose sizes
    and sketches allow a link.  Rows are ordered by size, so a row meets only
    those of its size window.  ``forest``: only the closest pairs that
    together join the components (fewer than there are rows), and then the
    others."""
    group.sort()
    out = set()
    close = []
    for i, (n, cls, comp, blk, sk, bits) in enumerate(group):
        for m, cls2, comp2, blk2, sk2, bits2 in group[i + 1:]:
            if m * SHARE > n * 100:
                break
            if comp == comp2 or (across and blk == blk2):
                continue
            if bits2 > bits:  # fold the longer sketch, which keeps the parity
                sk2 = (sk2 & ((1 << bits) - 1)) ^ (sk2 >> bits)
            if (apart := (sk ^ sk2).bit_count()) <= most_apart(n, m):
                if forest:
                    close.append((apart, min(cls, cls2), max(cls, cls2), comp, comp2))
                else:
                    out.add((min(cls, cls2), max(cls, cls2)))
    root: dict[int, int] = {}
    for _, a, b, x, y in sorted(close):
        while root.get(x, x) != x:
            x = root[x]
        while root.get(y, y) != y:
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)
            out.add((a, b))
    return out, {(a, b) for _, a, b, _, _ in close} - out


_FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def _pairs_between(batches, forest: bool = False):
    """Rows sorted by (part, x, y) -> candidate pairs of every group (kind 0);
    rows of two blocks are paired across them only.  ``forest``: the others are
    of kind 2, or kind 1 names the part if they are too many."""
    key, group, out = None, [], set()

    def done():
        if key is None or len(group) < 2:
            return
        pairs, more = _close_pairs(group, key[1] != key[2], forest)
        out.update((0, a, b) for a, b in pairs)
        if len(more) <= LISTED_PAIRS * len(group):
            out.update((2, a, b) for a, b in more)
        else:
            out.add((1, key[0], None))

    def rows():
        return rows_to_batch(dict(zip(("kind", "a", "b"), zip(*out, strict=True), strict=True)), _FOUND)

    for b in batches:
        part, x, y, blk, cls, comp, n = (c.to_pylist() for c in b.columns[:7])
        sk = b.column(7)
        words, at = sk.flatten().to_numpy(), np.r_[0, np.cumsum(sk.value_lengths().to_numpy())].tolist()
        for i in range(b.num_rows):
            k = (part[i], x[i], y[i])
            if k != key:
                done()
                key, group = k, []
                if len(out) > 10_000:
                    yield rows()
                    out.clear()
            v = words[at[i]:at[i + 1]]
            group.append((n[i], cls[i], comp[i], blk[i], int.from_bytes(v.tobytes(), "little"), 64 * len(v)))
    done()
    if out:
        yield rows()


def _open_pairs(shared: DataFrame, comp: DataFrame, classes: DataFrame, sk: str, forest: bool) -> DataFrame:
    """Candidate pairs, by the sketches ``sk``, inside the groups that hold
    several components (see ``_pairs_between``)."""
    n = shuffle_partitions(shared.sparkSession)
    named = shared.where("cls <> lead").select("part", "cls") \
        .join(comp.withColumnRenamed("node", "cls"), "cls", "left") \
        .select("part", "cls", F.coalesce("label", "cls").alias("comp"))
    open_ = named.groupBy("part").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b"),
                                      F.count(F.lit(1)).alias("_g")).where("_a <> _b").select("part", "_g")
    rows = named.join(open_, "part").join(classes.select("cls", "n", F.col(sk).alias("sk")), "cls") \
        .withColumn("_nb", F.ceil(F.col("_g") / PAIR_BLOCK).cast("int")) \
        .withColumn("_mine", F.pmod(F.xxhash64("cls"), F.col("_nb")).cast("int")) \
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))) \
        .select("part", F.least("_mine", "_other").alias("x"), F.greatest("_mine", "_other").alias("y"),
                F.col("_mine").alias("blk"), "cls", "comp", "n", "sk")
    return rows.repartition(n, "part", "x", "y").sortWithinPartitions("part", "x", "y") \
        .mapInArrow(lambda b: _pairs_between(b, forest), "kind int, a long, b long").distinct()


def _joined(comp: DataFrame, found: DataFrame) -> DataFrame:
    """Components with the found links, too: only the labels that these join
    are gone through."""
    found = materialize(found, "jaccard-links")
    if not found.limit(1).count():
        return comp
    for c in ("a", "b"):
        found = found.join(comp.select(F.col("node").alias(c), F.col("label").alias(f"_{c}")), c, "left")
    to = connected_components(found.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")))
    moved = comp.join(to.select(F.col("node").alias("label"), F.col("label").alias("_to")), "label", "left") \
        .select("node", F.coalesce("_to", "label").alias("label"))
    return materialize(moved.unionByName(to.join(comp, "node", "left_anti")), "labels")


def _components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, cls, row) of ``docs`` (doc_id, text, row) and the
    component (label, rep) of each class with words."""
    spark = docs.sparkSession
    text = docs.select("doc_id", "text")
    signed = materialize(docs.select("doc_id", "text", "row").mapInArrow(
        _signatures(), "kind int, doc_id long, n long, cls long, sk array<long>, row long"),
        "jaccard-signatures", ["kind"])
    rows = signed.where("kind = 0")
    classes = materialize(_folded(rows.where("n > 0").groupBy("cls").agg(
        F.min("n").alias("n"), F.min("doc_id").alias("rep"), F.first("sk").alias("sk"))), "jaccard-classes")
    hot = signed.where("kind = 1").groupBy("cls").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_COUNT) \
        .orderBy(F.desc("n"), "cls").limit(HOT_LISTED).toPandas()
    keys = hot["cls"].to_numpy(np.int64).view(np.uint64) if len(hot) else np.zeros(0, np.uint64)
    order = np.argsort(keys)
    bc = spark.sparkContext.broadcast(
        {"value": (keys[order], hot["n"].to_numpy(np.int64)[order] if len(hot) else np.zeros(0, np.int64))})
    parts = text.mapInArrow(_part_rows(bc), "part long, cls long")
    shared = materialize(
        parts.repartition(shuffle_partitions(spark), "part").sortWithinPartitions("part", "cls")
        .mapInArrow(_shared, "part long, cls long, lead long"), "jaccard-shared")

    star = shared.where("cls <> lead").select(F.least("cls", "lead").alias("a"), F.greatest("cls", "lead").alias("b"))
    near = materialize(_sized(star.distinct(), classes, "short"), "jaccard-near")
    links = materialize(_verified(_sized(near, classes, "sk"), docs, classes), "jaccard-links")
    comp = connected_components(links)

    # groups of three and more whose members are not yet together: first the
    # closest pairs that would join them, then every pair that is still open
    found = materialize(_open_pairs(shared, comp, classes, "short", True), "jaccard-near", ["kind"])
    first, others = (found.where(f"kind = {k}").select("a", "b") for k in (0, 2))
    comp = _joined(comp, _verified(_sized(first, classes, "sk"), docs, classes))
    for c in ("a", "b"):
        others = others.join(comp.select(F.col("node").alias(c), F.col("label").alias(f"_{c}")), c, "left")
    others = others.where("coalesce(_a, a) <> coalesce(_b, b)").select("a", "b").join(first, ["a", "b"], "left_anti")
    others = materialize(others, "jaccard-near")
    many = shared.join(found.where("kind = 1").select(F.col("a").alias("part")), "part", "left_semi")
    pairs = _sized(others, classes, "sk").unionByName(_open_pairs(many, comp, classes, "sk", False).select("a", "b"))
    comp = _joined(comp, _verified(pairs.distinct(), docs, classes))

    member = classes.select("cls", "rep").join(comp.withColumnRenamed("node", "cls"), "cls", "left") \
        .select("cls", "rep", F.coalesce("label", "cls").alias("label"))
    return rows, member


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, cls, for every row of ``docs``."""
    rows, member = _components(docs.select("doc_id", "text", F.lit(None).cast("long").alias("row")))
    ids = member.groupBy("label").agg(F.min("rep").alias("component_id"))
    named_ids = member.join(ids, "label").select("cls", "component_id")
    out = rows.where("n > 0").join(named_ids, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                                                           "cls")
    return out.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"),
                                                      F.col("doc_id").alias("component_id"), "cls"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id
    (null last) and, among the component's rows of that id, the smallest hash
    of the row.  Rows of that id in other components don't matter; a text
    without words is like no other and stays, repeated or not."""
    given, docs = docs.columns, plain_names(docs)
    cols = docs.columns
    words = F.coalesce(F.col("text").rlike(r"[^ \x09-\x0D]"), F.lit(False))
    named = docs.withColumn("_row", F.xxhash64(*cols, *[F.col(c).isNull() for c in cols]))
    rows, member = _components(named.where(words).select("doc_id", "text", F.col("_row").alias("row")))
    rows = rows.join(member.select("cls", "label"), "cls").groupBy("label", "doc_id", "row").count()
    first = rows.groupBy("label").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "count")).alias("f"))
    keep = materialize(first.select(F.col("f.doc_id").alias("_id"), F.col("f.row").alias("_kept"),
                                    F.col("f.count").alias("_times")), "jaccard-kept")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_kept"))
    once = named.where(words).join(keep.where("_times = 1"), same, "left_semi")
    again = named.where(words).join(keep.where("_times > 1"), same, "left_semi").dropDuplicates(["doc_id", "_row"])
    return once.unionByName(again).drop("_row").unionByName(docs.where(~words)).toDF(*given)
