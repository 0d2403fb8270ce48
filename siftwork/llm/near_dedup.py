"""Near-duplicate documents by an LSH forest over MinHash signatures.

Documents with the same shingle set are one class. Each class has TREES labels of DEPTH MinHash values. A
tree sorts the classes by its label; classes that share the first START values are a region.

First the families are joined: the first JOINING trees' classes that share a region are sorted by label, and in runs of
this order each class meets its neighbours of longest common prefix and a leader, the class that agrees most with the
run's majority values. The spanning forest of what looks similar is confirmed on the full shingle sets, and the
components of the links are taken. Then, in all trees, only regions that still hold several components matter. In one of
up to REGION classes, all pairs of different components that look similar are confirmed. A larger one is crowded, and
its depth adapts: it is split by the rarest shingles of its classes. Two sets of the wanted similarity share one of
each set's first n - wanted + 1 shingles in any common order; in an order by rising frequency over all crowded classes
these are what a class does not share with its family. Classes that share such a shingle are a region of
its own; if that is crowded still, its classes outside the largest component meet all others in blocks of BLOCK. A pair is looked at by its sizes, its parity sketches
and its estimated similarity where its region lies, so that few pairs but links are confirmed.
So no pair of a crowded region is left unseen, and a family does not form its pairs.

A link is 100 * |A & B| >= percent * |A | B| (85 in the query, 80 in keep_first) on sets of 5-word shingles (64-bit hashes). Texts
without words link with nothing; shorter texts are one shingle. Null is a text without words. Rows that share an id are
one document, whose text is the smallest of theirs; rows without an id belong to no group and are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SHINGLE = 5
TREES = 16
DEPTH = 8
START = 3
#: Trees that join the families.
JOINING = 4
REGION = 48
#: Classes of one run of the sorted order that get a leader, and neighbours before a class in the order.
RUN = 512
NEIGHBOURS = 3
#: Counters of the shingle frequencies that order a crowded class's shingles; any order gives the same links.
COUNTERS = 1 << 20
#: How far under the limit a pair's estimated similarity may lie to be confirmed; five standard errors and more,
#: so that a pair at the limit is dropped with a probability of 1 in 10,000,000 or less.
MARGIN = 20
#: Bits of a class's parity sketch: bit b tells whether an odd number of its shingles fall on b. Two sets differ in at least
#: as many shingles as their sketches differ in bits, so a pair with too many such bits is no link, without exception.
PARITY = 1024
#: Classes on either side of a cell of a region that rare shingles leave crowded.
BLOCK = 512
PERCENT = 85
#: Limit of keep_first, the usual one of near-duplicates.
KEEP_PERCENT = 80

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SEEDS = common.mix64(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = _SEEDS | np.uint64(1)
_ADD = common.mix64(_SEEDS)


def shingle_sets(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and the size of each set."""
    numbers: dict[bytes, int] = {}
    number = numbers.setdefault
    counts, ids = [], []
    for t in texts:
        words = t.translate(_LOWER).split() if t else ()
        counts.append(len(words))
        ids.append(np.fromiter((number(w, len(numbers)) for w in words), np.int64, len(words)))
    counts = np.array(counts, np.int64)
    if not counts.sum():
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in numbers), np.uint64, len(numbers))
    # four empty words after each text: a text of fewer than five words has one shingle, its whole sequence
    short = np.where((counts > 0) & (counts < SHINGLE), SHINGLE - counts, 0)
    total = counts + short
    flat = np.zeros(int(total.sum()), np.uint64)
    doc = np.repeat(np.arange(len(texts)), total)
    starts = np.cumsum(total) - total
    inside = np.arange(len(flat)) - starts[doc] < counts[doc]
    flat[inside] = hashes[np.concatenate(ids)]
    n = len(flat) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    key = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        key = key * np.uint64(0x2545F4914F6CDD1D) + common.mix64(flat[j : j + n] + np.uint64(j + 1))
    key = common.mix64(key)
    whole = doc[:n] == doc[SHINGLE - 1 :]
    key, own = key[whole], doc[:n][whole]
    order = np.lexsort((key, own))
    key, own = key[order], own[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    key, own = key[fresh], own[fresh]
    return key, np.bincount(own, minlength=len(texts))


def signatures(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """MinHash values (uint32) of each non-empty set."""
    full = sizes[sizes > 0]
    starts = np.cumsum(full) - full
    out = np.empty((len(full), TREES * DEPTH), np.uint32)
    for k in range(TREES * DEPTH):
        value = (sets * _ODD[k] + _ADD[k]) >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(value.astype(np.uint32), starts) if len(full) else 0
    return out


def parities(sets: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Parity sketch of each non-empty set."""
    full = sizes[sizes > 0]
    ends = np.cumsum(full)
    out: list[bytes] = []
    for at in range(0, len(full), 1024):
        n = full[at : at + 1024]
        part = sets[ends[at] - full[at] : ends[at] - full[at] + n.sum()]
        slot = np.repeat(np.arange(len(n)) * PARITY, n) + (part % np.uint64(PARITY)).astype(np.int64)
        odd = np.bincount(slot, minlength=len(n) * PARITY).astype(np.uint8) & 1
        out += [row.tobytes() for row in np.packbits(odd.reshape(len(n), PARITY), axis=1)]
    return out


def _shorts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Low halves of the MinHash values, and parity words, of the column short."""
    rows = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), 2 * TREES * DEPTH + PARITY // 8)
    return np.ascontiguousarray(rows[:, : 2 * TREES * DEPTH]).view(np.uint16), np.ascontiguousarray(rows[:, 2 * TREES * DEPTH :]).view(np.uint64)


def _similar(i: np.ndarray, j: np.ndarray, size: np.ndarray, sig: np.ndarray, odd: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) that sizes, parities and the estimated similarity admit, and that estimate; exact but for the estimate."""
    left, right, same = [], [], []
    for at in range(0, len(i), 1 << 16):
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        fits = 100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b])
        a, b = a[fits], b[fits]
        apart = np.bitwise_count(odd[a] ^ odd[b]).sum(axis=1, dtype=np.int64)
        fits = (100 + percent) * apart <= (100 - percent) * (size[a] + size[b])
        a, b = a[fits], b[fits]
        share = (sig[a] == sig[b]).mean(axis=1)
        fits = share >= (percent - MARGIN) / 100
        left.append(a[fits])
        right.append(b[fits])
        same.append(share[fits])
    if not left:
        return i, j, np.zeros(0)
    return np.concatenate(left), np.concatenate(right), np.concatenate(same)


def sketch(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, set_hash (of the whole set; null if empty) and signature and parity (binary)."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_slices(batch, 1, 2 << 20):
                sets, sizes = shingle_sets(common.as_bytes(part.column(1)))
                labels, odd = iter(signatures(sets, sizes)), iter(parities(sets, sizes))
                ends = np.cumsum(sizes)
                whole = [xxhash.xxh3_128_digest(sets[e - n : e].tobytes()) if n else None for e, n in zip(ends, sizes, strict=True)]
                made = [pa.array([next(labels).tobytes() if n else None for n in sizes], pa.binary()), pa.array([next(odd) if n else None for n in sizes], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(whole, pa.binary()), *made],
                                                 names=["doc_id", "n_shingles", "set_hash", "signature", "parity"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles bigint, set_hash binary, signature binary, parity binary")


def _trees(classes: DataFrame, trees: int, *columns: str) -> DataFrame:
    """A row for each class and tree: the columns, tree and region key (of the first START label values)."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    at = F.col("tree") * (4 * DEPTH) + 1
    return classes.select(*columns, "signature", tree.alias("tree")).select(*columns, "tree", F.xxhash64("tree", F.col("signature").substr(at, F.lit(4 * START))).alias("key"))


def sorted_order(classes: DataFrame) -> DataFrame:
    """Rows (tree, label, rep, size, short) of the joining trees' shared regions, in sorted order; a region may go over several partitions."""
    keys = _trees(classes, JOINING, "rep")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    met = keys.join(shared, "key").groupBy("rep").agg(F.collect_set("tree").alias("trees"))  # JOINING at most
    met = common.materialize(met, "met", True)  # so that Spark knows its size and shuffles the signatures only where it is large
    rows = classes.join(met, "rep").select("rep", "size", "short", "signature", F.explode("trees").alias("tree"))
    rows = common.materialize(rows.select("tree", F.col("signature").substr(F.col("tree") * (4 * DEPTH) + 1, F.lit(4 * DEPTH)).alias("label"), "rep", "size", "short"), "labels", True)
    parts = max(1, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartitionByRange(parts, "tree", "label", "rep").sortWithinPartitions("tree", "label", "rep")


def neighbours(ordered: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Distinct pairs (a, b) that may join families: for each run of a region in sorted order, a spanning forest of similar classes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in (*batches, None):
            rows = batch if held is None else held if batch is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if rows is None or not rows.num_rows:
                continue
            region = [(t, x[: 4 * START]) for t, x in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)]
            edge = [0, *(k for k in range(1, len(region)) if region[k] != region[k - 1]), len(region)]
            if batch is not None:  # the last region may go on
                edge.pop()
            held = rows.slice(edge[-1])
            if batch is not None and held.num_rows > 4 * RUN:  # but its first runs are full
                edge.append(edge[-1] + held.num_rows // RUN * RUN)
                held = rows.slice(edge[-1] - 1)
            rep, size = (rows.column(k).to_numpy() for k in (2, 3))
            sig, odd = _shorts(rows.column(4))
            left, right = [], []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                for start in range(a, b - 1, RUN):
                    own = slice(start, min(b, start + RUN + 1))  # one class is in both of two runs
                    i, j = _run_pairs(rep[own], size[own], sig[own], odd[own], percent)
                    left.append(rep[own][i])
                    right.append(rep[own][j])
            if left:
                x, y = np.concatenate(left), np.concatenate(right)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return ordered.mapInArrow(run, "a bigint, b bigint").distinct()


def _run_pairs(rep: np.ndarray, size: np.ndarray, sig: np.ndarray, odd: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of one run: a maximum spanning forest of all pairs of a small run, else of leader and neighbours."""
    n = len(rep)
    if n <= REGION:
        i, j = np.triu_indices(n, 1)
    else:
        agree = (sig == np.sort(sig, axis=0)[n // 2]).sum(axis=1)
        lead = int(np.lexsort((rep, -agree))[0])
        others = np.delete(np.arange(n), lead)
        steps = [np.arange(n - k) for k in range(1, NEIGHBOURS + 1)]
        i, j = np.concatenate((np.full(n - 1, lead), *steps)), np.concatenate((others, *[s + k for k, s in enumerate(steps, 1)]))
    other = rep[i] != rep[j]
    i, j, same = _similar(i[other], j[other], size, sig, odd, percent)
    picked = _forest(n, i, j, same)
    return i[picked], j[picked]


def open_regions(classes: DataFrame) -> DataFrame:
    """Members (region, rep, component, n) of the regions of all trees that hold several components of classes(rep, component, signature)."""
    keys = _trees(classes, TREES, "rep", "component")
    mixed = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key", "n")
    return keys.join(mixed, "key").select(F.col("key").alias("region"), "rep", "component", "n")


def rare_shingles(crowded: DataFrame, documents: DataFrame, percent: int) -> DataFrame:
    """Members (region, rep, component, n) of the regions of rare shingles of crowded(rep, component), of several components each."""
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("bigint").alias("rep"), "text").join(crowded, "rep")
    texts = common.materialize(texts.select("rep", "text", "component"), "crowded-texts", True)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part in common.text_slices(batch, 0, 2 << 20):
                sets, _ = shingle_sets(common.as_bytes(part.column(0)))
                total += np.bincount((sets & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["slot", "n"])

    counted = texts.select("text").mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # COUNTERS rows at most
    often = np.zeros(COUNTERS, np.int64)
    often[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    sent = spark.sparkContext.broadcast(often)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = sent.value
        for batch in batches:
            for part in common.text_slices(batch, 1, 2 << 20):
                sets, sizes = shingle_sets(common.as_bytes(part.column(1)))
                own = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((sets, often[(sets & np.uint64(COUNTERS - 1)).astype(np.int64)], own))
                place = np.arange(len(sets)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                keep = place <= (sizes + (-sizes * percent) // 100)[own]
                at = own[keep]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), part.column(2).take(pa.array(at)), pa.array(sets[order][keep].view(np.int64))], names=["rep", "component", "region"])

    rows = common.materialize(texts.mapInArrow(first, "rep bigint, component bigint, region bigint"), "rare-shingles", True)
    common.drop_table(texts)
    mixed = rows.groupBy("region").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("region", "n")
    return rows.join(mixed, "region").select("region", "rep", "component", "n")


def blocks(crowded: DataFrame) -> DataFrame:
    """Members (region, rep, component) of crowded regions in cells: a block of the classes outside the largest component with a block of all."""
    sizes = crowded.groupBy("region", "component").agg(F.count("*").alias("m"), F.max("n").alias("n"))
    main = sizes.groupBy("region").agg(F.max_by("component", "m").alias("main"), (F.max("n") - F.max("m")).alias("minor"))
    rows = crowded.join(main, "region").withColumn("is_minor", F.expr("component <> main"))
    few, many = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("minor", "n"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    mine = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    as_minor = rows.where("is_minor").select("region", "rep", "component", mine(few).alias("i"), F.explode(every(many)).alias("j"))
    as_other = rows.select("region", "rep", "component", mine(many).alias("j"), F.explode(every(few)).alias("i"))
    both = as_minor.unionByName(as_other)
    return both.select(F.xxhash64("region", "i", "j").alias("region"), "rep", "component").distinct()


def _forest(n: int, left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> list[int]:
    """Edges of a maximum spanning forest of one region."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for k in np.argsort(-weight, kind="stable").tolist():
        a, b = root(int(left[k])), root(int(right[k]))
        if a != b:
            parent[a] = b
            out.append(k)
    return out


def _pairs_of(region: np.ndarray, rep: np.ndarray, group: np.ndarray, size: np.ndarray, sig: np.ndarray, odd: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Similar pairs of different groups inside each region of rows sorted by region."""
    edge = np.flatnonzero(np.concatenate(([True], region[1:] != region[:-1], [True])))
    left_all, right_all = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        i, j = np.triu_indices(b - a, 1)
        i, j = a + i, a + j
        apart = group[i] != group[j]
        i, j, _ = _similar(i[apart], j[apart], size, sig, odd, percent)
        left_all.append(rep[i])
        right_all.append(rep[j])
    left, right = np.concatenate(left_all), np.concatenate(right_all)
    return np.minimum(left, right), np.maximum(left, right)


def candidates(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Distinct candidate pairs (a, b) of members(region, rep, component, size, short)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in (*batches, None):
            rows = batch if held is None else held if batch is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if rows is None or not rows.num_rows:
                continue
            region = rows.column(0).to_numpy()
            end = len(region) if batch is None else int(np.searchsorted(region, region[-1]))  # the last region may go on
            held = rows.slice(end)
            if end:
                part = rows.slice(0, end)
                sig, odd = _shorts(part.column(4))
                rep, group, size = (part.column(k).to_numpy() for k in (1, 2, 3))
                a, b = _pairs_of(region[:end], rep, group, size, sig, odd, percent)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    found = members.select("region", "rep", "component", "size", "short").repartition("region").sortWithinPartitions("region").mapInArrow(run, "a bigint, b bigint")
    return found.distinct()


def confirm(pairs: DataFrame, documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose full shingle sets meet the limit."""
    ids = pairs.select(F.col("a").alias("__rep")).union(pairs.select("b")).distinct()
    texts = documents.select(F.col("doc_id").cast("bigint").alias("rep"), "text").join(ids, F.col("rep") == F.col("__rep"), "left_semi")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_slices(batch, 1, 2 << 20):
                sets, sizes = shingle_sets(common.as_bytes(part.column(1)))
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sets[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)], pa.binary())], names=["rep", "shingles"])

    sets = common.materialize(texts.mapInArrow(sets_of, "rep bigint, shingles binary").dropDuplicates(["rep"]), "shingles", True)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_slices(batch, 2):
                left = [np.frombuffer(x, np.uint64) for x in part.column(2).to_pylist()]
                right = [np.frombuffer(x, np.uint64) for x in part.column(3).to_pylist()]
                keep = []
                for x, y in zip(left, right, strict=True):
                    both = np.concatenate((x, y))
                    both.sort(kind="stable")
                    shared = int(np.count_nonzero(both[1:] == both[:-1]))
                    keep.append(100 * shared >= percent * (len(both) - shared))
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask)], names=["a", "b"])

    first = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a")
    both = first.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint")


def one_text(documents: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """doc_id and text with one row for each id (and all rows without one); and the ids that several rows have, with their number."""
    narrow = documents.select("doc_id", "text")
    again = narrow.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if again.isEmpty():
        return narrow, None
    again = common.materialize(again, "repeated-ids", True)
    ids = again.select("doc_id")
    return narrow.join(ids, "doc_id", "left_anti").unionByName(narrow.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))), again


def links_of(classes: DataFrame, documents: DataFrame, percent: int) -> DataFrame:
    """Components (rep, component) of the links of classes(rep, size, signature, short)."""
    tried = common.materialize(neighbours(sorted_order(classes), percent), "tried", True)
    links = common.materialize(confirm(tried, documents, percent), "links", True)
    parts = common.materialize(common.components(links, "a", "b"), "parts", True).select(F.col("node").alias("rep"), "component")
    known = classes.join(parts, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    members = common.materialize(open_regions(known), "open-regions", True)
    # written, so that Spark knows its size and shuffles the texts only where it is large
    crowded = common.materialize(members.where(F.col("n") > REGION).select("rep", "component").distinct(), "crowded", True)
    members = members.where(F.col("n") <= REGION).select("region", "rep", "component")
    if not crowded.isEmpty():
        rare = common.materialize(rare_shingles(crowded, documents, percent), "rare-regions", True)
        members = members.unionByName(rare.where(F.col("n") <= REGION).select("region", "rep", "component")).unionByName(blocks(rare.where(F.col("n") > REGION)))
    members = members.join(classes.select("rep", "size", "short"), "rep")
    more = common.materialize(candidates(members, percent).join(tried, ["a", "b"], "left_anti"), "more", True)
    if more.isEmpty():
        return parts
    found = common.materialize(confirm(more, documents, percent), "found", True)
    return parts if found.isEmpty() else common.components(links.unionByName(found), "a", "b").select(F.col("node").alias("rep"), "component")


def group(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id and kept; links of at least percent similarity."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    texts, again = one_text(documents)
    made = common.materialize(sketch(texts), "sketch", True)
    ids = made.select(F.col("doc_id").cast("bigint").alias("doc_id"), "n_shingles", "set_hash")
    reps = common.materialize(ids.where("set_hash is not null and doc_id is not null").groupBy("set_hash").agg(F.min("doc_id").alias("rep")), "classes", True)
    signed = made.select(F.col("doc_id").cast("bigint").alias("rep"), F.col("n_shingles").alias("size"), "signature", "parity").where("signature is not null")

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, odd = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            short = [np.frombuffer(x, np.uint32).astype(np.uint16).tobytes() + y for x, y in zip(values, odd, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(short, pa.binary())], names=["rep", "size", "signature", "short"])

    classes = signed.join(reps.select("rep"), "rep", "left_semi").mapInArrow(shorten, "rep bigint, size bigint, signature binary, short binary")
    parts = links_of(common.materialize(classes, "signatures", True), texts, percent)
    named = reps.join(parts, "rep", "left").select("set_hash", F.coalesce("component", "rep").alias("__component"))
    component = F.coalesce("__component", "doc_id")
    out = ids.join(named, "set_hash", "left").select(F.col("doc_id").cast(kind).alias("doc_id"), "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
                                                     (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))
    if again is None:
        return out
    return out.join(again, "doc_id", "left").select(*out.columns, F.explode(F.sequence(F.lit(1).cast("bigint"), F.coalesce("n", F.lit(1)))).alias("__row")).drop("__row")


def keep_first(documents: DataFrame, percent: int = KEEP_PERCENT) -> DataFrame:
    """The documents without all but the first (smallest doc_id) of each group; one row of a repeated doc_id."""
    grouped = common.materialize(group(documents, percent), "near-groups", True)
    gone = grouped.where("not kept").select("doc_id").distinct()
    left = documents.join(gone, "doc_id", "left_anti").select(*documents.columns)
    again = grouped.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("__n")).where("__n > 1").select("doc_id")
    if again.isEmpty():
        return left
    return left.join(again, "doc_id", "left_anti").unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(*documents.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return group(common.table(spark, sf_dir, "documents"))
