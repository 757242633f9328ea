"""N-gram Jaccard join in metric space: pivots, Voronoi regions, triangle-inequality windows, exact verification.

Documents are sets of k-word shingles. Two distances are used, both metrics: the
number of differing shingles, ``|x ^ y|``, and the Jaccard distance ``1 - J``.

1.  *Anchor pivots.* Fix a total order of all shingles. The pivot of shingle ``s``
    is the family of sets whose least shingle is ``s``; a document lies in the
    Voronoi region of its own least shingle (distance 0). The distance of ``x`` to
    another pivot ``s`` of its shingles is the number of its shingles before ``s``,
    the edits that make ``s`` the least one. If ``x`` and ``y`` link, both are
    within ``n - ceil(t n)`` edits of the region of their least common shingle, so by
    the triangle inequality it is enough to replicate a document into the regions
    of its first ``n - ceil(t n) + 1`` shingles. Order is by frequency class in a
    table of counts of fixed size, then by hash: regions of common passages come
    last, which costs nothing in exactness.
    A shingle that many documents of a task have in their window is dealt out already there: all but a few of those rows
    wait until the region's pivot is known, so that no task gathers a hot region.
2.  *Document pivots.* A region of more than ``region`` members is not paired. Its member of least
    hashed id is its pivot, regions of one pivot join, and all members are compared with it exactly.
    Those near it join its component. Where others remain, the region recurses: shells of distance to
    the pivot are cut into blocks of bounded size, and a block meets only blocks of shells inside the
    window, as distances of linked documents to the pivot differ by ``1 - t`` at most, and none of
    the same single component. Two blocks are joined exactly, by a matrix product, which gives a forest of links.
3.  *Bounds and verification.* A pair must share enough of its windows, and parity bits of its sets may differ
    in no more places than linked sets can (``|x ^ y|`` again, from below). What passes is verified on the whole sets
    of shingle hashes. No cap drops anything.

Equal sets count as one node from the start, so copies are never paired.

Shingles are 64-bit hashes. Two sets of n shingles are judged by a false common one with a chance of n^2 / 2^64
(5e-15 for n = 300), and two different sets taken as equal with 1 / 2^128 for each pair of documents, which is 2e-17 for
10^11 of them together.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernels
from .common import Scratch, join_counts, join_long_counts, located, mark, marked, salted
from .components import connected_components

#: Cells of the table of shingle counts: 2^22 classes of one byte go to each executor, whatever the input.
CELLS = 1 << 22
#: Cells that one row of the count exchange holds; a task counts up to 255 in each.
BLOCK = 1 << 14
#: Only shingles below this part of the hash range are counted; the others have class 0.
COUNTED = np.uint64(int(0.35 * 2**64))
#: Members up to which a region is paired directly.
REGION = 32
#: Shells of distance to the pivot in the width of a window, and members of a block, about.
SHELLS, BLOCK_ROWS = 4, 128
#: Columns of shingles that one step of a block's matrix product takes.
COLUMNS = 8192


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _profile(k: int):
    """Rows (id, place, n, d1, d2) of documents (place, id, text) and, at the end of a task, rows (block, counts) of shingle counts."""
    schema = pa.schema([("id", pa.int64()), ("place", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        counts = np.zeros(CELLS, np.uint32)
        for batch in batches:
            sizes, first, second = [], [], []
            for _, _, data, offsets in kernels.slices(batch.column(2)):
                for s in kernels.shingle_sets(data, offsets, k):
                    sizes.append(len(s))
                    first.append(int(np.sum(kernels.mix(s), dtype=np.uint64)) if len(s) else 0)
                    second.append(int(np.sum(kernels.mix(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)) if len(s) else 0)
                    np.add.at(counts, (s[: np.searchsorted(s, COUNTED)] % np.uint64(CELLS)).astype(np.int64), 1)
            none = pa.nulls(len(sizes))
            yield pa.record_batch([batch.column(1), batch.column(0), pa.array(sizes, pa.int64()), pa.array(_signed(np.array(first, np.uint64))), pa.array(_signed(np.array(second, np.uint64))), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        blocks = counts.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(1))
        none = pa.nulls(len(used)).cast(pa.int64())
        yield pa.record_batch([none, none, none, none, none, pa.array(used.astype(np.int32)), pa.array([np.minimum(blocks[i], 255).astype(np.uint8).tobytes() for i in used], pa.binary())], schema=schema)

    return run, "id long, place long, n long, d1 long, d2 long, block int, counts binary"


def _summed(batches):
    """Sum the counts of each block that this task holds; a running sum, not a gathered group."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            got = np.frombuffer(counts, np.uint8).astype(np.int64)
            totals[block] = totals[block] + got if block in totals else got
    yield pa.record_batch([pa.array(list(totals), pa.int32()), pa.array([np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes() for x in totals.values()], pa.binary())], names=["block", "counts"])


def _classes(profile: DataFrame) -> np.ndarray:
    """The frequency class of each cell: 0 up to what chance puts there (three deviations above the mean, and four), one more for each doubling of the rest."""
    sums = profile.where("block is not null").select("block", "counts").repartition("block").mapInArrow(kernels.tidy(_summed), "block int, counts binary")
    counts = np.zeros(CELLS, np.uint32)
    # A job for each partition, so there are few, of 2 MB.
    for row in sums.coalesce(8).toLocalIterator():
        counts[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(row.counts, np.uint32)
    load = float(np.partition(counts, CELLS // 2)[CELLS // 2])
    out = np.zeros(CELLS, np.uint8)
    for i in range(0, CELLS, 1 << 16):  # the driver has little memory
        over = counts[i : i + (1 << 16)] - (load + 3 * math.sqrt(load) + 4)
        out[i : i + (1 << 16)] = np.where(over > 0, np.log2(np.maximum(over, 1)).astype(np.int64) + 1, 0)
    del counts
    kernels.trim()
    return out


def _least(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """ceil(t n)."""
    return -((-num * n) // den)


#: Anchor rows that a task looks through at once for keys that are hot already there.
CHUNK = 1 << 20
#: Parity bits of a set.
PARITY = 1024


def _parity(s: np.ndarray) -> np.ndarray:
    """One bit for each of ``PARITY`` cells: whether an odd number of shingles falls into it."""
    odd = np.bincount((kernels.mix(s ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _window(s: np.ndarray, num: int, den: int, cls: np.ndarray) -> np.ndarray:
    """The anchor shingles of a set: its first n - ceil(t n) + 1 in the order of classes, then hashes."""
    n = len(s)
    p = n - -((-num * n) // den) + 1 if n else 0
    low = int(np.searchsorted(s, COUNTED))
    c = cls[(s[:low] % np.uint64(CELLS)).astype(np.int64)]
    if c.any():
        order = np.concatenate([np.flatnonzero(c == 0), np.arange(low, n)])
        if len(order) < p:
            hot = np.flatnonzero(c)
            order = np.concatenate([order, hot[np.argsort(c[hot], kind="stable")]])
        s = s[order[:p]]
    return s[:p]


def _anchors(k: int, num: int, den: int, region: int, classes, reps):
    """(id, n, parity, keys, late): the anchor shingles of the regions into which a document is replicated.

    Documents that cannot be the first of equal sets are left out by bits; one that slips through adds rows whose links are
    true ones. ``late`` are keys of which this run of rows has more than ``region`` + 1 others already.
    """
    def made(ids, sizes, marks, keys):
        counts = np.array([len(x) for x in keys], np.int64)
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        late = np.zeros(len(flat), bool)
        order = np.argsort(flat, kind="stable")
        inside = flat[order]
        if len(flat) > region + 1 and (inside[region + 1 :] == inside[: -region - 1]).any():
            first = np.concatenate([[True], inside[1:] != inside[:-1]])
            place = np.arange(len(inside)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            late[order] = place > region
        ends = np.concatenate([[0], np.cumsum(counts)])
        lists = []
        for mask in (~late, late):
            at = np.concatenate([[0], np.cumsum(mask)])[ends]
            lists.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(_signed(flat[mask]))))
        marked = pa.ListArray.from_arrays(pa.array(np.arange(len(marks) + 1, dtype=np.int32) * (PARITY // 64)), pa.array(np.concatenate(marks) if marks else np.zeros(0, np.int64)))
        return pa.record_batch([pa.array(np.array(ids, np.int64)), pa.array(np.array(sizes, np.int64)), marked, *lists], names=["id", "n", "parity", "keys", "late"])

    def run(batches):
        cls = classes.value
        ids, sizes, marks, keys, held = [], [], [], [], 0
        for batch in batches:
            batch = batch.take(pa.array(np.flatnonzero(marked(reps, batch.column(0).to_numpy(zero_copy_only=False)))))
            own = batch.column(1).to_numpy(zero_copy_only=False)
            for i, _, data, offsets in kernels.slices(batch.column(2)):
                for d, s in enumerate(kernels.shingle_sets(data, offsets, k)):
                    if not len(s):
                        continue
                    ids.append(own[i + d])
                    sizes.append(len(s))
                    marks.append(_parity(s))
                    keys.append(_window(s, num, den, cls))
                    held += len(keys[-1])
                if held >= CHUNK:
                    yield made(ids, sizes, marks, keys)
                    ids, sizes, marks, keys, held = [], [], [], [], 0
        yield made(ids, sizes, marks, keys)

    return run


_ANCHORS = "id long, n long, parity array<long>, keys array<long>, late array<long>"
_REGION_SCHEMA = "x long, nx long, y long, ny long, key long"


def _regions(num: int, den: int, region: int):
    """Rows sorted by key: pairs of regions of 2 to ``region`` members (key null), member and pivot of larger ones.

    Holds at most ``region`` rows of an unfinished region, however large that is.
    """
    def emitted(x, nx, y, ny, key=None):
        key = pa.array(key, pa.int64()) if key is not None else pa.nulls(len(x)).cast(pa.int64())
        return pa.record_batch([pa.array(c, pa.int64()) for c in (x, nx, y, ny)] + [key], names=["x", "nx", "y", "ny", "key"])

    def pairs(ids, ns, starts, lengths):
        for m in np.unique(lengths):
            if 2 <= m <= region:
                at = starts[lengths == m]
                a, b = np.triu_indices(m, 1)
                step = max(1, (1 << 18) // len(a))
                for i in range(0, len(at), step):
                    p, q = (at[i : i + step, None] + a).ravel(), (at[i : i + step, None] + b).ravel()
                    ok = (ids[p] != ids[q]) & (den * np.minimum(ns[p], ns[q]) >= num * np.maximum(ns[p], ns[q]))
                    p, q = p[ok], q[ok]
                    p, q = np.where(ids[p] < ids[q], p, q), np.where(ids[p] < ids[q], q, p)
                    if len(p):
                        yield emitted(ids[p], ns[p], ids[q], ns[q])

    def members(key, ids, ns, pivot):
        yield emitted(ids, ns, np.full(len(ids), pivot[0]), np.full(len(ids), pivot[1]), np.full(len(ids), key))

    def run(batches):
        held = [np.zeros(0, np.int64) for _ in range(3)]
        open_key = pivot = None  # of a large region that has begun
        for batch in batches:
            key, ids, ns = (np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held))
            if not len(key):
                continue
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            lengths = np.diff(np.concatenate([starts, [len(key)]]))
            if open_key is not None and key[0] == open_key:
                yield from members(open_key, ids[: lengths[0]], ns[: lengths[0]], pivot)
                if len(starts) == 1:
                    held = [np.zeros(0, np.int64) for _ in range(3)]
                    continue
                starts, lengths = starts[1:], lengths[1:]
            open_key = None
            for s, m in zip(starts[lengths > region].tolist(), lengths[lengths > region].tolist()):
                pivot = (ids[s], ns[s])
                yield from members(key[s], ids[s : s + m], ns[s : s + m], pivot)
                if s + m == len(key):
                    open_key = key[s]
            if open_key is None:  # the last region may go on in the next batch
                s = starts[-1]
                yield from pairs(ids, ns, starts[:-1], lengths[:-1])
                held = [a[s:].copy() for a in (key, ids, ns)]
            else:
                yield from pairs(ids, ns, starts[:-1], lengths[:-1])
                held = [np.zeros(0, np.int64) for _ in range(3)]
        if len(held[0]):
            yield from pairs(held[1], held[2], np.array([0]), np.array([len(held[0])]))

    return run


def _sets(k: int, wanted):
    """(id, set) of the documents whose place is marked."""
    def run(batches):
        for batch in batches:
            places = batch.column(0).to_numpy(zero_copy_only=False)
            part = batch.take(pa.array(np.flatnonzero(marked(wanted, places))))
            got = [s.tobytes() for _, _, data, offsets in kernels.slices(part.column(2)) for s in kernels.shingle_sets(data, offsets, k)]
            yield pa.record_batch([part.column(1), pa.array(got, pa.binary())], names=["id", "hashes"])

    return run


def _verified(num: int, den: int):
    def run(batches):
        for batch in batches:
            shared = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                shared.append((inter, len(a) + len(b) - inter))
            inter, union = np.array(shared, np.int64).reshape(-1, 2).T
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(den * inter >= num * union), pa.array(1 - inter / np.maximum(union, 1))], names=["x", "y", "linked", "d"])

    return run


def _block_links(num: int, den: int):
    """Links between the members of two blocks (or in one), as a forest: exact intersections by matrix products."""
    def run(table: pa.Table) -> pa.Table:
        rows = {}
        for side, i, component, hashes in zip(*(table.column(c).to_pylist() for c in ("side", "id", "component", "hashes"))):
            rows[side, i] = (component, np.frombuffer(hashes, np.uint64))
        sides = [[(i, *rows[s, i]) for s, i in sorted(rows) if s == side] for side in (0, 1)]
        a, b = sides[0], sides[1] or sides[0]
        everyone = a + (b if b is not a else [])
        flat = np.concatenate([x[2] for x in everyone])
        owner = np.repeat(np.arange(len(everyone)), [len(x[2]) for x in everyone])
        _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
        column, owner = column[count[column] > 1], owner[count[column] > 1]
        _, column = np.unique(column, return_inverse=True)
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        common = np.zeros((len(a), len(b)), np.float32)
        for begin in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            p, q = np.searchsorted(column, [begin, begin + COLUMNS])
            m = np.zeros((len(everyone), COLUMNS), np.float32)
            m[owner[p:q], column[p:q] - begin] = 1
            common += m[: len(a)] @ m[len(everyone) - len(b) :].T
        common = np.rint(common).astype(np.int64)
        na, nb = (np.array([len(x[2]) for x in side], np.int64) for side in (a, b))
        linked = den * common >= num * (na[:, None] + nb[None, :] - common)
        root = {x[1]: x[1] for x in everyone}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        for i, j in zip(*(w.tolist() for w in np.nonzero(linked))):
            x, y = find(a[i][1]), find(b[j][1])
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((a[i][0], b[j][0]))
        kernels.trim()
        return pa.table({"x": pa.array([x for x, _ in out], pa.int64()), "y": pa.array([y for _, y in out], pa.int64())})

    return run


def jaccard_nodes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, threshold: tuple[int, int] = (85, 100), region: int = REGION) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, classes, links): (id, n, d1, d2) of all rows; (d1, d2, n, rep, copies) of equal sets; links (x, y) between reps.

    ``links`` connects exactly what all links of the join connect: inside a large region, members
    that are already connected are not compared with each other again.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "jaccard")
    stage, drop = scratch.stage, scratch.drop
    num, den = threshold
    docs = located(df, F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null").select("place", "id", "text")

    run, schema = _profile(k)
    profile = stage(docs.mapInArrow(kernels.tidy(run), schema), "profile")
    rows_of = profile.where("block is null").select("id", "n", "d1", "d2")
    # Ids choose the places of their rows, which are marked for the scans: no text moves to be chosen.
    only = lambda ids: mark(scratch, profile.where("block is null").select("id", "place").join(ids.distinct(), "id", "left_semi").select("place"))
    classes = stage(rows_of.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    table = spark.sparkContext.broadcast(_classes(profile))

    reps = only(classes.select(F.col("rep").alias("id")))
    anchors = stage(docs.mapInArrow(kernels.tidy(_anchors(k, num, den, region, table, reps)), _ANCHORS), "anchors")
    rows = anchors.select(F.explode("keys").alias("key"), "id", "n").repartition("key")
    rows = rows.sortWithinPartitions("key", F.xxhash64("id")).select("key", "id", "n")
    found = stage(rows.mapInArrow(kernels.tidy(_regions(num, den, region)), _REGION_SCHEMA), "regions")

    window = lambda n: n - F.ceil(n * num / den) + 1
    needed = F.ceil((F.col("nx") + F.col("ny")) * F.lit(num) / F.lit(num + den) - 1e-9)
    fits = F.least("nx", "ny") * den >= F.greatest("nx", "ny") * num
    rest = F.greatest(F.col("nx") - window(F.col("nx")), F.col("ny") - window(F.col("ny")))

    # Members of large regions, with their pivots: those that waited, too. Regions of one pivot join: keys of one group
    # of near copies mostly have the same.
    members = found.where("key is not null").select("key", F.col("x").alias("id"), F.col("nx").alias("n"), F.col("y").alias("pivot"), F.col("ny").alias("np"))
    late = anchors.select(F.explode("late").alias("key"), "id", "n")
    members = members.unionByName(salted(late, "key", members.where("id = pivot").select("key", "pivot", "np")))
    members = stage(members.groupBy("id", "n", "pivot", "np").agg(F.count("*").alias("regions")), "members")
    large = members.groupBy("id").agg(F.sum("regions").alias("large"))

    # Small regions pair directly.
    pairs = found.where("key is null").groupBy("x", "nx", "y", "ny").agg(F.count("*").alias("shared"))
    for side in "xy":
        pairs = pairs.join(large.select(F.col("id").alias(side), F.col("large").alias(f"large_{side}")), side, "left")
    unseen = F.least(F.coalesce("large_x", F.lit(0)), F.coalesce("large_y", F.lit(0)))
    pairs = counted = stage(pairs.where(F.col("shared") + unseen + rest >= needed).select("x", "nx", "y", "ny"), "pairs")
    for side in "xy":
        pairs = pairs.join(anchors.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("parity").alias(f"parity_{side}")), [side, f"n{side}"])
    differ = sum((F.bit_count(F.col("parity_x")[i].bitwiseXOR(F.col("parity_y")[i])) for i in range(PARITY // 64)), F.lit(0))
    close = stage(pairs.where(differ <= F.col("nx") + F.col("ny") - 2 * needed).select("x", "y").distinct(), "close")

    # All members of a large region are compared with its pivot, exactly.
    star = members.where((F.col("id") != F.col("pivot")) & (F.least("n", "np") * den >= F.greatest("n", "np") * num))
    star = star.select(F.least("id", "pivot").alias("x"), F.greatest("id", "pivot").alias("y"))
    asked = stage(close.unionByName(star).distinct(), "asked")
    drop(found, anchors, counted)

    wanted = only(asked.select(F.explode(F.array("x", "y")).alias("id")).unionByName(members.select("id")).distinct())
    sets = stage(docs.mapInArrow(kernels.tidy(_sets(k, wanted)), "id long, hashes binary"), "sets")
    both = salted(salted(asked, "x", sets.toDF("x", "a")), "y", sets.toDF("y", "b")).select("x", "y", "a", "b")
    compared = stage(both.mapInArrow(kernels.tidy(_verified(num, den)), "x long, y long, linked boolean, d double"), "compared")
    links = stage(compared.where("linked").select("x", "y"), "links")
    if members.isEmpty():
        drop(sets, compared, members, asked, close)
        return rows_of, classes, links

    # Shells of distance around the pivot, cut into blocks of bounded size; of these, those recurse whose
    # shells are inside the triangle-inequality window and that hold more than one component.
    known = compared.select(F.col("x").alias("id"), F.col("y").alias("pivot"), "d").unionByName(compared.select(F.col("y").alias("id"), F.col("x").alias("pivot"), "d"))
    gap = 1 - num / den
    parts = connected_components(links)
    placed = members.join(known, ["id", "pivot"], "left").join(parts, "id", "left")
    # Sizes that differ too much bound the distance to the pivot from below, and the shell is that of the bound.
    d = F.when(F.col("id") == F.col("pivot"), 0.0).otherwise(F.coalesce("d", 1 - F.least("n", "np") / F.greatest("n", "np")))
    exact = (F.col("id") == F.col("pivot")) | F.col("d").isNotNull()
    placed = placed.select("pivot", "id", F.coalesce("component", "id").alias("component"), F.floor(F.when(exact, d).otherwise(2.0) * SHELLS / gap).cast("int").alias("shell"))
    placed = stage(placed, "placed")
    drop(members, asked, close)
    mixed = placed.groupBy("pivot").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n")).where("a <> b").select("pivot", "n")
    cuts = placed.groupBy("pivot", "shell").agg(F.count("*").alias("n")).withColumn("cuts", F.ceil(F.col("n") / BLOCK_ROWS).cast("int"))
    total = placed.count()
    placed = join_long_counts(join_long_counts(placed, ["pivot"], mixed, "n", total), ["pivot", "shell"], cuts, "n", total).withColumn("cut", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
    placed = stage(placed.select("pivot", "shell", "cut", "id", "component"), "blocks")
    blocks = placed.groupBy("pivot", "shell", "cut").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    # The blocks of one pivot meet in several tasks, of 64 blocks on one side each.
    sizes = stage(blocks, "sizes")
    blocks = stage(sizes.join(sizes.groupBy("pivot").agg(F.ceil(F.count("*") / 64).cast("int").alias("parts")), "pivot"), "shells")
    one = blocks.select("pivot", "shell", "cut", "least", "most", F.pmod(F.xxhash64("shell", "cut"), F.col("parts")).cast("int").alias("part"))
    two = blocks.select("pivot", "shell", "cut", "least", "most", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).toDF("pivot", "shell_2", "cut_2", "least_2", "most_2", "part")
    far = F.lit(int(2 * SHELLS / gap))
    inside = (F.col("shell_2") - F.col("shell") <= SHELLS) | (F.col("shell_2") == far)
    later = (F.col("shell") < F.col("shell_2")) | ((F.col("shell") == F.col("shell_2")) & (F.col("cut") <= F.col("cut_2")))
    meets = one.join(two, ["pivot", "part"]).where(later & inside & (F.least("least", "least_2") != F.greatest("most", "most_2")))
    meets = meets.select("pivot", "shell", "cut", "shell_2", "cut_2", F.xxhash64("pivot", "shell", "cut", "shell_2", "cut_2").alias("task"))
    ends = F.array(F.struct(F.lit(0).alias("side"), "shell", "cut"), F.struct(F.lit(1).alias("side"), F.col("shell_2").alias("shell"), F.col("cut_2").alias("cut")))
    same = (F.col("shell") == F.col("shell_2")) & (F.col("cut") == F.col("cut_2"))
    sides = stage(meets.select("pivot", "task", F.explode(F.when(same, F.slice(ends, 1, 1)).otherwise(ends)).alias("s")).select("pivot", "task", "s.*"), "sides")
    work = placed.join(sides, ["pivot", "shell", "cut"]).select("task", "side", "id", "component").distinct()
    work = work.join(sets, "id").select("task", "side", "id", "component", "hashes")
    more = stage(work.groupBy("task").applyInArrow(_block_links(num, den), "x long, y long"), "more")
    drop(sets, placed, compared, sizes, blocks, sides)
    # The components of the first links stand for these, so the next search for components begins with stars.
    return rows_of, classes, parts.where("id <> component").toDF("x", "y").unionByName(more)


def _one_id(docs: DataFrame, classes: DataFrame, repeated: DataFrame) -> DataFrame:
    """(x, y): links between the classes of the texts of one id, as a star, of the ids with several rows."""
    rows = docs.where("n > 0").join(repeated.select("id"), "id", "left_semi")
    pairs = join_counts(rows, ["d1", "d2", "n"], classes.select("d1", "d2", "n", "rep", "copies"), "copies").select("id", "rep").distinct()
    least = pairs.groupBy("id").agg(F.min("rep").alias("least"), F.count("*").alias("classes")).where("classes > 1")
    return join_counts(pairs, ["id"], least, "classes").where("rep <> least").select(F.col("least").alias("x"), F.col("rep").alias("y"))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, threshold: tuple[int, int] = (85, 100), region: int = REGION) -> DataFrame:
    """(id_col, n_shingles, component_id) of every row of ``df``.

    ``threshold`` is a fraction: sets link when den * intersection >= num * union. A null or empty
    text, or one without words, has the empty set and links with nothing; equal texts have one
    component; rows with a null id are returned with a null component. Rows that share an id are
    one node that has the links of all its texts. Ids are cast to long; one that is no number raises an error. Repeated
    rows come back as often as they are there; an empty table gives an empty result. Other columns are ignored.
    """
    docs, classes, links = jaccard_nodes(df, id_col, text_col, k, threshold, region)
    repeated = docs.where("n > 0").groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1")
    if not repeated.isEmpty():
        links = links.unionByName(_one_id(docs, classes, repeated))
    parts = connected_components(links)
    classes = classes.join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("d1", "d2", "n", "copies", F.coalesce("component", "rep").alias("component_id"))
    reps = join_long_counts(docs.where("n > 0"), ["d1", "d2", "n"], classes, "copies").select("id", "n", "component_id")
    out = reps.unionByName(docs.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    lost = df.where(F.col(id_col).isNull()).select(F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("long"))
    return out.unionByName(lost.toDF("id", "n", "component_id")).toDF(id_col, "n_shingles", "component_id")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, threshold: tuple[int, int] = (85, 100)) -> DataFrame:
    """The rows of ``df`` whose id is the least of its component: one document of each group stays. Rows with a null id stay.

    Repeated rows of an id that stays are kept once. An id that has several texts joins the groups of all of them.
    """
    parts = jaccard_components(df, id_col, text_col, k, threshold).groupBy(id_col).agg(F.min("component_id").alias("component_id"))
    keep = parts.where(F.col(id_col) == F.col("component_id")).select(id_col)
    known = df.where(F.col(id_col).isNotNull()).join(keep, id_col, "left_semi").dropDuplicates([id_col])
    return known.unionByName(df.where(F.col(id_col).isNull())).select(df.columns)
