"""Near-duplicate classes by order MinHash over five-word shingles.

A text's shingles are labelled with their occurrence number, so that repeats count. Each of several hash functions picks
the two labelled shingles with the least hashes; together in text order they make one sketch, so texts agree on it only
if they share those shingles in that order. Texts that agree on any sketch are candidates; they are linked if banded
alignment of their shingle sequences matches enough of them: matched / (all - matched) >= similarity. Classes are the
connected components of links and exact copies.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdikt.llm.common import bounded_batches, chunks, mixed, row_key, spread_join, utf8, word_hashes, written

#: So many orders in which a bucket's leader is its first text: a text missed by one leader meets another.
ORDERS = 3
#: Texts, about, that are compared with one copy of a leader's text.
LED = 500
#: Bytes of signatures, about, in one block of a bucket's members.
BLOCK_BYTES = 1 << 20
#: Of a class's pairs with a text, so many are given by a meeting, the likeliest first, and so many are
#: aligned at first, then eight times as many of those that are still apart, and so on.
MET, ALIGNED = 256, 4
#: A text has fewer shingles than bytes, and a string fewer bytes than 2**31.
_POSITION = np.uint64((1 << 32) - 1)


def shingles(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of size words of each text, and the texts' offsets in them; a shorter text is one shingle."""
    counts = np.diff(at)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    out_at = np.r_[0, np.cumsum(n)]
    total = np.zeros(len(words), np.uint64)
    for k in range(size):
        ahead = words[k:]
        total[: len(ahead)] = total[: len(ahead)] * np.uint64(0x9E3779B97F4A7C15) + ahead
    start = np.repeat(at[:-1] - out_at[:-1], n) + np.arange(out_at[-1])
    found = total[start]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        value = np.uint64(counts[i])
        for w in words[at[i] : at[i + 1]]:
            value = mixed(np.array([value ^ w]), 5)[0]
        found[out_at[i]] = value
    return mixed(found, 11), out_at


def labelled(found: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Shingles with their occurrence number in their text hashed in."""
    text = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
    own = mixed(found ^ mixed(text, 3), 4)
    order = np.argsort(own, kind="stable")
    run = own[order]
    first = np.r_[True, run[1:] != run[:-1]] if len(run) else np.zeros(0, bool)
    place = np.arange(len(run))
    nth = np.empty(len(run), np.uint64)
    nth[order] = place - np.maximum.accumulate(np.where(first, place, 0))
    return found + nth * np.uint64(0xA24BAED4963EE407)


def sketches(labels: np.ndarray, at: np.ndarray, hashes: int, least: int = 2) -> np.ndarray:
    """A row for each text, a column for each hash function (texts without shingles have zeros)."""
    n = len(at) - 1
    out = np.zeros((n, hashes), np.uint64)
    full = np.flatnonzero(np.diff(at) > 0)
    if not len(full):
        return out
    starts, sizes = at[full], np.diff(at)[full]
    place = (np.arange(at[-1]) - np.repeat(at[:-1], np.diff(at))).astype(np.uint64) & _POSITION
    highest = np.uint64(2**64 - 1)
    for j in range(hashes):
        value = mixed(labels, 100 + j) & ~_POSITION | place
        chosen = []
        for k in range(least):
            low = np.minimum.reduceat(value, starts)
            chosen.append(np.where(sizes > k, low & _POSITION, _POSITION))
            value[(starts + (low & _POSITION).astype(np.int64))[sizes > k]] = highest
        total = np.full(len(full), j, np.uint64)
        for position in np.sort(np.stack(chosen), 0):  # in text order
            held = position < _POSITION
            label = labels[np.where(held, starts + position.astype(np.int64), 0)]
            total = np.where(held, mixed(total * np.uint64(0x9E3779B97F4A7C15) + label, 9), total)
        out[full, j] = total
    return out


def signature(labels: np.ndarray) -> bytes:
    """A bit for each place: whether an odd number of labels falls there. The differing bits of two signatures are no
    more than the labels that only one of the texts has. Four places or more for each label, so that most differences
    show at any length."""
    places = 1 << max(9, int(4 * len(labels) - 1).bit_length())
    at = (mixed(labels, 55) & np.uint64(places - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=places) & 1).astype(bool), bitorder="little").tobytes()


def _sketched(documents: DataFrame, id_column: str, text_column: str, size: int, hashes: int) -> DataFrame:
    """id, k1, k2, t (128 bits of the text; of the whole row if the text has no words), n and sketches of all rows."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    rows = documents.select(F.col(f"`{id_column}`").alias("id"), *row_key(f"`{id_column}`", f"`{text_column}`"), F.unhex(F.md5(text.cast("binary"))).alias("t"), text.alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(4))
            for a, b in chunks(at):
                found, bounds = shingles(*word_hashes(data, at[a : b + 1]), size)
                labels = labelled(found, bounds)
                made = sketches(labels, bounds, hashes).view(np.int64)
                column = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * hashes, pa.int32()), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(4)), pa.array(np.diff(bounds).astype(np.int64)), column], names=["id", "k1", "k2", "t", "n", "sketches"])

    kind = documents.schema[id_column].dataType.simpleString()
    made = rows.mapInArrow(sketch, f"id {kind}, k1 long, k2 long, t binary, n long, sketches array<long>")
    alone = F.unhex(F.concat(F.lpad(F.hex("k1"), 16, "0"), F.lpad(F.hex("k2"), 16, "0")))
    return made.withColumn("t", F.when(F.col("n") > 0, F.col("t")).otherwise(alone))


def _signed(texts: DataFrame, size: int) -> DataFrame:
    """t, text and signature of texts (t, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            for a, b in chunks(at):
                found, bounds = shingles(*word_hashes(data, at[a : b + 1]), size)
                labels = labelled(found, bounds)
                marks = [signature(labels[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(2)), pa.array(marks, pa.binary())], names=["t", "text", "signature"])

    return texts.mapInArrow(sign, "t binary, text string, signature binary")


#: Shingles that occur more often in a text keep their places as one number, others as a list.
_OFTEN = 2048


def banded_matches(a: list[int], b: list[int], band: int) -> int:
    """The most elements that an alignment matches, positions at most band apart: bit-parallel, on a window of bits that
    moves along a, so that a step costs the band's width and not the text's. Equal ends are matched first."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return head + tail
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    often = {x: sum(1 << i for i in at) for x, at in places.items() if len(at) > _OFTEN}
    width, matched = 2 * band + 1, 0
    full = state = (1 << width) - 1
    for j, x in enumerate(b):
        low = j - band  # the place in a of the window's first bit
        if x in often:
            hit = (often[x] >> low if low > 0 else often[x] << -low) & state
        else:
            at, hit = places.get(x, ()), 0
            for i in at[bisect_left(at, low) : bisect_left(at, low + width)] if at else ():
                hit |= 1 << (i - low)
            hit &= state
        if hit:
            state = ((state + hit) | (state - hit)) & full
        matched += not state & 1
        state = state >> 1 | 1 << (width - 1)
    return head + tail + matched + width - state.bit_count()


def rising(order: np.ndarray) -> int:
    """The length of the longest rising part of a sequence."""
    ends: list[int] = []
    for x in order.tolist():
        at = bisect_left(ends, x)
        ends[at : at + 1] = [x]
    return len(ends)


def needed_of(both: np.ndarray | int, least: float) -> np.ndarray:
    """How many of both texts' shingles together have to match."""
    return np.ceil(least / (1 + least) * both - 1e-9).astype(np.int64)


def similar(a: np.ndarray, a_labels: np.ndarray, b: np.ndarray, b_labels: np.ndarray, least: float) -> bool:
    """Whether matched / (all - matched) >= least for the best banded alignment of two texts' shingles. Bounds come
    first: shared labels from above, and those of them in the same order from below."""
    both = len(a) + len(b)
    needed = int(needed_of(np.int64(both), least))
    common, at, to = np.intersect1d(a_labels, b_labels, assume_unique=True, return_indices=True)
    if len(common) < needed or needed == 0:
        return False
    order = to[np.argsort(at)]
    return bool(np.all(order[1:] > order[:-1])) or rising(order) >= needed or banded_matches(a.tolist(), b.tolist(), both - 2 * needed) >= needed


def _verified(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """t, leader and whether they are similar. texts: one row for each t that occurs.

    A leader's text goes once to each of its parts, of LED texts or so, and is met there by the texts themselves: sorted
    behind it, one at a time.
    """
    parts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / F.lit(LED)).alias("parts"))
    led = spread_join(pairs.select("t", "leader"), parts, ["leader"], "t").select("t", "leader", F.pmod(F.xxhash64("t"), "parts").alias("part"), F.lit(1).alias("place"))
    own = parts.select(F.col("leader").alias("t"), "leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("place"))
    rows = led.unionByName(own).join(texts, "t").select("t", "leader", "part", "place", "text").repartition("leader", "part").sortWithinPartitions("leader", "part", "place")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leading = None
        for batch in batches:
            data, at = utf8(batch.column(4))
            leader, place, result = batch.column(1).to_pylist(), batch.column(3).to_pylist(), []
            for i in range(len(batch)):
                found, bounds = shingles(*word_hashes(data, at[i : i + 2]), size)
                this = found, labelled(found, bounds)
                if place[i] == 0:
                    leading = leader[i], this
                    result.append(None)
                else:
                    assert leading is not None and leading[0] == leader[i]
                    result.append(similar(*this, *leading[1], least))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(result, pa.bool_())], names=["t", "leader", "linked"])

    return rows.mapInArrow(compare, "t binary, leader binary, linked boolean").filter("linked IS NOT NULL")


def folded(signature: np.ndarray) -> np.ndarray:
    """Signatures, a row each, of half as many bits: a shingle's place there is its place modulo their number."""
    half = signature.shape[1] // 2
    return signature[:, :half] ^ signature[:, half:]


def close_members(n: np.ndarray, root: np.ndarray, minor: np.ndarray, signatures: list[bytes], a: np.ndarray, b: np.ndarray, least: float, most: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """For each of b, of other classes than its own those of a whose signatures allow a link: their places, its place,
    how many of that class are likelier, and whether more of it were left out. Of each class the most likeliest are given. Members stand in order of
    their ids, and two that are both minor meet once."""
    a = a[np.argsort(n[a], kind="stable")]
    sizes = np.array([len(signatures[i]) for i in a])
    held = {}
    for size in np.unique(sizes).tolist():
        first, last = np.searchsorted(sizes, [size, size + 1])  # longer texts have no shorter signatures
        whole = np.frombuffer(b"".join(signatures[i] for i in a[first:last]), np.uint64).reshape(last - first, -1)
        held[size] = first, last, whole, folded(whole) if whole.shape[1] > 1 else whole
    for i in b.tolist():
        own = np.frombuffer(signatures[i], np.uint64)[None]
        low, high = np.searchsorted(n[a], [int(np.ceil(least * n[i] - 1e-9)), int(n[i] / least + 1e-9) + 1])
        near = []
        for size, (first, last, whole, half) in held.items():
            first, last, start = max(first, low), min(last, high), first
            if first >= last:
                continue
            mine = own if size >= len(signatures[i]) else folded(own)
            table = whole if size <= len(signatures[i]) else half
            apart = np.bitwise_count(table[first - start : last - start] ^ mine).sum(1, dtype=np.int64)
            other = a[first:last]
            both = n[other] + n[i]
            good = (apart <= both - 2 * needed_of(both, least)) & (root[other] != root[i]) & (~minor[other] | (other < i))
            near.append(np.stack([root[other[good]], apart[good], other[good]]))
        if near and (found := np.concatenate(near, 1)).shape[1]:
            found = found[:, np.lexsort(found[::-1])]
            first = np.flatnonzero(np.r_[True, found[0, 1:] != found[0, :-1]])
            count = np.diff(np.r_[first, found.shape[1]])
            nth = np.arange(found.shape[1]) - np.repeat(first, count)
            keep = nth < most
            yield found[2, keep], i, nth[keep], np.repeat(count > most, count)[keep]


#: Who is there to be met, who meets them, and who does both.
THERE, ASKING, BOTH = 0, 1, 2


def _arenas(members: DataFrame) -> DataFrame:
    """Who meets whom: arena, t, n, root, side, and in how many rows and columns of blocks the arena's sides stand.

    In every bucket, who isn't in its largest class meets everyone outside its own class. Buckets of the same largest
    class hold much the same texts if that class is hot; then, where this means fewer meetings, its minor ones meet the
    class itself, once, and in their buckets only each other.
    """
    width = F.greatest(F.col("n"), F.lit(64))  # a signature's bytes at most
    blocks = lambda w: F.greatest(F.lit(1), F.ceil(F.col(w) / F.lit(BLOCK_BYTES)))
    here = members.select("t", "n", "root", F.explode("buckets").alias("value"))
    sizes = here.groupBy("value", "root").agg(F.count("*").alias("size"), F.sum(width).alias("w"))
    whole = sizes.groupBy("value").agg(F.max(F.struct("size", "root", "w")).alias("main"), F.sum("size").alias("members"), F.sum("w").alias("w")).filter("members > 2 AND members > main.size")
    largest = written(whole.select("value", F.col("main.root").alias("main"), F.col("main.size").alias("size"), (F.col("members") - F.col("main.size")).alias("others"), "w", (F.col("w") - F.col("main.w")).alias("other_w")), "largest")
    other = sizes.select("value", "root").join(largest.select("value", "main", "w", "other_w"), "value").filter("root <> main")
    minor = written(spread_join(here, other, ["value", "root"], "t").select("value", "main", "t", "n", "root", "w", "other_w"), "minor")
    by_bucket = largest.groupBy("main").agg(F.sum(F.col("size") * F.col("others")).alias("by_bucket"))
    minors = minor.select("main", "t", "n").distinct().groupBy("main").agg(F.count("*").alias("minors"), F.sum(width).alias("minor_w"))
    by_class = minors.join(members.groupBy(F.col("root").alias("main")).agg(F.count("*").alias("size"), F.sum(width).alias("class_w")), "main")
    hot = written(by_bucket.join(by_class, "main").filter("by_bucket > minors * size").select("main", blocks("class_w").alias("hot_rows"), blocks("minor_w").alias("hot_columns")), "hot")

    place = lambda arena, side, rows, columns: [arena.alias("arena"), "t", "n", "root", F.lit(side).alias("side"), rows.alias("rows"), columns.alias("columns")]
    in_class, hot_places = F.xxhash64(F.lit("class"), "main"), (F.col("hot_rows"), F.col("hot_columns"))
    of_class = members.withColumn("main", F.col("root")).join(hot, "main").select(*place(in_class, THERE, *hot_places))
    cool = largest.join(hot, "main", "left_anti").select("value", F.col("main").alias("root"), "w", "other_w")
    of_bucket = spread_join(here, cool, ["value", "root"], "t").select(*place(F.col("value"), THERE, blocks("w"), blocks("other_w")))
    marked = minor.join(hot, "main", "left")
    in_bucket = marked.select(*place(F.col("value"), BOTH, F.when(F.col("hot_rows").isNull(), blocks("w")).otherwise(blocks("other_w")), blocks("other_w")))
    against_class = marked.filter("hot_rows IS NOT NULL").select(*place(in_class, ASKING, *hot_places)).distinct()
    return of_class.unionByName(of_bucket).unionByName(in_bucket).unionByName(against_class)


def _apart(members: DataFrame, signatures: DataFrame, least: float, most: int) -> DataFrame:
    """t, leader, nth and more: pairs of a bucket's members of different classes that their signatures allow to be linked,
    of each class the most likeliest for a member, counted by nth from 0; more tells whether that left out any.

    members: t, n, root and buckets (an array). Members of an arena meet in blocks of signatures of about BLOCK_BYTES: a
    block pair is a row, pairs of members aren't.
    """
    each = _arenas(members).groupBy("t").agg(F.collect_list(F.struct("arena", "n", "root", "side", "rows", "columns")).alias("arenas"))
    placed = each.join(signatures, "t").select("t", "signature", F.inline("arenas"))
    own = lambda n: F.pmod(F.xxhash64(F.lit(5), "t"), n)
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    spot = lambda at, row, column: F.struct(F.lit(at).alias("at"), row.alias("row"), column.alias("column"))
    as_row = F.transform(every("columns"), lambda c: spot(THERE, own("rows"), c))
    as_column = F.transform(every("rows"), lambda r: spot(ASKING, r, own("columns")))
    spots = F.when(F.col("side") == THERE, as_row).when(F.col("side") == ASKING, as_column).otherwise(F.concat(as_row, as_column))
    dealt = placed.select("arena", "t", "n", "root", (F.col("side") != THERE).alias("minor"), "signature", F.inline(spots))
    met = dealt.groupBy("arena", "row", "column").agg(F.collect_list(F.struct("at", "t", "n", "root", "minor", "signature")).alias("m"), F.min("at").alias("first"), F.max("at").alias("last")).filter("first < last").select("m")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column(0):
                flat = row.values
                t, root, signature = (flat.field(name).to_pylist() for name in ("t", "root", "signature"))
                by = sorted(range(len(t)), key=t.__getitem__)
                t, root, signature = ([x[i] for i in by] for x in (t, root, signature))
                side, n, minor = (flat.field(name).to_numpy(zero_copy_only=False)[by] for name in ("at", "n", "minor"))
                names = {r: i for i, r in enumerate(set(root))}
                found = list(close_members(n, np.array([names[r] for r in root]), minor, signature, np.flatnonzero(side == THERE), np.flatnonzero(side == ASKING), least, most))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([t[i] for near, _, _, _ in found for i in near], pa.binary()), pa.array([t[i] for near, i, _, _ in found for _ in near], pa.binary()), *(pa.array(np.concatenate([row[k] for row in found])) for k in (2, 3))], names=["t", "leader", "nth", "more"])

    return met.mapInArrow(meet, "t binary, leader binary, nth long, more boolean").groupBy("t", "leader").agg(F.min("nth").alias("nth"), F.bool_or("more").alias("more"))


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for the nodes of links (a, b), by rounds of taking the least
    label around and of jumping to the label's own label, until nothing changes. Labels are kept as tables."""
    links = written(links.select("a", "b"), "links")
    edges = links.union(links.select("b", "a"))
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "labels")
    while True:
        around = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        nearer = labels.join(around, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        further = labels.select(F.col("node").alias("via"), F.col("root").alias("its"))
        step = written(nearer.join(further, F.col("root") == F.col("via")).select("node", F.least("root", "its").alias("root"), "old"), "labels")
        labels = step.select("node", "root")
        if step.filter("root <> old").isEmpty():
            return labels


def classes(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = 5, similarity: float = 0.8, hashes: int = 12) -> DataFrame:
    """id, k1, k2 (the row's key) and class (a key of its class) for every row: the connected components of all similar
    candidates and exact copies. For the rest see near_duplicates."""
    bounded_batches(documents.sparkSession)
    rows = written(_sketched(documents, id_column, text_column, shingle_words, hashes), "sketches")
    # of each distinct text its first row is the one whose text is fetched
    texts = written(rows.filter("n > 0").groupBy("t").agg(F.first("n").alias("n"), F.first("sketches").alias("sketches"), F.min(F.struct("id", "k1", "k2")).alias("owner")), "texts")
    bands = texts.select("t", "n", F.posexplode("sketches").alias("j", "value")).select("value", "t", "n", F.xxhash64("t", F.pmod("j", F.lit(ORDERS))).alias("rank"))
    leaders = bands.groupBy("value").agg(F.min(F.struct("rank", "t", "n")).alias("lead"), F.count("*").alias("members")).filter("members > 1").select("value", "lead")
    met = written(spread_join(bands, leaders, ["value"], "t").filter(F.col("t") != F.col("lead.t")).select("value", "t", "n", F.col("lead.t").alias("leader"), F.col("lead.n").alias("leader_n")), "met")
    placed = written(met.select("value", "t", "n").union(met.select("value", "leader", "leader_n")).groupBy("t", "n").agg(F.collect_set("value").alias("buckets")), "buckets")

    # the texts of all buckets, fetched once
    owners = texts.join(placed.select("t"), "t").select("t", F.col("owner.k1").alias("k1"), F.col("owner.k2").alias("k2"))
    keyed = documents.select(*row_key(f"`{id_column}`", f"`{text_column}`"), F.col(f"`{text_column}`").alias("text"))
    held = written(_signed(keyed.join(owners, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("t", "text"), shingle_words), "candidates")

    fits = F.least("n", "leader_n") >= similarity * F.greatest("n", "leader_n")
    shown = written(_verified(met.filter(fits).select("t", "leader").distinct(), held, shingle_words, similarity), "verified")
    roots = components(shown.filter("linked").select(F.col("t").alias("a"), F.col("leader").alias("b"))).withColumnRenamed("node", "t")
    members = written(placed.join(roots, "t", "left").select("t", "n", "buckets", F.coalesce("root", "t").alias("root")), "members")

    def apart(pairs: DataFrame, members: DataFrame) -> DataFrame:
        """pairs whose texts are in different classes, a and b."""
        root = lambda t, to: members.select(F.col("t").alias(t), F.col("root").alias(to))
        return pairs.join(root("t", "a"), "t").join(root("leader", "b"), "leader").filter("a <> b")

    def joined(pairs: DataFrame, shown: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
        """shown and members after pairs are verified, those that are known left out."""
        known = shown.select("t", "leader").union(shown.select("leader", "t"))
        more = written(_verified(pairs.select("t", "leader").join(known, ["t", "leader"], "left_anti"), held, shingle_words, similarity), "verified")
        whole = components(apart(more.filter("linked"), members).select("a", "b").distinct()).select(F.col("node").alias("root"), F.col("root").alias("whole"))
        members = spread_join(members, whole, ["root"], "t", "left").select("t", "n", "buckets", F.coalesce("whole", "root").alias("root"))
        return shown.union(more), written(members, "members")

    # what leaders left in different classes of a bucket; once two classes are one, their other pairs needn't be aligned: a
    # meeting gives more pairs than are aligned at first, and few meet again
    signatures, most = held.select("t", "signature"), MET
    while True:
        rest, low, high = written(_apart(members, signatures, similarity, most), "apart"), 0, ALIGNED
        while True:
            shown, members = joined(rest.filter((F.col("nth") >= low) & (F.col("nth") < high)), shown, members)
            rest = written(apart(rest.filter((F.col("nth") >= high) | F.col("more")), members).select("t", "leader", "nth", "more"), "rest")
            low, high = high, high * 8
            if low >= most or rest.isEmpty():
                break
        if rest.filter("more").isEmpty():
            break
        most *= 8
    return spread_join(rows.select("id", "k1", "k2", "t"), members.select("t", "root"), ["t"], "k1", "left").select("id", "k1", "k2", F.coalesce("root", "t").alias("class"))


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = 5, similarity: float = 0.8, hashes: int = 12) -> DataFrame:
    """id, k1, k2 (the row's key), class_id (the least id of its class) and first (whether the row is its class's
    representative: the least by id and key, nulls first) for every row.

    Rows with equal texts share a class; equal rows also share the key and first. Texts without words (null, empty or
    white) are classes of their own. Shorter texts than a shingle are one shingle. Texts with similarity J agree on a
    sketch with about J**2, so all of 12 miss a pair at 0.8 about once in 200,000.

    Those of a class aren't all compared with each other: a bucket's members first meet its leader (in one of three
    orders, so that leaders differ between buckets), and links among copies run through leaders. What is then still in
    different classes of a bucket meets by signatures, in blocks, and what those allow is aligned, until no pair of
    different classes is left: the classes are those of all candidates, whatever the size of a bucket. Buckets are never
    gathered: leaders are minima, and rows that share a key are dealt to several places.

    Texts may be of any length up to Spark's own: signatures grow with them, and an alignment costs the text's length
    times the band's width in machine words, and only where shared shingles stand in another order.
    """
    placed = written(classes(documents, id_column, text_column, shingle_words, similarity, hashes), "placed")
    best = placed.groupBy("class").agg(F.min(F.struct("id", "k1", "k2")).alias("best"))
    return spread_join(placed, best, ["class"], "k1").select("id", "k1", "k2", F.col("best.id").alias("class_id"), ((F.col("k1") == F.col("best.k1")) & (F.col("k2") == F.col("best.k2"))).alias("first"))


def drop_near_duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options: float) -> DataFrame:
    """One row of each class: its representative's, in the columns of documents."""
    stay = near_duplicates(documents, id_column, text_column, **options).filter("first").select(F.col("k1").alias("__s1"), F.col("k2").alias("__s2")).distinct()
    keys = [k.alias(name) for k, name in zip(row_key(f"`{id_column}`", f"`{text_column}`"), ("__k1", "__k2"), strict=True)]
    kept = documents.select(*(F.col(f"`{c}`") for c in documents.columns), *keys).join(stay, (F.col("__k1") == F.col("__s1")) & (F.col("__k2") == F.col("__s2")))
    return kept.dropDuplicates(["__k1", "__k2"]).select(*(F.col(f"`{c}`") for c in documents.columns))
