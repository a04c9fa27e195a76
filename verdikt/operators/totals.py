"""How many resources a policy permits each subject, and sums over them, where the pairs are too many to be rows.

Resources that no rule tells apart are one, with their number and sums. Blocks of subjects are dealt to spots, each of which gets
all blocks of resources. A pair of blocks is judged by bits, 64 resources a word: what concerns the subject alone is a constant
for rows that are alike, what concerns the resource alone one bitmap; what links the two is a bitmap of the resource block for each
value, or for each 8 members of sets a table of the unions of their bitmaps. Where a tree is true and where it is false are
bitmaps of their own, and none is made that doesn't matter. Only totals leave.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.functions.logic import comparable
from verdikt.model import Policy, Predicate, Rule
from verdikt.operators.decide import Compiler
from verdikt.operators.permitted import permitted_pairs

#: Rows of a block of subjects and of resources, and bytes of blocks handed to Python at once.
SUBJECT_ROWS, RESOURCE_ROWS, BATCH_BYTES = 8192, 16384, 4 << 20
#: Words of bitmaps that are worked on at once, and bytes of resources' bitmaps kept in a task.
WORDS, KEPT_BYTES = 1 << 16, 64 << 20
#: Values or members of a block of resources that have bitmaps each; beyond, members are counted by so many at once.
MAPPED, MEMBERS = 512, 256
#: Resources in a row, by order, between two of which bitmaps are kept.
STEP = 8
#: Spots for each core, at most as many as a shuffle has partitions: each gets a copy of all resources.
SPOTS = 4

#: Where something holds for rows of subjects and words of 64 resources; True and False are everywhere and nowhere.
Bits = np.ndarray | bool

_SIDES = ("subject", "resource")
_SCALAR = ("EQ", "NEQ", "LT", "LE", "GT", "GE")
_SET = ("IN", "NIN", "CONTAINS", "SUPERSET")


def _links(p: Predicate) -> bool:
    return p.by_attribute and {p.left_scope, p.right_scope} == set(_SIDES)


def _by_arrays(c: Compiler, p: Predicate) -> bool:
    """Whether a predicate concerns one side alone or links the two in a way that arrays can tell."""
    if not _links(p):
        return True
    a, b = c.attribute(p.left_scope, p.left_attr), c.attribute(p.right_scope, p.right_attr)
    return comparable(a, b) and (p.op.upper() in _SET or (p.op.upper() in _SCALAR and not a.many and not b.many))


def _columns(c: Compiler, predicates: list[Predicate]) -> dict[str, list[Column]]:
    """Each side's columns: v and the predicate's number for what concerns it alone, else x (value or members) and k (known)."""
    sides: dict[str, list[Column]] = {s: [] for s in _SIDES}
    for n, p in enumerate(predicates):
        if not _links(p):
            scope = "resource" if "resource" in (p.left_scope, p.right_scope if p.by_attribute else None) else "subject"
            sides[scope].append(c.predicate(p)[0].alias(f"v{n}"))
            continue
        a, b = c.attribute(p.left_scope, p.left_attr), c.attribute(p.right_scope, p.right_attr)
        for scope, own, other in ((p.left_scope, a, b), (p.right_scope, b, a)):
            x = own.as_set if p.op.upper() in _SET else own.value
            if own.base != other.base:
                x = x.cast("array<double>" if p.op.upper() in _SET else "double")
            sides[scope] += [x.alias(f"x{n}"), F.coalesce(own.known, F.lit(False)).alias(f"k{n}")]
    return sides


def _numbered(table: pa.Table) -> pa.Table:
    """The table, sets' members as numbers in a dictionary of the block's, so that pairs of blocks compare dictionaries."""
    for at, field in enumerate(table.schema):
        if pa.types.is_list(field.type):
            column = _array(table, field.name)
            flat = column.flatten()
            if pa.types.is_floating(flat.type):
                flat = pc.add(flat, 0.0)  # -0.0 is 0.0
            starts = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())].astype(np.int32)
            table = table.set_column(at, field.name, pa.ListArray.from_arrays(pa.array(starts), flat.dictionary_encode(null_encoding="encode")))
    return table


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """block: Arrow streams of at most size rows each, sets as _numbered() has them; nth numbers a task's blocks from its own number on."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        nth = TaskContext.get().partitionId() * 7919

        def streams(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal nth
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            for at in range(0, len(table), size):
                part = table.slice(at, size)
                if len(part) < size and not last:
                    held.extend(part.to_batches())
                    break
                part = _numbered(part)
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, part.schema) as stream:
                    stream.write_table(part)
                yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary()), pa.array([nth], pa.int64())], names=["block", "nth"])
                nth += 1

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= size:
                yield from streams(False)
        if held:
            yield from streams(True)

    return rows.mapInArrow(pack, "block binary, nth long")


def _spots(spark: SparkSession) -> list[int]:
    """Numbers that a shuffle by them deals to partitions of their own: SPOTS for each core, if there are as many partitions."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbers = spark.range(64 * partitions).select(F.col("id").cast("int").alias("spot"))
    alone = numbers.groupBy(F.pmod(F.hash("spot"), F.lit(partitions)).alias("place")).agg(F.min("spot").alias("spot"))
    return [r.spot for r in alone.orderBy("spot").limit(SPOTS * max(8, spark.sparkContext.defaultParallelism)).collect()]


def _array(table: pa.Table, name: str) -> pa.Array:
    return table[name].combine_chunks() if table[name].num_chunks != 1 else table[name].chunk(0)


def _codes(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in the order of two columns' values, equal ones alike; nulls are -1."""
    both = pa.concat_arrays([a, b])
    empty = both.is_null().to_numpy(zero_copy_only=False)
    if pa.types.is_string(both.type) or pa.types.is_large_string(both.type):
        codes = pc.rank(both.cast(pa.large_string()), tiebreaker="dense").to_numpy().astype(np.int32)
    else:
        plain = both.cast(pa.int8()) if pa.types.is_boolean(both.type) else both
        codes = np.unique(pc.fill_null(plain, 0).to_numpy(zero_copy_only=False), return_inverse=True)[1].astype(np.int32)
    codes[empty] = -1
    return codes[: len(a)], codes[len(a) :]


def _marks(sets: pa.Array, place: np.ndarray, members: int) -> np.ndarray:
    """For each set (a row) which members it has; place gives each number's, or -1."""
    row = np.repeat(np.arange(len(sets)), np.diff(sets.offsets.to_numpy()))
    at = place[sets.flatten().indices.to_numpy(zero_copy_only=False)] if len(row) else row
    mark = np.zeros((len(sets), members), np.float32)
    mark[row[at >= 0], at[at >= 0]] = 1
    return mark


def _shared(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many members each set of a shares with each of b, and how many they have."""
    x, y = (s.flatten().dictionary for s in (a, b))
    nth = pc.index_in(y, value_set=x)
    both = np.flatnonzero(nth.is_valid().to_numpy(zero_copy_only=False))
    common = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, len(both), MEMBERS):
        in_b = both[at : at + MEMBERS]
        places = [np.full(len(d), -1, np.int64) for d in (x, y)]
        for place, own in zip(places, (nth.take(pa.array(in_b)).to_numpy(zero_copy_only=False), in_b), strict=True):
            place[own] = np.arange(len(in_b))
        common += _marks(a, places[0], len(in_b)) @ _marks(b, places[1], len(in_b)).T
    return common, np.diff(a.offsets.to_numpy())[:, None], np.diff(b.offsets.to_numpy())[None]


class _Side:
    """A block of one side, and what is made of its columns, once."""

    def __init__(self, block: pa.Buffer) -> None:
        self.table = pa.ipc.open_stream(block).read_all()
        self.words = -(-len(self.table) // 64)
        self.made: dict = {}

    def once(self, name: str, make: Callable):
        if name not in self.made:
            self.made[name] = make()
        return self.made[name]

    def array(self, name: str) -> pa.Array:
        return self.once(name, lambda: _array(self.table, name))

    def tri(self, n: int) -> np.ndarray:
        """1, 0 (unknown) and -1 of a predicate that concerns this side alone."""
        one = self.array(f"v{n}")
        return self.once(f"tri{n}", lambda: np.where(one.is_null().to_numpy(zero_copy_only=False), 0, np.where(pc.fill_null(one, False).to_numpy(zero_copy_only=False), 1, -1)).astype(np.int8))

    def known(self, n: int) -> np.ndarray:
        return self.once(f"known{n}", lambda: self.array(f"k{n}").to_numpy(zero_copy_only=False))

    def members(self, n: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Rows and numbers of sets' members, and what the numbers stand for."""

        def make() -> tuple[np.ndarray, np.ndarray, pa.Array]:
            sets = self.array(f"x{n}")
            flat = sets.flatten()
            return np.repeat(np.arange(len(sets)), np.diff(sets.offsets.to_numpy())), flat.indices.to_numpy(zero_copy_only=False), flat.dictionary

        return self.once(f"members{n}", make)

    def values(self, n: int) -> pa.Array:
        x = self.array(f"x{n}")
        return self.once(f"values{n}", lambda: pc.add(x, 0.0) if pa.types.is_floating(x.type) else x)  # -0.0 is 0.0

    def bits(self, where: np.ndarray) -> np.ndarray:
        """One bitmap of a mark for each row of this block."""
        return _bitmaps(np.zeros(np.count_nonzero(where), np.int64), np.flatnonzero(where), 1, self.words)

    def alike(self, numbers: list[int]) -> list[tuple[dict[int, int], np.ndarray]]:
        """This block's rows by their values of predicates that concern them alone."""

        def make() -> list[tuple[dict[int, int], np.ndarray]]:
            kind = np.zeros(len(self.table), np.int64)
            for n in numbers:
                kind = np.unique(kind * 3 + self.tri(n), return_inverse=True)[1]
            rows = [np.flatnonzero(kind == nth) for nth in range(int(kind.max()) + 1)]
            return [({n: int(self.tri(n)[some[0]]) for n in numbers}, some) for some in rows]

        return self.once("alike", make)

    @property
    def bytes(self) -> int:
        return self.table.nbytes + sum(x.nbytes for made in self.made.values() for x in (made if isinstance(made, tuple) else (made,)) if hasattr(x, "nbytes"))


def _packed(marks: np.ndarray) -> np.ndarray:
    """Rows of marks, a multiple of 64 each, as words of bits."""
    return np.packbits(marks, axis=1, bitorder="little").view(np.uint64)


#: A word's bits, each alone.
_BIT = _packed(np.eye(64, dtype=bool))[:, 0]


def _bitmaps(slot: np.ndarray, row: np.ndarray, slots: int, words: int) -> np.ndarray:
    """For each slot the rows that are named with it, as words of bits."""
    if slots <= MAPPED:
        marks = np.zeros((slots, words * 64), bool)
        marks[slot, row] = True
        return _packed(marks)
    bits = np.zeros((slots, words * 8), np.uint8)
    np.bitwise_or.at(bits, (slot, row >> 3), (1 << (row & 7)).astype(np.uint8))
    return bits.view(np.uint64)


def _not(bits: np.ndarray) -> np.ndarray:
    """In place."""
    return np.invert(bits, out=bits)


def _both(a: Bits, b: Bits) -> Bits:
    if a is False or b is False:
        return False
    return b if a is True else a if b is True else a & b


def _either(a: Bits, b: Bits) -> Bits:
    if a is True or b is True:
        return True
    return b if a is False else a if b is False else a | b


def _unions(masks: np.ndarray, bitmaps: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """For chosen rows of masks the union of the bitmaps that each marks, by tables of the unions of 8 each."""
    words = bitmaps.shape[1]
    tables = []
    for at in range(0, len(bitmaps), 8):
        some = bitmaps[at : at + 8]
        table = np.zeros((1 << len(some), words), np.uint64)
        for nth, one in enumerate(some):
            np.bitwise_or(table[: 1 << nth], one, out=table[1 << nth : 2 << nth])
        tables.append(table)
    chosen = np.packbits(masks, axis=1, bitorder="little")

    def union(rows: np.ndarray) -> np.ndarray:
        if not tables:
            return np.zeros((len(rows), words), np.uint64)
        found, more = tables[0][chosen[rows, 0]], np.empty((len(rows), words), np.uint64)
        for nth, table in enumerate(tables[1:], 1):
            of = chosen[rows, nth]
            some = np.flatnonzero(of)
            if 2 * len(some) <= len(rows):
                found[some] |= table[of[some]]
            else:
                found |= np.take(table, of, axis=0, out=more, mode="clip")
        return found

    return union


def _of_sets(p: Predicate, n: int, subjects: _Side, resources: _Side) -> Callable[[np.ndarray], np.ndarray]:
    row, number, own = subjects.members(n)
    there, member, others = resources.members(n)
    turned, op = p.left_scope == "resource", p.op.upper()
    if len(others) > MAPPED:

        def counted(rows: np.ndarray) -> np.ndarray:
            common, size_x, size_y = _shared(subjects.array(f"x{n}").take(pa.array(rows)), resources.array(f"x{n}"))
            marks = np.zeros((len(rows), resources.words * 64), bool)
            marks[:, : len(resources.table)] = common > 0 if op == "IN" else common == 0 if op == "NIN" else common == (size_x if turned else size_y)
            return _packed(marks)

        return counted
    bitmaps = resources.once(f"bitmaps{n}", lambda: _bitmaps(member, there, len(others), resources.words))
    place = pc.fill_null(pc.index_in(own, value_set=others), -1).to_numpy(zero_copy_only=False)
    at = place[number] if len(number) else number
    has = np.zeros((len(subjects.table), len(others)), bool)
    has[row[at >= 0], at[at >= 0]] = True
    if op in ("IN", "NIN"):
        shares = _unions(has, bitmaps)
        return shares if op == "IN" else lambda rows: _not(shares(rows))
    if not turned:  # the resource has none that the subject hasn't
        more = _unions(~has, bitmaps)
        return lambda rows: _not(more(rows))
    lacks, alone = _unions(has, ~bitmaps), np.zeros(len(subjects.table), bool)
    alone[row[at < 0]] = True  # has a member that no resource has

    def included(rows: np.ndarray) -> np.ndarray:
        found = _not(lacks(rows))
        found[alone[rows]] = 0
        return found

    return included


def _of_values(op: str, n: int, subjects: _Side, resources: _Side) -> Callable[[np.ndarray], np.ndarray]:
    kinds = resources.once(f"kinds{n}", lambda: resources.values(n).dictionary_encode(null_encoding="encode"))
    number = kinds.indices.to_numpy(zero_copy_only=False)
    at = pc.fill_null(pc.index_in(subjects.values(n), value_set=kinds.dictionary), -1).to_numpy(zero_copy_only=False)
    if len(kinds.dictionary) <= MAPPED:
        bitmaps = resources.once(f"bitmaps{n}", lambda: _bitmaps(number, np.arange(len(number)), len(kinds.dictionary) + 1, resources.words))
    else:  # only values that subjects have
        used = np.unique(at[at >= 0])
        slots = np.full(len(kinds.dictionary) + 1, -1, np.int64)
        slots[used] = np.arange(len(used))
        there = np.flatnonzero(slots[number] >= 0)
        bitmaps, at = _bitmaps(slots[number[there]], there, len(used) + 1, resources.words), slots[at]
    return (lambda rows: bitmaps[at[rows]]) if op == "EQ" else lambda rows: _not(bitmaps[at[rows]])


def _of_order(op: str, n: int, subjects: _Side, resources: _Side) -> Callable[[np.ndarray], np.ndarray]:
    """By bitmaps of the resources from every STEPth on, in order; those before the next one are marked one by one."""
    x, y = subjects.values(n), resources.values(n)
    if pa.types.is_string(x.type) or pa.types.is_large_string(x.type):
        a, b = _codes(x, y)
        order = np.argsort(b, kind="stable")
    else:
        a, b = (pc.fill_null(v.cast(pa.int8()) if pa.types.is_boolean(v.type) else v, 0).to_numpy(zero_copy_only=False) for v in (x, y))
        order = resources.once(f"order{n}", lambda: np.argsort(b, kind="stable"))
    above = op in ("LT", "LE")  # the resource's value is above the subject's
    first = np.searchsorted(b[order], a, side="right" if op in ("LT", "GE") else "left")

    def from_there() -> np.ndarray:
        bits = _bitmaps(np.arange(len(order)) // STEP, order, len(order) // STEP + 2, resources.words)  # the last two: the rest, and none
        for at in range(len(bits) - 2, -1, -1):
            bits[at] |= bits[at + 1]
        return bits

    bits = from_there() if pa.types.is_string(x.type) or pa.types.is_large_string(x.type) else resources.once(f"from{n}", from_there)
    word, bit = order >> 6, _BIT[order & 63]

    def ordered(rows: np.ndarray) -> np.ndarray:
        at = first[rows]
        step = -(-at // STEP)
        found = bits[step]
        end = np.minimum(step * STEP, len(order))
        for nth in range(STEP - 1):
            some = np.flatnonzero(at + nth < end)
            if not len(some):
                break
            one = at[some] + nth
            found[some, word[one]] |= bit[one]
        return found if above else _not(found)

    return ordered


def _linked(p: Predicate, n: int, subjects: _Side, resources: _Side) -> Callable[[np.ndarray, bool], Bits]:
    """Where a linking predicate is true, or is false, for chosen subjects; bits after the last resource are of no meaning."""
    op, own, others = p.op.upper(), subjects.known(n), resources.known(n)
    if op in _SET:
        holds = _of_sets(p, n, subjects, resources)
    elif op in ("EQ", "NEQ"):
        holds = _of_values(op, n, subjects, resources)
    else:
        own, others = (known & side.array(f"x{n}").is_valid().to_numpy(zero_copy_only=False) for known, side in ((own, subjects), (others, resources)))
        if p.left_scope == "resource":
            op = {"LT": "GT", "LE": "GE", "GT": "LT", "GE": "LE"}[op]
        holds = _of_order(op, n, subjects, resources)
    there: Bits = True if others.all() else resources.bits(others)
    last: list = [None, None]

    def value(rows: np.ndarray, want: bool) -> Bits:
        if last[0] is not rows:
            last[:] = rows, holds(rows)
        known = own[rows]
        here: Bits = True if known.all() else np.where(known, ~np.uint64(0), np.uint64(0))[:, None]
        return _both(_both(last[1] if want else ~last[1], here), there)

    return value


def _links_in(rule: Rule, node: str, linking: Callable[[Rule, str], bool]) -> int:
    e = rule.expressions[node]
    return int(linking(rule, e.predicate_id)) if e.op.upper() == "PRED" else sum(_links_in(rule, c, linking) for c in e.children)


def _tree(rule: Rule, node: str, want: bool, value: Callable[[Rule, str, bool], Bits], linking: Callable[[Rule, str], bool]) -> Bits:
    """Where the tree is true (or is false, as wanted); what links the two sides is asked last."""
    e = rule.expressions[node]
    op = e.op.upper()
    if op == "PRED":
        return value(rule, e.predicate_id, want)
    if op == "NOT":
        return _tree(rule, e.children[0], not want, value, linking) if e.children else False
    if op not in ("AND", "OR"):
        return False
    together = (op == "AND") == want
    found: Bits = together
    for child in sorted(e.children, key=lambda c: _links_in(rule, c, linking)):
        if found is (not together):
            break
        found = (_both if together else _either)(found, _tree(rule, child, want, value, linking))
    return found


class _Weights:
    """Whole numbers of a block's rows, to be summed over bits: the least of each word, and bitmaps of what is over it."""

    def __init__(self, weights: np.ndarray, words: int) -> None:
        padded = np.full(words * 64, weights[-1], np.int64)
        padded[: len(weights)] = weights
        self.least = padded.reshape(words, 64).min(axis=1)
        over = padded.view(np.uint64) - np.repeat(self.least, 64).view(np.uint64)
        self.planes = [_packed((over >> np.uint64(bit) & np.uint64(1)).astype(bool)[None]) for bit in range(int(over.max()).bit_length())]
        self.nbytes = self.least.nbytes * (1 + len(self.planes))

    def sums(self, bits: np.ndarray, counts: np.ndarray, more: np.ndarray) -> np.ndarray:
        """counts: how many bits each word has; more: room for as many words."""
        found = counts.sum(axis=1, dtype=np.int64) * self.least[0] if (self.least == self.least[0]).all() else counts.astype(np.int64) @ self.least
        counted = np.empty(bits.shape, np.uint8)
        for nth, plane in enumerate(self.planes):
            found += np.bitwise_count(np.bitwise_and(bits, plane, out=more), out=counted).sum(axis=1, dtype=np.uint32).astype(np.int64) << nth
        return found


def permitted_totals(subjects: DataFrame, resources: DataFrame, policy: Policy, action: str, by: Column, sums: dict[str, Column]) -> DataFrame:
    """by (a column of subject, named key), n and sums of the pairs that permitted_pairs() gives, for keys that have one: n counts them, sums are
    long columns of resource. Nothing is a row for a pair: work is that of the product of subjects and distinct resources, memory that of
    two blocks and of bitmaps, and what is shuffled grows with subjects and resources. Policies that link the two by MATCH, by
    lists or by sets' equality or order go by permitted_pairs().
    """
    spark = subjects.sparkSession
    named = F.lit(action).alias("action")
    left, right = subjects.select("subject", named), resources.select("resource", named)
    c = Compiler(policy, left.limit(0).withColumn("resource", F.lit(None).cast(resources.schema["resource"].dataType)))
    applying = [r for r in policy.rules if action in r.actions]
    total = [F.sum(name).alias(name) for name in ("n", *sums)]
    predicates = [(r.rule_id, p) for r in applying for p in c.used(r)]
    if not all(_by_arrays(c, p) for _, p in predicates):
        pairs = permitted_pairs(subjects, resources, policy, action)
        return pairs.select(by.alias("key"), F.lit(1).cast("long").alias("n"), *(v.cast("long").alias(name) for name, v in sums.items())).groupBy("key").agg(*total)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    number = {(r, p.predicate_id): n for n, (r, p) in enumerate(predicates)}
    own = _columns(c, [p for _, p in predicates])
    weights = ["n", *(f"s_{name}" for name in sums)]
    kept = right.select(*(v.cast("long").alias(f"s_{name}") for name, v in sums.items()), *own["resource"])
    told = [F.sort_array(f.name).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in kept.schema if f.name not in weights]
    kept = kept.groupBy(*told).agg(F.count("*").alias("n"), *(F.coalesce(F.sum(w), F.lit(0).cast("long")).alias(w) for w in weights[1:]))
    # in order, so that near sums are near each other, and a task that is run again makes the same blocks
    names_told = [f.name for f in kept.schema if f.name not in weights]
    kept = kept.repartitionByRange(*reversed(weights), F.xxhash64(*names_told) if names_told else F.lit(0)).sortWithinPartitions(*reversed(weights), *names_told)
    spots = _spots(spark)
    places = F.array(*map(F.lit, spots))
    asked = _blocks(left.select(by.alias("key"), *own["subject"]).sortWithinPartitions("key"), SUBJECT_ROWS).select("block", F.get(places, F.pmod("nth", F.lit(len(spots))).cast("int")).alias("spot"))
    # a copy for each spot, which no estimate of Spark's counts: shuffled, never broadcast; the blocks' bytes say nothing of their work, so spots stay apart
    blocks = _blocks(kept, RESOURCE_ROWS).repartition(len(spots), F.xxhash64("block"))
    held = blocks.select(F.col("block").alias("others"), F.xxhash64("block").alias("others_hash"), F.explode(places).alias("spot"))
    met = asked.repartition(len(spots), "spot").hint("merge").join(held.repartition(len(spots), "spot").hint("merge"), "spot").select("block", "others", "others_hash")
    linking, names = [_links(p) for _, p in predicates], list(sums)
    links = lambda rule, predicate_id: linking[number[rule.rule_id, predicate_id]]

    def judge(subjects_: _Side, resources_: _Side, found: np.ndarray) -> None:
        """Adds a pair of blocks to the totals found."""
        judged: dict[int, Callable] = {}
        alone = [n for n in range(len(predicates)) if not linking[n] and f"v{n}" in subjects_.table.column_names]

        def weighed(name: str) -> _Weights:
            return resources_.once(f"weights {name}", lambda: _Weights(resources_.array(name).to_numpy(zero_copy_only=False), resources_.words))

        def holds(denies: bool, value: Callable) -> Bits:
            found_: Bits = False
            for r in applying:
                if r.denies == denies and found_ is not True:
                    found_ = _either(found_, _tree(r, r.root, True, value, links))
            return found_

        every = resources_.once("every", lambda: resources_.bits(np.ones(len(resources_.table), bool)))
        step = max(1, WORDS // max(1, resources_.words))
        for constants, alike in subjects_.alike(alone):
            for at in range(0, len(alike), step):
                rows = alike[at : at + step]

                def value(rule: Rule, predicate_id: str, want: bool, rows=rows, constants=constants) -> Bits:
                    n = number[rule.rule_id, predicate_id]
                    if n in constants:
                        return constants[n] == (1 if want else -1)
                    if not linking[n]:
                        return resources_.once(f"bits{n}{want}", lambda: resources_.bits(resources_.tri(n) == (1 if want else -1)))
                    if n not in judged:
                        judged[n] = _linked(predicates[n][1], n, subjects_, resources_)
                    return judged[n](rows, want)

                denied = holds(True, value)
                permitted = holds(False, value) if denied is not True else False
                if permitted is False:
                    continue
                permitted = _both(_both(permitted, every), True if denied is False else ~denied)
                counts, more = np.bitwise_count(permitted), np.empty_like(permitted)
                for nth, name in enumerate(weights):
                    found[nth, rows] += weighed(name).sums(permitted, counts, more)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, side, found = None, None, None
        seen: dict[int, list[tuple[pa.Buffer, _Side]]] = {}

        def made() -> pa.RecordBatch:
            some = found[0] > 0
            return pa.RecordBatch.from_arrays([side.array("key").filter(pa.array(some)), *(pa.array(x[some]) for x in found)], names=["key", "n", *names])

        def resource(block: pa.Buffer, hashed: int) -> _Side:
            """A block of resources, of those that were met before with what was made of them, as long as there is room."""
            for other, known in seen.get(hashed, ()):
                if other.equals(block):
                    return known
            if sum(known.bytes for some in seen.values() for _, known in some) > KEPT_BYTES:
                seen.clear()
            copied = pa.py_buffer(block.to_pybytes())
            seen.setdefault(hashed, []).append((copied, _Side(copied)))
            return seen[hashed][-1][1]

        for batch in batches:
            for row in range(len(batch)):
                block, others = (batch.column(i)[row].as_buffer() for i in range(2))
                if last is None or not block.equals(last):
                    if last is not None:
                        yield made()
                    last, side = block, _Side(block)
                    found = np.zeros((len(weights), len(side.table)), np.int64)
                judge(side, resource(others, batch.column(2)[row].as_py()), found)
        if last is not None:
            yield made()

    kind = left.select(by.alias("key")).schema["key"].dataType.simpleString()
    schema = ", ".join([f"key {kind}", "n long", *(f"{name} long" for name in sums)])
    return met.mapInArrow(totals, schema).groupBy("key").agg(*total)
