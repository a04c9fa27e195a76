"""Spelling variants: words that differ by one inserted, deleted or replaced code point, and each word's likeliest form.

One error spares the first or the second half of a word. So each word asks twice: once with its first half, matched
exactly in a minimal acyclic automaton of words, and once with its second half, in an automaton of the words read
backward. From the state that the half leads to the rest is completed with exactly one error. Every edge carries the number
of words that come before it, so a path's sum is its word's number in the sorted list: a perfect hash, and nothing needs
to be looked up by text.

Spark deals words out by halves: a word is stored where words of its own length or one more may ask for it, so the shorter
of two words, or either of two equally long ones, is found. Halves that many words share are split by the words' hashes, and
each part is asked. Each task builds the automata of its bucket; what it returns is summed up per word: no row for a pair.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdikt.llm.common import ascii_lower, bounded_batches, mixed, written

#: Stored words of a bucket, on average; a half that more words share is split into parts of so many.
BUCKET_WORDS = 40_000

#: Asking words that are completed at once.
ASKED = 8192


class Automaton:
    """The minimal acyclic automaton of sorted distinct words, given as labels from 1 (all words in one array) and their offsets.

    State 0 is the start. Edges are sorted by state and label: ``first[s] : first[s + 1]`` are those of state s, ``label``,
    ``target``, and ``skip``, the number of the state's words that come before the edge's.
    """

    def __init__(self, labels: np.ndarray, at: np.ndarray, seed: int = 0) -> None:
        n, length = len(at) - 1, np.diff(at)
        shared = _shared_beginnings(labels, at)
        # the trie, level by level: of each node its parent, label, first word and number of words
        word = np.arange(n)
        node = np.zeros(n, np.int64)
        parents, marks, firsts, levels, total = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [0, 1], 1
        depth = 0
        while True:
            depth += 1
            longer = length[word] >= depth
            word, node = word[longer], node[longer]
            if not len(word):
                break
            fresh = np.flatnonzero(shared[word] < depth)
            parents.append(node[fresh]), firsts.append(word[fresh]), marks.append(labels[at[word[fresh]] + depth - 1])
            node = total + np.cumsum(shared[word] < depth) - 1
            total += len(fresh)
            levels.append(total)
        parent, mark, first_word = np.concatenate(parents), np.concatenate(marks).astype(np.int64), np.concatenate(firsts)
        depth_of = np.repeat(np.arange(len(levels) - 1), np.diff(levels))
        final = length[first_word] == depth_of if n else np.zeros(1, bool)
        # bottom-up: what follows a node as a hash, and how many words
        follows, count = np.where(final, np.uint64(0x9E3779B97F4A7C15), np.uint64(0)), final.astype(np.int64)
        for level in range(len(levels) - 2, 0, -1):
            a, b = levels[level], levels[level + 1]
            follows[a:b] = mixed(follows[a:b], seed)
            np.add.at(follows, parent[a:b], mixed(follows[a:b] * np.uint64(2) + mark[a:b].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), seed + 1))
            np.add.at(count, parent[a:b], count[a:b])
        follows[:1] = 0  # the start is a state of its own
        _, example, state = np.unique(follows, return_index=True, return_inverse=True)
        # edges of the states' examples; the trie's children of all nodes must lead where those of the example do
        by_parent = np.lexsort((mark[1:], parent[1:])) + 1
        degree = np.bincount(parent[1:], minlength=total)
        start = np.concatenate([[0], np.cumsum(degree)])
        same = example[state]
        if not (np.array_equal(degree, degree[same]) and np.array_equal(final, final[same])):
            return self.__init__(labels, at, seed + 2)  # two different states with one hash
        nth = np.arange(len(by_parent)) - np.repeat(start[:-1], degree)
        twin = by_parent[np.repeat(start[same], degree) + nth]
        if not (np.array_equal(mark[by_parent], mark[twin]) and np.array_equal(state[by_parent], state[twin])):
            return self.__init__(labels, at, seed + 2)
        self.final = final[example]
        self.first = np.concatenate([[0], np.cumsum(degree[example])])
        edges = by_parent[np.repeat(start[example], degree[example]) + np.arange(self.first[-1]) - np.repeat(self.first[:-1], degree[example])]
        self.label, self.target = mark[edges], state[edges]
        before = np.concatenate([[0], np.cumsum(count[edges])])
        own = np.repeat(np.arange(len(example)), degree[example])
        self.skip = before[:-1] - before[self.first[own]] + self.final[own]
        self.width = int(mark.max()) + 2
        self.keys = own * self.width + self.label

    def step(self, state: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The edge that leaves each state by each label, and whether there is one."""
        key = state * self.width + np.minimum(label, self.width - 1)
        edge = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        return edge, (self.keys[edge] == key if len(self.keys) else np.zeros(len(key), bool))

    def near(self, labels: np.ndarray, at: np.ndarray, half: np.ndarray, first_of_run: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of an asking word and a stored word's number: the asking word's first half[i] labels match exactly, and of
        the rest one label is replaced or left out. Of a run of equal labels only one is left out, the first of the run
        (also across the half's end) or the last."""
        n, length = len(at) - 1, np.diff(at)
        state, number = np.zeros(n, np.int64), np.zeros(n, np.int64)
        asking = np.arange(n)
        for j in range(int(half.max(initial=0))):
            on = asking[half[asking] > j]
            edge, there = self.step(state[on], labels[at[on] + j])
            on, edge = on[there], edge[there]
            number[on] += self.skip[edge]
            state[on] = self.target[edge]
            asking = np.concatenate([on, asking[half[asking] <= j]])
        # exact: words without an error so far; erred: (word, state, number) with one
        exact, place = asking, at[:-1] + half
        state, number = state[exact], number[exact]
        erred = [np.zeros(0, np.int64)] * 3
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for j in range(int((length - half).max(initial=0)) + 1):
            over = half[erred[0]] + j == length[erred[0]]
            done = [x[over] for x in erred]
            good = self.final[done[1]]
            found.append((done[0][good], done[2][good]))
            erred = [x[~over] for x in erred]
            within = half[exact] + j < length[exact]
            exact, state, number = exact[within], state[within], number[within]
            here = place[exact] + j
            # one label replaced: all other edges
            degree = self.first[state + 1] - self.first[state]
            source = np.repeat(np.arange(len(exact)), degree)
            edges = np.repeat(self.first[state], degree) + np.arange(len(source)) - np.repeat(np.cumsum(degree) - degree, degree)
            other = self.label[edges] != labels[here][source]
            source, edges = source[other], edges[other]
            # one label left out: the state stays
            beside = np.clip(here - 1 if first_of_run else here + 1, 0, len(labels) - 1)
            edge_of_word = (here == at[exact]) if first_of_run else (here + 1 == at[exact + 1])
            out = np.flatnonzero(edge_of_word | (labels[beside] != labels[here]))
            # the earlier errors go on exactly
            edge, there = self.step(erred[1], labels[place[erred[0]] + j])
            edge = edge[there]
            moved = [x[there] for x in erred]
            erred = [
                np.concatenate([moved[0], exact[source], exact[out]]),
                np.concatenate([self.target[edge], self.target[edges], state[out]]),
                np.concatenate([moved[2] + self.skip[edge], number[source] + self.skip[edges], number[out]]),
            ]
            edge, there = self.step(state, labels[here])
            exact, state, number = exact[there], self.target[edge[there]], number[there] + self.skip[edge[there]]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _shared_beginnings(labels: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many labels each word shares with the one before it; -1 for the first."""
    n, length = len(at) - 1, np.diff(at)
    shared = np.zeros(n, np.int64)
    shared[:1] = -1
    on, depth = np.arange(1, n), 0
    while len(on):
        on = on[(length[on] > depth) & (length[on - 1] > depth)]
        on = on[labels[at[on] + depth] == labels[at[on - 1] + depth]]
        depth += 1
        shared[on] = depth
    return shared


def _labels(words: list[str], alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of all words in a row, numbered along the alphabet from 1, and the words' offsets."""
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return np.searchsorted(alphabet, _points(words)) + 1, at


def _points(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)


def near_in_bucket(words: list[str], counts: np.ndarray, asks: np.ndarray, stores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted distinct words: how many near words each has here, the largest count among those (-1: none) and that
    word's number (ties: the smallest). asks and stores: two columns of flags, by first and by second half."""
    n_near, best = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
    alphabet = np.unique(_points(words))
    size = len(words)
    for backward in (0, 1):
        stored, asking = np.flatnonzero(stores[:, backward]), np.flatnonzero(asks[:, backward])
        if not len(stored) or not len(asking):
            continue
        spelled = [(words[i][::-1] if backward else words[i], i) for i in stored.tolist()]
        spelled.sort() if backward else None
        numbered = np.array([i for _, i in spelled])
        automaton = Automaton(*_labels([w for w, _ in spelled], alphabet))
        for first in range(0, len(asking), ASKED):
            part = asking[first : first + ASKED]
            labels, at = _labels([words[i][::-1] if backward else words[i] for i in part.tolist()], alphabet)
            length = np.diff(at)
            asked, number = automaton.near(labels, at, length - length // 2 if backward else length // 2, bool(backward))
            one, two = part[asked], numbered[number]
            shorter = np.array([len(words[i]) for i in two.tolist()], np.int64) < length[asked]  # finds none itself
            for a, b in ((one, two), (two[shorter], one[shorter])):
                n_near += np.bincount(a, minlength=size)
                np.maximum.at(best, a, counts[b] * size + (size - 1 - b))
    return n_near, np.where(best < 0, -1, best // size), np.where(best < 0, -1, size - 1 - best % size)


def _bucket(table: pa.Table) -> pa.Table:
    """Rows word, n, backward, asks, stores of one bucket, some words repeated; returns word, n, n_near, best_n, best."""
    table = table.select(["word", "n", "backward", "asks", "stores"])
    flags = [pc.and_(table["backward"] if b else pc.invert(table["backward"]), table[c]) for c in ("asks", "stores") for b in (0, 1)]
    merged = pa.table([table["word"], table["n"], *flags], names=["word", "n", "a0", "a1", "s0", "s1"]).group_by("word").aggregate([("n", "max"), *((c, "any") for c in ("a0", "a1", "s0", "s1"))])
    words = merged["word"].to_pylist()
    order = sorted(range(len(words)), key=words.__getitem__)
    merged, words = merged.take(order), [words[i] for i in order]
    counts, flags = merged["n_max"].to_numpy(), np.column_stack([merged[f"{c}_any"].to_numpy(zero_copy_only=False) for c in ("a0", "a1", "s0", "s1")])
    n_near, best_n, best = near_in_bucket(words, counts, flags[:, :2], flags[:, 2:])
    chosen = pa.array([words[i] if i >= 0 else None for i in best.tolist()], pa.string())
    return pa.table({"word": pa.array(words, pa.string()), "n": counts, "n_near": n_near, "best_n": pa.array(best_n, mask=best_n < 0), "best": chosen})


def stored_halves(words: DataFrame) -> DataFrame:
    """word, n, backward, half (a hash), asks: each word with the halves under which it is stored; it asks with those of
    its own length."""
    length = F.char_length("word")
    rows = []
    for backward in (False, True):
        size = lambda n: F.floor((n + 1) / 2).cast("int") if backward else F.floor(n / 2).cast("int")  # noqa: B023, E731
        for longer in (0, 1):
            k = size(length + longer)
            part = F.substring(F.col("word"), length - k + 1, k) if backward else F.substring(F.col("word"), F.lit(1), k)
            row = F.struct(F.lit(backward).alias("backward"), F.xxhash64(F.lit(backward), part).alias("half"), F.lit(not longer).alias("asks"))
            rows.append(F.when(size(length + 1) > size(length), row) if longer else row)  # else the same half
    return words.select("word", "n", F.inline(F.array_compact(F.array(*rows))))


def near_words(words: DataFrame, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """word, n, n_near (near words), best_n and best (the near word of largest n, ties: the smallest; null if none) for a table of
    distinct words with their counts n."""
    rows = stored_halves(words)
    buckets = max(1, math.ceil(rows.count() / bucket_words))
    sizes = rows.groupBy("half").agg(F.count("*").alias("stored")).filter(F.col("stored") > bucket_words)
    crowded = written(sizes.select("half", F.ceil(F.col("stored") / bucket_words).cast("int").alias("parts")), "crowded")  # few: one of bucket_words rows at most
    parted = rows.join(crowded, "half", "left").withColumn("own", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")))
    every = F.when(F.col("asks") & F.col("parts").isNotNull(), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))
    spread = parted.select("word", "n", "backward", "half", "asks", "own", F.explode(every).alias("part"))
    # a part has its group to itself, lest a word that is there for another half were found in two parts
    alone = F.col("part").isNotNull()
    dealt = spread.select("word", "n", "backward", "asks", F.col("part").eqNullSafe(F.col("own")).alias("stores"), F.when(alone, F.col("half")).otherwise(F.pmod("half", F.lit(buckets))).alias("bucket"), "part")
    found = dealt.groupBy("bucket", "part").applyInArrow(_bucket, "word string, n long, n_near long, best_n long, best string")
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("minus"), "best"))).alias("best")
    summed = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    return summed.select("word", "n", "n_near", (-F.col("best.minus")).alias("best_n"), F.col("best.best").alias("best"))


def count_words(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", letters: str = r"A-Za-zÀ-ÿ", min_length: int = 7, min_count: int = 2, error_every: int | None = None) -> DataFrame:
    """word and n of the runs of letters, A-Z lower-cased, with min_length code points and min_count occurrences or more.
    With error_every, a run whose hash with its document's id (null: empty) that divides loses one code point first."""
    runs = F.regexp_extract_all(F.coalesce(F.col(f"`{text_column}`"), F.lit("")), F.lit(f"([{letters}]{{{min_length},}})"), F.lit(1))
    word = F.col("word")
    found = documents.select(F.col(f"`{id_column}`").alias("id"), F.explode(runs).alias("run")).select("id", ascii_lower(F.col("run")).alias("word"))
    if error_every:
        h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
        at = (F.col("h") % F.char_length(word)).cast("int")
        found = found.select("word", h.alias("h")).select(F.when(F.col("h") % error_every == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))).otherwise(word).alias("word"))
    return found.filter(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def spelling_groups(words: DataFrame, times: int = 10, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """word, form, root, n, n_near and form_n for a table of distinct words with counts n.

    form: the near word of largest n (ties: the smallest in code-point order) if it has times as many occurrences, else null. root: where
    a word's forms lead, the word itself without one. Counts grow by that factor along the way, so it is short, and
    doubled steps end after a few joins. An empty table gives none. Words may be of any length: automata take a step for
    each code point, over all words of a bucket at once.
    """
    if times < 2:
        raise ValueError("a form must have twice as many occurrences at least")
    bounded_batches(words.sparkSession)
    known = written(near_words(words, bucket_words).withColumn("form", F.when(F.col("best_n") >= times * F.col("n"), F.col("best"))), "spelling")
    led = known.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = known.agg(F.max("n")).first()[0] or 1
    for _ in range(max(1, math.floor(math.log(most, times)) + 1).bit_length()):
        led = written(led.join(led.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return known.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n"))


def group_spellings(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_length: int = 7, min_count: int = 2, times: int = 10, error_every: int | None = None, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """spelling_groups of the documents' words.

    Null and empty texts have no words; equal rows count as often as they occur; other columns aren't read; an empty table gives none.
    A very long text is one array of its words, counted like others.
    """
    words = written(count_words(documents, id_column, text_column, min_length=min_length, min_count=min_count, error_every=error_every), "words")
    return spelling_groups(words, times, bucket_words)
