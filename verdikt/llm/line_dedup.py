"""Line deduplication with DataFrame functions alone.

Every line has a key (stripped, A-Z lower-cased). The keys' hashes are first summed up by salt, so that a line which a
third of all documents share leaves few rows, then range-partitioned by hash and sorted by document and position within
it; a window streams over each hash's rows and yields its first occurrence and the number of its documents. Documents
get back a compressed bitmap of the lines that stay (run lengths), not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdikt.llm.common import WHITE, ascii_lower, row_key, written

#: Rows of one hash that reach the streaming window at most: its occurrences are summed up in so many parts.
SALTS = 64


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def lines_of(text: Column) -> Column:
    """All lines; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keyed_lines(documents: DataFrame, id_column: str, text_column: str, min_length: int) -> DataFrame:
    """One row per line whose key has min_length code points at least: k1, k2 (the row's key), id, position, h1, h2
    (128 bits of the line key's hash) and fresh (whether the row has the key for the first time there)."""
    source = documents.select(*row_key(f"`{id_column}`", f"`{text_column}`"), F.col(f"`{id_column}`").alias("id"), lines_of(F.col(f"`{text_column}`")).alias("lines"))
    keys = source.select("k1", "k2", "id", F.transform("lines", line_key).alias("keys"))
    mark = lambda key, at: F.struct(F.xxhash64(F.lit(1), key).alias("h1"), F.xxhash64(F.lit(2), key).alias("h2"), at.alias("position"), (F.char_length(key) >= min_length).alias("counts"))
    marks = keys.select("k1", "k2", "id", F.sort_array(F.filter(F.transform("keys", mark), lambda m: m.counts)).alias("marks")).filter(F.size("marks") > 0)
    before = F.concat(F.slice("marks", 1, 1), F.slice("marks", 1, F.size("marks") - 1))  # each one's predecessor; the first's is itself
    pairs = F.transform(F.arrays_zip(F.col("marks").alias("this"), before.alias("before")), lambda p, at: F.struct(p.this.h1.alias("h1"), p.this.h2.alias("h2"), p.this.position.alias("position"), ((at == 0) | (p.this.h1 != p.before.h1) | (p.this.h2 != p.before.h2)).alias("fresh")))
    return marks.select("k1", "k2", "id", F.inline(pairs))


def line_occurrences(lines: DataFrame, min_documents: int = 2) -> DataFrame:
    """h1, h2, documents (rows that have the line) and first (its first occurrence: id, k1, k2, position) of each line
    that min_documents rows or more have. Every row is a document of its own; a null id comes first."""
    salt = F.pmod(F.xxhash64("k1", "k2"), F.lit(SALTS))
    here = F.struct("id", "k1", "k2", "position")
    parts = lines.groupBy("h1", "h2", salt.alias("salt")).agg(F.count_if("fresh").alias("part"), F.min(here).alias("first"))
    ranged = parts.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "first")
    same = Window.partitionBy("h1", "h2").orderBy("first")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    streamed = ranged.select("h1", "h2", "first", F.row_number().over(same).alias("nth"), F.sum("part").over(whole).alias("documents"))
    return streamed.filter((F.col("nth") == 1) & (F.col("documents") >= min_documents)).drop("nth")


def run_lengths(positions: Column) -> Column:
    """Sorted distinct positions of what goes, as lengths of runs: kept, dropped, kept, dropped, ..."""
    size = F.size(positions)
    before = F.concat(F.array(F.lit(-1)), F.slice(positions, 1, size - 1))
    after = F.concat(F.slice(positions, 2, size), F.array(F.lit(-1)))
    zipped = F.arrays_zip(positions.alias("x"), before.alias("before"), after.alias("after"))
    starts = F.filter(zipped, lambda p: (p.x != p.before + 1) | (p.x == 0))
    ends = F.filter(zipped, lambda p: p.x + 1 != p.after)
    last_end = F.concat(F.array(F.lit(-1)), F.transform(ends, lambda p: p.x))
    runs = F.filter(F.arrays_zip(starts.alias("start"), ends.alias("end"), last_end.alias("gone")), lambda r: r.start.isNotNull())
    return F.flatten(F.transform(runs, lambda r: F.array(r.start.x - r.gone - 1, r.end.x - r.start.x + 1)))


def keep_bitmaps(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_length: int = 1, min_documents: int = 2, keep_first: bool = True) -> DataFrame:
    """k1, k2 and keep, for rows that lose lines: the bitmap of the lines that stay, compressed to run lengths, kept
    lines first. Lines found in min_documents rows or more go, but for the first occurrence if keep_first.

    Hot lines: the join is an equi-join with one row per line on the right, so adaptive execution broadcasts a right
    side that it has measured to be small, and else splits a hot line's rows.
    """
    lines = written(keyed_lines(documents, id_column, text_column, min_length), "lines")  # hashes alone, for both uses
    common = line_occurrences(lines, min_documents).withColumnsRenamed({"h1": "c1", "h2": "c2"})
    hit = lines.join(common, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")))
    if keep_first:
        hit = hit.filter((F.col("k1") != F.col("first.k1")) | (F.col("k2") != F.col("first.k2")) | (F.col("position") != F.col("first.position")))
    gone = hit.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("position")).alias("gone"))
    return gone.select("k1", "k2", run_lengths(F.col("gone")).alias("keep"))


def dedup_lines(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_length: int = 1, min_documents: int = 2, keep_first: bool = True) -> DataFrame:
    """The rows of documents without their common lines, and with n_lines, n_dropped and keep (run lengths; null if all
    stay) as further columns, which replace columns of these names.

    Null and empty texts are one empty line, whose key is empty and stays if min_length is positive; a null text stays
    null. A row whose lines all go has an empty text. Equal rows are documents of their own and lose the same lines. A
    very long text is one array of lines within its row.
    """
    bitmaps = keep_bitmaps(documents, id_column, text_column, min_length, min_documents, keep_first).withColumnsRenamed({"k1": "b1", "k2": "b2", "keep": "b_keep"})
    others = [F.col(f"`{c}`") for c in documents.columns if c not in ("n_lines", "n_dropped", "keep")]
    keys = [k.alias(name) for k, name in zip(row_key(f"`{id_column}`", f"`{text_column}`"), ("__k1", "__k2"), strict=True)]
    joined = documents.select(*others, *keys).join(bitmaps, (F.col("__k1") == F.col("b1")) & (F.col("__k2") == F.col("b2")), "left")
    text, keep = F.col(f"`{text_column}`"), F.col("b_keep")
    flags = F.flatten(F.transform(keep, lambda run, at: F.array_repeat(at % 2 == 0, run)))
    stay = F.array_join(F.zip_with(lines_of(text), flags, lambda line, flag: F.when(F.coalesce(flag, F.lit(True)), line)), "\n")
    n_dropped = F.aggregate(F.transform(keep, lambda run, at: F.when(at % 2 == 1, run).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)
    n_lines = F.char_length(F.coalesce(text, F.lit(""))) - F.char_length(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(""))) + 1
    rest = [F.col(f"`{c}`") if c != text_column else F.when(keep.isNull(), text).otherwise(stay).alias(c) for c in documents.columns if c not in ("n_lines", "n_dropped", "keep")]
    return joined.select(*rest, n_lines.cast("long").alias("n_lines"), F.coalesce(n_dropped, F.lit(0)).cast("long").alias("n_dropped"), keep.alias("keep"))
