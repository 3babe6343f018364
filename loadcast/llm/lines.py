"""Repeated lines across documents, equal or within a small edit distance. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored
from .filters import bitmap_of, maybe_in, split_by

#: Characters from which lines within ``THRESHOLD`` edits count as the same; equal ones do at any length.
MIN_CHARS = 30
THRESHOLD = 1
#: Lines in one index entry up to which its pairs are compared; lines of fuller entries go by deletions.
CELL_PAIRS = 64


def _lines(docs: DataFrame) -> DataFrame:
    """Every line of every text (columns i, t): document id, hash of the text, place and line."""
    return (docs.select("i", F.xxhash64("t").alias("th"), F.posexplode(F.split("t", "\n")).alias("pos", "line")))


def _key(line: str = "line") -> Column:
    """The first 128 bits of the SHA-256 of a line."""
    return F.unhex(F.substring(F.sha2(line, 256), 1, 32))


def segments(length: Column, threshold: int) -> list[tuple[Column, Column]]:
    """Start (from 1) and length of ``threshold + 1`` segments that are even but for one character."""
    n = threshold + 1
    short, longer = (length / n).cast("int"), length % n
    found, start = [], F.lit(1)
    for i in range(n):
        size = short + F.when(longer >= n - i, 1).otherwise(0)
        found.append((start, size))
        start = start + size
    return found


def index_entries(line: Column, threshold: int) -> list[Column]:
    """Hash of length, number and text of each segment."""
    length = F.length(line)
    return [F.xxhash64(length, F.lit(i), F.substring(line, at, size))
            for i, (at, size) in enumerate(segments(length, threshold))]


def probe_entries(line: Column, threshold: int) -> list[Column]:
    """Hashes under which a line finds the indexed segments of lines that are up to ``threshold`` shorter.

    Of the substrings that may match segment i of a line shorter by d, only those count whose shift leaves
    enough edits for the segments before and after (multi-match-aware selection). Those equal to the line's
    own index entries are left out; entries of segments that do not fit are null.
    """
    length, found = F.length(line), []
    for shorter in range(threshold + 1):
        of = length - shorter
        for i, (at, size) in enumerate(segments(of, threshold)):
            rest = threshold - i
            for shift in range(max(-i, shorter - rest), min(i, shorter + rest) + 1):
                if shorter == shift == 0:
                    continue
                start = at + shift
                fits = (start >= 1) & (start + size - 1 <= length) & (of >= 1)
                found.append(F.when(fits, F.xxhash64(of, F.lit(i), F.substring(line, start, size))))
    return found


def within(a: str, b: str, threshold: int) -> Column:
    """Whether two lines are within ``threshold`` edits, by a banded bit-parallel automaton.

    Bit d + threshold of a word stands for the diagonal on which ``b`` is d characters ahead of ``a``; word e
    holds the diagonals that up to e edits can reach. Every character of ``a`` moves all diagonals at once: a match
    stays on its diagonal, a replacement stays and costs one edit, a deletion from ``a`` falls one diagonal
    back, an insertion climbs one without using a character.
    """
    k, width = threshold, 2 * threshold + 1

    def climb(words: list[Column]) -> list[Column]:
        out = [words[0]]
        for word in words[1:]:
            out.append(word.bitwiseOR(out[-1]).bitwiseOR(F.shiftleft(out[-1], 1)).bitwiseAND(F.lit((1 << width) - 1)))
        return out

    def packed(words: list[Column]) -> Column:
        return F.struct(*[w.cast("int").alias(f"w{e}") for e, w in enumerate(words)])

    def matches(lines: Column, at: Column) -> Column:
        """Diagonals on which the character at ``at`` matches; places outside of ``b`` match nothing."""
        char = F.get(lines["a"], at)
        found = [F.when(F.get(lines["b"], at + (bit - k)) == char, 1 << bit).otherwise(0) for bit in range(width)]
        return sum(found[1:], found[0])

    def move(state: Column, same: Column) -> Column:
        words = [state[f"w{e}"] for e in range(k + 1)]
        moved = [words[0].bitwiseAND(same)]
        for e in range(1, k + 1):
            moved.append(words[e].bitwiseAND(same).bitwiseOR(words[e - 1]).bitwiseOR(F.shiftright(words[e - 1], 1)))
        return packed(climb(moved))

    # a lambda's variable holds the characters, so that they are split once and not once per character
    lines = F.array(F.struct(F.split(F.col(a), "").alias("a"), F.split(F.col(b), "").alias("b")))
    end = F.transform(lines, lambda both: F.aggregate(
        F.sequence(F.lit(0), F.length(a) - 1), packed(climb([F.lit(1 << k)] + [F.lit(0)] * k)),
        lambda state, at: move(state, matches(both, at)), lambda state: state[f"w{k}"]))
    ahead = F.length(b) - F.length(a)
    return F.when(F.abs(ahead) > k, False).when(F.length(a) == 0, True).otherwise(
        F.getbit(F.get(end, F.lit(0)), ahead + k) == 1)


def line_table(docs: DataFrame, min_chars: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Occurrences of lines with a word (i, th, pos, key) and distinct lines with first place and index entries.

    Lines under ``min_chars`` have no entries.
    """
    worded = _lines(docs).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    at = F.struct("i", "th", "pos").alias("at")
    occurrences = worded.select("i", "th", "pos", _key().alias("key"))
    line, long = F.col("line"), F.length("line") >= min_chars
    distinct = (worded.select(_key().alias("key"), at,
                              F.when(long, F.array(*index_entries(line, threshold))).alias("index"),
                              F.when(long, F.array(*probe_entries(line, threshold))).alias("probe"))
                .groupBy("key").agg(F.min("at").alias("first"), F.count("*").alias("n"),
                                    F.first("index").alias("index"), F.first("probe").alias("probe")))
    return occurrences, stored(distinct, "lines")


def line_links(docs: DataFrame, distinct: DataFrame, min_chars: int, threshold: int, cell_pairs: int) -> DataFrame:
    """Per distinct line that has one: ``links`` to other lines and ``earlier``, the first place of the earliest."""
    entries = distinct.select("key", "first", F.explode("index").alias("h"), F.lit(True).alias("indexed")).union(
        distinct.select("key", "first", F.explode("probe").alias("h"), F.lit(False)).where("h IS NOT NULL"))
    sizes = (entries.groupBy("h").agg(F.count("*").alias("size"), F.max("indexed").alias("hit"))
             .where("size > 1 AND hit").select("h", "size"))
    sizes = stored(sizes, "entries")
    crowd = maybe_in(entries, bitmap_of(sizes, "h"), "h").join(sizes, "h")
    crowd = stored(crowd, "crowd")
    # the texts of lines that have a candidate, each fetched once from its first place
    wanted = crowd.select("key", "first").distinct()
    texts = (maybe_in(_lines(docs).where(F.length("line") >= min_chars).withColumn("at", F.struct("i", "th", "pos")),
                      bitmap_of(wanted, "first.pos", "first.i", "first.th"), "pos", "i", "th")
             .join(wanted.withColumnRenamed("first", "at"), "at").select("key", "at", "line").distinct())
    texts = stored(texts, "texts")

    crowded = crowd.where(F.col("size") > cell_pairs).select("key").distinct().withColumn("crowded", F.lit(True))
    if threshold != 1:
        crowded = crowded.limit(0)
    entry = (crowd.where(F.lit(threshold != 1) | (F.col("size") <= cell_pairs))
             .join(crowded, "key", "left").na.fill(False, ["crowded"]))
    left, right = entry.alias("x"), entry.where("indexed").alias("y")
    pairs = (left.join(right, (F.col("x.h") == F.col("y.h")) & (F.col("x.key") != F.col("y.key"))
                       & (~F.col("x.indexed") | (F.col("x.key") < F.col("y.key")))
                       & ~(F.col("x.crowded") & F.col("y.crowded")))
             .select(F.least("x.key", "y.key").alias("p"), F.greatest("x.key", "y.key").alias("q")).distinct())
    p, q = (texts.select(F.col("key").alias(n), F.col("line").alias(f"{n}_line"), F.col("at").alias(f"{n}_at"))
            for n in "pq")
    near = pairs.join(p, "p").join(q, "q").where(within("p_line", "q_line", threshold))
    near = stored(near.select("p", "q", "p_at", "q_at"), "near")
    found = near.select(F.col("p").alias("key"), F.lit(1).cast("long").alias("links"), F.col("q_at").alias("earlier")).union(
        near.select("q", F.lit(1).cast("long"), "p_at"))
    if threshold == 1:
        found = found.union(_by_deletions(texts.join(crowded, "key")))
    return found.groupBy("key").agg(F.sum("links").alias("links"), F.min("earlier").alias("earlier"))


def _by_deletions(texts: DataFrame) -> DataFrame:
    """Links within one edit among many lines that share a segment, without comparing pairs.

    Lines of one length differ in one character exactly if they are equal without the character at some place;
    a line is one character shorter exactly if it equals another line without one of its characters. So every
    line is grouped under each of its deletions and, for the second case, under itself.
    """
    line = F.col("line")
    cut = F.transform(F.sequence(F.lit(1), F.length("line")), lambda i: F.struct(
        i.alias("place"), F.sha2(F.concat(F.substring(line, F.lit(1), i - 1), F.substring(line, i + 1, F.length(line))),
                                 256).alias("rest")))
    shorter = texts.select("key", "at", F.explode(cut).alias("c")).select("key", "at", "c.place", "c.rest")
    groups = (shorter.groupBy("place", "rest")
              .agg(F.count("*").alias("n"), F.min("at").alias("least")).where("n > 1"))
    replaced = shorter.join(groups, ["place", "rest"]).select(
        "key", (F.col("n") - 1).alias("links"), F.when(F.col("least") < F.col("at"), F.col("least")).alias("earlier"))
    whole = texts.select(F.col("key").alias("whole"), F.col("at").alias("whole_at"), F.sha2("line", 256).alias("rest"))
    cuts = shorter.join(whole, "rest").select("key", "at", "whole", "whole_at").distinct()
    one = F.lit(1).cast("long")
    return (replaced.union(cuts.select("key", one, "whole_at")).union(cuts.select("whole", one, "at")))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
         threshold: int = THRESHOLD, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """Lines to remove: i, th (hash of the text), pos, equal, links.

    A line with a word goes if an equal one stands earlier, and one of at least ``min_chars`` characters if another
    such line within ``threshold`` edits does; earlier means a smaller (id, hash of text, place), a null id first. ``equal`` tells which, ``links``
    counts the other distinct lines within the threshold. Lines that stay are returned too if they have links.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where("t IS NOT NULL")
    occurrences, distinct = line_table(rows, min_chars, threshold)
    linked = line_links(rows, distinct, min_chars, threshold, cell_pairs)
    matter = (distinct.select("key", "first", "n").join(linked, "key", "left")
              .where("n > 1 OR links IS NOT NULL"))
    matter = stored(matter, "matter")
    at = F.struct("i", "th", "pos")
    return (maybe_in(occurrences, bitmap_of(matter, "key"), "key").join(matter, "key")
            .select("i", "th", "pos", (at != F.col("first")).alias("equal"),
                    F.coalesce("links", F.lit(0)).alias("links"),
                    ((at != F.col("first")) | F.coalesce(F.col("earlier") < F.col("first"), F.lit(False))).alias("goes"))
            .distinct())


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with all columns, their text without the lines that ``find`` says go, and counts of lines.

    Added are ``lines_equal`` and ``lines_near``, the removed lines, and ``line_links``; where ``docs`` has such
    a column, the new one gets a leading underscore. Null and empty texts stay as they are; a text all of whose
    lines go becomes empty. Rows with the same id and text get the same result. Documents without a removed or
    linked line pass without a shuffle.
    """
    equal, near, links = (fresh(docs, n) for n in ("lines_equal", "lines_near", "line_links"))
    own, of, i, th, gone = (fresh(docs, n) for n in ("_own", "_of", "_line_i", "_line_th", "_line_gone"))
    found = stored(find(docs, id_col, text_col, **options), "found")
    per_text = found.groupBy("i", "th").agg(
        F.collect_list(F.when(F.col("goes"), F.col("pos"))).alias(gone),
        F.sum((F.col("goes") & F.col("equal")).cast("long")).alias(equal),
        F.sum((F.col("goes") & ~F.col("equal")).cast("long")).alias(near),
        F.sum("links").alias(links)).withColumnsRenamed({"i": i, "th": th})
    named = docs.withColumns({own: F.col(id_col), of: F.xxhash64(F.col(text_col).cast("string"))})
    marked, others = split_by(named, bitmap_of(per_text, i, th), own, of)
    joined = marked.join(per_text, F.col(own).eqNullSafe(F.col(i)) & (F.col(of) == F.col(th)), "left")
    lines, none = F.split(F.col(text_col), "\n"), F.array().cast("array<int>")
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce(gone, none))
    # the split lines are bound once; see within()
    text = F.get(F.transform(F.array(lines), lambda all_lines: F.array_join(
        F.transform(keep, lambda at: F.get(all_lines, at)), "\n")), F.lit(0))
    text = F.when(F.size(F.coalesce(gone, none)) > 0, text).otherwise(F.col(text_col))
    zero = F.lit(0).cast("long")

    def shaped(rows: DataFrame, text: Column, *counts: Column) -> DataFrame:
        return rows.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns],
                           *[F.coalesce(c, zero).alias(n) for c, n in zip(counts, (equal, near, links), strict=True)])

    return shaped(joined, text, F.col(equal), F.col(near), F.col(links)).union(
        shaped(others, F.col(text_col), zero, zero, zero))
