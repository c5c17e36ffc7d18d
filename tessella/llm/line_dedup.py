"""Line dedup by pairwise alignment.

Lines are hashed with the white space around them off. Of the documents with the same lines in the same order all but those of the least
id lose them all; only the others are aligned. What a document can lose at all are its runs of lines that an earlier document has too: the
shortest runs of at least LEAST_WORDS words, from each line on and back from each line, since every block is made of such runs. Each
document is first aligned with the first document of each of its runs. Where a run isn't lost by then, the other earlier documents that
have it follow in rounds, an expected PARTNERS of them, then GROWTH times as many, until the run is lost or all have been tried. So what
goes is what alignment with all earlier documents gives; frequent lines take few pairs, but for runs that no alignment takes.

Each pair is aligned by patience diff: common ends are matched, then lines that occur once in both, in their longest
increasing order, then what lies between them; where no line occurs once in both, a longest common subsequence. From the document with the greater id the matched blocks go, runs of lines that follow
each other in both documents, if they hold at least LEAST_WORDS words. Deletions are judged on the input.

Rows: null and empty texts have no lines; a row with a null id is kept whole and no pair has it; rows of equal id and text are judged
alike, and rows of equal id make no pair; other columns are ignored or, in `without_repeats`, kept; an empty table gives no rows. A text
of any length is aligned whole; where two texts share no unique line, the alignment's memory is the product of their repeated lines in bits.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut, mapped

LEAST_WORDS = 5  # of a block that goes
PARTNERS, GROWTH = 4, 8


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first, whose second numbers increase."""
    tails, ends, back = [], [], [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        back[k] = ends[at - 1] if at else -1
        tails[at : at + 1], ends[at : at + 1] = [j], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places of a longest common subsequence. A row of its table is one number: the bit of a place of b is 0 where the length grows."""
    in_a, in_b = set(a), set(b)
    rows, cols = [k for k, x in enumerate(a) if x in in_b], [k for k, x in enumerate(b) if x in in_a]
    at, every = Counter(), (1 << len(cols)) - 1
    for k, j in enumerate(cols):
        at[b[j]] |= 1 << k
    table = [every]
    for i in rows:
        v = table[-1]
        u = v & at[a[i]]
        table.append((v + u | v - u) & every)
    out, r, c = [], len(rows), len(cols)
    while r and c:
        if a[rows[r - 1]] == b[cols[c - 1]]:  # equal ends may always be matched, so blocks stay together
            r, c = r - 1, c - 1
            out.append((rows[r], cols[c]))
        elif table[r] >> (c - 1) & 1:
            c -= 1
        else:
            r -= 1
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places of two lists of line hashes, in order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        times_a, times_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        where = {b[k]: k for k in range(j, j_end) if times_b[b[k]] == 1}
        anchors = increasing([(k, where[a[k]]) for k in range(i, i_end) if times_a[a[k]] == 1 and a[k] in where])
        if anchors:
            out += anchors
            for (p, q), (r, s) in zip([(i - 1, j - 1), *anchors], [*anchors, (i_end, j_end)], strict=True):
                todo.append((p + 1, r, q + 1, s))
        else:
            out += [(i + p, j + q) for p, q in common(a[i:i_end], b[j:j_end])]
    return sorted(out)


def doomed(a: list[int], b: list[int], n_words: list[int], least_words: int = LEAST_WORDS) -> list[int]:
    """Places in b of the matched blocks that are long enough. n_words: of b's lines."""
    out, block, last = [], [], (-2, -2)
    for i, j in [*patience(a, b), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(n_words[k] for k in block) >= least_words:
                out += block
            block = []
        block.append(j)
        last = (i, j)
    return out


def runs(n_words: list[int], least_words: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """[first, end) of the shortest runs of at least least_words words from each line on and back from each line."""
    total = [0, *accumulate(n_words)]
    out = set()
    for k in range(len(n_words)):
        end = bisect_left(total, total[k] + least_words)
        if end < len(total):
            out.add((k, end))
        first = bisect_right(total, total[k + 1] - least_words) - 1
        if first >= 0:
            out.add((first, k + 1))
    return sorted(out)


def lines(text_col: str) -> Column:
    return F.split(F.col(text_col), "\n")


def repeats(df: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    """(id, t, gone): the places of the lines that go from each document that loses any; t is the text's hash."""
    own = lambda x: F.xxhash64(F.btrim(x, F.lit(" \t\r\x0b\x0c")))
    word_count = lambda x: F.size(F.filter(F.split(x, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    docs = df.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"), F.transform(lines(text_col), own).alias("hashes"), F.transform(lines(text_col), word_count).alias("n_words"))
    docs = docs.distinct().withColumn("s", F.xxhash64("hashes"))
    docs = cut(docs)
    least = docs.groupBy("s").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    several = cut(least.where("least <> most"))
    same = docs.select("id", "t", "s", "n_words").join(several, "s").where("id > least")
    whole = same.where(F.aggregate("n_words", F.lit(0), lambda x, n: x + n) >= least_words).select("id", "t", F.sequence(F.lit(0), F.size("n_words") - 1).alias("gone"))
    docs = cut(docs.join(same.select("id", "t"), ["id", "t"], "left_anti"))  # written, so that Spark can split the joins below

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, out = [], []
            for k, (x, n) in enumerate(zip(batch.column("hashes").to_pylist(), batch.column("n_words").to_pylist(), strict=True)):
                x = np.array(x, np.int64)
                found = [(xxhash.xxh3_64_intdigest(x[i:j].tobytes()) - (1 << 63), i, j) for i, j in runs(n, least_words)]
                of += [k] * len(found)
                out += found
            own = [batch.column(c).take(pa.array(of, pa.int64())) for c in ("id", "t")]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array([r[c] for r in out], ty) for c, ty in enumerate((pa.int64(), pa.int32(), pa.int32())))], names=["id", "t", "h", "first", "end"])

    each = cut(mapped(docs.select("id", "t", "hashes", "n_words"), keyed, "id long, t long, h long, first int, end int"))
    shared = each.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("id", "t")).alias("least"), F.max("id").alias("last_id")).where("least.id <> last_id").drop("last_id")
    having = cut(each.join(cut(shared), "h"))  # the runs that two documents share; `shared` is written, so that Spark can split a frequent one

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [doomed(x, y, n, least_words) for x, y, n in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "n_words")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("b"), batch.column("b_t"), pa.array(out, pa.list_(pa.int32()))], names=["id", "t", "gone"])

    def aligned(pairs: DataFrame) -> DataFrame:
        """(id, t, gone) of b for the pairs (a, a_t, b, b_t)."""
        pairs = pairs.distinct().join(docs.select(F.col("id").alias("a"), F.col("t").alias("a_t"), F.col("hashes").alias("x")), ["a", "a_t"])
        pairs = pairs.join(docs.select(F.col("id").alias("b"), F.col("t").alias("b_t"), F.col("hashes").alias("y"), "n_words"), ["b", "b_t"])
        return mapped(pairs.select("b", "b_t", "x", "y", "n_words"), align, "id long, t long, gone array<int>").where(F.size("gone") > 0)

    def merged(found: DataFrame) -> DataFrame:
        return found.select("id", "t", F.explode("gone").alias("at")).groupBy("id", "t").agg(F.collect_set("at").alias("gone"))

    later = having.where("id <> least.id")
    found = cut(merged(aligned(later.select(F.col("least.id").alias("a"), F.col("least.t").alias("a_t"), F.col("id").alias("b"), F.col("t").alias("b_t")))))
    place = F.pmod(F.xxhash64(F.lit(1), "id", "t"), F.lit(1 << 32)) / F.lit(float(1 << 32))  # the order in which partners are tried
    open_runs, lo, hi = later.where("n > 2"), 0, PARTNERS
    while True:
        rest = open_runs.join(found, ["id", "t"], "left").where(F.col("gone").isNull() | F.exists(F.sequence("first", F.col("end") - 1), lambda k: ~F.array_contains("gone", k))).drop("gone")
        open_runs = cut(rest)
        most = open_runs.agg(F.max("n")).first()[0]
        if most is None:
            break
        wanted = open_runs.select("h").distinct()
        partners = having.where((F.lit(lo) <= place * F.col("n")) & (place * F.col("n") < hi)).join(wanted, "h", "left_semi").select("h", F.col("id").alias("a"), F.col("t").alias("a_t"))
        pairs = open_runs.select("h", F.col("id").alias("b"), F.col("t").alias("b_t"), F.col("least.id").alias("c"), F.col("least.t").alias("c_t")).join(partners, "h").where("a < b and not (a = c and a_t = c_t)")
        found = cut(merged(found.unionByName(aligned(pairs.select("a", "a_t", "b", "b_t")))))
        if most <= hi:
            break
        open_runs, lo, hi = open_runs.where(F.col("n") > hi), hi, hi * GROWTH
    return found.unionByName(whole)


def judged(df: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    """(row, gone, kept): each row as a struct, the places of the lines that go from it (null: none), and its text without them."""
    found = cut(repeats(df, id_col, text_col, least_words))
    given = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"))
    text = F.col(f"row.`{text_col}`")
    left = F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains("gone", i))
    return given.join(found, ["id", "t"], "left").select("row", "gone", F.when(F.col("gone").isNull(), text).otherwise(F.array_join(left, "\n")).alias("kept"))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, n_lines, n_removed, kept_sha256) of every row; an empty text has no lines."""
    out, text = judged(df.select(id_col, text_col), id_col, text_col, least_words), F.col(f"row.`{text_col}`")
    n = F.when(F.length(text) > 0, F.size(F.split(text, "\n"))).otherwise(0)
    return out.select(F.col(f"row.`{id_col}`").cast("long").alias(id_col), n.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """df with the repeated lines taken out of its texts; a document that loses its last word is a repeat as a whole, and goes."""
    out = judged(df, id_col, text_col, least_words).where(F.col("gone").isNull() | F.col("kept").rlike("[^\\x20\\x09-\\x0D]"))
    return out.select(*((F.col("kept") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in df.columns))
