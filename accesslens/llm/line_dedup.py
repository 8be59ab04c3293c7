"""Line dedup by pairwise alignment: patience diff against earlier documents that share rare line hashes."""

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from accesslens.llm.common import pieces, stored
from accesslens.llm.texthash import run_values

#: Words that a block of lines must have to be deleted; fewer occur by chance.
LEAST_WORDS = 8
_LAST = (1 << 63) - 1


def line_hash(line):
    return int.from_bytes(hashlib.blake2b(line.encode(), digest_size=8).digest(), "little", signed=True)


def run_hashes(lines, words, least):
    """(hashes, starts): for each line with words, the hash of the shortest run from it that has ``least`` words."""
    lines, words = np.asarray(lines, np.int64).view(np.uint64), np.asarray(words, np.int64)
    sums = np.concatenate(([0], np.cumsum(words)))
    ends = np.searchsorted(sums, sums[:-1] + least)
    starts = np.flatnonzero((words > 0) & (ends <= len(lines)))
    return run_values(lines, starts, ends[starts]).view(np.int64), starts


def _rising(pairs):
    """The longest subsequence of pairs (sorted by their first number) whose second numbers rise."""
    tails, at, back = [], [], []
    for k, (_, j) in enumerate(pairs):
        p = bisect.bisect_left(tails, j)
        back.append(at[p - 1] if p else -1)
        if p == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[p], at[p] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _numbered(seq, low, high, once):
    """Position of each line in the stretch: of those that occur once, or of every occurrence under its number."""
    seen = {}
    for i in range(low, high):
        seen.setdefault(seq[i], []).append(i)
    if once:
        return {line: at[0] for line, at in seen.items() if len(at) == 1}
    return {(line, n): i for line, at in seen.items() for n, i in enumerate(at)}


def patience(a, b):
    """Matched positions (i, j), a[i] == b[j], rising in both.

    Equal ends are matched, then the lines that occur once in either stretch are anchors (their longest rising
    subsequence), and the stretches between anchors are treated alike. Without such lines, equal lines are matched
    by the number of their occurrence.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, ie, j, je = todo.pop()
        while i < ie and j < je and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < ie and j < je and a[ie - 1] == b[je - 1]:
            ie, je = ie - 1, je - 1
            out.append((ie, je))
        if i == ie or j == je:
            continue
        for once in (True, False):
            left, right = _numbered(a, i, ie, once), _numbered(b, j, je, once)
            anchors = _rising(sorted((p, right[line]) for line, p in left.items() if line in right))
            if anchors and not once:
                out += anchors
            if anchors:
                break
        else:
            continue
        if once:
            for p, q in anchors:
                todo.append((i, p, j, q))
                out.append((p, q))
                i, j = p + 1, q + 1
            todo.append((i, ie, j, je))
    return sorted(out)


def _blocks(matched, sums, least, at=0):
    """Stretches (start, end) of consecutive matched lines with ``least`` words; ``sums``: words before each line."""
    out, start = [], None
    for k, (i, j) in enumerate(matched):
        if start is None:
            start = j
        if k + 1 == len(matched) or matched[k + 1] != (i + 1, j + 1):
            if sums[at + j + 1] - sums[at + start] >= least:
                out.append((at + start, at + j + 1))
            start = None
    return out


def _open_stretches(b, taken, follows, sums, least):
    """Maximal stretches of lines not taken whose every neighbouring pair stands in the earlier document as well."""
    out, start = [], None
    for j in range(len(b) + 1):
        if start is not None and (j == len(b) or taken[j] or b[j] not in follows.get(b[j - 1], ())):
            if sums[j] - sums[start] >= least:
                out.append((start, j))
            start = None
        if start is None and j < len(b) and not taken[j] and b[j] in follows:
            start = j
    return out


def common_blocks(a, b, b_words, least=LEAST_WORDS):
    """Stretches (start, end) of ``b`` to delete: the aligned blocks of ``least`` words.

    The first patience alignment gives the blocks in common order. Blocks that moved, or that ``b`` repeats, lie across
    it: what is left and could be one (every neighbouring pair of lines stands in ``a``) is aligned once more with the
    parts of ``a`` that agree with it around its rarest line. The longest block goes, and both sides of it, or of the
    line if it stands in no block, are treated alike.
    """
    if a == b:
        return [(0, len(b))]
    sums = np.concatenate(([0], np.cumsum(b_words))).tolist()
    out = _blocks(patience(a, b), sums, least)
    taken = np.zeros(len(b) + 1, bool)
    for s, e in out:
        taken[s:e] = True
    follows, where = {}, {}
    for i, line in enumerate(a):
        where.setdefault(line, []).append(i)
        follows.setdefault(line, set()).update(a[i + 1:i + 2])
    todo = _open_stretches(b, taken, follows, sums, least)
    while todo:
        low, high = todo.pop()
        rare = min(range(low, high), key=lambda j: len(where[b[j]]))
        best = None
        for p in where[b[rare]]:
            s, e = rare, rare + 1
            while s > low and p - (rare - s) > 0 and a[p - (rare - s) - 1] == b[s - 1]:
                s -= 1
            while e < high and p + (e - rare) < len(a) and a[p + (e - rare)] == b[e]:
                e += 1
            if sums[e] - sums[s] >= least and (best is None or e - s > best[1] - best[0]):
                best = next(iter(_blocks(patience(a[p - (rare - s):p + (e - rare)], b[s:e]), sums, least, s)), best)
        if best is not None:
            out.append(best)
        s, e = best or (rare, rare + 1)
        todo += [(x, y) for x, y in ((low, s), (e, high)) if sums[y] - sums[x] >= least]
    return out


def _keyed(docs, id_col, text_col):
    """Documents named by (k1: id, null last; k2: hash of the text), which also orders them."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("k1"),
                       F.xxhash64(F.col(text_col)).alias("k2"), F.col(text_col).alias("text"))


def removed_blocks(docs, id_col="doc_id", text_col="text", least=LEAST_WORDS):
    """(k1, k2, blocks: array of (start, end) line numbers) of the documents that lose lines.

    A line run of ``least`` words is a line hash rare enough to mean something. Its first document (by id, then text
    hash) is paired with every other that has it: pairs grow with the lines, not with the square of a group of copies.
    Each pair is aligned by its line hashes; texts are not shuffled. Whatever a later document loses stands in an
    earlier one, and the first document that has a line keeps it.
    """
    def hashed(batches):
        for k1, k2, texts in pieces(batches, 2):
            lines = [[x.rstrip() for x in (t or "").split("\n")] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                 pa.array([[line_hash(x) for x in d] for d in lines], pa.list_(pa.int64())),
                 pa.array([[len(x.split()) for x in d] for d in lines], pa.list_(pa.int32()))],
                names=["k1", "k2", "lines", "words"])

    def runs(batches):
        for batch in batches:
            k1, k2, lines, words = (c.to_pylist() for c in batch.columns)
            found = [np.unique(run_hashes(x, w, least)[0]) for x, w in zip(lines, words)]
            n = [len(f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([*found, np.empty(0, np.int64)])), pa.array(np.repeat(k1, n).astype(np.int64)),
                 pa.array(np.repeat(k2, n).astype(np.int64))], names=["run", "k1", "k2"])

    def aligned(batches):
        for batch in batches:
            k1, k2, a, b, bw = (c.to_pylist() for c in batch.columns)
            blocks = [common_blocks(*x, least) for x in zip(a, b, bw)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                 pa.array([[{"start": s, "end": e} for s, e in x] for x in blocks],
                          pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=["k1", "k2", "blocks"])

    block = "array<struct<start:int,end:int>>"
    lines = stored(_keyed(docs, id_col, text_col).mapInArrow(
        hashed, "k1 long, k2 long, lines array<long>, words array<int>"), "line-hashes")
    rows = stored(lines.mapInArrow(runs, "run long, k1 long, k2 long"), "line-runs")
    first = (rows.groupBy("run").agg(F.min(F.struct("k1", "k2")).alias("f"), F.max(F.struct("k1", "k2")).alias("l"))
             .where("f <> l").select("run", F.col("f.k1").alias("a1"), F.col("f.k2").alias("a2")))
    pairs = stored(rows.join(first, "run").where("k1 <> a1 or k2 <> a2").select("a1", "a2", "k1", "k2").distinct(),
                   "line-pairs")
    single = lines.dropDuplicates(["k1", "k2"])
    earlier = single.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("lines").alias("a"))
    found = (pairs.join(earlier, ["a1", "a2"]).join(single, ["k1", "k2"])
             .select("k1", "k2", "a", "lines", "words")
             .mapInArrow(aligned, f"k1 long, k2 long, blocks {block}"))
    return found.where(F.size("blocks") > 0).groupBy("k1", "k2").agg(F.flatten(F.collect_list("blocks")).alias("blocks"))


def dedup_lines(docs, id_col="doc_id", text_col="text", least=LEAST_WORDS):
    """The columns of ``docs``, the text without its repeated blocks, and ``removed_lines`` (long).

    Lines are compared without trailing white space. Rows equal in id and text count as one document and get the same
    text; documents with equal ids are ordered by text hash; null ids come last. A null text stays null. A later exact
    copy becomes an empty text. Input columns whose names begin with an underscore are reserved; an input column
    ``removed_lines`` is replaced. An empty input gives an empty result.
    """
    gone = stored(removed_blocks(docs, id_col, text_col, least), "line-blocks").select(
        F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("blocks").alias("_blocks"))
    rows = docs.drop("removed_lines").withColumns({
        "_k1": F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)), "_k2": F.xxhash64(F.col(text_col))})
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.exists("_blocks", lambda s: (i >= s["start"]) & (i < s["end"])))
    out = rows.join(gone, ["_k1", "_k2"], "left").withColumn("_kept", F.when(F.col("_blocks").isNotNull(), kept))
    return (out.withColumn("removed_lines", F.coalesce(F.size(lines) - F.size("_kept"), F.lit(0)).cast("long"))
            .withColumn(text_col, F.when(F.col("_kept").isNull(), F.col(text_col)).otherwise(F.array_join("_kept", "\n")))
            .select(*[c for c in docs.columns if c != "removed_lines"], "removed_lines"))
