"""Document fingerprints: a threshold-scaled sketch of byte shingles, mergeable and good for containment."""

import base64
import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from accesslens.llm.common import pieces
from accesslens.llm.texthash import window_hashes

WIDTH, SCALE = 16, 16
#: A text of at most so many windows keeps all hashes: a sixteenth of so few would say little, or nothing.
WHOLE = 512
#: At most so many parts, whose ends the driver holds.
MAX_PARTS = 20_000
_LEAST = -(1 << 63)


def sketch(text, width=WIDTH, scale=SCALE):
    """The scale of the text, then its sorted distinct hashes (32 bits) below 2**32 / scale of all byte windows.

    Two fixed fractions: all hashes of texts of up to ``WHOLE`` windows, one in ``scale`` of longer ones. A text shorter
    than a window is one window as a whole. An empty text has no hashes.
    """
    data = (text or "").encode()
    if len(data) < width:
        found = np.frombuffer(hashlib.blake2b(data, digest_size=4).digest(), "<u4") if data else np.empty(0, np.uint32)
        return np.concatenate([np.array([1], np.uint32), found.astype(np.uint32)])
    own = 1 if len(data) - width + 1 <= WHOLE else scale
    hashes = window_hashes(data, width) >> np.uint64(32)
    return np.concatenate([np.array([own], np.uint32), np.unique(hashes[hashes < (1 << 32) // own]).astype(np.uint32)])


def to_text(hashes):
    return base64.b64encode(hashes.astype("<u4").tobytes()).decode()


def from_text(fingerprint):
    return np.frombuffer(base64.b64decode(fingerprint or ""), "<u4")


def _aligned(a, b):
    """The hashes of both sketches under the threshold that both hold, and its scale."""
    scale = max(int(a[0]) if len(a) else 1, int(b[0]) if len(b) else 1)
    limit = (1 << 32) // scale
    return a[1:][a[1:] < limit], b[1:][b[1:] < limit], scale


def merge(a, b):
    """The sketch of both documents together."""
    x, y, scale = _aligned(a, b)
    return np.concatenate([np.array([scale], np.uint32), np.union1d(x, y).astype(np.uint32)])


def resemblance(a, b):
    """Estimated Jaccard likeness, exact between short texts. Two empty texts are alike; a text without a hash under the
    other's threshold is like it only if both are equal."""
    x, y, _ = _aligned(a, b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    union = len(x) + len(y) - both
    return both / union if union else float(np.array_equal(a, b))


def containment(a, b):
    """Estimated share of a's shingles that b has; an empty text is contained in any.

    Where no hash of a is under b's threshold, the share is unknown: 1 for equal sketches, else 0.
    """
    x, y, _ = _aligned(a, b)
    if len(x):
        return len(np.intersect1d(x, y, assume_unique=True)) / len(x)
    return 1.0 if len(a) <= 1 else float(np.array_equal(a, b))


def fingerprints(docs, id_col="doc_id", text_col="text", width=WIDTH, scale=SCALE):
    """(doc_id, n_chars, fingerprint) of every row over its whole text; a null text counts as empty, its sketch too.

    Every shingle hash below 1/scale of the hash range is kept (all of a short text), so sketches of texts of any length
    compare and merge.
    """
    def run(batches):
        for ids, texts in pieces(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(t or "") for t in texts], pa.int64()),
                 pa.array([to_text(sketch(t, width, scale)) for t in texts])],
                names=["doc_id", "n_chars", "fingerprint"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, n_chars long, fingerprint string"))


def _compare(measure):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([measure(from_text(x), from_text(y)) for x, y in zip(a, b)])
    return run


def containment_column(a, b):
    """Column: share of fingerprint ``a`` found in fingerprint ``b``."""
    return _compare(containment)(a, b)


def resemblance_column(a, b):
    return _compare(resemblance)(a, b)


def in_descending_order(docs, id_col="doc_id", text_col="text", rows_per_part=4000):
    """The rows of ``docs`` as (part, ahead, key, doc_id, text), each part sorted by descending id (nulls last, then text).

    Parts are ranges of ids whose upper ends are ids that occur (at most ``MAX_PARTS`` numbers on the driver; rows of a
    part are streamed, so its size does not bound memory). The first row of each part also goes, marked ``ahead``, to the end of the part before it, and the very
    first to the last part: so the successor of every row lies in its part and the texts are shuffled once.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("key"),
                       F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = max(1, min(MAX_PARTS, math.ceil(rows.count() / rows_per_part)))
    ends = rows.agg(F.percentile_approx("key", [(k + 1) / parts for k in range(parts)],
                                        max(10_000, 10 * parts)).alias("ends"), F.max("key").alias("top")).first()
    heads = np.array(sorted({*(ends["ends"] or []), ends["top"] if ends["top"] is not None else 0}), np.int64)

    @F.pandas_udf("array<int>")
    def places(key: pd.Series) -> pd.Series:
        last = len(heads) - 1
        at = np.searchsorted(heads, key.to_numpy(np.int64))
        # heads ascend, so part ``last - k`` is the k-th from the top.
        return pd.Series([[last - k, (last - k - 1) % len(heads)] if heads[k] == v else [last - k]
                          for k, v in zip(at.tolist(), key.tolist())])

    copies = rows.select("*", F.posexplode(places("key")).alias("_copy", "part"))
    return (copies.select("part", (F.col("_copy") == 1).alias("ahead"), "key", "doc_id", "text")
            .repartition("part").sortWithinPartitions("part", "ahead", F.desc("key"), "text"))


def edited(text, following):
    """``text`` with its last third (floor) replaced by the first as many characters of the following text, or all of it."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


def fingerprints_with_edits(docs, id_col="doc_id", text_col="text"):
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and
    contained_edited: the share of the document's shingles that the edited text still has.

    The next document is the one with the next smaller id (after the last: the first; repeated ids by text; null ids
    last). A single row follows itself. An empty input gives an empty result.
    """
    def run(batches):
        waiting = done = None
        for parts, aheads, _, ids, texts in pieces(batches, 4):
            rows = []
            for part, ahead, doc_id, text in zip(parts, aheads, ids, texts):
                if ahead and done == part:
                    continue
                text = text or ""
                own = sketch(text)
                if waiting is not None and waiting[0] == part:
                    _, wid, wtext, wown = waiting
                    changed = edited(wtext, text)
                    other = sketch(changed)
                    rows.append((wid, len(wtext), hashlib.sha256(changed.encode()).hexdigest(), to_text(wown),
                                 to_text(other), resemblance(wown, other), resemblance(wown, own), containment(wown, other)))
                if ahead:
                    waiting, done = None, part
                else:
                    waiting = (part, doc_id, text, own)
            columns = list(zip(*rows)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(),
                                                          pa.float64(), pa.float64(), pa.float64()))],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
                       "near_next", "contained_edited"])

    return in_descending_order(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double, contained_edited double")
