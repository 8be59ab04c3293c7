"""SentencePiece encoding with seeded merge-dropout, and lossless decoding."""

import heapq
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from accesslens.llm.common import pieces
from accesslens.llm.texthash import mix

SPACE = "▁"
#: Dropout patterns that a text piece can take under one seed; each occurrence draws one by keyed hash.
STREAMS = 4
#: Piece encodings that a worker remembers at most; beyond, the memory starts anew. It changes speed only.
REMEMBERED = 1_200_000
#: Longer blank-separated pieces are merged one at a time with a heap instead of many at once in arrays.
LONG = 64
_NONE = np.int32(2**31 - 1)
_models, _known = {}, {}
_CHUNK = re.compile(r" *[^ \n]+|\n| +")
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


class PieceModel:
    """The pieces and scores of a SentencePiece model of merge type, and the table of possible merges."""

    def __init__(self, path):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_of, self.byte_ids, chars, normal = [], {}, {}, []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                normal.append((piece, i))
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
                if len(piece) == 1:
                    chars[piece] = i
        if len(self.byte_ids) < 256:
            raise ValueError("the model has no byte fallback, so not every text can be encoded")
        ids = dict(normal)
        # Characters that occur only inside pieces get numbers of their own, so that they can merge.
        self.extra = {}
        for piece, _ in normal:
            for c in piece:
                if c not in chars:
                    self.extra[n + len(self.extra)] = c
                    chars[c] = ids[c] = n + len(self.extra) - 1
        self.unknown = n + len(self.extra)
        self.size, self.chars, self.pieces = self.unknown + 1, chars, n
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p, _ in normal):
            raise ValueError("pieces that reach over blanks or line ends are not supported")
        best = sorted((-sp.get_score(i), i) for p, i in normal if len(p) > 1)
        self.by_rank = np.array([i for _, i in best], np.int32)
        rank = {i: r for r, (_, i) in enumerate(best)}
        pairs = {ids[p[:k]] * self.size + ids[p[k:]]: rank[i] for p, i in normal for k in range(1, len(p))
                 if p[:k] in ids and p[k:] in ids}
        keys = np.array(sorted(pairs), np.int64)
        self.keys, self.ranks = keys, np.array([pairs[k] for k in keys.tolist()], np.int32)
        table = np.full(0x110000, self.unknown, np.int32)
        for c, i in chars.items():
            table[ord(c)] = i
        self.table = table

    def rank(self, left, right):
        """Rank of the merge of two symbols, _NONE where they do not merge."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def spelled(self, symbols, text, starts, ends):
        """Ids of symbols; those that are no pieces are spelled by the bytes of their text."""
        out = []
        for s, a, b in zip(symbols, starts, ends):
            if s < self.pieces:
                out.append(s)
            else:
                out += [self.byte_ids[v] for v in text[a:b].encode()]
        return out


def _skipped(keys, start, middle, end, rank, dropout):
    """Whether the candidate merge is dropped: its keyed hash, as a fraction, lies below ``dropout``."""
    h = mix(keys + start.astype(np.uint64) * _A + middle.astype(np.uint64) * _B + end.astype(np.uint64) * _C
            + rank.astype(np.uint64) * _D)
    return (h >> np.uint64(11)).astype(float) * 2.0**-53 < dropout


def merge_heap(model, text, key, dropout):
    """The symbols of one text: an agenda of candidate merges by (score, place), each skipped by its keyed hash."""
    n = len(text)
    symbol = model.table[np.array([ord(c) for c in text], np.int64)].tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda, alive, cache = [], [True] * n, {}

    def add(j):
        k = after[j]
        if k < n:
            pair = symbol[j], symbol[k]
            if pair not in cache:
                cache[pair] = int(model.rank(np.array([pair[0]]), np.array([pair[1]]))[0])
            if cache[pair] != _NONE:
                heapq.heappush(agenda, (cache[pair], j, k, after[k]))

    for j in range(n - 1):
        add(j)
    key = np.array([key], np.uint64)
    while agenda:
        r, j, k, e = heapq.heappop(agenda)
        if not alive[j] or after[j] != k or after[k] != e or not alive[k]:
            continue
        if dropout and _skipped(key, np.array([j]), np.array([k]), np.array([e]), np.array([r]), dropout)[0]:
            continue
        symbol[j], after[j], alive[k] = int(model.by_rank[r]), e, False
        if e < n:
            before[e] = j
        add(j)
        if before[j] >= 0:
            add(before[j])
    at = [i for i in range(n) if alive[i]]
    return model.spelled([symbol[i] for i in at], text, at, [after[i] for i in at])


def merge_many(model, texts, keys, dropout):
    """merge_heap for many short texts at once: in each round every text takes the first candidate of its agenda."""
    lengths = np.array([len(t) for t in texts])
    rows, width = len(texts), int(lengths.max())
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    where = np.arange(width)[None, :] < lengths[:, None]
    symbol = np.full((rows, width), model.unknown, np.int32)
    symbol[where] = model.table[codes]
    after = np.tile(np.arange(1, width + 1, dtype=np.int32), (rows, 1))
    before = after - 2
    rank = np.full((rows, width), _NONE, np.int32)
    if width > 1:
        inside = where[:, 1:]
        rank[:, :-1][inside] = model.rank(symbol[:, :-1][inside], symbol[:, 1:][inside])
    alive, open_ = where.copy(), np.arange(rows)
    while len(open_):
        here = rank[open_]
        j = here.argmin(1)
        r = here[np.arange(len(open_)), j]
        go = r != _NONE
        open_, j, r = open_[go], j[go], r[go]
        if not len(open_):
            break
        k = after[open_, j]
        e = after[open_, k]
        skip = _skipped(keys[open_], j, k, e, r, dropout) if dropout else np.zeros(len(open_), bool)
        rank[open_[skip], j[skip]] = _NONE
        row, j, k, e, r = open_[~skip], j[~skip], k[~skip], e[~skip], r[~skip]
        symbol[row, j] = model.by_rank[r]
        after[row, j], alive[row, k], rank[row, k] = e, False, _NONE
        more = e < lengths[row]
        rank[row[~more], j[~more]] = _NONE
        a, b, c = row[more], j[more], e[more]
        before[a, c] = b
        rank[a, b] = model.rank(symbol[a, b], symbol[a, c])
        back = before[row, j]
        more = back >= 0
        a, b, c = row[more], back[more], j[more]
        rank[a, b] = model.rank(symbol[a, b], symbol[a, c])
    flat = symbol[alive]
    ends = np.cumsum(alive.sum(1))
    raw = flat.astype("<i4").tobytes()
    strange = np.zeros(rows, bool)
    strange[np.searchsorted(ends, np.flatnonzero(flat >= model.pieces), side="right")] = True
    out, start = [], 0
    for i, end in enumerate(ends.tolist()):
        if strange[i]:
            at = np.flatnonzero(alive[i])
            ids = model.spelled(symbol[i, at].tolist(), texts[i], at.tolist(), after[i, at].tolist())
            out.append(np.array(ids, "<i4").tobytes())
        else:
            out.append(raw[4 * start:4 * end])
        start = end
    return out


def _encode_new(model, words, stream, seed, dropout):
    """{word: ids as bytes} of pieces under one stream."""
    out, short = {}, []
    base = zlib.crc32(f"{seed}:{stream}".encode()) << 32
    for word in sorted(words, key=len):
        # A literal U+2581 must not decode to a blank, so it is spelled in bytes: U+FFFFF stands for it while merging.
        text = word.replace(SPACE, "\U000fffff").replace(" ", SPACE) if SPACE in word else word.replace(" ", SPACE)
        key = base ^ zlib.crc32(word.encode())
        if len(text) > LONG:
            ids = merge_heap(model, text, key, dropout)
            out[word] = np.array(ids, "<i4").tobytes()
        else:
            short.append((word, text, key))
    step, i = [], 0
    while i < len(short):
        # Words come by length, so the rows of a step are about equally long; a step has some 2**18 cells.
        step = short[i:i + max(1, (1 << 18) // len(short[i][1]))]
        step = step[:max(1, (1 << 18) // len(step[-1][1]))]
        ids = merge_many(model, [s[1] for s in step], np.array([s[2] for s in step], np.uint64), dropout)
        out.update(zip((s[0] for s in step), ids))
        i += len(step)
    if any(SPACE in w for w in words):
        marked = np.array([model.byte_ids[v] for v in "\U000fffff".encode()], "<i4").tobytes()
        real = np.array([model.byte_ids[v] for v in SPACE.encode()], "<i4").tobytes()
        for w in words:
            if SPACE in w:
                out[w] = out[w].replace(marked, real)
    return out


def chunks_of(text):
    """The text with its leading blank, cut where no piece can reach over: before blanks and around line ends."""
    return _CHUNK.findall(" " + text) if text else []


def encode_texts(model, keys, texts, seed, dropout, known):
    """ids (int32 bytes) of each text; ``keys`` (one per text) and the place in the text choose a piece's stream."""
    words = [chunks_of(t) for t in texts]
    sizes = [len(w) for w in words]
    flat = [w for d in words for w in d]
    if not dropout:
        streams = np.zeros(len(flat), np.int64)
    else:
        place = np.concatenate([np.arange(n, dtype=np.uint64) for n in sizes] or [np.empty(0, np.uint64)])
        owner = np.repeat(mix(np.array(keys, np.int64).view(np.uint64) + np.uint64(seed * int(_A) % 2**64)), sizes)
        streams = (mix(owner + place * _B) % np.uint64(STREAMS)).astype(np.int64)
    ids = np.empty(len(flat), object)
    for s in np.unique(streams).tolist():
        at = np.flatnonzero(streams == s)
        mine = [flat[i] for i in at.tolist()]
        cache = known.setdefault(s, {})
        new = set(mine).difference(cache)
        if len(cache) + len(new) > REMEMBERED // STREAMS:
            cache.clear()
            new = set(mine)
        if new:
            cache.update(_encode_new(model, new, s, seed, dropout))
        ids[at] = list(map(cache.__getitem__, mine))
    ids, out, start = ids.tolist(), [], 0
    for n in sizes:
        out.append(b"".join(ids[start:start + n]))
        start += n
    return out


def model_of(path):
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode(docs, path, seed=0, dropout=0.1, id_col="doc_id", text_col="text"):
    """(doc_id, text, ids: array of int) of every row: one segmentation by the model's merges with dropout.

    A candidate merge popped from the agenda is skipped when its keyed hash (seed, stream, piece, places, merge) lies
    below ``dropout``; it is not tried again while its two symbols stay. The stream of each occurrence is drawn by keyed
    hash of seed, id and place, so a text is segmented in varied ways, the same for the same seed, id and text on any
    cluster. Without dropout the result is the model's own. A null or empty text has no ids; null ids count as 0; repeated
    rows repeat; an empty input gives an empty result; other columns are ignored.
    """
    def run(batches):
        model = model_of(path)
        known = _known.setdefault((path, seed, dropout), {})
        for ids, texts in pieces(batches):
            raw = encode_texts(model, [i or 0 for i in ids], [t or "" for t in texts], seed, dropout, known)
            offsets = np.concatenate(([0], np.cumsum([len(r) // 4 for r in raw]))).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(raw), np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), values)],
                names=["doc_id", "text", "ids"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, text string, ids array<int>"))


def decode_column(ids, path):
    """Column: the text of an array of ids, byte for byte; null for null."""
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        table = model_of(path).bytes_of
        # The first piece carries the blank that the encoder put before the text.
        return pd.Series([None if v is None else b"".join(map(table.__getitem__, v.tolist()))[1:].decode() for v in values],
                         dtype=object)
    return run(ids)
