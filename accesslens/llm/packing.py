"""Packing: vector bin packing of token pieces into sequences under limits on tokens, segments and loss-bearing tokens."""

import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from accesslens.llm.common import pieces

#: Blank-separated pieces whose ids a worker remembers at most; beyond, the memory starts anew. It changes speed only.
REMEMBERED = 1_500_000
#: Longer pieces are encoded each time, so the memory of a worker is bounded in bytes as well.
LONGEST = 64
#: Documents in a sequence: limits of ``pack_documents``.
SEGMENTS = 16
#: Texts whose new pieces are encoded together.
TOGETHER = 32
_known, _tokenizers = {}, {}


def tokenizer(path):
    """The tokenizer file, loaded once for each worker."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        one = Tokenizer.from_file(path)
        ids = lambda text: one.encode(text, add_special_tokens=False).ids
        for text in ("two words", "a\nb c\td", "x  y", " lead", "trail "):
            if ids(text) != [i for word in text.replace("\n", " ").replace("\t", " ").split(" ") for i in ids(word)]:
                raise ValueError(f"the tokens of {path} do not end at white space")
        _tokenizers[path] = one
    return _tokenizers[path]


def _encoded(words, path):
    """{word: ids as bytes} of words without ASCII white space, encoded side by side and told apart by offsets."""
    out = {}
    for start in range(0, len(words), 100):
        some = words[start:start + 100]
        e = tokenizer(path).encode(" ".join(some), add_special_tokens=False)
        ids, ends = np.array(e.ids, np.uint32), np.cumsum([len(w) + 1 for w in some])
        cuts = 4 * np.searchsorted(np.fromiter((o[0] for o in e.offsets), np.int64, len(ids)), ends)
        data, low = ids.tobytes(), 0
        for word, high in zip(some, cuts.tolist()):
            out[word], low = data[low:high], high
    return out


def word_ids(texts, path):
    """The ids of each text as little-endian uint32 bytes, for tokenizers whose tokens end at ASCII white space.

    Texts are cut at ASCII white space; each different piece is encoded by the tokenizer once and remembered.
    """
    tokenizer(path)
    known, out = _known.setdefault(path, {"": b""}), []
    for start in range(0, len(texts), TOGETHER):
        words = []
        for text in texts[start:start + TOGETHER]:
            for c in "\n\t\r\v\f":
                if c in text:
                    text = text.replace(c, " ")
            words.append(text.split(" "))
        new = set().union(*words).difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            known[""] = b""
            new = set().union(*words).difference(known)
        known.update(_encoded(list(new), path))
        out += [b"".join(map(known.__getitem__, w)) for w in words]
        for word in new:
            if len(word) > LONGEST:
                del known[word]
    return out


class Packer:
    """Packs items into sequences; a bin is filled by the item with the largest dot product with what it has left.

    An item is (key, start, tokens, loss): ``tokens`` ids of ``key`` from ``start``, of which ``loss`` bear loss. Every
    item adds one segment. Each dimension is scaled by its limit, so the dot product prefers items that use much of what
    is plentiful in the bin. With ``cut``, an item may be cut anywhere (its last ids bear the loss), and a sequence that cannot reach ``tokens`` is cut into lengths that are powers of two, so nothing is padded.
    """

    def __init__(self, tokens=2048, segments=128, loss=2048, cut=True, pool=4096):
        self.limits = np.array([tokens, segments, loss], float)
        self.cut, self.pool = cut, pool
        self.items = []
        self.sequences = []

    def add(self, key, tokens, loss):
        """Take a new item; its whole sequences close at once, the rest waits in the pool."""
        start, top = 0, int(self.limits[0])
        if not self.cut and (tokens > top or loss > self.limits[2]):
            raise ValueError("an item exceeds a limit; pack with cut=True")
        while self.cut and tokens >= top and self._loss(loss, tokens, top) <= self.limits[2] and self.limits[1] >= 1:
            part = self._loss(loss, tokens, top)
            self.sequences.append([(key, start, top, part)])
            start, tokens, loss = start + top, tokens - top, loss - part
        # What still exceeds the limit on loss waits in parts that do not.
        while tokens and loss > self.limits[2]:
            size = max(1, tokens - loss + int(self.limits[2]))
            part = self._loss(loss, tokens, size)
            self.items.append((key, start, size, part))
            start, tokens, loss = start + size, tokens - size, loss - part
        if tokens:
            self.items.append((key, start, tokens, loss))
        if len(self.items) >= self.pool:
            self._pack(self.pool // 2)

    @staticmethod
    def _loss(loss, tokens, part):
        """Loss-bearing ids among the first ``part``: the others come first."""
        return max(0, part - (tokens - loss))

    def finish(self):
        self._pack(0)

    def _pack(self, leave):
        """Close sequences until at most ``leave`` items wait."""
        if len(self.items) <= leave:
            return
        sizes = np.array([(t, 1, x) for _, _, t, x in self.items], float)
        there = np.ones(len(self.items), bool)
        items, open_ = self.items, len(self.items)
        while open_ > leave:
            left, chosen = self.limits.copy(), []
            while open_:
                fits = there & (sizes[:, 0] <= left[0]) & (sizes[:, 1] <= left[1]) & (sizes[:, 2] <= left[2])
                if fits.any():
                    at = int(np.argmax(np.where(fits, sizes @ (left / self.limits ** 2), -1)))
                    chosen.append(items[at])
                    left -= sizes[at]
                    there[at] = False
                    open_ -= 1
                elif self.cut and left[0] >= 1 and left[1] >= 1:
                    # Cut the longest item to the tokens that are left, or to fewer where loss is short.
                    at = int(np.argmax(np.where(there, sizes[:, 0], -1)))
                    key, start, tokens, loss = items[at]
                    size = int(min(left[0], tokens - 1, tokens - loss + left[2]))
                    if size < 1:
                        break
                    part = self._loss(loss, tokens, size)
                    chosen.append((key, start, size, part))
                    items[at] = (key, start + size, tokens - size, loss - part)
                    sizes[at] = tokens - size, 1, loss - part
                    left -= (size, 1, part)
                else:
                    break
                if left[0] < 1:
                    break
            self._close(chosen, int(self.limits[0] - left[0]))
        self.items = [x for x, t in zip(items, there) if t]

    def _close(self, chosen, length):
        if not self.cut or length == self.limits[0]:
            self.sequences.append(chosen)
            return
        chosen = chosen[::-1]
        while length:
            room = 1 << (length.bit_length() - 1)
            length -= room
            sequence = []
            while room:
                key, start, tokens, loss = chosen.pop()
                if tokens > room:
                    part = self._loss(loss, tokens, room)
                    chosen.append((key, start + room, tokens - room, loss - part))
                    tokens, loss = room, part
                sequence.append((key, start, tokens, loss))
                room -= tokens
            self.sequences.append(sequence)


_PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
           "loss_tokens long")


def pack_documents(docs, path, id_col="doc_id", text_col="text", end_id=1, **limits):
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    Each task tokenizes its rows and packs them; a pool of waiting items bounds its memory, and texts are never
    shuffled. The first line of a document is taken as its prompt: its ids (the first id, if the text has one line) bear
    no loss, all others do. A sequence holds at most 2048 ids, ``SEGMENTS`` pieces and 2048 loss-bearing ids; ``limits``
    set others. ``sequence_id`` is the task's number times 2**33 plus a
    count, so it is unique, and a repeated task gives the same rows. A null or empty text is its end id alone; repeated
    rows and null ids are packed like others; an empty input gives an empty result; other columns are ignored.
    """
    def run(batches):
        packer, waiting = Packer(**{"segments": SEGMENTS, **limits}), {}
        number = TaskContext.get().partitionId() << 33
        key = 0

        def out():
            nonlocal number
            rows = []
            for sequence in packer.sequences:
                offset = 0
                for k, start, length, loss in sequence:
                    doc_id, ids, at = waiting[k]
                    ids_crc = zlib.crc32(ids[4 * start:4 * (start + length)])
                    rows.append((doc_id, start, length, ids_crc, len(ids) // 4, number, offset, loss))
                    offset += length
                    waiting[k] = (doc_id, ids, at + length)
                    if 4 * (at + length) == len(ids):
                        del waiting[k]
                number += 1
            packer.sequences.clear()
            columns = list(zip(*rows)) if rows else [[]] * 8
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"])

        end = array("I", [end_id]).tobytes()
        for doc_ids, texts in pieces(batches):
            texts = [t or "" for t in texts]
            whole = word_ids(texts, path)
            prompts = word_ids([t[:t.find("\n") + 1] for t in texts], path)
            for doc_id, ids, prompt in zip(doc_ids, whole, prompts):
                ids += end
                n = len(ids) // 4
                waiting[key] = (doc_id, ids, 0)
                packer.add(key, n, n - max(1, len(prompt) // 4))
                key += 1
            yield out()
        packer.finish()
        yield out()

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, _PIECES))


def pack_examples(examples, id_col, tokens_col, loss_col, **limits):
    """Pack ready examples (id, tokens, loss-bearing tokens) whole: (id, tokens, loss, sequence_id, offset).

    For instruction data: examples are not cut, so sequences may be padded; one that exceeds a limit is an error. Null
    or negative counts count as 0; an example without tokens takes no room and is given no sequence.
    """
    limits = {"cut": False, **limits}

    def run(batches):
        packer, ids, number = Packer(**limits), {}, TaskContext.get().partitionId() << 33
        key = 0

        def out():
            nonlocal number
            rows = []
            for sequence in packer.sequences:
                offset = 0
                for k, _, length, loss in sequence:
                    rows.append((ids.pop(k), length, loss, number, offset))
                    offset += length
                number += 1
            packer.sequences.clear()
            columns = list(zip(*rows)) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                columns, (pa.string(), *[pa.int64()] * 4))], names=["id", "tokens", "loss", "sequence_id", "offset"])

        for batch in batches:
            for one, tokens, loss in zip(*[c.to_pylist() for c in batch.columns]):
                ids[key] = one
                packer.add(key, max(0, tokens or 0), max(0, loss or 0))
                key += 1
            yield out()
        packer.finish()
        yield out()

    return (examples.select(F.col(id_col).cast("string").alias("id"), F.col(tokens_col).cast("long").alias("tokens"),
                            F.col(loss_col).cast("long").alias("loss"))
            .mapInArrow(run, "id string, tokens long, loss long, sequence_id long, offset long"))
