"""Vectorised 64-bit hashes of words, word shingles and byte windows.

All hashes come from prefix sums of a polynomial over random byte values, modulo 2**64, finished by a mixing step.
A hash depends on the hashed bytes only, never on where they stand.
"""

import numpy as np

_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_BYTES = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Texts are hashed in stretches of so many bytes, cut at white space.
STRETCH = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWERED = _BYTES[_LOWER]

_powers = {}


def _power(base, n):
    """base**0 .. base**(n-1) modulo 2**64, grown on demand."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, STRETCH + 1024), base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        _powers[base] = known
    return known[:n]


def mix(x):
    """Finish a hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data):
    """Hashes and start offsets of the words of a byte array, A-Z lower-cased."""
    space = _SPACE[data]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWERED[data] * _power(_BASE, len(data)), out=sums[1:])
    value = (sums[ends] - sums[starts]) * _power(_INVERSE, len(data) + 1)[starts]
    return mix(value + (ends - starts).astype(np.uint64) * _FACTORS[63]), starts


def words_of(texts):
    """For each text (None: empty) the uint64 hashes of its words, in order."""
    out, group, size = [None] * len(texts), [], 0

    def flush():
        if group:
            data = np.frombuffer(b"\n".join(b for _, b in group) + b"\n", np.uint8)
            hashes, starts = _word_hashes(data)
            cuts = np.searchsorted(starts, np.cumsum([len(b) + 1 for _, b in group])[:-1])
            for (i, _), part in zip(group, np.split(hashes, cuts)):
                out[i] = part
            group.clear()

    for i, text in enumerate(texts):
        raw = (text or "").encode()
        if len(raw) > STRETCH:
            parts, at = [], 0
            while at < len(raw):
                end = at + STRETCH
                while end < len(raw) and not _SPACE[raw[end]]:
                    end += 1
                parts.append(_word_hashes(np.frombuffer(raw[at:end], np.uint8))[0])
                at = end
            out[i] = np.concatenate(parts)
            continue
        if size + len(raw) > STRETCH:
            flush()
            size = 0
        group.append((i, raw))
        size += len(raw) + 1
    flush()
    return out


def shingles(words, n):
    """Hashes of all runs of ``n`` words; a shorter, non-empty sequence counts as one run."""
    if len(words) == 0:
        return words
    n = min(n, len(words))
    total = np.full(len(words) - n + 1, n, np.uint64) * _FACTORS[62]
    for k in range(n):
        total += words[k:len(words) - n + 1 + k] * _FACTORS[k]
    return mix(total)


def shingle_sets(texts, n):
    """For each text the sorted distinct shingle hashes."""
    return [np.unique(shingles(w, n)) for w in words_of(texts)]


def run_values(values, starts, ends):
    """Hashes of the stretches values[start:end]; equal stretches have equal hashes wherever they stand."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values) * _power(_BASE, len(values)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(values) + 1)[starts] + (ends - starts).astype(np.uint64))


def window_hashes(raw, width):
    """Hashes of all windows of ``width`` bytes; a shorter, non-empty text is one window."""
    if not raw:
        return np.empty(0, np.uint64)
    width = min(width, len(raw))
    parts, at = [], 0
    while at + width <= len(raw):
        data = np.frombuffer(raw[at:at + STRETCH + width - 1], np.uint8)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * _power(_BASE, len(data)), out=sums[1:])
        count = len(data) - width + 1
        parts.append(mix((sums[width:] - sums[:count]) * _power(_INVERSE, count) + np.uint64(width)))
        at += STRETCH
    return np.concatenate(parts)
