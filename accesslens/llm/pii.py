"""Personal data: base patterns, and terms whose co-occurrence with them in the corpus discloses them."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from accesslens.llm.common import pieces, stored

KINDS = ("email", "ip", "card", "phone")
#: Order of kinds among spans that start together.
_RANK = {k: i for i, k in enumerate((*KINDS, "term"))}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive digits and the look-behind change no match; they keep long digit runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_WORD = re.compile(r"[^\W\d_]+")


def _emails(text):
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append(("email", start, domain.end()))
            last = domain.end()
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def base_spans(text):
    """(kind, start, end) of the base patterns in code points, by start, then kind."""
    out = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            # A part of many digits exceeds 255 unless zeros lead.
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], _RANK[s[0]], s[2]))


def terms_of(text):
    """Distinct lower-case words of letters, three at least."""
    return {w for w in map(str.lower, set(_WORD.findall(text))) if len(w) > 2}


def outside(text, spans):
    """The text with the spans blanked."""
    parts, at = [], 0
    for _, start, end in spans:
        if start > at:
            parts.append(text[at:start])
        at = max(at, end)
    parts.append(text[at:])
    return " ".join(parts)


def _term_counts(docs):
    """(term, kind, n): documents that have the term, and (kind not null) those that hold that kind too, by piece."""
    def run(batches):
        counts = Counter()

        def out():
            keys = list(counts)
            batch = pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                 pa.array(list(counts.values()), pa.int64())], names=["term", "kind", "n"])
            counts.clear()
            return batch

        for (texts,) in pieces(batches, 0):
            for text in texts:
                if not text:
                    continue
                spans = base_spans(text)
                terms = terms_of(outside(text, spans) if spans else text)
                for kind in (None, *{s[0] for s in spans}):
                    counts.update((t, kind) for t in terms)
            if len(counts) > 200_000:       # a full buffer is sent on, nothing is dropped
                yield out()
        yield out()

    return docs.select("text").mapInArrow(run, "term string, kind string, n long") \
        .groupBy("term", "kind").agg(F.sum("n").alias("n"))


def _entities(docs):
    """(term, kind, value): for documents that hold protected values, each of their terms with each value's hash."""
    def run(batches):
        for (texts,) in pieces(batches, 0):
            rows = []
            for text in texts:
                spans = base_spans(text) if text else []
                if spans:
                    terms = sorted(terms_of(outside(text, spans)))
                    # The first value of each kind stands for the document: copies of a text count as one witness.
                    first = {}
                    for kind, start, end in spans:
                        first.setdefault(kind, text[start:end])
                    for kind, value in first.items():
                        digest = int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)
                        rows.append((kind, digest, terms))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.list_(pa.string()))], names=["kind", "value", "terms"])

    return docs.select("text").mapInArrow(run, "kind string, value long, terms array<string>")


def disclosing_terms(docs, threshold=0.8, least_values=20, least_share=0.001):
    """(term, kind, disclosure) of the terms that reveal a kind of protected data.

    Over all documents, disclosure is the pointwise mutual information of term and kind over the kind's information
    content: log2(p(t,k) / (p(t) p(k))) / -log2 p(k), 1 where the term never stands without the kind. A term also
    needs ``least_values`` different protected values, and ``least_share`` of all those of the kind, that occur with
    it, so repeated copies of a document prove nothing. That share bounds the list: with 4 kinds, at most
    4 * (mean distinct terms of a document) / least_share terms, however large the corpus.
    """
    seen = stored(_entities(docs), "pii-entities")
    if seen.isEmpty():
        return seen.select(F.lit("").alias("term"), "kind", F.lit(0.0).alias("disclosure")).limit(0)
    values = seen.groupBy("kind").agg(F.approx_count_distinct("value").alias("all_values"))
    witnesses = (seen.select("kind", "value", F.explode("terms").alias("term"))
                 .groupBy("term", "kind").agg(F.approx_count_distinct("value").alias("values"))
                 .join(F.broadcast(values), "kind")
                 .where(F.col("values") >= F.greatest(F.lit(least_values), F.col("all_values") * least_share)))
    witnesses = stored(witnesses.select("term", "kind"), "pii-witnesses")
    if witnesses.isEmpty():
        return witnesses.withColumn("disclosure", F.lit(0.0))
    total = docs.count()
    counts = stored(_term_counts(docs), "pii-counts")
    kinds = docs.select("text").mapInArrow(_kind_counts, "kind string, n long").groupBy("kind").agg(F.sum("n").alias("nk"))
    joined = (witnesses.join(counts.where("kind is not null").withColumnRenamed("n", "ntk"), ["term", "kind"])
              .join(counts.where("kind is null").select("term", F.col("n").alias("nt")), "term")
              .join(F.broadcast(kinds), "kind"))
    content = -F.log2(F.col("nk") / total)
    shared = F.log2(F.col("ntk") * F.lit(float(total)) / (F.col("nt") * F.col("nk")))
    # A kind that every document holds has no information content: nothing can disclose it further.
    return (joined.where(F.col("nk") < total).select("term", "kind", (shared / content).alias("disclosure"))
            .where(F.col("disclosure") >= threshold))


def _kind_counts(batches):
    counts = Counter()
    for (texts,) in pieces(batches, 0):
        for text in texts:
            counts.update({s[0] for s in base_spans(text)} if text else ())
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                     names=["kind", "n"])


def term_spans(text, spans, disclosing):
    """Spans of the disclosing terms of the kinds that the text holds, outside its base spans."""
    kinds = {s[0] for s in spans}
    if not kinds or not disclosing:
        return []
    out, at, covered = [], 0, 0
    for m in _WORD.finditer(text):
        while at < len(spans) and spans[at][1] < m.end():
            covered = max(covered, spans[at][2])
            at += 1
        if covered <= m.start() and kinds & disclosing.get(m.group().lower(), {}).keys():
            out.append(("term", m.start(), m.end()))
    return out


def sanitised(text, spans, disclosing, remove_at):
    """Base values become [KIND]; a disclosing term is generalised to [KIND] too, or removed from ``remove_at`` on."""
    kinds, parts, at = {s[0] for s in spans}, [], 0
    for kind, start, end in spans:
        if end <= at:
            continue
        parts.append(text[at:max(at, start)])
        if kind == "term":
            revealed = {k: d for k, d in disclosing[text[start:end].lower()].items() if k in kinds}
            best = max(revealed, key=lambda k: (revealed[k], k))
            parts.append("" if revealed[best] >= remove_at else f"[{best.upper()}]")
        else:
            parts.append(f"[{kind.upper()}]")
        at = end
    return "".join(parts) + text[at:]


def detect(docs, id_col="doc_id", text_col="text", threshold=0.8, remove_at=0.95, **options):
    """(doc_id, text, spans: array of (kind, start, end)) of every row; ``text`` is the sanitised text.

    Base spans are always found; terms that disclose a kind (see ``disclosing_terms``) are added in documents that
    hold that kind. A null text counts as empty, has no spans and stays null. Repeated rows repeat; null ids are kept;
    an empty input gives an empty result; other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    disclosing = _collected(source, threshold, options)
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches):
        for ids, texts in pieces(batches):
            clean, found = _cleaned(texts, disclosing, remove_at)
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(clean, pa.string()),
                                              pa.array(spans, pa.list_(span))], names=["doc_id", "text", "spans"])

    return source.mapInArrow(run, "doc_id long, text string, spans array<struct<kind:string,start:int,end:int>>")


def sanitise(docs, text_col="text", threshold=0.8, remove_at=0.95, **options):
    """All rows and columns of ``docs``, the text sanitised as by ``detect``; a null text stays null."""
    disclosing = _collected(docs.select(F.col(text_col).alias("text")), threshold, options)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            clean, _ = _cleaned(batch.column(at).to_pylist(), disclosing, remove_at)
            yield batch.set_column(at, text_col, pa.array(clean, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def _collected(docs, threshold, options):
    """{term: {kind: disclosure}}; see ``disclosing_terms`` for its bound."""
    out = {}
    for row in disclosing_terms(docs, threshold, **options).collect():
        out.setdefault(row["term"], {})[row["kind"]] = row["disclosure"]
    return out


def _cleaned(texts, disclosing, remove_at):
    """The sanitised texts and their spans."""
    clean, found = [], []
    for text in texts:
        spans = base_spans(text) if text else []
        if spans:
            spans = sorted(spans + term_spans(text, spans, disclosing), key=lambda s: (s[1], _RANK[s[0]], s[2]))
            text = sanitised(text, spans, disclosing, remove_at)
        clean.append(text)
        found.append(spans)
    return clean, found
