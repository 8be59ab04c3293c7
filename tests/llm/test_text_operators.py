"""Small cases and brute-force versions of the text operators."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("accesslens.llm.queries")
public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema)


def odd_docs(spark, extra=()):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, None), (3, ""), (None, "a b c d e f g h"), (None, None),
            (4, "  \n\t "), (5, long), (6, long), (1, "other text of a repeated id, mail me@host.org now"), *extra]
    out = docs_of(spark, rows)
    for name in ("score", "label", "n", "spans", "shard", "slot", "statistics", "set_id", "removed_lines", "component"):
        out = out.withColumn(name, F.lit("clash"))
    return out


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def real(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def linked_brute(rows, linked):
    """{index: smallest component index} by union-find over all pairs."""
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if linked(rows[i], rows[j]):
            a, b = sorted((root(i), root(j)))
            up[b] = a
    return [root(i) for i in range(len(rows))]


# --- 1 and 6: trained scores -----------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_trained_scores(spark, name):
    from accesslens.llm.quality import quality_scores
    from accesslens.llm.toxicity import toxicity_scores

    run, label = (toxicity_scores, "toxic") if name == "toxicity" else (quality_scores, "quality")
    # Few documents are toxic: at sf0.01 a handful of them are held out, too few to measure a rate.
    folder = "/root/testdata/sf0.1" if name == "toxicity" else "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = run(spark.read.parquet(f"{folder}/documents.parquet"), labels).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    cut = 0.5 if name == "toxicity" else 0.3
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    held = [(truth[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    if name == "toxicity":
        flagged = [mark for mark, score in held if score >= cut]
        assert sum(flagged) / len(flagged) > 0.95 and sum(flagged) / sum(mark for mark, _ in held) > 0.85
    ones, zeros = [s for y, s in held if y == 1], [s for y, s in held if y == 0]
    if ones and zeros:
        auc = np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])
        assert auc > 0.85


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_trained_scores_edges(spark, name, real):
    from accesslens.llm.quality import keep_good, quality_scores
    from accesslens.llm.toxicity import toxicity_scores

    run = toxicity_scores if name == "toxicity" else quality_scores
    odd = odd_docs(spark)
    for labels in (real[1], real[1].limit(0)):
        rows = run(odd, labels).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
        same = [r["score"] for r in rows if r["doc_id"] in (2, 3)]
        assert same[0] == same[1]                           # null counts as empty
    nulls = spark.createDataFrame([(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in run(odd, nulls).collect()} == {0.5}
    assert run(empty_docs(spark), real[1]).collect() == []
    if name == "quality":
        assert keep_good(odd, nulls).count() == odd.count()
        assert keep_good(empty_docs(spark), real[1]).columns == empty_docs(spark).columns


def test_factorization_machine_learns_pairs():
    """Both terms or none: no linear weights tell these apart, the pairwise weight does."""
    from accesslens.llm.toxicity import FactorizationMachine

    cases = [([], 1), ([0], 0), ([1], 0), ([0, 1], 1)]
    rows = [(np.array(at, np.int64), np.ones(len(at)), y) for at, y in cases] * 200
    model = FactorizationMachine.fit([10, 20], rows, epochs=200)
    assert [model.margin(at, x) > 0 for at, x, _ in rows[:4]] == [bool(y) for _, y in cases]


def test_rules_are_tree_paths(spark):
    from accesslens.llm.quality import RuleEnsemble

    rng = np.random.default_rng(1)
    x = rng.random((400, 3))
    rows = spark.createDataFrame([(int((a > 0.5) and (b > 0.5)), [float(v) for v in (a, b, c)]) for a, b, c in x],
                                 "label int, statistics array<double>")
    model = RuleEnsemble.fit(rows)
    assert any(len(r) > 1 for r in model.rules) and len(model.rules) < 200
    wrong = rows.where((model.score(F.col("statistics")) >= 0.5).cast("int") != F.col("label")).count()
    assert wrong < 20


def test_toxicity_learns_pairs(spark):
    """Documents are toxic only where exactly one of two words stands: neither word says anything alone."""
    from accesslens.llm.toxicity import toxicity_scores

    rng = random.Random(11)
    rows, marks = [], []
    for i in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"filler{rng.randrange(40)}" for _ in range(12)] + ["insulting"] * a + ["groupname"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(a != b)))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    truth = {i: t for i, _, t in marks}
    found = [r for r in toxicity_scores(docs_of(spark, rows), labels).collect() if r["held_out"]]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in found)
    assert right / len(found) > 0.9


# --- 2: line dedup ---------------------------------------------------------------------------------------------------

def test_line_dedup_removes_the_later_block(spark):
    from accesslens.llm.line_dedup import dedup_lines

    block = "one two three four five six\nseven eight nine ten eleven twelve"
    docs = docs_of(spark, [(1, f"first own line here\n{block}\nend of one"), (2, f"second own line\n{block}  \nend of two"),
                           (3, "nothing shared at all in this text"), (4, f"first own line here\n{block}\nend of one"),
                           (5, "end of one"), (6, f"{block}\nsecond own line")])
    out = {r["doc_id"]: (r["text"], r["removed_lines"]) for r in dedup_lines(docs).collect()}
    assert out[1] == (f"first own line here\n{block}\nend of one", 0)
    assert out[2] == ("second own line\nend of two", 2)
    assert out[3][1] == 0 and out[4] == ("", 4) and out[5] == ("end of one", 0)
    assert out[6] == ("second own line", 2)


def test_line_dedup_against_brute_force(spark):
    """Nothing of eight words may repeat, and whatever is deleted must stand in an earlier document."""
    from accesslens.llm.line_dedup import dedup_lines

    rng = random.Random(5)
    lines = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(9)) for _ in range(40)]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    out = {r["doc_id"]: r for r in dedup_lines(docs_of(spark, list(enumerate(texts)))).collect()}
    seen = set()
    for i, text in enumerate(texts):
        mine = text.split("\n")
        kept = [x for x in mine if x not in seen]
        assert (out[i]["text"].split("\n") if out[i]["text"] else []) == kept
        assert out[i]["removed_lines"] == len(mine) - len(kept)
        seen.update(mine)


def test_line_dedup_is_the_alignment(monkeypatch):
    """Only aligned blocks go, moved and repeated ones too; without the alignment nothing is deleted."""
    from accesslens.llm import line_dedup

    rng = random.Random(9)
    for trial in range(300):
        pool = [" ".join(f"{trial}x{k}y{w}" for w in range(rng.choice((1, 2, 3, 9)))) for k in range(14)]
        a = [rng.choice(pool) for _ in range(rng.randrange(1, 25))]
        b = [rng.choice(pool) for _ in range(rng.randrange(1, 25))]
        words = [len(x.split()) for x in b]
        gone = line_dedup.common_blocks(a, b, words)
        joined = "\n" + "\n".join(a) + "\n"
        for s, e in gone:
            assert sum(words[s:e]) >= 8 or a == b
            assert "\n" + "\n".join(b[s:e]) + "\n" in joined
        # No run of eight words that stands in a is left, but for parts of runs whose rest went with another block.
        taken = {j for s, e in gone for j in range(s, e)}
        for s in range(len(b)):
            e = next((k for k in range(s + 1, len(b) + 1) if sum(words[s:k]) >= 8), None)
            if e and not taken & set(range(s, e)):
                assert "\n" + "\n".join(b[s:e]) + "\n" not in joined
    monkeypatch.setattr(line_dedup, "patience", lambda a, b: [])
    long = [" ".join(f"{k}w{i}" for i in range(10)) for k in range(6)]
    assert line_dedup.common_blocks(long, long[3:] + long[:3] + ["x"], [10] * 6 + [1]) == []


def test_line_dedup_of_reversed_lines_is_fast():
    import time

    from accesslens.llm.line_dedup import common_blocks

    a = [f"line {i}" for i in range(20_000)]
    began = time.time()
    assert sum(e - s for s, e in common_blocks(a, a[::-1], [9] * len(a))) == len(a)
    assert time.time() - began < 20


def test_line_dedup_edges(spark):
    from accesslens.llm.line_dedup import dedup_lines

    odd = odd_docs(spark)
    rows = dedup_lines(odd).collect()
    assert len(rows) == odd.count()
    assert [r["text"] for r in rows if r["doc_id"] == 2] == [None]
    assert sorted(len(r["text"]) > 0 for r in rows if r["doc_id"] in (5, 6)) == [False, True]
    assert dedup_lines(empty_docs(spark)).collect() == []


# --- 3: encoding -----------------------------------------------------------------------------------------------------

STRANGE = ["", " ", "  two  blanks ", "line\n\nends\n", "▁ literal", "\U0001f600 emoji \u0000 zero", "x" * 300, "日本語 текст",
           "tab\tand\r\nreturn", "hello hello hello hello world"]


def test_encoding_is_lossless_and_matches_without_dropout(spark):
    from sentencepiece import SentencePieceProcessor

    from accesslens.llm.piece_dropout import decode_column, encode

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = docs_of(spark, list(enumerate(STRANGE)) + [(90, None)])
    for dropout in (0.0, 0.1, 0.5, 1.0):
        rows = encode(docs, path, 7, dropout).withColumn("back", decode_column(F.col("ids"), path)).collect()
        assert len(rows) == len(STRANGE) + 1
        for r in rows:
            assert (r["back"] or "") == (r["text"] or ""), (dropout, r["doc_id"])
    sp = SentencePieceProcessor(model_file=path)
    plain = {r["doc_id"]: r["ids"] for r in encode(docs, path, 7, 0.0).collect()}
    for i in (2, 9):
        assert plain[i] == sp.encode(STRANGE[i])
    assert encode(empty_docs(spark), path).collect() == []
    assert encode(odd_docs(spark), path).count() == odd_docs(spark).count()


def test_encoding_varies_with_seed_and_repeats(spark, real):
    from accesslens.llm.piece_dropout import encode

    path = public_tokenizers.path("piece_bpe_32k.model")
    first, again, other = ({r["doc_id"]: r["ids"] for r in encode(d, path, s).collect()} for d, s in
                           ((real[0], 1), (real[0].repartition(5), 1), (real[0], 2)))
    assert first == again
    assert sum(first[k] != other[k] for k in first) > len(first) / 2


def test_many_at_once_equals_one_at_a_time():
    from accesslens.llm import piece_dropout as D

    model = D.model_of(public_tokenizers.path("piece_bpe_32k.model"))
    words = ["▁hello", "▁unbelievable", "▁internationalisation", "a", "▁x1y2z3", "▁naïve"]
    keys = np.arange(len(words), dtype=np.uint64) * np.uint64(12345)
    for dropout in (0.0, 0.3):
        many = D.merge_many(model, words, keys, dropout)
        one = [D.merge_heap(model, w, int(k), dropout) for w, k in zip(words, keys)]
        assert [np.frombuffer(m, np.int32).tolist() for m in many] == one


# --- 4: n-gram join --------------------------------------------------------------------------------------------------

def shingle_set(text, n=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def alike(a, b):
    return bool(a and b) and 100 * len(a & b) >= 85 * len(a | b)


def near_texts(rng, families, members):
    words = [f"v{i}" for i in range(300)]
    out = []
    for _ in range(families):
        base = [rng.choice(words) for _ in range(rng.randrange(3, 160))]
        for _ in range(rng.randrange(1, members)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy).upper() if rng.random() < 0.2 else "  ".join(copy))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("rare", [2, 64])
def test_ngram_join_against_brute_force(spark, rare):
    from accesslens.llm.ngram_join import keep_first, ngram_join

    texts = near_texts(random.Random(rare), 40, 12)
    sets = [shingle_set(t) for t in texts]
    parts = linked_brute(sets, alike)
    docs = docs_of(spark, list(enumerate(texts)))
    out = {r["doc_id"]: r for r in ngram_join(docs, rare=rare).collect()}
    assert len(out) == len(texts)
    for i, (s, p) in enumerate(zip(sets, parts)):
        assert (out[i]["n_shingles"], out[i]["component_id"]) == (len(s), p), texts[i]
    kept = sorted(r["doc_id"] for r in keep_first(docs, rare=rare).collect())
    assert kept == sorted(set(parts))


def test_ngram_join_large_group_in_blocks(spark, monkeypatch):
    from accesslens.llm import ngram_join as J

    monkeypatch.setattr(J, "BLOCK_SETS", 16)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(200)]
    texts = []
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.randrange(0, 8)):
            copy[rng.randrange(200)] = f"x{rng.randrange(40)}"
        texts.append(" ".join(copy))
    sets = [shingle_set(t) for t in texts]
    parts = linked_brute(sets, alike)
    out = {r["doc_id"]: r["component_id"] for r in J.ngram_join(docs_of(spark, list(enumerate(texts))), rare=4).collect()}
    assert [out[i] for i in range(len(texts))] == parts


def test_ngram_join_edges(spark):
    from accesslens.llm.ngram_join import keep_first, ngram_join

    odd = odd_docs(spark)
    rows = ngram_join(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["component_id"] == r["doc_id"] for r in rows if r["n_shingles"] == 0)
    assert {r["component_id"] for r in rows if r["n_shingles"] == 5} == {1}
    assert {r["component_id"] for r in rows if r["doc_id"] in (5, 6)} == {5}
    kept = keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:9]) for r in kept.collect()) == [
        (0, ""), (1, "a b c d e"), (1, "other tex"), (2, ""), (3, ""), (4, "  \n\t "), (5, "w0 w1 w2 ")]
    assert ngram_join(empty_docs(spark)).collect() == [] and keep_first(empty_docs(spark)).collect() == []


# --- 5: embeddings ---------------------------------------------------------------------------------------------------

def test_near_vectors_against_brute_force(spark):
    from accesslens.llm.near_vectors import near_vectors

    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 24))
    x = np.vstack([base[rng.integers(0, 40)] + rng.normal(scale=s, size=24) for s in rng.choice([0, .1, .3, .45, 2], 300)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, [float("inf")] * 24), (1004, []),
           (1005, [None] * 24), (None, x[0].tolist()), (0, x[0].tolist())]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("node", F.lit("clash"))
    out = near_vectors(table, group_rows=64).collect()
    assert len(out) == len(rows) + len(odd)
    unit = np.vstack([x, x[:1], x[:1]])
    unit = unit / np.linalg.norm(unit, axis=1)[:, None]
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    counts = link.sum(1)
    parts = linked_brute(list(range(len(unit))), lambda i, j: link[i, j])
    got = {r["vec_id"]: r for r in out if r["vec_id"] is not None}
    for i in range(1, len(x)):
        assert got[i]["n_links"] == counts[i] and got[i]["component_id"] == parts[i]
        assert got[i]["kept"] == (parts[i] == i)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(1000, 1006))
    assert near_vectors(table.limit(0)).collect() == []


# --- 7: packing ------------------------------------------------------------------------------------------------------

def test_packing_round_trip(spark, real):
    from tokenizers import Tokenizer

    from accesslens.llm.packing import pack_documents

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    for docs in (real[0], docs_of(spark, list(enumerate(STRANGE)) + [(90, None)])):
        rows = pack_documents(docs, path).collect()
        ids = {r["doc_id"]: tok.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
        pieces = {}
        for r in rows:
            part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
            assert r["length"] > 0 and len(part) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        assert set(pieces) == set(ids)
        for k, p in pieces.items():
            ends = [0] + [a + n for a, n in sorted(p)]
            assert [a for a, _ in sorted(p)] == ends[:-1] and ends[-1] == len(ids[k])
        sequences = {}
        for r in rows:
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for s in sequences.values():
            ends = [0] + [a + n for a, n in sorted(s)]
            assert [a for a, _ in sorted(s)] == ends[:-1]
            assert ends[-1] == 2048 or bin(ends[-1]).count("1") == 1
    assert pack_documents(empty_docs(spark), path).collect() == []
    assert pack_documents(odd_docs(spark), path).select("doc_id").distinct().count() == 7


def test_packing_keeps_every_limit():
    from accesslens.llm.packing import Packer

    rng = random.Random(9)
    for cut in (True, False):
        packer = Packer(tokens=256, segments=6, loss=100, cut=cut, pool=64)
        wanted = {}
        for k in range(400):
            tokens = rng.randrange(1, 900 if cut else 257)
            loss = rng.randrange(0, min(tokens, 10_000 if cut else 100) + 1)
            wanted[k] = tokens
            packer.add(k, tokens, loss)
        packer.finish()
        found = {}
        for s in packer.sequences:
            assert sum(x[2] for x in s) <= 256 and len(s) <= 6 and sum(x[3] for x in s) <= 100
            for key, start, tokens, _ in s:
                found.setdefault(key, []).append((start, tokens))
        for k, n in wanted.items():
            at = 0
            for start, tokens in sorted(found[k]):
                assert start == at
                at += tokens
            assert at == n


def test_every_limit_shapes_the_packing(spark):
    """Without any one limit the documents are placed otherwise; prompts bear no loss; little is left over."""
    from accesslens.llm.packing import SEGMENTS, pack_documents

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(2)
    rows = []
    for i in range(400):
        first = " ".join(f"ask{rng.randrange(99)}" for _ in range(rng.randrange(1, 60)))
        rest = " ".join(f"say{rng.randrange(99)}" for _ in range(rng.choice((1, 3, 10, 300, 900))))
        rows.append((i, f"{first}\n{rest}" if i % 3 else rest))
    docs = docs_of(spark, rows).coalesce(1)
    place = lambda **limits: sorted(tuple(r) for r in pack_documents(docs, path, **limits).collect())
    usual = place()
    for free in ({"segments": 10 ** 9}, {"loss": 10 ** 9}, {"tokens": 4096}):
        assert place(**free) != usual
    sequences, loss = {}, {}
    for doc_id, start, length, _, tokens, sequence, _, bearing in usual:
        sequences.setdefault(sequence, []).append(length)
        loss[doc_id] = loss.get(doc_id, 0) + bearing
    from accesslens.llm.packing import word_ids
    for i, text in rows:
        prompt = len(word_ids([text[:text.find("\n") + 1]], path)[0]) // 4
        assert loss[i] == len(word_ids([text], path)[0]) // 4 + 1 - max(1, prompt)
    assert max(map(len, sequences.values())) == SEGMENTS
    total = sum(map(sum, sequences.values()))
    padded = sum(n if n & (n - 1) == 0 else 2048 for n in map(sum, sequences.values()))
    assert padded == total


def test_packing_refuses_other_tokenizers():
    from accesslens.llm.packing import tokenizer

    with pytest.raises(ValueError, match="white space"):
        tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def test_pack_examples(spark):
    from accesslens.llm.packing import pack_examples

    rows = [("a", 1500, 900), ("b", 600, 600), ("c", 548, 10), ("d", None, None), ("e", 2048, 2048)]
    out = pack_examples(spark.createDataFrame(rows, "id string, t int, x int").coalesce(1), "id", "t", "x").collect()
    assert {r["id"] for r in out} == {"a", "b", "c", "e"}
    for _, s in itertools.groupby(sorted(out, key=lambda r: r["sequence_id"]), key=lambda r: r["sequence_id"]):
        assert sum(r["tokens"] for r in s) <= 2048


# --- 8: fingerprints -------------------------------------------------------------------------------------------------

def test_fingerprints(spark, real):
    from accesslens.llm.fingerprints import containment, fingerprints_with_edits, from_text, merge, resemblance, sketch

    rows = fingerprints_with_edits(real[0]).collect()
    texts = sorted(((r["doc_id"], r["text"] or "") for r in real[0].collect()), reverse=True)
    after = {i: texts[(k + 1) % len(texts)] for k, (i, _) in enumerate(texts)}
    mine = dict(texts)
    assert len(rows) == len(texts)
    prints = {r["doc_id"]: r["fingerprint"] for r in rows}
    for r in rows:
        text, (next_id, other) = mine[r["doc_id"]], after[r["doc_id"]]
        k = len(text) // 3
        edited = text[:len(text) - k] + other[:k]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_next"] == pytest.approx(resemblance(from_text(r["fingerprint"]), from_text(prints[next_id])))
        assert r["near_edited"] == pytest.approx(
            resemblance(from_text(r["fingerprint"]), from_text(r["edited_fingerprint"])))
        assert (sketch(text) == from_text(r["fingerprint"])).all()
    a, b = "the quick brown fox " * 3 + "x" * 4000, " ".join(f"word{i}" for i in range(4000))
    assert containment(sketch(b), merge(sketch(a), sketch(b))) == 1.0
    # Short texts are compared exactly, and texts shorter than a window as a whole.
    assert resemblance(sketch("call me now"), sketch("Eser thed nt of.")) == 0.0
    assert resemblance(sketch("call me now"), sketch("call me now")) == resemblance(sketch(""), sketch(None)) == 1.0
    assert resemblance(sketch(""), sketch("x")) == 0.0 and containment(sketch(""), sketch("x")) == 1.0
    rng = random.Random(3)
    for n, m in ((40, 60), (300, 500), (400, 3000), (5000, 9000)):
        base = "".join(rng.choice("abcdefgh ") for _ in range(m))
        part, whole = base[:n], base
        windows = [{t[i:i + 16] for i in range(len(t) - 15)} for t in (part, whole)]
        exact = len(windows[0] & windows[1]) / len(windows[0] | windows[1])
        tolerance = 1e-9 if m <= 500 else 0.12
        assert abs(resemblance(sketch(part), sketch(whole)) - exact) <= tolerance
        assert containment(sketch(part), sketch(whole)) == 1.0
    assert fingerprints_with_edits(empty_docs(spark)).collect() == []
    assert fingerprints_with_edits(odd_docs(spark)).count() == odd_docs(spark).count()


# --- 9: personal data ------------------------------------------------------------------------------------------------

PERSONAL = ["mail a.b+c@host.example.org, again x@y.z.", "ip 10.0.0.255 not 256.1.1.1 nor 1.2.3", "card 4111 1111 1111 1111 ok",
            "card 4111 1111 1111 1112 bad", "phone +49 (30) 1234-5678 end", "+1 2 too short", "ü a@b.co é 1.2.3.4.5", "", None,
            "9" * 5000 + "@" + "a." * 2000, "4111111111111111@1.2.3.4", "007.000000001.2.3"]


def plain_spans(text):
    import re

    from accesslens.llm.pii import luhn

    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15)]
    out = []
    for rank, (kind, pattern, test) in enumerate(kinds):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text or "") if test(m.group())]
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def test_base_spans_equal_the_patterns(spark, real):
    from accesslens.llm.pii import base_spans, detect

    rng = random.Random(4)
    texts = [t for t in PERSONAL if t and len(t) < 1000]
    texts += ["".join(rng.choice("12 .-+@a(") for _ in range(60)) for _ in range(3000)]
    for t in texts:
        assert base_spans(t) == plain_spans(t), t
    for r in detect(real[0].unionByName(docs_of(spark, [(10**9 + i, t) for i, t in enumerate(PERSONAL)]))).join(
            real[0].withColumnRenamed("text", "raw"), "doc_id").collect():
        base = [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] != "term"]
        assert base == plain_spans(r["raw"])


def test_disclosing_terms(spark):
    from accesslens.llm.pii import detect, disclosing_terms, sanitise

    rng = random.Random(8)
    rows = [(i, f"customer kontonummer note{rng.randrange(9)} user{i}@host{i}.org") for i in range(60)]
    rows += [(100 + i, f"customer plain text number note{rng.randrange(9)}") for i in range(300)]
    docs = docs_of(spark, rows)
    found = {(r["term"], r["kind"]): r["disclosure"] for r in disclosing_terms(docs).collect()}
    assert set(found) == {("kontonummer", "email")} and found["kontonummer", "email"] == pytest.approx(1.0)
    out = {r["doc_id"]: r for r in detect(docs).collect()}
    assert [s["kind"] for s in out[0]["spans"]] == ["term", "email"] and "kontonummer" not in out[0]["text"]
    assert out[0]["text"].endswith("[EMAIL]") and out[100]["text"] == rows[60][1]
    assert {r["doc_id"]: r["text"] for r in sanitise(docs).collect()} == {k: r["text"] for k, r in out.items()}


def test_personal_data_edges(spark):
    from accesslens.llm.pii import detect, sanitise

    odd = odd_docs(spark)
    assert detect(odd).count() == odd.count() and detect(empty_docs(spark)).collect() == []
    clean = sanitise(odd)
    assert clean.columns == odd.columns and clean.where("text like '%[EMAIL]%'").count() == 1
    assert clean.where("text is null").count() == 2


# --- 10: sharding ----------------------------------------------------------------------------------------------------

def test_sharding(spark, real):
    from accesslens.llm.sharding import communication_matrix, hypergeometric, shuffle_to_shards

    for docs, n in ((real[0], 16), (odd_docs(spark), 3), (odd_docs(spark), 16), (empty_docs(spark), 4)):
        rows = shuffle_to_shards(docs, n, seed=1).collect()
        assert len(rows) == docs.count()
        slots = {}
        for r in rows:
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        sizes = [len(slots.get(s, [])) for s in range(n)]
        assert max(sizes) - min(sizes) <= 1
    matrix = communication_matrix([5, 0, 12, 7], 4, 3)
    assert [sum(r) for r in matrix] == [5, 0, 12, 7] and [sum(c) for c in zip(*matrix)] == [6, 6, 6, 6]
    rng = random.Random(1)
    draws = [hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert abs(np.mean(draws) - 6) < 0.15 and abs(np.var(draws) - 20 * .3 * .7 * 80 / 99) < 0.3


# --- the registered queries ------------------------------------------------------------------------------------------

def test_registered_queries(spark):
    import __spark_entry__ as E

    names = [n for n in E.queries() if n == "pipeline" or (n[:2] == "op" and n[2].isdigit())]
    assert len(names) == 14
    integers = (T.LongType, T.IntegerType)
    for name in names:
        if name == "pipeline":
            continue
        schema = E.queries()[name](spark, SF).schema
        key = {"op5": "vec_id", "op11": "vec_id", "op12": "anchor_id", "op13": "page_id"}.get(name.split("_")[0], "doc_id")
        assert isinstance(schema[key].dataType, integers)


def test_near_vectors_of_any_size(spark):
    """Tiny, huge and subnormal components: cosines are those of the directions, and no vector spoils another's links."""
    from accesslens.llm.near_vectors import near_vectors

    rows = [(1, [1e-200, 1e-200]), (2, [1.0, 2.0]), (3, [2.0, 4.0]), (4, [1e200, 1e200]), (5, [1.0, 1.0]), (6, [5e-324, 0.0]),
            (7, [1e308, 0.0]), (8, [-1e308, 1e300]), (9, [0.0, 0.0]), (10, [3e-310, 3e-310])]
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in
             near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), threshold=0.95).collect()}
    assert {i for i, (_, c) in found.items() if c == 1} == {1, 4, 5, 10} | {i for i in (2, 3) if found[i][1] == 1}
    assert found[2][1] == found[3][1] and found[6] == found[7] == (1, 6)
    assert found[8] == (0, 8) and found[9] == (0, 9)


def test_very_long_text_is_stitched(spark):
    """A text above the step size gives the same shingles and links as its plain set."""
    from accesslens.llm.ngram_join import ngram_join

    words = [f"w{(i * 7919) % 300_007}" for i in range(400_000)]
    long = " ".join(words)
    assert len(long) > 2_500_000
    rows = ngram_join(docs_of(spark, [(1, long), (2, long + " more words at the end"), (3, "a b c d e")])).collect()
    expected = len(set(zip(words, words[1:], words[2:], words[3:])))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert found[1] == (expected, 1) and found[2][1] == 1 and found[3] == (2, 3)


def test_words_are_encoded_side_by_side(monkeypatch):
    """New words go to the tokenizer some at a time, and keep the ids that the whole text has."""

    from accesslens.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    one, calls = packing.tokenizer(path), []

    class Counting:
        def encode(self, *args, **kwargs):
            calls.append(1)
            return one.encode(*args, **kwargs)

    monkeypatch.setitem(packing._tokenizers, path, Counting())
    monkeypatch.setitem(packing._known, path, {"": b""})
    draw = random.Random(5)
    letters = "abcXYZ.,!?'s7éÀİßΣς́\x1c\x00<|>-中   \n\t"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 80))) for _ in range(2000)]
    texts += ["", "a" * 70 + "!" * 80, "<|endoftext|> <|ENDOFTEXT|>. x"]
    found = packing.word_ids(texts, path)
    assert [np.frombuffer(f, np.uint32).tolist() for f in found] == [one.encode(t, add_special_tokens=False).ids for t in texts]
    words = {w for t in texts for w in t.split()}
    assert len(calls) < len(words) / 10
    assert not any(len(w) > packing.LONGEST for w in packing._known[path])


def test_bucket_counts_travel_packed(spark, monkeypatch):
    """A set has shingles in every bucket; the rows that buckets send follow buckets and homes, not sets in buckets."""
    from accesslens.llm import ngram_join as J

    monkeypatch.setattr(J, "HOMES", 2)
    draw = np.random.default_rng(3)
    pool = [f"w{i}" for i in range(30)]
    texts = [" ".join(draw.choice(pool, 60)) for _ in range(40)] + [" ".join(pool)] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r["set_id"]: r["unshared"] for r in J._unshared(docs, 1, 64, 64).collect()}
    sets = {J.set_id(s): set(s.tolist()) for s in J.shingle_sets(texts, 1)}
    own = {k: sum(not any(x in o for j, o in sets.items() if j != k) for x in s) for k, s in sets.items()}
    assert found == own
    plan = J._unshared(docs, 1, 64, 64)._jdf.queryExecution().toString()
    assert "home" in plan and "Aggregate" not in plan


def test_pieces_hold_one_step():
    """A batch becomes Python values piece by piece: the same pieces as by length, never all of its texts at once."""
    import tracemalloc

    import pyarrow as pa

    from accesslens.llm.common import pieces

    texts = [None, "", "é" * 5, "x" * 40, "ab", None, "\U0001f600" * 9, "y" * 10, "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], names=["id", "text"]).slice(1)
    assert list(pieces([batch], limit=12)) == [
        [[1, 2, 3], texts[1:4]], [[4, 5, 6], texts[4:7]], [[7, 8], texts[7:]]] and list(pieces([batch.slice(8)])) == []
    many = pa.RecordBatch.from_arrays([pa.array(["t" * 1000] * 500)], names=["text"])
    assert [len(step) for (step,) in pieces([many], 0, 10_000)] == [10] * 50
    tracemalloc.start()
    next(pieces([many], 0, 10_000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000       # 500 texts of 1,000 characters take 525,000 bytes
