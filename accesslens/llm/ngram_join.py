"""N-gram Jaccard join: token-combination prefixes find candidates, exact set sizes verify them."""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from accesslens.llm.common import connected_components, join_labels, pieces, stored
from accesslens.llm.texthash import mix, shingle_sets

WORDS, PERCENT = 4, 85
#: A shingle of at most so many different sets is rare and indexed alone; one of more is indexed in pairs.
RARE = 64
BUCKET_TOKENS = 1_000_000
#: Groups of sets, at least, in which the counts of all buckets are added up.
HOMES = 64
BLOCK_SETS, BLOCK_TOKENS = 256, 1 << 17


def slack(n, percent=PERCENT):
    """How many of its n shingles a set can lack in a set linked with it."""
    return n - -(-percent * n // 100)


def _slack(n, percent):
    return n - F.floor((n * percent + 99) / 100)


def set_id(tokens):
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(n, counts, tokens, percent=PERCENT, rare=RARE):
    """Index entries of a set of n shingles, of which ``tokens`` (with ``counts``: sets that have them) are shared.

    All shingles are ordered by (count, hash); those in one set only come first and need no entry. Let ``t`` be the
    slack. A prefix of t + 1 shingles shares one with any partner. If the rare ones reach that far, they are the entries.
    Else all rare ones are entries, and the prefix goes on with frequent ones: of these at most ``left`` = t - rare ones
    before can be missing (were no rare one shared), and a partner can have at most s of its own between them, s its
    largest possible slack. Each missing one breaks two neighbouring pairs, each foreign one breaks one; so of
    2 * left + s + 2 frequent shingles, at least one pair of neighbours stands in both prefixes. Entries: these pairs.
    """
    order = np.lexsort((tokens, counts))
    counts, tokens = counts[order], tokens[order]
    t, alone = slack(n, percent), n - len(tokens)
    few = int(np.searchsorted(counts, rare, side="right"))
    if alone + few > t:
        return tokens[:max(0, t + 1 - alone)]
    left, s = t - alone - few, (100 - percent) * n // percent
    often = tokens[few:few + 2 * left + s + 2]
    pairs = mix(often[:-1] * np.uint64(0x9E3779B97F4A7C15) + mix(often[1:]))
    return np.concatenate([tokens[:few], pairs])


def _summary(docs, words):
    """(doc_id, text_key, n, set_id) of every row; set_id null for an empty set."""
    def run(batches):
        for ids, keys, texts in pieces(batches, 2):
            sets = shingle_sets(texts, words)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())],
                names=["doc_id", "text_key", "n", "set_id"])

    return docs.mapInArrow(run, "doc_id long, text_key long, n long, set_id long")


def _unshared(docs, words, buckets, bits=62):
    """(set_id, unshared): how many of a set's posted shingles surely no other set of ``docs`` has.

    Posted are the shingles below 2**``bits`` of 2**64: a quarter of them by default. A piece of a partition sends each of them once: with its
    set if one set of the piece has it, without if several do. So a shingle of many documents costs a task few bytes.
    What a piece knows to be shared it counts itself; the buckets of shingles add those that other pieces have too. If
    equal sets stand in several pieces, the least count of a piece holds: each further one is met in a bucket. A set may
    have shingles in every bucket, so buckets pass their counts on packed, in one row for each home of sets.
    """
    homes = max(HOMES, buckets // 16)

    def post(batches):
        for (texts,) in pieces(batches, 0):
            different = {s.tobytes(): s for s in shingle_sets(texts, words) if len(s)}
            if not different:
                continue
            ids = np.array([set_id(s) for s in different.values()], np.int64)
            posted = [s if bits == 64 else s[s >> np.uint64(bits) == 0] for s in different.values()]
            size = np.array([len(p) for p in posted])
            at, token = np.repeat(np.arange(len(ids)), size), np.concatenate(posted)
            order = np.argsort(token, kind="stable")
            token, at = token[order], at[order]
            first = np.concatenate(([True], token[1:] != token[:-1]))[:len(token)]
            single = first & np.concatenate((first[1:], [True]))[:len(token)]
            known = np.bincount(at[~single], minlength=len(ids))
            shared, token, owner = token[first & ~single], token[single], ids[at[single]]
            ends = np.arange(1, buckets, dtype=np.uint64) * np.uint64((1 << bits) // buckets)
            rows = [np.split(v, np.searchsorted(by, ends)) for v, by in ((token, token), (owner, token), (shared, shared))]
            # The counts of the piece go to buckets of sets, which follow those of shingles.
            home = (ids.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            parts = np.searchsorted(home[order], np.arange(1, buckets))
            for column, v in zip(rows, (ids, size, known)):
                column += np.split(v[order].astype(np.int64), parts)
            filled = [k for k in range(2 * buckets) if any(len(column[k]) for column in rows)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(filled, pa.int32()), *[pa.array([column[k].tobytes() for k in filled], pa.binary()) for column in rows]],
                names=["bucket", "tokens", "owners", "shared"])

    def count(t):
        x, y, z = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.int64) for c in ("tokens", "owners", "shared"))
        if t.column("bucket")[0].as_py() >= buckets:
            order = np.lexsort((z, x))
            x, y, z = x[order], y[order], z[order]
            least = np.concatenate(([True], x[1:] != x[:-1]))
            return packed(x[least], y[least], z[least])
        order = np.lexsort((y, x))
        token, owner = x[order], y[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        token, owner = token[new], owner[new]               # equal sets of several pieces count once
        same = token[1:] == token[:-1]
        often = np.isin(token, z)
        often[1:] |= same
        often[:-1] |= same
        sets, n = np.unique(owner[often], return_counts=True)
        return packed(sets, np.zeros(len(sets), np.int64), n.astype(np.int64))

    def packed(sets, posted, shared):
        home = (sets.view(np.uint64) % np.uint64(homes)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        found, first = np.unique(home[order], return_index=True)
        columns = [np.split(v[order], first[1:]) if len(found) else [] for v in (sets, posted - shared)]
        return pa.table({"home": pa.array(found, pa.int32()),
                         **{n: pa.array([v.tobytes() for v in c], pa.binary()) for n, c in zip(("sets", "counts"), columns)}})

    def add(t):
        sets, counts = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.int64) for c in ("sets", "counts"))
        order = np.argsort(sets, kind="stable")
        different, first = np.unique(sets[order], return_index=True)
        return pa.table({"set_id": different, "unshared": np.add.reduceat(counts[order], first)})

    return (docs.select("text").mapInArrow(post, "bucket int, tokens binary, owners binary, shared binary")
            .groupBy("bucket").applyInArrow(count, "home int, sets binary, counts binary")
            .groupBy("home").applyInArrow(add, "set_id long, unshared long"))


def _likely(source, nodes):
    """The rows of ``source`` whose text hash may be that of a node: all that are, and about one in sixteen others.

    A bitmap over the hashes, of sixteen bits a node but 64 MB at most, goes to every task. It only spares the join that
    follows the texts that surely have no part in it.
    """
    bits = 1 << max(15, min(29, math.ceil(math.log2(16 * max(1, nodes.count())))))
    place = lambda key: F.pmod(key, F.lit(bits))
    maps = (nodes.select(place(F.col("rkey")).alias("p"))
            .groupBy(F.floor(F.col("p") / 32768).alias("_page")).agg(F.expr("bitmap_construct_agg(p % 32768)").alias("_map")))
    rows = source.withColumn("_at", place(F.col("text_key"))).withColumn("_page", F.floor(F.col("_at") / 32768))
    byte = F.expr("cast(conv(hex(substring(_map, cast(_at % 32768 div 8 AS int) + 1, 1)), 16, 10) AS int)")
    bit = byte.bitwiseAND(F.expr("shiftleft(1, cast(_at % 8 AS int))"))
    return rows.join(F.broadcast(maps), "_page").where(bit != 0).select(*source.columns)


def _token_sets(rows, words):
    def run(batches):
        for ids, ns, texts in pieces(batches, 2):
            sets = shingle_sets(texts, words)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["set_id", "n", "tokens"])

    sets = stored(rows.mapInArrow(run, "set_id long, n long, tokens array<long>"), "ngram-sets")
    # A set comes twice only if a row repeats; the long token lists of all others are not shuffled for that.
    twice = stored(sets.groupBy("set_id").count().where("count > 1").select("set_id"), "ngram-twice")
    if twice.isEmpty():
        return sets
    return stored(sets.join(twice, "set_id", "left_anti").unionByName(
        sets.join(twice, "set_id", "left_semi").dropDuplicates(["set_id"])), "ngram-sets")


def _index(sets, percent, rare):
    """(sig, set_id, n): the index entries of every set that shares a shingle with another."""
    postings = sets.select("set_id", "n", F.explode("tokens").alias("token"))
    counts = postings.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    shared = (postings.join(counts, "token").groupBy("set_id", "n")
              .agg(F.collect_list(F.struct("c", "token")).alias("x"))
              .select("set_id", "n", F.col("x.c").alias("c"), F.col("x.token").alias("token")))

    def run(batches):
        for batch in batches:
            ids, ns, c, token = batch.columns
            found = [np.unique(signatures(n.as_py(), np.array(k.values), np.array(t.values).view(np.uint64), percent, rare))
                     .view(np.int64) for n, k, t in zip(ns, c, token)]
            size = [len(f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([*found, np.empty(0, np.int64)])), pa.array(np.repeat(ids.to_numpy(), size)),
                 pa.array(np.repeat(ns.to_numpy(), size))], names=["sig", "set_id", "n"])

    return shared.mapInArrow(run, "sig long, set_id long, n long")


def _alike_sizes(a, b, percent):
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _verified(pairs, sets, percent):
    """The pairs (a, b) whose sets are alike enough, by exact intersection."""
    left = sets.select(F.col("set_id").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("set_id").alias("b"), F.col("tokens").alias("y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("i", F.size(F.array_intersect("x", "y")))
    return both.where(F.col("i") * 100 >= (F.size("x") + F.size("y") - F.col("i")) * percent).select("a", "b")


def block_links(a, b, percent):
    """Spanning links (set ids) between two blocks of (set_id, label, tokens): all pairs of different labels, in tiles.

    Only shingles in both blocks count; intersections come from 0/1 matrix products over stretches of those.
    """
    rows = [np.concatenate([np.asarray(t, np.int64) for t in x["tokens"]]) for x in (a, b)]
    at = [np.repeat(np.arange(len(x["n"])), x["n"]) for x in (a, b)]
    common = np.intersect1d(np.unique(rows[0]), np.unique(rows[1]))
    cols = [np.searchsorted(common, r) for r in rows]
    keep = [(c < len(common)) & (common[np.minimum(c, max(0, len(common) - 1))] == r) if len(common) else np.zeros(len(r), bool)
            for c, r in zip(cols, rows)]
    na, nb = np.asarray(a["n"]), np.asarray(b["n"])
    inter = np.zeros((len(na), len(nb)), np.float32)
    ca, cb, ra, rb = cols[0][keep[0]], cols[1][keep[1]], at[0][keep[0]], at[1][keep[1]]
    for start in range(0, len(common), 4096):
        width = min(4096, len(common) - start)
        m = []
        for c, r, n in ((ca, ra, len(na)), (cb, rb, len(nb))):
            inside = (c >= start) & (c < start + width)
            x = np.zeros((n, width), np.float32)
            x[r[inside], c[inside] - start] = 1
            m.append(x)
        inter += m[0] @ m[1].T
    inter = inter.astype(np.int64)
    la, lb = np.asarray(a["label"]), np.asarray(b["label"])
    i, j = np.nonzero((100 * inter >= percent * (na[:, None] + nb[None, :] - inter)) & (la[:, None] != lb[None, :]))
    ids = np.concatenate([np.asarray(a["set_id"]), np.asarray(b["set_id"])])
    unique, node = np.unique(ids, return_inverse=True)
    labels = np.arange(len(unique))
    if len(i):
        join_labels(labels, node[i], node[j + len(na)])
    moved = np.flatnonzero(labels != np.arange(len(unique)))
    return unique[moved], unique[labels[moved]]


def _open_links(sets, index, links, percent, rare):
    """Links that the stars missed: pairs under an index entry whose sets are not all connected yet."""
    labels = connected_components(links, "ngram-stars")
    entries = stored(index.join(labels.select(F.col("node").alias("set_id"), "component"), "set_id", "left")
                     .select("sig", "set_id", "n", F.coalesce("component", "set_id").alias("label")), "ngram-entries")
    groups = (entries.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m"))
              .where("lo <> hi").select("sig", "m"))
    entries = stored(entries.join(groups, "sig"), "ngram-open")
    few = entries.where(F.col("m") <= rare)
    left = few.select("sig", F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))
    right = few.select("sig", F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    pairs = (left.join(right, "sig").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb"))
                                          & _alike_sizes("na", "nb", percent)).select("a", "b").distinct())
    found = _verified(pairs, sets, percent)
    many = entries.where(F.col("m") > rare)
    if many.isEmpty():
        return found
    # Sets under large entries are dealt to blocks of like sets: by their smallest such entry, in even parts by hash.
    home = many.groupBy("set_id", "label", "n").agg(F.min("sig").alias("home"))
    parts = home.groupBy("home").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_TOKENS)).alias("parts"))
    home = stored(home.join(parts, "home").select(
        "set_id", "label", F.xxhash64("home", F.pmod(F.xxhash64("set_id"), "parts")).alias("block")), "ngram-blocks")
    sides = many.join(home.select("set_id", "block"), "set_id").select("sig", "block").distinct()
    units = (sides.withColumnRenamed("block", "p").join(sides.withColumnRenamed("block", "q"), "sig")
             .where("p <= q").select("p", "q").distinct())
    blocks = (home.join(sets, "set_id").groupBy("block")
              .agg(F.collect_list(F.struct("set_id", "label", "n", "tokens")).alias("rows")))
    rows = (units.join(blocks.select(F.col("block").alias("p"), F.col("rows").alias("x")), "p")
            .join(blocks.select(F.col("block").alias("q"), F.col("rows").alias("y")), "q").select("x", "y"))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                sides = [batch.column(c)[k].values for c in (0, 1)]
                a, b = ({"set_id": s.field("set_id").to_numpy(), "label": s.field("label").to_numpy(),
                         "n": s.field("n").to_numpy(), "tokens": [t.values.to_numpy() for t in s.field("tokens")]}
                        for s in sides)
                left, right = block_links(a, b, percent)
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], names=["a", "b"])

    return found.unionByName(rows.mapInArrow(run, "a long, b long"))


def linked_rows(docs, id_col="doc_id", text_col="text", words=WORDS, percent=PERCENT, rare=RARE):
    """(doc_id, text_key, n_shingles, component) of every row; rows of one component are linked, null is an empty set.

    1. Every text becomes its set of shingles; rows of equal sets are one node from here on.
    2. A node whose posted shingles are its own beyond its slack has no partner and goes (exact, most nodes): first by a
       quarter of the shingles of all nodes, then by all shingles of the nodes that are left.
    3. The others are indexed by ``signatures``. Each entry's first node is compared with the others of that entry.
    4. Entries whose nodes are not all connected then are compared in full: small ones pair by pair, large ones in blocks
       by matrix products. Nodes already connected need no comparison, so a group of near copies costs little.
    Every pair that could change a component is compared exactly; there is no cap.

    Other columns are ignored; an empty input gives an empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"),
                         F.col(text_col).alias("text"))
    summary = stored(_summary(source, words), "ngram-summary")
    least = math.ceil(percent / (100 - percent))        # smaller sets link with equal ones only
    total = summary.agg(F.sum("n")).first()[0] or 0
    buckets = max(8, math.ceil(total / 4 / BUCKET_TOKENS))
    nodes = (summary.where(F.col("n") >= least).groupBy("set_id", "n")
             .agg(F.min(F.struct("doc_id", "text_key")).alias("r"))
             .join(_unshared(source, words, buckets), "set_id", "left")
             .where(F.coalesce("unshared", F.lit(0)) <= _slack(F.col("n"), percent))
             .select("set_id", "n", F.col("r.doc_id").alias("rid"), F.col("r.text_key").alias("rkey")))
    nodes = stored(nodes, "ngram-nodes")

    texts = stored(_likely(source, nodes).join(
        nodes, F.col("doc_id").eqNullSafe(F.col("rid")) & (F.col("text_key") == F.col("rkey")))
        .select("set_id", "n", "text"), "ngram-texts")
    # Any partner is among the nodes left, so all shingles of these, and only these, decide once more.
    held = nodes.agg(F.sum("n")).first()[0] or 0
    again = _unshared(texts, words, max(8, math.ceil(4 * held / BUCKET_TOKENS)), 64)
    sets = _token_sets(texts.join(again, "set_id", "left")
                       .where(F.coalesce("unshared", F.lit(0)) <= _slack(F.col("n"), percent)).select("set_id", "n", "text"), words)
    index = stored(_index(sets, percent, rare), "ngram-index")
    hubs = index.groupBy("sig").agg(F.min(F.struct("set_id", "n")).alias("h"), F.count("*").alias("m")).where("m > 1")
    stars = (index.join(hubs.select("sig", F.col("h.set_id").alias("hub"), F.col("h.n").alias("hn")), "sig")
             .where((F.col("set_id") != F.col("hub")) & _alike_sizes("n", "hn", percent))
             .select(F.col("hub").alias("a"), F.col("set_id").alias("b")).distinct())
    links = stored(_verified(stars, sets, percent), "ngram-links")
    more = stored(_open_links(sets, index, links, percent, rare), "ngram-more")
    labels = connected_components(links.unionByName(more), "ngram-components")
    return (summary.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
            .select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.coalesce("component", "set_id").alias("component")))


def ngram_join(docs, id_col="doc_id", text_col="text", words=WORDS, percent=PERCENT, rare=RARE):
    """(doc_id, n_shingles, component_id) of every row: its set's size and the smallest id reachable by links.

    See ``linked_rows`` for the method. Nulls and texts without words have an empty set, linked with nothing. Null ids
    are kept and take the smallest id of their component, null if it has none. Repeated rows and ids are separate rows
    with the same component if their sets are linked. Other columns are ignored; an empty input gives an empty result.
    """
    rows = linked_rows(docs, id_col, text_col, words, percent, rare)
    names = rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = rows.where("component is not null").join(names, "component")
    return (linked.select("doc_id", "n_shingles", "component_id")
            .unionByName(rows.where("component is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))))


def keep_first(docs, id_col="doc_id", text_col="text", **options):
    """The rows of ``docs`` but for those linked with a document of smaller id (null last), then smaller text hash.

    Of rows equal in id and text one stays, whichever; rows without words all stay. Rows are named by id and text hash,
    so ids may repeat or be null. All columns are kept; input columns ``_k1``, ``_k2`` and ``_once`` are reserved.
    """
    last = (1 << 63) - 1
    rows = (linked_rows(docs, id_col, text_col, **options).where("component is not null")
            .groupBy("component", F.coalesce("doc_id", F.lit(last)).alias("_k1"), F.col("text_key").alias("_k2"))
            .agg(F.count("*").alias("copies")))
    first = rows.groupBy("component").agg(F.min(F.struct("_k1", "_k2")).alias("first"), F.sum("copies").alias("m"))
    # Only rows of groups matter from here on: the first one stays (once, if it repeats), the others go.
    acts = stored(rows.join(first.where("m > 1"), "component")
                  .withColumn("_once", F.struct("_k1", "_k2") == F.col("first"))
                  .where("not _once or copies > 1").select("_k1", "_k2", "_once"), "ngram-acts")
    marked = docs.withColumns({"_k1": F.coalesce(F.col(id_col).cast("long"), F.lit(last)),
                               "_k2": F.xxhash64(F.col(text_col))}).join(acts, ["_k1", "_k2"], "left")
    out = marked.where("_once is null")
    if not acts.where("_once").isEmpty():
        out = out.unionByName(marked.where("_once").dropDuplicates(["_k1", "_k2"]))
    return out.select(*docs.columns)
