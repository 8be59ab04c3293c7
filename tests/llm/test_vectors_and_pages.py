"""Centroids, hard negatives and page text against brute force, and their odd inputs."""

import hashlib
import html
import math
import random
import re

import numpy as np
import pytest

pytest.importorskip("accesslens.llm.queries")

from pyspark.sql import functions as F  # noqa: E402

VECTORS = "vec_id long, embedding array<float>, label int"


def random_vectors(n, dim=64, seed=0, labels=4, spread=0.3):
    """Vectors around a few centres, with copies and nulls in every column."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    rows = []
    for i in range(n):
        v = (centres[i % 5] + spread * rng.normal(size=dim)).astype(np.float32).tolist()
        rows.append((i, v, i % labels))
    rows += [(i, list(rows[i][1]), rows[i][2]) for i in (1, 1, 7)] + [(n + j, list(rows[3][1]), 1) for j in range(20)]
    return rows


def odd_vectors():
    bad = [1.0] * 64
    return [(900, None, 1), (901, [], 1), (902, [1.0] * 63, 2), (903, bad[:-1] + [None], 3), (904, bad[:-1] + [math.nan], 1),
            (905, bad[:-1] + [math.inf], 0), (None, [0.5] * 64, 2), (906, [0.25] * 64, None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, VECTORS).withColumns(
        {c: F.lit("clash") for c in ("v", "cluster", "distance", "near", "_row", "id", "rank", "slots")})


# --- 11: centroids ---------------------------------------------------------------------------------------------------

def lloyd(rows, k=16, rounds=3):
    """Plain integer rounds, every centroid measured."""
    kept = [(i, tuple(math.floor(64 * float(np.float32(x))) for x in v)) for i, v, _ in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for n, vs in groups.items():
            centroids[n] = [sum(col) // len(vs) for col in zip(*vs)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {}
    for _, c, d in found:
        inertia[c] = inertia.get(c, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    fit = lambda s: s if s < 1 << 63 else None
    broken = {c for _, c, d in found if d >= 1 << 63}
    return sorted(((i, c, fit(d), None if c in broken else fit(inertia[c]),
                    None if broken else fit(sum(inertia.values())), digest[c]) for i, c, d in found), key=str)


@pytest.mark.parametrize("n", [0, 9, 400])
def test_centroids_brute_force(spark, n):
    from accesslens.llm.centroids import cluster_vectors

    rows = (random_vectors(n, seed=n) if n else []) + odd_vectors()
    found = cluster_vectors(frame(spark, rows))
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == lloyd(rows)


def test_centroids_extreme_components(spark):
    from accesslens.llm.centroids import cluster_vectors

    rows = random_vectors(60, seed=3) + [(500, [2.0 ** 40] * 64, 1), (501, [-2.0 ** 40] * 64, 1), (502, [2.0 ** 21] * 64, 1)]
    found = cluster_vectors(frame(spark, rows), k=5)
    assert sorted((tuple(r) for r in found.collect()), key=str) == lloyd(rows, k=5)
    assert cluster_vectors(frame(spark, [])).collect() == []


def test_bounds_rule_centroids_out_and_stay_exact():
    """Distant clusters need few exact distances; equal bounds and offsets far from zero stay exact."""
    from accesslens.llm import centroids as module

    rng = np.random.default_rng(1)
    for offset in (0, 10 ** 6):
        centres = rng.integers(-500, 500, (16, 64)) + offset
        x = centres[rng.integers(0, 16, 2000)] + rng.integers(-20, 20, (2000, 64))
        x[:50] = x[0]
        mean = x.mean(0)
        axes = np.linalg.eigh(np.cov((x - mean).T))[1][:, ::-1]
        near, rest = module.project(x, mean, axes, 16)
        best, least = module.nearest(x, near, rest, centres.astype(object), mean, axes)
        every = ((x[:, None, :] - centres[None]) ** 2).sum(2)
        assert (best == every.argmin(1)).all() and (least == every.min(1)).all()
        place, tail = module.project(centres, mean, axes, 16)
        bound = ((near[:, None] - place[None]) ** 2).sum(2) + (rest[:, None] - tail[None]) ** 2
        assert (bound <= every + 1e-3 * (1 + offset / 100)).all()
        assert (bound > least[:, None]).mean() > 0.9


# --- 12: hard negatives ----------------------------------------------------------------------------------------------

def mined(rows):
    kept = []
    for n, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        kept.append((math.inf if i is None else i, n, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for i, n, label, v in kept:
        if i == math.inf or i % 100:
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w)), j, m, other) for j, m, other, w in kept if m != n)
        scores = [s for s in scores if -(1 << 63) <= -s[0] < 1 << 63]
        for p, j, m, _ in [s for s in scores if s[3] == label][:5]:
            window = [s for s in scores if s[3] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out += [(i, None if j == math.inf else j, r + 1, None if s[1] == math.inf else s[1], -p, -s[0])
                    for r, s in enumerate(window)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_rows", [16_384, 64])
def test_hard_negatives_brute_force(spark, block_rows):
    from accesslens.llm.hard_negatives import mine_embeddings

    rows = random_vectors(420, seed=5, labels=3, spread=0.9) + odd_vectors() + random_vectors(101, seed=6)[100:101]
    rows += [(903, [0.5] * 20, 1), (200, [0.1] * 70, 2)]
    found = mine_embeddings(frame(spark, rows), block_rows=block_rows)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = sorted((tuple(r) for r in found.collect()), key=str)
    assert found and found == mined(rows)


def test_hard_negatives_edges(spark):
    from accesslens.llm.hard_negatives import mine_embeddings

    run = lambda rows: sorted((tuple(r) for r in mine_embeddings(frame(spark, rows)).collect()), key=str)
    assert run([]) == [] and run(odd_vectors()) == [] and run([(100, [1.0] * 64, 1)]) == []
    # Only ties: the smallest ids come first.
    ties = [(i, [0.5] * 8, i % 2) for i in range(201)]
    assert run(ties) == mined(ties)
    # Scores beyond a long are not ranked; the others stay exact.
    huge = [(i, [2.0 ** 22 * (i % 3 + 1), 1.0, 3.0], i % 2) for i in range(50)] + [(100, [2.0 ** 26, 2.0, 5.0], 1), (3, [2.0 ** 60, 0.0, 0.0], 1)]
    assert run(huge) == mined(huge)


def test_strassen_is_exact():
    from accesslens.llm.hard_negatives import strassen

    rng = np.random.default_rng(0)
    for shape in ((1, 1, 1), (3, 64, 5), (70, 64, 200), (256, 64, 1000), (65, 33, 129)):
        a, b = (rng.integers(-2 ** 27, 2 ** 27, s) for s in (shape[:2], shape[1:]))
        assert (strassen(a, b) == a @ b).all()
    a, b = rng.integers(-2 ** 27, 2 ** 27, (70, 64)).astype(object) ** 3, rng.integers(-9, 9, (64, 70)).astype(object)
    assert (strassen(a, b) == a.dot(b)).all()


# --- 13: page text ---------------------------------------------------------------------------------------------------

def text_of(page):
    from accesslens.llm.main_text import main_lines

    return "\n".join(main_lines(page))


def test_pages_of_the_table(spark):
    """The table's articles, read with plain patterns that know its one layout."""
    from accesslens.llm.main_text import extract_main_text

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r["page_id"]: r for r in extract_main_text(pages).collect()}
    assert len(found) == pages.count()
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1).replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        expected = "\n".join(b for b in blocks if b)
        row = found[r["page_id"]]
        assert (row["text"], row["n_chars"], row["url"]) == (expected, len(expected), r["url"])


def test_page_layouts():
    words = "some words of an article that is long enough to stand out " * 4
    body = " ".join(words.split())
    # No sectioning elements: the distribution alone finds the text.
    plain = (f"<div id=top><a href=/>Home</a> | <a href=/x>News</a></div><div id=c><p>{words}<p>Short.<p>{words}</div>"
             "<div id=low>(c) 2020, all rights kept</div>")
    assert text_of(plain) == f"{body}\nShort.\n{body}"
    for wrong in ("<aside>{}</aside>", "<nav><p>{}</p></nav>", '<div class="cookie-notice">{}</div>',
                  '<section id="comments"><p>{}</p></section>', "<form><p>{}</p></form>", "<footer>{}</footer>",
                  '<div role="complementary">{}</div>', "<header><p>{}</p></header>", "<p hidden>{}</p>",
                  '<div style="display: none">{}</div>', "<script>{}</script>", "<!-- {} -->", '<ul class="sidebar_2"><li>{}</ul>'):
        for page in (f"{wrong}<article><h1>T</h1><p>{words}</p></article>", f"<article><h1>T</h1><p>{words}</p></article>{wrong}",
                     f"<div id=c><h1>T</h1><p>{words}</p></div>{wrong}"):
            assert text_of(page.replace("{}", words + words)) == f"T\n{body}", page
    inner = f'<main><h2>A</h2><p>{words}</p><div class="ad">buy</div><p>Be.</p><div class="share-links"><a href=q>f</a></div></main>'
    assert text_of(inner) == f"A\n{body}\nBe."
    assert text_of('<body class="no-sidebar has-ads"><article class="post comment-open"><p class="no-ad">x</p></article>') == "x"


def test_page_markup():
    assert text_of("<article>a&amp;b &lt;i&gt; &#233;&nbsp;&#x41;<br>c<br><br>d\n\t e</article>") == "a&b <i> é A c\nd e"
    assert text_of("<nav><a href=x>Home</a><article><p>Hello <b>wor<i>ld</b></p><p class=ad>buy<p>More</article>") == "Hello world\nMore"
    assert text_of("<article><p title='>'>t</p><p title=\"x>y</p></article>").startswith("t")
    assert text_of("<article>x<!-- never closed <p>y</article>") == "x"
    assert text_of("<article>1 < 2 <p>3</article>") == "1 < 2\n3"
    assert text_of("<form><main><p>whole page in a form</p></main></form>") == "whole page in a form"
    assert text_of("<article>a<script>var t='</p>';</script>b</article>") == "ab"
    assert text_of("<article><table><tr><td>a</td><td>b</td></tr><tr><td>c</table></article>") == "a b\nc"
    for page in ("", " ", "<", "<p", "</p>", "<a href=x>only links</a>", "<script>x"):
        assert text_of(page) == ("<" if page == "<" else "")


def test_pages_odd(spark):
    from accesslens.llm.main_text import extract_main_text

    long = "<article>" + "".join(f"<p>w{i}</p>" for i in range(400_000)) + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article>x</article>"), (1, "u", "<article>x</article>"), (3, "v", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(9))
    found = sorted((tuple(r) for r in extract_main_text(pages).collect()), key=lambda r: (str(r[0]), str(r[2])[:9]))
    whole = "\n".join(f"w{i}" for i in range(400_000))
    assert found == [(1, "u", "", 0), (1, "u", "x", 1), (2, None, "", 0), (3, "v", whole, len(whole)), (None, "u", "x", 1)]
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize("part", ["<b>", "</i>", '<a "', "<!--", "<script>", "<div class='ad'>", "<p>x", "<", "&", "<a '", "<br>"])
def test_broken_pages_stay_linear(part):
    import time

    from accesslens.llm.main_text import main_lines

    began = time.time()
    main_lines(part * random.Random(0).choice((60_001, 60_002)))
    assert time.time() - began < 20
