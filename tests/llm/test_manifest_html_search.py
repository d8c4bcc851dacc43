"""Manifest, main text of pages and ranked search, against brute force and defined edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import html_text, merkle, ranked_search
from ledgerspark.llm.html_blocks import blocks

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["tree", "pos", "n", "digest", "other", "block", "proof", "root", "rank", "score", "item", "docs", "term", "url2", "kept"]


def clashing(df):
    for i, name in enumerate(CLASHES):
        df = df.withColumn(name, F.lit(i))
    return df


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# manifest

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows, fanout):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def digest(r):
        return sha("".join(map(field, r)))

    def levels(nodes):
        found = [nodes]
        while len(found[-1]) > 1:
            x = found[-1]
            found.append([sha("".join(x[i : i + fanout])) for i in range(0, len(x), fanout)])
        return found

    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    trees = {}
    for source, own in by.items():
        own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
        trees[source] = own, levels([digest(r) for r in own])
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = levels([trees[s][1][-1][0] for s in order])
    root, out = top[-1][0], []
    for k, source in enumerate(order):
        own, tree = trees[source]
        for i, r in enumerate(own):
            picked = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            h, siblings = digest((*r[:4], ascii_lower(r[4]) if picked and r[4] is not None else r[4])), ""
            for parts, j in ((tree, i), (top, k)):
                for nodes in parts[:-1]:
                    first = j // fanout * fanout
                    run, slot = nodes[first : first + fanout], j - first
                    siblings += "".join(run[:slot] + run[slot + 1 :])
                    h = sha("".join([*run[:slot], h, *run[slot + 1 :]]))
                    j //= fanout
            out.append((r[0], tree[0][i], tree[-1][0], root, sha(siblings), h, h == root))
    return sorted(out, key=repr)


def manifest_rows():
    rng = random.Random(3)
    rows = [
        (None if i % 34 == 0 else 5 if i % 17 == 0 else i, rng.choice(["b", "a", None, "ü", f"s{rng.randint(0, 50)}", "hot", "hot"]),
         rng.choice(["x", None]), rng.choice([3, None]), rng.choice([None, "", "Aé b", f"T{i}"]))
        for i in range(700)
    ]
    return rows + [(7, "hot", "x", 1, "Same")] * 40 + [(9000, "alone", None, None, "L" * 300_000)]


@pytest.mark.parametrize(("fanout", "levels"), [(16, 3), (2, 2), (3, 1)])
def test_manifest_against_brute_force(spark, fanout, levels, monkeypatch):
    whole = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda x: whole(x, fanout, levels))
    docs = clashing(spark.createDataFrame(manifest_rows(), "doc_id long, source string, lang string, n_chars long, text string"))
    assert rows_of(merkle.verify_documents(docs)) == brute_manifest(manifest_rows(), fanout)


def test_manifest_of_nothing_and_of_one(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert merkle.verify_documents(spark.createDataFrame([], schema)).count() == 0
    row = (1, None, None, None, None)
    got = merkle.verify_documents(spark.createDataFrame([row], schema)).head()
    assert got.leaf == got.subroot == got.root == sha("1:1----") and got.verified and got.proof_sha256 == sha("")


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 600])
def test_sweeps_hand_every_leaf_its_siblings(n):
    leaves = [sha(str(i)) for i in range(n)]
    levels = merkle.n_levels(n, 4)
    top, children = merkle.sweep_up(leaves, levels, 4)
    for leaf, proof in zip(leaves, merkle.sweep_down(n, children, levels, (("x", "y"),), 4), strict=True):
        assert proof[-1] == ("x", "y") and len(proof) == levels + 1
        for before, after in proof[:-1]:
            leaf = sha(before + leaf + after)
        assert leaf == top


# main text of pages

def test_blocks_of_broken_markup():
    page = (
        "<!doctype html><title>no</title><body><p class='aB c-d'>one <b>two<br>three&nbsp;&amp;x<p>four<ul><li>five<li><a href=x>six</a></ul>"
        "<script>var a='</p>';</script><!-- gone --><div id=z>sev<i>en</i></p>  </div>eight<!-- open <p>never</p>"
    )
    found = list(blocks(page))
    assert [b.text for b in found] == ["one two three &x", "four", "five", "six", "seven", "eight"]
    assert found[0].path == ["body", "p.", "a", "b", "c", "d"]
    assert found[3].link == 1 and found[2].link == 0
    assert list(blocks("")) == [] and [b.text for b in blocks("a < b <")] == ["a < b <"]
    for evil in ("<a " * 200_000, "<a b='" * 100_000, "<!--" * 200_000, "</" * 300_000, "<script>" * 100_000):
        assert len(list(blocks(evil))) <= 1


def test_gradients_of_the_labeller():
    maker = html_text.PageMaker(["Some words that make a text.", "And a few more of them."], 7)
    found = [list(blocks(maker.page())) for _ in range(3)]
    labels = [np.array([b.kept == "1" for b in f], float) for f in found]
    model = html_text.Labeller(1)
    model.p = {k: v.astype(float) for k, v in model.p.items()}
    pages = [html_text.features(f) for f in found]
    _, grads = model.gradients(pages, labels)
    for name, table in model.p.items():
        at = np.unravel_index(np.abs(grads[name]).argmax(), table.shape)
        old, sides = table[at], []
        for step in (1e-3, -1e-3):
            table[at] = old + step
            sides.append(model.gradients(pages, labels)[0])
        table[at] = old
        assert (sides[0] - sides[1]) / 2e-3 == pytest.approx(grads[name][at], rel=1e-2)


def test_batches_do_not_change_probabilities():
    maker, model = html_text.PageMaker(["Some words of a text."], 8), html_text.Labeller(2)
    pages = [html_text.features(list(blocks(maker.page()))) for _ in range(5)]
    for page, own in zip(pages, model.probabilities(pages), strict=True):
        assert model.probabilities([page])[0] == pytest.approx(own, abs=1e-5)


@pytest.fixture(scope="module")
def labeller(spark, sf_dir):
    return html_text.train(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def test_main_text_of_held_out_layouts(spark, sf_dir, labeller):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    prose = [b.text for r in pages for b in blocks(r.html) if len(b.text) >= 40 and b.link < 0.3]
    maker = html_text.PageMaker(prose, 99)
    right = total = 0
    for _ in range(150):
        found = list(blocks(maker.page()))
        kept = labeller.probabilities([html_text.features(found)])[0] >= html_text.KEEP
        right += sum(k == (b.kept == "1") for k, b in zip(kept, found, strict=True))
        total += len(found)
    assert right / total > 0.93


def test_main_text_of_the_given_pages(spark, sf_dir, labeller):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    right = 0
    for r, source in zip(html_text.extract(pages.orderBy("page_id"), labeller).orderBy("page_id").collect(), pages.orderBy("page_id").collect(), strict=True):
        article = [b.text for b in blocks(source.html) if any(p.rstrip(".") == "article" for p in b.path) and not {"footer", "footer."} & set(b.path)]
        right += r.text == "\n\n".join(article)
        assert r.n_chars == len(r.text)
    assert right / pages.count() > 0.95


def test_main_text_of_odd_pages(spark, labeller):
    article = "<html><body><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>A title of it</h1>" + "<p>Some words &eacute; of a text that goes on.</p>" * 3
    rows = [(1, "u", article), (1, "u", article), (2, None, None), (3, "", ""), (None, "v", "<p> </p>"), (4, "w", article + "<p>And more words here.</p>" * 30_000)]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string")).withColumn("text", F.lit("t")).withColumn("n_blocks", F.lit(1))
    got = {(r.page_id, r.url): r for r in html_text.extract(pages, labeller).collect()}
    assert html_text.extract(pages, labeller).count() == len(rows)
    assert got[1, "u"].text == "\n\n".join(["A title of it"] + ["Some words é of a text that goes on."] * 3)
    assert [got[k].text for k in ((2, None), (3, ""), (None, "v"))] == ["", "", ""]
    assert got[4, "w"].n_blocks == 30_005 and got[4, "w"].text.count("And more") > 29_000
    assert html_text.extract(pages.limit(0), None).count() == 0
    assert html_text.train(pages.limit(0)) is None
    assert html_text.extract(pages.where("page_id = 1"), None).head().text.startswith("A title")


# ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, top):
    found = [(d, Counter(TERM.findall(ascii_lower(t or "")))) for d, t in docs]
    found = [(d, c) for d, c in found if c]
    n_docs, n_terms = len(found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    asked = defaultdict(list)
    for i, t in items:
        asked[i] += TERM.findall(ascii_lower(t or ""))
    out = []
    for i, terms in asked.items():
        scores = []
        for d, c in found:
            m = 100 - 25 + 25 * c.total() * n_docs // n_terms
            w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms}
            score = sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms if c[t])
            if score > 0:
                scores.append((-score, d is not None, d or 0, d))
        out += [(i, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def search_rows():
    rng = random.Random(1)
    names = [f"w{i}" for i in range(40)] + ["the", "of", "Ünï", "été", "x1"]

    def text(n):
        return " ".join(rng.choices(names, weights=[1 / (i + 1) for i in range(len(names))], k=n))

    docs = [(i, text(rng.randint(0, 40))) for i in range(900)]
    docs += [(None, text(9)), (3, "The the of"), (3, "The the of"), (9, None), (10, ""), (11, "É é A-b_c"), (12, "the " * 50_000)]
    items = [(i, text(rng.randint(1, 30))) for i in range(25)]
    items += [(5, "the the"), (70, None), (71, ""), (72, "nowhere"), (None, "of x1"), (73, "é a É")]
    return docs, items


@pytest.mark.parametrize(("top", "shard", "block"), [(20, 4096, 1 << 18), (3, 50, 150), (20, 7, 1 << 18)])
def test_ranked_search_against_brute_force(spark, top, shard, block):
    docs, items = search_rows()
    left = clashing(spark.createDataFrame(docs, "doc_id long, text string")).repartition(3)
    right = clashing(spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(ranked_search.search(left, right, top, shard, block)) == brute_search(docs, items, top)


def test_ranked_search_of_nothing(spark):
    docs, items = search_rows()
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert ranked_search.search(left.limit(0), right).count() == 0
    assert ranked_search.search(left, right.limit(0)).count() == 0


def test_pair_bounds_skip_more_than_single_ones_and_lose_nothing():
    rng = random.Random(5)
    # two frequent terms that seldom meet, and a rare one
    texts = [["a"] * 3 if i % 2 else ["b"] * 3 for i in range(400)] + [["a", "b"] + ["z"] * 20] * 3 + [["c", "a"]] * 30
    rng.shuffle(texts)
    asked = ranked_search.Items([1], {b"a": 0, b"b": 1, b"c": 2}, [[(0, 1), (1, 2), (2, 1)]])
    rows = [[({"a": 0, "b": 1, "c": 2}[t], n) for t, n in Counter(x).items() if t != "z"] for x in texts]
    starts, places, counts = ranked_search._lists(rows, 3)
    lengths = np.array([len(x) for x in texts])
    asked.weigh(len(texts), np.diff(starts))
    impact = ranked_search.impacts(counts, lengths[places], len(texts), int(lengths.sum()))
    most = np.maximum.reduceat(impact, starts[:-1])
    best = {p: 0 for p in asked.pair_at}
    for r in range(len(texts)):
        own = {t: int(impact[starts[t] : starts[t + 1]][places[starts[t] : starts[t + 1]] == r][0]) for t, _ in rows[r]}
        for a, b in best:
            if a in own and b in own:
                best[a, b] = max(best[a, b], int(asked.weights[a]) * own[a] + int(asked.weights[b]) * own[b])
    order = sorted(asked.asked[0], key=lambda x: x[1] * asked.weights[x[0]] * most[x[0]])
    single = [int(n * asked.weights[t] * most[t]) for t, n in order]
    bound = ranked_search.bounds(order, single, best)
    assert bound[-1] < sum(single)
    for k in range(len(order) + 1):
        for r in range(len(texts)):
            own = {t: int(impact[starts[t] : starts[t + 1]][places[starts[t] : starts[t + 1]] == r][0]) for t, _ in rows[r]}
            assert sum(n * int(asked.weights[t]) * own.get(t, 0) for t, n in order[:k]) <= bound[k]
