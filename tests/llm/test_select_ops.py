"""Near-duplicates, mixing, scoring, search, fingerprints: brute force and odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragspark.llm import grulm, minhash, mixing, normsearch, sketch

from .conftest import DOCS, SF, rows


# ---- DartMinHash ----------------------------------------------------------------

def _shingles(text, lower=True):
    w = (text or "").lower().split() if lower else (text or "").split()
    if not w:
        return frozenset()
    return frozenset(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else frozenset([tuple(w)])


def _jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


DOCS_2 = "doc_id bigint, text string"


def _brute_classes(pairs):
    """Least id of each component of texts with similarity 0.8 or more."""
    sets = [(i, _shingles(t)) for i, t in pairs]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and (a == b or _jaccard(a, b) >= 0.8):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return sorted((i, find(i)) for i, _ in sets)


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(0)
    for weights in (np.ones(200), rng.random(200) * 3 + 0.05, np.ceil(rng.random(200) * 4)):
        other, error = weights * rng.choice([1, 0.5], 200), []
        for _ in range(25):
            x = rng.integers(1, 2 ** 63, 200).astype(np.uint64)
            same = (minhash.signature(x, weights) == minhash.signature(x, other)).mean()
            error.append(same - np.minimum(weights, other).sum() / np.maximum(weights, other).sum())
        assert abs(np.mean(error)) < 0.025
    one = minhash.signature(np.array([7], np.uint64), np.ones(1))
    assert (one != minhash._NONE).all()


def test_op1_whole_table(llm, queries, docs):
    got = rows(queries["op1_dart_minhash"](llm, SF))
    assert sorted(got) == _brute_classes(docs.select("doc_id", "text").collect())


def _near_group(n, seed, base_words=300, edits=6):
    """A large group of near copies, each with a few words of its own changed."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randint(0, 10**6)}" for _ in range(base_words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 10**9)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def planted(llm):
    rnd = random.Random(8)
    texts = _near_group(60, 1) + _near_group(40, 2, 150, 4) + ["exact copy of one text that many rows share here"] * 50
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"u{rnd.randint(0, 10**9)}" for _ in range(80)) for _ in range(40)]   # a shared passage
    texts += [" ".join(f"v{rnd.randint(0, 10**9)}" for _ in range(rnd.randint(1, 50))) for _ in range(60)]
    rnd.shuffle(texts)
    return [(i + 100, t) for i, t in enumerate(texts)]


def test_op1_planted_groups_passages_and_copies(llm, planted):
    d = llm.createDataFrame(planted, "doc_id bigint, text string")
    assert sorted(rows(minhash.classes(d))) == _brute_classes(planted)


def test_op1_cells_find_links_between_non_hubs(llm, planted, monkeypatch):
    """With tiny cells and hubs that link nothing, the cell search alone finds all links."""
    monkeypatch.setattr(minhash, "CELL", 7)
    real, calls = minhash._settle, []

    def settle(pairs, *args):
        calls.append(1)
        return real(pairs.limit(0), *args)
    monkeypatch.setattr(minhash, "_settle", settle)
    some = [(i, t) for i, t in planted if len(t.split()) > 120][:70]
    got = dict(rows(minhash.classes(llm.createDataFrame(some, "doc_id bigint, text string"))))
    size = lambda c: Counter(Counter(c.values()).values())
    want = dict(_brute_classes(some))
    # buckets of two members are left to the stars, so only groups that share larger buckets are joined here
    assert len(calls) == 1 and max(size(got)) >= 0.9 * max(size(want))


def test_op1_odd_rows(odd_docs, no_docs):
    got = defaultdict(list)
    for i, c in minhash.classes(odd_docs).collect():
        got[i].append(c)
    assert got == {1: [1], 2: [2], 3: [3], 4: [4], 5: [5, 5], 6: [5], 7: [7], 8: [8], 9: [9], 10: [10], None: [None]}
    assert minhash.classes(no_docs).count() == 0
    kept = minhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10]


def test_op1_rows_without_ids(llm):
    """Near copies are found whether their rows have ids or not; one row of each group stays."""
    texts = _near_group(12, 3, edits=3) + _near_group(8, 4, edits=2)
    rows_ = [(i if i % 2 else None, t) for i, t in enumerate(texts[:12], 1)] + [(None, t) for t in texts[12:]]
    rows_ += [(None, "a text of its own without an id at all"), (None, None), (None, " "), (90, "alone"), (90, "alone")]
    d = llm.createDataFrame(rows_, DOCS_2).withColumn("class_id", F.lit("clash"))
    number = [10 ** 6 + n if i is None else i for n, (i, _) in enumerate(rows_)]
    least = dict(_brute_classes([(n, t) for n, (_, t) in zip(number, rows_)]))
    want = [(i, least[n] if least[n] < 10 ** 6 else None) for n, (i, _) in zip(number, rows_)]
    assert any(i is None and c is not None for i, c in want) and any(i is not None and c != i for i, c in want)
    assert sorted(((r.doc_id, r["class_id"]) for r in minhash.classes(d).collect()), key=repr) == sorted(want, key=repr)
    kept = [(r.doc_id, r.text) for r in minhash.keep_one(d).collect()]
    groups = {least[n] for n in number}
    assert len(kept) == len(groups)
    for g in groups:
        mine = {t for n, (_, t) in zip(number, rows_) if least[n] == g}
        assert sum(t in mine and (g >= 10 ** 6 or i == g) for i, t in kept) == 1


def test_components_of_a_long_path_and_stars(llm):
    rnd = random.Random(0)
    ids = list(range(400))
    rnd.shuffle(ids)
    edges = list(zip(ids[:200], ids[1:200])) + [(ids[200], x) for x in ids[201:350]] + [(ids[399], ids[399])]
    got = dict(map(tuple, minhash.components(llm.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert {got[x] for x in ids[:200]} == {min(ids[:200])} and {got[x] for x in ids[200:350]} == {min(ids[200:350])}
    assert minhash.components(llm.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---- mixing ---------------------------------------------------------------------

def _water_fill(budget, nodes):
    """Share a budget by weight among [(capacity, weight)], filling up the small ones first."""
    out, open_, left = [0.0] * len(nodes), [i for i, (_, w) in enumerate(nodes) if w > 0], float(budget)
    while open_:
        total = sum(nodes[i][1] for i in open_)
        full = [i for i in open_ if nodes[i][0] <= left * nodes[i][1] / total + 1e-9]
        if not full:
            for i in open_:
                out[i] = left * nodes[i][1] / total
            break
        for i in full:
            out[i] = nodes[i][0]
        left -= sum(nodes[i][0] for i in full)
        open_ = [i for i in open_ if i not in full]
    return out


def test_op6_matches_sql(llm, queries):
    import duckdb
    from ragspark.llm import registry
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    rel = con.execute(registry.oracle_sql()["op6_budget_mix"])
    cols = [c[0] for c in rel.description]
    got = queries["op6_budget_mix"](llm, SF)
    assert set(got.columns) == set(cols)
    assert rows(got.select(*cols)) == sorted(map(tuple, rel.fetchall()), key=repr)


def test_op6_shares_among_siblings_before_ancestors(llm):
    leaves = [("a", "x", "s1", 10), ("a", "x", "s2", 1000), ("a", "y", "s1", 5), ("b", "x", "s1", 40), ("b", "x", "s2", 0), ("c", "z", "s", 500)]
    d = llm.createDataFrame(leaves, "domain string, lang string, source string, capacity bigint")
    w = [F.when(F.col("domain") == "c", 0).otherwise(F.when(F.col("domain") == "a", 2).otherwise(1)), F.lit(1), F.lit(1)]
    got = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixing.allocate(d, mixing.LEVELS, w, F.lit(300)).collect()}
    a, b = _water_fill(300, [(1015, 2), (40, 1)])
    ax, ay = _water_fill(a, [(1010, 1), (5, 1)])
    s1, s2 = _water_fill(ax, [(10, 1), (1000, 1)])
    assert [got["a", "x", "s1"], got["a", "x", "s2"], got["a", "y", "s1"], got["b", "x", "s1"], got["b", "x", "s2"],
            got["c", "z", "s"]] == [int(s1), int(s2), int(ay), int(b), 0, 0]
    assert int(a) == 260 and int(s2) == 245            # b's and y's shortages went where they should


def test_op6_takes_exact_budgets_and_prefixes(llm, docs):
    tree = mixing.tree_rows(docs, mixing.domain_of(F.col("source")))
    leaves, starts = mixing.plan(tree, mixing.LEVELS, mixing.target_weights(), 0.5, 2)
    want = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in leaves.collect()}
    got = mixing.mix(tree, mixing.target_weights(), 0.5, 2).groupBy(*mixing.LEVELS).agg(F.sum("take_tokens").alias("n")).collect()
    for r in got:
        assert r["n"] == want[r["domain"], r["lang"], r["source"]]
    total = tree.agg(F.sum("n_tokens")).first()[0]
    assert total * 0.5 - len(want) * 4 <= sum(want.values()) <= total * 0.5
    order = defaultdict(list)
    for r in starts.collect():
        order[r["domain"], r["lang"], r["source"]].append((r["_key"], r["_id"], r["start"], r["n_tokens"]))
    for leaf in order.values():                        # starts are the running sums of the leaf's seeded order
        at = 0
        for _, _, start, n in sorted(leaf):
            assert start == at
            at += n


def test_op6_odd_rows(odd_docs, no_docs):
    d = odd_docs.withColumn("source", F.col("source"))
    tree = mixing.tree_rows(d, mixing.domain_of(F.col("source")))
    out = mixing.mix(tree, mixing.target_weights(), 0.7, 3).collect()
    assert all(r["take_tokens"] <= r["n_tokens"] for r in out)
    total = tree.agg(F.sum("n_tokens")).first()[0]
    assert sum(r["take_tokens"] for r in out) <= 0.7 * total
    empty = mixing.tree_rows(no_docs, mixing.domain_of(F.col("source")))
    assert mixing.mix(empty, mixing.target_weights(), 0.7, 3).count() == 0
    taken = mixing.take(odd_docs, mixing.domain_of(F.col("source")), mixing.target_weights(), 1.0)
    assert taken.columns == odd_docs.columns and taken.where("text is not null and trim(text) <> ''").count() >= 9
    assert mixing.take(no_docs, mixing.domain_of(F.col("source")), mixing.target_weights(), 0.5).count() == 0


def test_op6_take_is_the_one_pass_mix(llm, docs):
    dom, w = mixing.domain_of(F.col("source")), mixing.target_weights()
    got = sorted(r["doc_id"] for r in mixing.take(docs, dom, w, 0.6).collect())
    want = sorted(r["doc_id"] for r in mixing.mix(mixing.tree_rows(docs, dom), w, 0.6, 1).collect())
    assert got == want and 0 < len(got) < docs.count()


# ---- LM scoring -----------------------------------------------------------------

def test_op7_counts_and_base(llm, queries, docs):
    words = lambda t: (t or "").encode().lower().split()
    pairs = docs.select("doc_id", "text").collect()
    learn = [t for i, t in pairs if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for t in learn for w in words(t))
    n, z = sum(c.values()) + len(learn), 0.0
    z = n + 0.1 * (len(c) + 2)
    base = score = 0.0
    got = {r["doc_id"]: r for r in queries["op7_gru_score"](llm, SF).collect()}
    assert len(got) == len(pairs)
    for i, t in pairs:
        w, r = words(t), got[i]
        want = sum(math.log10((c[x] + 0.1) / z) for x in w) + math.log10((len(learn) + 0.1) / z)
        assert r["n_tokens"] == len(w) + 1 and r["n_known"] == sum(c[x] > 0 for x in w) + 1 and r["train_tokens"] == n
        assert r["base_score"] == pytest.approx(want, rel=1e-9) and r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)
        if r["held_out"]:
            base, score = base + want, score + r["score"]
    assert score > base                                # better than the counts on texts it has not seen


def test_op7_each_distinct_word_of_a_batch_is_looked_up_once():
    import pyarrow as pa
    rnd = random.Random(7)
    texts = ["".join(rnd.choice(" \n\t\x0b\x0c\r abcDEÉé.日\x1c\x85\x00🙂") for _ in range(rnd.randint(0, 40))) for _ in range(500)]
    texts += [None, "", " ", "\n\n", "x" * 100_000]
    column = pa.array(["sliced off", *texts])[1:]
    got = []
    for start, words, place, first in grulm.tokens(column):
        assert start == len(got) and len(set(words)) == len(words)
        got += [[words[k] for k in place[a:b]] for a, b in zip(first, first[1:])]
    assert got == [(t or "").encode().lower().split() for t in texts]
    assert [len(x[1]) for x in grulm.tokens(pa.array(["A a b"] * 1000))] == [2]
    assert list(grulm.tokens(pa.array([], pa.string()))) == []


def _tiny(lm_words=6):
    words = [b"a", b"b", b"c", b"d", b"e", b"f"][:lm_words]
    return grulm.Vocabulary(words, np.array([9, 7, 5, 4, 3, 2][:lm_words]), 33, 7, 3, 0)


def test_op7_probabilities_sum_to_one():
    v = _tiny()
    net = grulm.new_net(v, hidden=4)
    rng = np.random.default_rng(0)
    net.wc[:], net.ww[:] = rng.standard_normal(net.wc.shape), rng.standard_normal(net.ww.shape)
    h = np.repeat(rng.standard_normal((1, 4)).astype(np.float32), len(net.cls), axis=0)
    assert np.exp(grulm._log_probs(net, h, np.arange(len(net.cls)))).sum() == pytest.approx(1, abs=1e-5)
    known = sum(10 ** v.log10(c) for c in v.counts) + 10 ** v.log10(v.ends)
    assert known + v.rare_mass == pytest.approx(1)


def test_op7_gradients():
    """Back-propagation through one window against finite differences of the loss."""
    v = _tiny()
    rng = np.random.default_rng(1)
    net = grulm.new_net(v, hidden=5)
    for k in net.WEIGHTS:
        setattr(net, k, (getattr(net, k) + rng.standard_normal(getattr(net, k).shape) * 0.3).astype(np.float64))
    ids = [rng.integers(0, 8, 7) for _ in range(3)]
    ids = [np.where(x == grulm.END, grulm.RARE, x) for x in ids]
    n = sum(len(x) + 1 for x in ids)
    flat = net.flat()
    own = grulm.Net(**net.__dict__).load(flat)
    first = np.full(flat.size, 1e6, np.float32)        # so large that a step is rate * gradient / 1000
    grulm.train_ids(own, first, ids, rate=1000.0)
    moved = flat - own.flat()
    for at in rng.choice(flat.size, 40, replace=False):
        up, down = flat.copy(), flat.copy()
        up[at] += 1e-2
        down[at] -= 1e-2
        slope = -(grulm.score_ids(grulm.Net(**net.__dict__).load(up), ids).sum()
                  - grulm.score_ids(grulm.Net(**net.__dict__).load(down), ids).sum()) / 2e-2 / n
        assert moved[at] == pytest.approx(slope, abs=3e-3)


def test_op7_state_is_carried_and_lanes_do_not_matter():
    v = _tiny()
    net = grulm.new_net(v, hidden=4)
    rng = np.random.default_rng(2)
    ids = [np.where((x := rng.integers(0, 8, n)) == grulm.END, 0, x) for n in (0, 1, 500, 3, 90, 1)]
    together = grulm.score_ids(net, ids)
    alone = [grulm.score_ids(net, [x])[0] for x in ids]
    assert np.allclose(together, alone, atol=1e-3)
    split = grulm.score_ids(net, [ids[2][:250], ids[2][250:]]).sum()
    assert abs(split - together[2]) > 1e-3             # a cut document is another one


def _window(words=1500):
    """A network of many classes and the ids of one full training window."""
    counts = (100_000 / np.arange(1, words + 1)).astype(np.int64)
    v = grulm.Vocabulary([b"%d" % i for i in range(words)], counts, int(counts.sum()) + 128, words + 1, 128, 0)
    rng = np.random.default_rng(3)
    share = np.concatenate(([20_000, 0], counts)) / (20_000 + counts.sum())
    return grulm.new_net(v), [rng.choice(words + 2, 23, p=share).astype(np.int32) for _ in range(128)]


def test_op7_a_window_takes_few_calls_per_class():
    """Arithmetic on whole windows: the softmax of a class is three products (47 calls per class before)."""
    import sys
    net, ids = _window()
    grown, calls = np.full(net.flat().size, 1e-8, np.float32), [0]

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")
    once = lambda n: grulm.train_ids(net, grown, [np.tile(x, n) for x in ids])
    once(1)
    by_windows = []
    for n in (2, 12):                                      # windows
        calls[0] = 0
        sys.setprofile(count)
        once(n)
        sys.setprofile(None)
        by_windows.append(calls[0])
    classes = len(net.first) - 1
    assert classes > 30 and (by_windows[1] - by_windows[0]) / 10 < 25 * classes


def test_op7_rows_of_a_key_are_added_up():
    rng = np.random.default_rng(5)
    keys = np.concatenate((rng.integers(3, 400, 900), np.full(70, 2), np.arange(500, 520), np.repeat([600, 601], [8, 9])))
    rng.shuffle(keys)
    rows = rng.standard_normal((len(keys), 6)).astype(np.float32)
    got, sums = grulm._sum_by(rows, keys, grulm.Space())
    want = np.zeros((602, 6))
    np.add.at(want, keys, rows)
    assert got.tolist() == sorted(set(keys.tolist())) and np.allclose(sums, want[got], atol=1e-4)


def test_op7_buffers_are_used_again():
    space = grulm.Space()
    a = space("a", 10, 4)
    assert space("a", 3, 5).base is a.base and space("b", 10, 4).base is not a.base
    assert space("a", 100, 4).shape == (100, 4)


def test_op7_odd_lanes_make_whole_windows():
    """Lanes longer than the blocks that windows are cut from, and lanes that end early."""
    rng = np.random.default_rng(6)
    ids = [rng.integers(2, 8, n).astype(np.int32) for n in (5000, 3, 0, 1700)]
    seen = [[] for _ in ids]
    for x, y, d in grulm.Lanes.deal(ids, 3).windows(24):
        assert x.shape == y.shape == d.shape and len(x) <= 24
        for lane in range(x.shape[1]):
            for doc, target in zip(d[:, lane].tolist(), y[:, lane].tolist()):
                assert (doc < 0) == (target < 0)
                if doc >= 0:
                    seen[doc].append(target)
    assert seen == [[*x.tolist(), grulm.END] for x in ids]


def test_op7_learns_from_every_text_of_a_large_corpus(llm):
    """20 million learning tokens by the counts: the words of all three texts move."""
    v = grulm.Vocabulary([b"a", b"b", b"c", b"d", b"e", b"f"], np.array([9, 7, 5, 4, 3, 2]), 20_000_000, 7, 3, 0)
    texts = llm.createDataFrame([(1, "a b a b"), (2, "c d c d"), (3, "e f e f")], "i bigint, t string")
    moved = np.abs(grulm.train(texts, v).x - grulm.new_net(v).x).max(1)
    assert (moved[2:] > 0).all()


def test_op7_scores_do_not_depend_on_the_partitions(docs, monkeypatch):
    monkeypatch.setattr(grulm, "REPLICA", 40_000)          # several replicas, some in several sittings
    monkeypatch.setattr(grulm, "PER_WEIGHT", 0)
    a, b = ({r["doc_id"]: r["score"] for r in grulm.score(docs.repartition(n)).collect()} for n in (4, 32))
    assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i], rel=1e-6) for i in a)


def test_op7_vocabulary_grows_with_the_corpus():
    counts = (10_000_000 / np.arange(1, 200_001)).astype(np.int64)
    sizes = [grulm.Vocabulary([b""] * len(counts), c, int(c.sum()), len(c), 1, 0).lm_size for c in (counts, counts * 4, counts * 16)]
    assert sizes[0] > 2_048 and sizes[0] < sizes[1] < sizes[2] <= grulm.LM_WORDS


def test_op7_odd_rows(llm, odd_docs, no_docs):
    got = grulm.score(odd_docs).collect()
    assert len(got) == 12 and all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert {r["doc_id"]: r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3, 4, 7)} == {1: 1, 2: 1, 3: 1, 4: 2, 7: 30001}
    assert grulm.score(no_docs).count() == 0
    unlearned = llm.createDataFrame([(None, "a b", None, None, 3)], DOCS)
    r = grulm.score(unlearned).first()
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and np.isfinite(r["score"])


def test_op7_counts_beyond_the_head_come_by_the_join(docs, monkeypatch):
    whole = {r["doc_id"]: r for r in grulm.score(docs).collect()}
    monkeypatch.setattr(grulm, "HEAD_WORDS", 300)
    real = grulm.vocabulary
    monkeypatch.setattr(grulm, "vocabulary", lambda c, n: real(c, n, 300))
    for r in grulm.score(docs).collect():
        assert r["n_known"] == whole[r["doc_id"]]["n_known"]
        assert r["base_score"] == pytest.approx(whole[r["doc_id"]]["base_score"], rel=1e-9)


# ---- exact search ---------------------------------------------------------------

def _brute_top(pairs, k):
    vs = {}
    for i, v in pairs:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = tuple(math.floor(64 * float(np.float32(c))) for c in v)
        vs[i] = min(vs.get(i, x), x, key=lambda y: np.array(y, "<i4").tobytes())
    out = []
    for q, a in vs.items():
        if q % 20 == 0:
            best = sorted((-sum(s * t for s, t in zip(a, b)), i) for i, b in vs.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_op8_whole_table(llm, queries):
    pairs = llm.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    assert sorted(rows(queries["op8_norm_bucket_search"](llm, SF))) == _brute_top(pairs, 20)


@pytest.mark.parametrize("ties", [False, True])
def test_op8_many_slabs_blocks_and_ties(llm, monkeypatch, ties):
    monkeypatch.setattr(normsearch, "BUCKET", 16)
    monkeypatch.setattr(normsearch, "SLAB", 64)
    monkeypatch.setattr(normsearch, "BLOCK", 128)
    rng = np.random.default_rng(3)
    v = rng.standard_normal((700, 5)) * rng.choice([0.1, 1, 4], (700, 1))
    if ties:
        v[::2] = v[0]
    pairs = [(int(i) * 5, [float(np.float32(x)) for x in r]) for i, r in zip(rng.permutation(700), v)]
    d = llm.createDataFrame(pairs, "vec_id bigint, embedding array<float>")
    assert sorted(rows(normsearch.top_k(d, F.col("vec_id") % 20 == 0, 7))) == _brute_top(pairs, 7)


def test_op8_search_against_brute_force():
    rng = np.random.default_rng(0)
    for trial in range(80):
        n, d, k = rng.integers(1, 300), rng.integers(1, 10), int(rng.integers(1, 8))
        v = rng.integers(-6, 7, (n, d)).astype(float) * rng.choice([1, 1, 5, 20], (n, 1))
        if trial % 3 == 0:
            v[:] = v[rng.integers(0, max(1, n // 20), n)]
        ids = rng.permutation(10_000)[:n]
        o = np.lexsort((ids, -np.sqrt((v * v).sum(1))))
        v, ids = v[o], ids[o]
        q = rng.choice(n, min(20, n), replace=False)
        s = normsearch._Search(v[q], ids[q], np.full(len(q), -np.inf), k)
        for a in range(0, n, 37):
            s.bucket(v[a:a + 37], ids[a:a + 37])
        for j in range(len(q)):
            m = ids != ids[q[j]]
            full = (v[m] @ v[q[j]]).astype(int)
            best = np.lexsort((ids[m], -full))[:k]
            assert list(zip(s.vec[s.row == j], s.score[s.row == j])) == list(zip(ids[m][best], full[best]))


def test_op8_prunes():
    rng = np.random.default_rng(1)
    v = rng.standard_normal((2000, 8)) * np.exp(rng.standard_normal((2000, 1)))
    v = np.floor(64 * v[np.argsort(-np.sqrt((v * v).sum(1)))])
    s = normsearch._Search(v[:50], np.arange(50), np.full(50, -np.inf), 5)
    for a in range(0, 2000, 100):
        s.bucket(v[a:a + 100], np.arange(a, a + 100))
    assert s.verified < 0.5 * 50 * 2000


def test_op8_odd_rows(llm):
    big = 3.0e38
    pairs = [(0, [1.0, 2.0]), (20, None), (40, [1.0, None]), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]), (100, []),
             (120, [1.0]), (140, [1.0, 2.0]), (140, [1.0, 2.0]), (141, [0.0, 0.0]), (None, [1.0, 1.0]), (3, [-1.0, -2.0, 0.5])]
    d = llm.createDataFrame([(*p, 1, 2) for p in pairs], "vec_id bigint, embedding array<float>, rank int, score int")
    got = sorted(rows(normsearch.top_k(d, F.col("vec_id") % 20 == 0, 3)))
    padded = [(i, None if v is None else [*v, *[0.0] * (3 - len(v))]) for i, v in pairs]
    assert got == _brute_top(padded, 3)
    assert normsearch.top_k(d.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    huge = llm.createDataFrame([(0, [big, 1.0]), (1, [1.0, -big]), (2, [2.0, 2.0])], "vec_id bigint, embedding array<float>")
    assert [r["vec_id"] for r in normsearch.top_k(huge, F.col("vec_id") == 0).orderBy("rank").collect()] == [2, 1]


def test_op8_extreme_components_are_exact(llm):
    rng = np.random.default_rng(8)
    size = rng.choice([1.0, 1e3, 1e9, 1e12, 1e30, 1e300], (160, 1))
    pairs = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((160, 4)) * size)]
    pairs += [(500, [2.0 ** 31 / 64, 1.0, 0.0, 0.0]), (501, [-(2.0 ** 31) / 64, 3.0, 0.0, 0.0]), (502, [1.7e308, 1.0, 1.0, 1.0])]
    d = llm.createDataFrame(pairs, "vec_id bigint, embedding array<double>")
    whole = {i: [math.floor(64 * x) for x in v] for i, v in pairs if i != 502}       # 64 * 1.7e308 overflows
    held = lambda x: max(-(2 ** 63 - 1), min(2 ** 63 - 1, x))                        # noqa: E731
    want = []
    for q in whole:
        if q % 20 == 0:
            best = sorted((-held(sum(a * b for a, b in zip(whole[q], v))), i) for i, v in whole.items() if i != q)[:20]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(rows(normsearch.top_k(d, F.col("vec_id") % 20 == 0))) == sorted(want)


# ---- fingerprints ---------------------------------------------------------------

def _brute_edits(pairs):
    """(id, edited text, next text); rows of a null id have no next."""
    known = sorted(((i, t or "") for i, t in pairs if i is not None), key=lambda r: (-r[0], r[1]))
    out = []
    for n, (i, t) in enumerate(known):
        after = known[(n + 1) % len(known)][1]
        out.append((i, t, t[:len(t) - len(t) // 2] + after[:len(t) // 2], after))
    for i, t in pairs:
        if i is None:
            out.append((i, t or "", (t or "")[:len(t or "") - len(t or "") // 2], ""))
    return out


def _check_fingerprints(got, pairs):
    want = {(i, hashlib.sha256(e.encode()).hexdigest()): (t, e, after) for i, t, e, after in _brute_edits(pairs)}
    assert len(got) == len(pairs)
    by_text = {}
    for r in got:
        t, e, after = want[r["doc_id"], r["edited_sha256"]]
        assert r["n_chars"] == len(t)
        a, b, c = (_shingles(x, lower=False) for x in (t, e, after))
        exact = lambda x, y: 1.0 if not x and not y else len(x & y) / len(x | y)
        assert abs(r["near_edited"] - exact(a, b)) < 0.2 and abs(r["near_next"] - exact(a, c)) < 0.2
        if len(a | b) <= sketch.K:
            assert r["near_edited"] == pytest.approx(exact(a, b))
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        if len(a) < sketch.K:
            assert r["n_shingles"] == len(a)
        else:
            assert abs(r["n_shingles"] - len(a)) < 0.45 * len(a)


def test_op10_whole_table(llm, queries, docs):
    _check_fingerprints(queries["op10_bottom_k_fingerprint"](llm, SF).collect(), docs.select("doc_id", "text").collect())


def test_op10_odd_rows(llm, odd_docs, no_docs):
    _check_fingerprints(sketch.report(odd_docs).collect(), odd_docs.select("doc_id", "text").collect())
    assert sketch.report(no_docs).count() == 0
    one = llm.createDataFrame([(7, "a single row of a few words", "x")], "doc_id bigint, text string, sketch string")
    r = sketch.report(one).first()
    assert r["near_next"] == 1.0
    null = llm.createDataFrame([(None, "a b", None), (None, None, None)], "doc_id bigint, text string, lang string")
    assert sketch.report(null).count() == 2


def test_op10_sketches_merge_and_contain(llm):
    words = [f"w{i}" for i in range(900)]
    d = llm.createDataFrame([(" ".join(words[:500]), " ".join(words[496:]), " ".join(words))], "a string, b string, ab string")
    s = d.select(sketch.sketch(F.col("a")).alias("a"), sketch.sketch(F.col("b")).alias("b"), sketch.sketch(F.col("ab")).alias("ab"))
    r = s.select((sketch.merge(F.col("a"), F.col("b")) == F.col("ab")).alias("m"), sketch.containment(F.col("a"), F.col("ab")).alias("c"),
                 sketch.resemblance(F.col("a"), F.col("ab")).alias("j"), sketch.n_distinct(F.col("ab")).alias("n")).first()
    assert r["m"] and r["c"] > 0.75 and abs(r["j"] - 496 / 896) < 0.2 and abs(r["n"] - 896) < 0.35 * 896


def test_native_operators_run_no_python(llm, queries):
    for name in ("op6_budget_mix", "op10_bottom_k_fingerprint"):
        plan = queries[name](llm, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan, name
