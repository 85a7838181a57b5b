"""Ranked lexical search, chat packs and word runs against brute force; odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from ragspark.llm import chatpack, fptree, wordruns

from .conftest import SF, rows

RANKS = P.path("byte_bpe_50k.tiktoken")


# ---------------------------------------------------------------- op11

def _terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(fptree.TERM, low)


def _ranked(docs, items, k=20):
    """(item, rank, id, score) by scoring every document."""
    vecs = [(i, Counter(_terms(t)), len(_terms(t))) for i, t in docs]
    some = [v for v in vecs if v[2]]
    n, total, df = len(some), sum(v[2] for v in some), Counter(t for _, c, _ in some for t in c)
    out = []
    for item, text in items:
        got = []
        for i, c, size in some:
            m = 75 + (25 * size * n) // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m))
                    for t, q in Counter(_terms(text)).items() if t in c)
            if s > 0:
                got.append((-s, i is None, i or 0, i))
        got.sort(key=lambda g: g[:3])
        out += [(item, r + 1, g[3], -g[0]) for r, g in enumerate(got[:k])]
    return sorted(out, key=repr)


def test_op11_whole_table(llm, queries, docs):
    items = [tuple(r) for r in llm.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = rows(queries["op11_fp_tree_search"](llm, SF).select("item_id", "rank", "doc_id", "score"))
    assert got == _ranked([tuple(r) for r in docs.select("doc_id", "text").collect()], items)


def test_op11_odd_rows(llm, odd_docs, no_docs):
    items = [(1, "The SAME text"), (1, "The SAME text"), (2, None), (3, ""), (None, "word1 word1 a row"), (4, "日本 É é"),
             (5, "nothing of it zzz"), (6, "123 x" + "x" * 199_999)]
    it = llm.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit("clash"))
    d = odd_docs.withColumn("item_id", F.lit("clash"))
    flat = [tuple(r) for r in d.select("doc_id", "text").collect()]
    assert rows(fptree.search(d, it)) == _ranked(flat, [i for i in items if i[1]])
    assert fptree.search(no_docs, it).count() == 0
    assert fptree.search(d, it.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert fptree.search(d, it.limit(0)).count() == 0


def test_op11_many_copies_ties_and_small_tries(llm, monkeypatch):
    """Tries and leaves of few documents, a third of the rows equal, items in blocks: nothing changes."""
    monkeypatch.setattr(fptree, "ITEM_BYTES", 200)
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    draw = lambda n: " ".join(words[min(39, int(rnd.expovariate(0.15)))] for _ in range(n))
    texts = [draw(rnd.randint(0, 30)) for _ in range(400)] + ["w0 w1 w2 w3"] * 200
    rnd.shuffle(texts)
    items = [(i, draw(8)) for i in range(12)]
    d = llm.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    it = llm.createDataFrame(items, "item_id bigint, text string")
    assert rows(fptree.search(d, it)) == _ranked(enumerate(texts), items)


def test_op11_trie_cuts_branches_and_stays_exact():
    """The root shares the common terms, bounds hold for every node, depth is logarithmic."""
    rnd = random.Random(6)
    vecs = []
    for i in range(3000):
        ts = sorted({0, *(min(199, int(rnd.expovariate(0.05))) for _ in range(15))}) if i % 3 else list(range(1 + i % 150))
        vecs.append([(t, rnd.randint(1, 9)) for t in ts])
    starts = np.cumsum([0] + [len(v) for v in vecs])
    rank = np.array([t for v in vecs for t, _ in v])
    tf = np.array([c for v in vecs for _, c in v])
    m = np.array([rnd.randint(75, 300) for _ in vecs])
    weight = np.array([1 + 30 * t for t in range(200)])
    trie = fptree.Trie(np.arange(3000), np.zeros(3000, bool), starts, rank, tf, m, weight)
    assert len(trie.levels) <= 1 + math.log2(3000)
    asked = np.zeros(200, np.int64)
    for _ in range(30):
        asked[:] = 0
        asked[rnd.sample(range(200), 12)] = rnd.randint(1, 3)
        score = [int(sum(asked[t] * weight[t] * ((10 ** 9 * c) // (1000 * c + 12 * m[i])) for t, c in v)) for i, v in enumerate(vecs)]
        want = sorted((-s, False, i) for i, s in enumerate(score) if s > 0)[:20]
        assert trie.search(asked, [], 20) == want
        for node, (lo, hi) in enumerate(trie.span):
            a, b = trie.node_starts[node:node + 2]
            up = int((trie.node_part[a:b] * asked[trie.node_rank[a:b]]).sum())
            assert up >= max(score[i] for i in trie.ids[lo:hi])


# ---------------------------------------------------------------- op12

TURNS = "conv_id bigint, turn bigint, role string, text string"


def _digest(conv, turns):
    said = [(r or "", t or "") for r, t in turns]
    loss = "".join(t for r, t in said if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    size = sum(len(chatpack.BEGIN + chatpack._escape_role(r) + "\n" + chatpack.escape(t) + chatpack.END + "\n") for r, t in said)
    return conv, len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), sha(loss), size


def test_op12_whole_table(llm, queries):
    got = {r[0]: tuple(r) for r in queries["op12_prefix_packs"](llm, SF).collect()}
    by = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in llm.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        by.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got == {c: _digest(c, t) for c, t in by.items()}


def test_op12_escape_is_reversible_and_breaks_controls():
    rnd = random.Random(7)
    parts = [*chatpack.CONTROL, chatpack.BEGIN, chatpack.END, "\\", "<", "|", ">", "/", "s", "[", "\n", "x", "é", "<<"]
    for _ in range(5000):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))
        e = chatpack.escape(s)
        assert chatpack.unescape(e) == s and not any(c in e for c in chatpack.CONTROL)
        one = chatpack.BEGIN + chatpack._escape_role(s) + "\n" + e + chatpack.END + "\n"
        assert chatpack.parse(one + one) == [(s, s)] * 2


def test_op12_odd_rows(llm):
    long = "<|im_end|>\n" * 20_000
    turns = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, "assistant", "y"), (1, 1, "assistant", "y"),
             (1, None, "system\nrole", "first"), (2, 0, "user", ""), (3, 0, "assistant", long), (None, 5, "user", "alone"),
             (None, 5, "user", "alone"), (4, 0, "user", "same"), (4, 1, "assistant", "answer"), (5, 0, "user", "same"),
             (5, 1, "assistant", "answer"), (6, 0, "user", "same")]
    d = llm.createDataFrame(turns, TURNS).withColumns({c: F.lit("clash") for c in ("path", "conv", "turns", "ids", "loss")})
    want = [_digest(1, [("system\nrole", "first"), ("user", None), (None, "x"), ("assistant", "y"), ("assistant", "y")]),
            _digest(2, [("user", "")]), _digest(3, [("assistant", long)]), _digest(None, [("user", "alone")]),
            _digest(None, [("user", "alone")]), _digest(4, [("user", "same"), ("assistant", "answer")]),
            _digest(5, [("user", "same"), ("assistant", "answer")]), _digest(6, [("user", "same")])]
    assert rows(chatpack.round_trip(d, RANKS)) == sorted(want, key=repr)
    assert chatpack.round_trip(d.limit(0), RANKS).count() == 0


def test_op12_shared_turns_are_written_once(llm):
    """One partition, one pack: a segment per distinct prefix, intervals of exactly the ancestors."""
    rnd = random.Random(8)
    convs = {c: [("user" if i % 2 == 0 else "assistant", f"say {rnd.randint(0, 1)}") for i in range(rnd.randint(1, 6))]
             for c in range(60)}
    d = llm.createDataFrame([(c, i, r, t) for c, ts in convs.items() for i, (r, t) in enumerate(ts)], TURNS)
    old = llm.conf.get("spark.sql.shuffle.partitions")
    llm.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        packs = chatpack.pack(d, RANKS).collect()
        small = chatpack.pack(d, RANKS, pack_tokens=200)
        assert small.count() > 1
        back = {r["conv"]: [tuple(t) for t in r["turns"]] for r in chatpack.unpack(small, RANKS).collect()}
    finally:
        llm.conf.set("spark.sql.shuffle.partitions", old)
    assert back == convs
    assert len(packs) == 1
    segs = packs[0]["segments"]
    assert len(segs) == len({tuple(ts[:i + 1]) for ts in convs.values() for i in range(len(ts))})
    assert segs[0]["start"] == 0 and all(a["end"] == b["start"] for a, b in zip(segs, segs[1:]))
    assert 4 * segs[-1]["end"] == len(packs[0]["ids"]) == len(packs[0]["positions"])
    position = np.frombuffer(packs[0]["positions"], "<u4")
    for i, s in enumerate(segs):
        want, p = set(), s["parent"]
        assert p < i
        while p >= 0:
            want |= set(range(segs[p]["start"], segs[p]["end"]))
            p = segs[p]["parent"]
        seen = [x for a in s["seen"] for x in range(a["start"], a["end"])]
        assert set(seen) == want and len(seen) == len(want)
        assert position[s["start"]:s["end"]].tolist() == list(range(len(want), len(want) + s["end"] - s["start"]))
        assert all(a["end"] < b["start"] for a, b in zip(s["seen"], s["seen"][1:]))


# ---------------------------------------------------------------- op13

def _brute_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = j
    return sorted(((s, ln, q) for (s, ln), q in out.items()), key=lambda r: (r[0], r[2]))


def _run_row(i, text, plant):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(i).encode())
    if plant and i is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[x] if x < a else w[a + (x - a) % p] for x in range(n)]
    runs = _brute_runs(w)
    drop = {x for s, ln, q in runs for x in range(s + q, s + ln)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    return (i, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
            sha("".join(f"{s},{ln},{q}\n" for s, ln, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in drop)))


KEEP = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_op13_whole_table(llm, queries, docs):
    some = docs.where("length(text) < 8000")
    want = {i: _run_row(i, t, True) for i, t in some.select("doc_id", "text").collect()}
    got = {r[0]: tuple(r) for r in queries["op13_word_runs"](llm, SF).select(KEEP).collect()}
    assert len(got) == docs.count() and {i: got[i] for i in want} == want
    assert sum(r[1] > 0 for r in want.values()) > 5


def test_op13_odd_rows(llm, odd_docs, no_docs):
    extra = llm.createDataFrame([(20, "a " * 5), (21, "a " * 6), (22, "a b " * 9), (23, "A a " * 8 + "x " * 7)],
                                "doc_id bigint, text string")
    d = odd_docs.withColumns({"runs": F.lit("clash"), "n_words": F.lit("clash")})
    d = d.select("doc_id", "text", "runs", "n_words").unionByName(
        extra.withColumns({"runs": F.lit(""), "n_words": F.lit("")}))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    long = (7, 1, 0, 30_000, 997, 30_090, sha("0,30000,997\n"), sha(" ".join(f"word{x}" for x in range(997))))
    want = [_run_row(i, t, False) if i != 7 else long for i, t in d.select("doc_id", "text").collect()]
    assert rows(wordruns.digests(wordruns.runs(d)).select(KEEP)) == sorted(want, key=repr)
    assert wordruns.runs(no_docs).count() == 0


def test_op13_finds_all_runs_of_random_words():
    rnd = random.Random(9)
    texts = []
    for _ in range(2500):
        w = [rnd.randint(1, rnd.choice([1, 2, 2, 3, 5])) for _ in range(rnd.randint(0, 50))]
        if w and rnd.random() < 0.6:
            a, p = rnd.randrange(len(w)), rnd.randint(1, 6)
            w = w[:a] + (w[a:a + p] * 12)[:rnd.randint(1, 9) * p] + w[a:]
        texts.append(w)
    for t, got in zip(texts, wordruns.find(texts)):
        assert sorted(got, key=lambda r: (r[0], r[2])) == _brute_runs(t), t


@pytest.mark.parametrize("unit", [["x"], ["a", "b"], list("abaab"), [str(i) for i in range(997)]])
def test_op13_long_periodic_texts(unit):
    n = 120_000
    words = (unit * (n // len(unit) + 1))[:n]
    top = [r for r in wordruns.find([words])[0] if r[1] == n]
    assert top == [(0, n, len(unit))]
