"""Language, quality, BPE, token files, pages: brute force, round trips, odd rows."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from ragspark.llm import bpe, htmltext, langid, ordinal, tokenfiles

from .conftest import SF, rows

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tik():
    import tiktoken
    with open(RANKS, "rb") as f:
        return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(f.read()), special_tokens={})


def test_bpe_pattern_is_the_public_one():
    assert bpe.PATTERN == P.PATTERN


def test_bpe_matches_on_random_texts(tik):
    with open(RANKS, "rb") as f:
        enc = bpe.TextEncoder(f.read())
    rnd = random.Random(2)
    for alphabet in (" \n\t    abcdeéß'stre0123.,!!日本\x1c\x85🙂", "ab", " a", "the andin"):
        for _ in range(1500):
            s = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
            assert np.frombuffer(enc(s), "<u4").tolist() == tik.encode_ordinary(s), repr(s)


def test_bpe_replay_agrees_with_backtracking():
    with open(RANKS, "rb") as f:
        core = bpe.Backtracker(bpe.parse_ranks(f.read()))
    rnd = random.Random(3)
    for _ in range(300):
        piece = bytes(rnd.choice(b"etaoin shrdl\xc3\xa9\xff") for _ in range(rnd.randint(1, 20)))
        whole = core.ranks.get(piece)
        assert core.encode(piece) == ([whole] if whole is not None else core.replay(piece))


def test_bpe_refuses_other_vocabularies():
    with pytest.raises(ValueError):
        bpe.parse_ranks(b"YQ== 0\n")


def _bpe_rows(d, tik):
    out = []
    for i, t in d.select("doc_id", "text").collect():
        ids = np.array(tik.encode_ordinary(t or ""), "<u4")
        out.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_op5_whole_table(llm, queries, docs, tik):
    assert rows(queries["op5_bpe_round_trip"](llm, SF)) == _bpe_rows(docs, tik)


def test_op5_odd_rows(odd_docs, no_docs, tik):
    two = lambda d: bpe.digests(bpe.decode(bpe.encode(d, RANKS), RANKS))
    one = lambda d: bpe.digests(bpe.round_trip(d, RANKS))                  # noqa: E731
    for run in (one, two):
        assert rows(run(odd_docs)) == _bpe_rows(odd_docs, tik)
        assert run(no_docs).count() == 0


def test_bpe_backtracks_through_long_texts_in_linear_time(tik):
    import time
    with open(RANKS, "rb") as f:
        enc = bpe.TextEncoder(f.read())
    rnd = random.Random(12)
    for s in ("ab" * 5_000, "abcab" * 3_000, "".join(rnd.choice("abcde") for _ in range(20_000))):
        assert np.frombuffer(enc(s), "<u4").tolist() == tik.encode_ordinary(s)
    took = []
    for n in (100_000, 400_000):
        t = time.process_time()
        enc("ab" * (n // 2))
        took.append(time.process_time() - t)
    assert took[1] < 12 * took[0]          # four times the text; quadratic work would be sixteen times


def _token_rows(d):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(WORDS)
    return [(i, np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4"))
            for i, x in d.select("doc_id", "text").collect()]


def test_op4_whole_table(llm, queries, docs):
    want, at = [], 0
    for i, ids in sorted(_token_rows(docs), key=lambda r: r[0]):
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert rows(queries["op4_token_files"](llm, SF)) == sorted(want, key=repr)


def test_op4_odd_rows(odd_docs, no_docs):
    got = tokenfiles.round_trip(odd_docs, WORDS).collect()
    want = _token_rows(odd_docs)
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(
        (i or -1, len(x), zlib.crc32(x.tobytes())) for i, x in want)
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])][0] is None
    assert tokenfiles.round_trip(no_docs, WORDS).count() == 0


def test_op4_single_documents_and_the_dictionary_hash():
    import zstandard
    ids = [np.arange(n, dtype="<u2") for n in (0, 3, 70)]
    dictionary = zstandard.train_dictionary(2048, [np.arange(i % 50, 200, dtype="<u2").tobytes() for i in range(500)]).as_bytes()
    z = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    shard = tokenfiles.write_shard([4, None, 9], [len(x) for x in ids], [z.compress(x.tobytes()) for x in ids], 2,
                                   hashlib.sha256(dictionary).digest())
    r = tokenfiles.ShardReader(shard, dictionary)
    assert len(r) == 3 and r.document(1).tolist() == [0, 1, 2] and r.document(2).tolist() == list(range(70))
    with pytest.raises(ValueError):
        tokenfiles.ShardReader(shard, b"another")


def test_op4_words_as_the_library(odd_docs):
    from tokenizers import Tokenizer
    t, w = Tokenizer.from_file(WORDS), tokenfiles.WordEncoder(open(WORDS, encoding="utf-8").read())
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(" \n\t abcDEÉé'sT01.,!日\x1c\x85🙂İß") for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    texts += ["a<|endoftext|> b", "DON'T  it's", None]
    for x, got in zip(texts, w.batch(texts)):
        assert np.frombuffer(got, "<u2").tolist() == t.encode(x or "", add_special_tokens=False).ids + [1], repr(x)


def test_op4_each_distinct_word_of_a_batch_is_looked_up_once(monkeypatch):
    import pyarrow as pa

    class Counted(dict):
        asked = 0

        def get(self, *key):
            self.asked += 1
            return super().get(*key)

        def __getitem__(self, key):
            self.asked += 1
            return super().__getitem__(key)
    w = tokenfiles.WordEncoder(open(WORDS, encoding="utf-8").read())
    texts = ["The cat,\nthe dog  the cat,", None, " ", "dog" * 40] * 200
    alone = [w.batch([t])[0] for t in texts[:4]]
    w.memo, w.older = Counted(), w.memo
    assert w.batch(pa.array(["sliced off", *texts])[1:]) == alone * 200
    assert w.memo.asked == 5                            # The, cat + comma, the, dog, the long word
    monkeypatch.setattr(tokenfiles, "_MEMO_ROWS", 2)    # forgotten words are encoded again
    assert [w.batch([t])[0] for t in texts[:8]] == alone * 2
    assert w.batch(pa.array([], pa.string())) == []


def test_op2_held_out_accuracy(llm, queries, docs):
    got = {r["doc_id"]: r for r in queries["op2_ecoc_language"](llm, SF).collect()}
    held = [(i, x) for i, x in docs.select("doc_id", "lang").collect() if got[i]["held_out"]]
    assert len(got) == docs.count() and len(held) > 10
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert sum(got[i]["lang_pred"] == x for i, x in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_op2_ignores_ids_sources_and_labels(docs):
    from pyspark.sql import functions as F
    m = langid.fit(docs)
    a = langid.predict(docs, m).select("lang_pred", "score")
    b = langid.predict(docs.select((-F.col("doc_id")).alias("doc_id"), "text"), m).select("lang_pred", "score")
    assert rows(a) == rows(b)


def test_op2_odd_rows(docs, odd_docs, no_docs):
    m = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.predict(odd_docs, m).collect()}
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {1, 2, 3, 8}
    assert got[1]["score"] == 0 and not got[1]["ambiguous"] and got[9]["lang_pred"] in m.languages
    assert langid.predict(odd_docs, m).count() == 12 and langid.predict(no_docs, m).count() == 0
    none = langid.fit(no_docs)
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.accept(odd_docs, m).columns == odd_docs.columns
    assert {r["doc_id"] for r in langid.accept(odd_docs, m).collect()} & {1, 2, 3, 8} == set()
    one = langid.fit(docs.where("lang = 'en'"))
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(docs, one).collect()} == {("en", 1.0)}


def test_op2_texts_far_from_every_language_are_dropped(llm):
    """Unlearned languages and noise go; the table's own texts, held out or not, stay."""
    docs = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = np.random.default_rng(3)

    def noise(letters):
        return " ".join("".join(rng.choice(list(letters), rng.integers(3, 9))) for _ in range(60))
    far = ["Съешь же ещё этих мягких французских булок да выпей чаю, пока погода стоит хорошая",
           "我们今天去公园散步天气很好大家都很高兴然后回家吃饭看书学习写字",
           "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto",
           "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler", "x" * 5000,
           *[noise("bcdfghjklmnpqrstvwxz") for _ in range(50)], *[noise("abcdefghijklmnopqrstuvwxyz") for _ in range(50)]]
    planted = llm.createDataFrame(list(enumerate(far)), "doc_id bigint, text string")
    two = docs.where("lang in ('en', 'de')")
    for known in (docs, two, docs.where("lang = 'en'")):
        m = langid.fit(known)
        assert langid.accept(planted, m).count() == 0
        assert langid.accept(known, m).count() >= 0.99 * known.count()
        if len(m.languages) > 1:
            assert {(r["score"], r["ambiguous"]) for r in langid.predict(planted, m).collect()} == {(0.0, True)}
    assert langid.accept(docs.where("lang = 'fr'"), langid.fit(two)).count() < 0.05 * docs.where("lang = 'fr'").count()


def test_op2_codes_differ_and_neighbours_do_not_matter():
    for k in (2, 4, 6, 12):
        c = langid.codebook(k)
        assert len(np.unique(c, axis=0)) == k and (np.abs(c.sum(0)) < k).all()
    rng = np.random.default_rng(0)
    w = rng.standard_normal((3, langid._NONE + 1)).astype(np.float32)
    w[:, langid._NONE] = 0
    texts = ["ab", "the cat", "é", "zz top of it"]
    alone = np.concatenate([langid._margins([t], w) for t in texts])
    assert np.allclose(alone, langid._margins(texts, w), atol=1e-5)


def test_op3_separates_grades(llm, queries, docs):
    labels = llm.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r for r in queries["op3_ordinal_quality"](llm, SF).collect()}
    rated = labels.collect()
    clean = [got[r["doc_id"]] for r in rated if r["quality"] == 1 and r["toxic"] == 0]
    bad = [got[r["doc_id"]] for r in rated if r["quality"] == 0]
    assert len(got) == docs.count()
    assert np.mean([r["selected"] for r in clean]) > 0.9 and np.mean([r["selected"] for r in bad]) < 0.1
    assert all(0 <= r["tail_prob"] <= 1 and r["tail_prob"] <= r["expected_grade"] + 1e-9 <= 2 + 1e-9 for r in got.values())


def test_op3_held_out_accuracy(llm):
    """Fit on one half of the ratings, test on the other (10,000 documents)."""
    from pyspark.sql import functions as F
    sf = "/root/testdata/sf0.1"
    d, labels = llm.read.parquet(f"{sf}/documents.parquet"), llm.read.parquet(f"{sf}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    m = ordinal.fit(d, labels.where(half), ordinal.grade_of())
    got = ordinal.predict(d.join(labels.where(~half), "doc_id"), m).join(labels, "doc_id").groupBy(
        ordinal.grade_of().alias("g")).agg(F.avg(F.col("selected").cast("double")).alias("s")).collect()
    share = {r["g"]: r["s"] for r in got}
    assert share[2] > 0.97 and share[1] < 0.2 and share[0] < 0.05


def test_op3_learns_from_the_last_words_of_long_texts(llm):
    """Long toxic texts whose telling word is last in the alphabet, beyond 2,000 others."""
    from pyspark.sql import functions as F
    common = " ".join(f"a{i}" for i in range(2_500))
    texts = [(i, f"{common} {'zzworthless' if i % 2 else 'zzuseful'}") for i in range(60)]
    d = llm.createDataFrame(texts, "doc_id bigint, text string")
    labels = llm.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id bigint, quality int, toxic int")
    m = ordinal.fit(d, labels, ordinal.grade_of())
    word = {w: m.weights[list(ordinal._word_features(w))].sum() for w in ("zzworthless", "zzuseful", "a7")}
    assert word["zzworthless"] < 0 < word["zzuseful"] and word["a7"] == 0
    got = {r["doc_id"]: r["selected"] for r in ordinal.predict(d, m).select("doc_id", F.col("selected")).collect()}
    assert all(got[i] == (i % 2 == 0) for i in got)


def test_op3_learns_a_lexicon_of_rare_words(llm):
    """50 words, one in each toxic text, so about 2 % of the toxic texts hold each."""
    from pyspark.sql import functions as F
    sf = "/root/testdata/sf0.1"
    labels = llm.read.parquet(f"{sf}/labels.parquet").where(ordinal.grade_of() == 2).select("doc_id").distinct()
    words = F.array(*[F.lit(f"zq{i}x") for i in range(50)])
    draw = lambda seed, n: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(n))       # noqa: E731
    d = llm.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").join(labels, "doc_id")
    d = d.withColumn("g", F.when(draw(5, 3) == 0, 1).otherwise(2)).withColumn("text", F.when(F.col("g") == 1, F.concat_ws(
        " ", "text", F.element_at(words, (draw(1, 50) + 1).cast("int")))).otherwise(F.col("text")))
    half = draw(77, 2) == 0
    m = ordinal.fit(d, d.where(half).select("doc_id", F.col("g").alias("grade")), F.col("grade"))
    got = ordinal.predict(d.where(~half), m).join(d.select("doc_id", "g"), "doc_id").groupBy("g").agg(
        F.avg(F.col("selected").cast("double")).alias("s")).collect()
    share = {r["g"]: r["s"] for r in got}
    assert share[1] < 0.3 and share[2] > 0.95


def test_op3_odd_rows(llm, docs, odd_docs, no_docs):
    labels = llm.read.parquet(f"{SF}/labels.parquet")
    m = ordinal.fit(docs, labels, ordinal.grade_of())
    assert (np.diff(m.thresholds) > 0).all()
    got = ordinal.predict(odd_docs, m).collect()
    assert len(got) == 12 and {r["doc_id"] for r in got if r["expected_grade"] == 0.0} >= {1, 2, 3}
    assert ordinal.predict(no_docs, m).count() == 0
    assert ordinal.accept(odd_docs, m).columns == odd_docs.columns
    none = ordinal.fit(docs, labels.limit(0), ordinal.grade_of())
    assert none is None and ordinal.accept(odd_docs, none).count() == 9
    odd = llm.createDataFrame([(None, 1, 0), (0, None, None), (10**9, 0, 1)], "doc_id bigint, quality int, toxic int")
    assert ordinal.fit(docs, odd, ordinal.grade_of()) is None


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1><nav><a href=/>Home</a></nav></header><div class="cookie-banner">We use cookies</div>
<main><article><header><h1>Big &amp;amp; Title</h1></header><p>First para with <a href="x>y">a&nbsp;link</a> in
 side.<p>Short.<div class="ad">Buy now</div><ul><li>one<li>two</ul><pre>x  &lt;y&gt;</pre><form><label>Mail</label></form>
<p><b>Bold start.<br><p>Next.</p><section id="comments"><article class="comment"><p>A long reader comment with many words in it.</p>
</article></section></article></main><aside><p>Side text that is long enough to be an article by itself.</p></aside>
<footer>&copy; x</footer><!-- a > b --></body>"""


def test_op9_page():
    tree = htmltext.train_tree(*htmltext.labelled_table())
    assert htmltext.main_text(PAGE, tree).split("\n") == [
        "Big &amp; Title", "First para with a link in side.", "Short.", "one", "two", "x <y>", "Bold start.", "Next."]


def _words(n, s="word"):
    return " ".join(f"{s}{i}" for i in range(n))


def test_op9_listed_words_inside_articles_and_deep_nesting():
    """Words that often name furniture also name parts of a text; what they hold decides."""
    tree = htmltext.train_tree(*htmltext.labelled_table())

    def article(inner):
        return ("<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><header>Site</header><article>"
                + inner + "</article><footer>foot text here</footer></body></html>")

    def p(*texts):
        return "".join(f"<p>{t}</p>" for t in texts)
    a, b, c = _words(50), _words(40, "b"), _words(5, "c")
    for page, want in [
            (article(f"<h1>T</h1>{p(a)}<section id='discussion'><h2>Discussion</h2>{p(a, b)}</section>"), ["T", a, "Discussion", a, b]),
            (article(f"<h1>T</h1><div class='long-form'>{p(a, b, c)}</div>"), ["T", a, b, c]),
            (f"<nav><a href='/'>Home</a></nav><div class='long-form'><article><h1>T</h1>{p(a)}</article></div>", ["T", a]),
            (article(f"<h1>T</h1>{p(a)}<p class='notice-of-motion'>{_words(28, 'm')}</p>{p(b)}"), ["T", a, _words(28, "m"), b]),
            (article("<div>" + "<div>" * 600 + p(a) + "</div>" * 600 + "</div>" + p(b)), [a, b]),
            (article(f"<h1>T</h1>{p(a)}<div class='ad'>{_words(8, 'ad')}</div>{p(b)}"), ["T", a, b]),
            (article(f"<h1>T</h1>{p(a)}<div class='sidebar'>{p(b)}</div>{p(a)}"), ["T", a, a]),
            (article(f"<h1>T</h1>{p(a)}<section class='comments'>{p(a, b)}</section>"), ["T", a]),
            (article(f"<h1>T</h1>{p(a)}<div class='main-nav'><a href='/x'>one</a> <a href='/y'>two</a></div>"), ["T", a])]:
        assert htmltext.main_text(page, tree).split("\n") == want, page[:200]

    def used(node):
        return {htmltext.FEATURES[node[0]]} | used(node[2]) | used(node[3]) if isinstance(node, tuple) else set()
    assert {"words", "links", "words_after", "box_words", "box_share"} <= used(tree)


def test_op9_reads_stray_and_deep_tags_in_linear_time():
    import time
    took = []
    for n in (20_000, 80_000):
        t = time.process_time()
        found, _ = htmltext.blocks("<div>" * n + "</b></x></section>" * n + "text" + "</div>" * n)
        took.append(time.process_time() - t)
        assert [f.text for f in found] == ["text"]
    assert took[1] < 12 * took[0]


def test_op9_whole_table(llm, queries):
    """The article element's text, cut at its block tags, is the expected text."""
    import html
    import re
    want = []
    for r in llm.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner))
        text = "\n".join(p for p in parts if p)
        want.append((r["page_id"], r["url"], text, len(text)))
    assert rows(queries["op9_block_tree_text"](llm, SF)) == sorted(want, key=repr)


def test_op9_odd_rows(llm):
    cases = [None, "", "<p>", "<p>a", "no markup at all but a sentence of several words in it", "<!-- never closed", "<p>x</p><script>",
             "<div>" * 3000 + "deep", "<a" * 50, '<p title="a > b">q</p>' * 2, "<br><br>", "&#xZZ; &bogus; &amp", "<p>" + "word " * 100_000]
    d = llm.createDataFrame([(i, "u", h, "c") for i, h in enumerate([*cases, cases[3]])], "page_id bigint, url string, html string, text string")
    got = {r["page_id"]: r for r in htmltext.extract(d).collect()}
    assert len(got) == len(cases) + 1 and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert all(got[i]["text"] == "" for i in (0, 1, 2, 5, 10))
    assert got[12]["text"] == ("word " * 100_000).strip() and got[4]["text"] == cases[4]
    assert htmltext.extract(d.limit(0)).count() == 0
    null = htmltext.extract(llm.createDataFrame([(None, None, None)], "page_id bigint, url string, html string")).collect()
    assert [tuple(r) for r in null] == [(None, None, "", 0)]
