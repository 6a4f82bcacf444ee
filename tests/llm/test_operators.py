"""The training-data operators against brute force, and on nulls, empty tables, ties, repeats and clashing names."""

import time
import pickle
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers
from courtside.llm import attention, boosting, chat, decontam, html, language, lm, packing, quality, simhash, tokens, toxicity
from courtside.llm.graph import components, local_labels
from courtside.llm.shared import Scratch

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "stone", "river", "cold", "is", "was", "green", "hill", "sun", "walk", "tall", "house"]) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, a very long text, repeated rows, ties, and columns that clash with names used inside."""
    rng = np.random.default_rng(3)
    rows = [(1, prose(rng, 80), "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t ", "en", "b", 4), (5, "one", "en", "b", 3),
            (None, prose(rng, 60), "en", "c", 2), (6, prose(rng, 30000), "en", "c", 5), (7, "été über 漢字 <|endoftext|> 😀 don't", "fr", "c", 5),
            (8, "12 34 !!", None, "c", 5), (9, "one", "en", "d", 3), (9, "one", "en", "d", 3), (1, prose(rng, 50), "en", "a", 1)]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as fp", "2 as _row", "'x' as row", "3 as _hits", "4 as pieces", "5 as score")


# ---- 1 ---------------------------------------------------------------------------------------------------

def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, radius=4):
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return group


@given(st.text(alphabet="ab AZ\n\té漢", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) & (2 ** 64 - 1) == slow_print(text)


def test_links_join_up_all_near_prints(spark):
    rng = np.random.default_rng(0)
    prints = [int(x) for x in rng.integers(0, 2 ** 63, 40)]
    for _ in range(260):  # chains of near prints, and more of them in one bucket than a shard holds
        p = prints[rng.integers(0, 12)]
        for b in rng.choice(64, rng.integers(1, 7), replace=False):
            p ^= 1 << int(b)
        prints.append(p)
    prints = sorted({p - 2 ** 64 if p >> 63 else p for p in prints})
    old, simhash.SHARD = simhash.SHARD, 16
    try:
        scratch = Scratch(spark)
        found = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp bigint"), 4, scratch)
        label = {r.node: r.label for r in components(found, scratch).collect()}
    finally:
        simhash.SHARD = old
    want = slow_components([p & (2 ** 64 - 1) for p in prints])
    got = [label.get(p, p) for p in prints]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_local_labels():
    assert local_labels(6, np.array([5, 3, 1]), np.array([3, 1, 0])).tolist() == [0, 0, 2, 0, 4, 0]


def test_components_of_a_path_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a bigint, b bigint"), Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 60)}}


def test_near_duplicates_odd_rows(spark, odd):
    rows = odd.select("doc_id", "text").collect()
    prints = [slow_print(r.text) for r in rows]
    group = slow_components(prints)
    want = Counter((r.doc_id, f"{p:016x}", min((s.doc_id for s, h in zip(rows, group) if h == g and s.doc_id is not None), default=None))
                   for r, p, g in zip(rows, prints, group))
    got = simhash.near_duplicates(odd)
    assert Counter((r.doc_id, f"{r.simhash & (2 ** 64 - 1):016x}", r.component) for r in got.collect()) == want
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len(set(group))
    empty = odd.limit(0)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


# ---- 2 ---------------------------------------------------------------------------------------------------

def slow_repeats(words):
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    return len({i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)})


@given(st.lists(st.sampled_from(["a", "b", "c", "dd"]), max_size=40))
def test_repeated_words(words):
    assert quality.repeated_words([w.encode() for w in words]) == slow_repeats(words)


def test_quality(spark, odd):
    rows = quality.with_quality(odd, "q").select("text", "q.*").collect()
    for r in rows:
        text = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text))
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_repeat_words == slow_repeats(words)
        assert r.base_failed == (len(words) < 50 or 100 * r.n_repeat_words > 50 * len(words)) and not (r.base_failed and r.kept)
    assert quality.clean(odd.limit(0)).columns == odd.columns
    rng = np.random.default_rng(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    plain = " ".join("".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 8))) for _ in range(400))
    noise = " ".join("".join(chr(rng.integers(0x4E00, 0x9FFF)) for _ in range(30)) for _ in range(90))
    again = " ".join(f"{letters[i % 26]}{i % 7} same words" for i in range(300))
    rules = quality.Rules()
    assert [rules.bands(t.encode())[3] for t in (plain, noise, again)] == [True, False, False]


# ---- 3 ---------------------------------------------------------------------------------------------------

def test_language(spark, odd):
    rng = np.random.default_rng(5)
    kinds = {"xx": ["ba", "do", "mi", "ru"], "yy": ["kel", "tor", "vin", "zas"], "zz": ["oph", "yth", "igh", "awn"]}
    rows = [(i, " ".join("".join(rng.choice(kinds[k], 3)) for _ in range(40)), k) for i in range(90) for k in kinds]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit_fold(docs)
    got = language.with_language(docs, model, "found").select("lang", "found.*").toDF("want", "lang", "score").collect()
    assert all(r.want == r.lang and 0 <= r.score <= 1 for r in got)
    counts = language.Counts(model)
    keys, _ = language.gram_keys(["bado", "keltor"])
    member = model.member(keys)
    for l, name in enumerate(model.languages):  # popcounts are sums of filter answers over the n-grams
        assert counts.of("Bado KELTOR bado")[l] == sum(model.member(language.gram_keys([w])[0])[:, l].sum() for w in ("bado", "keltor", "bado"))
    assert member.shape == (len(keys), 3)
    found = {r.doc_id: (r.f.lang, r.f.score) for r in language.with_language(odd, model, "f").collect()}
    assert found[2] == found[3] == found[4] == found[8] == ("und", 0.0)
    none = language.fit(docs.limit(0))
    assert {r.f.lang for r in language.with_language(docs, none, "f").collect()} == {"und"}
    assert language.clean(docs.withColumn("_language", F.lit(1)), model).columns == [*docs.columns, "_language"]
    assert language.with_language(docs.limit(0), model, "f").count() == 0


def test_language_filter_has_no_false_negatives(spark):
    docs = spark.createDataFrame([(i, "abcde fghij klmno", l) for i, l in enumerate(f"l{k:03d}" for k in range(130))], "doc_id bigint, text string, lang string")
    model = language.fit(docs)
    assert len(model.languages) == 130 and model.member(language.gram_keys(["abcde"])[0]).all()


# ---- 4 ---------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def byte_bpe():
    from tokenizers import Tokenizer
    return tokens.TextCounter(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)


BITS = ["'", "'s", "'re", "'ll", "'r", " ", "  ", "\n", "\t", " ", "　", "\x1c", "a", "e", "re", "the", "1", "²", "é", "漢",
        "\U0001f600", "<|endoftext|>", "<|end", "!", "--", "ING", "_", "ll", "ve", "v", "l"]


@settings(max_examples=300, deadline=None)
@given(parts=st.lists(st.one_of(st.sampled_from(BITS), st.text(max_size=3)), max_size=30))
def test_token_counts(byte_bpe, parts):
    ours, library = byte_bpe
    text = "".join(parts)
    assert ours.counts([text]) == [len(library.encode(text, add_special_tokens=False).ids)]


@pytest.mark.parametrize("text", ["\U000323b0's", "a\U000323b0b", "\U000323b0\U000323b0 \U00033479"])
def test_token_counts_of_characters_that_the_library_does_not_know(byte_bpe, text):
    ours, library = byte_bpe
    assert ours.counts([text]) == [len(library.encode(text, add_special_tokens=False).ids)]


def test_chunk_maps_compose(byte_bpe):
    ours, library = byte_bpe
    texts = ["don't  we'll x" * 900, " " * 5000, "a" * 3000, "", "'" * 1000]
    assert ours.counts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    old = (tokens.TokenCounter.STATES, tokens.TokenCounter.PIECES)
    tokens.TokenCounter.STATES, tokens.TokenCounter.PIECES = 50, 5  # tables emptied all the time
    try:
        assert ours.counts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    finally:
        tokens.TokenCounter.STATES, tokens.TokenCounter.PIECES = old


def test_tokens_odd_rows(spark, odd, byte_bpe):
    got = tokens.with_tokens(odd, BYTE_BPE, "n").select("text", "n").collect()
    assert all(r.n == len(byte_bpe[1].encode(r.text or "", add_special_tokens=False).ids) for r in got)
    assert tokens.with_tokens(odd.limit(0), BYTE_BPE, "n").count() == 0


# ---- 5 ---------------------------------------------------------------------------------------------------

def slow_hits(text, items, window=13):
    def words_of(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = words_of(text), set(), set()
    for item, t in items:
        own = words_of(t)
        size = min(window, len(own))
        for w in {tuple(own[i:i + size]) for i in range(len(own) - size + 1)} if own else ():
            for i in range(len(words) - size + 1):
                if tuple(words[i:i + size]) == w:
                    hit |= set(range(i, i + size))
                    found.add(item)
    return len(words), len(hit), sorted(found, key=str)


def test_decontamination(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 40)))) for i in range(2, 14)] + [(20, None), (21, ""), (22, "w1 w1 w1"), (22, "w2 w2")]
    items = [x for x in items if x[1] is None or len(x[1].split()) != 1]
    docs = [(i, " ".join(rng.choice(vocabulary + ["other"], rng.integers(0, 60)))) for i in range(40)]
    docs += [(100 + i, f"Other, {t.upper()}! and {t}" if t else t) for i, (_, t) in enumerate(items)] + [(200, "w1 " * 500), (201, None)]
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for words in (10 ** 6, 20):  # in one pass, and in several
        got = decontam.with_hits(df, bench, "h", pattern_words=words).withColumns(decontam.digest(F.col("h"))).collect()
        for r in got:
            n, hits, found = slow_hits(r.text, items)
            assert (r.n_words, r.n_hit, r.n_items, list(r.h["items"])) == (n, hits, len(found), sorted(found))
            assert all(a.stop < b.start for a, b in zip(r.h.spans, r.h.spans[1:]))
            assert r.contaminated == (hits > 0 and 20 * hits >= n)
    assert {r.doc_id for r in decontam.clean(df.withColumn("_hits", F.lit(1)), bench).collect()} == {r.doc_id for r in got if not r.contaminated}
    none = decontam.with_hits(df, bench.limit(0), "h").select(F.sum(F.size("h.spans"))).first()[0]
    assert none == 0 and decontam.with_hits(df.limit(0), bench, "h").count() == 0


def test_benchmark_parts_are_collected_one_by_one(spark, monkeypatch):
    rng = np.random.default_rng(12)
    items = [(i, prose(rng, 30)) for i in range(12)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    docs = spark.createDataFrame([(i, prose(rng, 10) + " " + t) for i, t in items], "doc_id bigint, text string")
    steps = []
    collect, keep = type(benchmark).collect, Scratch.keep
    monkeypatch.setattr(type(benchmark), "collect", lambda self: steps.append("collect") or collect(self))
    monkeypatch.setattr(Scratch, "keep", lambda self, df: steps.append("pass") or keep(self, df))
    found = decontam.with_hits(docs, benchmark, "hits", pattern_words=150)
    monkeypatch.undo()
    parts = steps.count("pass")
    passes = [s for s in steps if s == "pass" or s == "collect"][-2 * parts:]
    assert parts > 1 and passes == ["collect", "pass"] * parts
    assert all(r.hits["items"] == [r.doc_id] for r in found.collect())


def test_index_searches_and_locates():
    rng = np.random.default_rng(4)
    seq = np.concatenate([np.r_[rng.integers(1, 5, rng.integers(1, 50)), 0] for _ in range(30)]).astype(np.int32)
    index = decontam.FMIndex(seq, 4)
    rows = np.flatnonzero(index.last >= 0)
    assert sorted(index.locate(rows[rows >= index.first[1]]).tolist()) == np.flatnonzero(seq).tolist()
    for value in range(1, 5):
        for end in (0, 7, len(seq)):
            got = index.tree.rank(np.array([value]), np.array([end]), index.start[[value]])[0]
            assert got == (index.last[:end] == value).sum()


# ---- 6 ---------------------------------------------------------------------------------------------------

TRICKY = ["", "\\", "<|turn|>", "<\\|turn|>", "</s>[INST] ok [/INST]", "<<SYS>>\\<|end|>", "<|says|>\n", "[\\/INST]", "\\\\<|", "<|end|>", "漢😀"]


def test_chat_round_trip(spark):
    rows = [(i % 5, i // 5, r, t) for i, (r, t) in enumerate((r, t) for r in ("user", "assistant", None, "<|says|>") for t in (*TRICKY, None))]
    rows += [(9, 0, "assistant", "same"), (9, 0, "assistant", "same"), (None, 1, "user", "x"), (9, None, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    made = chat.format_chats(df.withColumn("parts", chat.text_part(F.col("text"))).withColumn("begin", F.lit(1)))
    got = made.select("conv_id", "formatted", "n_turns", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("loss")).collect()
    def key(r):
        return (r[1] is not None, r[1] or 0, r[2] or "")
    for g in got:
        own = sorted((r for r in rows if r[0] == g.conv_id), key=key)
        assert Counter((t.role, t.text) for t in g.turns) == Counter((r[2] or "", r[3] or "") for r in own) and g.n_turns == len(own)
        assert g.formatted.count(chat.TURN) == len(own) == g.formatted.count(chat.END) and "[INST]" not in g.formatted and "</s>" not in g.formatted
        assert g.loss == "".join(t.text for t in g.turns if t.role == "assistant")
    assert chat.format_chats(df.limit(0).withColumn("parts", chat.text_part(F.col("text")))).count() == 0


@settings(max_examples=40, deadline=None)
@given(texts=st.lists(st.text(alphabet="<|>\\/[]INSTsSYturn é", max_size=20), min_size=1, max_size=30))
def test_escapes_are_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escaped(F.col("t")))
    for r in df.withColumn("u", chat.unescaped(F.col("e"))).collect():
        assert r.u == r.t
        assert not re.search(r"<\||</?s>|\[/?INST\]|<</?SYS>>", r.e)


def test_chat_parts(spark):
    parts = [("text", "see <|image|>", None, None, None, None, None), ("image", None, "a.png", 1024, 600, None, None), ("audio", None, "b.wav", None, None, 2.4, None),
             ("document", None, "c.pdf", None, None, None, 3), None, ("image", None, None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id int, turn int, role string, parts {chat.PARTS}")
    r = chat.format_chats(df).first()
    assert r.formatted.startswith("<|turn|>user<|says|>see <\\|image|><|image|><|audio|><|document|><|image|><|end|>")
    assert [(a.turn, a.place, a.kind, a.ref, a.tokens) for a in r.attachments] == [
        (1, 0, "image", "a.png", 85 + 170 * 4), (1, 1, "audio", "b.wav", 75), (1, 2, "document", "c.pdf", 900), (1, 3, "image", None, 255)]
    assert r.n_tokens_attached == 765 + 75 + 900 + 255


# ---- 7 ---------------------------------------------------------------------------------------------------

@given(st.lists(st.integers(1, 20), max_size=60))
def test_bins(sizes):
    sizes = np.array(sizes, np.int64)
    bins = packing.pack(sizes, 20)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sizes[b].sum() <= 20 for b in bins)
    assert len(bins) <= len(packing.best_fit(sizes, 20))


def test_search_beats_best_fit():
    rng = np.random.default_rng(0)
    first = found = 0
    for _ in range(20):
        sizes = rng.integers(25, 40, 60)
        a, b = len(packing.best_fit(sizes, 100)), len(packing.pack(sizes, 100))
        assert b <= a
        first, found = first + a, found + b
    assert found < 0.98 * first


def test_packing(spark, odd):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(WORD_BPE)
    want = Counter()
    for r in odd.collect():
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), 2048):
            want[r.doc_id, k // 2048, k, len(ids[k:k + 2048]), zlib.crc32(ids[k:k + 2048].tobytes())] += 1
    old, packing.GROUP = packing.GROUP, 6
    try:
        got = packing.packed(odd, WORD_BPE).toPandas()
    finally:
        packing.GROUP = old
    rows = [(None if np.isnan(d) else int(d), *map(int, rest)) for d, *rest in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert Counter(rows) == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist() and s.length.sum() <= 2048
    assert packing.packed(odd.limit(0), WORD_BPE).count() == 0


@settings(max_examples=150, deadline=None)
@given(parts=st.lists(st.one_of(st.sampled_from(BITS), st.text(max_size=4)), max_size=25))
def test_word_ids(parts):
    text = "".join(parts)
    words = test_word_ids.words = getattr(test_word_ids, "words", None) or packing.WordTokenizer(WORD_BPE)
    assert words.encode([text]) == [np.array(words.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]


# ---- 8 ---------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def trees():
    rng = np.random.default_rng(6)
    return html._train([[prose(rng, int(n)) for n in rng.integers(5, 60, 5)] for _ in range(40)], html.MADE)


def test_main_text(spark, trees):
    rng = np.random.default_rng(8)
    paragraphs = [prose(rng, 40) for _ in range(4)]
    page = ("<!doctype html><html><head><title>t</title><style>p{}</style><script>var a='</p><p>no';</script></head><body><header><h2>Site</h2></header>"
            "<nav><ul><li><a href=/>home</a><li><a href=/x>more</a></ul></nav><div class='cookie-notice'><p>We use cookies <button>ok</button></p></div>"
            f"<article><h1>Head &amp; line</h1><p>{paragraphs[0]}<p>{paragraphs[1]} <b>bold</b><br>next&nbsp;line</p><!-- no --><div class=ad>Buy this</div>"
            f"<ul><li>{paragraphs[2]}</li></ul>\n\n<p>{paragraphs[3]}</p></article><div id='comments'><h3>Comments</h3><div class=comment><p>{prose(rng, 30)}</p></div></div>"
            "<form><label>Name</label><input><textarea>x</textarea></form><footer>&copy; 2020</footer></body></html>")
    want = " ".join(["Head & line", paragraphs[0], paragraphs[1], "bold next line", paragraphs[2], paragraphs[3]])
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "no markup at all"), (5, "<p"), (6, "</div></p>&lt;"), (7, page)], "page_id int, html string")
    got = {r.page_id: r.main_text for r in html.with_main_text(df, trees).collect()}
    assert got[1] == got[7] == want
    assert got[2] == got[3] == ""
    assert html.with_main_text(df.limit(0), trees).count() == 0


@pytest.mark.parametrize("page, want", [
    ("<body><form><datalist id=d><option value=a><option value=b></datalist></form><p>one</p>", "one"),
    ("<form><select><option>a<option>b</form><p>one", "one"), ("<div><select><option>a<input>mid</div>one", "mid one"),
    *((f"<div><{t} src=x></div><p>one</p><p>two", "one two") for t in ("video", "audio", "svg", "canvas", "template", "object", "noscript")),
    ("<ul><li>a<video src=x><li>b</ul>", "a b"), ("<p>a <span><svg><path d=x></span> b</p>", "a b"), ("<div><svg><path d=x><p>one</p></div>", "one"),
    ("<div><video><div>no</div><p>no</p>no</video>one</div>", "one"), ("<div><svg><g><text>no</text></g></svg>one</div>", "one"),
    ("<html><head><title>t</title><meta charset=x><p>one</p>two", "one two"), ("<head><title>t</title> one <b>two</b>", "one two"),
    ("<head><noscript><link href=x></noscript><title>t</title></head><p>one", "one"),
    ("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>", "so x=1 holds"),
    ("<p>a</p><object data=x><p>b</p></object><noscript><p>c</p></noscript>", "a b c")])
def test_hidden_elements_end_with_their_block(page, want):
    nodes, _ = html.parse(page)
    assert html.text_of(nodes, [True] * len(nodes)) == want


def test_training_sample_has_each_page_once(spark):
    rng = np.random.default_rng(3)
    pages = [f"<p>{prose(rng, 30)}</p><p>{prose(rng, 20)}</p>" for _ in range(6)]
    once = spark.createDataFrame([(p,) for p in pages], "html string")
    often = spark.createDataFrame([(p,) for p in pages * 5] + [("",), (" \n",), (None,)] * 20, "html string")
    want, got = (pickle.dumps(html.fit(df, sample=4, made=30)) for df in (once, often))
    assert got == want
    assert html.fit(once.limit(0), made=30)


def test_decoding_agrees_along_paths():
    rng = np.random.default_rng(9)
    for _ in range(60):
        n = int(rng.integers(2, 11))
        parents = [-1] + [int(rng.integers(0, k)) for k in range(1, n)]
        nodes = [html.Node("div", p, 0, 0) for p in parents]
        odds = rng.normal(0, 1, n).tolist()
        kept = html.decode(nodes, odds)
        def value(choice):
            return sum(o if c else -o for o, c in zip(odds, choice))
        best = max((value(c) for c in ([bool(m >> k & 1) for k in range(n)] for m in range(2 ** n))
                    if c[0] and all(not c[k] or c[parents[k]] for k in range(1, n))))
        assert all(not kept[k] or kept[parents[k]] for k in range(1, n)) and abs(value(kept) - best) < 1e-9


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = boosting.fit(x, y, trees=30, depth=3)
    assert ((model.log_odds(x) > 0) == y).mean() > 0.95
    assert boosting.fit(np.zeros((0, 3)), np.zeros(0)).log_odds(np.zeros((0, 3))).shape == (0,)


# ---- 9 ---------------------------------------------------------------------------------------------------

def _toy(seed=0):
    rng = np.random.default_rng(seed)
    texts = [rng.integers(0, 60, rng.integers(1, 90)) for _ in range(20)]
    v = attention.Vocabulary.of(np.bincount(np.concatenate(texts), minlength=80).astype(float))
    return texts, v


def test_attention_scores_each_token_once_and_sees_no_later_one():
    texts, v = _toy()
    base = attention.prior(attention.pairs_of(attention.lay_out(texts, v, 79)).reshape(attention.ROWS, -1))
    model = attention.Model(attention.start(), base)
    model.tables()
    def chances(t):
        s = attention.lay_out(t, v, 79)
        c = model.log_chances(s)
        return [c[b:b + n] for b, n in zip(s.begin, s.size)]
    together = chances(texts)
    for t, c in zip(texts, together):
        assert np.allclose(chances([t])[0], c, atol=1e-5) and (c < 0).all()
        changed = t.copy()
        changed[-1] = (changed[-1] + 1) % 60
        assert np.allclose(chances([changed])[0][:-1], c[:-1], atol=1e-5)
    # brute force: one query at a time
    p, t = model.p, texts[0]
    x = np.concatenate([[79], t[:-1]])
    for i in range(len(t)):
        low = max(0, (i // attention.BLOCK - 1) * attention.BLOCK)
        k = np.array([model.k[v.inputs[x[j]]][:-1] @ model.q[v.inputs[x[i]]][:-1] + p["lag"][i - j] for j in range(low, i + 1)])
        w = np.exp(k) / np.exp(k).sum()
        z = base[v.inputs[x[i]]] + (w @ np.array([model.v[v.inputs[x[j]]] for j in range(low, i + 1)])) @ p["out"] + p["shift"]
        assert abs(z[v.classes[t[i]]] - np.log(np.exp(z).sum()) - together[0][i]) < 1e-4


def test_attention_gradient_and_training():
    texts, v = _toy(1)
    s = attention.lay_out(texts, v, 79, 2)
    base = attention.prior(attention.pairs_of(s).reshape(attention.ROWS, -1))
    flat = attention.start()
    model = attention.Model(flat.copy(), base)
    model.tables()
    grad, count = model.gradient(s.inputs, s.classes)
    def loss(f):
        m = attention.Model(f, base)
        m.tables()
        a = m.windows(s.inputs, 2 * attention.BLOCK)[-1].astype(float)
        y = s.classes.reshape(-1, 2, attention.BLOCK)[:, 1].reshape(-1)
        a = a[y >= 0]
        return -(a[np.arange(len(a)), y[y >= 0]] - np.log(np.exp(a).sum(axis=1))).sum() / count
    at = 0
    for name, shape in attention.SHAPES.items():
        size = int(np.prod(shape))
        i = at + int(np.argmax(np.abs(grad[at:at + size])))
        at += size
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-2
        down[i] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - grad[i]) < 0.05 * abs(grad[i]) + 1e-4, name
    trained = flat
    for _ in range(30):
        trained, seen = attention.train(trained, base, iter([s]))
    assert loss(trained) < loss(flat) and seen == count


def test_training_predicts_every_token_once():
    texts, v = _toy(2)
    base = attention.prior(attention.pairs_of(attention.lay_out(texts, v, 79)).reshape(attention.ROWS, -1))
    column = pa.array([t.astype("<u2").tobytes() for t in texts], pa.binary())
    old, attention.BATCH = attention.BATCH, 3  # several steps, whose windows meet without gap or overlap
    try:
        got = lm._train(SimpleNamespace(value=lm.Setting(v, 79, 78)), SimpleNamespace(value=(attention.start(), base)))(iter([column]))
    finally:
        attention.BATCH = old
    assert got[-1] == sum(map(len, texts)) + len(texts)  # and the end marks


def test_gradient_of_overlapping_windows():
    texts, v = _toy(2)
    s = attention.lay_out(texts, v, 79)
    base = attention.prior(attention.pairs_of(s).reshape(attention.ROWS, -1))
    flat = attention.start()
    model = attention.Model(flat.copy(), base)
    model.tables()
    grad, count = model.gradient(s.inputs, s.classes, attention.BLOCK)
    def loss(f):
        m = attention.Model(f, base)
        m.tables()
        return -m.log_chances(s).sum() / count
    at = 0
    for name, shape in attention.SHAPES.items():
        size = int(np.prod(shape))
        i = at + int(np.argmax(np.abs(grad[at:at + size])))
        at += size
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-2
        down[i] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - grad[i]) < 0.05 * abs(grad[i]) + 1e-4, name


def test_a_token_in_its_class_depends_on_the_one_before():
    texts, v = _toy(3)
    texts += [np.array([70, 71] * 9), np.array([72, 73] * 9)]  # 71 and 73 are as frequent as each other
    v = attention.Vocabulary.of(np.bincount(np.concatenate(texts), minlength=80).astype(float))
    v.classes[:], v.inputs[:] = 0, np.arange(80)
    one = attention.Vocabulary(v.inputs, v.classes, v.pad, *attention._trees(np.bincount(np.concatenate(texts), minlength=80) + 0.05, v.classes))
    counts = np.zeros(2 * attention.CELLS, np.float32)
    np.add.at(counts, attention.turns_of(one, *attention.before(texts, 79))[0], 1)
    def chance(last, token):
        both = attention.within(one, counts, [np.array([last]), np.array([last, token])], 79)
        return np.exp(both[1] - both[0])
    for last in (70, 72, 5, 79):
        assert abs(sum(chance(last, t) for t in range(80)) - 1) < 1e-4
    assert chance(70, 71) > 0.5 > 0.1 > chance(70, 73) and chance(72, 73) > 0.5 > 0.1 > chance(72, 71)
    # brute force: the counts of a token's turns after the one before it
    pairs = Counter((int(a), int(b)) for t in texts for a, b in zip(np.concatenate([[79], t[:-1]]), t))
    place, share, n = attention.turns_of(one, np.array([71]), np.array([70]))
    assert n[0] == len(place) > 0 and counts[place].min() >= pairs[70, 71] and ((0 < share) & (share < 1)).all()
    alone = attention.Vocabulary.of(np.array([3.0, 1.0]))
    assert len(alone.turns) == 2 and attention.within(alone, counts * 0, [np.array([0, 1])], 0).shape == (1,)


def test_words_give_the_ids_of_the_whole_text():
    texts = [None, "", "A b  c \x85 d\x1ce", "\u0130x <|endoftext|> y", "\u65e5\u672c\u8a9e text \u00dcn\u00ef \u0391\u03a3", "it's 'S ''ll 12a3 --x", "\u00c9T\u00c9 caf\u00e9", " \n\t ", "a b a"] * 3
    reader = lm.Reader(lm.Words(np.array([lm.word_hash(b"a")]), np.array([7]), 1, 9, 3), WORD_BPE)
    whole = [np.frombuffer(i, "<u4").tolist() for i in reader.tokenizer.encode([t or "" for t in texts])]
    old, lm.Reader.KEEP = lm.Reader.KEEP, 4  # what words give is forgotten in between
    try:
        got = [r for at in range(0, len(texts), 5) for r in reader.read(texts[at:at + 5])]
    finally:
        lm.Reader.KEEP = old
    assert [np.frombuffer(r[0], "<u2").tolist() for r in got] == whole
    assert got[8][1:4] == (4, 3, pytest.approx(np.log10(1.5) + 2 * np.log10(7.5))) and got[8][4].tolist() == [lm.word_hash(b"b")] and got[8][5].tolist() == [1]


def test_lm_base_scores(spark, odd):
    learns = F.col("doc_id").isNotNull() & (F.col("doc_id") != 5)
    got = lm.scored(odd, learns, WORD_BPE).collect()
    rows = odd.collect()
    def words_of(t):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    count = Counter(w for r in rows if r.doc_id not in (None, 5) for w in words_of(r.text))
    ends = sum(r.doc_id not in (None, 5) for r in rows)
    total, distinct = sum(count.values()) + ends, len(count) + 1
    want = Counter()
    for r in rows:
        w = words_of(r.text)
        base = sum(np.log10((c + 0.5) / (total + 0.5 * (distinct + 1))) for c in [*(count[x] for x in w), ends])
        want[r.doc_id, len(w) + 1, 1 + sum(count[x] > 0 for x in w), total, round(base, 6)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    old, lm.FREQUENT = lm.FREQUENT, 0.01  # most words are joined
    try:
        again = lm.scored(odd, learns, WORD_BPE).collect()
    finally:
        lm.FREQUENT = old
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in again) == want
    assert lm.scored(odd.limit(0), learns, WORD_BPE).count() == 0
    none = lm.scored(odd, F.lit(False), WORD_BPE).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in none)


# ---- 10 --------------------------------------------------------------------------------------------------

def test_toxicity_counts_all_words_of_an_ngram():
    text = " ".join(f"abc{k}" for k in range(700))
    found = toxicity.Features().of(text)
    number = zlib.crc32(b" abc") & toxicity._SLOTS
    weight = np.zeros(1 << toxicity.BITS)
    weight[number] = 1.0
    score = toxicity.Model(weight, -9.0).score(found)
    assert abs(np.log(score / (1 - score)) + 9 - np.log2(701)) < 0.01


def test_toxicity(spark, odd):
    rng = np.random.default_rng(7)
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        rows.append((i, prose(rng, 60) + (" you vile rotter" if bad else "")))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None), (9999, 0, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train_fold(docs, known)
    got = toxicity.with_score(docs, model, "s").collect()
    assert all((r.s >= 0.5) == (r.doc_id % 3 == 0) and 0 <= r.s <= 1 for r in got)
    scores = {r.doc_id: r.s for r in toxicity.with_score(odd, model, "s").collect()}
    assert scores[2] == scores[3] == scores[4] < 0.5
    assert toxicity.clean(docs.withColumn("_toxicity", F.lit(1)), model).count() == 200
    one = toxicity.fit(docs, known.where("toxic = 0"))
    assert {round(r.s, 3) for r in toxicity.with_score(docs, one, "s").collect()} == {0.018}
    none = toxicity.fit(docs.limit(0), known.limit(0))
    assert toxicity.with_score(docs.limit(0), none, "s").count() == 0


def test_language_words_are_runs_of_letters_found_without_the_slow_class():
    from courtside.llm import language
    rng = np.random.default_rng(9)
    odd = "aZ é½Ⅷ²٣_9-\u0301\U0001d7d9中ª\U00010107"
    for _ in range(300):
        text = "".join(odd[i] for i in rng.integers(0, len(odd), 40))
        assert language._words(text) == language._WORDS(text)
    plain = "some words of prose, again and again " * 20_000
    start = time.perf_counter()
    language._words(plain)
    fast = time.perf_counter() - start
    start = time.perf_counter()
    language._WORDS(plain)
    assert fast * 3 < time.perf_counter() - start


def test_toxicity_fit_holds_little_more_than_its_rows():
    import tracemalloc
    rng = np.random.default_rng(5)
    label = (np.arange(600) % 3 == 0).astype(float)
    rows = [np.unique(np.r_[rng.integers(0, 1 << toxicity.BITS, 3000), np.arange(40) + 100 * int(y)]).astype(np.int64) << 32 | 1 for y in label]
    tracemalloc.start()
    model = toxicity.fit_rows(rows, label, steps=50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * sum(r.nbytes for r in rows)
    assert model.score(rows[0]) > 0.5 > model.score(rows[1])
