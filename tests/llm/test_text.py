"""BPE, decontamination, toxicity and page text."""

import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkseek.llm import bpe, decontamination, html_text, toxicity

from .helpers import EDGES, clashing, documents, shared_passages

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
REPLAY = bpe.Replay(RANKS)
SPLIT = bpe.splitter(public_tokenizers.PATTERN)

characters = st.one_of(st.characters(max_codepoint=0x24F), st.characters(exclude_categories=["Cs", "Cn"]), st.sampled_from("  \n\t\x1c\x1f\x85\xa0aab'st"))


@given(st.text(characters, max_size=60))
@settings(max_examples=300, deadline=None)
def test_ids_equal_the_library(text):
    assert SPLIT(text) == regex.findall(public_tokenizers.PATTERN, text)
    ids = [i for word in REPLAY.encode([w.encode() for w in SPLIT(text)]) for i in word]
    assert ids == REFERENCE.encode_ordinary(text)


def test_replay_of_many_words_at_once():
    pick = random.Random(1)
    words = ["".join(pick.choice("aaabtheing ") for _ in range(pick.randint(1, 30))).encode() for _ in range(3000)]
    assert [list(ids) for ids in REPLAY.encode(words)] == [REFERENCE._encode_single_piece(word) for word in words]


def test_words_merge_together(monkeypatch):
    # One step takes a pair of all words that hold it, so steps are far fewer than merges; words on both sides of the bound for it are right.
    pick = random.Random(2)
    words = ["".join(pick.choice("aabtheing 01é日") for _ in range(pick.randint(1, 9))).encode() for _ in range(4000)]
    words += [unit * (bpe.LONG_WORD + more) for unit in (b"a", b" ", b"ab", b"the") for more in (-1, 0, 1)] + [b""]
    steps = []
    form = bpe._Partners.form
    monkeypatch.setattr(bpe._Partners, "form", lambda *args: steps.append(1) or form(*args))
    found = [np.frombuffer(ids, dtype=np.int32).tolist() for ids in REPLAY.packed(words)]
    assert found == [REFERENCE._encode_single_piece(word) if word else [] for word in words]
    assert 0 < len(steps) // 2 < sum(map(len, words)) / 20


def test_an_earlier_merge_may_open_late():
    # "bc" comes before "ab", but only "ab" lets "abc" form, which ranks first.
    ranks = {bytes([b]): 1000 + b for b in range(256)} | {b"cd": 1, b"ab": 7, b"abcd": 3, b"xab": 2}
    own = bpe.Replay(ranks)
    library = tiktoken.Encoding("small", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    for word in (b"abcd", b"xabab", b"xabcdabab", b"aabb" * 5):
        assert list(own.encode([word])[0]) == library._encode_single_piece(word)


def test_encode_and_decode(spark):
    docs = clashing(documents(spark, EDGES))
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    found = bpe.decode(encoded, RANKS)
    assert found.columns == [*docs.columns, "ids", "decoded"]
    for row in found.collect():
        text = row.text or ""
        assert row.ids == REFERENCE.encode_ordinary(text)
        assert bytes(row.decoded) == text.encode()
    assert bpe.encode(documents(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def brute_items(text, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    row, hit, found = words(text), set(), set()
    for item_id, item in items:
        test = words(item)
        n = min(window, len(test))
        phrases = {tuple(test[s : s + n]) for s in range(len(test) - n + 1)} if n else set()
        for s in range(len(row) - n + 1):
            if tuple(row[s : s + n]) in phrases:
                hit.update(range(s, s + n))
                if item_id is not None:
                    found.add(str(item_id))
    return len(row), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1, 200, 1 << 20])
def test_items_against_brute_force(spark, block_bytes):
    texts = shared_passages(120, 2, 8, 50)
    items = [(k, text) for k, text in enumerate(texts[:25])] + [(3, texts[30]), (None, texts[31]), (50, None), (51, "..."), (52, "a"), (53, "É É"), (54, texts[7].upper())]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = EDGES + [(100 + k, text) for k, text in enumerate(texts)]
    docs = documents(spark, rows)
    for row in decontamination.find_items(docs, benchmark, block_bytes=block_bytes).withColumn("n_hit", decontamination.hit_words("hits")).collect():
        assert (row.n_words, row.n_hit, row["items"]) == brute_items(row.text, items)


def test_clean_documents_stay_whole(spark):
    passage = " ".join(f"w{k}" for k in range(30))
    rows = EDGES + [(10, passage), (11, passage + " y" * 569), (12, passage + " y" * 570), (13, passage + " y" * 571)]
    docs = clashing(documents(spark, rows))
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    kept = decontamination.clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(row.doc_id for row in kept.filter("doc_id >= 10").collect()) == [13]
    assert kept.filter("doc_id < 10 OR doc_id IS NULL").count() == len(EDGES)
    assert decontamination.clean(docs, benchmark.limit(0)).count() == len(rows)
    assert decontamination.clean(documents(spark, []), benchmark).count() == 0


def labelled(n):
    pick = random.Random(4)
    rows, labels = [], []
    for k in range(n):
        words = ["".join(pick.choice("abcdefgh") for _ in range(5)) for _ in range(pick.choice([20, 60, 800]))]
        toxic = k % 5 == 0
        for _ in range(3 if toxic else 0):
            words[pick.randrange(len(words))] = pick.choice(["Rotten", "rotter", "nasty"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = labelled(600)
    docs = clashing(documents(spark, rows + EDGES))
    truth = spark.createDataFrame(labels + [(9999, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, truth.filter("doc_id % 2 = 0"))
    scored = toxicity.score(docs, model, added="toxicity")
    assert scored.columns == [*docs.columns, "toxicity"]
    found = scored.select("doc_id", "text", "toxicity").collect()
    assert all(0 <= row.toxicity <= 1 for row in found)
    empty = {row.toxicity for row in found if not row.text}
    assert len(empty) == 1
    held = [(row.toxicity, row.doc_id % 5 == 0) for row in found if row.doc_id is not None and row.doc_id >= 10 and row.doc_id % 2]
    assert np.mean([(score >= 0.5) == toxic for score, toxic in held]) > 0.97


def test_toxicity_without_both_classes(spark):
    docs = documents(spark, EDGES)
    for labels, want in (([], 0.5), ([(1, 0)], 0.0), ([(1, 1)], 1.0), ([(1, 1), (77, 0)], 0.5)):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {row.score for row in toxicity.score(docs, model).collect()} == {want}


def test_toxicity_sample_is_bounded_and_repeatable(spark):
    rows, labels = labelled(200)
    truth = spark.createDataFrame(labels, "doc_id long, toxic int")
    one = toxicity.train(documents(spark, rows), truth, per_class=20, features=500)
    two = toxicity.train(documents(spark, rows[::-1]), truth, per_class=20, features=500)
    assert np.count_nonzero(one.ratio) <= 500
    assert np.allclose(one.weight, two.weight)


PAGES = {
    "<p>one<p>two</div><div>three": "one\n\ntwo\n\nthree",
    "<title>t</title><script>var a = '</p>';</script><style>p{}</style>seen<!-- no <b>never</b> -->": "seen",
    "<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>after": "- a\n- b\n  3. c\n  4. d\n\nafter",
    "<table><tr><th>name<th>n<tr><td>long name<td>1<tr><td>x<td>22</table>": "name      | n\nlong name | 1\nx         | 22",
    "a <span hidden>b</span><span style='display: none'>c</span><div aria-hidden=true>d</div>e": "a\nd\ne",
    "<textarea>a\n b &amp; <i></textarea><select><optgroup label=g><option>x<option>y</optgroup></select>z": "a\n b & <i>\ng\nx\ny\nz",
    "<svg><title>no</title><desc>no</desc><text>l</text><text>m</text></svg><math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>": "l\nm\nx=1",
    "<object>o</object> <video>v</video> <noscript>n</noscript><iframe>no</iframe>": "o v n",
    "<i><table><tr><td>a</i>b<td>c</table>d": "ab | c\n\nd",
    "<a title='x>y'>l</a><a title='m</a><b title='>n</b> <a": "ln <a",
    "<a title='never closed>m</a><b title=\"x>y\">n": "my\">n",
    "x<br>y &amp; z&nbsp;&eacute;  w": "x\ny & z\xa0é w",
    "<pre>a\n  b\n</pre>c": "a\n  b\n\nc",
    "<h1>T</h1><blockquote>q<p>r</blockquote>s": "T\n\n    q\n\n    r\n\ns",
    "a < b <unknown>c</unknown></b>": "a < b c",
    "<b>unclosed <i>tags": "unclosed tags",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n    d\nu\n    e",
    "<table><tr><td colspan=2>wide<td>z<tr><td>1<td>2<td>3</table>": "wide |   | z\n1    | 2 | 3",
    "<p>a<table><tr><td>in<ul><li>k</ul></table>b": "a\n\nin\n- k\n\nb",
    "<img alt='pic'> <hr>": "pic\n\n---",
    "": "",
}


@pytest.mark.parametrize("page", list(PAGES))
def test_layout(page):
    assert html_text.render(html_text.build(page)) == PAGES[page]


@given(st.lists(st.sampled_from(["<", ">", "/", "p", "li", "<td>", "<table>", "</table>", "<ul>", "&amp", '"', "=", " ", "\n", "<script>", "é", "<tr>", "<li value=9>", "</"]), max_size=60).map("".join))
@settings(max_examples=300, deadline=None)
def test_any_markup_renders(page):
    html_text.render(html_text.build(page))


@pytest.mark.parametrize("page", [
    "<b>" * 40_000 + "</i>" * 40_000, "<a " * 80_000, "<a \"" * 40_000 + ">", "<i><table><tr><td>" + "<b>" * 40_000 + "</i>" * 40_000,
    "<p>" + "<span>" * 40_000 + "<div>x</div>" * 40_000, "<div>" * 40_000 + "<ul></ul>" * 40_000, "<!--" * 80_000, "</" * 80_000,
])
def test_broken_markup_takes_linear_time(page):
    start = time.process_time()
    html_text.render(html_text.build(page))
    assert time.process_time() - start < 5  # some 0.2 s; minutes if a step searched the page or the open elements


def test_pages(spark):
    deep = "<div>" * 20_000 + "x"
    pages = spark.createDataFrame([(1, None), (1, None), (None, deep), (2, ""), (3, "<p>" + "y " * 100_000)], "page_id long, html string")
    found = html_text.extract(clashing(pages), text="shown").collect()
    assert sorted(len(row.shown) for row in found) == [0, 0, 0, 1, 199_999]
    assert html_text.extract(pages.limit(0)).count() == 0
