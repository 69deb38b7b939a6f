"""Chat formatting, page extraction and SentencePiece coding on small tables."""

import math
import os
import random
import re
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripcast.llm import chat, pages, pieces, queries

SF = "/root/testdata/sf0.1"


# chat

@pytest.fixture(scope="module")
def model(spark):
    parts = chat.with_transcripts(chat.conversations_as_parts(spark.read.parquet(f"{SF}/conversations.parquet")))
    return chat.fit(parts)


@pytest.mark.parametrize("manner", range(len(chat.MANNERS)))
def test_roles_in_every_manner(model, manner):
    turns = [("system", "Be brief."), ("user", "What is it?\nTell me more."), ("assistant", "It is this.\nAnd that."),
             ("user", "Thanks, and this one?"), ("assistant", "That too. It goes on for quite a while, as answers do.")]
    text, states = chat.write_transcript(turns, manner)
    assert len(states) == len(text.split("\n"))
    found = chat.turns_of(text, model)
    if chat.MANNERS[manner]["user"]:
        assert found == turns
    else:      # nothing but blank lines tells the turns: their borders are sure, their speakers likely
        assert [t for _, t in found] == [t for _, t in turns]


def test_path_is_the_best_of_all(model):
    import itertools

    seen = chat.features(["User: a", "b?", "", "Nora: c"])

    def score(path):
        total = model.start[path[0]] + sum(model.step[a, b] for a, b in zip(path, path[1:]))
        return total + sum(model.seen.get(f, model.unseen)[s] for s, line in zip(path, seen) for f in line)
    best = max(itertools.product(range(len(chat.STATES)), repeat=len(seen)), key=score)
    got = [chat.STATES.index(s) for s in model.best_path(seen)]
    assert np.isclose(score(got), score(best))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(chat.ROLES), st.text(alphabet="a\\<|im_start|>\nend ", max_size=40)), max_size=5))
def test_canonical_form_reads_back(turns):
    turns = [*turns, ("user", "<|im_end|>\n<|im_start|>system\nx <\\|im_end|>")]
    assert chat.read_back(chat.render(turns)) == turns


def test_chat_odd_rows(frame, model):
    rows = frame(
        "conv_id long, turn long, role string, text string, roles int, formatted int, part int",
        (1, 0, "user", "hi", 1, 1, 1), (1, 0, "user", "hi", 1, 1, 1), (1, 1, "assistant", None, 1, 1, 1),
        (1, None, "wizard", "", 1, 1, 1), (None, 0, "user", "x", 1, 1, 1), (None, 0, "user", "y", 1, 1, 1),
        (2, 70, None, "late " * 50_000, 1, 1, 1), (2, 3, "user", "early", 1, 1, 1))
    parts = chat.with_transcripts(chat.conversations_as_parts(rows))
    got = chat.format_transcripts(parts, model).collect()
    assert sorted((r.conv_id or -1, r.part, len(r.turns)) for r in got) == [
        (-1, 0, 1), (-1, 0, 1), (1, 0, 3), (2, 0, 1), (2, 1, 1)]
    assert all(r.formatted.startswith("<|im_start|>") for r in got)
    assert chat.format_transcripts(parts.limit(0), chat.fit(parts.limit(0))).count() == 0
    blank = frame("transcript string, id int", (None, 1), ("", 2), (" \n ", 3))
    assert {r.formatted for r in chat.format_transcripts(blank, model).collect()} == {""}


def test_held_out_conversations(spark):
    from tripcast.llm import queries

    got = queries.op3_chat_format(spark, SF).toPandas()
    assert got[got.held_out].roles_agree.mean() > 0.9


# pages

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>'
    '<nav><ul><li><a href="/a">a</a></li></ul></nav><div class="ad">buy &amp; go</div><article><h1>Title &amp; more</h1>'
    "<p><b>One  two<br>\n three&nbsp;<p>Four <i>fi</i>ve &lt;x&gt;</p><ul><li>six<li>seven</ul>"
    '<div class="comments"><p>I disagree</p></div></article><footer>&copy; x</footer>')


def test_main_text_of_a_page():
    assert pages.main_blocks(PAGE, set()) == ["Title & more", "One two three", "Four five <x>", "six", "seven"]


@pytest.mark.parametrize("source, text", [
    ("", ""), ("plain words", "plain words"), ("<p>a</p><!-- never closed <p>b</p>", "a"), ("<p>a<p", "a"),
    ("<div>x < y</div>", "x < y"), ("<script>never closed <p>b</p>", ""), ("<p title='a>b'>c</p>", "c"),
    ("</div></p>a</b>", "a"), ("<header>h</header><p>a</p><aside>b</aside>", "a"), ("<p hidden>a</p><p>b</p>", "b"),
    ("<p>a <span class='ad'>b</span> c</p>", "a\nc"), ("<b>" * 3000 + "deep" + "<div>" * 3000 + "er", "deep\ner"),
    ("<article><header><h1>t</h1></header>x</article><form>f</form>", "t\nx")])
def test_broken_and_marked_pages(source, text):
    assert "\n".join(pages.main_blocks(source, set())) == text


@pytest.mark.parametrize("source, text", [
    ("<div class='content has-sidebar'><article>a b c</article><div class='sidebar'>d</div></div>", "a b c"),
    ("<div class='content-sidebar-wrap'><main><p>a</p></main><aside>b</aside></div><footer>c</footer>", "a"),
    ("<body><form id='aspnetForm'><div class='menu'>m</div><p>a b</p><p>c</p></form></body>", "a b\nc"),
    ("<form><div class='has-sidebar'><article>a</article></div></form>", "a"),
    ("<article>a</article><div class='related'><article>b</article></div>", "a"),
    ("<p>a</p><div class='related'><article>b</article><article>c</article></div>", "a"),
    ("<p>a</p><div class='comments-area'><p>b b b b b</p></div>", "a"),
    ("<p>a</p><div class='sidebar'><p>b b b b b</p></div>", "a")])
def test_wrappers_of_the_article_stay(source, text):
    assert "\n".join(pages.main_blocks(source, set())) == text


def test_article_elements_choose_only_with_most_of_the_text():
    body = "<div><p>The story itself stands in a plain element.</p><p>And goes on.</p></div>"
    cards = "<article class='card'>Other one</article><article class='card'>Other two</article>"
    assert pages.main_blocks(body + cards, set()) == [
        "The story itself stands in a plain element.", "And goes on.", "Other one", "Other two"]
    whole = "<div id='t'>Top</div><h1>Headline</h1><article>The story itself, at some length</article>"
    assert pages.main_blocks(whole, set()) == ["The story itself, at some length"]      # nothing known of the site
    top = pages.parse(whole)[0][0].paths[-1]
    assert pages.main_blocks(whole, {top}) == ["Headline", "The story itself, at some length"]


def test_counts_of_a_part_are_plain_rows():
    source = "<div class='a'><p>One two <b>two</b></p><p>One two two</p></div><div class='b'>two three</div>tail"
    blocks, signs = pages.parse(source)
    packed = pages._packed(blocks, signs)
    styles, texts = pages._unpacked(packed)
    assert [(t.decode(), p) for t, p in texts] == [(b.text, b.paths) for b in blocks]
    assert [path for path, _ in styles] == list(signs)
    got = pages._count(pa.table({"host": ["h"] * 3, "mark": [1, 2, 1], "page": [packed] * 3})).to_pylist()
    assert [r["held"] for r in got if r["kind"] == pages.SITE] == [2]
    words, held = Counter(), Counter()
    for r in got:
        if r["kind"] == pages.WORD:
            words[r["key"], r["path"]] += r["n"]
            held[r["key"]] += r["held"]
    assert words == Counter({
        k: 2 * n for k, n in Counter((pages._hashed(w), b.paths[-1] if b.paths else 0)
                                     for b in blocks for w in b.text.lower().split()).items()})
    assert set(held.values()) == {2}
    assert {(r["key"], r["path"], r["n"]) for r in got if r["kind"] == pages.TEXT} == {
        (pages._hashed(b.text), path, 2) for b in blocks for path in b.paths}
    assert all(len(r) == 6 for r in got)


@pytest.mark.parametrize("buckets", [1, 7])
def test_counts_dealt_into_buckets_add_up(site_pages, buckets):
    """Sums of two parts, packed and dealt, are those of their plain rows."""
    parsed = [pages.parse(html) for _, _, html in site_pages]
    counts = [pages._count(pa.table({
        "host": ["h"] * 30, "mark": list(range(30)), "page": [pages._packed(*page) for page in part]}))
        for part in (parsed[:30], parsed[30:])]
    dealt = pa.concat_tables(pages._dealt(part, buckets) for part in counts)
    got = Counter()
    for bucket in set(dealt["bucket"].to_pylist()):
        for r in pages._add_up(dealt.filter(pc.equal(dealt["bucket"], bucket))).to_pylist():
            got.update({(r["path"], name): r[name] for name in pages.SUMS})
    n, held = Counter(), Counter()
    for r in pa.concat_tables(counts).to_pylist():
        n[r["kind"], r["key"], r["path"]] += r["n"]
        held[r["kind"], r["key"]] += r["held"]
    want = Counter()
    for (kind, key, path), times in n.items():
        if kind == pages.SITE:
            want[path, "site"] += held[kind, key]
        elif kind == pages.WORD:
            spread = math.log(held[kind, key])
            want.update({(path, "words"): times, (path, "spread_sum"): times * spread, (path, "spread_squares"): times * spread ** 2})
        else:
            names = ("pages", "style_sum", "styles") if kind == pages.STYLE else ("texts", "text_sum", "")
            want.update(dict(zip([(path, name) for name in names], (times, times * math.log(times), 1))))
    assert want[0, "site"] == 60 and max(held.values()) > 1
    for path, name in got:
        assert got[path, name] == pytest.approx(want[path, name])
    assert {path for path, name in want if name} == {path for path, _ in got}


def test_pages_and_counts_shuffle_in_little_room(spark):
    """All that the site trees write to disk, against the table's own size."""
    table = "/root/testdata/sf0.1/pages.parquet"
    jvm = spark.sparkContext._jsc.sc()

    def shuffled():
        jvm.listenerBus().waitUntilEmpty()
        executors = jvm.statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    before = shuffled()
    pages.importance(spark.read.parquet(table), "url", "html").count()
    assert shuffled() - before < 1.5 * os.path.getsize(table)


def test_template_of_a_site_goes_by_importance(frame):
    def page(i, host):
        return (i, f"http://{host}/{i}", f"<div><div id='top'>Welcome to us</div><div id='b{i}'><p>Story {i} of {host} "
                f"with its own words</p><p>and more {i}</p></div><div id='end'>Call {i % 2}</div></div>")
    rows = frame("page_id long, url string, html string", *[page(i, "a.org") for i in range(40)],
                 *[page(100 + i, "b.org") for i in range(3)])
    got = {r.page_id: r.text for r in pages.extract(rows).collect()}
    assert got[7] == "Story 7 of a.org with its own words\nand more 7"
    assert got[101].startswith("Welcome to us")      # too few pages to know


def test_long_notice_on_every_page_is_template(frame):
    notice = "We use small files to remember what you like and share them with our partners. " * 20
    rows = frame("page_id long, url string, html string", *[
        (i, f"http://a.org/{i}", f"<div id='x'>{notice}</div><div id='y'><p>Story {i}, told in its own words</p></div>")
        for i in range(30)])
    assert {r.page_id: r.text for r in pages.extract(rows).collect()} == {
        i: f"Story {i}, told in its own words" for i in range(30)}


def test_copies_of_an_article_are_no_template(frame):
    rows = frame("page_id long, url string, html string", *[
        (i, "http://a.org", f"<article><p>{'The same story' if i < 60 else f'Story {i}'} told at length</p></article>")
        for i in range(80)])
    got = {r.page_id: r.text for r in pages.extract(rows).collect()}
    assert got[3] == "The same story told at length" and got[70] == "Story 70 told at length"


@pytest.fixture(scope="module")
def site_pages():
    """Pages of one site: an article of rare words and two plain boxes whose words recur in changing texts."""
    draw = random.Random(3)
    pool = [f"menu{i}" for i in range(12)]
    return [
        (i, f"http://site.org/{i}", f"<div class='top'>{' '.join(draw.sample(pool, 6))}</div><div class='story'><p>"
         f"{' '.join(f'w{draw.randrange(4000)}' for _ in range(60))}</p></div><ul><li>{draw.choice(pool)}<li>{draw.choice(pool)}</ul>")
        for i in range(60)]


def test_importance_is_that_of_a_plain_tree(frame, site_pages):
    parsed = [pages.parse(html)[0] for _, _, html in site_pages]
    words = [[(b.paths[-1], w) for b in blocks for w in b.text.split()] for blocks in parsed]
    holders = {w: sum(any(w == v for _, v in page) for page in words) for page in words for _, w in page}
    values = {}
    for page in words:
        for path, w in page:
            values.setdefault(path, []).append(1 - math.log(holders[w]) / math.log(len(parsed)))
    means = {path: sum(v) / len(v) for path, v in values.items()}
    usual = sum(len(v) * means[p] ** 2 for p, v in values.items()) / sum(len(v) * means[p] for p, v in values.items())
    rows = frame("page_id long, url string, html string", *site_pages, *site_pages[:9])
    got = {r.path: r for r in pages.importance(rows, "url", "html").collect()}
    assert {p for p, r in got.items() if r.words} == set(means)
    for path, mean in means.items():
        error = math.sqrt(sum((v - mean) ** 2 for v in values[path])) / len(values[path])
        assert got[path].word_importance == pytest.approx(mean) and got[path].usual == pytest.approx(usual)
        assert got[path].word_error == pytest.approx(error, abs=1e-9)
    texts = {}
    for blocks in parsed:
        for path, text in {(p, b.text) for b in blocks for p in b.paths}:
            texts.setdefault(path, []).append(text)
    for path, found in texts.items():
        if path in means and len(found) == 60:
            entropy = sum(c * math.log(c) for c in Counter(found).values()) / len(found) / math.log(60)
            assert got[path].importance == pytest.approx(1 - entropy)


@pytest.mark.parametrize("part_bytes", [1 << 22, 6000])
def test_texts_of_common_words_go_without_names(frame, site_pages, part_bytes, monkeypatch):
    monkeypatch.setattr(pages, "PART_BYTES", part_bytes)
    rows = frame("page_id long, url string, html string", *site_pages)
    got = {r.page_id: r.text for r in pages.extract(rows, names=False).collect()}
    assert got == {i: re.search("<p>(.*?)</p>", html)[1] for i, _, html in site_pages}


def test_importance_is_that_of_the_whole_site_however_it_is_dealt(frame, site_pages, monkeypatch):
    rows = frame("page_id long, url string, html string", *site_pages)
    whole = {r.path: r for r in pages.importance(rows, "url", "html").collect()}
    monkeypatch.setattr(pages, "PART_BYTES", 6000)
    dealt = {r.path: r for r in pages.importance(rows, "url", "html").collect()}
    assert whole.keys() == dealt.keys()
    for path, r in whole.items():
        assert tuple(dealt[path])[2:] == pytest.approx(tuple(r)[2:], abs=1e-12)


def test_site_tree_alone_finds_most_marked_texts(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    left = {r.page_id: Counter(r.text.split("\n")) for r in pages.extract(table, names=False).collect()}
    marked, marked_gone, plain, plain_gone = 0, 0, 0, 0
    for r in table.collect():
        for b in pages.parse(r.html or "")[0]:
            stays = left[r.page_id][b.text] > 0
            left[r.page_id][b.text] -= 1
            if b.named_off:
                marked, marked_gone = marked + len(b.text), marked_gone + len(b.text) * (not stays)
            else:
                plain, plain_gone = plain + len(b.text), plain_gone + len(b.text) * (not stays)
    assert marked_gone > 0.7 * marked and plain_gone < 0.001 * plain


def test_page_odd_rows(frame):
    rows = frame("page_id long, url string, html string, host string, text string, low int, path int, n_chars int",
                 (1, None, PAGE, "", "", 1, 1, 1), (1, None, PAGE, "", "", 1, 1, 1), (2, "x", None, "", "", 1, 1, 1),
                 (None, "", "", "", "", 1, 1, 1), (3, "http://h", "<p>" + "w " * 100_000, "", "", 1, 1, 1))
    got = [tuple(r) for r in pages.extract(rows).collect()]
    assert sorted((i or 0, n) for i, _, _, n in got) == [(0, 0), (1, 50), (1, 50), (2, 0), (3, 199_999)]
    assert pages.extract(rows.limit(0)).count() == 0


# SentencePiece

@pytest.fixture(scope="module")
def public():
    return pieces.public_pieces()()


def slow_segment(model, word):
    n = len(word)
    best, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - 20), end):
            part = word[start:end]
            if part in model.normal:
                ids, score = [model.normal[part]], float(model.scores[model.normal[part]])
            elif len(part) == 1:
                ids, score = model._spelled(part)
            else:
                continue
            if best[start] + score > best[end]:
                best[end], back[end] = best[start] + score, (start, ids)
    ids, at = [], n
    while at:
        at, own = back[at]
        ids = own + ids
    return ids, best[n]


TEXT = st.text(alphabet=st.one_of(st.sampled_from("the anding \n.éß漢😀▁\x00"), st.characters(codec="utf-8")), max_size=25)


@settings(max_examples=200, deadline=None)
@given(text=TEXT)
def test_best_segmentation_and_round_trip(public, text):
    ids, score = public.encode(text)
    assert public.decode(ids) == text
    if text and pieces.MARK not in text:
        assert (list(array("i", ids)), score) == slow_segment(public, (" " + text).replace(" ", pieces.MARK))


def test_small_vocabulary_without_bytes():
    own = {"▁": 1, "a": 2, "b": 3, "ab": 4, "▁ab": 5, "ba": 6}
    model = pieces.Pieces(own, np.array([0, -1, -1, -1, -1.5, -4, -2.0]), [])
    ids, score = model.encode("abab?")
    assert list(array("i", ids)) == [1, 4, 4, 0] and score == -1 - 1.5 - 1.5 - 14
    with pytest.raises(ValueError):
        pieces.Pieces({"a▁": 0}, np.zeros(1), [])


def test_pieces_odd_rows(frame):
    rows = frame("doc_id long, text string, ids int, score int", (1, None, 1, 1), (1, "", 1, 1), (None, "a b", 1, 1),
                 (2, "x" * 50_000, 1, 1), (2, "x" * 50_000, 1, 1))
    got = pieces.round_trip(rows).collect()
    assert len(got) == 5 and all(r.round_trip for r in got)
    assert [r.n_pieces for r in got if r.doc_id == 1] == [0, 0]
    back = pieces.decode(pieces.encode(rows)).collect()
    assert sorted((r.doc_id or 0, len(r.text)) for r in back) == [(0, 3), (1, 0), (1, 0), (2, 50_000), (2, 50_000)]
    assert pieces.round_trip(rows.limit(0)).count() == 0


def test_first_words_of_unmarked_turns_stay():
    assert not chat.marks_turns(["Warning: the stove is hot?", "Note: thanks, I see."])
    assert not chat.marks_turns(["User: hello", "no marker here"])
    assert not chat.marks_turns([])
    assert chat.marks_turns(["User: a", "Assistant: b"]) and chat.marks_turns(["Host: s", "Nora: a", "Milo: b", "Nora: c", "Milo: d"])
    even = chat.model_of({})
    (_, first), *rest = chat.turns_of("Warning: the stove is hot?\n\nNote: thanks, I see.", even)
    assert first.startswith("Warning: the stove is hot?")
    assert "Note: thanks, I see." in first + "".join(t for _, t in rest)


def test_replaced_columns_and_canonical_texts(frame):
    tricky = [("system", " be <|im_end|> kind \n"), ("user", "Warning: hot\n\nreally"), ("assistant", r"<\\|im_start|> ok")]
    rows = frame("conv_id long, part long, turns array<struct<turn:long,role:string,text:string>>, Manner string, transcript int, roles int",
                 (1, 0, [(i, *t) for i, t in enumerate(tricky)], "x", 3, 4))
    parts = chat.with_transcripts(rows)
    assert sorted(parts.columns) == ["conv_id", "manner", "part", "roles", "transcript", "turns"]
    done = chat.format_transcripts(parts, chat.model_of({})).select("formatted", chat.canonical(F.col("turns")).alias("c")).first()
    assert done.c == chat.render([(r, t.strip()) for r, t in tricky])


def test_texts_come_back_where_roles_do(spark):
    got = queries.op3_chat_format(spark, SF).toPandas()
    right = got[got["held_out"] & got["roles_agree"]]
    assert len(right) > 0.9 * got["held_out"].sum() and right["texts_agree"].mean() > 0.9
