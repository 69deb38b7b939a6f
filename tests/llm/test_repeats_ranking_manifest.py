"""Suffix-array dedup, ranked search and the Merkle manifest against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripcast.llm import bags, merkle, queries, suffixes

SF = "/root/testdata/sf0.001"
DOCS = ("doc_id long, text string, lang string, source string, n_chars long, chunk int, tree string, at int, m int, "
        "score double, node int, total int, spans string, _place int")


def doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), 1, "t", 2, 3, 0.5, 4, 5, "x", 6)


@pytest.fixture
def odd(frame):
    """Nulls, empty and long texts, ties, repeated rows and columns whose names the operators use."""
    return [doc(5, None), doc(None, ""), doc(None, "b c " * 40, None), doc(3, "a b c d é" * 20), doc(3, "a b c d é" * 20),
            doc(9, "A B c D É" * 20), doc(7, "word " * 30_000), doc(2, " \t\n", None), doc(11, "x" * 99), doc(12, "x" * 99),
            doc(13, "x" * 100), doc(14, "yx" + "x" * 99, ""), doc(8, "word word other", "de")]


# suffixes

def removed(rows, least):
    """(id, bytes, kept) of each row: every string of ``least`` bytes in a set, in order."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - least + 1):
            window = data[p:p + least]
            if window in seen:
                gone[p:p + least] = True
            seen.add(window)
        out.append((doc_id, len(data), bytes(np.frombuffer(data, np.uint8)[~gone])))
    return sorted(out, key=repr)


def kept(df, **options):
    return sorted(((r.doc_id, r.n_bytes, bytes(r.kept)) for r in suffixes.remove_repeats(df, **options).collect()), key=repr)


def test_repeats_of_odd_rows(frame, odd):
    got = suffixes.remove_repeats(frame(DOCS, *odd).coalesce(1)).collect()
    assert sorted(((r.doc_id, r.n_bytes, bytes(r.kept)) for r in got), key=repr) == removed([r[:2] for r in odd], 100)
    for r in got:
        cut = [b for s in r.spans for b in range(s.start, s.stop)]
        assert len(cut) == r.n_bytes - len(r.kept) and all(
            a.stop < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_repeats_of_an_empty_table(frame):
    assert suffixes.remove_repeats(frame(DOCS)).collect() == []


@pytest.mark.parametrize("least, chunk, crowded, block, piece", [
    (100, 2000, 4096, 1 << 22, 1 << 14), (100, 1 << 21, 4096, 1 << 22, 1 << 14), (100, 3000, 3, 1 << 22, 1 << 14),
    (20, 1500, 50, 700, 30), (100, 5000, 10, 1000, 64), (7, 900, 20, 1 << 22, 1 << 14), (2, 300, 10**9, 100, 9)])
def test_repeats_against_all_strings(frame, least, chunk, crowded, block, piece):
    """Chunks, blocks, pieces and crowded grams cut the texts anywhere; nothing may depend on it."""
    rng = random.Random(least + chunk)
    base = ["".join(rng.choice("abé \n") for _ in range(rng.randint(0, 400))) for _ in range(5)] + ["a" * 500, "ab" * 300, ""]
    rows = []
    for i in range(40):
        text = "".join(rng.choice(base)[rng.randint(0, 50):] for _ in range(rng.randint(0, 4)))
        text += "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 200)))
        rows.append((rng.choice([None, i, i]), rng.choice([text, text, text, None])))
    df = frame("doc_id long, text string", *rows).coalesce(1)
    assert kept(df, least=least, chunk=chunk, crowded=crowded, block=block, piece=piece) == removed(rows, least)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", max_size=40), min_size=1, max_size=6), st.integers(2, 13))
def test_longest_previous_factors(texts, least):
    text = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    places = [p for t, e in zip(texts, ends) for p in range(e - len(t), e - least + 1)]
    seen, want = set(), []
    for p in places:
        window = bytes(text[p:p + least])
        want.append(window in seen)
        seen.add(window)
    got = suffixes.repeats(text, np.array(places, np.int64), np.arange(len(places)), least)
    assert got.tolist() == want


def test_equal_strings_share_their_smallest_gram():
    rng = random.Random(3)
    passage = "".join(rng.choice("abcde ") for _ in range(150))
    texts = ["".join(rng.choice("fghij") for _ in range(n)) + passage for n in (0, 37, 250)]
    own = suffixes.Chunk("".join(texts).encode(), [len(t) for t in texts], 100)
    runs = [(h, p, n) for low, first, ns, *_ in own.runs() for h, p, n in zip(low.tolist(), first.tolist(), ns.tolist())]
    cell = {p + k: h for h, p, n in runs for k in range(n)}
    ends = own.ends.tolist()
    assert len(cell) == sum(max(0, len(t) - 99) for t in texts)
    for back in range(100, 151):
        assert len({cell[e - back] for e in ends}) == 1


def test_op11_on_the_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = {(i, n, hashlib.sha256(k).hexdigest()) for i, n, k in removed([tuple(r) for r in docs.collect()], 100)}
    got = queries.op11_suffix_dedup(spark, SF).collect()
    assert {(r.doc_id, r.n_bytes, r.kept_sha256) for r in got} == want and len(got) == docs.count()
    assert any(r.n_spans > 1 for r in got) and all((r.n_removed > 0) == (r.n_spans > 0) for r in got)


# ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def ranking(docs, items, limit):
    """(item, rank, doc, score) by scoring every document for every item."""
    own = [(i, Counter(words(t)), len(words(t))) for i, t in docs]
    own = [d for d in own if d[2]]
    n_docs, n_terms = len(own), sum(n for *_, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        found = []
        for doc_id, held, n in own:
            m = 25 + (75 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (
                (10**9 * held[t]) // (1000 * held[t] + 8 * m)) for t in words(text) if t in held)
            if score > 0:
                found.append((-score, doc_id is not None, doc_id or 0, doc_id))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(found)[:limit])]
    return sorted(out, key=repr)


def ranked(docs, items, **options):
    return sorted((tuple(r) for r in bags.rank_documents(docs, items, **options).collect()), key=repr)


def test_terms_are_those_of_the_pattern():
    text = "".join(map(chr, range(0x250))) + "Ωμέγα ÄÖ a_b A1-b2 x y 日本 ﬁ\U0001f600z"
    assert [t.decode() for t in bags.terms(text.encode())] == words(text)
    assert bags.terms(None) == bags.terms(b" .,\n") == []


ITEMS = "item_id long, text string, doc_id int, item int, score int"


def test_ranking_of_odd_rows(frame, odd):
    items = [(1, "A b word É", 1, 1, 1), (2, None, 1, 1, 1), (1, "c c d", 1, 1, 1), (None, "other WORD", 1, 1, 1), (4, "", 1, 1, 1),
             (5, "nowhere", 1, 1, 1)]
    got = ranked(frame(DOCS, *odd), frame(ITEMS, *items))
    assert got == ranking([r[:2] for r in odd], [i[:2] for i in items], 10) and got


def test_ranking_of_empty_tables(frame, odd):
    items = frame(ITEMS, (1, "a b", 1, 1, 1))
    assert bags.rank_documents(frame(DOCS), items).collect() == []
    assert bags.rank_documents(frame(DOCS, *odd), frame(ITEMS)).collect() == []
    assert bags.rank_documents(frame(DOCS, doc(1, None)), items).collect() == []


@pytest.mark.parametrize("limit, postings, cells", [(10, 1 << 20, 1 << 22), (3, 20, 1 << 22), (5, 1 << 20, 40), (1, 7, 3)])
def test_ranking_against_every_score(frame, limit, postings, cells):
    """Copies and shuffled copies far beyond the limit, items in several blocks and groups."""
    rng = random.Random(limit)
    vocabulary = [f"t{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    copy = text(12)
    docs = [(rng.randrange(300), text(rng.randint(0, 30))) for _ in range(60)]
    docs += [(300 + i, " ".join(rng.sample(copy.split(), 12))) for i in range(40)]
    items = [(i % 17, text(rng.randint(0, 8))) for i in range(20)]
    got = ranked(frame("doc_id long, text string", *docs), frame("item_id long, text string", *items),
                 limit=limit, postings=postings, cells=cells)
    assert got == ranking(docs, items, limit)


def test_whole_numbers_beyond_doubles():
    """Items whose scores pass 2^53 are multiplied in whole numbers."""
    number, times = np.array([0, 1]), np.array([10**7, 10**7 + 1])
    weights = np.array([20_000, 19_999])
    big = bags.Items(np.array([7, 7]), number, times, weights)
    assert big.groups[0][2].dtype == np.int64
    assert bags.Items(np.array([7, 7]), number, np.array([1, 2]), weights).groups[0][2].dtype == np.float64


# manifest

def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    levels = [list(nodes)]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([digest(*low[i:i + 2]) for i in range(0, len(low), 2)])
    return levels


def path(levels, at):
    """(sibling, side) per level; a single node has neither."""
    out = []
    for level in levels[:-1]:
        out.append((level[at ^ 1], "L" if at & 1 else "R") if at ^ 1 < len(level) else ("", "-"))
        at >>= 1
    return out


def plain_manifest(rows):
    """(id, leaf, subroot, root, proof, steps) of rows (id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], digest(*map(told, r))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree([leaf for _, leaf in sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for g in order]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, (g, t) in enumerate(zip(order, trees)):
        ids = sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        for at, (doc_id, leaf) in enumerate(ids):
            steps = path(t, at) + path(top, k)
            out.append((doc_id, leaf, t[-1][0], top[-1][0], "".join(s for s, _ in steps), "".join(x for _, x in steps)))
    return sorted(out, key=repr)


def manifested(df, **options):
    return sorted((tuple(r)[:6] for r in merkle.manifest(df, **options).collect()), key=repr)


def test_manifest_of_odd_rows(frame, odd):
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in odd]
    assert manifested(frame(DOCS, *odd)) == plain_manifest(rows)


def test_manifest_of_an_empty_table(frame):
    assert merkle.manifest(frame(DOCS)).collect() == []


@pytest.mark.parametrize("stride", [1, 2, 3, 8])
def test_manifest_against_plain_trees(frame, stride):
    """Groups of 1 to 40 rows, and more groups than one block holds at the smaller strides."""
    rng = random.Random(stride)
    odd = [doc(rng.choice([None, i]), f"text {rng.randrange(50)}", rng.choice([None, "", "a", "b", "é", "zz", f"g{i % 7}"]))
           for i in range(150)] + [doc(1000 + i, "one", "alone" + "x" * i) for i in range(3)]
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in odd]
    df = frame(DOCS, *odd)
    assert manifested(df, stride=stride) == plain_manifest(rows)
    found = merkle.manifest(df, stride=stride, extra=F.col("doc_id") + 5)
    back = merkle.folded(F.col("leaf"), F.col("proof"), F.col("steps"))
    wrong = merkle.folded(F.sha2(F.lit("x"), 256), F.col("proof"), F.col("steps"))
    assert found.filter((back != F.col("root")) | (wrong == F.col("root"))).count() == 0
    assert found.filter(~F.col("extra").eqNullSafe(F.col("doc_id") + 5)).count() == 0


def test_op13_on_the_given_table(spark):
    got = queries.op13_merkle_manifest(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in got:
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0)


# the queries with SQL

@pytest.mark.parametrize("name", ["op12_ranked_search", "op13_merkle_manifest"])
def test_agrees_with_sql(spark, name):
    from checks.run_checks import duck, tidy

    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck(SF).execute(queries.SQL[name]).df()
    assert tidy(got) == tidy(want) and len(got)
    assert {c: got[c].dtype for c in got} == {c: want[c].dtype for c in got}
