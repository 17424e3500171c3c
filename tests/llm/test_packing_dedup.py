"""Packing, near-duplicates, substring dedup and decontamination against brute force, and their odd cases."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docsift.llm import decontaminate, minhash, packing, substring

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, shard int, kept int, spans string, n_removed int, at string"
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def frame(spark, rows):
    """Documents with every other column null or clashing with a name that operators use."""
    return spark.createDataFrame([(i, t, None, None, None, 7, 7, 7, "x", 7, "x") for i, t in rows], DOCS)


def words(seed, n, vocabulary=5000):
    r = random.Random(seed)
    return ["w%d" % r.randrange(vocabulary) for _ in range(n)]


def naive_best_fit(lengths, window):
    open_, bins = [], 0
    for n in sorted(lengths, reverse=True):
        fit = [x for x in open_ if x >= n]
        if fit:
            open_.remove(min(fit))
            open_.append(min(fit) - n)
        else:
            bins += 1
            open_.append(window - n)
    return bins, sorted(open_)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 24), min_size=1, max_size=80))
def test_best_fit_is_that_of_the_plain_algorithm(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    free = {}
    seen = {n: 0 for n in counts}
    for length, first, each, window, offset in packing.best_fit(counts, 24):
        upto = min([s[1] for s in packing.best_fit(counts, 24) if s[0] == length and s[1] > first], default=counts[length])
        for r in range(first, upto):
            seen[length] += 1
            at = window + (r - first) // each
            free.setdefault(at, []).append((offset + (r - first) % each * length, length))
    assert seen == counts
    left = []
    for parts in free.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 24
        left.append(24 - at)
    assert sorted(free) == list(range(len(free)))
    assert (len(free), sorted(left)) == naive_best_fit(lengths, 24)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.text(max_size=20), st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "u v"])), max_size=5).map("".join), max_size=5))
def test_ids_are_the_tokenizers(texts):
    plain = Tokenizer.from_file(JSON)
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert packing.encoder(JSON, RANKS)(texts) == want
    assert packing.encoder(JSON, None)(texts) == want


def test_packing(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x y"), (5, " ".join(words(1, 9000))), (6, "ä<|endoftext|>ü")]
    packed = packing.pack(frame(spark, rows), JSON, RANKS, keep_ids=True)
    got = packed.toPandas()
    tokens = Tokenizer.from_file(JSON)
    long = np.array(tokens.encode(rows[5][1], add_special_tokens=False).ids + [1], "<u4")
    assert got.doc_id.isna().sum() == 1 and (got.doc_id == 3).sum() == 2
    pieces = got[got.doc_id == 5].sort_values("start")
    assert list(pieces.start) == list(range(0, len(long), 2048)) and set(pieces.doc_tokens) == {len(long)}
    for p in pieces.itertuples():
        assert p.ids_crc32 == zlib.crc32(long[p.start : p.start + p.length].tobytes())
    assert list(got[got.doc_id == 1].length) == [1] and list(got[got.doc_id == 2].ids_crc32) == [zlib.crc32(np.array([1], "<u4").tobytes())]
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 2048
    seq = packing.sequences(packed).toPandas()
    assert all(len(r.input_ids) == (r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else 2048) for r in seq.itertuples()) and seq.n_tokens.sum() == got.length.sum()
    assert packing.pack(frame(spark, []), JSON, RANKS).count() == 0


def brute_components(rows, n):
    sets = {i: minhash.shingles(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def families(seed):
    """Chains, stars and crowds of near-copies on both sides of the threshold."""
    r, rows = random.Random(seed), []
    for f in range(12):
        base = words(f, r.choice([3, 12, 40, 120]))
        for k in range(r.choice([1, 4, 14])):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 6)):
                w[r.randrange(len(w))] = "e%d" % r.randrange(10**6)
            rows.append((len(rows), " ".join(w)))
            if k % 3 == 0:
                base = w  # a chain
    common = words(99, 30)
    rows += [(len(rows) + i, " ".join(common + words(1000 + i, 9 + i % 4))) for i in range(60)]  # much in common, but not enough
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = families(3) + [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "One"), (5004, "ONE"), (5005, "É é"), (5006, "é É"), (5007, "a b"), (5008, "A\x0bB")]
    for n in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, rows), n).collect()}
        assert got == brute_components(rows, n)


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c"), (3, None), (4, "x y z"), (4, "p q r"), (5, "p q r")]
    got = minhash.near_duplicates(frame(spark, rows), 2).collect()
    assert len(got) == len(rows)
    assert {(r.component_id, r.kept) for r in got if r.doc_id is None} == {(None, True)}
    assert {(r.component_id, r.kept) for r in got if r.doc_id in (1, 2)} == {(1, True), (1, False)}
    assert {r.component_id for r in got if r.doc_id in (4, 5)} == {4}
    long = words(8, 40)
    near = " ".join([*long[:-1], "end"])
    rows = [(7, "x y z w"), (7, " ".join(long)), (8, "p q r s"), (9, near), (9, "k l m n"), (10, "K L M N"), (11, "p q r s t"), (12, " ".join(words(5, 60_000))), (12, " ".join(words(5, 60_000)))]
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(frame(spark, rows), 2).collect()}
    assert got == {(7, 7), (8, 8), (9, 7), (10, 7), (11, 11), (12, 12)}
    assert minhash.near_duplicates(frame(spark, []), 2).count() == 0


def test_hot_group_stays_linear(spark, monkeypatch):
    """Thousands of near copies of one text, which all copies are near and hardly two of them: rows stay in proportion."""
    r, base = random.Random(4), words(77, 60)

    def copy():
        w = list(base)
        for _ in range(2):
            w[r.randrange(len(w))] = "e%d" % r.randrange(10**6)
        return " ".join(w)

    made, plain = [], minhash.common.cut

    def counted(df, *a, **k):
        back = plain(df, *a, **k)
        made.append(back.count())
        return back

    monkeypatch.setattr(minhash.common, "cut", counted)
    most = []
    for size in (300, 1200):
        made.clear()
        rows = [(i, copy()) for i in range(size)] + [(size, " ".join(base))] + [(size + 1 + i, " ".join(words(i, 30))) for i in range(50)]
        got = {x.doc_id: x.component_id for x in minhash.near_duplicates(frame(spark, rows), 5).collect()}
        if size == 300:
            assert got == {i: c for i, (_, c) in brute_components(rows, 5).items()}
        most.append(max(n for n in made))
    assert most[1] < 6 * most[0], most


def test_sketch_is_the_set_alone_and_estimates():
    r = np.random.default_rng(5)
    a, b = r.integers(0, 2**63, 900).astype("u8"), r.integers(0, 2**63, 100).astype("u8")
    sets = [a, a[::-1], np.concatenate([a[:800], b]), b]
    reg = minhash.sketch(np.concatenate(sets), np.repeat(np.arange(4), [len(s) for s in sets]), 4, 2000)
    assert (reg[0] == reg[1]).all()
    got = minhash.likeliest(reg[[0, 0]].astype(int), reg[[2, 3]].astype(int), np.array([900.0, 900.0]), np.array([900.0, 100.0]))
    assert abs(got[0] - 0.8) < 0.04 and got[1] < 0.03


def test_boundaries_resist_insertions():
    text = " ".join(words(7, 400))
    digest, start, end = substring.chunks(text, 32, 4096)
    assert start[0] == 0 and end[-1] == len(text) and (start[1:] == end[:-1]).all()
    moved = substring.chunks("abcdefg" + text, 32, 4096)[0]
    assert len({tuple(x) for x in digest.tolist()} - {tuple(x) for x in moved.tolist()}) <= 2
    odd = "é" * 5000 + "漢字" * 3000
    _, start, end = substring.chunks(odd, 32, 4096)
    assert end[-1] == len(odd) and (end > start).all()


def brute_spans(rows, least):
    """Later occurrences of chunks in one pass, extended as long as the neighbouring characters are equal."""
    text, first, seen = dict(rows), {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        if not t:
            continue
        digest, start, end = substring.chunks(t, substring.MEAN, substring.MOST)
        for d, s, e in zip(map(tuple, digest.tolist()), start.tolist(), end.tolist(), strict=True):
            if d in first:
                seen.setdefault(i, []).append((s, e, *first[d]))
            first.setdefault(d, (i, s))
    out = {}
    for i, spans in seen.items():
        merged = []
        for s, e, o, at in sorted(spans):
            if merged and merged[-1][1] == s:
                merged[-1][1], merged[-1][3] = e, (o, at + e - s)
            else:
                merged.append([s, e, (o, at), (o, at + e - s)])
        wide = []
        for s, e, (o, left), (p, right) in merged:
            if e - s < substring.TRIED:
                continue
            while left > 0 and s > 0 and text[o][left - 1] == text[i][s - 1]:
                left, s = left - 1, s - 1
            while right < len(text[p]) and e < len(text[i]) and text[p][right] == text[i][e]:
                right, e = right + 1, e + 1
            if wide and s <= wide[-1][1]:
                wide[-1] = (wide[-1][0], max(wide[-1][1], e))
            else:
                wide.append((s, e))
        if keep := [x for x in wide if x[1] - x[0] >= least]:
            out[i] = keep
    return out


def test_substring_equals_brute_force(spark):
    passage = " ".join(words(42, 70))
    rows = [(i, " ".join(words(i, 120)) + " " + (passage if i % 3 == 0 else "") + " " + " ".join(words(i + 500, 60))) for i in range(30)]
    rows += [(100, passage), (101, passage + passage), (102, "x" * 9000), (103, "short"), (104, "short")]
    got = {r.doc_id: r for r in substring.dedup_substrings(frame(spark, rows)).collect()}
    want = brute_spans(rows, substring.LEAST)
    text = dict(rows)
    assert {i: [(s.start, s.end) for s in r.spans] for i, r in got.items() if r.spans} == want
    assert all(len(r.text) + r.n_removed == len(text[i]) for i, r in got.items())
    assert passage in got[0].text
    for i in range(3, 30, 3):  # to the character, but for what stands around it by chance
        at = text[i].index(passage)
        (s,) = got[i].spans
        assert at - 8 <= s.start <= at and at + len(passage) <= s.end <= at + len(passage) + 8
    assert all(got[i].text == text[i] for i in range(30) if i % 3)


def test_substring_odd_rows(spark):
    t = " ".join(words(1, 80))
    got = substring.dedup_substrings(frame(spark, [(None, t), (1, t), (2, None), (3, ""), (4, t)])).collect()
    assert {(r.doc_id, r.text) for r in got} == {(None, t), (1, t), (2, None), (3, ""), (4, "")}
    other, long = " ".join(words(2, 150)), " ".join(words(3, 40_000))
    got = substring.dedup_substrings(frame(spark, [(1, t), (2, "see " + t), (2, other), (2, other), (5, long), (6, long[:3000])])).collect()
    assert sorted((r.doc_id, len(r.text)) for r in got) == sorted([(1, len(t)), (2, 4), (2, len(other)), (2, len(other)), (5, len(long)), (6, 0)])
    assert substring.dedup_substrings(frame(spark, [])).count() == 0


def common_passages(a, b, least):
    """Spans of b, as long as can be, that stand in a: on the raw strings."""
    out, at = [], 0
    while at + least <= len(b):
        if b[at : at + least] in a:
            end = at + least
            while end < len(b) and b[at : end + 1] in a:
                end += 1
            out.append((at, end))
            at = end
        else:
            at += 1
    return out


def test_substring_takes_passages_whole_on_the_raw_strings(spark):
    """No boundary for long, one word over and over, insertions before a passage: all of a shared passage goes, whatever its length."""
    again, prose = "word " * 400, " ".join(words(77, 60)) + " "
    pairs = []
    for i, shared in enumerate([prose + again, again + prose + again, prose + "ab" * 20_000]):
        pairs.append((" ".join(words(1000 + i, 40)) + " <" + shared + "> " + " ".join(words(2000 + i, 40)), "(" * (7 * i) + " ".join(words(3000 + i, 30)) + " {" + shared + "} " + " ".join(words(4000 + i, 30))))
    for a, b in pairs:  # one pair a table: what stays is told from these two alone
        got = {r.doc_id: r for r in substring.dedup_substrings(frame(spark, [(1, a), (2, b)])).collect()}
        want = [x for x in common_passages(a, b, substring.LEAST)]
        assert any(s.start <= x[0] and x[1] <= s.end for x in want for s in got[2].spans) and len(want) >= 1
        assert [(s.start, s.end) for s in got[2].spans if s.source == 1] == want


def edit_distance_within(pattern, text):
    """Smallest distance of pattern to any substring of text, by the table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


@settings(max_examples=80, deadline=None)
@given(st.text("abc ", min_size=1, max_size=70), st.text("abc ", max_size=90))
def test_myers(pattern, text):
    assert decontaminate.myers(decontaminate.masks(pattern), len(pattern), text)[0] == edit_distance_within(pattern, text)


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=40))
def test_normalised_places(text):
    norm, shifts = decontaminate.normalise(text)
    for i, c in enumerate(norm):
        o = decontaminate._original(shifts, i)
        if c != " ":
            assert 0 <= o < len(text) and text[o].lower()[:1] == c[:1]


def test_short_items_match_exactly_and_as_words(spark):
    items = [(1, "What is the capital of Peru?"), (2, "art"), (3, " .. "), (4, "")]
    rows = [(1, "Q: what is  the capital of PERU"), (2, "What is the capital of Perus?"), (3, "What is the capitol of Peru?"), (4, "An art."), (5, "Party, artful."), (6, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((m.doc_id, m.item_id, m.distance, m.start, m.end) for m in decontaminate.matches(frame(spark, rows), bench).collect())
    assert got == [(1, 1, 0, 3, 31), (4, 2, 0, 3, 6)]


def test_matches_equal_brute_force(spark):
    r = random.Random(11)
    items = [(i, " ".join(words(i + 70, 14))) for i in range(6)] + [(90, "too short"), (91, None), (None, "x" * 50)]
    rows = []
    for i in range(40):
        t = list(items[i % 6][1])
        for _ in range(r.randrange(0, 10)):
            t[r.randrange(len(t))] = r.choice("qz-")
        rows.append((i, " ".join(words(i, 40)) + " " + "".join(t).upper() + ". " + " ".join(words(i + 300, 40))))
    rows += [(50, None), (51, ""), (52, items[0][1]), (52, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((m.doc_id, m.item_id, m.distance) for m in decontaminate.matches(frame(spark, rows), bench, block_chars=200).collect())
    want = []
    for d, t in rows:
        norm = decontaminate.normalise(t or "")[0]
        for i, x in items[:6]:
            p = decontaminate.normalise(x)[0].strip()
            k = decontaminate.budget(p, decontaminate.RATE)
            if norm and (e := edit_distance_within(p, norm)) <= k:
                want.append((d, i, e))
    assert got == sorted(want) and len({d for d, _, _ in got}) < 41
    assert decontaminate.matches(frame(spark, []), bench).count() == 0
    assert decontaminate.matches(frame(spark, rows), bench.limit(0)).count() == 0


@pytest.mark.parametrize("edges, want", [([(1, 2), (2, 3), (9, 8), (3, 4), (4, 5), (5, 6), (7, 7)], {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 8: 8, 9: 8}), ([], {})])
def test_components(spark, edges, want):
    from docsift.llm import common

    got = common.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.component_id for r in got.collect()} == want
