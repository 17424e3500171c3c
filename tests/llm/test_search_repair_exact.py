"""Ranked search, conversation repair and exact dedup against brute force, and their odd cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from docsift.llm import exact, impact, repair

DOCS = "doc_id long, text string, lang string, term int, n int, score string, keep_id string, key string, text_sha256 string, bucket int"
ITEMS = "item_id long, text string, rank int, term string, doc_id long"
TURNS = "conv_id long, turn long, role string, text string, n int, copy int, digest string, audit string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, 7, 7, "x", "x", "x", "x", 7) for i, t in rows], DOCS)


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def ranked(rows, items, k):
    found = [(i, Counter(t), len(t)) for i, text in rows if (t := terms(text))]
    n, all_ = len(found), sum(x[2] for x in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item in {i for i, _ in items}:
        query = Counter(t for i, text in items if i == item for t in terms(text))
        scored = []
        for doc, c, length in found:
            m = 100 - 25 + (25 * length * n) // all_
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in query.items() if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def prose(r, n, vocabulary):
    return " ".join("W%d" % min(int(r.expovariate(0.05)), vocabulary) for _ in range(n))


@pytest.mark.parametrize(("shard", "block_terms"), [(1 << 20, 200_000), (40, 3)])
def test_search_equals_brute_force(spark, shard, block_terms):
    r = random.Random(3)
    rows = [(i, prose(r, r.randrange(1, 60), 300)) for i in range(300)]
    rows += [(i, None) for i in range(300, 303)] + [(303, ""), (304, "--- \x7f"), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (5, "w1 w2 w3"), (305, "Ünïcode w9 " * 3000), (306, "w1 w2 w3"), (307, "ÜNÏCODE É")]
    items = [(i, prose(r, 12, 300)) for i in range(8)] + [(8, None), (9, ""), (10, "ünïcode w9 w9"), (None, "w1 w2"), (3, "w250 w250"), (11, "nowhere")]
    got = impact.search(docs(spark, rows), spark.createDataFrame([(i, t, 7, "x", 7) for i, t in items], ITEMS), k=7, shard=shard, block_terms=block_terms)
    assert sorted(map(tuple, got.collect()), key=str) == ranked(rows, items, 7)


def test_search_of_empty_tables_is_empty(spark):
    one, none = docs(spark, [(1, "a b")]), docs(spark, [])
    items = spark.createDataFrame([(1, "a", 7, "x", 7)], ITEMS)
    assert impact.search(none, items).count() == 0
    assert impact.search(one, items.limit(0)).count() == 0
    assert impact.search(docs(spark, [(1, None), (2, "..")]), items).count() == 0


def test_a_shard_stops_before_its_postings_are_read():
    r = np.random.default_rng(1)
    n = 4000
    times = [{0: 1, 1: 1, **{t: 1 for t in range(2, 12)}} if d < 5 else {t: 1 for t in r.choice(np.arange(2, 40), 12, replace=False)} for d in range(n)]
    lengths = np.array([len(x) for x in times])
    shard = impact.Shard(lengths, np.array([sum(x.values()) for x in times]), np.array([t for x in times for t in x]), np.array([c for x in times for c in x.values()]), 400, n, sum(sum(x.values()) for x in times))
    ids = np.arange(5)
    factors = np.array([impact.weight(n, int(np.diff(shard.starts)[t])) for t in ids])

    class Counted(np.ndarray):
        read = 0

        def __getitem__(self, at):
            out = super().__getitem__(at)
            if isinstance(at, slice):
                Counted.read += len(out)
            return out

    shard.doc = shard.doc.view(Counted)
    places, scores = shard.top(ids, factors, 5)
    assert Counted.read < 0.5 * shard.starts[5]
    best = places[np.lexsort((places, -scores))[:5]]
    assert sorted(best.tolist()) == [0, 1, 2, 3, 4]
    dense = np.zeros(400, np.int64)
    dense[ids] = factors
    for p, s in zip(places, scores, strict=True):
        own = slice(shard.first[p], shard.first[p + 1])
        assert s == dense[shard.terms[own]] @ shard.impacts[own]


def all_repairs(rows):
    """Every edit sequence of a short conversation: (cost, audit, lines); two inserts in a row at most, more cannot help."""
    best = []

    def go(i, cost, audit, roles, lines, run):
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", "".join(roles)):
            best.append((cost, audit, lines))
        if run < 2:
            for name in ("user", "assistant"):
                go(i, cost + 2, audit + "I", [*roles, name[0]], [*lines, name + ":"], run + 1)
        if i == len(rows):
            return
        role, text, fault = rows[i]
        go(i + 1, cost + 3, audit + "D", roles, lines, 0)
        if fault in ("", "truncated"):
            charge = fault == "truncated"
            if role:
                go(i + 1, cost + charge, audit + "K", [*roles, role[0]], [*lines, f"{role}:{text}"], 0)
            for name in ("user", "assistant"):
                go(i + 1, cost + charge + 2, audit + "R", [*roles, name[0]], [*lines, f"{name}:{text}"], 0)

    go(0, 0, "", [], [], 0)
    return min(best, key=lambda x: x[:2])


def cheapest(rows):
    """The same for long ones, row by row."""
    nexts = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(states):
        for _ in range(2):
            for s, (c, a, lines) in list(states.items()):
                for name in ("user", "assistant"):
                    if t := nexts.get((s, name[0])):
                        x = (c + 2, a + "I", (lines, name + ":"))
                        states[t] = min(states.get(t, x), x, key=lambda y: y[:2])
        return states

    states = {"": (0, "", None)}
    for role, text, fault in rows:
        new = {}
        for s, (c, a, lines) in inserted(states).items():
            found = [(s, (c + 3, a + "D", lines))]
            if fault in ("", "truncated"):
                charge = fault == "truncated"
                found += [(t, (c + charge, a + "K", (lines, f"{role}:{text}"))) for t in [nexts.get((s, role[:1]))] if t]
                found += [(t, (c + charge + 2, a + "R", (lines, f"{name}:{text}"))) for name in ("user", "assistant") for t in [nexts.get((s, name[0]))] if t]
            for t, x in found:
                if t:
                    new[t] = min(new.get(t, x), x, key=lambda y: y[:2])
                else:
                    new[t] = x
        states = new
    cost, audit, lines = min((x for s, x in inserted(states).items() if s in ("", "a")), key=lambda y: y[:2])
    out = []
    while lines:
        lines, line = lines
        out.append(line)
    return cost, audit, out[::-1]


def told(rows):
    """conv_id, turn, role, text of damaged rows: what repair() should say of each conversation."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest(), text, turn))
    out = []
    for c, own in convs.items():
        own.sort(key=lambda x: x[:4])
        seen, lattice = set(), []
        for x in own:
            solid = x[4].strip(" \t\n\x0b\x0c\r")
            lattice.append((x[2], x[4], "blank" if not solid else "duplicate" if (x[2], x[4]) in seen else "" if solid[-1] in ".!?" else "truncated"))
            seen.add((x[2], x[4]))
        turns = {x[5] for x in own if x[5] is not None}
        count = Counter(f for _, _, f in lattice)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(lattice))
        cost, audit, lines = all_repairs(lattice) if len(lattice) < 4 else cheapest(lattice)
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def turns(seed, convs, most):
    r = random.Random(seed)
    texts = ["One.", "Two!", "Three?\n", "no end", " \t", "", "Ünd.", "x"]
    return [(c, r.choice([None, *range(12)]) if most < 20 else t, r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", " "]), r.choice(texts) + (str(r.randrange(99)) + "." if r.random() < 0.5 else "")) for c in convs for t in range(r.randrange(1, most))]


@pytest.mark.parametrize("block", [1, 3, 256])
def test_repair_equals_every_edit_sequence(spark, block):
    rows = turns(5, [None, *range(60)], 5) + turns(6, range(60, 80), 14) + turns(7, [80, 81], 400)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = repair.repair(frame, block=block)
    assert sorted(map(tuple, got.collect()), key=str) == told(rows)


def test_damage_and_conversations_of_which_nothing_is_left(spark):
    raw = [(c, t, role, text) for c, t, role, text in turns(9, range(40), 8)] + [(None, None, None, None), (7, None, None, "Ends."), (90, 1, "user", None)]
    gone = next((c, 0) for c in range(100, 400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    raw += [(*gone, "user", "Hello.")]
    kept = []
    for c, t, role, text in raw:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role, text = "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        kept += [(c, t, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    frame = spark.createDataFrame([(*x, 7, 7, "x", "x") for x in raw], TURNS)
    got = sorted(map(tuple, repair.repair(repair.damaged(frame), frame.select("conv_id")).collect()), key=str)
    left = {c for c, *_ in kept}
    empty = [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c in {c for c, *_ in raw} - left]
    assert gone[0] in {c for c, *_ in empty}
    assert got == sorted(told(kept) + empty, key=str)
    assert repair.repair(repair.damaged(frame.limit(0)), frame.limit(0).select("conv_id")).count() == 0


def test_the_heuristic_never_says_too_much():
    r = random.Random(11)
    for _ in range(200):
        rows = [(r.choice("uasx"), r.choice([0, 0, 0, 1, 2, 3])) for _ in range(r.randrange(0, 7))]
        (cost, audit), = repair.astar(rows, repair.NONE, True).values()
        names = {0: "", 1: "blank", 2: "duplicate", 3: "truncated"}
        assert (cost, audit) == cheapest([(i, "", names[f]) for i, f in rows])[:2]
        least = sum({0: 0, 1: 3, 2: 3, 3: 1}[f] for _, f in rows)
        assert least <= cost


def grouped(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    out = []
    for t, ids in by.items():
        keep = max((i for i in ids if i is not None), default=None)
        once = True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and once, hashlib.sha256(t.encode()).hexdigest()))
            once = once and i != keep
    return sorted(out, key=str)


@pytest.mark.parametrize(("bits", "capacity"), [(64, 8192), (64, 3), (4, 2), (1, 1)])
def test_exact_duplicates_equal_brute_force(spark, bits, capacity):
    from pyspark.sql import functions as F

    r = random.Random(2)
    rows = [(i, "text %d" % r.randrange(120)) for i in range(300)] + [(1000 + i, "copied") for i in range(200)]
    rows += [(None, "alone"), (None, "alone"), (None, "copied"), (400, None), (401, ""), (402, None), (403, "x" * 300_000), (404, "x" * 300_000), (405, "x" * 299_999 + "y"), (406, "same"), (406, "same"), (406, "other"), (407, "Same"), (408, "same ")]
    key = (lambda c: F.xxhash64(c)) if bits == 64 else (lambda c: F.shiftleft(F.xxhash64(c), 64 - bits))
    got = exact.exact_duplicates(docs(spark, rows), key, capacity).drop("bucket")
    assert sorted(map(tuple, got.collect()), key=str) == grouped(rows)


def test_the_directory_holds_every_key_in_a_bucket_that_is_not_full(spark):
    from pyspark.sql import functions as F

    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    slots, depth = exact.directory(keys, 100)
    rows = slots.collect()
    assert sorted(x.slot for x in rows) == list(range(2**depth))
    of = {x.slot: (x.bucket, x.local_depth) for x in rows}
    full = Counter(of[(x.key % 2**64) >> (64 - depth)][0] for x in keys.collect())
    assert max(full.values()) <= 100 and sum(full.values()) == 5000
    for slot, (bucket, local) in of.items():
        assert slot >> (depth - local) == bucket >> (depth - local) and bucket % 2 ** (depth - local) == 0


def test_exact_duplicates_of_an_empty_table_are_none(spark):
    assert exact.exact_duplicates(docs(spark, [])).count() == 0
