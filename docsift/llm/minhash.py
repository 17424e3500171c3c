"""Near-duplicates by SetSketch registers: bands of register values propose, a joint likelihood sifts, full sets confirm.

A register is the truncated, exponentially spaced minimum floor(1 - log_b x) of exponential hash values x. Each word
shingle sends a Poisson stream of points to random registers, so that registers are independent and a document costs its
shingles and some m log m points, not shingles times registers.

No group meets in one task and no group is paired with itself: copies of one shingle set are first one class; members of
equal bands form a group under the smallest of them, which all others are compared with (a star). Groups whose members are
then in several components are merged where their centres are linked and their members mostly the same, and elect another
centre, the member that agrees best with the commonest registers, as long as that finds links enough. Jaccard distance is a
metric, so what stars leave open can be told from the distances to a last centre: a member further than twice the bound from
it has no partner among those near it. The rest, members of different components alone, meet in blocks, by their registers
and then their hashed sets. A pair at the threshold shares no band with
probability (1 - 0.8 ** rows) ** bands, about 1e-7.

Defined results: null text or one without words has an empty set and links with nothing; rows that share a doc_id are one
document, linked through each of its sets; very long texts are sketched whole, one at a time; a null doc_id links with
nothing, has no component and is kept; ties go to the smaller doc_id; an empty table gives an empty result; more columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

U = np.uint64
BANDS, ROWS, BASE, RATE = 40, 5, 1.02, 20.0
#: Sides of a join up to this many ids are broadcast (some 16 MB); larger ones are shuffled.
BROADCAST_IDS = 500_000
#: Rows of the blocks in which members that a star left open are compared.
BLOCK_LEFT, BLOCK_RIGHT, BLOCK_SHINGLES = 256, 4096, 2_000_000
#: Members whose registers tell the commonest values of a group, and groups whose values are broadcast (400 bytes each).
MODEL, BROADCAST_MODES = 64, 20_000
#: Share of equal registers from which a pair is confirmed by its sets: over four standard errors below 0.8.
LIKELY = 0.68
#: Links that another round of stars must find for each open member, to be followed by one more; blocks do the rest.
WORTH = 0.01


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode().lower().split()


def shingles(text: str | None, n: int) -> set[tuple[bytes, ...]]:
    w = words(text)
    return {tuple(w)} if 0 < len(w) < n else set(zip(*(w[i:] for i in range(n)), strict=False))


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles."""
    w = words(text)
    if not w:
        return np.empty(0, U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), U, len(w))
    if len(w) < n:
        n = len(w)
    out = np.full(len(w) - n + 1, n, U)
    for i in range(n):
        out = mix(out * U(0x9E3779B97F4A7C15) + h[i : len(w) - n + 1 + i])
    return np.unique(out)


def digest(hashes: np.ndarray) -> tuple[int, int, int]:
    """128 bits and the size of a set of hashes."""
    return int(mix(hashes).sum(dtype=U)), int(mix(hashes ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U)), len(hashes)


def sketch(hashes: np.ndarray, owner: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m registers of n sets; owner: the set of each hash. Sets without members get zeros."""
    low = np.full(n * m, np.inf)
    worst = np.full(n, np.inf)
    worst[np.bincount(owner, minlength=n) == 0] = 0
    alive, at, step = np.arange(len(hashes)), np.zeros(len(hashes)), 0
    while len(alive):
        k = int(np.clip(65_536 // len(alive), 1, 64))
        z = mix(hashes[alive, None] + (np.arange(step, step + k, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15))
        x = at[:, None] + np.cumsum(-np.log(((z >> U(11)) + U(1)).astype("f8") * 2.0**-53) / m, axis=1)
        to = owner[alive, None] * m + (mix(z ^ U(0xD1B54A32D192ED03)) % U(m)).astype("i8")
        near = x < worst[owner[alive], None]
        np.minimum.at(low, to[near], x[near])
        worst = np.where(worst > 0, low.reshape(n, m).max(axis=1), 0)
        keep = x[:, -1] < worst[owner[alive]]
        alive, at, step = alive[keep], x[keep, -1], step + k
    with np.errstate(divide="ignore"):
        value = np.floor(1 - np.log(low / RATE) / np.log(BASE))
    return np.clip(np.where(np.isfinite(low), value, 0), 0, 65_535).astype("u2").reshape(n, m)


def likeliest(one: np.ndarray, two: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of greatest joint likelihood, from register rows and set sizes."""
    above, below = (one > two).sum(1)[:, None], (one < two).sum(1)[:, None]
    same = one.shape[1] - above - below
    u = (a / (a + b))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)
    j = np.linspace(0, 1, 101)[None, :] * top
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    plus, minus = p(u - v * j), p(v - u * j)
    with np.errstate(divide="ignore", invalid="ignore"):
        term = lambda k, q: np.where(k > 0, k * np.log(np.maximum(q, 1e-300)), 0)
        total = term(above, plus) + term(below, minus) + term(same, 1 - plus - minus)
    return np.take_along_axis(j, total.argmax(1)[:, None], 1)[:, 0]


def sketched(docs: DataFrame, n: int, m: int) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digest of the set), registers (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text"):
            sets, known, of = [], {}, []
            for t in b.column("text").to_pylist():
                h = shingle_hashes(t, n)
                key = digest(h)
                if key not in known:
                    known[key] = len(sets)
                    sets.append(h)
                of.append(key)
            flat = np.concatenate(sets) if sets else np.empty(0, U)
            reg = sketch(flat, np.repeat(np.arange(len(sets)), [len(s) for s in sets]), len(sets), m)
            rows = [reg[known[k]].tobytes() if k[2] else None for k in of]
            signed = lambda i: pa.array(np.array([k[i] for k in of], U).view("i8"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([k[2] for k in of], pa.int64()), signed(0), signed(1), pa.array(rows, pa.binary())], names=["doc_id", "n_shingles", "d1", "d2", "registers"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, registers binary")


def banded(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    """x, key: a row for each band of each representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                reg = np.frombuffer(b"".join(part.column("registers").to_pylist()), "u2").reshape(part.num_rows, bands, rows)
                key = np.broadcast_to(np.arange(bands, dtype=U) + U(1), (part.num_rows, bands))
                for i in range(rows):
                    key = mix(key * U(0x9E3779B97F4A7C15) + reg[:, :, i].astype(U))
                ids = np.repeat(part.column("doc_id").to_numpy(), bands)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(key.reshape(-1).view("i8"))], names=["x", "key"])

    return reps.select("doc_id", "registers").mapInArrow(run, "x long, key long")


class _Verifier:
    """Exact similarity of candidate pairs, after a first sifting by registers."""

    def __init__(self, reps: DataFrame, texts: DataFrame, n: int, least: float, files: int):
        self.reps, self.texts, self.n, self.least, self.files = reps, texts, n, least, files

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b) -> (a, b, jaccard, linked) of those whose estimate may be enough."""
        n, least = self.n, self.least
        side = lambda s: self.reps.select(F.col("doc_id").alias(s), F.col("n_shingles").alias(f"n{s}"), F.col("registers").alias(f"r{s}"))

        def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 2000):
                    p = b.slice(at, 2000)
                    one, two = (np.frombuffer(b"".join(p.column(c).to_pylist()), "u2").reshape(p.num_rows, -1).astype("i4") for c in ("ra", "rb"))
                    ok = likeliest(one, two, p.column("na").to_numpy().astype("f8"), p.column("nb").to_numpy().astype("f8")) >= least
                    yield pa.RecordBatch.from_arrays([p.column("a"), p.column("b")], names=["a", "b"]).filter(pa.array(ok))

        # Cut here, lest both functions run in one stage: an executor would hold twice the Python workers.
        likely = common.cut(pairs.join(side("a"), "a").join(side("b"), "b").where("least(na, nb) >= 0.4 * greatest(na, nb)").mapInArrow(sift, "a long, b long"), files=self.files)
        text = lambda s: self.texts.select(F.col("id").alias(s), F.col("text").alias(f"t{s}"))

        def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last: tuple[str, set] = ("", set())
            for b in common.slices(common.slices(batches, "ta"), "tb"):
                share, linked = [], []
                for ta, tb in zip(b.column("ta").to_pylist(), b.column("tb").to_pylist(), strict=True):
                    if last[0] != tb:
                        last = (tb, shingles(tb, n))
                    one, two = shingles(ta, n), last[1]
                    both = len(one & two)
                    whole = len(one) + len(two) - both
                    share.append(both / whole if whole else 0.0)
                    linked.append(whole > 0 and 100 * both >= 80 * whole)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(share, pa.float64()), pa.array(linked, pa.bool_())], names=["a", "b", "jaccard", "linked"])

        full = likely.join(text("a"), "a").join(text("b"), "b").select("a", "b", "ta", "tb")
        return full.mapInArrow(confirm, "a long, b long, jaccard double, linked boolean")


def _compare_block(n: int):
    """Links of one block that join two of its components; n: words of a shingle."""

    def compare(block: pa.Table) -> pa.Table:
        is_left = pc.fill_null(block.column("left"), False)
        l, r = block.filter(is_left), block.filter(pc.invert(is_left))
        out: list[tuple[int, int]] = []
        if l.num_rows and r.num_rows:
            number = lambda c: r.column(c).combine_chunks().to_numpy(zero_copy_only=False)
            rr = np.frombuffer(b"".join(r.column("registers").to_pylist()), "u2").reshape(r.num_rows, -1)
            rx, rc, rn, rj, rin = number("x"), number("component").copy(), number("n"), number("jaccard").astype("f8"), number("inside").astype(bool)
            texts, sets = r.column("text"), {}
            into: dict[int, int] = {}  # components that this block has joined

            def now(c: int) -> int:
                while c in into:
                    c = into[c]
                return c

            for x, c, m, j, reg, text in zip(*(l.column(k).to_pylist() for k in ("x", "component", "n", "jaccard", "registers", "text")), strict=True):
                c = now(c)
                may = (rc != c) & (np.minimum(rn, m) >= 0.8 * np.maximum(rn, m) - 1e-9) & np.where(rin, (j is not None) & (rj <= (j or 0) + 0.2 + 1e-9), rx < x)
                at = np.flatnonzero(may)
                at = at[(rr[at] == np.frombuffer(reg, "u2")).mean(1) >= LIKELY] if len(at) else at
                own = shingle_hashes(text, n) if len(at) else None
                for i in at.tolist():
                    if rc[i] == c:
                        continue  # joined by a link found meanwhile
                    if i not in sets:
                        sets[i] = shingle_hashes(texts[i].as_py(), n)
                    both = int((own[np.minimum(np.searchsorted(own, sets[i]), len(own) - 1)] == sets[i]).sum())
                    if 100 * both >= 80 * (m + int(rn[i]) - both):
                        out.append((x, int(rx[i])))
                        into[c] = joined = int(rc[i])
                        rc[rc == c] = joined
                        c = joined
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return compare


def _join_blocks(rows: DataFrame, n: int, files: int) -> DataFrame:
    """Links (a, b) between the components of a group that its stars leave open, enough of them to connect what is connected.

    rows: g, x, component, jaccard (with the group's last centre; null if far), inside (linked with it), n, registers, text. Each
    member outside that centre's ball meets the members of other components in blocks of bounded size: sizes, the
    triangle inequality and equal registers sift, hashed sets confirm, and of a block's links only those leave the task that
    join two components there.
    """
    sizes = rows.groupBy("g").agg(F.count("*").alias("all"), F.count(F.when(~F.col("inside"), 1)).alias("out"), F.max(F.when(~F.col("inside"), F.col("jaccard"))).alias("nearest"), F.sum("n").alias("mass"))
    sizes = common.cut(sizes, files=files)
    few = sizes.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    # Inside the ball only those matter that the triangle inequality lets meet the nearest member outside.
    rows = rows.join(F.broadcast(sizes) if few else sizes, "g").where("not inside or jaccard <= nearest + 0.2 + 1e-9")
    parts = lambda count, rows_: F.ceil(F.greatest(F.col(count) / rows_, F.col("mass") / BLOCK_SHINGLES)).cast("int")
    lefts, rights = parts("out", BLOCK_LEFT), parts("all", BLOCK_RIGHT)
    spread = lambda n, salt: F.pmod(F.xxhash64("x", F.lit(salt)), n).cast("int")
    columns = ["g", "x", "component", "jaccard", "inside", "n", "registers", "text"]
    left = rows.where(~F.col("inside")).select(*columns, F.lit(True).alias("left"), spread(lefts, 1).alias("i"), F.explode(F.sequence(F.lit(0), rights - 1)).alias("j"))
    right = rows.select(*columns, F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), lefts - 1)).alias("i"), spread(rights, 2).alias("j"))
    return left.unionByName(right).groupBy("g", "i", "j").applyInArrow(_compare_block(n), "a long, b long").distinct()


def _centres(rows: DataFrame, files: int) -> DataFrame:
    """g, c, own (component of c): the member of each group whose registers agree best with the commonest ones of the group.

    Whoever is near most members of a group (what the others were copied from) agrees best, so its star reaches furthest.
    The commonest values are read off the MODEL members of smallest hash; every member is held against them. Which member is
    the centre decides how much work is left, not what is found.
    """
    first = rows.select("g", "x", "registers").withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("x"), "x"))).where(F.col("r") <= MODEL).drop("r")

    def common_values(group: pa.Table) -> pa.Table:
        reg = np.sort(np.frombuffer(b"".join(group.column("registers").to_pylist()), "u2").reshape(group.num_rows, -1), axis=0)
        run, best, mode = np.ones(reg.shape[1], int), np.ones(reg.shape[1], int), reg[0].copy()
        for one, two in zip(reg, reg[1:], strict=False):
            run = np.where(one == two, run + 1, 1)
            mode, best = np.where(run > best, two, mode), np.maximum(run, best)
        return pa.table({"g": group.column("g")[:1], "mode": pa.array([mode.astype("u2").tobytes()], pa.binary())})

    modes = common.cut(first.groupBy("g").applyInArrow(common_values, "g long, mode binary"), files=files)  # MODEL rows a group
    few = modes.limit(BROADCAST_MODES + 1).count() <= BROADCAST_MODES

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = (np.frombuffer(b"".join(b.column(c).to_pylist()), "u2").reshape(b.num_rows, -1) if b.num_rows else np.empty((0, 1)) for c in ("registers", "mode"))
            yield pa.RecordBatch.from_arrays([b.column("g"), b.column("x"), b.column("component"), pa.array((one == two).sum(1), pa.int64())], names=["g", "x", "component", "agree"])

    held = rows.select("g", "x", "component", "registers").join(F.broadcast(modes) if few else modes, "g").select("g", "x", "component", "registers", "mode")
    best = held.mapInArrow(agree, "g long, x long, component long, agree long").groupBy("g").agg(F.max(F.struct("agree", (-F.col("x")).alias("x"), "component")).alias("m"))
    return common.cut(best.select("g", (-F.col("m.x")).alias("c"), F.col("m.component").alias("own")), old=[modes], files=files)


def _held(df: DataFrame) -> DataFrame:
    """df for one side of a join: broadcast if counted to be small, else shuffled."""
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def _open(rows: DataFrame, labels: DataFrame, files: int, old: list[DataFrame]) -> DataFrame:
    """rows (g, x, ...) of groups whose members are in several components, and the component of each."""
    rows = common.cut(rows.join(labels.select(F.col("id").alias("x"), "component_id"), "x", "left").withColumn("component", F.coalesce("component_id", "x")).drop("component_id"), old=old, files=files)
    several = common.cut(rows.groupBy("g").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("g"), files=files)
    return common.cut(rows.join(_held(several), "g", "left_semi"), old=[rows, several], files=files)


def _merged(rows: DataFrame, labels: DataFrame, files: int) -> DataFrame:
    """rows (g, x, ...), once each, with a component's groups under one g where that makes no more pairs than they have apart.

    Near copies of one text share bands under many centres, with nearly the same members: apart, each group would repeat the
    others' work. Groups that are joined by a chain, with other members each, stay apart.
    """
    sizes = rows.groupBy("g").agg(F.count("*").cast("double").alias("n")).join(labels.select(F.col("id").alias("g"), "component_id"), "g", "left")
    sizes = common.cut(sizes.select("g", "n", F.coalesce("component_id", "g").alias("to")), files=files)
    apart = sizes.groupBy("to").agg(F.sum(F.col("n") * F.col("n")).alias("apart"), F.count("*").alias("groups")).where("groups > 1")
    moved = common.cut(sizes.join(apart, "to").select("g", "to", "apart"), old=[sizes], files=files)
    whole = rows.join(_held(moved), "g").select("to", "apart", "x").distinct().groupBy("to", "apart").agg(F.count("*").cast("double").alias("n"))
    better = common.cut(moved.join(whole.where("n * n <= apart").select("to"), "to").select("g", "to"), files=files)
    back = rows.join(_held(better), "g", "left").withColumn("g", F.coalesce("to", "g")).drop("to").dropDuplicates(["g", "x"])
    return common.cut(back, old=[moved, better], files=files)


def _joined(labels: DataFrame, more: DataFrame, files: int) -> DataFrame:
    """Labels after more links (a, b): only the components that these join are gone through again."""
    of = lambda s: labels.select(F.col("id").alias(s), F.col("component_id").alias(f"c{s}"))
    pairs = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    pairs = common.cut(pairs.where("a <> b").distinct(), files=files)
    moved = common.components(pairs, files, old=[pairs])
    to = _held(moved.select(F.col("id").alias("component_id"), F.col("component_id").alias("to")))
    kept = labels.join(to, "component_id", "left").select("id", F.coalesce("to", "component_id").alias("component_id"))
    return common.cut(kept.union(moved.join(labels.select("id"), "id", "left_anti")), old=[labels, moved, more], files=files)


def links(reps: DataFrame, texts_of, n: int, bands: int, rows: int, files: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) that are linked and connect all that is connected, and their components. files: of each table that is cut.

    Members of a group share a band with its centre. First each member is compared with the centre (a star). Then, as long as
    that finds links enough, groups that are in several components yet elect another centre, and members of other components
    than its own are compared with it. What is still in several components is compared with one more centre, then in blocks.
    """
    all_bands = common.cut(banded(reps, bands, rows))
    sizes = all_bands.groupBy("key").agg(F.min("x").alias("g"), F.count("*").alias("n")).where("n > 1")
    members = common.cut(all_bands.join(sizes.select("key", "g"), "key").select("g", "x").distinct(), old=[all_bands], files=files)
    texts = texts_of(members.select(F.col("x").alias("id")).distinct())
    verify = _Verifier(reps, texts, n, 0.45, files)
    seen = common.cut(verify(members.where("x <> g").select(F.col("x").alias("a"), F.col("g").alias("b"))), files=files)
    edges = common.cut(seen.where("linked").select("a", "b"), files=files)
    told = members.where("x <> g").join(seen.select(F.col("a").alias("x"), F.col("b").alias("g"), "jaccard", "linked"), ["x", "g"], "left")
    told = told.select("g", "x", F.when(F.col("jaccard") >= 0.6, F.col("jaccard")).alias("jaccard"), F.coalesce("linked", F.lit(False)).alias("inside"))
    keys = told.groupBy("g").agg(F.count(F.when(~F.col("inside"), 1)).alias("out"), F.count(F.when(F.col("inside") | F.col("jaccard").isNotNull(), 1)).alias("near"))
    # One member outside and nobody who could meet it: nothing is open.
    left_open = common.cut(told.join(keys.where("out > 1 or (out = 1 and near > 1)").select("g"), "g", "left_semi"), old=[seen, members], files=files)
    labels = common.components(edges, files)
    lean = _open(left_open.select("g", "x"), labels, files, [left_open])
    left_open = _merged(lean.drop("component"), labels, files)
    # What is needed of each member is joined once and carried along.
    left_open = common.cut(left_open.join(reps.select(F.col("doc_id").alias("x"), F.col("n_shingles").alias("n"), "registers"), "x"), old=[lean, left_open], files=files)
    left_open = _open(left_open, labels, files, [left_open])
    while (size := left_open.count()) > 0:
        centres = _centres(left_open, files)
        at = _held(centres)
        star = common.cut(left_open.join(at, "g").where("component <> own").select(F.col("x").alias("a"), F.col("c").alias("b")).distinct(), files=files)
        more = common.cut(verify(star).where("linked").select("a", "b"), old=[star], files=files)
        found = more.count()
        if found:
            edges = common.cut(edges.union(more), old=[edges], files=files)
            labels = _joined(labels, more, files)
        # A centre has met every member of its group's other components, so it is done there.
        rest = left_open.drop("component").join(at.select("g", F.col("c").alias("x")), ["g", "x"], "left_anti")
        if found < WORTH * size:
            left_open = _open(rest, labels, files, [left_open, centres])
            break
        merged = _merged(rest, labels, files)
        left_open = _open(merged, labels, files, [left_open, centres, merged])
    if left_open.limit(1).count():
        # Distances of all members from one centre, for the blocks.
        centres = _centres(left_open, files)
        rows_ = common.cut(left_open.drop("component").join(_held(centres), "g").where("x <> c").drop("own"), old=[left_open, centres], files=files)
        seen = common.cut(verify(rows_.select(F.col("x").alias("a"), F.col("c").alias("b")).distinct()), files=files)
        more = common.cut(seen.where("linked").select("a", "b"), files=files)
        edges = common.cut(edges.union(more), old=[edges], files=files)
        labels = _joined(labels, more, files)
        rows_ = rows_.join(seen.select(F.col("a").alias("x"), F.col("b").alias("c"), "jaccard", "linked"), ["x", "c"], "left")
        rows_ = common.cut(rows_.select("g", "x", F.when(F.col("jaccard") >= 0.6, F.col("jaccard")).alias("jaccard"), F.coalesce("linked", F.lit(False)).alias("inside"), "n", "registers"), old=[rows_, seen], files=files)
        left_open = _open(rows_, labels, files, [rows_])
        full = left_open.join(texts.select(F.col("id").alias("x"), "text"), "x")
        last = common.cut(_join_blocks(full, n, files), files=files)
        if last.limit(1).count():
            edges = common.cut(edges.union(last), old=[edges], files=files)
            labels = _joined(labels, last, files)
    common.drop(left_open, texts)
    return edges, labels


def _with_digests(texts: DataFrame, n: int) -> DataFrame:
    """id, text, d1, d2 of texts (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text"):
            keys = [digest(shingle_hashes(t, n)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text"), *(pa.array(np.array([k[i] for k in keys], U).view("i8")) for i in (0, 1))], names=["id", "text", "d1", "d2"])

    return texts.mapInArrow(run, "id long, text string, d1 long, d2 long")


def near_duplicates(docs: DataFrame, n: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; documents of Jaccard similarity 0.8 or more are linked."""
    common.tune(docs.sparkSession)
    table = common.cut(sketched(docs, n, bands * rows))
    files = common.files_for(table.count())
    full = table.where("n_shingles > 0 and doc_id is not null")
    ids = full.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.struct("d1", "d2")).alias("least"), F.max(F.struct("d1", "d2")).alias("most"))
    repeats = ids.agg(F.max("n").alias("n"), F.max((F.col("least") != F.col("most")).cast("int")).alias("several")).first()
    repeated, several = (repeats.n or 0) > 1, bool(repeats.several)
    classes = full.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    if several:
        # A class is a node under its smallest doc_id; of classes with one smallest doc_id all but one get a node of their own.
        first = classes.groupBy("rep").agg(F.min(F.struct("d1", "d2")).alias("m"))
        own = F.xxhash64("d1", "d2").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
        classes = classes.join(first, "rep").withColumn("node", F.when((F.col("d1") == F.col("m.d1")) & (F.col("d2") == F.col("m.d2")), F.col("rep")).otherwise(own)).drop("m")
    else:
        classes = classes.withColumn("node", F.col("rep"))
    classes = common.cut(classes, files=files)
    reps = full.join(classes.select(F.col("rep").alias("doc_id"), "d1", "d2", "node"), ["doc_id", "d1", "d2"]).groupBy(F.col("node").alias("doc_id")).agg(F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    reps = common.cut(reps, files=files)

    def texts_of(ids: DataFrame) -> DataFrame:
        ids = common.cut(ids, files=files)
        few = ids.count() <= BROADCAST_IDS
        texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
        if several:
            wanted = ids.join(classes.select(F.col("node").alias("id"), "rep", "d1", "d2"), "id").select(F.col("id").alias("node"), F.col("rep").alias("id"), "d1", "d2")
            texts = texts.join(F.broadcast(wanted.select("id").distinct()) if few else wanted.select("id").distinct(), "id", "left_semi")
            texts = _with_digests(texts, n).join(F.broadcast(wanted) if few else wanted, ["id", "d1", "d2"]).select(F.col("node").alias("id"), "text")
        else:
            texts = texts.join(F.broadcast(ids) if few else ids, "id", "left_semi")
        return common.cut(texts.groupBy("id").agg(F.first("text").alias("text")) if repeated else texts, old=[ids])

    edges, labels = links(reps, texts_of, n, bands, rows, files)
    if several:  # the sets of one doc_id are one document's
        of = full.join(classes, ["d1", "d2", "n_shingles"]).select("doc_id", "node")
        least = of.groupBy("doc_id").agg(F.min("node").alias("a"))
        edges = common.cut(edges.union(of.join(least, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()), old=[edges], files=files)
        labels = common.components(edges, files, old=[labels])
    named = classes.join(labels.select(F.col("id").alias("node"), "component_id"), "node", "left").select("d1", "d2", "rep", F.coalesce("component_id", "node").alias("component_id"))
    if several:  # under its smallest doc_id, not its smallest node
        named = named.join(named.groupBy("component_id").agg(F.min("rep").alias("least")), "component_id").withColumn("component_id", F.col("least"))
    joined = table.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("d1")).alias("d1"), "d2").join(named.select("d1", "d2", "component_id"), ["d1", "d2"], "left")
    at = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", at.alias("component_id"), F.col("doc_id").eqNullSafe(at).alias("kept"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=2)
