"""Conversation structure repair: A* on the edit lattice, in blocks of bounded length.

A node of the lattice is a row's place in its conversation and what the rows kept so far end with (nothing, system, user, assistant).
Edges keep, re-role or delete the next row or insert one before it. The heuristic is the suffix sum of what no path avoids: the
deletion of blank and repeated rows, and the charge of truncated ones (their deletion costs more). Since it is consistent, the first
time a node leaves the queue, keyed (cost plus heuristic, audit), its path is the cheapest and the least in ASCII.

Rows go without their texts: role, digest and faults decide. They are sorted by range, so that a conversation of any length lies in
neighbouring partitions, and are searched in blocks of BLOCK rows. A block of a conversation that one partition may not hold
whole is searched from each entry state to each exit state. Two passes stream the blocks of such conversations, backwards for the best
exit of each entry, then forwards for the entries; they hold one block at a time, since of two paths through a block with different exits
neither audit begins the other (a row's edge is last), so that a tie is settled within the block. Texts meet the rows kept at the end and
are hashed in order as a stream; the hash of one text is a sequence by nature, so one task reads a conversation then, in bounded memory.

Defined results: rows of one turn go by role, then by the SHA-256 of the text, equal ones count one by one; a null turn comes first; null
role and text are one space, as is a null conv_id or turn in the key that tells the damage; a conversation is the rows of one conv_id, null
too; an empty role has no initial and fits nowhere; empty texts are blank; very long texts are digested where they lie; a conversation of which no row is left
has zeros, an empty audit and the hash of the empty string; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Rows of a block.
BLOCK = 256
#: Costs of the edits.
REROLE, DELETE, INSERT, CHARGE = 2, 3, 2, 1
WHITE = " \t\n\x0b\x0c\r"

NONE, SYSTEM, USER, ASSISTANT = range(4)
BLANK, REPEATED, TRUNCATED = 1, 2, 3
KEPT = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: What a re-roled or inserted row leads to, and the inserts that end a conversation.
NEXT = [USER, USER, ASSISTANT, USER]
NAMES = {USER: "user", ASSISTANT: "assistant"}
TAIL = ["", "II", "I", ""]


def astar(rows: list[tuple[str, int]], start: int, whole: bool) -> dict[int, tuple[int, str]]:
    """The cheapest (cost, audit) from start to each state after the rows, (initial, fault) each; whole: only the best legal end."""
    n = len(rows)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        fault = rows[i][1]
        rest[i] = rest[i + 1] + (DELETE if fault in (BLANK, REPEATED) else CHARGE if fault else 0)
    queue = [(rest[0], "", 0, start)]
    done, found = set(), {}
    while queue:
        f, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            found[state] = (f, audit)
            if whole and state in (NONE, ASSISTANT):
                return {state: (f, audit)}
        if i < n or whole:
            heapq.heappush(queue, (f + INSERT, audit + "I", i, NEXT[state]))
        if i == n:
            continue
        initial, fault = rows[i]
        done_with = f - rest[i] + rest[i + 1]
        heapq.heappush(queue, (done_with + DELETE, audit + "D", i + 1, state))
        if fault in (BLANK, REPEATED):
            continue
        charge = CHARGE if fault else 0
        if (state, initial) in KEPT:
            heapq.heappush(queue, (done_with + charge, audit + "K", i + 1, KEPT[state, initial]))
        heapq.heappush(queue, (done_with + charge + REROLE, audit + "R", i + 1, NEXT[state]))
    return found


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, n (equal rows), blank, later (role and text stand in an earlier turn), truncated."""
    last = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    each = rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"))
    kinds = common.cut(each.groupBy("conv_id", "turn", "role", "digest").agg(F.count("*").alias("n"), F.max("blank").alias("blank"), F.max("truncated").alias("truncated")))
    at = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = kinds.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(at).alias("first"))
    met = kinds.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    return met.select("conv_id", "turn", "role", "digest", "n", "blank", (at > F.col("first")).alias("later"), "truncated")


_FIELDS = {
    "conv_id": pa.int64(), "part": pa.int32(), "block": pa.int32(), "whole": pa.bool_(), "illegal": pa.int64(), "first": pa.string(), "last": pa.string(),
    "cost": pa.list_(pa.int64()), "audit": pa.list_(pa.string()), "turns": pa.list_(pa.int64()), "roles": pa.list_(pa.string()), "digests": pa.list_(pa.binary()),
}
_BLOCKS = "conv_id long, part int, block int, whole boolean, illegal long, first string, last string, cost array<long>, audit array<string>, turns array<long>, roles array<string>, digests array<binary>"


def _batches(rows: Iterator[tuple], fields: dict[str, pa.DataType], size: int = 200) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, k in enumerate(fields.values())], names=list(fields))

    for r in rows:
        held.append(r)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _blocks(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of sorted rows, searched. A conversation is known to be whole if others stand before and after it in the partition."""

    def search(conv: int | None, at: tuple[int, int], rows: list[tuple], whole: bool) -> tuple:
        lattice = [(role[:1], fault) for _, role, _, fault in rows]
        illegal = sum(not _legal(a[0], b[0]) for a, b in zip(lattice, lattice[1:], strict=False))
        if whole:
            cost, audit = map(list, zip(*astar(lattice, NONE, True).values(), strict=True))
        else:
            found = [astar(lattice, s, False) for s in range(4)]
            cost, audit = ([f[e][k] if e in f else None for f in found for e in range(4)] for k in range(2))
        return (conv, *at, whole, illegal, lattice[0][0], lattice[-1][0], cost, audit, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part, block, convs = TaskContext.get().partitionId(), 0, 0
        conv, held, full = None, [], False
        for c, turn, role, digest, n, blank, later, truncated in _rows(batches):
            if not convs or c != conv:
                if held:
                    yield search(conv, (part, block), held, convs > 1 and not full)
                    block += 1
                conv, held, full, convs = c, [], False, convs + 1
            for i in range(n):
                if len(held) == size:
                    yield search(conv, (part, block), held, False)
                    block, held, full = block + 1, [], True
                fault = BLANK if blank else REPEATED if later or i else TRUNCATED if truncated else 0
                held.append((turn, role, None if i else digest, fault))
        if held:
            yield search(conv, (part, block), held, False)

    return lambda batches: _batches(found(batches), _FIELDS)


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of each conversation from its last: the best exit from each entry."""

    def found() -> Iterator[tuple]:
        conv, value, begun = None, None, False
        for c, part, block, cost, audit in _rows(batches):
            last = not begun or c != conv
            if last:
                conv, begun, value = c, True, [INSERT * len(x) for x in TAIL]
            exits = [min(((cost[4 * s + e] + value[e], audit[4 * s + e], e) for e in range(4) if cost[4 * s + e] is not None)) for s in range(4)]
            value = [x[0] for x in exits]
            yield part, block, last, [x[2] for x in exits]

    return _batches(found(), {"p": pa.int32(), "b": pa.int32(), "end": pa.bool_(), "exits": pa.list_(pa.int32())})


_RESOLVED = "conv_id long, part int, block int, entry int, cost long, audit string, tail string, illegal long, turns array<long>, roles array<string>, digests array<binary>"


def _forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of each conversation from its first: the state that the best path enters each with."""

    def found() -> Iterator[tuple]:
        conv, state, before, begun = None, NONE, "", False
        for c, part, block, whole, illegal, first, last, cost, audit, turns, roles, digests, end, exits in _rows(batches):
            if whole:
                yield c, part, block, NONE, cost[0], audit[0], "", illegal, turns, roles, digests
                continue
            if not begun or c != conv:
                conv, state, begun = c, NONE, True
            else:
                illegal += not _legal(before, first)
            at, entry = 4 * state + exits[state], state
            state, before = exits[state], last
            tail = TAIL[state] if end else ""
            yield c, part, block, entry, cost[at] + INSERT * len(tail), audit[at], tail, illegal, turns, roles, digests

    fields = _FIELDS | {"entry": pa.int32(), "cost": pa.int64(), "audit": pa.string(), "tail": pa.string()}
    return _batches(found(), {k: fields[k] for k in ("conv_id", "part", "block", "entry", "cost", "audit", "tail", "illegal", "turns", "roles", "digests")})


def resolved(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of conversations with the edits of their rows. rows: of faults()."""
    order = ["conv_id", "turn", "role", "digest"]
    found = common.cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks(block), _BLOCKS))
    back = found.where("not whole").select("conv_id", "part", "block", "cost", "audit").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("block"))
    exits = common.cut(back.mapInArrow(_backwards, "p int, b int, end boolean, exits array<int>"))
    known = found.join(exits, (F.col("part") == F.col("p")) & (F.col("block") == F.col("b")), "left").drop("p", "b")
    alone = known.where("whole").mapInArrow(_forwards, _RESOLVED)  # nothing to stream: stays where it is
    others = known.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    return common.cut(alone.union(others.mapInArrow(_forwards, _RESOLVED)), old=[found])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of the repaired conversation: rows kept, by their key, with what is inserted before them."""

    def found() -> Iterator[tuple]:
        for c, part, block, state, audit, tail, turns, roles, digests in _rows(batches):
            inserted, i = [], 0
            for edit in audit + tail:
                if edit == "I":
                    state = NEXT[state]
                    inserted.append(NAMES[state] + ":")
                    continue
                if edit != "D":
                    state = KEPT[state, roles[i][:1]] if edit == "K" else NEXT[state]
                    yield c, part, block, i, inserted, NAMES[state] if edit == "R" else roles[i], turns[i], roles[i], digests[i]
                    inserted = []
                i += 1
            if inserted:
                yield c, part, block, i, inserted, None, None, None, None

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.string(), pa.binary()]
    return _batches(found(), dict(zip(["conv_id", "part", "block", "i", "inserted", "as", "turn", "role", "digest"], kinds, strict=True)))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found() -> Iterator[tuple]:
        conv, state = None, None
        for c, inserted, as_, text in _rows(batches):
            if state is not None and c != conv:
                yield conv, state.hexdigest()
                state = None
            for line in [*inserted, *([f"{as_}:{text}"] if as_ is not None else [])]:
                if state is None:
                    state = hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line.encode())
            conv = c
        if state is not None:
            yield conv, state.hexdigest()

    return _batches(found(), {"conv_id": pa.int64(), "sha": pa.string()})


def _key(conv: Column, turn: Column) -> Column:
    return F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))


def repair(rows: DataFrame, ids: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation.

    rows: conv_id, turn, role, text without nulls in role and text; ids: conv_ids that are told in any case.
    """
    common.tune(rows.sparkSession)
    kinds = common.cut(faults(rows))
    done = resolved(kinds, block)
    of = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    once = ~F.col("blank") & ~F.col("later")
    told = kinds.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0).cast("long")).alias("gaps"),
        of(F.col("blank")).alias("blank"), F.sum(F.when(F.col("blank"), 0).when(F.col("later"), F.col("n")).otherwise(F.col("n") - 1)).alias("duplicate"), F.sum(F.when(once & F.col("truncated"), 1).otherwise(0)).alias("truncated"),
    )
    edits = done.groupBy("conv_id").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
        # One value by contract: as long as the conversation has rows.
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "block", F.concat("audit", "tail").alias("a")))), lambda x: x["a"]), "").alias("audit"),
    )
    pieces = done.select("conv_id", "part", "block", "entry", "audit", "tail", "turns", "roles", "digests").mapInArrow(_pieces, "conv_id long, part int, block int, i int, inserted array<string>, as string, turn long, role string, digest binary")
    texts = rows.select(_key(F.col("conv_id"), F.col("turn")).alias("k"), F.col("role").alias("r"), F.unhex(F.sha2("text", 256)).alias("d"), "text").groupBy("k", "r", "d").agg(F.first("text").alias("text"))
    alone = F.concat_ws(":", F.lit("none"), "part", "block")  # lines inserted last have no text to meet: dealt evenly
    keyed = pieces.withColumn("key", F.when(F.col("digest").isNotNull(), _key(F.col("conv_id"), F.col("turn"))).otherwise(alone))
    keyed = keyed.withColumn("role", F.coalesce("role", F.lit(""))).withColumn("digest", F.coalesce("digest", F.lit("").cast("binary")))
    lines = keyed.join(texts, (F.col("key") == F.col("k")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    in_order = lines.select("conv_id", "part", "block", "i", "inserted", "as", "text").repartition("conv_id").sortWithinPartitions("conv_id", "part", "block", "i")
    hashes = in_order.select("conv_id", "inserted", "as", "text").mapInArrow(_hashes, "conv_id long, sha string")
    parts = [told, edits, hashes] + ([ids.select("conv_id").distinct()] if ids is not None else [])
    all_ = parts[0]
    for x in parts[1:]:
        all_ = all_.unionByName(x, allowMissingColumns=True)
    zero = lambda name: F.coalesce(F.max(name), F.lit(0)).cast("long").alias(name)
    empty = hashlib.sha256().hexdigest()
    return all_.groupBy("conv_id").agg(*map(zero, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("sha"), F.lit(empty)).alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, of which some rows are damaged, by the hash of conv_id and turn."""
    t = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    t = t.withColumn("h", F.crc32(_key(F.col("conv_id"), F.col("turn")).cast("binary")) % 20).where("h <> 0")
    role = F.when(F.col("h") == 4, F.lit("user")).otherwise(F.col("role"))
    text = F.when(F.col("h") == 1, F.lit("")).when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return t.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair(damaged(t), t.select(F.col("conv_id").cast("long").alias("conv_id")))


def _oracle() -> str:
    """The same by dynamic programming: a recursion over the rows with the best path to each state."""
    crc = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(key, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))), 4294967295)"
    white = r"[\x20\x09-\x0D]"
    best = lambda *x: f"list_sort([{', '.join(x)}])[1]"
    add = lambda s, cost, edit, line=None: f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}', 't': " + (f"{s}.t || {line}" if line else f"{s}.t") + "}"
    new = lambda s, role: add(s, INSERT, "I", f"chr(10) || '{role}:'")
    never = "{'c': 1000000000::BIGINT, 'a': '', 't': ''}"
    start = "{'c': 0::BIGINT, 'a': '', 't': ''}"
    keep = lambda s, i: f"CASE WHEN must = 0 AND initial = '{i}' THEN {add(s, 'charge', 'K', 'chr(10) || line')} ELSE {never} END"
    role = lambda s, r: f"CASE WHEN must = 0 THEN {add(s, f'charge + {REROLE}', 'R', f'''chr(10) || '{r}:' || text''')} ELSE {never} END"
    gone = lambda s: add(s, DELETE, "D")
    return f"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
hashed AS (SELECT *, {crc} % 20 AS h FROM keyed),
damaged AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM hashed WHERE h <> 0),
placed AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
told AS (SELECT conv_id, turn, i, left(role, 1) AS initial, text, role || ':' || text AS line, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN seen > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?]{white}*$') THEN 3 ELSE 0 END AS fault FROM placed),
rows AS (SELECT *, (fault IN (1, 2))::INT AS must, (fault = 3)::INT AS charge, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM told),
walk(conv_id, i, e, s, u, a) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, {start}, {never}, {never}, {never} FROM conversations
  UNION ALL
  SELECT conv_id, i, {gone("e")}, {best(gone("s"), keep("e", "s"))}, {best(gone("u2"), keep("e", "u"), keep("s", "u"), keep("a1", "u"), role("e", "user"), role("s", "user"), role("a1", "user"))}, {best(gone("a1"), keep("u2", "a"), role("u2", "assistant"))}
  FROM (SELECT *, {best("u1", new("a1", "user"))} AS u2 FROM (SELECT *, {best("a", new("u1", "assistant"))} AS a1 FROM (
    SELECT w.conv_id, r.i, e, s, u, a, must, charge, initial, line, text, {best("u", new("e", "user"), new("s", "user"), new("a", "user"))} AS u1
    FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1)))
),
ends AS (SELECT conv_id, {best("e", "a", new("u", "assistant"), add("s", 2 * INSERT, "II", "chr(10) || 'user:' || chr(10) || 'assistant:'"))} AS b FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate, count_if(fault = 3) AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  b.c AS cost, b.a AS audit, sha256(substr(b.t, 2)) AS repaired_sha256
FROM ends e LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM e.conv_id"""


ORACLE = _oracle()
