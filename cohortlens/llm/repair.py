"""Repair of a conversation's structure, by Hirschberg's divide and conquer.

The rows of a conversation should begin with at most one system row and then take
turns, user and assistant, ending with the assistant (or be no rows at all). Edits,
one letter each in the audit: K keeps a row (0), R gives it the role user or
assistant (3), D deletes it (4, a must for blank and repeated rows), I inserts an
empty row of user or assistant (3); a truncated row that stays costs 3 more. The
cheapest audit is wanted, of equally cheap ones the first in ASCII order.

Four states are enough: nothing yet, after system, after user, after assistant. Costs
of the four from the left and from the right meet in the middle of the rows; of the
states that lie on a cheapest repair, the one whose audit from the left comes first
is crossed, and both halves are solved alike. No table of choices is kept, so space
is linear. Audits of the same rows that end in different states differ before either
ends, hence a rank of the four audits is enough to compare them. The vectors,
less their smallest cost, are few, so each step of a vector is remembered.

How it runs: rows are counted by (conversation, turn, role, digest of the text), so
copies meet as partial counts, sorted by ranges of those keys, and cut into blocks of
at most ``BLOCK`` rows of one conversation. A block becomes a four by four table
of costs and ranks. One task reads the tables of a conversation (one for 65,536
rows) and finds the crossing at each border; then every block is solved alone, so a
conversation that holds a third of all rows is spread over tasks. Texts are
looked at once for their digest and faults, and once more where a row stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.session import ensure_checkpoint_dir

BLOCK = 1 << 16
FLUSH = 4 << 20  # bytes of rows that leave a task together

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# A row's code: the kind of its role (0 system, 1 user, 2 assistant, 3 other), 4 more if truncated, 8 more if it must go.
CUT, GOES, TAIL = 4, 8, 16
_KEPT = {NOTHING: {0: SYSTEM, 1: USER}, SYSTEM: {1: USER}, USER: {2: ASSISTANT}, ASSISTANT: {1: USER}}
_NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
# A state this much dearer than another is on no cheapest repair: any state reaches what another reaches for 13 at most.
FAR = 24

Vector = tuple  # of four (cost, rank) or None


def _row(state: int, code: int) -> Iterator[tuple[int, int, str]]:
    """(next state, cost, letter) of one row, without inserting."""
    if code == TAIL:
        if state in (NOTHING, ASSISTANT):
            yield state, 0, ""
        return
    yield state, DELETE, "D"
    if code < GOES:
        more = TRUNCATED if code & CUT else 0
        if (kept := _KEPT[state].get(code & 3)) is not None:
            yield kept, more, "K"
        yield _NEXT[state], REROLE + more, "R"


@cache
def moves(code: int) -> tuple[tuple[tuple[int, str] | None, ...], ...]:
    """The cheapest, then first, (cost, letters) from each state to each, over one row
    and what is inserted before it."""
    best: list[list] = [[None] * 4 for _ in range(4)]
    for a in range(4):
        state, letters, paid = a, "", 0
        for _ in range(3):  # a third row would come back to a state that was there
            for b, cost, letter in _row(state, code):
                new = (paid + cost, letters + letter)
                if best[a][b] is None or new < best[a][b]:
                    best[a][b] = new
            state, letters, paid = _NEXT[state], letters + "I", paid + INSERT
    return tuple(map(tuple, best))


@cache
def forward(vector: Vector, code: int) -> tuple[Vector, int]:
    """The vector after one more row, and the cost that all its states have more."""
    step, new = moves(code), [None] * 4
    for b in range(4):
        ways = [(v[0] + step[a][b][0], v[1], step[a][b][1]) for a, v in enumerate(vector) if v and step[a][b]]
        new[b] = min(ways, default=None)
    return _shifted(new)


def _shifted(ways: list) -> tuple[Vector, int]:
    """(cost, order) of each state as a vector of small costs and ranks, and the smallest cost."""
    if not any(ways):
        return (None,) * 4, 0
    least = min(w[0] for w in ways if w)
    near = [w if w and w[0] - least <= FAR else None for w in ways]
    order = sorted(w[1:] for w in near if w)
    return tuple(w and (w[0] - least, order.index(w[1:])) for w in near), least


@cache
def backward(costs: tuple, code: int) -> tuple[tuple, int]:
    """Costs to the end from before one more row, less the smallest, and that."""
    step = moves(code)
    new = [min((step[a][b][0] + costs[b] for b in range(4) if step[a][b] and costs[b] is not None), default=None) for a in range(4)]
    least = min((c for c in new if c is not None), default=0)
    return tuple(c if c is None else c - least for c in new), least


def _only(state: int, value) -> tuple:
    return tuple(value if s == state else None for s in range(4))


def _crossing(vector: Vector, costs: tuple) -> int:
    """Of the states on a cheapest repair, the one whose audit so far comes first."""
    return min((v[0] + c, v[1], s) for s, (v, c) in enumerate(zip(vector, costs)) if v and c is not None)[2]


def solve(codes: bytes, a: int, b: int) -> tuple[str, int]:
    """The first cheapest audit of rows that lead from state ``a`` to ``b``, and its cost."""
    letters, cost, todo = [], 0, [(0, len(codes), a, b)]
    while todo:
        lo, hi, a, b = todo.pop()
        if hi - lo == 1:
            c, text = moves(codes[lo])[a][b]
            letters.append(text)
            cost += c
        elif hi > lo:
            middle, ahead, behind = (lo + hi) // 2, _only(a, (0, 0)), _only(b, 0)
            for code in reversed(codes[middle:hi]):
                behind = backward(behind, code)[0]
            for code in codes[lo:middle]:
                ahead = forward(ahead, code)[0]
                if b in (NOTHING, SYSTEM):  # no way back to these from a user or an assistant
                    ahead = (*ahead[:2], None, None)
            state = _crossing(ahead, behind)
            todo += [(middle, hi, state, b), (lo, middle, a, state)]
    return "".join(letters), cost


def table(codes: bytes) -> np.ndarray:
    """Cost (-1: no way) and rank of the first cheapest audit from each state to each."""
    out = np.full((2, 4, 4), -1, np.int32)
    for a in range(4):
        vector, paid = _only(a, (0, 0)), 0
        for code in codes:
            vector, more = forward(vector, code)
            paid += more
        for b, v in enumerate(vector):
            if v:
                out[0, a, b], out[1, a, b] = v[0] + paid, v[1]
    return out


def borders(tables: list[np.ndarray]) -> list[tuple[int, int]]:
    """The first state and the last of each of a conversation's blocks."""
    end = moves(TAIL)
    behind = [tuple(min((end[a][b][0] for b in range(4) if end[a][b]), default=None) for a in range(4))]
    for t in reversed(tables[1:]):
        cost, last = t[0].tolist(), behind[-1]
        behind.append(tuple(min((cost[a][b] + last[b] for b in range(4) if cost[a][b] >= 0 and last[b] is not None), default=None)
                            for a in range(4)))
    ahead, state, out = _only(NOTHING, (0, 0)), NOTHING, []
    for t, costs in zip(tables, reversed(behind)):
        (cost, rank), ways = t.tolist(), []
        for b in range(4):
            ways.append(min(((v[0] + cost[a][b], v[1], rank[a][b]) for a, v in enumerate(ahead) if v and cost[a][b] >= 0), default=None))
        ahead = _shifted(ways)[0]
        last = _crossing(ahead, costs)
        out.append((state, last))
        state = last
    return out


_PAIRS = np.zeros((4, 4), bool)
_PAIRS[0, 1] = _PAIRS[1, 2] = _PAIRS[2, 1] = True  # system user, user assistant, assistant user


def _block_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


@dataclass
class Repair:
    """``conversations``: one row each, with ``gaps``, ``blank``, ``duplicate``, ``truncated``,
    ``illegal``, ``cost`` and ``audit``. ``rows``: the repaired rows (conversation, ``part``, ``seq``,
    ``place`` in order, ``role``, ``text``, ``letter`` K, R or I)."""
    conversations: DataFrame
    rows: DataFrame


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join in which null keys are equal; the keys are kept once."""
    right = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return left.join(right, on, how).drop(*[f"_{k}" for k in keys])


def repair_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """The cheapest repair of every conversation.

    Rows stand by turn (nulls first), then role, then a digest of the text. A null
    conversation is one; a null role or text is one space. A row is blank without a
    byte other than space and 0x09 to 0x0D, duplicate if the conversation has its
    role and text before, truncated if its last such byte is none of ``.!?``; the first
    that holds counts. Roles count by their first letter; an empty role is like any
    that is not system, user or assistant. ``gaps`` are turns missing between the
    smallest and the largest. Other columns are left out; an empty table gives none.
    Texts of any length pass whole. Blocks are written to the session's checkpoint folder.
    """
    base = (df.select(F.col(f"`{conv}`").alias("c"), F.col(f"`{turn}`").cast("long").alias("t"),
                      F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("r"), F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("x"))
            .withColumn("d", F.unhex(F.sha2(F.encode("x", "UTF-8"), 256))))
    counted = (base.select("c", "t", "r", "d", (~F.col("x").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
                           (~F.col("x").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"))
               .groupBy("c", "t", "r", "d", "blank", "cut").agg(F.count(F.lit(1)).alias("n")))
    first = counted.groupBy("c", "r", "d").agg(F.min("t").alias("low"), F.max(F.col("t").isNull()).alias("unturned"))
    stays = ~F.col("blank") & F.when(F.col("unturned"), F.col("t").isNull()).otherwise(F.col("t") == F.col("low"))
    letter = F.substring("r", 1, 1)
    kind = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/repair-{uuid.uuid4().hex}"
    spark = df.sparkSession

    def shelved(name: str, made: DataFrame) -> DataFrame:
        made.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    rows = shelved("rows", same(counted, first, ["c", "r", "d"], "inner").select(
        "c", "t", "r", "d", "n", "blank", stays.alias("stays"),
        (kind + F.when(F.col("cut"), CUT).otherwise(0) + F.when(stays, 0).otherwise(GOES)).cast("int").alias("code")))
    kind_of = dict(rows.dtypes)["c"]
    stay = F.col("stays").cast("long")
    counts = rows.groupBy("c").agg(
        F.coalesce((F.max("t").cast("decimal(20,0)") - F.min("t").cast("decimal(20,0)") + 1 - F.count_distinct("t")).try_cast("long"),
                   F.lit(0).cast("long")).alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("n") - stay)).alias("duplicate"),
        F.sum(F.when(F.col("stays") & (F.col("code").bitwiseAND(CUT) > 0), 1).otherwise(0)).cast("long").alias("truncated"))

    ordered = (rows.select("c", "t", "r", "d", "n", "code")
               .repartitionByRange(F.asc_nulls_first("c"), F.asc_nulls_first("t"), F.asc("r"), F.asc("d"))
               .sortWithinPartitions(F.asc_nulls_first("c"), F.asc_nulls_first("t"), F.asc("r"), F.asc("d")))
    c_type = ordered.select("c").limit(0).toArrow().schema.field("c").type
    made = pa.schema([("c", c_type), ("part", pa.int32()), ("seq", pa.int32()), ("codes", pa.binary()), ("at", pa.list_(pa.int32())),
                      ("role", pa.list_(pa.string())), ("digest", pa.list_(pa.binary())), ("edge", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, out, held = TaskContext.get().partitionId(), 0, [], 0
        now, codes, at, roles, digests = object(), bytearray(), [], [], []
        for batch in batches:
            for c, _, r, d, n, code in zip(*(col.to_pylist() for col in batch.columns)):
                while n:
                    if codes and (c != now or len(codes) == BLOCK):
                        out.append((now, part, seq, bytes(codes), at, roles, digests, table(bytes(codes)).tobytes()))
                        seq, held = seq + 1, held + len(codes) + 200 + 60 * len(at)
                        codes, at, roles, digests = bytearray(), [], [], []
                        if held > FLUSH:
                            yield _block_batch(out, made)
                            out, held = [], 0
                    now = c
                    if code < GOES:
                        at.append(len(codes))
                        roles.append(r)
                        digests.append(d)
                        codes.append(code)
                        code, n = code | GOES, n - 1  # its copies go
                    take = min(n, BLOCK - len(codes))
                    codes += bytes([code | GOES]) * take
                    n -= take
        if codes:
            out.append((now, part, seq, bytes(codes), at, roles, digests, table(bytes(codes)).tobytes()))
        if out:
            yield _block_batch(out, made)

    blocks = shelved("blocks", ordered.mapInArrow(
        cut, f"c {kind_of}, part int, seq int, codes binary, at array<int>, role array<string>, digest array<binary>, edge binary"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = object(), []

        def crossed() -> Iterator[tuple]:
            before = None
            for (part, seq, _, first, last), (a, b) in zip(group, borders([g[2] for g in group])):
                yield part, seq, a, b, (part, seq) == group[-1][:2], before is not None and not _PAIRS[before, first]
                before = last
        for batch in batches:
            out = []
            for c, part, seq, edge, first, last in zip(*(col.to_pylist() for col in batch.columns)):
                if c != now and group:
                    out += crossed()
                    group = []
                now = c
                group.append((part, seq, np.frombuffer(edge, np.int32).reshape(2, 4, 4), first[0] & 3, last[0] & 3))
            if out:
                yield _block_batch(out, met)
        if group:
            yield _block_batch(list(crossed()), met)

    met = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("ends", pa.bool_()), ("clash", pa.bool_())])
    code = F.col("codes")
    crossings = (blocks.select("c", "part", "seq", "edge", F.substring(code, 1, 1).alias("f"), F.substring(code, -1, 1).alias("l"))
                 .repartition("c").sortWithinPartitions("c", "part", "seq")
                 .mapInArrow(meet, "part int, seq int, a int, b int, ends boolean, clash boolean"))
    done = pa.schema([("c", c_type), ("part", pa.int32()), ("seq", pa.int32()), ("audit", pa.string()), ("cost", pa.int64()),
                      ("illegal", pa.int64()), ("rows", pa.list_(pa.struct([("place", pa.int32()), ("letter", pa.string()), ("role", pa.string()),
                                                                            ("was", pa.string()), ("digest", pa.binary())])))])

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for part, seq, c, codes, at, roles, digests, a, b, ends, clash in zip(*(col.to_pylist() for col in batch.columns)):
                audit, cost = solve(codes, a, b)
                if ends:
                    end = min((m, s) for s, m in enumerate(moves(TAIL)[b]) if m)[0]
                    audit, cost = audit + end[1], cost + end[0]
                kinds = np.frombuffer(codes, np.uint8) & 3
                illegal = int((~_PAIRS[kinds[:-1], kinds[1:]]).sum()) + clash
                state, i, stays_at, rows_out = a, 0, {p: k for k, p in enumerate(at)}, []
                for letter in audit:
                    if letter != "D":
                        k = None if letter == "I" else stays_at[i]
                        state = _KEPT[state][codes[i] & 3] if letter == "K" else _NEXT[state]
                        name = roles[k] if letter == "K" else _NAMES[state]
                        rows_out.append({"place": len(rows_out), "letter": letter, "role": name, "was": k if k is None else roles[k],
                                         "digest": k if k is None else digests[k]})
                    i += letter != "I"
                out.append((c, part, seq, audit, cost, illegal, rows_out))
                held += 200 + 100 * len(rows_out)
                if held > FLUSH:
                    yield _block_batch(out, done)
                    out, held = [], 0
        if out:
            yield _block_batch(out, done)

    solved = shelved("solved", blocks.drop("edge").join(crossings, ["part", "seq"]).mapInArrow(
        mend, f"c {kind_of}, part int, seq int, audit string, cost long, illegal long, "
              "rows array<struct<place int, letter string, role string, was string, digest binary>>"))
    in_order = F.array_sort(F.collect_list(F.struct("part", "seq", "audit")))
    repaired = solved.groupBy("c").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
                                       F.array_join(F.transform(in_order, lambda b: b["audit"]), "").alias("audit"))
    found = same(counts, repaired, ["c"])
    texts = base.groupBy("c", "r", "d").agg(F.min("x").alias("x"))
    staying = solved.select("c", "part", "seq", F.inline("rows")).select(
        "c", "part", "seq", "place", "letter", "role", F.col("was").alias("r"), F.col("digest").alias("d"))
    with_text = same(staying.where(F.col("d").isNotNull()), texts, ["c", "r", "d"], "inner").drop("r", "d")
    new = staying.where(F.col("d").isNull()).drop("r", "d").withColumn("x", F.lit(""))
    return Repair(found.withColumnRenamed("c", conv),
                  with_text.unionByName(new).withColumnsRenamed({"c": conv, "x": text}))


def text_digests(rows: DataFrame, conv: str = "conv_id", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, ``repaired_sha256``): digest of each conversation's repaired ``role:text``
    rows, joined by newlines. Rows stream through their task, a text at a time; a digest
    runs from the first row to the last, so one conversation's rows pass one task."""
    kind = dict(rows.dtypes)[conv]
    lines = (rows.select(F.col(conv).alias("c"), "part", "seq", "place", F.concat(F.col(role), F.lit(":"), F.col(text)).alias("x"))
             .repartition("c").sortWithinPartitions("c", "part", "seq", "place").select("c", "x"))
    c_type = lines.select("c").limit(0).toArrow().schema.field("c").type

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256
        now, running = object(), None
        for batch in batches:
            names, digests = [], []
            for c, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                if running is None or c != now:
                    if running is not None:
                        names.append(now)
                        digests.append(running.hexdigest())
                    now, running = c, sha256()
                else:
                    running.update(b"\n")
                running.update(x.as_py().encode())
            if names:
                yield pa.record_batch([pa.array(names, c_type), pa.array(digests)], names=["c", "repaired_sha256"])
        if running is not None:
            yield pa.record_batch([pa.array([now], c_type), pa.array([running.hexdigest()])], names=["c", "repaired_sha256"])

    return lines.mapInArrow(digest, f"c {kind}, repaired_sha256 string").withColumnRenamed("c", conv)


def damaged(df: DataFrame, checksum: Column) -> DataFrame:
    """Rows with faults made by ``checksum`` modulo 20: 0 drops the row, 1 empties its text,
    2 removes ``.!?`` from it, 3 repeats the row, 4 makes its role user."""
    fault = checksum % 20
    return (df.withColumn("_fault", fault).where(F.col("_fault") != 0)
            .withColumn("text", F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", ""))
                        .otherwise(F.col("text")))
            .withColumn("role", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")))
            .withColumn("_copy", F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .drop("_fault", "_copy"))


def repair_sql() -> str:
    """Damage, faults and repair of the table ``conversations`` in SQL: a row at a time, with the cheapest audit
    of each state as a text. Slow on long conversations."""
    def way(state: str, cost: str, letter: str, line: str | None = None) -> str:
        rows = f"list_append({state}.r, {line})" if line else f"{state}.r"
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {rows}}}"

    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    kept = lambda state, initial: way(state, f"CASE WHEN goes OR initial <> '{initial}' THEN 1000000000 WHEN cut THEN 3 ELSE 0 END", "K", "role || ':' || text")
    given = lambda state, name: way(state, "CASE WHEN goes THEN 1000000000 WHEN cut THEN 6 ELSE 3 END", "R", f"'{name}:' || text")
    gone = lambda state: way(state, "4", "D")
    user = least("u", *[way(s, "3", "I", "'user:'") for s in "nsa"])
    shift = "list_transform(string_split(k, ''), lambda x: [unicode(x), -1, -1, -1, -1, -1, -1, -1, -1])"
    crc = (f"xor(list_reduce(list_prepend(4294967295::BIGINT, flatten({shift})::BIGINT[]), lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) "
           "WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END), 4294967295)")
    far = "{'c': 1000000000::BIGINT, 'a': '', 'r': []::VARCHAR[]}"
    return f"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
faulty AS (SELECT *, {crc} % 20 AS fault FROM raw),
hurt AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
  CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy FROM faulty WHERE fault <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
  substr(role, 1, 1) AS initial,
  NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut FROM hurt),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM placed),
marked AS MATERIALIZED (SELECT *, blank OR again AS goes, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM seen),
step(conv_id, i, n, s, u, a) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}}, {far}, {far}, {far} FROM raw
  UNION ALL
  SELECT conv_id, i, {gone('n')}, {least(gone('s'), kept('n', 's'))},
    {least(gone('u'), *[kept(s, 'u') for s in 'nsa'], *[given(s, 'user') for s in 'nsa'])}, {least(gone('a'), kept('u', 'a'), given('u', 'assistant'))}
  FROM (SELECT conv_id, i, n, s, u, {least('a', way('u', '3', 'I', "'assistant:'"))} AS a, role, text, initial, goes, cut FROM (
    SELECT p.conv_id, m.i, n, s, {user} AS u, a, m.role, m.text, m.initial, m.goes, m.cut
    FROM step p JOIN marked m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.i = p.i + 1))),
ended AS (SELECT conv_id, {least('n', 'a', way('u', '3', 'I', "'assistant:'"))} AS best FROM (
  SELECT conv_id, n, {user} AS u, a FROM step QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
  count(*) FILTER (NOT blank AND again) AS duplicate, count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(array_to_string(best.r, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
