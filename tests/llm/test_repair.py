import hashlib
import itertools
import random
import re
import zlib

import pytest

from cohortlens.llm import repair as R
from cohortlens.llm.queries import op12

SF = "/root/testdata/sf0.01"
GOOD = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """By trying every edit: (cost, audit, repaired) of rows (initial, must go, truncated, role, text)."""
    best = {"": (0, "", ())}  # kept initials so far -> cheapest way; a longer prefix never gets cheaper by waiting
    for row in [*rows, None]:
        grown = {}

        def put(key, way, into):
            if key not in into or way < into[key]:
                into[key] = way
        ways = dict(best)
        for k in range(3):  # rows inserted here
            for key, (cost, audit, out) in list(ways.items()):
                if len(audit) - len(best.get(key, (0, audit, ()))[1]) <= 3:
                    for c, name in (("u", "user"), ("a", "assistant")):
                        if ok(key + c):
                            put(short(key + c), (cost + 3, audit + "I", (*out, (name, ""))), ways)
        if row is None:
            return min(w for key, w in ways.items() if GOOD.fullmatch(key))
        initial, goes, cut, role, text = row
        for key, (cost, audit, out) in ways.items():
            put(key, (cost + 4, audit + "D", out), grown)
            if not goes:
                if ok(key + initial):
                    put(short(key + initial), (cost + 3 * cut, audit + "K", (*out, (role, text))), grown)
                for c, name in (("u", "user"), ("a", "assistant")):
                    if ok(key + c):
                        put(short(key + c), (cost + 3 + 3 * cut, audit + "R", (*out, (name, text))), grown)
        best = grown


def ok(initials):
    return re.fullmatch(r"s?(ua)*u?", initials) is not None


def short(initials):
    """Initials that allow the same rows after them."""
    return initials if len(initials) < 3 else re.sub(r"^s?(ua)+", "ua", initials)


def by_hand(rows):
    """The contract in loops: rows (turn, role, text) of one conversation, after damage and in order."""
    seen, marked, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        letters = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = ("blank" if not letters else "duplicate" if (role, text) in seen else
                 "truncated" if letters[-1] not in ".!?" else None)
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        marked.append((role[:1] or " ", fault in ("blank", "duplicate"), fault == "truncated", role, text))
    initials = [m[0] for m in marked]
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, out = cheapest(marked)
    return {**counts, "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        row = (conv, turn, "user" if fault == 4 else role, text)
        out += [] if fault == 0 else [row] * (2 if fault == 3 else 1)
    return out


def expected(rows):
    groups = {c: [] for c, *_ in rows}
    for conv, *row in damage(rows):
        groups[conv].append(tuple(row))
    digest = lambda r: hashlib.sha256(r[2].encode()).digest()
    return {c: by_hand(sorted(g, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r)))) for c, g in groups.items()}


def test_cheapest_is_cheapest():
    """The faster search above against every audit of short conversations."""
    rng = random.Random(5)
    for _ in range(60):
        rows = [(rng.choice("suax"), rng.random() < 0.3, rng.random() < 0.3, "", "") for _ in range(rng.randrange(4))]
        found = []
        for n in range(len(rows) + 5):
            for audit in itertools.product("DIKR", repeat=n):
                if sum(c != "I" for c in audit) == len(rows):
                    places = iter(rows)
                    ways = [("", 0)]
                    for c in audit:
                        initial, goes, cut, *_ = next(places) if c != "I" else ("", False, False)
                        if c == "D":
                            ways = [(k, cost + 4) for k, cost in ways]
                        else:
                            letters = [initial] if c == "K" and not goes else [] if goes else ["u", "a"]
                            ways = [(k + x, cost + 3 * (c != "K") + 3 * cut) for k, cost in ways for x in letters]
                    found += [(cost, "".join(audit)) for k, cost in ways if GOOD.fullmatch(k)]
        assert min(found) == cheapest(rows)[:2]


def whole(codes):
    """Audit and cost from the module, in blocks of any size."""
    def run(size):
        parts = [codes[i:i + size] for i in range(0, len(codes), size)]
        audit, cost, b = "", 0, R.NOTHING
        for part, (a, b) in zip(parts, R.borders([R.table(p) for p in parts])):
            more, paid = R.solve(part, a, b)
            audit, cost = audit + more, cost + paid
        paid, more = min(m for m in R.moves(R.TAIL)[b] if m)
        return cost + paid, audit + more
    return run


def test_audits_in_blocks():
    rng = random.Random(6)
    for n in [*range(1, 12)] * 12 + [60, 200]:
        rows = [(rng.choices("suax", (1, 4, 4, 1))[0], rng.random() < 0.25, rng.random() < 0.25, "", "") for _ in range(n)]
        codes = bytes("suax".index(i) + R.CUT * cut + R.GOES * goes for i, goes, cut, *_ in rows)
        want = cheapest(rows)[:2]
        for size in {1, 2, 5, n}:
            assert whole(codes)(size) == want


def test_long_and_hopeless_conversations():
    for codes in (bytes([1, 2]) * 40_000, bytes([3 + R.GOES]) * 70_000, bytes([0]) * 50_000, bytes([0] + [9] * 30_000 + [0, 1, 2])):
        cost, audit = whole(codes)(R.BLOCK)
        assert (cost, audit) == whole(codes)(1000) and len(audit.replace("I", "")) == len(codes)
    assert R.forward.cache_info().currsize < 5000 and R.backward.cache_info().currsize < 5000


def test_query_equals_loops(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = expected(rows)
    got = op12(spark, SF).collect()
    assert len(got) == len(want) and {r["conv_id"] for r in got} == set(want)
    for r in got:
        assert {k: r[k] for k in want[r["conv_id"]]} == want[r["conv_id"]]


@pytest.fixture
def odd_rows():
    rng = random.Random(7)
    texts = ["Yes.", "No", "", " \t", "Why? ", "é!", None, "w " * 200_000 + "."]
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(["user", "assistant", "system", "tool", "", None, "urchin"]),
             rng.choice(texts)) for _ in range(300)]
    return rows + [(8, t, "user", "again.") for t in range(400)] + [(9, 5, "assistant", "same.")] * 500


def test_odd_rows(spark, odd_rows, tmp_path, monkeypatch):
    schema = "conv_id long, turn long, role string, text string, audit int, c string, n string"
    df = spark.createDataFrame([(*r, 1, "x", None) for r in odd_rows], schema).repartition(7)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    want = expected(odd_rows)
    monkeypatch.setattr(R, "BLOCK", 16)
    got = op12(spark, str(tmp_path)).collect()
    assert {r["conv_id"] for r in got} == set(want) and len(got) == len(want)
    for r in got:
        assert {k: r[k] for k in want[r["conv_id"]]} == want[r["conv_id"]]


def test_query_equals_sql(spark, odd_rows, tmp_path):
    """The SQL of the query on odd rows (no long conversation: its audits grow as texts)."""
    import duckdb
    from cohortlens.llm.queries import ORACLES
    rows = [r for r in odd_rows if r[0] not in (8, 9)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    cur = con.execute(ORACLES["op12_structure_repair"])
    names = [d[0] for d in cur.description]
    got = op12(spark, str(tmp_path)).collect()
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got))) == sorted(map(str, cur.fetchall()))


def test_rows_and_empty_tables(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "Hi."), (1, 1, "tool", "Out"), (2, 0, "system", "")]
    fixed = R.repair_conversations(spark.createDataFrame(rows, schema))
    assert [(r["role"], r["text"], r["letter"]) for r in fixed.rows.orderBy("conv_id", "part", "seq", "place").collect()] == [
        ("user", "Hi.", "K"), ("assistant", "Out", "R")]
    assert {r["conv_id"]: (r["audit"], r["cost"]) for r in fixed.conversations.collect()} == {1: ("KR", 6), 2: ("D", 4)}
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/conversations.parquet")
    assert op12(spark, str(tmp_path)).count() == 0
