"""Exact Jaccard join of 5-word shingle sets, by a token-group matrix.

Two texts link when 100 * |A and B| >= 80 * |A or B|. Texts with equal sets are
one class from the start, however many there are.

* Shingles are put in one fixed order, the frequent ones last. If two sets
  link, the first ``n - ceil(0.8 n) + l`` of each share ``l`` at least, where
  ``l(n) = floor(n / 20) + 1``; so only those beginnings are compared first.
* Similar classes are put into groups: a class is compared whole with the
  class that leads the lists it shares, twice over; what links is one group.
* The matrix then has a cell for each shingle of a beginning and each group
  that has it in the union of its members' beginnings. A class's overlap with
  a group's column is counted; where it is under the bound, no member can link,
  and the group stays closed. Qualifying groups are opened: the members that
  share enough are compared whole, set against set.

No pair of one group is compared once the group is known to be connected, and
no list of texts is ever gathered in one place. Sets are of 64-bit hashes, and a
class is known by a 64-bit sum over its set.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import vectext as V
from cohortlens.llm.bits import bit_filter, passes
from cohortlens.llm.components import connected_components
from cohortlens.session import ensure_checkpoint_dir

SHINGLE = 5
FREQUENT = 0.001        # a shingle in more than this share of the texts is put last
FLUSH = 2_000_000       # shingles counted at once in a task
STAR_ROUNDS = 2         # what they leave apart, the matrix settles
PARITY = 8              # words of 64 bits; each shingle flips one bit of its class's parities

_TEXTS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("check", pa.int64()),
                    ("token", pa.int64()), ("hits", pa.int64()), *[(f"p{k}", pa.int64()) for k in range(PARITY)]])
_POSTINGS = pa.schema([("token", pa.int64()), ("cls", pa.int64()), ("n", pa.int32())])
_SETS = pa.schema([("doc_id", pa.int64()), ("cls", pa.int64()), ("shingles", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[int]]]:
    """Ids, shingle sets and class numbers of bounded runs of texts."""
    for batch in batches:
        ids = batch.column(0)
        data, offsets = V.flat(batch.column(1))
        for a, b, d, o in V.chunks(data, offsets):
            sets = V.shingle_sets(V.Words(d, o), SHINGLE)
            yield ids.slice(a, b - a), sets, [int(V.mix(s).sum(dtype=np.uint64).astype(np.int64)) for s in sets]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text, and rows of shingles that came up often in a task."""
    held: dict[int, np.ndarray] = {}
    size = 0

    def often():
        u, n = np.unique(np.concatenate(list(held.values())), return_counts=True)
        u, n = u[keep := n >= max(2, FREQUENT * len(held))], n[keep]
        none = pa.nulls(len(u), pa.int64())
        return pa.record_batch([none, none, none, none, pa.array(u.view(np.int64)), pa.array(n)] + [none] * PARITY, schema=_TEXTS)

    for ids, sets, classes in _sets(batches):
        check = [int(V.mix(s ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
        none = pa.nulls(len(sets), pa.int64())
        yield pa.record_batch([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.int64()),
                               pa.array(check, pa.int64()), none, none,
                               *[pa.array(column) for column in _parities(sets)]], schema=_TEXTS)
        for c, s in zip(classes, sets):
            if len(s) and c not in held:
                held[c] = s
                size += len(s)
        if size > FLUSH:
            yield often()
            held, size = {}, 0
    if held:
        yield often()


def _beginnings(frequent, wanted):
    """Mapper to rows of (shingle, class, set size); ``wanted`` is a bit filter or None."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, place = frequent.value
        bits = wanted.value if wanted is not None else None
        done: set[int] = set()
        for _, sets, classes in _sets(batches):
            tokens, cls, size = [], [], []
            for c, s in zip(classes, sets):
                n = len(s)
                if not n or c in done:
                    continue
                done.add(c)
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    late = common[at] == s
                    if late.any():
                        s = np.concatenate((s[~late], s[late][np.argsort(place[at[late]], kind="stable")]))
                s = s[:n - -(-n * 4 // 5) + n // 20 + 1]
                if bits is not None:
                    s = s[passes(bits, s)]
                tokens.append(s)
                cls.append(np.full(len(s), c, np.int64))
                size.append(np.full(len(s), n, np.int32))
            if tokens:
                yield pa.record_batch([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(cls)),
                                       pa.array(np.concatenate(size))], schema=_POSTINGS)
    return run


def _whole_sets(wanted):
    """Mapper to the whole sets of the texts whose hashed id passes the bit filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = pa.array(passes(wanted.value, batch.column(2).to_numpy().view(np.uint64)), pa.bool_())
            for ids, sets, classes in _sets([batch.filter(passed)]):
                yield pa.record_batch([ids, pa.array(classes, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                                      schema=_SETS)
    return run


def _parities(sets: list[np.ndarray]) -> np.ndarray:
    """Columns of words of parities, a bit for each shingle modulo their number:
    two sets differ in as many shingles, at least, as their parities in bits."""
    bits = 64 * PARITY
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    place = (np.concatenate([*sets, np.zeros(0, np.uint64)]) >> np.uint64(40)).astype(np.int64) % bits
    odd = (np.bincount(row * bits + place, minlength=len(sets) * bits) & 1).astype(np.uint8).reshape(-1, bits)
    return np.packbits(odd, axis=1).view(np.int64).T.copy()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = int((y[at] == x).sum())
            keep.append(100 * both >= 80 * (len(x) + len(y) - both))
        yield batch.select([0, 1, 4, 5]).filter(pa.array(keep, pa.bool_()))


def need(n: Column) -> Column:
    """Shared shingles of the beginnings that a link needs, by the smaller size."""
    return F.floor(n / 20) + 1


def _alike(n: Column, m: Column) -> Column:
    return F.least(n, m) * 5 >= F.greatest(n, m) * 4


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): a row for each row of ``docs``.

    Null, empty and blank texts have no shingles and are their own component;
    repeated rows each get a row; rows with a null id keep it, and take part in
    links without lending their id. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    keep = _Shelf(spark)
    scanned = keep(source.mapInArrow(_texts, _ddl(_TEXTS)))
    texts = scanned.where("hits is null").select("doc_id", "n", "cls", "check")
    parities = [F.first(f"p{k}").alias(f"p{k}") for k in range(PARITY)]
    classes = keep(scanned.where("hits is null and n > 0").groupBy("cls", "check", "n").agg(F.min("doc_id").alias("rep"), *parities))
    links = _links(keep, source, scanned, classes)
    member = connected_components(links).withColumnsRenamed({"node": "cls"})
    grouped = classes.select("cls", "check", "n", "rep").join(member, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    smallest = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = grouped.join(smallest, "component").select("cls", "check", "n", "component_id")
    return (texts.join(named, ["cls", "check", "n"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))


class _Shelf:
    """Writes tables to the session's checkpoint folder, as Parquet, and reads them back."""

    def __init__(self, spark):
        self.spark, self.folder = spark, f"{ensure_checkpoint_dir(spark)}/jaccard-{uuid.uuid4().hex}"
        self.count = 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.count += 1
        df.write.parquet(f"{self.folder}/{self.count}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.count}")


def _links(keep: _Shelf, source: DataFrame, scanned: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between classes; they join up all that belong together."""
    lists = _shared_beginnings(keep, source, scanned, classes.count())
    reps = classes.select("cls", "rep")
    links = None
    for k in range(STAR_ROUNDS):
        new = keep(_compare(keep, source, reps, _star_pairs(lists, k)))
        links = new if links is None else links.unionByName(new)
        joined = connected_components(new.select("ga", "gb"), "ga", "gb").withColumnsRenamed({"node": "grp"})
        lists = keep(_unsettled(lists.join(joined, "grp", "left").withColumn("grp", F.coalesce("component", "grp"))
                                .drop("component")))
        if new.isEmpty() or lists.isEmpty():
            break
    parities = classes.select("cls", *[f"p{k}" for k in range(PARITY)])
    return links.unionByName(_compare(keep, source, reps, _opened(keep, lists, parities))).select("a", "b")


def _shared_beginnings(keep: _Shelf, source: DataFrame, scanned: DataFrame, total: int) -> DataFrame:
    """(token, cls, n, grp, shared): the beginnings of all classes that could link with
    another, and how many shingles of its beginning a class shares."""
    often = (scanned.where("hits is not null").groupBy("token").agg(F.sum("hits").alias("hits"))
             .where(F.col("hits") >= max(2, FREQUENT * total / 2)).toArrow())
    # 2 / FREQUENT times the mean set size at most, whatever the table's size
    common, hits = often["token"].to_numpy().view(np.uint64), often["hits"].to_numpy()
    order = np.argsort(common)
    common, hits = common[order], hits[order]
    place = np.empty(len(common), np.int64)
    place[np.lexsort((common, hits))] = np.arange(len(common))
    frequent = keep.spark.sparkContext.broadcast((common, place))
    shared = keep(source.mapInArrow(_beginnings(frequent, None), _ddl(_POSTINGS)).groupBy("token")
                  .agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("token"))
    again = _beginnings(frequent, bit_filter(shared, F.col("token")))
    lists = keep(source.mapInArrow(again, _ddl(_POSTINGS)).join(shared, "token", "left_semi").distinct())
    enough = (lists.groupBy("cls").agg(F.count(F.lit(1)).alias("shared"), F.first("n").alias("m"))
              .where(F.col("shared") >= need(F.ceil(F.col("m") * 0.8))))
    return keep(lists.join(enough.select("cls", "shared"), "cls").withColumn("grp", F.col("cls")))


def _unsettled(lists: DataFrame) -> DataFrame:
    """The lists that hold classes of several groups."""
    several = lists.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi")
    return lists.join(several.select("token"), "token", "left_semi")


def _star_pairs(lists: DataFrame, k: int) -> DataFrame:
    """(a, ga, b, gb): each class with up to two leaders of lists that it shares
    most with. A list is led by the class of which the largest part is shared,
    which of a group of copies is the one least changed, and by one at random;
    after the first round by two at random, others in each round."""
    at_random = lambda i: F.min(F.struct(F.xxhash64(F.lit(i), "cls").alias("o"), "cls", "grp", "n"))
    if k:
        leads = lists.groupBy("token").agg(at_random(2 * k).alias("l0"), at_random(2 * k + 1).alias("l1"))
    else:
        leads = lists.groupBy("token").agg(
            F.max(F.struct((F.col("shared") / F.col("n")).alias("o"), "cls", "grp", "n")).alias("l0"), at_random(0).alias("l1"))
    plain = [F.struct(*[F.col(f"{x}.{c}").alias(c) for c in ("cls", "grp", "n")]) for x in ("l0", "l1")]
    leads = leads.select("token", F.explode(F.array_distinct(F.array(*plain))).alias("l")).select(
        "token", F.col("l.cls").alias("b"), F.col("l.grp").alias("gb"), F.col("l.n").alias("m"))
    shared = (lists.join(leads, "token").where((F.col("grp") != F.col("gb")) & _alike(F.col("n"), F.col("m")))
              .groupBy(F.col("cls").alias("a"), F.col("grp").alias("ga"), "b", "gb", "n", "m").agg(F.count(F.lit(1)).alias("k"))
              .where(F.col("k") >= need(F.least("n", "m"))))
    # as many leaders as a class has shingles in its beginning, at most twice over
    best = F.slice(F.sort_array(F.collect_list(F.struct("k", "b", "gb")), False), 1, 2)
    return (shared.groupBy("a", "ga").agg(best.alias("best")).select("a", "ga", F.explode("best").alias("l"))
            .select("a", "ga", F.col("l.b").alias("b"), F.col("l.gb").alias("gb")))


def _opened(keep: _Shelf, lists: DataFrame, parities_of: DataFrame) -> DataFrame:
    """(a, ga, b, gb): pairs of classes of different groups that the bounds do not
    rule out. Of two groups, the smaller one's members ask the larger one's column.

    Beside the count of shared shingles, the parities bound a pair: linked sets of
    sizes n and m differ in (n + m) / 9 shingles at most.
    """
    parities = [f"p{k}" for k in range(PARITY)]
    size = lists.select("grp", "cls").distinct().groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    lists = keep(lists.join(size, "grp").join(parities_of, "cls"))

    def near(n: str, m: str) -> Column:
        differ = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"q{p}"))) for p in parities), F.lit(0))
        return _alike(F.col(n), F.col(m)) & (differ * 9 <= F.col(n) + F.col(m))

    column = lists.groupBy("token", F.col("grp").alias("g"), F.col("size").alias("larger")).agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), *[F.max(p).alias(f"q{p}") for p in parities])
    asks = (F.col("size") < F.col("larger")) | ((F.col("size") == F.col("larger")) & (F.col("grp") > F.col("g")))
    fits = (F.col("lo") * 4 <= F.col("n") * 5) & (F.col("hi") * 5 >= F.col("n") * 4)
    overlap = (lists.join(column, (lists["token"] == column["token"]) & asks & fits & ((F.col("larger") > 1) | near("n", "lo")))
               .groupBy("cls", "n", "g").agg(F.count(F.lit(1)).alias("k")))
    qualify = overlap.where(F.col("k") >= need(F.ceil(F.col("n") * 0.8))).select("cls", "g")
    asked = lists.join(qualify, "cls").select("token", F.col("cls").alias("a"), F.col("grp").alias("ga"), "n", "g", *parities)
    member = lists.select("token", F.col("grp").alias("g"), F.col("cls").alias("b"), F.col("n").alias("m"),
                          *[F.col(p).alias(f"q{p}") for p in parities])
    same = (asked["token"] == member["token"]) & (asked["g"] == member["g"])
    return (asked.join(member, same & near("n", "m")).groupBy("a", "ga", "b", asked["g"].alias("gb"), "n", "m")
            .agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= need(F.least("n", "m"))).select("a", "ga", "b", "gb"))


def _compare(keep: _Shelf, source: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (with their groups) whose whole sets are alike enough. Sets are
    made again from the texts, for the classes in the pairs alone."""
    for side in ("a", "b"):
        pairs = pairs.join(reps.select(F.col("cls").alias(side), F.col("rep").alias(f"rep_{side}")), side)
    pairs = keep(pairs)
    ids = pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).distinct()
    hashed = source.select("doc_id", "text", F.xxhash64("doc_id").alias("key"))
    sets = keep(hashed.mapInArrow(_whole_sets(bit_filter(ids, F.xxhash64("rep"))), _ddl(_SETS)))
    x = sets.select(F.col("cls").alias("_a"), F.col("doc_id").alias("_ra"), F.col("shingles").alias("x"))
    y = sets.select(F.col("cls").alias("_b"), F.col("doc_id").alias("_rb"), F.col("shingles").alias("y"))
    return (pairs.join(x, (F.col("a") == F.col("_a")) & F.col("rep_a").eqNullSafe(F.col("_ra")))
            .join(y, (F.col("b") == F.col("_b")) & F.col("rep_b").eqNullSafe(F.col("_rb")))
            .select("a", "b", "x", "y", "ga", "gb").mapInArrow(_linked, "a long, b long, ga long, gb long").distinct())
