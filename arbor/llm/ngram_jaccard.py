"""Jaccard join of word n-gram sets by adaptive multi-match prefixes.

Shingles are ordered by how many sets hold them, rarest first. Two sets that
share `o` shingles share l of them at least within the first n - o + l of each,
for any l: a prefix that is longer by l - 1 asks for l matches before a pair is
verified. Each set chooses l by what its candidates would cost.

Equal sets are one from the start. Two rounds of block-wise counting keep the
data that moves small: the first counts the heads of all sets (the shingles of
least hash) and drops sets that can't have a partner; the second counts all
shingles of the rest. Candidates first meet one leader each, the least unusual
set that holds a shingle of theirs; pairs that a verified leader connects
already are never made, so that a group of copies costs as many pairs as it has
members."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbor.llm.blocks import bucketed, press, spread
from arbor.llm.common import chunks, few, give_back, table, tidied, utf8
from arbor.llm.textnum import U, mix, shingles
from arbor.session import forget, scratch_mark, ship, written

#: Matches asked of the heads in the first round.
HEAD_MATCHES = 32
#: Matches that a set may choose to ask for.
LEVELS = (1, 2, 3, 4, 6, 8)
BLOCK_TOKENS = 1 << 19
#: Bytes of text whose shingles stand in memory at once.
CHUNK_BYTES = 1 << 19


def _least(n, num: int, den: int):
    """Shingles that a set of n shares at least with a partner of any size."""
    return -(-num * n // den)


def _digests(one: np.ndarray, two: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """128 bits of each set: sums over the mixed halves of its shingles."""
    with np.errstate(over="ignore"):
        a = np.concatenate([[U(0)], np.cumsum(mix(one ^ U(0x5851F42D4C957F2D)), dtype=U)])
        b = np.concatenate([[U(0)], np.cumsum(mix(two + U(0x14057B7EF767814F)), dtype=U)])
        at = np.concatenate([[0], ends])
        both = np.stack([a[at[1:]] - a[at[:-1]], b[at[1:]] - b[at[:-1]]], 1)
    return [r.tobytes() for r in both]


def _sets(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n, digest and the head of each row's set: its shingles of least hash."""

    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column("text"))
            ids = b.column("doc_id")
            for i, j in chunks(offsets, CHUNK_BYTES):
                row, one, two = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                n = np.bincount(row, minlength=j - i)
                ends = np.cumsum(n)
                digests = [x if m else None for x, m in zip(_digests(one, two, ends), n.tolist())]
                heads = [one[e - m : e - _least(m, num, den) + min(HEAD_MATCHES, _least(m, num, den))].tobytes() for e, m in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(heads, pa.binary())], names=["doc_id", "n", "digest", "tokens"])

    return docs.mapInArrow(tidied(run), "doc_id long, n long, digest binary, tokens binary")


def _whole_sets(k: int):
    """From batches of (id, digest, text) to id, n, tokens and marks (first and
    second halves, in the order of the first) of those whose set has the digest."""

    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column("text"))
            for i, j in chunks(offsets, CHUNK_BYTES):
                row, one, two = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                n = np.bincount(row, minlength=j - i)
                ends = np.cumsum(n)
                keep = np.flatnonzero([x == y for x, y in zip(_digests(one, two, ends), b.column("digest").slice(i, j - i).to_pylist())])
                parts = [(int(ends[r] - n[r]), int(ends[r])) for r in keep]
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i).take(pa.array(keep)), pa.array(n[keep], pa.int64()), pa.array([one[s:e].tobytes() for s, e in parts], pa.binary()), pa.array([two[s:e].tobytes() for s, e in parts], pa.binary())], names=["id", "n", "tokens", "marks"])

    return run


def _pressed(tokens: np.ndarray) -> bytes:
    """Ascending tokens by their gaps, the upper and the lower halves of which
    stand apart: the denser they are, the fewer bytes."""
    gaps = np.diff(tokens, prepend=U(0))
    return press(gaps >> U(32)) + press(gaps & U(0xFFFFFFFF))


def _unpressed(b: bytes) -> np.ndarray:
    upper, rest = spread(b)
    return np.cumsum((upper.astype(U) << U(32)) | spread(rest)[0].astype(U), dtype=U)


_BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("ns", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("marks", pa.binary()), ("codes", pa.binary()), ("packs", pa.list_(pa.struct([("bucket", pa.int32()), ("tokens", pa.binary()), ("counts", pa.binary())])))])


def _counted(sets: DataFrame, tag: str, buckets: int, back, schema: str, first=lambda batches: batches) -> DataFrame:
    """back(ids, ns, sizes, tokens, marks, df) of each block of sets(id, n,
    tokens, marks), df being how many sets hold each token. A token counts once
    a block before it moves; marks stay in their block. first makes batches of
    sets of what sets holds, in the same task."""

    def deal(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        ids, ns, held, marks, size = [], [], [], [], 0

        def out():
            flat = np.concatenate([np.frombuffer(x, U) for x in held])
            found, code, count = np.unique(flat, return_inverse=True, return_counts=True)
            bucket = ((found >> U(32)) * U(buckets)) >> U(32)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=U)).tolist()
            packs = [{"bucket": x, "tokens": _pressed(found[s:e]), "counts": press(count[s:e])} for x, (s, e) in enumerate(zip(cuts, cuts[1:])) if s < e]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((block, ids, ns, [len(x) // 8 for x in held], b"".join(marks), press(code), packs), _BLOCK)], schema=_BLOCK)

        for b in first(batches):
            for i, n, x, y in zip(b.column("id").to_pylist(), b.column("n").to_pylist(), b.column("tokens"), b.column("marks")):
                ids.append(i)
                ns.append(n)
                held.append(x.as_py())
                marks.append(y.as_py())
                size += len(held[-1]) // 8
                if size >= BLOCK_TOKENS:
                    yield out()
                    block, ids, ns, held, marks, size = block + 1, [], [], [], [], 0
        if size:
            yield out()

    def count(key, group):
        tokens = [_unpressed(x) for x in group.column("tokens").to_pylist()]
        times = np.concatenate([spread(x)[0] for x in group.column("counts").to_pylist()])
        _, code = np.unique(np.concatenate(tokens), return_inverse=True)
        df = np.minimum(np.bincount(code, times), 2**32 - 1).astype(np.uint32)[code]
        cuts = np.cumsum([0, *map(len, tokens)]).tolist()
        return pa.table([group.column("block"), group.column("bucket"), pa.array([press(df[s:e]) for s, e in zip(cuts, cuts[1:])], pa.binary())], names=["block", "bucket", "df"])

    def join(key, left, right):
        packs = left.column("packs")[0].as_py()
        tokens = np.concatenate([_unpressed(p["tokens"]) for p in packs])
        give_back()
        df = np.concatenate([spread(x)[0] for _, x in sorted(zip(right.column("bucket").to_pylist(), right.column("df").to_pylist()))])
        code = spread(left.column("codes")[0].as_py())[0]
        one = [left.column(c)[0].as_py() for c in ("ids", "ns", "sizes")]
        return back(*one, tokens[code], np.frombuffer(left.column("marks")[0].as_py(), U), df[code])

    blocks = bucketed(sets.mapInArrow(tidied(deal), "block long, ids array<long>, ns array<long>, sizes array<long>, marks binary, codes binary, packs array<struct<bucket:int,tokens:binary,counts:binary>>"), tag, buckets)
    packs = blocks.select("block", F.explode("packs").alias("p")).select("block", "p.bucket", "p.tokens", "p.counts")
    df = packs.groupBy("bucket").applyInArrow(count, "block long, bucket int, df binary")
    return blocks.groupBy("block").cogroup(df.groupBy("block")).applyInArrow(join, schema)


def _alive(num: int, den: int):
    """Sets whose heads share enough with other sets' heads to have a partner."""

    def back(ids, ns, sizes, tokens, marks, df):
        row = np.repeat(np.arange(len(sizes)), sizes)
        shared = np.bincount(row, df > 1, len(sizes))
        need = np.minimum(HEAD_MATCHES, _least(np.array(ns), num, den))
        keep = np.flatnonzero(shared >= need)
        return pa.table([pa.array(np.array(ids)[keep], pa.int64())], names=["id"])

    return back


def choose_level(df: np.ndarray, unique: int, n: int, least: int, alike: int) -> int:
    """The number of matches to ask for that costs least: reading the prefix's
    posting lists, and verifying, at n steps each, the candidates that share so
    many; of df - 1 meetings with other sets, one in l makes such a candidate.
    Most partners are of about the same size and share `alike` shingles at
    least, so that the first n - alike + l places count."""
    best = (np.inf, 1)
    total = np.concatenate([[0], np.cumsum(df.astype(np.float64) - 1)])
    for level in LEVELS:
        if level > least:
            break
        meetings = total[min(len(df), max(0, n - alike + level - unique))]
        best = min(best, (meetings * (1 + n / 16 / level), level))
    return best[1]


_ORDERED = "id long, n long, unique long, level int, prefix array<long>, tokens binary, marks binary"


def _ordered(num: int, den: int):
    """Sets that can have a partner, their shared tokens rarest first: unique
    tokens, which no other set holds, stand before them."""

    def back(ids, ns, sizes, tokens, marks, df):
        out, s = [], 0
        for i, n, m in zip(ids, ns, sizes):
            t, d, z = tokens[s : s + m], df[s : s + m], marks[s : s + m]
            s += m
            t, d, z = t[d > 1], d[d > 1], z[d > 1]
            unique, least = n - len(t), int(_least(n, num, den))
            if unique > n - least:
                continue
            order = np.lexsort((t, d))
            t, d, z = t[order], d[order], z[order]
            level = choose_level(d, unique, n, least, -(-2 * num * n // (num + den)))
            out.append((i, n, unique, level, t[: n - least + level - unique].view(np.int64), t.tobytes(), z.tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary())
        columns = list(zip(*out)) if out else [[]] * 7
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "n", "unique", "level", "prefix", "tokens", "marks"])

    return back


def _need(a: str, b: str, num: int, den: int) -> str:
    """Shingles that sets of sizes a and b share at least if they are linked."""
    return f"(({num} * ({a} + {b}) + {den + num - 1}) div {den + num})"


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of pairs(x, y) whose sets are linked, by all 128 bits of their shingles."""

    def run(batches):
        for b in batches:
            keep = []
            columns = [b.column(c) for c in ("xt", "xm", "yt", "ym")]
            for i, (xn, yn) in enumerate(zip(b.column("xn").to_pylist(), b.column("yn").to_pylist())):
                xt, xm, yt, ym = (np.frombuffer(c[i].as_buffer(), U) for c in columns)
                both, marks = np.concatenate([xt, yt]), np.concatenate([xm, ym])
                order = both.argsort(kind="stable")
                both, marks = both[order], marks[order]
                n = int(((both[1:] == both[:-1]) & (marks[1:] == marks[:-1])).sum())
                keep.append(den * n >= num * (xn + yn - n))
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y")], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("id").alias("x"), F.col("n").alias("xn"), F.col("tokens").alias("xt"), F.col("marks").alias("xm"))
    two = sets.select(F.col("id").alias("y"), F.col("n").alias("yn"), F.col("tokens").alias("yt"), F.col("marks").alias("ym"))
    return pairs.join(one, "x").join(two, "y").select("x", "y", "xn", "yn", "xt", "xm", "yt", "ym").mapInArrow(tidied(run), "x long, y long")


def living(reps: DataFrame, heads: DataFrame, num: int, den: int) -> DataFrame:
    """id and times (rows) of the sets of reps(id, doc_id, digest) whose heads
    leave it open that they have a partner, written."""
    buckets = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = heads.join(reps.select("id", "doc_id", "digest"), ["doc_id", "digest"]).select("id", "n", "tokens", F.lit(b"").alias("marks"))
    alive = _counted(first, "heads", buckets, _alive(num, den), "id long")
    return written(alive.groupBy("id").agg(F.count("*").alias("times")), "alive")


def links(docs: DataFrame, reps: DataFrame, alive: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links x, y between the sets of reps(id, doc_id, digest) that connect all
    that are connected, alive being living() of them. A set is known by its id,
    whatever doc_ids hold it."""
    spark = docs.sparkSession
    mark = scratch_mark(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = written(reps.join(few(alive.select("id")), "id", "left_semi").select("id", "doc_id", "digest"), "wanted")
    full = docs.join(few(wanted), "doc_id").select("id", "digest", "text")
    if not alive.where("times > 1").isEmpty():  # rows that repeat doc_id and text
        full = full.dropDuplicates(["id", "text"])
    sets = written(_counted(full, "sets", buckets, _ordered(num, den), _ORDERED, _whole_sets(k)), "ordered")
    forget(spark, mark, sets)
    at = sets.select("id", "n", "unique", "level", F.posexplode("prefix").alias("p", "token")).withColumn("p", F.col("p") + F.col("unique"))

    # round 1: each set and the least unusual one that holds a token of its prefix
    lead = at.groupBy("token").agg(F.min(F.struct((F.col("unique") / F.col("n")).alias("rate"), "id", "n", "p")).alias("lead"), F.count("*").alias("times")).where("times > 1")
    met = at.join(lead.select("token", "lead.*").toDF("token", "rate", "y", "yn", "yp"), "token").where("id <> y")
    need = _need("n", "yn", num, den)
    met = met.where(f"p <= n - {need} and yp <= yn - {need}")
    star = met.groupBy("id", "y").agg(F.count("*").alias("times")).groupBy("id").agg(F.max_by("y", F.struct("times", -F.col("y"))).alias("y"))
    near = written(_verified(star.select(F.col("id").alias("x"), "y"), sets, num, den), "star")

    # round 2: pairs that these links don't connect already
    up = near.select(F.col("x").alias("id"), F.col("y").alias("g"))
    over = up.select(F.col("id").alias("g"), F.col("g").alias("gg"))
    group = up.join(over, "g", "left").select("id", F.when(F.coalesce("gg", "g") == F.col("id"), F.least("id", "g")).otherwise(F.coalesce("gg", "g")).alias("g"))
    rows = written(at.join(group, "id", "left").withColumn("g", F.coalesce("g", "id")), "prefixes")
    most = rows.groupBy("token", "g").agg(F.count("*").alias("times")).groupBy("token").agg(F.max_by("g", F.struct("times", "g")).alias("most"), F.count("*").alias("groups")).where("groups > 1").drop("groups")
    rows = rows.join(most, "token").withColumn("minor", F.col("g") != F.col("most")).drop("most")
    # the smaller of two sets needs no longer a prefix than its least overlap with a set no smaller
    small = f"p < n - {_need('n', 'n', num, den)} + level"
    x = rows.select("token", *(F.col(c).alias("x" + c) for c in ("id", "n", "p", "level", "g", "minor")))
    y = rows.where(small).select("token", *(F.col(c).alias("y" + c) for c in ("id", "n", "p", "level", "g", "minor")))
    need = _need("xn", "yn", num, den)
    fits = f"xg <> yg and (yn < xn or yn = xn and yid < xid) and {den} * yn >= {num} * xn and xp < xn - {need} + least(xlevel, ylevel) and yp < yn - {need} + least(xlevel, ylevel)"
    pairs = x.where("xminor").join(y, "token").where(fits).unionAll(x.where("not xminor").join(y.where("yminor"), "token").where(fits))
    pairs = pairs.groupBy("xid", "yid").agg(F.count("*").alias("times"), F.max(F.least("xlevel", "ylevel")).alias("level")).where("times >= level")
    rest = _verified(pairs.select(F.col("xid").alias("x"), F.col("yid").alias("y")), sets, num, den)
    return near.unionAll(written(rest, "rest"))


def components(edges: DataFrame) -> DataFrame:
    """node and the least node that it is connected with, for all nodes of
    edges(x, y): alternating large and small stars until nothing changes."""
    spark = edges.sparkSession
    now = edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct()
    now = written(now, "edges")
    seen = None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").distinct(), "edges")
        told = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == tuple(told):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component_id"))
        seen = tuple(told)


def jaccard_classes(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs(doc_id, text).

    Two texts are linked if their sets of k-word shingles have num / den of
    their union in common; component_id is the least doc_id that links reach.
    Words are what ASCII white space parts, A-Z lower-cased. A text of fewer
    words is one shingle; one without words, or null, has none and is alone. A
    null doc_id has a null component_id and is linked with nothing; rows that
    repeat a doc_id have each the component of their own text; other columns are
    ignored; an empty table gives none. Shingles and sets are told apart by 128
    bits, made from BLAKE2 digests of the words."""
    spark = docs.sparkSession
    ship(spark)
    mark = scratch_mark(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    heads = written(_sets(docs, k, num, den), "sets")
    rows = written(heads.drop("tokens"), "rows")  # what is left of them when the heads have been counted
    # exact copies: one set, which goes by its least doc_id
    reps = rows.where("doc_id is not null and n > 0").groupBy("digest", "n").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    reps = written(reps, "reps")
    # a doc_id that is the least of several sets can't be the id of each
    shared, seed, named = reps.groupBy("doc_id").count().where("count > 1"), 0, reps.withColumn("id", F.col("doc_id"))
    plain = shared.isEmpty()
    while not plain:
        named = reps.withColumn("id", F.xxhash64(F.lit(seed), "digest", "n"))
        if named.groupBy("id").count().where("count > 1").isEmpty():
            break
        seed += 1
    alive = living(named, heads, num, den)
    forget(spark, mark, rows, reps, alive)  # large steps go as soon as their rows are used up, not at the end
    joined = components(links(docs, named, alive, k, num, den))
    forget(spark, mark, rows, reps, joined)
    joined = joined.select(F.col("node").alias("id"), F.col("component_id").alias("root"))
    of_set = named.select("digest", "copies", "doc_id", "id").join(joined, "id", "left").withColumn("root", F.coalesce("root", "id"))
    if plain:
        of_set = of_set.withColumn("component_id", F.col("root"))
    else:
        of_set = of_set.join(of_set.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root")
    # only copies, members of larger components and sets of shared ids need to look theirs up
    told = of_set.where("copies > 1 or component_id <> doc_id").select("digest", "component_id")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(told, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), 3, 90, 100)
