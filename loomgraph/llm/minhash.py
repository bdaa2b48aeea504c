"""MinHash near-dedup by a signature-coordinate inverted join.

Documents are posted under each (coordinate, value) pair of their MinHash
signature. Two documents at the required similarity agree in at least T of K
coordinates (but for a chance of MISS), so they meet under one of the K-T+1
rarest postings of each (prefix) and the agreement of the pairs met there is
counted over whole signatures (skip); pairs from T on are confirmed on full
shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import column, is_small, packed, semi_small, small_batches
from loomgraph.llm.words import Words, mix, shingle_sets, slices
from loomgraph.operators.components import connected_components
from loomgraph.operators.skew import join_keyed
from loomgraph.store import cut, drop

COORDINATES = 32
#: Bytes of text that are hashed together; each takes some ten times as much in arrays.
HASHED_BYTES = 1 << 20
#: Chance at most that a pair right at the threshold shows too few agreeing coordinates.
MISS = 1e-6
#: Documents of a posting list that are compared in one task.
BLOCK = 512
#: Lists of more blocks than this are first compared with PIVOTS of their members.
LONG, PIVOTS = 4, 16
#: Candidate pairs of a task from which shared shingles are counted by a matrix product.
DENSE = 3000

_A = mix(np.arange(COORDINATES, dtype=np.uint64), 21) | np.uint64(1)
_B = mix(np.arange(COORDINATES, dtype=np.uint64), 22)


def match_threshold(percent: int, k: int = COORDINATES, miss: float = MISS) -> int:
    """Largest T with P(Binomial(k, percent/100) < T) <= miss; 1 at least."""
    p, below, t = percent / 100, 0.0, 0
    while t < k:
        below += comb(k, t) * p**t * (1 - p) ** (k - t)
        if below > miss:
            break
        t += 1
    return max(t, 1)


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash signatures (int32, documents x COORDINATES) of the non-empty sets."""
    out = np.empty((len(bounds), COORDINATES), np.int32)
    for k in range(COORDINATES):
        v = ((sets ^ _B[k]) * _A[k]) >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(v, bounds).astype(np.uint32).view(np.int32)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", HASHED_BYTES):
            w = Words(part.column(1), lower=True)
            h, bounds, n = shingle_sets(w)
            full = np.flatnonzero(n)
            sig = signatures(h, bounds[:-1][full]) if len(full) else np.zeros((0, COORDINATES), np.int32)
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, COORDINATES, 0))]).astype(np.int32)
            # the word sequence as a whole, twice 64 bits
            keys = []
            for seed in (31, 32):
                c = np.concatenate([[0], np.cumsum(mix(w.hash, seed) * mix(np.arange(len(w.hash), dtype=np.uint64) - np.repeat(w.first[:-1], w.count).astype(np.uint64), seed + 2))]).astype(np.uint64)
                keys.append(mix((c[w.first[1:]] - c[w.first[:-1]]) ^ w.count.astype(np.uint64), seed).view(np.int64))
            arrays = [part.column(0), part.column(2), pa.array(n), *map(pa.array, keys), pa.ListArray.from_arrays(pa.array(ends), pa.array(sig.ravel()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "t", "n_shingles", "k1", "k2", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", HASHED_BYTES):
            h, bounds, _ = shingle_sets(Words(part.column(1), lower=True))
            data = h.tobytes()
            rows = [data[8 * a : 8 * b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], names=["id", "set"])


def _members(block: pa.StructArray) -> dict[str, np.ndarray]:
    """The documents of a block as arrays."""
    out = {f: block.field(f).to_numpy(zero_copy_only=False) for f in ("id", "n", "mask", "comp")}
    return out | {"sig": block.field("sig").flatten().to_numpy(zero_copy_only=False).reshape(-1, COORDINATES)}


def _meet(least: int, percent: int):
    """Of two blocks of a list: pairs that agree in ``least`` coordinates, have sizes that allow the
    similarity, lie in different components and share no earlier prefix coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                c, same_block = batch.column(0)[r].as_py(), batch.column(2)[r] == batch.column(3)[r]
                x, y = _members(batch.column(4)[r].values), _members(batch.column(5)[r].values)
                both = x["mask"][:, None] & y["mask"][None, :]
                agree = np.zeros(both.shape, np.uint8)
                earlier = np.zeros(both.shape, bool)
                for k in range(COORDINATES):
                    eq = x["sig"][:, k][:, None] == y["sig"][:, k][None, :]
                    agree += eq
                    if k < c:
                        earlier |= eq & ((both >> k) & 1).astype(bool)
                low, high = np.minimum(x["n"][:, None], y["n"][None, :]), np.maximum(x["n"][:, None], y["n"][None, :])
                good = (agree >= least) & ~earlier & (low * 100 >= high * percent) & (x["comp"][:, None] != y["comp"][None, :])
                if same_block:
                    good = np.triu(good, 1)
                i, j = np.nonzero(good)
                if not len(i):
                    continue
                ids, at = np.unique(np.concatenate([x["id"][i], y["id"][j]]), return_inverse=True)
                pairs = at.reshape(2, -1).T.astype(np.uint16)
                arrays = [*(batch.column(f).slice(r, 1) for f in range(4)), pa.array([ids.tolist()]), pa.array([pairs.tobytes()])]
                yield pa.RecordBatch.from_arrays(arrays, schema=_TASK_SCHEMA)

    return run


_TASK = "c int, v int, xk int, yk int, ids array<long>, pairs binary"
_TASK_SCHEMA = pa.schema([("c", pa.int32()), ("v", pa.int32()), ("xk", pa.int32()), ("yk", pa.int32()), ("ids", pa.list_(pa.int64())), ("pairs", pa.binary())])


def _common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets i and j."""
    if len(i) < DENSE:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    doc = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, col, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(n > 1) - 1
    used = (n > 1)[col]
    doc, col = doc[used], place[col[used]]
    order = np.argsort(col, kind="stable")
    doc, col = doc[order], col[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    step = 4096
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, step):
        a, b = np.searchsorted(col, [at, at + step])
        m = np.zeros((len(sets), step), np.float32)
        m[doc[a:b], col[a:b] - at] = 1
        total += m @ m.T
    return total[i, j].astype(np.int64)


def _confirm(percent: int):
    """Confirms a task's pairs on full sets; of the links a spanning forest is enough for components."""

    def run(sets: pa.Table, task: pa.Table) -> pa.Table:
        out: tuple[list, list] = ([], [])
        place = {d: k for k, d in enumerate(sets.column("id").to_pylist())}
        full = [np.frombuffer(x.as_buffer(), np.uint64) for x in sets.column("set")]
        for r in range(task.num_rows):
            ids = task.column("ids")[r].as_py()
            at = np.array([place[d] for d in ids])
            pairs = at[np.frombuffer(task.column("pairs")[r].as_buffer(), np.uint16).reshape(-1, 2)]
            both = _common(full, pairs[:, 0], pairs[:, 1])
            n = np.array([len(x) for x in full])
            linked = pairs[100 * both >= percent * (n[pairs[:, 0]] + n[pairs[:, 1]] - both)]
            root = list(range(len(full)))

            def find(x: int, root=root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            names = sets.column("id").to_pylist()
            for p, q in linked.tolist():
                p0, q0 = find(p), find(q)
                if p0 != q0:
                    root[q0] = p0
                    out[0].append(names[p])
                    out[1].append(names[q])
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return run


def _linked(rows: DataFrame, sets: DataFrame, percent: int, least: int) -> DataFrame:
    """Links (a, b) that span the components inside each pair of blocks ``rows`` (c, v, xk, yk, x, y)."""
    keys = ["c", "v", "xk", "yk"]
    tasks = cut(rows.select(*keys, "x", "y").mapInArrow(_meet(least, percent), _TASK), "tasks")
    need = tasks.select(*keys, F.explode("ids").alias("id")).join(semi_small(sets, tasks.select(F.explode("ids").alias("id")), "id"), "id").select(*keys, "id", "set")
    mine = need.toDF(*(f"n_{k}" for k in keys), "id", "set").groupBy(*(f"n_{k}" for k in keys))
    both = mine.cogroup(tasks.groupBy(*keys))
    links = cut(both.applyInArrow(_confirm(percent), "a long, b long"), "links")
    drop(tasks)
    return links


def near_components(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Words are runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z; a set
    holds the distinct 5-word shingles, of a shorter text its whole word
    sequence. Documents with Jaccard similarity of at least ``percent``/100
    are linked; component_id is the smallest id reachable. A text without
    words (or null) has an empty set and is linked with nothing. Rows that
    repeat an id are one document for the links; a null id is never linked and
    its component is null. An empty table gives no rows; other columns are
    ignored. Ids are whole numbers. A very long text is one set, held whole by
    the task that compares it.

    Equal word sequences are one class, so copies never form pairs. Lists are
    compared block by block inside tasks: a pair belongs to the first prefix
    coordinate it shares, and only links that join components leave the task,
    so no pair is a row. Long lists are first compared with a few pivots;
    members that land in one component need no further comparison. Pairs of
    blocks are listed by number and then dealt out, each pair to a task of its
    own. No list is capped.
    """
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        signed, home, total = _classes_joined(rows, percent, True)
    least = home.groupBy("root").agg(F.min("low").alias("component"))
    home = home.join(least, "root").select("k1", "k2", "n_shingles", "rows", "component")
    out = join_keyed(signed.select("doc_id", "n_shingles", "k1", "k2"), home, ["k1", "k2", "n_shingles"], "rows", total)
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    return out.select("doc_id", "n_shingles", own).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _classes_joined(docs: DataFrame, percent: int, by_id: bool) -> tuple[DataFrame, DataFrame, int]:
    """Signed rows (doc_id, t, n_shingles, k1, k2, sig); classes (k1, k2, n_shingles, rows, low, root); rows with words.

    A class is a word sequence: its rows, its smallest id, and the root that
    all classes linked with it have. With ``by_id``, classes that share an id
    are linked, and rows without an id belong to none.
    """
    least = match_threshold(percent)
    key = ["k1", "k2", "n_shingles"]
    signed = cut(
        docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(_sign, "doc_id long, t long, n_shingles long, k1 long, k2 long, sig array<int>"), "signed"
    )
    full = signed.where("n_shingles > 0" + (" and doc_id is not null" if by_id else ""))
    # numbered once and for all, as the rows are written
    grouped = full.groupBy(key).agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("rows"), F.first("sig").alias("sig"))
    classes = cut(grouped.withColumn("id", F.monotonically_increasing_id()), "classes")
    total = classes.agg(F.sum("rows")).first()[0] or 0
    posts = classes.select("id", F.posexplode("sig").alias("c", "v"))
    shared = posts.groupBy("c", "v").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    # rarest first; a coordinate nobody shares is rarest of all and posts nothing
    mine = posts.join(shared, ["c", "v"]).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("f", "c", "v"))).alias("p"))
    mine = mine.where(F.size("p") >= least).withColumn("weight", F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["f"]))
    mine = cut(mine.select("id", "weight", F.slice("p", F.lit(1), F.size("p") - least + 1).alias("p")), "prefixes")
    prefix = mine.select("id", "weight", F.explode("p").alias("x")).select("id", "weight", "x.c", "x.v")
    bits = mine.select("id", F.expr("aggregate(p, 0L, (s, x) -> s | shiftleft(1L, x.c))").alias("mask"))
    reps = cut(classes.select("id", *key, "low", "sig").join(bits, "id"), "reps")
    # one text of each class that has a prefix: of equal rows any
    wanted = reps.select("id", *key, "low")
    of = full.join(F.broadcast(wanted) if is_small(wanted) else wanted, key).where("low <=> doc_id").groupBy("id", F.col("low").alias("doc_id")).agg(F.min("t").alias("t"))
    texts = docs.withColumn("t", F.xxhash64("text"))
    of = cut(of, "texts")
    small = is_small(of)
    found = texts.join(F.broadcast(of) if small else of, texts["t"].eqNullSafe(of["t"]) & texts["doc_id"].eqNullSafe(of["doc_id"])).select("id", "text")
    sets = cut(found.dropDuplicates(["id"]).mapInArrow(_sets, "id long, set binary"), "sets")
    lists = prefix.groupBy("c", "v").agg(F.count(F.lit(1)).alias("len"), F.max(F.struct("weight", "id")).alias("top")).where("len > 1")
    listed = prefix.join(lists.select("c", "v", F.ceil(F.col("len") / BLOCK).cast("int").alias("nb")), ["c", "v"])
    listed = cut(listed.join(reps.select("id", "n_shingles", "sig", "mask"), "id"), "listed")

    def blocks(rows: DataFrame, comp: DataFrame | None) -> DataFrame:
        rows = rows.join(comp, "id", "left") if comp is not None else rows.withColumn("comp", F.lit(None).cast("long"))
        member = F.struct("id", F.col("n_shingles").alias("n"), "mask", F.coalesce("comp", "id").alias("comp"), "sig")
        made = rows.withColumn("k", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")).groupBy("c", "v", "k")
        return made.agg(F.first("nb").alias("nb"), F.collect_list(member).alias("m"), F.min(F.coalesce("comp", "id")).alias("low"), F.max(F.coalesce("comp", "id")).alias("high"))

    found = []
    single = blocks(listed.where(F.col("nb") <= 1), None)
    found.append(_linked(single.select("c", "v", F.col("k").alias("xk"), F.col("k").alias("yk"), F.col("m").alias("x"), F.col("m").alias("y")), sets, percent, least))
    large = listed.where("nb > 1")
    if not large.isEmpty():
        if not listed.where(F.col("nb") > LONG).isEmpty():
            made = blocks(listed.where(F.col("nb") > LONG), None)
            # the members that share most with others: PIVOTS of each block, then of the list
            rank = "row_number() over (partition by c, v{} order by weight desc, id)"
            pivot = listed.where(F.col("nb") > LONG).withColumn("k", F.pmod(F.xxhash64("id"), F.col("nb"))).withColumn("r", F.expr(rank.format(", k"))).where(F.col("r") <= PIVOTS)
            pivot = pivot.withColumn("r", F.expr(rank.format(""))).where(F.col("r") <= PIVOTS)
            member = F.struct("id", F.col("n_shingles").alias("n"), "mask", F.col("id").alias("comp"), "sig")
            pivot = pivot.groupBy("c", "v").agg(F.collect_list(member).alias("y"))
            star = made.join(pivot, ["c", "v"]).select("c", "v", F.col("k").alias("xk"), F.lit(-1).alias("yk"), F.col("m").alias("x"), "y")
            found.append(_linked(star, sets, percent, least))
        union = found[0].unionAll(found[1]) if len(found) > 1 else found[0]
        comp = cut(connected_components(union, "a", "b").select("id", F.col("component").alias("comp")), "components")
        made = cut(blocks(large, comp), "blocks")
        # pairs of blocks by number, then each block to its pairs: a hot list spreads over its pairs
        x, y = (made.select("c", "v", *(F.col(f).alias(f"{s}{f}") for f in ("k", "low", "high"))) for s in "xy")
        apart = "not (xlow = xhigh and ylow = yhigh and xlow = ylow)"
        pairs = x.join(y, ["c", "v"]).where(f"xk <= yk and {apart}").select("c", "v", "xk", "yk")
        for s in "xy":
            pairs = pairs.join(made.select("c", "v", F.col("k").alias(f"{s}k"), F.col("m").alias(s)), ["c", "v", f"{s}k"])
        found.append(_linked(pairs, sets, percent, least))
        drop(made)
    union = found[0]
    for more in found[1:]:
        union = union.unionAll(more)
    if by_id:  # an id with several texts is one document
        own = full.select("doc_id", *key).distinct()
        many = own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("doc_id")
        own = own.join(many, "doc_id").join(classes.select(*key, "id"), key).select("doc_id", "id")
        first = own.groupBy("doc_id").agg(F.min("id").alias("a"))
        union = union.unionAll(own.join(first, "doc_id").where("a <> id").select("a", F.col("id").alias("b")))
    roots = cut(connected_components(union, "a", "b").select("id", F.col("component").alias("root")), "roots")
    for done in (mine, reps, of, sets, listed, *found):
        drop(done)
    home = classes.join(roots, "id", "left").select(*key, "rows", "low", F.coalesce("root", "id").alias("root"))
    return signed, home, total


def drop_near_copies(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each group of near copies, columns as they are.

    Rows are judged by their own text, also where ids repeat or are null: of a
    group the row with the smallest id stays (null last; then the smallest
    text hash), and of rows that agree in id and text one. Rows without words
    all stay, but for repeats in id and text. An empty table gives none.
    """
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        signed, home, total = _classes_joined(rows, percent, False)
    one = join_keyed(signed.select("doc_id", "t", "k1", "k2", "n_shingles"), home.select("k1", "k2", "n_shingles", "rows", "root"), ["k1", "k2", "n_shingles"], "rows", total)
    one = cut(one.groupBy("doc_id", "t", "root").agg(F.count(F.lit(1)).alias("times")), "judged")
    drop(signed)
    drop(home)
    first = one.where("root is not null").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("t").alias("text"))).alias("stays"), F.count(F.lit(1)).alias("size")
    )
    members = join_keyed(one, first, ["root"], "size", total)
    stays = F.col("root").isNull() | (F.col("doc_id").eqNullSafe(F.col("stays.id")) & F.col("t").eqNullSafe(F.col("stays.text")))
    marked = cut(members.select(F.col("doc_id").alias("id"), "t", stays.alias("stays"), "times").where("not stays or times > 1"), "marked")
    drop(one)

    whole = docs.select(packed(docs.columns).alias("row"), column(id_col).cast("long").alias("doc_id"), F.xxhash64(column(text_col)).alias("hash"))

    def beside(keys: DataFrame, how: str) -> DataFrame:
        keys = F.broadcast(keys) if is_small(keys) else keys
        return whole.join(keys, whole["doc_id"].eqNullSafe(keys["id"]) & whole["hash"].eqNullSafe(keys["t"]), how)

    left = beside(marked.select("id", "t"), "left_anti").select("row")
    twice = marked.where("stays").select("id", "t")
    if not twice.isEmpty():
        left = left.unionByName(beside(twice, "left_semi").groupBy("doc_id", "hash").agg(F.first("row").alias("row")).select("row"))
    return left.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
meets AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingle a JOIN shingle b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y FROM meets JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id, doc_id AS low FROM documents UNION SELECT y, low FROM reach JOIN link ON x = doc_id WHERE low < y),
least AS (SELECT doc_id, min(low) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN size USING (doc_id)
"""
