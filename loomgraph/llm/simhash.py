"""SimHash near-dedup by a byte-position inverted index with count filtering.

Fingerprints of 64 bits that differ in at most RADIUS = 4 bits differ in at
most 4 of their 8 bytes, so they share at least 8 - 4 = 4 positional bytes.
Distinct fingerprints are posted under the bytes they hold at given positions;
those that meet in a posting list tally the positional bytes they share, pairs
below the guaranteed number go, and the others are verified bit by bit.

Of four shared positions two lie in one of the groups (0 1 2), (3 4 5), (6 7),
so the 7 pairs of positions inside the groups find every link. A list longer
than BLOCK is posted again under two more of its six other positions (15
pairs: any two shared positions are one of them), so keys grow to four bytes
where lists are long. What is still too long, a cloud of fingerprints around
one text, is cut into blocks that meet block by block, by component. No list
is cut short, and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import column, small_batches
from loomgraph.llm.words import Words, slices
from loomgraph.operators.components import connected_components
from loomgraph.operators.skew import join_keyed
from loomgraph.store import cut, drop

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Positional bytes that two fingerprints within RADIUS share at least.
SHARED = 8 - RADIUS
PAIRS = [p for group in ((0, 1, 2), (3, 4, 5), (6, 7)) for p in combinations(group, 2)]
#: For each of PAIRS, the pairs among the other six positions.
MORE = [list(combinations([i for i in range(8) if i not in p], 2)) for p in PAIRS]
#: Fingerprints of a list that are compared in one go.
BLOCK = 1024
#: Pairs and shingles that are held at once.
STRIPE = 1 << 19
CHUNK = 1 << 17

_U = np.uint64
_LOW = _U(0x0101010101010101)


def fingerprints(w: Words) -> np.ndarray:
    """The SimHash (uint64) of each document: bit b is set if more than half of its shingles' hashes have it."""
    size = w.ends - w.starts
    begin = np.concatenate([[0], np.cumsum(size + 1)]).astype(np.int64)
    # the words joined by single blanks
    text = np.full(begin[-1], 32, np.uint8)
    at = np.arange(int(size.sum()))
    lead = np.repeat(np.cumsum(size) - size, size)
    text[at - lead + np.repeat(begin[:-1], size)] = w.data[at - lead + np.repeat(w.starts, size)]
    text = text.tobytes()
    runs = np.where(w.count > 0, np.maximum(w.count - SHINGLE + 1, 1), 0)
    firsts = np.concatenate([[0], np.cumsum(runs)]).astype(np.int64)
    doc = np.repeat(np.arange(len(runs)), runs)
    start = np.arange(len(doc)) - firsts[doc] + w.first[doc]
    last = np.minimum(start + SHINGLE, w.first[doc + 1]) - 1
    begins, ends = begin[start], begin[last] + size[last]
    votes = np.zeros((len(runs), 64), np.int64)
    hashed = xxhash.xxh64_intdigest
    for a in range(0, len(doc), CHUNK):
        b = min(a + CHUNK, len(doc))
        spans = zip(begins[a:b].tolist(), ends[a:b].tolist(), strict=True)
        h = np.fromiter((hashed(text[x:y], SEED) for x, y in spans), np.uint64, b - a)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        new = np.flatnonzero(np.concatenate([[True], doc[a + 1 : b] != doc[a : b - 1]]))
        votes[doc[a:b][new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    return np.packbits(2 * votes > runs[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            fp = fingerprints(Words(part.column(1), lower=True))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs share SHARED positional bytes and differ in at most RADIUS bits."""
    x = a ^ b
    y = x | (x >> _U(4))
    y |= y >> _U(2)
    y |= y >> _U(1)
    tally = 8 - np.bitwise_count(y & _LOW).astype(np.int8)
    kept = np.flatnonzero(tally >= SHARED)
    out = np.zeros(len(x), bool)
    out[kept] = np.bitwise_count(x[kept]) <= RADIUS
    return out


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the classes of i and j in place; ``root`` holds a class's least member."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j = i[apart], j[apart]
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root[:] = root[root]


def linked(group: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of links inside the runs of equal ``group``: members and their centres."""
    n = len(fp)
    root = np.arange(n)
    bounds = np.concatenate([np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), [n]]) if n else np.zeros(1, np.int64)
    end = np.repeat(bounds[1:], np.diff(bounds))
    # each member against those after it, a stripe of pairs at a time
    after = end - np.arange(n) - 1
    total = np.concatenate([[0], np.cumsum(after)])
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, total[at] + STRIPE, "right")) - 1)
        i = np.repeat(np.arange(at, to), after[at:to])
        j = np.arange(len(i)) - (total[i] - total[at]) + i + 1
        hit = near(fp[i], fp[j])
        _join(root, i[hit], j[hit])
        at = to
    member = np.flatnonzero(root != np.arange(n))
    return member, root[member]


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that span the components of each list; lists (key, x, y) come one after another."""
    held: list[np.ndarray] = [np.zeros(0, np.int64)] * 4

    def found(cols: list[np.ndarray]) -> pa.RecordBatch:
        new = np.zeros(len(cols[0]), bool)
        for c in cols[:3]:
            new[1:] |= c[1:] != c[:-1]
        member, centre = linked(np.cumsum(new), cols[3].view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(cols[3][member]), pa.array(cols[3][centre])], names=["a", "b"])

    for batch in batches:
        held = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True)]
        same = np.ones(len(held[0]), bool)
        for c in held[:3]:
            same &= c == c[-1:]
        whole = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # the last list may go on
        if whole:
            yield found([np.ascontiguousarray(c[:whole]) for c in held])
            held = [c[whole:] for c in held]
    if len(held[0]):
        yield found([np.ascontiguousarray(c) for c in held])


def _links(lists: DataFrame) -> DataFrame:
    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lists.select("key", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "fp").repartition(n, "key", "x", "y")
    return cut(dealt.sortWithinPartitions("key", "x", "y").mapInArrow(_link, "a long, b long"), "links")


def _byte(position: int) -> Column:
    return F.shiftrightunsigned("fp", 8 * position).bitwiseAND(255)


def _posts(pairs: list[tuple[int, int]], salt: int = 0) -> Column:
    """(key) of each pair of positions: its number, then the two bytes."""
    return F.array(*(F.lit((salt + t) << 32) + _byte(p) * 256 + _byte(q) for t, (p, q) in enumerate(pairs)))


def _sized(posts: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Posts in lists of at most BLOCK members but one at least; and those in longer lists, with their length n."""
    length = cut(posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("size", F.col("n")), "lengths")
    sized = cut(join_keyed(posts, length, ["key"], "size", total).where("n > 1"), "posts")
    drop(length)
    return sized.where(F.col("n") <= BLOCK), sized.where(F.col("n") > BLOCK)


def _block(n: Column) -> Column:
    return F.pmod(F.xxhash64("fp"), F.ceil(n / BLOCK))


def _clouds(long: DataFrame, links: list[DataFrame]) -> list[DataFrame]:
    """Links of lists of any length.

    Every block meets itself and the list's first block, which joins most of a
    cloud. Then members of large components form blocks of their own, and
    blocks meet all others but those of the same component.
    """
    flat = F.lit(0)
    own = long.withColumn("x", _block(F.col("n"))).withColumn("y", flat)
    first = own.where("x = 0").withColumn("x", F.explode(F.expr(f"sequence(1L, cast(ceil(n / {BLOCK}) as bigint) - 1)")))
    links = [*links, _links(own.unionByName(first))]
    so_far = links[0]
    for more in links[1:]:
        so_far = so_far.unionAll(more)
    comp = cut(connected_components(so_far, "a", "b").select(F.col("id").alias("fp"), "component"), "components")
    members = cut(long.join(comp, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "members")
    sizes = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
    groups = sizes.select("key", F.when(F.col("m") > BLOCK, F.col("component")).alias("component"), "m").groupBy("key", "component").agg(F.sum("m").alias("m"))
    # at most one row for each block of the list, and one for all small components
    order = Window.partitionBy("key").orderBy(F.col("component").asc_nulls_first())
    groups = groups.withColumn("blocks", F.ceil(F.col("m") / BLOCK)).withColumn("to", F.sum("blocks").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    groups = groups.withColumn("all", F.sum("blocks").over(Window.partitionBy("key"))).withColumn("members", F.sum("m").over(Window.partitionBy("key")))
    groups = cut(groups, "groups")
    total = members.count()
    large = groups.where("component is not null").select("key", "component", "m", "to", "blocks", "all", F.col("m").alias("size"))
    rest = groups.where("component is null").select("key", "m", "to", "blocks", "all", F.col("members").alias("size"))
    placed = join_keyed(members.select("key", "component", "fp"), large, ["key", "component"], "size", total)
    ours = placed.where("m is not null").withColumn("apart", F.lit(True))
    others = join_keyed(placed.where("m is null").select("key", "component", "fp"), rest, ["key"], "size", total).withColumn("apart", F.lit(False))
    dealt = ours.unionByName(others).withColumn("mine", F.col("to") - F.col("blocks") + _block(F.col("m")))
    partner = F.filter(F.sequence(F.lit(0).cast("long"), F.col("all") - 1), lambda j: ~F.col("apart") | (j < F.col("to") - F.col("blocks")) | (j >= F.col("to")))
    dealt = dealt.withColumn("partner", F.explode(partner)).select("key", F.least("mine", "partner").alias("x"), F.greatest("mine", "partner").alias("y"), "fp")
    links.append(_links(dealt))
    for done in (comp, members, groups):
        drop(done)
    return links


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``docs``.

    A-Z is lower-cased, words are runs of ``[^\\x20\\x09-\\x0D]``, and the
    shingles are all runs of four words joined by one space, repeats included;
    a text of one to three words is one shingle. A bit of the fingerprint is
    set if more than half of the shingles' XXH64 (seed 42) have it; a text
    without words (or null) has the fingerprint zero. Fingerprints that differ
    in at most 4 bits are linked, and component_id is the smallest id
    reachable. Rows that repeat an id are judged by their own texts; a null id
    reaches the ids of its component (null if there are none). An empty table
    gives no rows; ids are whole numbers; other columns are ignored. Long
    texts are read in one piece, memory following the text.

    Equal fingerprints are one class, so copies form no pairs. Tasks return
    spanning stars and no pairs.
    """
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        signed = cut(rows.mapInArrow(_sign, "doc_id long, fp long"), "fingerprints")
    classes = cut(signed.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("rows")), "classes")
    total, rows = classes.agg(F.count(F.lit(1)), F.sum("rows")).first()
    posts = classes.select("fp", F.explode(_posts(PAIRS)).alias("key"))
    short, long = _sized(posts, total * len(PAIRS))
    links = [_links(short.withColumn("x", F.lit(0)).withColumn("y", F.lit(0)))]
    if not long.isEmpty():
        table = F.shiftright("key", 32)
        again = F.coalesce(*(F.when(table == t, _posts(more, t * len(MORE[0]))) for t, more in enumerate(MORE)))
        # four bytes: the table of the first two and the next two, then both pairs of bytes
        second = long.withColumn("again", F.explode(again)).select(
            "fp", (F.shiftleft(F.shiftright("again", 32), 32) + F.shiftleft(F.col("key").bitwiseAND(0xFFFF), 16) + F.col("again").bitwiseAND(0xFFFF)).alias("key")
        )
        second = cut(second, "posts")
        short, cloud = _sized(second, second.count())
        links.append(_links(short.withColumn("x", F.lit(0)).withColumn("y", F.lit(0))))
        if not cloud.isEmpty():
            links = _clouds(cloud, links)
    union = links[0]
    for more in links[1:]:
        union = union.unionAll(more)
    roots = connected_components(union, "a", "b").select(F.col("id").alias("fp"), F.col("component").alias("root"))
    home = cut(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "homes")
    least = home.groupBy("root").agg(F.min("low").alias("component_id"))
    home = cut(home.join(least, "root").select("fp", "rows", "component_id"), "homes")
    out = join_keyed(signed, home, ["fp"], "rows", rows or 0)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
