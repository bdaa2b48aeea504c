"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import column, packed
from loomgraph.store import cut

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Blocks into which a source's documents are permuted, at most.
BLOCKS = 1024


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def water_fill(sizes: np.ndarray, weights: np.ndarray, share: float = SHARE, most: float = MOST) -> np.ndarray:
    """Targets in proportion to the weights that sum to ``share`` of all sizes.

    A target above ``most`` times its size stops there; the excess is reshared
    by weight among the rest until none is above.
    """
    target = np.zeros(len(sizes))
    open_ = np.ones(len(sizes), bool)
    left = share * float(sizes.sum())
    while open_.any() and left > 0:
        trial = left * weights / weights[open_].sum()
        over = open_ & (trial > most * sizes)
        if not over.any():
            target[open_] = trial[open_]
            break
        target[over] = most * sizes[over]
        left -= float(target[over].sum())
        open_ &= ~over
    return target


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source for each shard: rows sum to near equal counts, columns to the quotas exactly.

    Each node deals its sources' quotas to two halves by a multivariate
    hypergeometric draw, so a shard is a uniform sample without replacement.
    """
    if shards == 1:
        return quotas[None, :].copy()
    left = shards // 2
    take = int(quotas.sum()) * left // shards
    part = np.zeros_like(quotas)
    rest, need = int(quotas.sum()), take
    for i, q in enumerate(quotas):  # the marginal method: one hypergeometric draw per source
        rest -= int(q)
        part[i] = rng.hypergeometric(int(q), rest, need) if q and need else 0
        need -= int(part[i])
    return np.vstack([split_tree(part, left, rng), split_tree(quotas - part, shards - left, rng)])


def fill(edge: DataFrame, gaps: dict[int, float]) -> DataFrame:
    """The rows of ``edge`` (_i, _fine, _order, size) that fill the gap of each source _i.

    In order of (_fine, _order) rows are taken while they fit; then, again and
    again, those among the rest that fit the gap left, up to the first that no
    longer does, or that one alone if it is larger than those before it. Either
    way the gap at least halves, and it ends smaller than any row left. At the
    end the smallest row left, or the first that did not fit in place of all
    after it, is taken where that misses by less. A step reads block sums, then
    one block of each source.
    """
    spark = edge.sparkSession
    lowest = (-1, 0)
    left = {i: (g, float("inf"), *lowest) for i, g in gaps.items()}  # gap, largest size that may be taken, place after which to look
    spans: dict[int, list[tuple]] = {i: [] for i in gaps}  # _i, place before, place after, limit, whether the first place alone
    first: dict[int, tuple] = {}
    gap = dict(gaps)
    place = "(_fine > _f0 or _fine = _f0 and _order > _o0)"
    while left:
        now = F.broadcast(spark.createDataFrame([(i, m, f, o) for i, (_, m, f, o) in left.items()], "_k int, _limit double, _f0 int, _o0 long"))
        fits = edge.join(now, F.col("_i") == F.col("_k")).where(f"size <= _limit and {place}")
        sums: dict[int, list] = {}
        for r in fits.groupBy("_i", "_fine").agg(F.sum("size").alias("w")).collect():
            sums.setdefault(r["_i"], []).append((r["_fine"], r["w"]))
        at, nxt = [], {}
        for i, (g, limit, f, o) in left.items():
            before = 0
            for block, w in sorted(sums.get(i, [])):
                if before + w > g:
                    at.append((i, block, g - before))
                    break
                before += w
            else:  # all that fit are taken
                spans[i].append((i, f, o, BLOCKS, 0, limit, False))
                gap[i] = g - before
        if not at:
            break
        blocks = F.broadcast(spark.createDataFrame(at, "_b int, _block int, _rest double"))
        one = fits.join(blocks, (F.col("_i") == F.col("_b")) & (F.col("_fine") == F.col("_block")))
        one = one.withColumn("_to", F.expr("sum(size) over (partition by _i order by _order rows unbounded preceding)"))
        ends = one.groupBy("_i", "_block", "_rest").agg(F.max(F.expr("if(_to <= _rest, _to, 0)")).alias("w"), F.min(F.expr("if(_to > _rest, struct(_order, size), null)")).alias("d"))
        for r in ends.collect():
            i, block, stop, size = r["_i"], r["_block"], r["d"]["_order"], r["d"]["size"]
            g, limit, f, o = left[i]
            taken = g - r["_rest"] + r["w"]
            if i in first and size > taken:
                spans[i].append((i, block, stop, block, stop, limit, True))
                gap[i] = g - size
                nxt[i] = (gap[i], gap[i], f, o)
                continue
            spans[i].append((i, f, o, block, stop, limit, False))
            gap[i] = g - taken
            if i not in first:
                first[i] = (size - gap[i], (i, block, stop, block, stop, float("inf"), True))
            nxt[i] = (gap[i], gap[i], block, stop)
        left = nxt

    def inside(how: str) -> DataFrame:
        rows = [x for some in spans.values() for x in some]
        these = F.broadcast(spark.createDataFrame(rows, "_k int, _f0 int, _o0 long, _f1 int, _o1 long, _limit double, _one boolean"))
        open_ = f"{place} and (_fine < _f1 or _fine = _f1 and _order < _o1)"
        return edge.join(these, (F.col("_i") == F.col("_k")) & F.expr(f"size <= _limit and if(_one, _fine = _f0 and _order = _o0, {open_})"), how)

    now = F.broadcast(spark.createDataFrame(list(gap.items()), "_g int, _gap double"))
    over = inside("left_anti").join(now, F.col("_i") == F.col("_g")).where("size - _gap < _gap")
    least = {r["_i"]: r["d"] for r in over.groupBy("_i").agg(F.min(F.struct("size", "_fine", "_order")).alias("d")).collect()}
    for i, g in gap.items():
        d = least.get(i)
        miss = min(g, d["size"] - g) if d else g
        if i in first and first[i][0] < miss:
            spans[i] = [spans[i][0], first[i][1]]
        elif d:
            spans[i].append((i, d["_fine"], d["_order"], d["_fine"], d["_order"], float("inf"), True))
    return inside("left_semi")


def deal(counts: np.ndarray, blocks: int, rng: np.random.Generator) -> np.ndarray:
    """The leaf of each of a source's block draws: draw k is of block k % ``blocks``.

    Draws are permuted; then draws of one block that met in one leaf change
    places with others until no block has two draws in a leaf, if there are
    leaves enough.
    """
    at = np.repeat(np.arange(len(counts)), counts)
    rng.shuffle(at)

    def clashes(k: int) -> bool:
        return any(0 <= x < len(at) and at[x] == at[k] for x in (k - blocks, k + blocks))

    for a in range(blocks, len(at)):
        for b in rng.integers(0, len(at), 200).tolist() if clashes(a) else ():
            at[a], at[b] = at[b], at[a]
            if not clashes(a) and not clashes(b):
                break
            at[a], at[b] = at[b], at[a]
    return at


def _drawn(docs: DataFrame, weights: tuple[float, ...], share: float, most: float, shards: int, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """row (all columns of ``docs`` as a struct), size, source_size, target, taken, shards, hash."""
    spark = docs.sparkSession
    sized = docs.select(
        packed(docs.columns).alias("row"), column(source_col).alias("source_"), word_count(column(text_col)).alias("size"),
        F.coalesce(F.xxhash64(F.lit(seed), column(id_col)), F.lit(0)).alias("_order"),
    )
    sized = sized.withColumn("_fine", F.pmod("_order", F.lit(BLOCKS)).cast("int"))
    keys = cut(sized.select(F.col("source_").alias("_source"), "size", "_fine", "_order"), "mix")
    per_block = keys.groupBy("_source", "_fine").agg(F.sum("size").alias("w")).collect()
    names = sorted({r["_source"] for r in per_block if r["_source"] is not None}) + [None] * any(r["_source"] is None for r in per_block)
    index = {s: i for i, s in enumerate(names)}
    fine = np.zeros((max(len(names), 1), BLOCKS), np.int64)
    for r in per_block:
        fine[index[r["_source"]], r["_fine"]] = r["w"]
    sizes = fine.sum(1)[: len(names)]
    wts = np.array([weights[i % len(weights)] for i in range(len(names))], float)
    targets = water_fill(sizes.astype(float), wts, share, most) if len(names) else np.zeros(0)
    # whole passes, whole blocks of the last pass, and what the cut block still gives
    plan, quotas = [], []
    for i, s in enumerate(names):
        passes = int(targets[i] // sizes[i]) if sizes[i] else 0
        rest = targets[i] - passes * int(sizes[i])
        ends = np.cumsum(fine[i])
        cut_at = int(np.searchsorted(ends, rest, "right")) if sizes[i] else BLOCKS
        cut_at = min(cut_at, BLOCKS)
        inside = rest - (int(ends[cut_at - 1]) if cut_at else 0)
        if passes >= most:  # a full second pass leaves nothing to cut
            cut_at, inside = 0, 0.0
        plan.append((s, int(sizes[i]), float(targets[i]), passes, cut_at, float(inside), i))
        quotas.append(passes * BLOCKS + min(cut_at + (inside > 0), BLOCKS) if sizes[i] else 0)
    schema = f"_s {docs.schema[source_col].dataType.simpleString()}, source_size long, target double, _passes int, _cut int, _inside double, _i int"
    plan_df = F.broadcast(spark.createDataFrame(plan, schema))  # a row per source
    joined = sized.join(plan_df, F.col("source_").eqNullSafe(F.col("_s"))).drop("_s")
    # numbers only: what the cut block and those after it hold
    edge = cut(
        keys.join(plan_df, F.col("_source").eqNullSafe(F.col("_s"))).where("_fine >= _cut and _inside > 0 and size > 0")
        .groupBy("_i", "_fine", "_order").agg(F.sum("size").alias("size")),
        "mix",
    )
    edge_in = fill(edge, {i: inside for *_, inside, i in plan if inside > 0}).select(F.col("_i").alias("_ei"), F.col("_order").alias("_eo"))
    # blocks of a source in its permuted order, dealt to the leaves of the tree
    leaves = split_tree(np.array(quotas or [0], np.int64), shards, np.random.default_rng(seed))
    dealt = []
    for i in range(len(names)):
        rng = np.random.default_rng([seed, i])
        at = deal(leaves[:, i], BLOCKS, rng)
        spare = rng.integers(0, shards, BLOCKS)  # for blocks of which only what fills the gap is taken
        for k in range(BLOCKS if len(at) else 0):
            got = at[k::BLOCKS].tolist()
            if plan[i][5] > 0 and len(got) == plan[i][3]:
                free = [x for x in range(shards) if x not in got] or [*range(shards)]
                got.append(free[int(spare[k]) % len(free)])
            dealt.append((i, k, got))
    deal_df = spark.createDataFrame(dealt, "_di int, _df int, _shards array<int>")
    found = joined.join(F.broadcast(deal_df), (F.col("_i") == F.col("_di")) & (F.col("_fine") == F.col("_df")), "left")
    out = found.join(edge_in, (F.col("_i") == F.col("_ei")) & (F.col("_order") == F.col("_eo")) & (F.col("_fine") >= F.col("_cut")), "left")
    copies = F.when(F.col("size") == 0, 0).otherwise(
        F.col("_passes") + F.when(F.col("_fine") < F.col("_cut"), 1).when(F.col("_eo").isNotNull(), 1).otherwise(0)
    )
    return out.select(
        "row", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"),
        F.slice(F.coalesce("_shards", F.array().cast("array<int>")), F.lit(1), copies).alias("shards"), F.col("_order").alias("hash"),
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    shards: int = 16,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The draws of the mix: every input column, size, source_size, target, taken, shards (array).

    Sources sorted by code point (null last) take the weights in turn. The
    documents of a source are permuted by hash into blocks. A source takes its
    blocks in that order, starting over at the end, until its target is
    reached; in the last block documents are taken in hash order while they
    fit, then those of all later blocks that fit the gap (see ``fill``).
    ``shards`` lists the output shard of each copy, by the splitting tree, two
    copies in different shards; an untaken document has none. Every document
    is drawn at most ceil(``most``) times. Rows with the same id are told
    apart by nothing: they share their block and are taken alike; null ids
    count as one id.

    Null or blank texts have size 0 and are never taken; a source of size 0
    has target 0; an empty table gives no rows; input columns named like those
    added are replaced, all others stay. A very long document is taken where
    that comes nearest to the target. Only per-source and per-block sums and a
    document a step reach the driver: at most BLOCKS rows a source at once;
    sources are taken for few (thousands).
    """
    own = ["size", "source_size", "target", "taken", "shards"]
    drawn = _drawn(docs, weights, share, most, shards, seed, id_col, text_col, source_col)
    return drawn.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in own), *own)


def mixture(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    shards: int = 16,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    partitions: int | None = None,
    with_shard: bool = True,
) -> DataFrame:
    """The mixed rows themselves: the columns of ``docs`` and (``with_shard``) mix_shard, each copy a row.

    Rows are dealt in ranges of (mix_shard, hash of seed, id and copy): a
    partition holds a stretch of one or more shards, sorted, so files written
    from it are shards shuffled inside. The copies of a document lie in
    different shards. Columns, nulls, repeats and empty tables as in ``mix``;
    an input column named mix_shard is replaced by the one added.
    """
    drawn = _drawn(docs, weights, share, most, shards, seed, id_col, text_col, source_col)
    rows = drawn.where("taken > 0").select("row", "hash", F.posexplode("shards").alias("copy", "mix_shard"))
    rows = rows.withColumn("place", F.xxhash64(F.lit(seed + 1), "hash", "copy")).drop("hash", "copy")
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "mix_shard", "place").sortWithinPartitions("mix_shard", "place")
    own = ["mix_shard"] if with_shard else []
    return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in own), *own)
