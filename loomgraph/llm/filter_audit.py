"""Filter interaction audit: all orders of the filters, run as a trie of permutations.

An order of filters is a path of the trie; what is left after a prefix does
not depend on the prefix's order. The trie is walked depth first: each
unordered prefix is one survivor frame, kept while the walk is below it, made
from the frame above by applying one filter, and counted once at all its
edges (the removals of each filter that may come next). Later paths that reach
it find its counts.
"""

from __future__ import annotations

from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import column
from loomgraph.operators.skew import join_keyed
from loomgraph.store import cut

#: Filters by letter, and when a document (columns text, words, first) fails.
FILTERS = {
    "A": "size(words) < 100",
    "B": "100 * size(array_distinct(words)) < 80 * size(words)",
    "C": "100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(text)",
    "D": "text rlike '[#$%&*|]'",
    "E": "doc_id > first or (doc_id is null and first is not null)",
}


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One narrow row per row of ``docs``: part, a flag for each filter that it fails, good, toxic."""
    rows = docs.select(column(id_col).alias("doc_id"), F.coalesce(column(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    own = rows.withColumn("words", words).select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("h"), *(F.expr(rule).alias(f) for f, rule in FILTERS.items() if f != "E")
    )
    own = cut(own, "audit")
    # equal texts: 256-bit digests; a hot group meets its smallest id by a broadcast
    copies = cut(own.groupBy("h").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "audit-copies")
    met = join_keyed(own, copies, ["h"], "n", own.count()).withColumn("E", F.coalesce(F.expr(FILTERS["E"]), F.lit(False))).drop("h", "first")
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    found = met.join(marks, met["doc_id"] == marks["id"], "left")
    return found.select("part", *FILTERS, F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def walk(rows: DataFrame) -> DataFrame:
    """(part, state, filter, alive, removed, good_lost, toxic_lost): every edge of the trie.

    state: the letters of the filters already applied, in alphabetical order.
    A part that has nothing left in a state has no row there.
    """
    seen: dict[str, DataFrame] = {}
    # the same aggregates in every state, so their code is compiled once; a filter of the state removes nothing
    counts = [F.count(F.lit(1)).alias("alive")]
    for f in FILTERS:
        lost = (F.count_if(F.col(f) & F.col(c)).alias(f"{c}_lost") for c in ("good", "toxic"))
        counts.append(F.struct(F.lit(f).alias("filter"), F.count_if(f).alias("removed"), *lost).alias(f"edge{f}"))

    def visit(alive: DataFrame, state: str) -> None:
        if state in seen or len(state) == len(FILTERS):
            return
        kept = alive.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            rows = kept.groupBy("part").agg(*counts).select("part", F.lit(state).alias("state"), "alive", F.explode(F.array(*(f"edge{f}" for f in FILTERS))).alias("edge"))
            edges = [f for f in FILTERS if f not in state]
            seen[state] = cut(rows.select("part", "state", "alive", "edge.*").where(F.col("filter").isin(edges)), "audit-edges")
            for f in edges:
                visit(kept.where(~F.col(f)), "".join(sorted(state + f)))
        finally:
            kept.unpersist()

    visit(rows, "")
    out = None
    for edges in seen.values():
        out = edges if out is None else out.unionByName(edges)
    return out


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step: what the step's filter removes.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley (removals of the step's filter over all
    orders). Failure: A, under 100 words; B, distinct words under 80 %; C,
    capitals A-Z over 10 % of the code points; D, one of ``#$%&*|``; E, an
    equal text with a smaller id anywhere, removed or not.

    A null text is empty (it fails A alone, and E where it repeats); a null
    part is the empty string. A null id comes after every other, equal ids
    (repeated rows) are no reason to fail E. Ids of repeated label rows are
    good or toxic if one of the rows says so; labels of no document count for
    nothing. Very long texts are judged whole, in one row. An empty table gives
    no rows; other columns are ignored.
    """
    edges = cut(walk(cut(judged(docs, labels, id_col, text_col, part_col), "audit-rows")), "audit-edges")
    all_but = F.array_join(F.array_remove(F.array(*map(F.lit, FILTERS)), F.col("filter")), "")
    fails = edges.where("state = ''").select("part", "filter", F.col("removed").alias("fails"), F.col("alive").alias("docs"))
    unique = edges.where(F.col("state") == all_but).select("part", "filter", F.col("removed").alias("unique_fails"))
    orders = ["".join(p) for p in permutations(FILTERS)]
    # every part with every order and step, from the few rows of the parts
    step = F.posexplode(F.split("filter_order", "")).alias("step", "filter")
    plan = fails.select("part").distinct().withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).select("part", "filter_order", step)
    plan = plan.withColumn("state", F.array_join(F.array_sort(F.split(F.expr("substring(filter_order, 1, step)"), "")), ""))
    none = F.lit(0).cast("long")
    full = plan.join(edges, ["part", "state", "filter"], "left").join(fails, ["part", "filter"]).join(unique, ["part", "filter"], "left")
    full = cut(full.fillna(0, ["alive", "removed", "good_lost", "toxic_lost", "unique_fails"]), "audit-orders")
    shapley = full.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return full.join(shapley, ["part", "filter"]).select(
        "part", "filter_order", (F.col("step") + 1).cast("int").alias("step"), (F.col("alive") - F.col("removed")).alias("kept"), "removed",
        F.greatest(F.col("fails") - F.col("removed"), none).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley",
    )


ORACLE = r"""
WITH base AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text),
                regexp_matches(text, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY text)] AS fails,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM base LEFT JOIN marks USING (doc_id)),
kinds AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest(range(1, 6)) AS at),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.at, b.at, c.at, d.at, e.at] AS path
  FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.at, b.at, c.at, d.at, e.at])) = 5),
steps AS (SELECT filter_order, step, path[1:step - 1] AS before, path[step] AS own FROM orders, range(1, 6) s(step)),
seen AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS bad, len(list_filter(before, lambda i: fails[i])) = 0 AS alive,
         len(list_filter([1, 2, 3, 4, 5], lambda i: fails[i])) = 1 AS alone
  FROM kinds, steps),
counted AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (alive AND NOT bad), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (alive AND bad), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (bad AND NOT alive), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (bad AND alone), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (alive AND bad), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (alive AND bad), 0)::BIGINT AS toxic_lost
  FROM seen GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
"""
