"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

Time runs in slots; a slot takes one block of rows of one source. With weight w (slots out of a period of H), block k
(from 0) of a source is released at floor(k/w) and due at ceil((k+1)/w). Serving the released block with the earliest
deadline keeps every source within less than one block of its share at every slot, and because weights are whole slots
out of H the schedule repeats each period: one period of H slots is worked out on a single row, and each row of the input
computes its own place from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name, write_table

#: Slots of a period for each source at least; epochs of a row that one task makes.
SLOTS, CHUNK = 4, 1024


def source_counts(df: DataFrame, source: str, parts: int, id_col: str) -> DataFrame:
    """(src, part, n): rows of each source by part of its ids."""
    return df.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("src"), part_of(id_col, parts).alias("part")).agg(F.count(F.lit(1)).alias("n"))


def part_of(id_col: str, parts: int):
    return F.coalesce(F.pmod(F.col(id_col).cast("long"), F.lit(parts)), F.lit(0)).cast("int")


def blended_slots(counts: DataFrame, period: int, natural: int, uniform: int) -> DataFrame:
    """(src, n, c, h): rows and slots a period of each source, for a target of ``natural`` parts the source's own share
    and ``uniform`` parts an equal share. Whole-number arithmetic; what rounding leaves goes to the largest remainders,
    then by name; each source has a slot at least. A period has ``SLOTS`` slots a source where that is more than ``period``."""
    one = W.partitionBy()  # over a row a source
    t = counts.groupBy("src").agg(F.sum("n").alias("n"))
    t = t.withColumns({"total": F.sum("n").over(one), "s": F.count(F.lit(1)).over(one)})
    t = t.withColumn("h", F.greatest(F.lit(period).cast("long"), F.col("s") * SLOTS))
    # share = (natural * n * s + uniform * total) / ((natural + uniform) * total * s), of the h - s slots beyond one each
    top = ((F.lit(natural) * F.col("n") * F.col("s") + F.lit(uniform) * F.col("total")).cast("decimal(38,0)")) * (F.col("h") - F.col("s"))
    bottom = (F.lit(natural + uniform) * F.col("total") * F.col("s")).cast("decimal(38,0)")
    t = t.withColumns({"top": top, "bottom": bottom})
    t = t.withColumn("c", F.expr("cast(top div bottom as bigint)")).withColumn("rest", F.expr("cast(top % bottom as decimal(38,0))"))
    t = t.withColumn("left", F.col("h") - F.col("s") - F.sum("c").over(one))
    t = t.withColumn("c", F.col("c") + 1 + F.when(F.row_number().over(one.orderBy(F.desc("rest"), "src")) <= F.col("left"), 1).otherwise(0))
    return t.select("src", "n", "c", "h")


def edf_period(slots: DataFrame) -> DataFrame:
    """(src, k, slot): which slot of a period takes block k of a source. Earliest deadline first among released blocks,
    ties by the source's name; the fold runs on one row that holds the weights of all sources."""
    row = slots.agg(F.sort_array(F.collect_list(F.struct("src", "c"))).alias("w"), F.max("h").alias("h"))
    # deadline of the next block of source i: ceil((done + 1) * h / c); released when floor(done * h / c) <= t
    fold = F.expr(
        """
        aggregate(
          sequence(0L, h - 1),
          named_struct('done', transform(w, x -> 0L), 'taken', cast(array() as array<int>)),
          (acc, t) -> transform(array(named_struct('acc', acc, 'i',
            array_min(filter(transform(w, (x, i) -> named_struct(
              'due', ((acc.done[i] + 1) * h + x.c - 1) div x.c, 'i', i, 'open', acc.done[i] < x.c AND (acc.done[i] * h) div x.c <= t)),
              y -> y.open)).i)),
            z -> named_struct(
              'done', transform(z.acc.done, (d, j) -> d + if(j = z.i, 1L, 0L)),
              'taken', concat(z.acc.taken, array(z.i))))[0],
          acc -> acc.taken)
        """
    )
    taken = row.filter(F.col("h").isNotNull()).select("w", F.posexplode(fold).alias("slot", "i"))
    taken = taken.select(F.expr("w[i].src").alias("src"), F.col("slot").cast("long").alias("slot"))
    return taken.withColumn("k", F.row_number().over(W.partitionBy("src").orderBy("slot")).cast("long") - 1)


def mix(
    docs: DataFrame, source: str = "source", id_col: str = "doc_id", block: int = 8, period: int = 1000, natural: int = 3, uniform: int = 1, parts: int = 4099, all_columns: bool = True
) -> DataFrame:
    """``docs`` mixed to target weights: rows with ``mix_position`` and ``mix_epoch``; sorted by position they interleave
    the sources in blocks of ``block`` rows, each source within less than one block of its weight at every point.

    No row is lost: the mix is as long as the source that its weight stretches furthest needs to appear in full once, and
    the others start over (``mix_epoch`` 1, 2, ...) to hold their weight until then. Rows of a source are taken in the order
    (id mod ``parts``, id); a null source is a source of its own named '', a null id counts as part 0 and comes first;
    rows alike keep places of their own. The schedule (``period`` rows, or ``SLOTS`` a source) and one row a source are
    broadcast; the table of sources times ``parts`` counts is joined where the rows lie for their ranks. ``parts`` is how many
    tasks can share one source's rows. Rows that come more than ``CHUNK`` times are dealt to many tasks for it. The schedule
    takes time by the square of the number of sources, which are meant to be corpora, not hosts. An empty table gives an
    empty result.
    """
    src, part, rank, before, k, n, c, h, goal, slot, last, chunk = free_name(docs, "src", "part", "rank", "before", "k", "n", "c", "h", "goal", "slot", "last", "chunk")
    counts = write_table(source_counts(docs, source, parts, id_col), "mix-counts")
    starts = counts.withColumn("before", F.sum("n").over(W.partitionBy("src").orderBy("part").rowsBetween(W.unboundedPreceding, -1))).select(
        F.col("src").alias(src), F.col("part").alias(part), F.coalesce("before", F.lit(0)).alias(before)
    )
    slots = blended_slots(counts, period, natural, uniform)
    # a source of weight c/h is through after n * h / c rows of the mix; the last of them ends it
    slots = write_table(slots.withColumn("longest", F.max(F.expr("cast(ceil(cast(n as decimal(38,0)) * h / c) as bigint)")).over(W.partitionBy())), "mix-slots")
    goals = slots.select(F.col("src").alias(src), F.col("n").alias(n), F.col("c").alias(c), F.col("h").alias(h), F.greatest(F.col("n"), F.expr("cast(cast(longest as decimal(38,0)) * c div h as bigint)")).alias(goal))
    plan = edf_period(slots).select(F.col("src").alias(src), F.col("k").alias(k), F.col("slot").alias(slot))

    held = docs if all_columns else docs.select(id_col, source)
    held = held.drop("mix_position", "mix_epoch").withColumns({src: F.coalesce(F.col(source).cast("string"), F.lit("")), part: part_of(id_col, parts)})
    names = held.columns

    def ranked(some: DataFrame) -> DataFrame:
        """Rows of some sources with their rank and how often they come."""
        rows = held.join(F.broadcast(some), src)
        rows = rows.withColumn(rank, F.row_number().over(W.partitionBy(src, part).orderBy(F.col(id_col))) - 1)
        rows = rows.join(starts.hint("merge"), [src, part])  # the window has dealt by the same keys: only starts move
        return rows.withColumn(rank, F.col(rank) + F.col(before)).withColumn(last, F.expr(f"(`{goal}` - 1 - `{rank}`) div `{n}`"))

    # row `rank` of a source comes again every n rows of it until the source has had its goal
    often = F.col(goal) > F.col(n) * CHUNK
    if goals.filter(often).isEmpty():
        held = ranked(goals).withColumn("mix_epoch", F.explode(F.expr(f"sequence(0L, `{last}`)")))
    else:
        few = ranked(goals.filter(~often)).withColumn("mix_epoch", F.explode(F.expr(f"sequence(0L, `{last}`)")))
        many = ranked(goals.filter(often)).withColumn(chunk, F.explode(F.expr(f"sequence(0L, `{last}` div {CHUNK})"))).repartition(src, rank, chunk)
        many = many.withColumn("mix_epoch", F.explode(F.expr(f"sequence(`{chunk}` * {CHUNK}, least(`{last}`, `{chunk}` * {CHUNK} + {CHUNK - 1}))"))).drop(chunk)
        held = few.unionByName(many)
    held = held.withColumn(rank, F.col(rank) + F.col("mix_epoch") * F.col(n))
    held = held.withColumn(k, F.expr(f"(`{rank}` div {block}) % `{c}`")).join(F.broadcast(plan), [src, k])
    position = F.expr(f"((`{rank}` div {block}) div `{c}` * `{h}` + `{slot}`) * {block} + `{rank}` % {block}")
    return held.select(*[F.col(x) for x in names if x not in (src, part)], position.alias("mix_position"), F.col("mix_epoch"))


#: DuckDB SQL for mix() over a view {docs} with columns doc_id and source, with its default parameters.
MIX_SQL = """
WITH RECURSIVE base AS (SELECT *, coalesce(source, '') AS src FROM {docs}),
cnt AS (SELECT src, count(*) AS n FROM base GROUP BY src),
tot AS (SELECT sum(n)::BIGINT AS total, count(*)::BIGINT AS s, greatest({period}, count(*) * 4)::BIGINT AS h FROM cnt),
shr AS (SELECT src, n, total, s, h, (({natural} * n * s + {uniform} * total)::HUGEINT * (h - s)) AS top,
               (({natural} + {uniform}) * total * s)::HUGEINT AS bottom FROM cnt, tot),
flo AS (SELECT *, (top // bottom)::BIGINT AS c0, top % bottom AS rest FROM shr),
slo AS (SELECT src, n, h, c0 + 1 + CASE WHEN row_number() OVER (ORDER BY rest DESC, src) <= h - s - sum(c0) OVER () THEN 1 ELSE 0 END AS c FROM flo),
lon AS (SELECT *, max(((n::HUGEINT * h + c - 1) // c)::BIGINT) OVER () AS longest FROM slo),
goa AS (SELECT src, n, h::BIGINT AS h, c::BIGINT AS c, greatest(n, (longest::HUGEINT * c // h)::BIGINT) AS goal FROM lon),
lst AS (SELECT list(c ORDER BY src) AS cs, list(src ORDER BY src) AS ss, max(h) AS h FROM goa),
sim AS (
  SELECT 0::BIGINT AS t, list_transform(cs, lambda x: 0::BIGINT) AS done, NULL::BIGINT AS i FROM lst
  UNION ALL
  SELECT t + 1, list_transform(range(1, len(done) + 1), lambda j: done[j] + CASE WHEN j = b THEN 1 ELSE 0 END), b
  FROM (SELECT sim.t, sim.done, list_min(list_filter(list_transform(range(1, len(sim.done) + 1), lambda j:
          CASE WHEN sim.done[j] < lst.cs[j] AND (sim.done[j] * lst.h) // lst.cs[j] <= sim.t
               THEN (((sim.done[j] + 1) * lst.h + lst.cs[j] - 1) // lst.cs[j]) * 100000 + j END), lambda v: v IS NOT NULL)) % 100000 AS b
        FROM sim, lst WHERE sim.t < lst.h) AS step
),
pla AS (SELECT ss[i] AS src, t - 1 AS slot, row_number() OVER (PARTITION BY i ORDER BY t) - 1 AS k FROM sim, lst WHERE i IS NOT NULL),
rnk AS (SELECT base.*, row_number() OVER (PARTITION BY src ORDER BY coalesce(doc_id % {parts}, 0), doc_id NULLS FIRST) - 1 AS rank FROM base),
rep AS (SELECT rnk.*, goa.n, goa.c, goa.h, unnest(range(0, (goa.goal - 1 - rank) // goa.n + 1)) AS epoch FROM rnk JOIN goa USING (src)),
pos AS (SELECT *, rank + epoch * n AS r FROM rep)
SELECT {columns}, ((r // {block}) // c * pos.h + slot) * {block} + r % {block} AS mix_position, epoch AS mix_epoch
FROM pos JOIN pla ON pla.src = pos.src AND pla.k = (r // {block}) % c
"""


def mix_sql(docs: str = "documents", columns: str = "doc_id, source", block: int = 8, period: int = 1000, natural: int = 3, uniform: int = 1, parts: int = 4099) -> str:
    return MIX_SQL.format(docs=docs, columns=columns, block=block, period=period, natural=natural, uniform=uniform, parts=parts)
