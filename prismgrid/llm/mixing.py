"""Mixing sources to target weights by Pfair scheduling, with SQL expressions only.

Documents of a source are numbered and cut into blocks. Block j of a source with weight w
is released at slot floor(j / w) and due at slot ceil((j + 1) / w); at each slot the
released block that is due first runs. As the weights sum to one, every deadline is met, and
at every slot each source that has blocks left is within one block of its share (Baruah et
al., 1996). Weights are taken as they are. A source that has run out leaves its slots to the
others; when no block is released, the clock moves on to the next release.

The schedule runs from the first block to the last in frames of FRAME blocks: one pass over a
row of the sources keeps their states where frames begin, and frames then list their blocks
side by side, each with the number of documents before it. A step looks at every source with
blocks left.

Documents are numbered in parts: a hash of doc_id deals a source to as many parts as the
table's size asks for, so that no part follows the size of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismgrid.llm.common import saved

#: Documents in a block; documents of the table for each part that sources are numbered by, and parts at least.
BLOCK, PART, PARTS = 64, 1 << 18, 64
#: Blocks in a frame of the schedule (at least one a source); how near to a whole number a time is taken for it.
FRAME, NEAR = 1000, 1e-13


def _key(source: Column) -> Column:
    """A string for each source; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _parted(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, source, key, part and the columns to keep: sources in parts by a hash of doc_id, null ids in one of their own."""
    parts = max(PARTS, -(-docs.count() // PART))
    part = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") % parts
    return docs.select("doc_id", "source", *keep).withColumns({"key": _key(F.col("source")), "part": F.coalesce(part, F.lit(-1)).cast("int")})


def _sizes(rows: DataFrame) -> DataFrame:
    """key, part, n, offset (rows of the source in parts before), total (of the source): counted map-side, a few rows a source."""
    size = rows.groupBy("key", "part").agg(F.count("*").alias("n"))
    every = Window.partitionBy("key")
    before = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return size.select("key", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(every).alias("total"))


def _weights(n: DataFrame, weights: dict[str, float] | None, power: float) -> DataFrame:
    """The sources' sizes (key, n) with their weights w, which need not sum to one."""
    if weights is None:
        return n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(power)))
    cases = F.lit(0.0)
    for name, w in weights.items():
        cases = F.when(F.col("key") == _key(F.lit(name)), F.lit(float(w))).otherwise(cases)
    return n.withColumn("w", cases)


def _block(x: Column, i: Column, j: Column) -> Column:
    """Block j of source i with its times, null if there is none; x: the source's late, pace, blocks and n."""
    whole = lambda t: F.least(t, F.lit(1e18)).cast("long")
    release = whole(F.floor(j * x["pace"] * (1 + NEAR) + NEAR).cast("double"))
    due = whole(F.ceil((j + 1) * x["pace"] * (1 - NEAR) - NEAR).cast("double"))
    own = [x[c].alias(c) for c in ("pace", "blocks", "n")]
    return F.when(j < x["blocks"], F.struct(x["late"].alias("late"), release.alias("release"), due.alias("due"), i.alias("i"), j.alias("j"), *own))


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def _run(state: Column, steps: Column, block: int, listed: bool) -> Column:
    """The state after some steps; listed: the blocks that they run instead.

    The state is t (the clock), docs (how many have their places) and next (the sources' next blocks).
    """
    ran = F.array().cast("array<struct<slot:bigint,i:int,j:bigint,start:bigint>>")

    def step(acc: Column, _: Column) -> Column:
        def waiting(x: Column) -> Column:
            size = F.least(F.lit(block), x["n"] - x["j"] * block)
            return F.struct(x["late"].alias("late"), F.greatest(x["release"], acc["t"]).alias("slot"), x["due"].alias("due"), x["i"].alias("i"), x["j"].alias("j"), size.alias("size"))

        ready = F.transform(acc["next"], lambda x: F.when(x.isNotNull(), waiting(x)))

        def after(p: Column) -> Column:
            following = F.transform(acc["next"], lambda x: F.when(x["i"] == p["i"], _block(x, x["i"], x["j"] + 1)).otherwise(x))
            one = F.struct(p["slot"].alias("slot"), p["i"].alias("i"), p["j"].alias("j"), acc["docs"].alias("start"))
            out = [F.array_append(acc["ran"], one).alias("ran")] if listed else []
            return F.struct((p["slot"] + 1).alias("t"), (acc["docs"] + p["size"]).alias("docs"), following.alias("next"), *out)

        return _let(F.array_min(ready), after)

    start = F.struct(state["t"].alias("t"), state["docs"].alias("docs"), state["next"].alias("next"), *([ran.alias("ran")] if listed else []))
    end = lambda acc: F.struct(acc["t"].alias("t"), acc["docs"].alias("docs"), F.array_compact(acc["next"]).alias("next"))
    return F.aggregate(F.sequence(F.lit(1).cast("long"), steps), start, step, (lambda acc: acc["ran"]) if listed else end)


def schedule(sources: DataFrame, block: int = BLOCK, frame: int = FRAME) -> DataFrame:
    """key, block, slot, start: the slot of every block of each source (key, w, n) and the documents before it; earliest deadline first.

    Sources of no weight come after all others, in turn. The table of sources has a row a
    source; it becomes one row of arrays.
    """
    every = Window.partitionBy(F.lit(0))  # a row a source
    w = F.when(F.col("w") > 0, F.col("w")).otherwise(F.lit(0.0))
    late = (w == 0).cast("int")
    pace = F.when(w == 0, F.sum(late).over(every).cast("double")).otherwise(F.sum(w).over(every) / F.when(w > 0, w))
    n = F.col("n").cast("long")
    one = sources.where("n > 0").select("key", late.alias("late"), pace.alias("pace"), F.ceil(n / block).cast("long").alias("blocks"), n.alias("n"))
    one = one.agg(F.sort_array(F.collect_list(F.struct("key", "late", "pace", "blocks", "n"))).alias("s")).where("size(s) > 0")
    one = one.select("s", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["blocks"]).alias("total"), F.greatest(F.lit(frame), F.size("s")).cast("long").alias("frame"))
    first = F.transform("s", lambda x, i: _block(x, i, F.lit(0).cast("long")))
    begin = F.struct(F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("docs"), first.alias("next"))
    later = F.filter(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / F.col("frame"))), lambda k: k > 0)
    move = lambda acc, _: _let(_run(acc["now"], F.col("frame"), block, False), lambda now: F.struct(now.alias("now"), F.array_append(acc["all"], now).alias("all")))
    states = F.aggregate(later, F.struct(begin.alias("now"), F.array(begin).alias("all")), move, lambda acc: acc["all"])
    frames = one.select(F.col("s.key").alias("keys"), "total", "frame", F.posexplode(states).alias("turn", "state")).withColumn("turn", F.col("turn").cast("long")).repartition("turn")
    steps = F.least(F.col("frame"), F.col("total") - F.col("turn") * F.col("frame"))
    rows = frames.select("keys", F.explode(_run(F.col("state"), steps, block, True)).alias("b"))
    return rows.select(F.get("keys", F.col("b.i")).alias("key"), F.col("b.j").alias("block"), F.col("b.slot").alias("slot"), F.col("b.start").alias("start"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, block: int = BLOCK, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, block, slot, position (all from 0) and the columns to keep: the documents' places in the mixed order.

    weights: target weights by source; sources without one, or with zero, come last. None: in
    proportion to the number of documents to this power. A source's documents are in order of
    their part, then doc_id. Every row gets one place; places run from 0 without gaps. A null
    source is a source of its own; null ids come first in theirs, and rows with the same id in
    any order next to each other. Empty tables give no rows. Other columns are ignored; texts
    are not read, however long.
    """
    rows = _parted(docs, *keep)
    size = saved(_sizes(rows))
    counts = size.groupBy("key").agg(F.sum("n").alias("n"))
    blocks = saved(schedule(_weights(counts, weights, power), block))
    # a row for each part with the blocks that it reaches: documents are joined where they have been numbered
    last = F.floor((F.col("offset") + F.col("n") - 1) / block)
    reached = size.select("key", "part", F.explode(F.sequence(F.floor(F.col("offset") / block), last)).alias("block")).join(blocks, ["key", "block"])
    reached = reached.groupBy("key", "part").agg(F.sort_array(F.collect_list(F.struct("block", "slot", "start"))).alias("_b"))
    where = size.select("key", "part", "offset").join(reached, ["key", "part"])
    rows = rows.withColumn("nr", F.row_number().over(Window.partitionBy("key", "part").orderBy("doc_id")) - 1).join(where, ["key", "part"])
    rows = rows.withColumn("nr", F.col("nr") + F.col("offset")).withColumn("_at", F.get("_b", (F.floor(F.col("nr") / block) - F.get("_b", 0)["block"]).cast("int")))
    place = [F.col("_at.block").cast("long").alias("block"), F.col("_at.slot").cast("long").alias("slot"), (F.col("_at.start") + F.col("nr") % block).cast("long").alias("position")]
    return rows.select("doc_id", "source", *place, *keep)


def in_mixed_order(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, block: int = BLOCK) -> DataFrame:
    """All rows of docs with all its columns, whatever their names, sorted by their place in the mixed order.

    Nulls, ties, repeated rows and empty tables are as in mix(); very long texts move as they are.
    """
    packed = docs.select(F.col("doc_id"), F.col("source"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return mix(packed, weights, power, block, keep=("row",)).orderBy("position").select("row.*")


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    """The mixed order of all documents, with weights in proportion to the square roots of the sources' sizes."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"))


SQL = {
    "op1_mix_sources": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS key,
         coalesce(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % (SELECT greatest({PARTS}, (count(*) + {PART} - 1) // {PART}) FROM documents), -1) AS part
  FROM documents
), n AS (
  SELECT key, count(*) AS n FROM d GROUP BY key
), one AS (
  SELECT list(key ORDER BY key) AS keys, list((SELECT sum(sqrt(CAST(n AS DOUBLE))) FROM n) / sqrt(CAST(n AS DOUBLE)) ORDER BY key) AS pace, list((n + {BLOCK} - 1) // {BLOCK} ORDER BY key) AS blocks FROM n
), sim(turn, t, pick, j, slot, done) AS (
  SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), list_transform(keys, lambda k: CAST(0 AS BIGINT)) FROM one
  UNION ALL
  SELECT turn + 1, p.slot + 1, p.i, done[p.i], p.slot, list_transform(range(1, len(done) + 1), lambda i: done[i] + CASE WHEN i = p.i THEN 1 ELSE 0 END)
  FROM (
    SELECT turn, done, list_sort(list_transform(list_filter(range(1, len(done) + 1), lambda i: done[i] < blocks[i]), lambda i: struct_pack(
      slot := greatest(t, CAST(floor(done[i] * pace[i] * (1 + {NEAR}::DOUBLE) + {NEAR}::DOUBLE) AS BIGINT)),
      due := CAST(ceil((done[i] + 1) * pace[i] * (1 - {NEAR}::DOUBLE) - {NEAR}::DOUBLE) AS BIGINT), i := i)))[1] AS p
    FROM sim, one WHERE t IS NOT NULL
  ) WHERE p IS NOT NULL
), num AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY part, doc_id) - 1 AS nr FROM d
), placed AS (
  SELECT doc_id, source, nr // {BLOCK} AS block, slot, nr, turn FROM num JOIN (SELECT keys[pick] AS key, j, slot, turn FROM sim, one WHERE turn >= 0) AS plan ON plan.key = num.key AND plan.j = nr // {BLOCK}
)
SELECT doc_id, source, CAST(block AS BIGINT) AS block, CAST(slot AS BIGINT) AS slot,
       CAST(row_number() OVER (ORDER BY turn, nr) - 1 AS BIGINT) AS position
FROM placed
""",
}
