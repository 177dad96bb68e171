"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only.

Targets share the budget by weight; none exceeds `epochs` times its source, and the excess goes to the rest by
weight (water filling, in closed form over sources ordered by cap / weight).  Documents are shuffled by a hash of
doc_id and text.  A document's virtual finish time is the cumulative size of its source up to and with it, divided by the
source's target; its second copy comes one whole source later.  Copies are taken in the order of these times until
the budget is reached.  Only the time at which that happens is needed, and it is found through histograms
of the times, each refining one bucket of the last, so no task sorts more than a sliver of the copies.

The cumulative sizes are taken within (source, range of hashes) and shifted by the sums of smaller ranges, so a source
that holds any share of all rows is spread over the ranges, whose number grows with the square root of the rows.  Rows
that share one hash in great number (equal in doc_id and text, so of one size) are dealt to ranges of their own.

Cases: null text has size 0; such documents are taken 0 words.  A null source is a source, ordered last.  A null
doc_id is as the empty one, and told from others by its text.  Repeated rows count as rows of their own; which of rows
equal in doc_id and text is taken oftener is open, how many is not.  Copies whose times tie at the limit are taken together
or not at all.  No words at all: all targets are 0.  An empty table gives an empty result.  Other columns are carried
along by `mix`, whatever their names: the added ones begin with `_w_`, or with as many more underscores as no column
of the input begins with.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.shared import free, table

WEIGHTS, EPOCHS, SHARE, FINE = (5, 2, 1), 2, (3, 2), 4096
#: Rows of one hash that are never dealt apart, and the ranges that more of them are dealt to.
LEAST, SHARES = 200, 512
WORD = r"[^\x20\x09-\x0D]+"


def _hash(seed: str):
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))


def targets(by_source: DataFrame, weights=WEIGHTS, share=SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size -> and target.  One row a source; a window over all of them is of their number."""
    everything = Window.partitionBy(F.lit(1))
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("source").isNull(), F.col("source"))
    t = by_source.withColumn("_w_place", F.row_number().over(order) - 1)
    t = t.withColumn("_w_weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_w_place"), F.lit(len(weights))) + 1).cast("int")).cast("long"))
    t = t.withColumn("_w_cap", F.col("source_size") * epochs).withColumn("_w_all", F.sum("source_size").over(everything))
    fill = Window.partitionBy(F.lit(1)).orderBy(F.col("_w_cap") / F.col("_w_weight"), "_w_place")
    capped = F.sum("_w_cap").over(fill) - F.col("_w_cap")
    weight = F.sum("_w_weight").over(everything) - F.sum("_w_weight").over(fill) + F.col("_w_weight")
    t = t.withColumn("_w_top", F.col("_w_all") * share[0] - capped * share[1]).withColumn("_w_low", weight * share[1])
    # A source is capped if the level that it and all later ones would share is no less than its own cap / weight.
    t = t.withColumn("_w_full", F.col("_w_weight") * F.col("_w_top") >= F.col("_w_cap") * F.col("_w_low"))
    first = F.when(~F.col("_w_full"), F.struct(F.lit(True), F.col("_w_cap") / F.col("_w_weight"), "_w_place", F.col("_w_top").alias("top"), F.col("_w_low").alias("low")))
    t = t.withColumn("_w_level", F.min(first).over(everything))
    target = F.when(F.col("_w_full") | F.col("_w_level").isNull(), F.col("_w_cap").cast("double")).otherwise((F.col("_w_weight") * F.col("_w_level.top")).cast("double") / F.col("_w_level.low").cast("double"))
    return t.select("source", "source_size", target.alias("target"), "_w_all")


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, epochs: int = EPOCHS, seed: str = "mix", keep: list[str] | None = None) -> DataFrame:
    """docs' columns and _w_size, _w_source_size, _w_target, _w_copies (0 to epochs).

    keep: the columns to carry (all).  Sizes and order are materialised without the texts if they are not kept.
    """
    keep = docs.columns if keep is None else keep
    w = free("_w_", docs.columns)
    size, hashed, deal, part, cum, times = (w + x for x in ("size", "hash", "deal", "part", "cum", "times"))
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(*keep, F.col("source").alias(w + "source"), words.alias(size), _hash(seed).alias(hashed), F.xxhash64(F.monotonically_increasing_id()).alias(deal))
    rows = table(rows, "sized")
    rows = rows.withColumn(part, _ranges(rows.select(F.col(hashed).alias("h"), F.col(deal).alias("deal")))(F.col(hashed), F.col(deal)))
    by_part = table(rows.groupBy(F.col(w + "source").alias("source"), F.col(part).alias("part")).agg(F.sum(size).alias("n")), "parts")
    goals = targets(by_part.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, epochs)
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")
    shifts = by_part.select("source", "part", before.alias("before"))
    shifts = shifts.join(goals, shifts.source.eqNullSafe(goals.source)).select(shifts.source.alias(w + "s"), F.col("part").alias(w + "p"), F.col("before").alias(w + "before"), F.col("source_size").alias(w + "source_size"), F.col("target").alias(w + "target"))
    shifts = table(shifts, "shifts")
    within = Window.partitionBy(w + "source", part).orderBy(hashed, deal).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn(cum, F.sum(size).over(within))
    placed = placed.join(shifts, F.col(w + "source").eqNullSafe(F.col(w + "s")) & (F.col(part) == F.col(w + "p"))).withColumn(cum, F.col(cum) + F.col(w + "before"))
    time = lambda e: (F.col(cum) + F.col(w + "source_size") * e).cast("double") / F.col(w + "target")
    placed = placed.withColumn(times, F.when(F.col(size) > 0, F.array(*(time(e) for e in range(epochs)))).otherwise(F.array().cast("array<double>")))
    timed = table(placed.select(*keep, size, w + "source_size", w + "target", times), "timed")
    limit = _limit(timed.select(F.col(size).alias("n"), F.explode(times).alias("t")), by_part.agg(F.sum("n")).first()[0] or 0, share)
    copies = F.size(F.filter(times, lambda t: t <= F.lit(limit)))
    return timed.select(*keep, size, w + "source_size", w + "target", copies.cast("long").alias(w + "copies"))


def _ranges(rows: DataFrame):
    """(hash, deal) -> name of its range; ranges are ordered by name as hashes are.  rows: h, deal.

    A range is a prefix of the hash, as long as makes about as many ranges as each has rows.  Where a hash repeats so
    often that its range stands out, it becomes several ranges, and what follows it in its prefix another.
    """
    n = rows.count()
    digits = max(3, math.ceil(math.log(max(n, 2), 256)))
    much = max(LEAST, 8 * n // 4096)
    prefix = F.substring("h", 1, digits)
    full = [r[0] for r in rows.groupBy(prefix.alias("p")).count().where(F.col("count") > much).select("p").collect()]  # 512 at most
    heavy = sorted(r[0] for r in rows.where(prefix.isin(full)).groupBy("h").count().where(F.col("count") > much).select("h").collect()) if full else []
    if not heavy:
        return lambda h, deal: F.substring(h, 1, digits)
    by_prefix = {}
    for h in heavy:
        by_prefix.setdefault(h[:digits], []).append(h)
    held = F.create_map(*(c for p, hs in by_prefix.items() for c in (F.lit(p), F.array(*map(F.lit, hs)))))

    def name(h, deal):
        mine = F.try_element_at(held, F.substring(h, 1, digits))
        dealt = F.concat(h, F.lit("/"), F.lpad(F.pmod(deal, F.lit(SHARES)).cast("string"), 4, "0"))
        after = F.concat(F.array_max(F.filter(mine, lambda x: x < h)), F.lit("~"))
        return F.when(F.array_contains(mine, h), dealt).otherwise(F.coalesce(after, F.substring(h, 1, digits)))

    return name


def repeat(docs: DataFrame, weights=WEIGHTS, share=SHARE, epochs: int = EPOCHS, seed: str = "mix") -> DataFrame:
    """docs, each row as often as the mix takes it.

    A source's copies of one epoch are taken in the order of the hashes up to some document, so two bounds a source
    decide each row where it stands, and texts are not moved.  Rows that are equal in doc_id and text are taken alike.
    """
    w = free("_w_", docs.columns)
    few = docs.select("doc_id", "text", "source")
    mixed = mix(few.withColumn("h", _hash(seed)), weights, share, epochs, seed, keep=["h", "source"])
    bounds = mixed.groupBy(F.col("source").alias(w + "source")).agg(*(F.max(F.when(F.col("_w_copies") > e, F.col("h"))).alias(f"{w}upto{e}") for e in range(epochs)))
    rows = docs.join(table(bounds, "bounds"), docs["source"].eqNullSafe(F.col(w + "source")), "left")
    copies = sum(((F.coalesce(_hash(seed) <= F.col(f"{w}upto{e}"), F.lit(False))).cast("int") for e in range(epochs)), F.lit(0))
    copies = F.when(F.col("text").rlike(WORD), copies).otherwise(0)
    return rows.withColumn(w + "each", F.explode(F.array_repeat(F.lit(1), copies))).select(*docs.columns)


def _limit(entries: DataFrame, words: int, share) -> float:
    """The latest finish time up to which the copies fit the budget."""
    low, width, taken, limit = 0.0, 2.0 / FINE, 0, -1.0
    for _ in range(2):
        place = F.least(F.floor((F.col("t") - F.lit(low)) / F.lit(width)), F.lit(FINE)).cast("int")
        sums = sorted(tuple(r) for r in entries.where(F.col("t") >= low).groupBy(place.alias("at")).agg(F.sum("n"), F.max("t"), F.min("t")).collect())  # FINE + 1 rows at most
        nxt = None
        for at, size, last, first in sums:
            if (taken + size) * share[1] > words * share[0]:
                nxt = (at, first)
                break
            taken, limit = taken + size, last
        if nxt is None:
            return limit
        low, width = nxt[1], width / FINE
        entries = entries.where((F.col("t") > limit) & (place == nxt[0]))
    total = Window.partitionBy(F.lit(1)).orderBy("t")
    fits = entries.groupBy("t").agg(F.sum("n").alias("n")).withColumn("n", F.sum("n").over(total)).where((F.col("n") + taken) * share[1] <= words * share[0])
    last = fits.agg(F.max("t")).first()[0]
    return limit if last is None else last


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    mixed = mix(docs, keep=["doc_id", "source"])
    return mixed.select("doc_id", F.col("_w_size").alias("size"), F.col("_w_source_size").alias("source_size"), F.col("_w_target").alias("target"), (F.col("_w_size") * F.col("_w_copies")).alias("taken"))


#: The same in SQL: sizes, water filling, shuffle by md5 and the cut at the budget, each in one window.
OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
             md5(concat_ws('|', 'mix', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2 AS cap,
        sum(source_size) OVER () AS total FROM s),
f AS (SELECT *, total * 3 - (sum(cap) OVER o - cap) * 2 AS top, (sum(weight) OVER () - sum(weight) OVER o + weight) * 2 AS low
      FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, place ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, weight * top >= cap * low AS filled FROM f),
v AS (SELECT top AS ltop, low AS llow FROM l WHERE NOT filled ORDER BY CAST(cap AS DOUBLE) / weight, place LIMIT 1),
t AS (SELECT source, source_size, total, CASE WHEN filled OR ltop IS NULL THEN CAST(cap AS DOUBLE)
        ELSE CAST(weight * ltop AS DOUBLE) / CAST(llow AS DOUBLE) END AS target FROM l LEFT JOIN v ON true),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.total,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id ROWS UNBOUNDED PRECEDING) AS cum
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT size, CAST(cum AS DOUBLE) / target AS vt, total FROM c WHERE size > 0
      UNION ALL SELECT size, CAST(cum + source_size AS DOUBLE) / target, total FROM c WHERE size > 0),
g AS (SELECT vt, any_value(total) AS total, sum(sum(size)) OVER (ORDER BY vt) AS upto FROM e GROUP BY vt),
m AS (SELECT coalesce(max(vt), -1) AS cutoff FROM g WHERE upto * 2 <= total * 3)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE size * ((CAST(cum AS DOUBLE) / target <= cutoff)::INT
            + (CAST(cum + source_size AS DOUBLE) / target <= cutoff)::INT) END AS BIGINT) AS taken
FROM c, m
"""
