r"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame operations only.

Each source's target share of all words is found by filling up to a cap of three times its size. Its documents are
permuted by a seeded digest and dealt into blocks. A source takes whole passes over its blocks and, for the rest, blocks
in permuted order until the target is met; the last block is taken up to the exact word. The units (block, pass) that a
source gives are split among output shards by a binary tree: at each node the left half receives a multivariate
hypergeometric draw of the node's units, so that every shard gets exact, random quotas and all units are used once.
Shards then take disjoint runs of permuted units and order them by a digest of their own.

Many sources are drawn for in groups: a node's draw is made for groups first, then within each group, which is the same
distribution, so no row holds more than WIDTH sources or all groups. Word counts are written once and read by all steps.

Defined cases: a null text has size 0; a null source is a source of its own and stands last; repeated rows count as
documents of their own, with equal fate but in the one block that a source takes in part; sources of size 0 get target 0;
an empty table gives an empty result; columns other than doc_id, source and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

WEIGHTS = (5, 2, 1)
CAP = 3
#: Blocks of a source and output shards; both powers of two.
BLOCKS, SHARDS = 256, 8
#: Sources whose units stand in one row of the splitting tree.
WIDTH = 1024


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size in words, draw (the document's place in its source's permutation), block and sub (part of a block)."""
    text = F.coalesce("text", F.lit(""))
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return docs.select("doc_id", "source", F.regexp_count(text, F.lit(common.WORD)).cast("long").alias("size"), draw.alias("draw")).withColumn("block", F.conv(F.substring("draw", 1, 2), 16, 10).cast("int")).withColumn("sub", F.substring("draw", 3, 3))


def targets(sources: DataFrame) -> DataFrame:
    """source, source_size, target: weights by code point, shares of the total, none above CAP times its size.

    With sources in the order of cap over weight, those before some place are at their cap and the rest share what is
    left by weight; the first place where that share is under its own cap is the right one."""
    everything = W.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1)
    weighed = sources.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * CAP)
    by_level = everything.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = by_level.rowsBetween(W.unboundedPreceding, -1), by_level.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    levels = weighed.withColumn("level", level.cast("double"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    final = levels.withColumn("level", F.first(fits, ignorenulls=True).over(by_level.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return final.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _blocks(docs: DataFrame, goals: DataFrame, seed: int) -> DataFrame:
    """A row per source and block: its words, its rank in the source's block permutation, the words before it, and
    passes, rest: whole passes and the words that the source takes beyond them."""
    sums = docs.groupBy("source", "block").agg(F.sum("size").alias("words"))
    turn = F.md5(F.concat_ws(":", F.lit(seed), "source", "block"))
    order = W.partitionBy("source").orderBy(turn, "block")
    ranked = sums.withColumn("rank", F.row_number().over(order)).withColumn("before", F.sum("words").over(order) - F.col("words"))
    goal = goals.withColumn("wanted", F.round("target").cast("long")).withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("wanted") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", F.col("wanted") - F.col("passes") * F.col("source_size"))
    goal = goal.withColumnRenamed("source", "goal_source")
    return ranked.join(goal, ranked["source"].eqNullSafe(goal["goal_source"])).drop("goal_source")


def _placed(plan: DataFrame, shards: int, seed: int) -> DataFrame:
    """plan with `units`: for each pass in which its block is drawn, the pass and the output shard.

    A source's units are ordered by pass and block rank; the splitting tree says how many of them each shard gets, and the
    shards take them in disjoint runs. Every table here has at most BLOCKS * (CAP + 1) rows a source."""
    passes = F.when(F.col("rest") > F.col("before"), F.col("passes") + 1).otherwise(F.col("passes"))
    units = plan.where(passes > 0).select("source", "block", "rank", F.explode(F.sequence(F.lit(1).cast("long"), passes)).alias("pass"))
    number = W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    quotas = units.groupBy("source").agg(F.count("*").alias("units")).withColumn("source_no", F.row_number().over(number) - 1)
    upto = W.partitionBy("source_no").orderBy("shard")
    runs = split_quotas(quotas.select("source_no", "units"), shards, seed).withColumn("stop", F.sum("units").over(upto))
    runs = runs.select("source_no", "shard", (F.col("stop") - F.col("units")).alias("start"), "stop")
    order = W.partitionBy("source").orderBy("pass", "rank")
    named = quotas.select("source_no", F.col("source").alias("of"))
    placed = units.withColumn("unit", F.row_number().over(order) - 1)
    placed = placed.join(named, placed["source"].eqNullSafe(named["of"])).join(runs, "source_no").where("unit >= start and unit < stop")
    placed = placed.groupBy(F.col("source").alias("of"), F.col("block").alias("of_block")).agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("units"))
    joined = plan.join(placed, plan["source"].eqNullSafe(placed["of"]) & (plan["block"] == placed["of_block"]), "left").drop("of", "of_block")
    return joined.withColumn("units", F.coalesce("units", F.array().cast("array<struct<pass:bigint,shard:bigint>>")))


def _more(part: DataFrame) -> DataFrame:
    """Adds `more`: the words taken of each document of the blocks in which a source's words run out, in permuted order.
    Only the part of such a block in which they run out is ordered."""
    sums = part.groupBy("source", "block", "sub").agg(F.sum("size").alias("sub_words"))
    order = W.partitionBy("source", "block").orderBy("sub").rowsBetween(W.unboundedPreceding, -1)
    subs = sums.withColumn("sub_before", F.coalesce(F.sum("sub_words").over(order), F.lit(0)))
    subs = subs.select(F.col("source").alias("s"), F.col("block").alias("b"), F.col("sub").alias("u"), "sub_words", "sub_before")
    joined = part.join(subs, part["source"].eqNullSafe(subs["s"]) & (part["block"] == subs["b"]) & (part["sub"] == subs["u"])).drop("s", "b", "u")
    left = F.col("extra") - F.col("sub_before")
    clear = (left <= 0) | (left >= F.col("sub_words"))
    known = joined.where(clear).withColumn("more", F.when(left > 0, F.col("size")).otherwise(0))
    within = W.partitionBy("source", "block", "sub").orderBy("draw", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(within), F.lit(0))
    return known.unionByName(joined.where(~clear).withColumn("more", F.greatest(F.lit(0), F.least("size", left - before))))


def mix(docs: DataFrame, seed: int = 17, shards: int = SHARDS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted), draw, parts (for each
    pass that takes words of the document: shard and words)."""
    own = common.settled(sized(docs, seed), "sizes")
    sums = own.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = _placed(common.settled(_blocks(own, targets(sums), seed), "blocks"), shards, seed)
    extra = F.greatest(F.lit(0), F.least("words", F.col("rest") - F.col("before")))
    plan = plan.select(F.col("source").alias("plan_source"), F.col("block").alias("plan_block"), "source_size", "target", "passes", "words", extra.alias("extra"), "units")
    plan = common.settled(plan, "mix-plan")
    joined = own.join(plan, own["source"].eqNullSafe(plan["plan_source"]) & (own["block"] == plan["plan_block"])).drop("plan_source", "plan_block")
    # Only the block in which a source's words run out is taken in part.
    whole = joined.where((F.col("extra") == F.col("words")) | (F.col("extra") == 0)).withColumn("more", F.when(F.col("extra") > 0, F.col("size")).otherwise(0))
    part = joined.where((F.col("extra") < F.col("words")) & (F.col("extra") > 0))
    columns = ["doc_id", "source", "size", "source_size", "target", "draw", "passes", "more", "units"]
    rows = whole.select(*columns).unionByName(_more(part).select(*columns))
    words = lambda u: F.when(u["pass"] <= F.col("passes"), F.col("size")).otherwise(F.col("more"))
    parts = F.filter(F.transform("units", lambda u: F.struct(u["pass"].alias("pass"), u["shard"].alias("shard"), words(u).alias("words"))), lambda u: u["words"] > 0)
    taken = F.aggregate("parts", F.lit(0).cast("long"), lambda a, u: a + u["words"])
    return rows.withColumn("parts", parts).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "draw", "parts")


def shards_of(docs: DataFrame, shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """shard, place, doc_id, words: what each output shard holds, a row per document and pass; place is the order in
    which a shard writes them, so that each is shuffled on its own."""
    rows = mix(docs, seed, shards).select("doc_id", "draw", F.explode("parts").alias("p"))
    return rows.select("p.shard", F.md5(F.concat_ws(":", "draw", "p.pass", "p.shard")).alias("place"), "doc_id", "p.words")


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """quotas: source_no (from 0 on), units. Returns shard, source_no, units: the splitting tree, a level at a time.

    A node's left half gets half of its units. How many of each group of sources is drawn group by group, and how many of
    each source in a group source by source, from the hypergeometric distribution given what those before left."""
    wide = quotas.withColumn("bucket", F.floor(F.col("source_no") / WIDTH))
    listed = lambda key: F.transform(F.array_sort(F.collect_list(F.struct(key, "units"))), lambda x: x["units"]).alias("units")
    root = F.lit(0).cast("long").alias("shard")
    groups = wide.groupBy("bucket").agg(F.sum("units").alias("units")).agg(listed("bucket")).select(root, "units")
    inner = wide.groupBy("bucket").agg(listed("source_no")).select("bucket", root, "units")
    level = 1
    while level < shards:
        total = F.aggregate("units", F.lit(0).cast("long"), lambda a, x: a + x)
        groups = groups.withColumn("took", _drawn(total, F.floor(total / 2).cast("long"), f"{seed}:{level}", F.lit("group")))
        rooms = groups.select("shard", F.posexplode("took").alias("bucket", "room"))
        inner = inner.join(rooms, ["bucket", "shard"]).withColumn("took", _drawn(total, F.col("room"), f"{seed}:{level}", F.lit(None).cast("string"), F.col("bucket") * WIDTH))
        groups, inner = _halves(groups), _halves(inner, "bucket")
        level *= 2
    return inner.select("shard", "bucket", F.posexplode("units").alias("i", "units")).select("shard", (F.col("bucket") * WIDTH + F.col("i")).cast("int").alias("source_no"), "units")


def _halves(node: DataFrame, *keys: str) -> DataFrame:
    right = F.zip_with("units", "took", lambda a, b: a - b)
    both = F.explode(F.array(F.struct((F.col("shard") * 2).alias("shard"), F.col("took").alias("units")), F.struct((F.col("shard") * 2 + 1).alias("shard"), right.alias("units"))))
    return node.select(*keys, both.alias("h")).select(*keys, "h.shard", "h.units")


def _bound(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _drawn(total: Column, room: Column, name: str, kind: Column, first: Column | None = None) -> Column:
    """How many of each entry of `units` are among `room` drawn from all. Each draw has a uniform number of its own, the
    digest of the node and the entry's number."""
    start = F.struct(total.alias("left_in"), room.cast("long").alias("room"), F.array().cast("array<long>").alias("took"))

    def step(state: Column, units: Column) -> Column:
        number = (first if first is not None else F.lit(0)) + F.size(state["took"])
        digest = F.md5(F.concat_ws(":", F.lit(name), "shard", kind, number.cast("string")))
        u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
        took = lambda x: F.struct((state["left_in"] - units).alias("left_in"), (state["room"] - x).alias("room"), F.array_append(state["took"], x).alias("took"))
        return _bound(_hypergeometric(state["left_in"], units, state["room"], u), took)

    return F.aggregate("units", start, step)["took"]


def _hypergeometric(total: Column, good: Column, room: Column, u: Column) -> Column:
    """The value at u of the hypergeometric distribution: of `total` units, `good` are this source's, `room` are drawn.
    Odds are taken in logarithms and relative to the greatest, so that none that matters vanishes."""
    low, high = F.greatest(F.lit(0), room + good - total).cast("long"), F.least(good, room).cast("long")
    steps = F.when(high > low, F.sequence(low, F.greatest(high - 1, low))).otherwise(F.array().cast("array<long>"))
    log = lambda x: F.ln(x.cast("double"))
    rise = lambda k: log(good - k) + log(room - k) - log(k + 1) - log(total - good - room + k + 1)
    zero = F.lit(0.0)

    def peak(ks: Column) -> Column:
        grown = lambda s, k: _bound(s["l"] + rise(k), lambda x: F.struct(x.alias("l"), F.greatest(s["most"], x).alias("most")))
        return F.aggregate(ks, F.struct(zero.alias("l"), zero.alias("most")), grown)["most"]

    def whole(ks: Column, most: Column) -> Column:
        grown = lambda s, k: _bound(s["l"] + rise(k), lambda x: F.struct(x.alias("l"), (s["sum"] + F.exp(x - most)).alias("sum")))
        return F.aggregate(ks, F.struct(zero.alias("l"), F.exp(-most).alias("sum")), grown)["sum"]

    def walked(ks: Column, most: Column, goal: Column) -> Column:
        further = lambda s, k: _bound(s["l"] + rise(k), lambda x: F.struct(x.alias("l"), (s["cdf"] + F.exp(x - most)).alias("cdf"), (k + 1).alias("x")))
        grown = lambda s, k: F.when(s["cdf"] < goal, further(s, k)).otherwise(s)
        return F.aggregate(ks, F.struct(zero.alias("l"), F.exp(-most).alias("cdf"), low.alias("x")), grown)["x"]

    return _bound(steps, lambda ks: _bound(peak(ks), lambda most: _bound(u * whole(ks, most), lambda goal: walked(ks, most, goal))))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the words that each output shard takes of a document, as
    `shard:words`, ascending."""
    of = lambda s: F.aggregate(F.filter("parts", lambda p: p["shard"] == s), F.lit(0).cast("long"), lambda a, p: a + p["words"])
    listed = F.transform(F.array_sort(F.array_distinct(F.transform("parts", lambda p: p["shard"]))), lambda s: F.concat_ws(":", s.cast("string"), of(s).cast("string")))
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", F.array_join(listed, ",").alias("shards"))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_report(common.table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE own AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat('17:', coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS draw FROM documents),
dealt AS (SELECT *, CAST(strpos('0123456789abcdef', substr(draw, 1, 1)) - 1 AS INT) * 16 + CAST(strpos('0123456789abcdef', substr(draw, 2, 1)) - 1 AS INT) AS block FROM own),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM dealt GROUP BY 1),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM src),
levels AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
  / CAST(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lvl,
  row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST) AS k FROM weighed),
best AS (SELECT lvl FROM levels WHERE lvl * weight <= cap ORDER BY k LIMIT 1),
goals AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), best.lvl * weight) AS target FROM levels LEFT JOIN best ON true),
plan AS (SELECT *, CAST(round(target) AS BIGINT) AS wanted, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS passes FROM goals),
blocks AS (SELECT source, block, CAST(sum(size) AS BIGINT) AS words FROM dealt GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER o AS rank, CAST(sum(words) OVER o AS BIGINT) - words AS before FROM blocks
  WINDOW o AS (PARTITION BY source ORDER BY md5(concat_ws(':', '17', source, CAST(block AS VARCHAR))), block ROWS UNBOUNDED PRECEDING)),
quota AS (SELECT r.source, r.block, r.rank, p.source_size, p.target, p.passes, p.wanted - p.passes * p.source_size AS rest, r.before, greatest(0, least(r.words, p.wanted - p.passes * p.source_size - r.before)) AS extra
  FROM ranked r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source),
units AS (SELECT source, block, pass, row_number() OVER (PARTITION BY source ORDER BY pass, rank) - 1 AS unit
  FROM (SELECT source, block, rank, unnest(range(1, passes + CASE WHEN rest > before THEN 2 ELSE 1 END)) AS pass FROM quota)),
given AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no FROM units GROUP BY 1),
tree AS (
  SELECT 1 AS level, 0 AS shard, list(n ORDER BY source_no) AS us, CAST([] AS BIGINT[]) AS took, CAST(sum(n) AS BIGINT) AS left_in, CAST(sum(n) AS BIGINT) // 2 AS room FROM given HAVING count(*) > 0
  UNION ALL
  SELECT CASE WHEN full_ THEN level * 2 ELSE level END, CASE WHEN full_ THEN shard * 2 + side ELSE shard END, CASE WHEN full_ THEN half ELSE us END,
         CASE WHEN full_ THEN CAST([] AS BIGINT[]) ELSE list_append(took, x) END, CASE WHEN full_ THEN CAST(list_sum(half) AS BIGINT) ELSE left_in - good END, CASE WHEN full_ THEN CAST(list_sum(half) AS BIGINT) // 2 ELSE room - x END
  FROM (SELECT *, CASE WHEN side = 0 THEN took ELSE list_transform(range(1, len(us) + 1), lambda i: us[i] - took[i]) END AS half,
               low + len(list_filter(range(1, len(w)), lambda i: list_sum(w[1:i]) < u * list_sum(w))) AS x
        FROM (SELECT *, list_transform(l, lambda y: exp(y - list_max(l))) AS w
              FROM (SELECT *, list_transform(range(low, high + 1), lambda k: -(lgamma(k + 1) + lgamma(good - k + 1) + lgamma(room - k + 1) + lgamma(left_in - good - room + k + 1))) AS l
                    FROM (SELECT *, greatest(0, room + good - left_in) AS low, least(good, room) AS high, (CAST(concat('0x', substr(md5(concat_ws(':', '17', level, shard, len(took))), 1, 12)) AS BIGINT) + 0.5e0) / 281474976710656e0 AS u
                          FROM (SELECT *, len(took) = len(us) AS full_, coalesce(us[len(took) + 1], 0) AS good, unnest(CASE WHEN len(took) = len(us) THEN [0, 1] ELSE [0] END) AS side FROM tree WHERE level < 8)))))),
runs AS (SELECT shard, source_no, CAST(sum(n) OVER (PARTITION BY source_no ORDER BY shard) AS BIGINT) AS stop, n FROM (SELECT shard, unnest(us) AS n, unnest(range(len(us))) AS source_no FROM tree WHERE level = 8)),
placed AS (SELECT u.source, u.block, list({'pass': u.pass, 'shard': r.shard}) AS parts FROM units u JOIN given g ON u.source IS NOT DISTINCT FROM g.source JOIN runs r ON r.source_no = g.source_no AND u.unit >= r.stop - r.n AND u.unit < r.stop GROUP BY 1, 2),
taking AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.passes, q.source, q.block,
    CAST(greatest(0, least(d.size, q.extra - coalesce(sum(d.size) OVER (PARTITION BY d.source, d.block ORDER BY d.draw, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS more
  FROM dealt d JOIN quota q ON d.source IS NOT DISTINCT FROM q.source AND d.block = q.block),
shared AS (SELECT t.*, list_transform(coalesce(p.parts, []), lambda x: {'shard': x['shard'], 'words': CASE WHEN x['pass'] <= t.passes THEN t.size ELSE t.more END}) AS parts
  FROM taking t LEFT JOIN placed p ON t.source IS NOT DISTINCT FROM p.source AND t.block = p.block)
SELECT doc_id, size, source_size, target, CAST(coalesce(list_sum(list_transform(parts, lambda x: x['words'])), 0) AS BIGINT) AS taken,
  array_to_string(list_filter(list_transform(range(8), lambda s: CASE WHEN len(list_filter(parts, lambda x: x['shard'] = s AND x['words'] > 0)) > 0 THEN concat(s, ':', CAST(list_sum(list_transform(list_filter(parts, lambda x: x['shard'] = s), lambda x: x['words'])) AS BIGINT)) END), lambda y: y IS NOT NULL), ',') AS shards
FROM shared
"""
