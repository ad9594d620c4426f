"""Mixing sources to target weights, with DataFrame and SQL functions only.

1. A document's size is its number of words; a source's target is its share, by weight, of ``share`` of all sizes. A
   target stops at ``most`` times its source's size; the excess goes to the others by weight, until none is above
   (solved at once over the sources in order of size by weight).
2. The documents of a source are dealt by a hash into blocks (about ``block_words`` words each, ``most_blocks`` at
   most). A source's blocks are drawn in a permuted order, pass after pass, until its target; this fixes the source's
   exact quota of blocks. The last block is taken in part: its documents are dealt into ``SUB_BLOCKS`` smaller blocks,
   taken whole in a permuted order, and in the last of these whole documents in a permuted order, then the first words
   of one more. So the words taken are the target, rounded (where several rows equal in doc_id and text are the last,
   each gives the same number of words, and fewer words than there are such rows may be missing).
3. Multivariate-hypergeometric splitting tree: the root holds the quotas of all sources; each node gives half of its
   output shards, and as many blocks as fall on them, to its left child, the composition drawn from the multivariate
   hypergeometric distribution (source by source, each from the hypergeometric distribution given those before,
   by inversion), the rest to the right child. Sources are drawn in groups of ``GROUP_SOURCES``, first the groups' counts
   and then each group's own, which is the same distribution, so that no row holds more than a group; sources that have
   no block at a node are left out there. A leaf is an output shard with exact counts of blocks of each source.
4. A shard takes its count of the source's permuted draws, disjoint from other shards', and is shuffled locally.

All draws come from hashes of ids, texts and a seed: reruns agree, on any number of tasks. Null or repeated ids spread by
their texts. Windows run over narrow rows only: blocks (at most ``most`` x ``most_blocks`` a source), sub-blocks, the
documents of one sub-block a source, and the sources. Rows with texts are only joined with what these decide.

Defined results: null texts have size 0 and take 0; a null source is a source of its own, last in the order; a null
doc_id is a document like any other; repeated rows are documents of their own; a source of size 0 has target 0; empty
tables give empty results. Extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import SPACE_CLASS, WORD, cut, table

WEIGHTS = (3, 1, 2)
#: A table of draws with at most so many rows (each under 200 bytes) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Never null: a null source differs from every string."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def targets(sized: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(src, number, source_size, target): one row for each source."""
    sizes = sized.groupBy("src", "source").agg(F.sum("size").alias("source_size"))
    numbered = sizes.withColumn("number", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("number", F.lit(len(weights))) + 1).cast("int"))
    caps = numbered.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    everything = W.partitionBy(F.lit(0))
    # in order of cap by weight, a source is at its cap if that is under its share of what those before left
    order = W.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "number")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    # what is left to share, by the weights that are left: a frame to the end would cost the square of the sources
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    solved = caps.withColumn("level", level).withColumn("rank", F.row_number().over(order))
    free = F.col("cap") > F.col("weight") * F.col("level")
    solved = solved.withColumn("shared", F.min_by(F.when(free, F.col("level")), F.when(free, F.col("rank"))).over(everything))
    target = F.when(free, F.col("weight") * F.col("shared")).otherwise(F.col("cap")).cast("double")
    return solved.select("src", F.col("number").cast("int").alias("number"), "source_size", target.alias("target"))


SUB_BLOCKS = 4096


def mark(doc_id: Column, text: Column) -> Column:
    """What a row is drawn by."""
    return F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))


def block_of(mark: Column, blocks: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(mark, F.lit("block"), F.lit(seed)), blocks).cast("int")


def sub_block(mark: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(mark, F.lit("sub"), F.lit(seed)), F.lit(SUB_BLOCKS)).cast("int")


def row_order(mark: Column, copy: Column, seed: int) -> Column:
    return F.xxhash64(mark, copy, F.lit("order"), F.lit(seed))


#: One draw x of the hypergeometric distribution: picks drawn of a pool, of which own are of the source; u is uniform in [0, 1).
#: t holds pool, own, picks, u; the walk covers the mode and 12 standard deviations to each side, which leaves out less than
#: a double can show.
_RANGE = """
transform(array(t), t -> named_struct('pool', t.pool, 'own', t.own, 'picks', t.picks, 'u', t.u,
  'a', greatest(0L, t.picks - (t.pool - t.own), cast(floor((t.picks + 1D) * (t.own + 1D) / (t.pool + 2D)) as bigint)
       - cast(ceil(12 * sqrt(t.picks * (t.own / greatest(t.pool, 1D)) * (1 - t.own / greatest(t.pool, 1D)) * ((t.pool - t.picks) / greatest(t.pool - 1D, 1D)))) as bigint) - 12L),
  'b', least(t.picks, t.own, cast(floor((t.picks + 1D) * (t.own + 1D) / (t.pool + 2D)) as bigint)
       + cast(ceil(12 * sqrt(t.picks * (t.own / greatest(t.pool, 1D)) * (1 - t.own / greatest(t.pool, 1D)) * ((t.pool - t.picks) / greatest(t.pool - 1D, 1D)))) as bigint) + 12L)))[0]
"""
#: Ratio of the probability of x + 1 to that of x.
_STEP = "(cast(t.own - x as double) * (t.picks - x) / ((x + 1D) * (t.pool - t.own - t.picks + x + 1D)))"
_SUM = f"aggregate(if(t.b > t.a, sequence(t.a, t.b - 1L), cast(array() as array<bigint>)), named_struct('p', 1D, 's', 1D), (s, x) -> named_struct('p', s.p * {_STEP}, 's', s.s + s.p * {_STEP}), s -> s.s)"
_FIND = f"aggregate(if(t.b > t.a, sequence(t.a, t.b - 1L), cast(array() as array<bigint>)), named_struct('p', 1D, 's', 1D, 'x', t.a), (s, x) -> named_struct('p', s.p * {_STEP}, 's', s.s + s.p * {_STEP}, 'x', if(s.s > t.u * t.total, s.x, x + 1L)), s -> s.x)"
_DRAW = f"""
transform(array({_RANGE}), t -> transform(array(named_struct('pool', t.pool, 'own', t.own, 'picks', t.picks, 'u', t.u, 'a', t.a, 'b', t.b, 'total', {_SUM})), t -> {_FIND})[0])[0]
"""


#: Sources whose counts stand in one row.
GROUP_SOURCES = 1024


def halve(rows: DataFrame, label: str, seed: int) -> DataFrame:
    """Adds ``left`` to rows (node, grp, items: array of number and quota, want): how many of each item's quota are among
    ``want`` drawn from all."""
    u = f"(shiftrightunsigned(xxhash64('{label}', {seed}, node, item.number), 11) / 9007199254740992D)"
    left = f"""
    aggregate(items,
      named_struct('left', cast(array() as array<bigint>), 'picks', want, 'pool', aggregate(items, 0L, (s, t) -> s + t.quota)),
      (s, item) -> transform(transform(array(named_struct('pool', s.pool, 'own', item.quota, 'picks', s.picks, 'u', {u})), t -> {_DRAW}),
        x -> named_struct('left', concat(s.left, array(x)), 'picks', s.picks - x, 'pool', s.pool - item.quota))[0],
      s -> s.left)
    """
    return rows.withColumn("left", F.expr(left))


def split(level: DataFrame, groups: int, seed: int) -> DataFrame:
    """One level of the tree: (node, shards, grp, items) to the two children of every node with several shards."""
    # a node with s shards and n blocks gives floor(s / 2) shards and floor(n * that / s) blocks to the left
    share = F.expr("cast(floor(total * (shards div 2) / shards) as bigint)")
    summed = level.withColumn("total", F.expr("aggregate(items, 0L, (s, t) -> s + t.quota)"))
    if groups == 1:
        wanted = summed.withColumn("want", share)
    else:
        totals = summed.groupBy("node", "shards").agg(F.array_sort(F.collect_list(F.struct(F.col("grp").alias("number"), F.col("total").alias("quota")))).alias("items"), F.sum("total").alias("total"))
        drawn = halve(totals.withColumn("want", share), "group", seed).select("node", F.explode(F.arrays_zip("items", "left")).alias("g"))
        wanted = level.join(drawn.select("node", F.col("g.items.number").alias("grp"), F.col("g.left").alias("want")), ["node", "grp"])
    halves = halve(wanted, "tree", seed)
    children = F.expr("""if(shards = 1, array(named_struct('node', node * 2, 'shards', 1L, 'items', items)), array(
      named_struct('node', node * 2, 'shards', shards div 2, 'items', zip_with(items, left, (t, l) -> named_struct('number', t.number, 'quota', l))),
      named_struct('node', node * 2 + 1, 'shards', shards - shards div 2, 'items', zip_with(items, left, (t, l) -> named_struct('number', t.number, 'quota', t.quota - l)))))""")
    each = halves.select("grp", F.explode(children).alias("c")).select("c.node", "c.shards", "grp", F.expr("filter(c.items, t -> t.quota > 0)").alias("items"))
    return each.where(F.size("items") > 0)


def tree(spark: SparkSession, quotas: DataFrame, shards: int, seed: int, group_sources: int = GROUP_SOURCES) -> DataFrame:
    """(number, shard, count), counts above 0: ``quotas`` has number (of a source) and quota."""
    item = F.struct(F.col("number").cast("long").alias("number"), F.col("quota").cast("long").alias("quota"))
    grouped = quotas.where("quota > 0").groupBy(F.expr(f"cast(number div {group_sources} as bigint)").alias("grp")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    level = cut(spark, grouped.select(F.lit(1).cast("long").alias("node"), F.lit(shards).cast("long").alias("shards"), "grp", "items"), "tree")
    groups = level.count()
    for _ in range(max(0, (shards - 1).bit_length())):
        level = cut(spark, split(level, groups, seed), "tree")
    # output shards by number, one row each; a shard without a block has none
    leaves = level.select("node").distinct().withColumn("shard", F.row_number().over(W.orderBy("node")) - 1)
    counts = level.select("node", F.explode("items").alias("t")).join(leaves, "node")
    return counts.select(F.col("t.number").cast("int").alias("number"), "shard", F.col("t.quota").alias("count"))


def plan(spark: SparkSession, sized: DataFrame, share: float = 1.5, most: int = 2, block_words: int = 1 << 16, most_blocks: int = 4096, shard_blocks: int = 64, most_shards: int = 1024, seed: int = 17) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``sized`` has src, source, doc_id, mark, size. Gives the sources (src, number, source_size, target, blocks), the
    draws: for each block that is drawn (src, block, draws: array of copy and shard for whole draws, edge: the draw in
    part with copy, shard and words, or null), the sub-blocks of the edges (src, sub, words: what is taken of one that is
    taken in part, null of one taken whole) and the documents of those in part (src, sub, mark, part: words)."""
    sources = cut(spark, targets(sized, share, most).withColumn("blocks", F.least(F.greatest(F.ceil(F.col("source_size") / block_words), F.lit(1)), F.lit(most_blocks)).cast("int")), "sources")
    small = F.broadcast if sources.count() <= BROADCAST_ROWS else (lambda df: df)
    blocked = sized.join(small(sources.select("src", "number", "target", "blocks")), "src").withColumn("block", block_of(F.col("mark"), F.col("blocks"), seed))
    blocks = blocked.groupBy("src", "number", "target", "block").agg(F.sum("size").alias("words")).where("words > 0")
    order = W.partitionBy("src").orderBy("copy", F.xxhash64("block", "copy", F.lit("permute"), F.lit(seed)), "block")
    passes = blocks.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    passes = passes.withColumn("before", F.sum("words").over(order) - F.col("words")).withColumn("rank", F.row_number().over(order) - 1)
    taken = F.least("words", F.round("target").cast("long") - F.col("before"))
    drawn = cut(spark, passes.withColumn("taken", taken).where("taken > 0"), "drawn")
    quotas = drawn.groupBy("number").agg(F.count("*").alias("quota"))
    total = drawn.count()
    shards = max(1, min(most_shards, -(-total // shard_blocks)))
    first = F.sum("count").over(W.partitionBy("number").orderBy("shard")) - F.col("count")
    ranks = tree(spark, quotas, shards, seed).withColumn("first", first).select("number", "shard", F.explode(F.expr("sequence(cast(first as int), cast(first + count - 1 as int))")).alias("rank"))
    dealt = drawn.join(ranks, ["number", "rank"])
    whole = F.col("taken") == F.col("words")
    draws = dealt.groupBy("src", "block").agg(
        F.array_sort(F.collect_list(F.when(whole, F.struct("copy", "shard")))).alias("draws"),
        F.first(F.when(~whole, F.struct("copy", "shard", F.col("taken").alias("words"))), ignorenulls=True).alias("edge"),
    )
    draws = cut(spark, draws, "draws")
    # one block of a source at most is taken in part
    edges = draws.where("edge is not null").select("src", "block", F.col("edge.words").alias("want"), F.col("edge.copy").alias("copy"))
    inside = blocked.select("src", "block", "doc_id", "mark", "size").join(small(edges), ["src", "block"]).where("size > 0").withColumn("sub", sub_block(F.col("mark"), seed))
    order = W.partitionBy("src").orderBy(F.xxhash64("sub", "copy", F.lit("permute"), F.lit(seed)), "sub")
    subs = inside.groupBy("src", "sub", "want", "copy").agg(F.sum("size").alias("all"))
    subs = subs.withColumn("rest", F.col("want") - (F.sum("all").over(order) - F.col("all"))).where("rest > 0")
    subs = cut(spark, subs.select("src", "sub", F.when(F.col("rest") < F.col("all"), F.col("rest")).alias("words")), "sub-blocks")
    # and one sub-block; equal rows count as one of several times the size
    last = inside.join(small(subs.where("words is not null")), ["src", "sub"])
    units = last.groupBy("src", "sub", "words", "mark", row_order(F.col("mark"), F.col("copy"), seed).alias("key"), "size").agg(F.count("*").alias("n"))
    order = W.partitionBy("src").orderBy(F.desc("n"), "key", "mark", "size")
    units = units.withColumn("rest", F.col("words") - (F.sum(F.col("size") * F.col("n")).over(order) - F.col("size") * F.col("n"))).where("rest > 0")
    parts = units.select("src", "sub", "mark", F.least(F.col("size"), F.floor(F.col("rest") / F.col("n"))).cast("long").alias("part"))
    return sources, draws, subs, cut(spark, parts.groupBy("src", "sub", "mark").agg(F.min("part").alias("part")), "parts")


def apply_plan(docs: DataFrame, planned: tuple[DataFrame, DataFrame, DataFrame, DataFrame], seed: int = 17) -> DataFrame:
    """Adds source_size, target and takes (array of copy, shard, words) to ``docs``, which has src, mark and size. Every
    table that is joined is broadcast if it is small, whatever the others are."""
    sources, draws, subs, parts = (F.broadcast(df) if df.count() <= BROADCAST_ROWS else df for df in planned)
    named = docs.join(sources.select("src", "source_size", "target", "blocks"), "src")
    named = named.withColumn("block", block_of(F.col("mark"), F.col("blocks"), seed)).join(draws, ["src", "block"], "left")
    named = named.withColumn("sub", F.when(F.col("edge").isNotNull(), sub_block(F.col("mark"), seed)))
    named = named.join(subs.withColumn("__in", F.lit(True)), ["src", "sub"], "left").join(parts, ["src", "sub", "mark"], "left")
    named = named.withColumn("part", F.when(F.col("__in"), F.when(F.col("words").isNull(), F.col("size")).otherwise(F.least("size", F.coalesce("part", F.lit(0))))).otherwise(0))
    more = F.array(F.struct(F.col("edge.copy").alias("copy"), F.col("edge.shard").alias("shard"), F.col("part").cast("long").alias("words")))
    takes = F.expr("transform(coalesce(draws, array()), d -> named_struct('copy', d.copy, 'shard', d.shard, 'words', size))")
    takes = F.filter(F.when(F.col("part") > 0, F.concat(takes, more)).otherwise(takes), lambda t: t["words"] > 0)
    return named.withColumn("takes", takes).drop("blocks", "block", "draws", "edge", "sub", "words", "part", "__in")


def sizes(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select("doc_id", "source", source_key(F.col("source")).alias("src"), mark(F.col("doc_id"), text).alias("mark"), words(text).alias("size"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = cut(spark, sizes(table(spark, sf_dir, "documents")), "sizes")
    mixed = apply_plan(sized, plan(spark, sized))
    return mixed.select("doc_id", "size", "source_size", "target", F.expr("aggregate(takes, 0L, (s, t) -> s + t.words)").alias("taken"), F.expr("transform(takes, t -> t.shard)").alias("shards"))


def mix(spark: SparkSession, docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mixed rows: the columns of ``docs``, ``mix_copy``, ``mix_shard``; a document taken in part has the first
    words of its text. Rows lie by shard, shuffled within it."""
    names = docs.columns
    plain = docs.select(F.struct(*names).alias("__row"), source_key(F.col("source")).alias("src"), mark(F.col("doc_id"), F.col("text")).alias("mark"), words(F.col("text")).alias("size"))
    sized = cut(spark, sizes(docs), "sizes")
    rows = apply_plan(plain, plan(spark, sized, seed=seed), seed).select("__row", "mark", "size", F.explode("takes").alias("__t"))
    # the first words with the white space between them
    head = F.array_join(F.slice(F.regexp_extract_all(F.col("__row.text"), F.lit(f"[{SPACE_CLASS}]*{WORD}"), F.lit(0)), F.lit(1), F.col("__t.words").cast("int")), "")
    text = F.when(F.col("__t.words") < F.col("size"), head).otherwise(F.col("__row.text"))
    parts = [text.alias("text") if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(f"__row.`{c}`") for c in names]
    out = rows.select(*parts, F.col("__t.copy").alias("mix_copy"), F.col("__t.shard").alias("mix_shard"), "mark")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(n, "mix_shard", F.pmod("mark", F.lit(64))).sortWithinPartitions("mix_shard", row_order(F.col("mark"), F.col("mix_copy"), seed)).drop("mark")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: a row for every copy, or part of one, that the mix takes."""
    return mix(spark, docs).select(*docs.columns)
