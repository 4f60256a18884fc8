"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations alone.

A source's target over its size is the number of copies that each of its documents should have. Its whole part is
taken; the fractional parts are rounded by duels: two documents meet, and words move from one's probability to the
other's, in a direction drawn at random (with the chances that keep each one's expected copies), until one of the two is
integral; the other meets the next. What one loses in words the other wins, so a duel doesn't change the source's sum.
Documents duel in bounded blocks of one source, dealt by hash, the largest first, so that what is left of a block, one
fractional document at most, is a small one as a rule. It goes up a reduction tree of blocks until a source has one left.
Chance rounds that one too, and the words that its rounding wins or loses are settled with smaller documents of its
source, which change by one copy; where these can settle one direction better than the other, it takes the former. So
expected copies are kept by the duels alone: the last document of a source and those that settle it, a few times its words
together, may deviate from theirs. Chances come from hashes of the documents' ids and texts, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofmill.llm.store import discard, documents, small, word_count, written

#: Documents in a block; a block's fold is one row of one task.
BLOCK = 256
MOST_COPIES = 3
_ITEM = "struct<size:long,u:long,row:long,whole:long,p:double>"
_DONE = "array<struct<size:long,u:long,row:long,copies:long>>"
_EPS = 1e-9


def targets(sized: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """A row for each source: source, source_size, target.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the sum of all sizes. A target stops at
    ``most`` times its source's size; what is above is shared again by weight: the level at which sources fill is found
    with running sums over the sources in the order in which they fill up. The windows run over one row a source.
    """
    sources = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    ranked = sources.withColumn("weight", ((rank - 1) % 3 + 1).cast("long")).withColumn("cap", most * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = fill.rowsBetween(Window.unboundedPreceding, 0)
    open_ = ranked.select(
        "*",
        (F.sum("source_size").over(whole) - (F.sum("cap").over(upto) - F.col("cap"))).alias("left"),
        (F.sum("weight").over(whole) - (F.sum("weight").over(upto) - F.col("weight"))).alias("weights"),
    ).withColumn("level", F.col("left") / F.col("weights"))
    below = F.col("cap") > F.col("level") * F.col("weight")
    leveled = open_.withColumn("final", F.min(F.when(below, F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole)["level"])
    share = F.least(F.col("cap").cast("double"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap").cast("double")))
    return leveled.select("source", "source_size", share.alias("target"))


def _chance(*keys: Column) -> Column:
    """A number from 0 to 1 that depends on the keys alone."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def _duel(state: Column, x: Column, seed: int) -> Column:
    """The held document meets x: one of them at least is decided, the other is held."""
    held = state["held"]
    mass = lambda d, p: d["size"] * p
    up = F.least(mass(held, 1 - held["p"]), mass(x, x["p"]))  # words that the held one can win
    down = F.least(mass(held, held["p"]), mass(x, 1 - x["p"]))  # and lose
    words = F.when(_chance(F.lit(seed), held["u"], x["u"]) * (up + down) < down, up).otherwise(-down)
    after = lambda d, moved: F.struct(d["size"].alias("size"), d["u"].alias("u"), d["row"].alias("row"), d["whole"].alias("whole"), (d["p"] + moved / d["size"]).alias("p"))
    decided = lambda d: (d["p"] < _EPS) | (d["p"] > 1 - _EPS)
    out = lambda d: F.struct(d["size"].alias("size"), d["u"].alias("u"), d["row"].alias("row"), (d["whole"] + F.round(d["p"])).cast("long").alias("copies"))
    both = F.array(after(held, words), after(x, -words))
    done = F.concat(state["done"], F.transform(F.filter(both, decided), out))
    rest = F.get(F.filter(both, lambda d: ~decided(d)), F.lit(0))
    first = F.struct(state["done"].alias("done"), x.alias("held"))
    return F.when(held.isNull(), first).otherwise(F.struct(done.alias("done"), rest.alias("held")))


def _round(items: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Folds each group's items, the largest first: source, done, held."""
    start = F.struct(F.array().cast(_DONE).alias("done"), F.lit(None).cast(_ITEM).alias("held"))
    blocks = items.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col("item").cast(_ITEM)), asc=False).alias("items"))
    folded = blocks.select("source", F.aggregate("items", start, lambda s, x: _duel(s, x, seed)).alias("s"))
    return folded.select("source", "s.done", "s.held")


def _dealt(items: DataFrame, seed: int) -> DataFrame:
    """``items`` (source, item) with a block of about BLOCK of one source."""
    counts = written(items.groupBy("source").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks")), "blocks").alias("b")
    block = F.pmod(F.xxhash64(F.lit(seed), "item.u", "item.row"), "blocks").alias("block")
    return items.alias("a").join(small(counts), F.expr("a.source <=> b.source")).select("a.source", block, "item")


def _copies(sized: DataFrame, seed: int, most: int) -> tuple[DataFrame, DataFrame]:
    """row, source, size, copies of the documents of ``sized`` (row, u, source, size; stored), and the sources' targets."""
    goals = written(targets(sized, most), "targets")
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    shares = goals.select("source", F.floor(factor + _EPS).cast("long").alias("whole"), F.greatest(factor - F.floor(factor + _EPS), F.lit(0.0)).alias("p"))
    worded = sized.where("size > 0").alias("a")
    placed = worded.join(small(shares).alias("b"), F.expr("a.source <=> b.source")).select("a.source", "size", "u", "row", "whole", "p")
    columns = ["source", "size", "u", "row", "copies"]
    whole = placed.where(F.col("p") < _EPS).withColumn("copies", F.col("whole")).select(*columns)
    items = placed.where(F.col("p") >= _EPS).select("source", F.struct("size", "u", "row", "whole", "p").alias("item"))

    parts = [whole, sized.where("size = 0").withColumn("copies", F.lit(0).cast("long")).select(*columns)]

    left, levels = items, []
    while True:
        level = written(_round(_dealt(left, seed), ["source", "block"], seed), "round")
        levels.append(level)
        parts.append(level.select("source", F.explode("done").alias("d")).select("source", "d.size", "d.u", "d.row", "d.copies"))
        left = level.where("held is not null").select("source", F.col("held").alias("item"))
        seed += 1
        if not left.groupBy("source").count().where("count > 1").limit(1).count():
            break
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows, left = written(rows, "rounded"), written(left.select("source", "item.*"), "open")
    discard(*levels)
    last = written(_last(rows, left, seed), "last")
    both = written(rows.unionByName(last.select(*columns)), "decided")
    discard(rows, left, last)
    out = written(_settled(both, goals, shares), "copies")
    discard(both)
    return out, goals


def _last(rows: DataFrame, left: DataFrame, seed: int) -> DataFrame:
    """Copies of the one document that each source has left: source, size, u, row, copies. Up or down by chance, if smaller
    documents that are decided (``rows``) have enough words to settle either; else in the direction that leaves less."""
    one = left.withColumns({"above": F.col("size") * (1 - F.col("p")), "below": F.col("size") * F.col("p")})
    near = rows.alias("a").join(small(one).alias("b"), F.expr("a.source <=> b.source"))
    give = (F.col("a.copies") == F.col("whole") + 1) & (F.col("a.size") <= F.col("above"))
    take = (F.col("a.copies") == F.col("whole")) & (F.col("a.size") <= F.col("below"))
    room = near.where("a.size > 0").groupBy("a.source").agg(*[F.sum(F.when(c, F.col("a.size")).otherwise(0)).alias(n) for c, n in ((give, "give"), (take, "take"))])
    both = one.alias("a").join(room.alias("b"), F.expr("a.source <=> b.source"), "left")
    over, under = (F.greatest(F.col(g) - F.coalesce(F.col(r), F.lit(0)), F.lit(0)) for g, r in (("above", "give"), ("below", "take")))
    chance = _chance(F.lit(seed), F.col("u")) < F.col("p")
    up = F.when(over < under, True).when(over > under, False).otherwise(chance)
    return both.select("a.source", "size", "u", "row", (F.col("whole") + F.when(up, 1).otherwise(0)).cast("long").alias("copies"))


def _settled(rows: DataFrame, goals: DataFrame, shares: DataFrame) -> DataFrame:
    """``rows`` with the words that a source has too many or too few settled with documents that are no larger, the
    largest that still fits first. Of a source documents of about three times these words are looked at, chosen by hash, so
    their number doesn't grow with the source."""
    same = F.expr("a.source <=> b.source")
    taken = rows.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
    gap = goals.alias("a").join(taken.alias("b"), same).join(shares.alias("c"), F.expr("a.source <=> c.source")).where(F.col("p") >= _EPS)
    gaps = written(gap.select("a.source", (F.col("target") - F.col("taken")).alias("gap"), "whole"), "gaps")
    from_ = F.col("whole") + F.when(F.col("gap") < 0, 1).otherwise(0)
    open_ = rows.alias("a").join(small(gaps).alias("b"), same).where((F.col("size") > 0) & (F.col("size") <= F.abs("gap")) & (F.col("copies") == from_)).select("a.*", "gap")
    room = written(open_.groupBy("source").agg(F.sum("size").alias("room")), "room")
    some = open_.alias("a").join(small(room).alias("b"), same).where(_chance(F.lit(-1), F.col("u")) * F.col("room") <= 3 * F.abs("gap")).select("a.*")
    listed = some.groupBy("source", "gap").agg(F.sort_array(F.collect_list(F.struct("size", "u", "row")), asc=False).alias("docs"))
    start = F.struct(F.abs("gap").alias("left"), F.array().cast("array<bigint>").alias("rows"))
    fits = lambda s, x: F.when(x["size"] <= s["left"], F.struct((s["left"] - x["size"]).alias("left"), F.array_append(s["rows"], x["row"]).alias("rows"))).otherwise(s)
    chosen = listed.select("gap", F.explode(F.aggregate("docs", start, fits, lambda s: s["rows"])).alias("row"))
    moved = written(chosen.select("row", F.signum("gap").cast("long").alias("more")), "moved")
    both = rows.join(small(moved), "row", "left")
    return both.select("source", "size", "row", (F.col("copies") + F.coalesce("more", F.lit(0))).alias("copies"))


def _numbered(docs: DataFrame, *keep: Column) -> DataFrame:
    """Rows with a number, stored, so that it stays; u: a hash that a document has wherever its row stands."""
    u = F.xxhash64("doc_id", "text", "source").alias("u")
    return written(docs.select(*keep, u, word_count(F.col("text").cast("string")).alias("size")).withColumn("row", F.monotonically_increasing_id()), "numbered")


def mix(docs: DataFrame, seed: int = 17, most: int = MOST_COPIES) -> DataFrame:
    """Copies of each document of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, copies.

    Size: words of the text. A document without words has no copies to its name (0). Null sources are one source.
    Repeated rows, and rows that share an id or have none, are documents of their own. An empty table gives no rows.
    Other columns are ignored.
    """
    sized = _numbered(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"))
    rows, goals = _copies(sized, seed, most)
    known = rows.alias("a").join(small(goals).alias("b"), F.expr("a.source <=> b.source")).select("row", "size", "source_size", "target", "copies")
    return known.join(sized.select("row", "doc_id"), "row").select("doc_id", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, seed: int = 17, most: int = MOST_COPIES) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; rows as in ``mix``. ``docs`` is read twice, so it should be stored.

    Texts aren't stored again: what is known of a row is joined to it by 128 bits of its id, text and source. Rows that have
    these in common are the same to the mix; its copies are dealt to them in the order of their other columns. The join is a
    shuffle at any size, so that what it needs of disk is in proportion to the documents.
    """
    own = ["doc_id", "text", "source"]
    key = [F.xxhash64(*own).alias("key1"), F.xxhash64(F.lit(1), *own).alias("key2")]
    numbered = _numbered(docs, *key, F.col("source").cast("string").alias("source"))
    rows, _ = _copies(numbered.select("row", "u", "source", "size"), seed, most)
    given = numbered.select("row", "key1", "key2").join(rows.select("row", F.col("copies").cast("int").alias("copies")), "row")
    upto = F.sum("count").over(Window.partitionBy("key1", "key2").orderBy(F.desc("copies")))
    given = given.groupBy("key1", "key2", "copies").count().withColumn("upto", upto).where("copies > 0")
    given = given.groupBy("key1", "key2").agg(F.array_sort(F.collect_list(F.struct("upto", "copies"))).alias("given"))  # one for each number of copies
    rest = F.xxhash64(*[f"`{f.name}`" for f in docs.schema if "map<" not in f.dataType.simpleString()])
    known = docs.select(*key, rest.alias("rest"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    place = F.row_number().over(Window.partitionBy("key1", "key2").orderBy("rest"))
    copies = F.get(F.filter("given", lambda g: g["upto"] >= F.col("place")), F.lit(0))["copies"].alias("copies")
    taken = known.join(given.hint("merge"), ["key1", "key2"]).withColumn("place", place).select("doc", copies).where("copies is not null")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("doc.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", taken)
