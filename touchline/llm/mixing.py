"""Mixing sources to target weights by a low-discrepancy schedule.

Point t of the golden-ratio sequence, mapped through the cumulative target shares, names the source
of slot t; the r-th slot of a source takes the r-th block of BLOCK words of that source's
shuffled stream, starting over at its end. A source's last slot is cut so that it takes its
target to the word. Offsets within a source come from two-level prefix sums over buckets, so no
task sees a whole source, however large.

mixed_sizes tells the slots of every document, and mixed_documents gives its rows in the order of
the slots, so that any stretch of the mixture has about the target shares.

Defined results: NULL and empty texts have size 0 and are never taken; NULL is a source of its
own, ranked last; repeated rows are separate documents, and rows equal in id, source and text may
stand for each other; an empty table gives an empty result; extra columns are ignored by
mixed_sizes and carried by mixed_documents, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import blank_to_space, documents, store, words_of

WEIGHTS = (5.0, 2.0, 1.0)
RATIO, REPEATS = 1.5, 2.0
#: Words in a block; documents in a bucket of a source's stream, about; slots in a run of the schedule; cells for u.
BLOCK, BUCKET, RUN, CELLS = 256, 2000, 512, 1024
GOLDEN = 0.6180339887498949


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, ratio: float = RATIO, repeats: float = REPEATS) -> DataFrame:
    """Adds weight and target to one row per source with source_size.

    min(repeats * size, level * weight) for the one level at which the targets sum to ratio * all
    sizes: sorted by the level at which each is capped, prefix sums give it in closed form. The
    table has a row per source of the mixture, whose weights are its configuration.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sources.withColumn("_rank", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("_rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", repeats * F.col("source_size")).withColumn("_at", F.col("_cap") / F.col("weight"))
    before = Window.orderBy("_at", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranked = ranked.withColumns(
        {
            "_left": F.lit(ratio) * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
            "_weights": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    ).withColumn("_level", F.col("_left") / F.col("_weights"))
    # the first source, in order of its cap, that stays below it sets the level for itself and all after it
    free = F.min(F.when(F.col("_level") < F.col("_at"), F.struct("_at", "_rank", "_level"))).over(every)
    ranked = ranked.withColumn("_free", free)
    return ranked.withColumn("target", F.least("_cap", F.coalesce(F.col("_free._level") * F.col("weight"), F.col("_cap")))).drop("_cap", "_at", "_left", "_weights", "_level", "_free")


def streams(sized: DataFrame, seed: int) -> DataFrame:
    """Adds start (long): the document's first word in its source's shuffled stream. Needs doc_id, size, _hash, _src, _n_src."""
    h = F.xxhash64(F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.col("_hash")), F.lit(seed))
    df = sized.withColumn("_h", h).withColumn("_bucket", F.pmod("_h", F.greatest(F.lit(1), F.ceil(F.col("_n_src") / BUCKET)).cast("long")))
    totals = df.groupBy("_src", "_bucket").agg(F.sum("size").alias("_in"))
    ahead = Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_in").over(ahead), F.lit(0))).drop("_in")
    inside = Window.partitionBy("_src", "_bucket").orderBy("_h", "doc_id", "_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return df.join(totals, ["_src", "_bucket"]).withColumn("start", F.col("_base") + F.col("_in")).drop("_base", "_in", "_bucket", "_h")


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """The slots in order: slot, _src, source_size, _from and _to (words of the source's endless stream).

    sources: _src, source_size, target. Slots past a source's target are dropped; what a source
    still lacks when the sequence ends (a few blocks at most) follows in closing slots.
    """
    spark = sources.sparkSession
    every, so_far = Window.partitionBy(), Window.orderBy("_src").rowsBetween(Window.unboundedPreceding, 0)
    spans = sources.filter("target > 0").withColumn("_sum", F.sum("target").over(every)).withColumn("_hi", F.sum("target").over(so_far) / F.col("_sum"))
    spans = spans.withColumn("_lo", F.col("_hi") - F.col("target") / F.col("_sum")).withColumn("_goal", F.round("target").cast("long"))
    last = F.col("_src") == F.max("_src").over(every)
    spans = spans.withColumn("_hi", F.when(last, F.lit(1.0)).otherwise(F.col("_hi"))).select("_src", "source_size", "_goal", "_lo", "_hi")
    slots = int((spans.agg(F.sum("_goal")).first()[0] or 0) / block)
    cells = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") * CELLS), F.least(F.floor(F.col("_hi") * CELLS), F.lit(CELLS - 1).cast("long")))))
    t = F.col("slot")
    u = F.pmod((t % (1 << 20)) * F.lit(GOLDEN) + F.floor(t / (1 << 20)) * F.lit((GOLDEN * (1 << 20)) % 1), F.lit(1.0))
    drawn = spark.range(slots).withColumnRenamed("id", "slot").withColumn("_u", u).withColumn("_cell", F.floor(F.col("_u") * CELLS))
    drawn = drawn.join(cells, "_cell").filter("_u >= _lo and (_u < _hi or _hi = 1)").withColumn("_run", F.floor(t / RUN))
    counts = drawn.groupBy("_src", "_run").count()
    ahead = Window.partitionBy("_src").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("_ahead", F.coalesce(F.sum("count").over(ahead), F.lit(0))).drop("count")
    inside = Window.partitionBy("_src", "_run").orderBy("slot")
    drawn = drawn.withColumn("_nth", F.row_number().over(inside) - 1).join(bases, ["_src", "_run"])
    drawn = drawn.select("slot", "_src", "source_size", "_goal", (F.col("_ahead") + F.col("_nth")).alias("_turn"))
    done = counts.groupBy("_src").agg(F.sum("count").alias("_done"))
    ends = F.ceil(F.col("_goal") / block) - 1
    closing = spans.join(done, "_src", "left").withColumn("_done", F.coalesce("_done", F.lit(0))).filter(F.col("_done") <= ends)
    closing = closing.withColumn("_turn", F.explode(F.sequence(F.col("_done"), ends))).select((F.col("_turn") + slots).alias("slot"), "_src", "source_size", "_goal", "_turn")
    start = F.col("_turn") * block
    return drawn.unionByName(closing).filter(start < F.col("_goal")).select("slot", "_src", "source_size", start.alias("_from"), F.least(start + block, F.col("_goal")).alias("_to"))


def _per_cell(df: DataFrame, low: str, high: str, block: int) -> DataFrame:
    """One row per block of the source's grid that [low, high) meets, cut to it."""
    df = df.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(low) / block), F.floor((F.col(high) - 1) / block))))
    return df.withColumn(low, F.greatest(F.col(low), F.col("_cell") * block)).withColumn(high, F.least(F.col(high), (F.col("_cell") + 1) * block))


def mix(sized: DataFrame, seed: int = 42, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(documents with source_size, target, start; pieces: slot, pass, _src, start, from_word, to_word).

    sized: doc_id, source, size, _hash (of the text) and any key columns, read more than once. A piece is the run of a
    document's words that a slot takes, pass counting the times the source has started over;
    (_src, start) names the document, as every document with words has a place of its own.
    """
    sources = store(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n_src"))).withColumnRenamed("_rank", "_src"), "sources")
    docs = sized.withColumn("_key", F.coalesce(F.col("source"), F.lit(""))).withColumn("_null", F.col("source").isNull())
    keyed = sources.withColumn("_key", F.coalesce(F.col("source"), F.lit(""))).withColumn("_null", F.col("source").isNull()).drop("source", "weight")
    docs = store(streams(docs.join(keyed, ["_key", "_null"]).drop("_key", "_null"), seed), "streams")
    slots = schedule(sources.select("_src", "source_size", "target"), block)
    turns = F.sequence(F.floor(F.col("_from") / F.col("source_size")), F.floor((F.col("_to") - 1) / F.col("source_size")))
    slots = slots.withColumn("pass", F.explode(turns)).withColumn("_zero", F.col("pass") * F.col("source_size"))
    slots = slots.select("slot", "pass", "_src", (F.greatest("_from", "_zero") - F.col("_zero")).alias("_from"), (F.least("_to", F.col("_zero") + F.col("source_size")) - F.col("_zero")).alias("_to"))
    places = docs.filter("size > 0").select("_src", "start", F.col("start").alias("_a"), (F.col("start") + F.col("size")).alias("_b"))
    low, high = F.greatest("_from", "_a"), F.least("_to", "_b")
    pieces = _per_cell(slots, "_from", "_to", block).join(_per_cell(places, "_a", "_b", block), ["_src", "_cell"]).filter(low < high)
    return docs, pieces.select("slot", "pass", "_src", "start", (low - F.col("start")).alias("from_word"), (high - F.col("start")).alias("to_word"))


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot, n_slots of every row of docs (doc_id, text, source).

    first_slot: the schedule's first slot that takes words of the document (NULL if none), n_slots: how many do.
    """
    sized = store(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("source", "text").alias("_hash")), "sizes")
    placed, pieces = mix(sized)
    took = pieces.groupBy("_src", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), F.min("slot").alias("first_slot"), F.count_distinct("slot").alias("n_slots"))
    with_words = placed.filter("size > 0").join(took, ["_src", "start"], "left")
    every = with_words.unionByName(placed.filter("size = 0"), allowMissingColumns=True)
    none = F.lit(0).cast("long")
    return every.select("doc_id", "size", "source_size", F.col("target").cast("double"), F.coalesce("taken", none).alias("taken"), "first_slot", F.coalesce("n_slots", none).alias("n_slots"))


def _cut(text: Column, from_word: Column, to_word: Column) -> Column:
    """The text from the start of word from_word to the end of the word before to_word, white space kept."""
    long = lambda x: F.lit(x).cast("long")
    zero = F.struct(long(0).alias("at"), long(0).alias("n"), long(0).alias("a"), long(0).alias("b"))

    def step(acc: Column, x: Column) -> Column:
        word, size = x != "", F.length(x).cast("long")
        return F.struct(
            (acc["at"] + size + 1).alias("at"),
            (acc["n"] + word.cast("long")).alias("n"),
            F.when(word & (acc["n"] == from_word), acc["at"]).otherwise(acc["a"]).alias("a"),
            F.when(word & (acc["n"] + 1 == to_word), acc["at"] + size).otherwise(acc["b"]).alias("b"),
        )

    ends = F.aggregate(F.split(blank_to_space(text), " ", -1), zero, step)
    return F.substring(text, (ends["a"] + 1).cast("int"), (ends["b"] - ends["a"]).cast("int"))


def mixed_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The mixture as rows of docs, in the order of the schedule's slots: one for each pass over a document, at its first slot there.

    A text is cut where its source's target ends; n_chars, where docs has it, is then the cut text's.
    """
    spark, columns = docs.sparkSession, docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))
    rows = rows.select("row", F.coalesce(F.col("row.doc_id").cast("string"), F.lit("\0")).alias("_id"), F.xxhash64(F.col("row.source"), F.col("row")[text]).alias("_hash"))
    sized = store(rows.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), word_count(F.col("row")[text]).alias("size"), "_id", "_hash"), "sizes")
    placed, pieces = mix(sized)
    spans = pieces.groupBy("_src", "start", "pass").agg(F.min("slot").alias("_slot"), F.min("from_word").alias("_from"), F.max("to_word").alias("_to"))
    spans = store(spans.join(placed.filter("size > 0").select("_src", "start", "_id", "_hash", "size"), ["_src", "start"]).select("_src", "start", "pass", "_slot", "_from", "_to", "size", "_id", "_hash"), "spans")
    many = sized.groupBy("_id", "_hash").agg(F.count("*").alias("_rows"))
    joined = rows.join(spans.join(many, ["_id", "_hash"]), ["_id", "_hash"])
    # equal rows find the passes of all of them: keep each pass once
    once = joined.filter("_rows = 1").unionByName(joined.filter("_rows > 1").dropDuplicates(["_id", "_hash", "_src", "start", "pass"]))
    # slots take equal numbers of words, so equal runs of slots make equal partitions, each after the one before
    parts, last = int(spark.conf.get("spark.sql.shuffle.partitions")), spans.agg(F.max("_slot")).first()[0] or 0
    once = once.repartitionById(parts, F.floor(F.col("_slot") * parts / (last + 1)).cast("int")).sortWithinPartitions("_slot", "_src", "start", "pass")
    whole = (F.col("_from") == 0) & (F.col("_to") == F.col("size"))
    made = F.when(whole, F.col("row")[text]).otherwise(_cut(F.col("row")[text], F.col("_from"), F.col("_to")))
    cells = {c: F.col("row")[c] for c in columns} | {text: made}
    if "n_chars" in columns:
        cells["n_chars"] = F.when(whole, F.col("row.n_chars")).otherwise(F.length(made).cast("long"))
    return once.select(*(c.alias(k) for k, c in cells.items()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: what the mixture takes of every document, and where in the schedule."""
    return mixed_sizes(documents(spark, sf_dir).select("doc_id", "text", "source"))
