"""Mixing sources to target weights: random order within each source, distributed prefix sums, exact cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotspan.storage import write_once

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words in a text; null and blank texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(row: Sequence[Column], seed: str) -> Column:
    """Hash-random sort key of a row, the same in every run and on every engine that has MD5."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in row]))


def running_totals(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Add ``before``: the sum of ``value`` over the rows of the same ``by`` that come earlier in ``order``.

    Rows are range-sorted once over (by, order), so that a large group spans many partitions; sums per partition give
    each partition its offset. No task sees more than its own partition. Rows equal in ``order`` may swap places.
    """
    ranged = write_once(df.repartitionByRange(*[F.col(c) for c in (*by, *order)]).withColumn(
        "_part", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "_part").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (*by, "_part")]
    joined = ranged.alias("r").join(offsets.alias("o"), same).select("r.*", "o._offset")
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return joined.withColumn("before", before.cast("long")).drop("_part", "_offset")


def source_budgets(sources: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """(source, source_size) -> with ``target`` (double) and ``budget`` (whole words).

    Sources in code point order, null last, weigh ``weights`` in turn. Together the targets are ``share`` of all sizes;
    a target stops at ``most`` times its source's size and the excess goes to the others by weight, until none is above.
    The water level is found by a few scalar aggregates, one per round of capping.
    """
    spark = sources.sparkSession
    ones = sources.select("source", "source_size", F.col("source").isNull().alias("_last"), F.lit(1).alias("_one"))
    ranked = running_totals(ones.withColumn("_all", F.lit(0)), ["_all"], ["_last", "source"], "_one")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("before", F.lit(len(weights))).cast("int"))
    table = write_once(ranked.select("source", "source_size", weight.alias("weight"),
                                     (F.col("source_size") * F.lit(most)).alias("cap")))
    total, all_weights = table.agg(F.sum("source_size"), F.sum("weight")).first()
    level, capped = None, -1
    while total:
        full = F.col("cap") < F.col("weight") * F.lit(level) if level is not None else F.lit(False)
        count, taken, used = table.agg(
            F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(full, F.col("weight"))), F.lit(0.0))).first()
        if count == capped:
            break
        level, capped = (share * total - taken) / (all_weights - used) if all_weights > used else level, count
    target = F.least(F.col("weight") * F.lit(level), F.col("cap")) if total else F.lit(0.0)
    with_target = table.withColumn("target", target)
    return with_target.select("source", "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("budget"))


def _sized(docs: DataFrame, doc_id: str, text: str, source: str, seed: str) -> DataFrame:
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                        word_count(F.col(text)).alias("size"))
    return sized.withColumn("_key", random_key([F.col("doc_id"), F.col("size")], seed))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix-0",
        weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken, epochs, rest.

    A source's words are taken in hash-random order, whole epochs first; the last epoch stops at the exact budget, so
    ``taken = epochs * size + rest`` and the taken words of a source add up to its rounded target. ``rest`` is below
    ``size`` only for the one document at the cut and for those after it.

    Null or blank texts have size 0 and nothing is taken from them. A null source is a source of its own; null ids are
    ordinary ids. Repeated rows count as often as they occur. An empty table gives an empty result. Only the three
    named columns are read, so further columns cannot clash.
    """
    sized = write_once(_sized(docs, doc_id, text, source, seed))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    budgets = write_once(source_budgets(sources, weights, share, most))
    ordered = running_totals(sized, ["source"], ["_key"], "size")
    same = F.col("d.source").eqNullSafe(F.col("b.source"))
    rows = ordered.alias("d").join(budgets.alias("b"), same).select("d.*", "b.source_size", "b.target", "b.budget")
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0)
    rest = F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("before")
    cut = rows.withColumn("epochs", epochs).withColumn("rest", F.greatest(F.lit(0), F.least(rest, F.col("size"))))
    return cut.select("doc_id", "size", "source", "source_size", "target",
                      (F.col("epochs") * F.col("size") + F.col("rest")).alias("taken"), "epochs", "rest")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                    seed: str = "mix-0", **settings) -> DataFrame:
    """The documents of the mix with all their columns: one row per epoch, the one at the cut shortened to its words.

    What is taken of a document depends only on its key and on its source's cut, a table with one row per source, so
    the texts are not shuffled. Rows that share the key at the cut are told apart by numbering them.
    Documents without words are in every whole epoch of their source, and nowhere if there is none. Columns of any name are kept:
    the documents travel as one struct beside the columns made here.
    """
    plan = write_once(mix(docs, doc_id, text, source, seed, **settings).withColumn(
        "_key", random_key([F.col("doc_id"), F.col("size")], seed)))
    cuts = plan.groupBy("source").agg(
        F.max("epochs").alias("_epochs"), F.max(F.when(F.col("rest") > 0, F.col("_key"))).alias("_cut"))
    at_cut = F.col("p.source").eqNullSafe(F.col("c.source")) & (F.col("p._key") == F.col("c._cut"))
    left = plan.alias("p").join(cuts.alias("c"), at_cut).groupBy("p.source").agg(F.sum("p.rest").alias("_left"))
    cuts = write_once(cuts.alias("c").join(left.alias("l"), F.col("c.source").eqNullSafe(F.col("l.source")), "left").select(
        F.col("c.source").alias("_source"), "_epochs", "_cut", F.coalesce("_left", F.lit(0)).alias("_left")))
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), word_count(F.col(text)).alias("size"),
                         F.col(doc_id).alias("id"), F.col(source).alias("source"))
    marked = marked.withColumn("key", random_key([F.col("id"), F.col("size")], seed))
    marked = marked.join(cuts, F.col("source").eqNullSafe(F.col("_source")), "left")
    content = F.col("doc").getField(text)
    away = marked.where(F.col("_cut").isNull() | (F.col("key") != F.col("_cut")))
    away = away.withColumn("rest", F.when(F.col("key") < F.col("_cut"), F.col("size")).otherwise(0).cast("long"))
    number = F.row_number().over(Window.partitionBy("_source").orderBy(content))
    near = marked.where(F.col("key") == F.col("_cut"))
    near = near.withColumn("rest", F.greatest(F.lit(0), F.least("size", F.col("_left") - (number - 1) * F.col("size"))))
    rows = away.unionByName(near)
    copies = F.concat(F.array_repeat(F.col("size"), F.col("_epochs").cast("int")),
                      F.when(F.col("rest") > 0, F.array(F.col("rest"))).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("words", F.explode(copies))
    kept = F.when(F.col("words") == F.col("size"), content).otherwise(first_words(content, F.col("words")))
    return rows.select(*(kept.alias(c) if c == text else F.col("doc").getField(c).alias(c) for c in docs.columns))
