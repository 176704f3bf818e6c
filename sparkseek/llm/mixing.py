"""Mixing sources to target weights by systematic sampling. Built-in functions only.

Every source's documents are put in one order, each with the same expected number of copies, its
source's target over its source's size. One random offset is added to the running sum of
expected copies, and a document is emitted once for each whole number that its share of the sum crosses.
In an order by size, what is taken differs from the target by little more than one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: How often a source may repeat itself.
MOST_COPIES = 3
#: Parts in which the documents of one source and size class are numbered; each is a window's partition.
PARTS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Sixteen classes for each power of two, in the order of sizes; at most 1,024."""
    length = F.length(F.bin(size))
    top = F.expr("shiftright({0}, greatest(length(bin({0})) - 5, 0))".format("size"))
    return F.when(size < 16, size).otherwise(length * 16 + top - 16).cast("int")


def hash_fraction(text: Column) -> Column:
    """A number of [0, 1) from the first 32 bits of a digest."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight, each at most `most` times its size.

    What a source cannot take is shared among the others by weight until none is above its limit. In the
    order of limit over weight, the full sources are the first ones, so one pass finds all of them.
    """
    ranked = sizes.withColumn(
        "weight",
        F.element_at(
            F.array(*[F.lit(w) for w in weights]),
            ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"),
        ).cast("long"),
    )
    order = Window.orderBy(
        (F.lit(most) * F.col("source_size")).cast("double") / F.col("weight"), F.col("source").asc_nulls_last()
    )
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    limit = (F.lit(most) * F.col("source_size")).cast("double")
    steps = (
        ranked.withColumn("position", F.row_number().over(order))
        .withColumn("room", F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0.0)))
        .withColumn("heft", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("full", limit * F.col("heft") <= F.col("weight") * F.col("room"))
    )
    # The first source that is not full sets the rate of itself and all that follow.
    rate = F.min(F.when(~F.col("full"), F.struct("position", "room", "heft"))).over(everything)
    shared = F.col("weight") * F.col("rate.room") / F.col("rate.heft")
    return steps.withColumn("rate", rate).select(
        "source",
        "source_size",
        F.when(F.col("rate").isNull() | (F.col("position") < F.col("rate.position")), limit)
        .otherwise(shared)
        .alias("target"),
    )


def mix(
    documents: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_COPIES,
    seed: str = "mix",
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    whole_rows: bool = False,
) -> DataFrame:
    """One row a document: doc_id, size, source, source_size, target, copies, taken.

    Size is the number of words, 0 for a null or empty text. Sources are ordered by code point, null
    last, and null is a source like others. Documents of the same id and size are numbered in turn, so that
    repeated rows count as often as they occur; reruns agree. The order within a source is by size class,
    then by a hash of the id, then by size and id. No rows: no rows. With whole_rows, the given row
    comes back as the struct column `row`, moved once with its number; else other columns are ignored.
    """
    rows = documents.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_column)), F.lit("")).alias("s"),
        word_count(F.col(text_column)).alias("size"),
        *([F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")] if whole_rows else []),
    )
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = rows.withColumns(
        {"class": size_class(F.col("size")), "part": F.floor(hash_fraction(key) * PARTS).cast("int")}
    )
    parts = rows.groupBy("s", "class", "part").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    classes = parts.groupBy("s", "class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    sizes = classes.groupBy("s").agg(F.sum("words").alias("source_size"))
    sizes = sizes.select(F.when(F.col("s") != "", F.substring("s", 2, 1 << 30)).alias("source"), "source_size")
    targets = source_targets(sizes, weights, most).select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("s"),
        "source",
        "source_size",
        "target",
        hash_fraction(F.concat(F.lit(seed), F.coalesce("source", F.lit("")))).alias("offset"),
    )

    def earlier(by: list[str], order: str) -> Column:
        window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(window), F.lit(0))

    # Where the numbering of each part begins: classes of a source, then parts of a class; both are few.
    begins = (
        parts.withColumn("in_class", earlier(["s", "class"], "part"))
        .select("s", "class", "part", "in_class")
        .join(classes.select("s", "class", earlier(["s"], "class").alias("in_source")), ["s", "class"])
        .join(targets, "s")
        .withColumn("begin", F.col("in_class") + F.col("in_source"))
        .drop("in_class", "in_source")
    )
    numbered = rows.withColumn("rank", F.row_number().over(Window.partitionBy("s", "class", "part").orderBy("size", "doc_id")))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    position = F.col("begin") + F.col("rank")
    crossed = F.floor(expected * position + F.col("offset")) - F.floor(expected * (position - 1) + F.col("offset"))
    return (
        numbered.join(begins, ["s", "class", "part"])
        .withColumn("copies", crossed.cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select(
            "doc_id", "size", "source", "source_size", "target", "copies", "taken", *(["row"] if whole_rows else [])
        )
    )


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The documents with all their columns, each row as often as the mix takes it."""
    taken = mix(documents, whole_rows=True, **options)
    return taken.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
