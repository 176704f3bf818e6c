"""Checks of declared keys, as the tables' owner would enforce them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseek.sources.schemas import TABLES

NOT_NULL, KEY, REFERENCE = "not null", "key", "reference"


def check_constraints(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, constraint, key, violations) for every broken rule of the given tables.

    Duplicates and orphans are listed by key; missing values by column. Columns
    absent from a table are not checked. Each table is read once: a row gives what its rules look at, and that is
    counted within each task before it is moved, so a key with very many rows is no more work than others.
    """
    return reduce(DataFrame.unionByName, [_violations(name, rows, tables) for name, rows in tables.items()])


def _violations(name: str, rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    declared = TABLES[name]
    entries: list[Column] = []
    for kind, key in [("primary key", declared.primary_key), *(("unique", u) for u in declared.unique)]:
        if set(key) <= set(rows.columns):
            text = F.concat_ws("|", *[F.col(c).cast("string") for c in key])
            whole = F.to_json(F.array(*[F.col(c).cast("string") for c in key]))
            entries.append(_entry(KEY, f"{kind} ({', '.join(key)})", text, whole))
    for column in declared.required:
        if column in rows.columns:
            entries.append(_entry(NOT_NULL, NOT_NULL, F.when(F.col(column).isNull(), F.lit(column))))
    parents: list[DataFrame] = []
    for column, parent in declared.foreign_keys.items():
        if column in rows.columns and parent in tables:
            rule = f"foreign key ({column})"
            entries.append(_entry(REFERENCE, rule, F.col(column).cast("string")))
            parents.append(tables[parent].select(F.lit(rule).alias("constraint"), F.col("id").cast("string").alias("whole")))

    seen = rows.select(F.explode(F.filter(F.array(*entries), lambda e: e["whole"].isNotNull())).alias("e")).select("e.*")
    counts = seen.groupBy("kind", "constraint", "whole").agg(F.min("key").alias("key"), F.count("*").alias("violations"))
    broken = counts.filter((F.col("kind") == NOT_NULL) | ((F.col("kind") == KEY) & (F.col("violations") > 1)))
    if parents:
        known = reduce(DataFrame.unionAll, parents).withColumn("_known", F.lit(True)).distinct()
        marked = counts.join(known, ["constraint", "whole"], "left")
        repeated = (F.col("kind") == KEY) & (F.col("violations") > 1)
        orphaned = (F.col("kind") == REFERENCE) & F.col("_known").isNull()
        broken = marked.filter((F.col("kind") == NOT_NULL) | repeated | orphaned)
    return broken.select(F.lit(name).alias("table"), "constraint", "key", "violations")


def _entry(kind: str, rule: str, key: Column, whole: Column | None = None) -> Column:
    """What one rule looks at in a row; a null ``whole`` is nothing to look at."""
    return F.struct(
        F.lit(kind).alias("kind"), F.lit(rule).alias("constraint"), key.alias("key"), (key if whole is None else whole).alias("whole")
    )


FOLDER = "key_folder"
#: Folders that the kept keys of a rule are dealt to.
FOLDERS = 256
#: Hit folders that are named in the scan's own predicate.
MAX_LISTED_FOLDERS = 4_096


def _keys(name: str, rows: DataFrame) -> DataFrame:
    """(table, rule, kind, key, whole) of what the rules on keys look at in each row."""
    declared = TABLES[name]
    entries = []
    for kind, key in [("primary key", declared.primary_key), *(("unique", u) for u in declared.unique)]:
        if set(key) <= set(rows.columns):
            texts = [F.col(c).cast("string") for c in key]
            entries.append(_entry(KEY, f"{kind} ({', '.join(key)})", F.concat_ws("|", *texts), F.to_json(F.array(*texts))))
    for column in declared.foreign_keys:
        if column in rows.columns:
            text = F.col(column).cast("string")
            entries.append(_entry(REFERENCE, f"foreign key ({column})", text))
    seen = rows.select(F.explode(F.filter(F.array(*entries), lambda e: e["whole"].isNotNull())).alias("e")).select("e.*")
    return seen.groupBy("kind", "constraint", "whole").agg(F.min("key").alias("key"), F.count("*").alias("n")).withColumn("table", F.lit(name))


def _dealt(keys: DataFrame, folders: int) -> DataFrame:
    digest = F.xxhash64("table", "constraint", "whole")
    return keys.withColumns({"digest": digest, FOLDER: F.pmod(digest, F.lit(folders)).cast("int")})


def store_keys(tables: dict[str, DataFrame], path: str, mode: str = "append", folders: int = FOLDERS) -> None:
    """Keeps a row for each key of the tables (their primary and unique keys), dealt to folders by a hash of the key.

    With ``mode="append"`` the keys of a checked batch join those that are there.
    """
    keys = reduce(DataFrame.unionByName, [_keys(name, rows).filter(F.col("kind") == KEY) for name, rows in tables.items()])
    placed = _dealt(keys, folders).select("table", "constraint", "whole", "n", "digest", FOLDER)
    placed.hint("rebalance", FOLDER).sortWithinPartitions(FOLDER, "digest").write.mode(mode).partitionBy(FOLDER).parquet(path)


def _stored_keys(asked: DataFrame, path: str) -> DataFrame:
    """The kept keys in the folders that the asked ones fall in. Where these are few enough to list, only they are read."""
    spark = asked.sparkSession
    stored = spark.read.schema(f"table string, constraint string, whole string, n long, digest long, {FOLDER} int").parquet(path)
    hit = asked.select(FOLDER).distinct().limit(MAX_LISTED_FOLDERS + 1).toArrow()[FOLDER].to_pylist()
    return stored.filter(F.col(FOLDER).isin(hit)) if len(hit) <= MAX_LISTED_FOLDERS else stored


def check_new_rows(batch: dict[str, DataFrame], path: str, folders: int = FOLDERS) -> DataFrame:
    """``check_constraints`` of the rules that a batch of new rows breaks, against the keys kept in ``path`` and among the batch itself.

    Violations count the kept rows of a repeated key too, as a check of everything would. Of the kept keys only the folders that keys or
    references of the batch fall in are read, and of the stored tables nothing. ``folders`` is what the keys were stored with.
    """
    keys = reduce(DataFrame.unionByName, [_keys(name, rows) for name, rows in batch.items()])
    # A reference is asked for as the primary key that it names.
    primary = "primary key (id)"
    own = _dealt(keys.filter(F.col("kind") == KEY), folders)
    declared = [(name, f"foreign key ({c})", parent) for name in batch for c, parent in TABLES[name].foreign_keys.items()]
    named = own.sparkSession.createDataFrame(declared, "table string, constraint string, parent string")
    asked = keys.filter(F.col("kind") == REFERENCE).join(F.broadcast(named), ["table", "constraint"])
    as_key = asked.select(
        F.col("parent").alias("table"), F.lit(primary).alias("constraint"), F.to_json(F.array("whole")).alias("whole"),
        F.col("table").alias("child"), F.col("constraint").alias("rule"), F.col("key"), F.col("n").alias("violations"),
    )
    references = _dealt(as_key, folders)
    stored = _stored_keys(own.select(FOLDER).unionAll(references.select(FOLDER)), path)
    match = ["digest", "table", "constraint", "whole", FOLDER]

    # A batch may be stored in several appends: its keys are counts to be added up.
    before = stored.groupBy(*match).agg(F.sum("n").alias("_before"))
    repeated = own.join(before, match, "left").withColumn("violations", F.col("n") + F.coalesce("_before", F.lit(0))).filter("violations > 1")
    known = before.select(*match).unionAll(own.select(*match))
    orphans = references.join(known, match, "left_anti")
    empty = [
        rows.select(F.explode(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in TABLES[name].required if c in rows.columns])).alias("key"))
        .filter("key is not null").groupBy("key").agg(F.count("*").alias("violations"))
        .select(F.lit(name).alias("table"), F.lit(NOT_NULL).alias("constraint"), "key", "violations")
        for name, rows in batch.items()
    ]
    shown = ["table", "constraint", "key", "violations"]
    orphaned = orphans.select(F.col("child").alias("table"), F.col("rule").alias("constraint"), "key", "violations")
    return reduce(DataFrame.unionByName, [repeated.select(*shown), orphaned, *empty])
