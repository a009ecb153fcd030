"""Source rows in one spelling, their order, the training cap and the balanced evaluation rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import label
from ..schema import GENDERS, PROFESSIONS


def source_rows(rows: DataFrame, order_col: str | None = "loaded_at", *, columns: tuple[str, ...] | None = None) -> DataFrame:
    """One row an id, the last delivered; split, profession and gender in one spelling; `ordinal` from the id.

    columns: what is kept beside the id (all without it); only that is read and shuffled.  Of rows delivered at the same time
    the largest by these columns counts.  The split dev is named validation.  Rows with null id are left out."""
    kept = [c for c in rows.columns if c not in ("id", "ordinal", order_col) and (columns is None or c in columns)]
    at = F.col(order_col) if order_col in rows.columns else F.lit(0)
    one = rows.where("id is not null").groupBy("id").agg(F.max(F.struct(at.alias("_at"), *kept)).alias("r")).select("id", *(f"r.{c}" for c in kept))
    split = F.lower(F.trim("split"))
    spelt = {"split": F.when(split == "dev", "validation").otherwise(split), "profession": label(F.col("profession")), "gender": F.lower(F.trim("gender"))}
    return one.withColumns({c: x for c, x in spelt.items() if c in kept} | {"ordinal": F.try_element_at(F.split("id", ":"), F.lit(3)).cast("long")})


def with_train_order(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """rows with train_order counted from 0 in the order of the ordinals, null outside the training split.

    The ordinals are cut into ranges that hold about as many rows each; each is ranked by itself, from the number of rows before it."""
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    train = F.col("split") == "train"
    shares = [i / ranges for i in range(1, ranges)]
    bounds = rows.where(train).agg(F.percentile_approx("ordinal", F.array(*map(F.lit, shares)))).first()[0] if shares else None
    bounds = sorted(set(bounds or []))
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.coalesce("ordinal", F.lit(-1)))) if bounds else F.lit(0)
    ranged = rows.withColumn("_range", F.when(train, at))
    before, sizes = {}, {r[0]: r[1] for r in ranged.where(train).groupBy("_range").count().collect()}  # a row a range
    for i in sorted(sizes):
        before[i] = sum(n for j, n in sizes.items() if j < i)
    start = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))[F.col("_range")] if before else F.lit(0)
    # other rows are not ranked, so they are spread instead of sharing the null range
    key = F.coalesce("_range", -1 - F.pmod(F.hash("id"), F.lit(ranges)))
    order = F.row_number().over(Window.partitionBy(key).orderBy("ordinal", "id")) - 1 + start
    return ranged.withColumn("train_order", F.when(train, order)).drop("_range")


def of_professions(rows: DataFrame, professions: tuple[str, ...] = PROFESSIONS) -> DataFrame:
    return rows.where(F.col("profession").isin(*professions) & F.col("gender").isin(*GENDERS))


def require_splits(rows: DataFrame, splits: tuple[str, ...]) -> None:
    """Fails if a split has no row."""
    seen = {r[0] for r in rows.groupBy("split").count().select("split").collect()}
    if missing := sorted(set(splits) - seen):
        raise ValueError(f"splits without rows: {', '.join(missing)}")


def train_cap(rows: DataFrame, size: int | None) -> DataFrame:
    """The first `size` training rows by ordinal; all for None.  Only the positions are ranked, and within a range of ordinals at once."""
    train = rows.where(F.col("split") == "train")
    if size is None:
        return train
    last = train.select("ordinal", "id").orderBy("ordinal", "id").limit(size).agg(F.max(F.struct("ordinal", "id")).alias("last"), F.count("*").alias("n")).first()
    if last["n"] < size:
        raise ValueError(f"{size} training rows are asked for; there are {last['n']}")
    at, name = last["last"]
    return train.where((F.col("ordinal") < at) | ((F.col("ordinal") == at) & (F.col("id") <= name)))


def pool_filter(train: DataFrame, professions: tuple[str, ...]) -> str:
    """The predicate that picks the rows of a training pool from a vector table."""
    last = train.agg(F.max("train_order")).first()[0]
    names = ", ".join(f"'{p}'" for p in professions)
    return f"profession in ({names}) and train_order <= {-1 if last is None else last}"


def cells(spark, professions=PROFESSIONS, genders=GENDERS) -> DataFrame:
    """Every profession with every gender, also where no row has them."""
    rows = [(p, g, i, j) for i, p in enumerate(professions) for j, g in enumerate(genders)]
    return spark.createDataFrame(rows, "profession string, gender string, profession_index int, gender_index int")


def max_balanced(rows: DataFrame, split: str, professions=PROFESSIONS) -> DataFrame:
    """(rows_per_cell, empty_cells): rows of the smallest cell of a split, 0 if a cell is empty."""
    n = rows.where(F.col("split") == split).groupBy("profession", "gender").agg(F.count("*").alias("n"))
    spine = F.broadcast(cells(rows.sparkSession, professions)).join(n, ["profession", "gender"], "left")
    return spine.agg(F.min(F.coalesce("n", F.lit(0))).alias("rows_per_cell"), F.sum(F.col("n").isNull().cast("long")).alias("empty_cells"))


def balanced_sample(rows: DataFrame, split: str, per_cell: int) -> DataFrame:
    """The first per_cell rows by ordinal of each profession and gender, with their place in the cell."""
    w = Window.partitionBy("profession", "gender").orderBy("ordinal", "id")
    return rows.where(F.col("split") == split).withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_cell)


def require_cells(sample: DataFrame, per_cell: int, professions=PROFESSIONS) -> None:
    short = F.broadcast(cells(sample.sparkSession, professions)).join(sample.groupBy("profession", "gender").count(), ["profession", "gender"], "left").where(F.coalesce("count", F.lit(0)) < per_cell)
    if (found := short.select("profession", "gender").first()) is not None:
        raise ValueError(f"fewer than {per_cell} rows for {found[0]}, {found[1]}")


def by_length(rows: DataFrame) -> DataFrame:
    """Longest texts first and then by train_order, the order in which vectors are made and ties are broken."""
    return rows.orderBy(F.length("hard_text").desc(), "train_order")
