"""Feature blocks: built by name, standardised with training statistics, assembled by weight."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuemill.functions import scalars as S
from queuemill.functions import text as X
from queuemill.functions import vectors as VX
from queuemill.runtime import rounded

MAX_VOCABULARY = 10_000


def literal_array(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def fit_vocabulary(train: DataFrame, column: str) -> list[str]:
    """Sorted distinct values: a model parameter, so it must stay small and is checked."""
    rows = train.select(F.coalesce(column, F.lit("")).alias("v")).distinct().limit(MAX_VOCABULARY + 1).collect()
    if len(rows) > MAX_VOCABULARY:
        raise ValueError(f"{column} has more than {MAX_VOCABULARY} distinct values")
    return sorted(r.v for r in rows)


# Blocks by name: a builder takes the fitted vocabulary and returns an array column.
BLOCKS = {
    "dept": lambda vocabulary: S.one_hot(F.col("department"), literal_array(vocabulary)),
    "time": lambda vocabulary: S.time_features(F.col("created")),
    "shape": lambda vocabulary: S.text_shape(F.col("subject"), F.col("description")),
}


def raw_blocks(tickets: DataFrame, vocabulary: list[str], names=tuple(BLOCKS)) -> DataFrame:
    return tickets.withColumns({name: BLOCKS[name](vocabulary) for name in names})


def standardise_fit(df: DataFrame, blocks: list[str]) -> DataFrame:
    """Mean and population standard deviation per block and dimension; a constant scales by 1."""
    tagged = F.array(*[F.struct(F.lit(b).alias("block"), F.col(b).alias("v")) for b in blocks])
    cells = (df.select(F.explode(tagged).alias("t"))
             .select("t.block", F.posexplode("t.v").alias("dim", "x")))
    spread = F.stddev_pop("x")
    return cells.groupBy("block", F.col("dim").cast("long").alias("dim")).agg(
        F.avg("x").alias("mean"), F.when(spread < 1e-12, 1.0).otherwise(spread).alias("std"))


def statistics(df: DataFrame, blocks: list[str]) -> dict[str, tuple[list[float], list[float]]]:
    """The fitted statistics as model parameters: one pair of numbers per dimension."""
    out: dict = {b: ([], []) for b in blocks}
    for r in standardise_fit(df, blocks).orderBy("block", "dim").collect():
        out[r.block][0].append(r["mean"])
        out[r.block][1].append(r["std"])
    return out


def apply_statistics(vector: Column, fitted, unitise: bool = True) -> Column:
    mean, std = fitted
    # What a rounded mean leaves of a constant is no signal; a head that scales its features by their spread would blow it up.
    scaled = F.transform(VX.standardised(vector, literal_array(mean), literal_array(std)), lambda x: F.when(F.abs(x) < 1e-12, 0.0).otherwise(x))
    return VX.unit(scaled) if unitise else scaled


@dataclass
class ContextBlocks:
    """Vocabulary and statistics of the training rows; applied unchanged to any other row."""

    vocabulary: list[str]
    stats: dict

    @classmethod
    def fit(cls, train: DataFrame) -> "ContextBlocks":
        vocabulary = fit_vocabulary(train, "department")
        return cls(vocabulary, statistics(raw_blocks(train, vocabulary), list(BLOCKS)))

    def transform(self, tickets: DataFrame, unitise: bool = True) -> DataFrame:
        raw = raw_blocks(tickets, self.vocabulary)
        return raw.withColumns({b: apply_statistics(F.col(b), self.stats[b], unitise) for b in BLOCKS})

    def fit_extra(self, name: str, df: DataFrame) -> "ContextBlocks":
        """Scaling of a block that another job produced, fitted on its out-of-fold rows."""
        return ContextBlocks(self.vocabulary, {**self.stats, **statistics(df, [name])})

    def apply_extra(self, name: str, df: DataFrame) -> DataFrame:
        return df.withColumn(name, apply_statistics(F.col(name), self.stats[name]))


def assemble(keys: list[str], alpha: float = 0.3) -> Column:
    """The chosen blocks side by side; `text` keeps its norm, the others are scaled by alpha."""
    return F.concat(*[F.col(k) if k == "text" else VX.scaled(F.col(k), F.lit(alpha)) for k in keys])


def features_for(tickets: DataFrame, fitter: ContextBlocks, keys: list[str], alpha: float) -> DataFrame:
    return fitter.transform(tickets).withColumn("features", assemble(keys, alpha))


def ticket_frame(tickets: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Query rows with defaults: blank texts and department, the current time when none is given."""
    now = as_of if as_of is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm")
    blank = {c: F.coalesce(c, F.lit("")) for c in ("subject", "description", "department")}
    filled = tickets.withColumns({**blank, "created": F.coalesce(F.nullif(F.col("created"), F.lit("")), now)})
    return filled.withColumn("text", X.build_text(F.col("subject"), F.col("description")))


def long_blocks(df: DataFrame, blocks: list[str], key: str = "ord") -> DataFrame:
    tagged = F.array(*[F.struct(F.lit(b).alias("block"), F.col(b).alias("v")) for b in blocks])
    cells = df.select(key, F.explode(tagged).alias("t")).select(key, "t.block", F.posexplode("t.v").alias("dim", "x"))
    return cells.select(key, "block", F.col("dim").cast("long").alias("dim"), rounded(F.col("x")).alias("value"))
