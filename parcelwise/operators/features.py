"""Dummies, interactions, standardisation, principal components and the design matrix."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, ElementwiseProduct, OneHotEncoder, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelwise.functions.columns import all_present
from parcelwise.functions.small import checkpointed, fetch_small

MAX_LEVELS = 10_000


def category_levels(df: DataFrame, columns: Sequence[str], limit: int = MAX_LEVELS) -> dict[str, list]:
    """Sorted levels of each category, found in one scan; refuses more than ``limit`` levels in all."""
    if not columns:
        return {}
    entries = [F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns]
    found = fetch_small(df.select(F.inline(F.array(*entries))).where(all_present("v")).distinct(), limit)
    if found is None:
        raise ValueError(f"more than {limit} levels in {list(columns)}: too many for dummies")
    return {c: sorted(r["v"] for r in found if r["c"] == c) for c in columns}


def dummy_columns(levels: dict[str, list]) -> dict[str, Column]:
    """One 0/1 column per level but the first of each category; null is 0 everywhere."""
    return {
        f"{c}_{v}": F.when(F.col(c).cast("string") == v, 1).otherwise(0).cast("tinyint")
        for c, found in levels.items()
        for v in found[1:]
    }


def one_hot(
    df: DataFrame, columns: Sequence[str], levels: dict[str, list] | None = None, max_levels: int = MAX_LEVELS
) -> DataFrame:
    """Replace categories by their dummies: a column each, hence the limit to their number."""
    levels = levels or category_levels(df, columns, max_levels)
    kept = [F.col(c) for c in df.columns if c not in columns]
    return df.select(*kept, *[expr.alias(name) for name, expr in dummy_columns(levels).items()])


def interaction_columns(columns: Sequence[str]) -> dict[str, Column]:
    """Products of every two columns, named "a b"; a missing factor counts as 0."""
    value = {c: F.coalesce(F.col(c).cast("double"), F.lit(0).cast("double")) for c in columns}
    return {f"{a} {b}": value[a] * value[b] for a, b in combinations(columns, 2)}


def with_interactions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns(interaction_columns(columns))


def standardized(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Columns with mean 0 and population deviation 1; a constant column becomes 0."""
    rows = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    stats = rows.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
        )
    ).scalar()
    scaled = [
        F.when(stats[f"s_{c}"] > 0, (F.col(c) - stats[f"m_{c}"]) / stats[f"s_{c}"])
        .when(F.col(c).isNotNull(), F.lit(0).cast("double"))
        .alias(c)
        for c in columns
    ]
    return rows.select(*keep, *scaled)


class Design:
    """Turns order lines into feature vectors: numbers, interactions, dummies, in this order."""

    def __init__(
        self, numeric: Sequence[str], levels: dict[str, list], interactions: Sequence[str] = (), keep: Sequence[str] = ()
    ):
        self.numeric = list(numeric)
        self.levels = levels
        self.interactions = list(interactions)
        self.keep = list(keep)
        self.names = [
            *self.numeric,
            *[f"{a} {b}" for a, b in combinations(self.interactions, 2)],
            *[f"{c}_{v}" for c, found in levels.items() for v in found[1:]],
        ]
        self.numbers = len(self.numeric) + len(self.interactions) * (len(self.interactions) - 1) // 2

    @property
    def _dummies(self) -> dict[str, list]:
        return {c: found[1:] for c, found in self.levels.items() if len(found) > 1}

    def apply(self, df: DataFrame) -> DataFrame:
        """Rows with ``keep`` columns and ``raw``, the unscaled vector. Missing numbers count as 0."""
        return self.assembled(self.coded(df))

    def coded(self, df: DataFrame) -> DataFrame:
        """The rows as numbers, with one for each category: a fraction of the vectors' size, for :meth:`assembled`."""
        zero = F.lit(0).cast("double")
        columns = [F.coalesce(F.col(c).cast("double"), zero).alias(f"_n{i}") for i, c in enumerate(self._factors)]
        # a category is one number, its dummy's place, and then one vector: a column for each dummy makes code too long to compile
        for i, (c, found) in enumerate(self._dummies.items()):
            place = F.array_position(F.lit(found), F.col(c).cast("string"))
            columns.append(F.when(place > 0, place - 1).otherwise(len(found)).cast("int").alias(f"_c{i}"))
        return df.select(*self.keep, *columns)

    @property
    def _factors(self) -> list[str]:
        """Columns that numbers and interactions are made of."""
        return [*self.numeric, *[c for c in self.interactions if c not in self.numeric]]

    def assembled(self, coded: DataFrame) -> DataFrame:
        """The vectors of :meth:`coded` rows."""
        place = {c: f"_n{i}" for i, c in enumerate(self._factors)}
        products = [F.col(place[a]) * F.col(place[b]) for a, b in combinations(self.interactions, 2)]
        inputs, made_products = [place[c] for c in self.numeric], [f"_p{i}" for i in range(len(products))]
        dummies = self._dummies
        codes, made = [f"_c{i}" for i in range(len(dummies))], [f"_d{i}" for i in range(len(dummies))]
        numbers = [*inputs, *[e.alias(name) for name, e in zip(made_products, products)]]
        rows = coded.select(*self.keep, *numbers, *[F.col(c).cast("double").alias(c) for c in codes])
        if dummies:
            none = tuple(float(len(found)) for found in dummies.values())
            last = coded.sparkSession.createDataFrame([none], ", ".join(f"{code} double" for code in codes))
            rows = OneHotEncoder(inputCols=codes, outputCols=made, dropLast=True).fit(last).transform(rows)
        assembled = VectorAssembler(inputCols=[*inputs, *made_products, *made], outputCol="raw").transform(rows)
        # without the attributes of dummies, which trees would take for categories
        return assembled.select(*self.keep, F.col("raw").alias("raw", metadata={"entries": "numbers"}))


def fit_scaler(train: DataFrame, raw: str = "raw", out: str = "features", rows: int | None = None) -> PipelineModel:
    """Standardise a vector column by population deviation; constant entries become 0."""
    n = rows if rows is not None else train.count()
    scaler = StandardScaler(withMean=True, withStd=True, inputCol=raw, outputCol="_sample").fit(train)
    return PipelineModel(stages=[scaler, _to_population(len(scaler.mean), n, "_sample", out)])


def _to_population(size: int, n: int, column: str, out: str) -> ElementwiseProduct:
    """The built-in scaler divides by the sample deviation."""
    factor = float(np.sqrt(n / (n - 1))) if n > 1 else 1.0
    return ElementwiseProduct(scalingVec=[factor] * size, inputCol=column, outputCol=out)


class SparseScaler:
    """Standardises the first ``numbers`` entries of a vector and only scales the others, the dummies.

    So vectors stay sparse. Neither distances nor a model with a free intercept change by leaving dummies uncentred;
    numbers with large means would make the fit ill-conditioned.
    """

    def __init__(self, train: DataFrame, numbers: int, rows: int, raw: str = "raw", out: str = "features"):
        first = train.select(raw).first()
        size = first[0].size if first else numbers
        parts = [("_numbers", list(range(numbers)), True), ("_dummies", list(range(numbers, size)), False)]
        stages, made = [], []
        for name, entries, centred in parts:
            if entries:
                scaler = StandardScaler(withMean=centred, withStd=True, inputCol=name, outputCol=f"{name}_scaled")
                stages += [VectorSlicer(inputCol=raw, outputCol=name, indices=entries), scaler]
                made += [name, f"{name}_scaled"]
        stages.append(VectorAssembler(inputCols=made[1::2], outputCol="_sample"))
        stages.append(_to_population(size, rows, "_sample", out))
        self.made = [*made, "_sample"]
        self.model = Pipeline(stages=stages).fit(train)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df).drop(*self.made)


def principal_components(df: DataFrame, columns: Sequence[str], k: int = 10) -> tuple[PipelineModel, DataFrame]:
    """PCA of standardised numbers: the fitted pipeline and ``(component, explained, cumulative)``.

    The sign of a component is arbitrary; :func:`project` fixes it so that its largest loading is positive.
    """
    k = min(k, len(columns))
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0).cast("double")).alias(c) for c in columns])
    assembler = VectorAssembler(inputCols=list(columns), outputCol="raw")
    vectors = assembler.transform(filled).select("raw").persist()
    try:
        scaler = fit_scaler(vectors)
        pca = PCA(k=k, inputCol="features", outputCol="pcs").fit(scaler.transform(vectors))
    finally:
        vectors.unpersist()
    shares = [float(v) for v in pca.explainedVariance.toArray()]
    total = np.cumsum(shares)
    table = df.sparkSession.createDataFrame(
        [(i + 1, shares[i], float(total[i])) for i in range(k)], "component int, explained double, cumulative double"
    )
    return PipelineModel(stages=[assembler, *scaler.stages, pca]), table


def project(df: DataFrame, model: PipelineModel, columns: Sequence[str], keep: Sequence[str], n: int = 2) -> DataFrame:
    """The first n components of every row, as ``pc1 ... pcn``."""
    loadings = model.stages[-1].pc.toArray()
    signs = [float(np.sign(loadings[np.abs(loadings[:, i]).argmax(), i])) or 1.0 for i in range(n)]
    filled = df.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0).cast("double")).alias(c) for c in columns])
    scores = vector_to_array(F.col("pcs"))
    return model.transform(filled).select(*keep, *[(scores[i] * signs[i]).alias(f"pc{i + 1}") for i in range(n)])


def level_places(df: DataFrame, columns: Sequence[str], start: int = 0) -> DataFrame:
    """``(category, level, place)``: places of the dummies of all categories from ``start`` on, as a table.

    As with :func:`category_levels`, levels are in order and the first of each category has no dummy; there may be any
    number of them. A category's distinct levels are numbered by one task.
    """
    entries = [F.struct(F.lit(i).alias("_i"), F.lit(c).alias("category"), F.col(c).cast("string").alias("level")) for i, c in enumerate(columns)]
    levels = df.select(F.inline(F.array(*entries))).where(all_present("level")).distinct()
    ranked = checkpointed(levels.withColumn("_rank", F.row_number().over(W.partitionBy("category").orderBy("level")) - 1))
    sizes = ranked.groupBy("_i").agg(F.max("_rank").alias("_size"))  # a row for each category
    offset = F.coalesce(F.sum("_size").over(W.orderBy("_i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = ranked.where("_rank > 0").join(F.broadcast(sizes.select("_i", offset.alias("_offset"))), "_i")
    return checkpointed(places.select("category", "level", (F.col("_offset") + F.col("_rank") - 1 + start).alias("place")))


def sparse_design(
    df: DataFrame, numeric: Sequence[str], categories: Sequence[str], interactions: Sequence[str], keep: Sequence[str]
) -> tuple[DataFrame, DataFrame, int, int]:
    """Rows with ``keep``, ``places`` and ``values``; the places of all features by name; their number; that of numbers.

    The vectors of :class:`Design` without a column or branch for each dummy: a category's levels are joined from
    :func:`level_places`, so their number is bounded by what a model can hold. Missing numbers count as 0; a null or the
    first level has no entry.
    """
    zero = F.lit(0).cast("double")
    numbers = {c: F.coalesce(F.col(c).cast("double"), zero) for c in numeric} | interaction_columns(interactions)
    table = level_places(df, categories, len(numbers))
    for i, c in enumerate(categories):
        own = table.where(F.col("category") == c).select(F.col("level").alias("_level"), F.col("place").alias(f"_place{i}"))
        df = df.join(own, F.col(c).cast("string") == F.col("_level"), "left").drop("_level")
    # ends of the numbers' places and values meet the dummies'
    dummies = F.array_compact(F.array(*[F.col(f"_place{i}").cast("long") for i in range(len(categories))]))
    places = F.concat(F.array(*[F.lit(i).cast("long") for i in range(len(numbers))]), dummies)
    values = F.concat(F.array(*numbers.values()), F.transform(dummies, lambda _: F.lit(1).cast("double")))
    rows = df.select(*keep, places.alias("places"), values.alias("values"))
    first = df.sparkSession.createDataFrame([*zip(numbers, range(len(numbers)))], "feature string, place long")
    names = first.unionByName(table.select(F.concat_ws("_", "category", "level").alias("feature"), F.col("place").cast("long").alias("place")))
    return rows, names, len(numbers) + table.count(), len(numbers)
