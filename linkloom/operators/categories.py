"""Categories of a text against the taxonomy: scores, ranking, normalisation and place in the tree.

The scorer writes the taxonomy's names out as literals; category_matches is for a taxonomy that is data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import half_even, let, words
from ..runtime import within

#: Names of a taxonomy given as data, at most.
MAX_NAMES = 10_000


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(vocab.taxonomy_rows(), "ord int, main string, sub string, name string, level string, weight int")


def points(c: Column) -> Column:
    """ARRAY of points, one for each main category in the taxonomy's order."""

    def of(low: Column) -> Column:
        by_main: dict[str, Column] = {}
        for _, main, _, name, _, weight in vocab.taxonomy_rows():
            own = F.when(F.contains(low, F.lit(name.lower())), weight).otherwise(0)
            by_main[main] = by_main[main] + own if main in by_main else own
        return F.array(*by_main.values())

    return let(F.lower(F.coalesce(c, F.lit(""))), of)


def by_keywords(c: Column) -> Column:
    """struct(primary, secondary, confidence): main categories by points, ties in the taxonomy's order; Other and nothing
    where no name occurs, also for null. confidence has the points of all, at most 10."""
    names = F.array(*[F.lit(m) for m in vocab.TAXONOMY])

    def of(p: Column) -> Column:
        rows = F.filter(F.transform(p, lambda x, i: F.struct((-x).alias("less"), i.alias("ord"), F.get(names, i).alias("name"))), lambda r: r["less"] < 0)

        def ranked(r: Column) -> Column:
            confidence = F.map_from_entries(F.transform(r, lambda e: F.struct(e["name"].alias("key"), F.least(F.lit(10.0), (-e["less"]).cast("double")).alias("value"))))
            first = F.coalesce(F.get(r, F.lit(0))["name"], F.lit("Other"))
            return F.struct(first.alias("primary"), F.transform(F.slice(r, 2, 3), lambda e: e["name"]).alias("secondary"), confidence.alias("confidence"))

        return let(F.array_sort(rows), ranked)

    return let(points(c), of)


def category_list(primary: Column, secondary: Column) -> Column:
    return F.concat(F.array(primary), secondary)


def normalise(category: Column) -> Column:
    """The taxonomy's spelling: itself, else but for case, else the first name that contains it or that it contains,
    else Other. Null and empty are Other."""
    names = list(dict.fromkeys(name for _, _, _, name, _, _ in vocab.taxonomy_rows()))
    exact = F.when(category.isin(names), category)
    spelled: dict[str, str] = {}
    for n in names:
        spelled.setdefault(n.lower(), n)
    caseless = F.try_element_at(F.create_map(*[F.lit(x) for k, n in spelled.items() for x in (k, n)]), F.lower(category))
    part = let(F.lower(category), lambda low: F.get(F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(F.lower(n), low) | F.contains(low, F.lower(n))), F.lit(0)))
    return F.when(F.coalesce(category, F.lit("")) == "", "Other").otherwise(F.coalesce(exact, caseless, part, F.lit("Other")))


def places(df: DataFrame, category: str, key: str) -> DataFrame:
    """(key, category, main, kind, subcategory): where each category stands in the tree, by a hash join with the
    taxonomy. A name that stands in two places has two rows; one that is in none has no row."""
    dim = taxonomy(df.sparkSession).select(F.col("main"), F.col("name").alias("_name"), F.when(F.col("level") == "main", "main").otherwise("parent").alias("kind"), F.when(F.col("level") == "main", None).otherwise(F.col("name")).alias("subcategory"))
    return df.select(key, F.col(category).alias("category")).join(F.broadcast(dim), F.col("category") == F.col("_name")).select(key, "category", "main", "kind", "subcategory").distinct()  # the taxonomy has a fixed size


def category_matches(df: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """(key, main, points): the scorer for names given as data (main, name, weight).

    Every text is compared with every name where it stands, so the names go to all executors: more than MAX_NAMES raise
    ValueError. Null and empty texts have no row, nor have those without any name.
    """
    low = names.where("main IS NOT NULL AND name <> ''").select("main", F.lower("name").alias("_name"), "weight")
    if not within(low, MAX_NAMES):
        raise ValueError(f"more than {MAX_NAMES} names of categories")
    texts = df.select(key, F.lower(F.col(text)).alias("_low"))
    return texts.join(F.broadcast(low), F.contains(F.col("_low"), F.col("_name"))).groupBy(key, "main").agg(F.sum("weight").cast("bigint").alias("points"))


def suggest(df: DataFrame, text: str, least: int = 3, n: int = 10) -> DataFrame:
    """(word, n): words of more than 3 letters and nothing else that occur at least `least` times and name no category."""
    names = sorted({r[3].lower() for r in vocab.taxonomy_rows()})
    each = df.select(F.explode(words(F.lower(F.coalesce(F.col(text), F.lit(""))))).alias("word")).where((F.length("word") > 3) & F.col("word").rlike(r"^\p{L}+$") & ~F.col("word").isin(names))
    return each.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(n).select(F.initcap("word").alias("word"), "n")


def statistics(df: DataFrame, result: str = "category") -> DataFrame:
    """One row: total, mean of all confidences, distinct categories."""
    c = F.col(result)
    total = df.agg(F.count("*").alias("total_categorized"))
    mean = df.select(F.explode(F.map_values(c["confidence"])).alias("v")).agg(half_even(F.avg("v"), 2).alias("average_confidence"))
    kinds = df.select(F.explode(category_list(c["primary"], c["secondary"])).alias("k")).agg(F.count_distinct("k").alias("unique_categories"))
    return total.join(F.broadcast(mean), F.lit(True)).join(F.broadcast(kinds), F.lit(True))  # one row each
