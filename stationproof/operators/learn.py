"""Training the fault classifier and keeping models with a record of what they were fitted on."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationproof.functions.columns import CELL, lookup, union_all
from stationproof.operators import boosting, cv, fault
from stationproof.operators.boosting import Forest, Params
from stationproof.sources.sinks import children, exists

#: Rounds, learning rate, leaves and rows of a leaf.
PARAMS = Params(rounds=250, rate=0.05, leaves=31, min_rows=20, column_share=1.0, loss="logistic")


def training_table(features: DataFrame, marks: DataFrame) -> DataFrame:
    """Subtle classes only: planted drift, weather artefacts, none; other planted cells stay out."""
    planted = marks.where("signature IS NOT NULL").select(*CELL, F.col("fault_class").alias("_planted")).distinct()
    art = fault.artefacts(features).withColumn("_art", F.lit("meteorological_artefact"))
    y = features.join(planted, CELL, "left").join(art, CELL, "left").withColumn(
        "label_class", F.coalesce("_planted", "_art", F.lit("none"))
    )
    return y.where(F.col("label_class").isin(*fault.SUBTLE)).drop("_planted", "_art")


def balanced(table: DataFrame) -> DataFrame:
    """Weight n / (classes x class size). At most three classes exist, so they become constants."""
    sizes = {r["label_class"]: r["count"] for r in table.groupBy("label_class").count().collect()}
    total, k = sum(sizes.values()), max(1, len(sizes))
    weights = {c: total / (k * n) for c, n in sizes.items()}
    return table.withColumn("weight", lookup(weights, F.col("label_class"), 1.0))


class Classifier(NamedTuple):
    """One forest of logistic loss a class and fold: model number = fold x classes + class; fold 0 has seen every block."""

    forest: Forest
    classes: list[str]


def fit(table: DataFrame, params: Params = PARAMS, folds: int = 0) -> Classifier | None:
    """One class against the others, all classes and folds in one fit; None when fewer than two classes exist.

    With folds, `table` has a `block` from 1 to `folds`, and fold k has seen all blocks but k.
    """
    table = balanced(table)
    classes = [c for c in fault.SUBTLE if not table.where(F.col("label_class") == c).isEmpty()]
    if len(classes) < 2:
        return None
    k = len(classes)
    fold = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds)), lambda f: (f == 0) | (f != F.col("block")))) if folds else F.lit(0)
    rows = table.withColumn("_fold", fold).withColumn("_class", F.explode(F.array(*[F.lit(c) for c in classes])))
    number = F.col("_fold") * k + lookup({c: i for i, c in enumerate(classes)}, F.col("_class"))
    design = rows.select(number.cast("int").alias("model"), (F.col("label_class") == F.col("_class")).cast("double").alias("y"), "weight", *fault.FEATURES)
    return Classifier(boosting.fit(design, list(fault.FEATURES), k * (folds + 1), params), classes)


def predictor(model: Classifier, fold: Column | None = None):
    """The shape `fault.classify` wants: rows with their best class and its probability, of ties the first class.

    `fold` picks the model of each row, by default the one that has seen every block.
    """

    def run(features: DataFrame) -> DataFrame:
        names = [f"_p{i}" for i in range(len(model.classes))]
        first = F.lit(0) if fold is None else fold * len(names)
        out = model.forest.predict_block(features.withColumn("_model", first.cast("int")), names, "_model")
        best = F.greatest(*names)
        named = F.coalesce(*[F.when(F.col(n) == best, F.lit(c)) for n, c in zip(names, model.classes)])
        total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
        return out.withColumns({"fault_class": named, "confidence": best / total}).drop("_model", *names)

    return run


def train(features: DataFrame, marks: DataFrame, folds: int = 4, params: Params = PARAMS):
    """Model on everything, and the held-out model that saw only the blocks before the last."""
    table = training_table(features, marks)
    blocks = cv.time_blocks(features, folds + 1)
    past = table.join(blocks.where(F.col("block") <= folds), "timestamp_utc", "left_semi")
    return fit(table, params), fit(past, params)


def version(checksum: str) -> str:
    return f"v1-{checksum[:8]}"


def save(spark: SparkSession, forest: Forest, root: str, record: DataFrame) -> str:
    """Store a forest under `root` in a folder of its name and version, next to its record; gives the folder's name.

    The record's row has at least name, version and data_checksum. The model is written first, so a folder with a record is whole.
    """
    row = record.withColumn("saved_at", F.current_timestamp())
    first = row.first()
    stem = f"{first['name']}-{first['version']}"
    spark.createDataFrame([(first["data_checksum"], forest.to_bytes())], "data_checksum string, model binary").write.mode("overwrite").parquet(f"{root}/{stem}/model")
    row.write.mode("overwrite").parquet(f"{root}/{stem}/record")
    return stem


def latest(spark: SparkSession, root: str, name: str) -> str | None:
    """Folder of the last stored model of a name; None where there is none."""
    if not exists(spark, root):
        return None
    folders = [f for f in children(spark, root) if f.startswith(f"{name}-") and exists(spark, f"{root}/{f}/record")]
    records = [spark.read.parquet(f"{root}/{f}/record").select("saved_at", F.lit(f).alias("stem")) for f in folders]
    return union_all(records).orderBy(F.col("saved_at").desc(), F.col("stem").desc()).first()["stem"] if records else None


def load(spark: SparkSession, root: str, stem: str, checksum: str | None = None) -> tuple[Forest, DataFrame]:
    """A stored forest and its record; refused without a record, or fitted on other data than the record or `checksum` says."""
    if not exists(spark, f"{root}/{stem}/record"):
        raise ValueError(f"no record beside the model {stem}")
    record = spark.read.parquet(f"{root}/{stem}/record")
    model = spark.read.parquet(f"{root}/{stem}/model").first()
    stated = record.first()["data_checksum"]
    if stated != model["data_checksum"] or checksum not in (None, stated):
        raise ValueError("the model was fitted on other data")
    return Forest.from_bytes(model["model"]), record
