"""The five classifiers and the feature stages in front of them. Trees, forests and boosting are those of `trees`, the others
spark.ml estimators."""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F

from sturdytab.learn.rbf import FourierFeatures
from sturdytab.learn.trees import blocks_for, column_cuts, fit_trees, row_blocks
from sturdytab.operators.meta import distinct_counts
from sturdytab.operators.prep import class_list, fit_prep
from sturdytab.operators.sampling import by_class
from sturdytab.session import settle
from sturdytab.table import LabelledTable

# The model list; its order decides ties.
MODELS = ("Logistic Regression", "Decision Tree", "Random Forest", "SVM", "XGBoost")
CODE, FEATURES, FOURIER, PREDICTION = "label_code", "model_features", "fourier_features", "predicted_code"
RAW = "column_values"  # numeric columns and category indices, for trees
TREES = {"Decision Tree": "tree", "Random Forest": "forest", "XGBoost": "boosted"}
PARTITION_ROWS = 50_000  # prepared rows a partition holds: small tables are fitted without any exchange


@dataclass(frozen=True)
class Settings:
    """Model sizes; the defaults are the published ones. Trees without a `tree_depth` grow until their leaves are pure."""

    iterations: int = 2000
    svm_iterations: int = 100
    trees: int = 200
    tree_depth: int | None = None
    rounds: int = 200
    round_depth: int = 6
    leaf_rows: int = 1  # rows a leaf needs at least, whatever the size of the table
    fourier: int = 256
    categories: int = 100_000  # values a text feature may have; one with more is refused, by exact count
    seed: int = 42
    parallelism: int = 5  # models fitted side by side
    cells: int = 8  # grid cells run side by side at most, each with its own cached training table; fewer on few cores


# Smaller models for trial runs over whole tables.
LIGHT = Settings(iterations=100, svm_iterations=20, trees=20, tree_depth=10, rounds=10, round_depth=4, fourier=64,
                 cells=4)


def estimator(name: str, classes: int, rows: int, settings: Settings):
    """A spark.ml classifier by model name."""
    columns = {"featuresCol": FEATURES, "labelCol": CODE, "predictionCol": PREDICTION}
    if name == "Logistic Regression":
        # regParam 1/n gives the objective of C = 1
        return LogisticRegression(
            **columns, maxIter=settings.iterations, regParam=1.0 / max(rows, 1), elasticNetParam=0.0,
            standardization=False, family="multinomial")
    if name == "SVM":
        columns["featuresCol"] = FOURIER
        svc = LinearSVC(**columns, maxIter=settings.svm_iterations, regParam=1.0 / max(rows, 1),
                        standardization=False)
        return svc if classes <= 2 else OneVsRest(**columns, classifier=svc, parallelism=settings.parallelism)
    raise ValueError(f"unknown model: {name}")


@dataclass
class FittedFeatures:
    """Feature stages fitted on a training table, and the class list."""

    stages: PipelineModel
    classes: list
    target: str
    rows: int
    kind: str  # type of the labels
    numeric: int  # numeric columns in front of the category indices
    sizes: list[int]  # categories of each text column
    cuts: list | None = None  # bins of the numeric columns, found by the first model that asks
    blocks: dict = field(default_factory=dict, repr=False, compare=False)  # binned rows by the size of their blocks, made likewise
    lock: threading.Lock = field(default_factory=threading.Lock, repr=False, compare=False)

    def cuts_of(self, prepared: DataFrame) -> list:
        with self.lock:
            if self.cuts is None:
                self.cuts = column_cuts(prepared, RAW, self.numeric)
            return self.cuts

    def blocks_of(self, prepared: DataFrame) -> DataFrame:
        cuts, size = self.cuts_of(prepared), blocks_for(self.rows, self.numeric + len(self.sizes))
        with self.lock:
            if size not in self.blocks:
                self.blocks[size] = row_blocks(prepared, CODE, RAW, cuts, *size)
            return self.blocks[size]

    def code(self, df: DataFrame) -> DataFrame:
        return by_class(df, self.target, {c: (float(i),) for i, c in enumerate(self.classes)}, [CODE], ["double"])

    def prepared(self, df: DataFrame) -> DataFrame:
        """Coded rows with feature vectors, nothing else."""
        out = self.stages.transform(self.code(df))
        return out.select(CODE, FEATURES, FOURIER, RAW)

    def packed(self, df: DataFrame, rows: int) -> DataFrame:
        """The same in as few partitions as the rows need, read from files: an iterative fit sends the lineage of its rows to the
        executors once an iteration, and the driver keeps it for a while. Fourier features, by far the widest column, are not
        written but made by the fit that asks for them."""
        fourier, parts = self.stages.stages[-1], max(1, -(-rows // PARTITION_ROWS))
        narrow = PipelineModel(stages=self.stages.stages[:-1]).transform(self.code(df))
        names = dict.fromkeys([CODE, FEATURES, RAW, *fourier.getInputCols()])
        return fourier.transform(settle(narrow.select(*names).coalesce(parts), "prepared").coalesce(parts)).select(
            CODE, FEATURES, FOURIER, RAW)


def fit_features(table: LabelledTable, settings: Settings, classes: list | None = None) -> FittedFeatures:
    """Imputation, scaling, one-hot coding and Fourier features, fitted on the training table."""
    prep = fit_prep(table)
    numeric = [f"num_{i}" for i in range(len(prep.numeric))]
    texts = [f"cat_{i}" for i in range(len(prep.categorical))]
    expressions = [
        e.rsplit(" AS ", 1)[0] + f" AS {name}" for e, name in zip(prep.select_list(), [*numeric, *texts])]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(expressions)} FROM __THIS__")]
    if numeric:
        stages.append(VectorAssembler(inputCols=numeric, outputCol="numbers"))
    index, hot, sizes = [f"{c}_index" for c in texts], [f"{c}_hot" for c in texts], []
    if texts:
        wide = [prep.categorical[r["ord"]] for r in distinct_counts(table.df, prep.categorical)
                .where(F.col("n_distinct") > settings.categories).collect()]  # at most one row per column
        if wide:
            raise ValueError(f"column(s) {wide} have more than {settings.categories} values; leave them out of the features")
        # an unseen category gets the extra last index, which one-hot drops: all zeros
        stages.append(StringIndexer(inputCols=texts, outputCols=index, handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True))
    stages.append(VectorAssembler(inputCols=(["numbers"] if numeric else []) + hot, outputCol=FEATURES))
    fitted = Pipeline(stages=stages).fit(table.df)
    if texts:
        indexer = next(s for s in fitted.stages if s.hasParam("stringOrderType"))
        sizes = [len(labels) for labels in indexer.labelsArray]
    raw = ", ".join([*numeric, *(f"double({i})" for i in index)])
    values = SQLTransformer(statement=f"SELECT *, array({raw}) AS {RAW} FROM __THIS__")
    width = len(numeric) + sum(sizes)
    # variance of all cells of the encoded matrix: scaled numerics have variance 1, each row one 1 per category column
    live = sum(1 for c in prep.numeric if prep.deviations[c])
    variance = (live + len(texts)) / width - (len(texts) / width) ** 2
    fourier = FourierFeatures(
        inputCols=["numbers" if numeric else FEATURES, *index], outputCol=FOURIER, numericWidth=len(numeric),
        sizes=sizes, outputs=settings.fourier, gamma=1.0 / (width * variance) if variance > 0 else 1.0,
        seed=settings.seed)
    stages = PipelineModel(stages=[*fitted.stages, values, fourier])
    known = classes if classes is not None else class_list(table.df, table.target)
    return FittedFeatures(stages, known, table.target, table.rows(), table.type_of(table.target).simpleString(),
                          len(numeric), sizes)


@dataclass
class FittedModel:
    """A whole fitted pipeline with its class list."""

    name: str
    stages: PipelineModel
    classes: list
    target: str
    kind: str
    seconds: float = 0.0

    def predict(self, df: DataFrame) -> DataFrame:
        """The rows with a decoded `prediction` of the target's type. A target column is neither needed nor used."""
        wanted = df.columns
        scored = self.stages.transform(df)
        decoded = by_class(scored, PREDICTION, {float(i): (c,) for i, c in enumerate(self.classes)},
                           ["prediction"], [self.kind])
        return decoded.select(*[F.col(f"`{c}`") for c in wanted], "prediction")

    def save(self, path: str) -> None:
        """The pipeline and, next to it, one Parquet row with model name, target and typed classes."""
        self.stages.write().save(f"{path}/pipeline")
        meta = SparkSession.active().createDataFrame(
            [(self.name, self.target, self.classes)], f"model string, target string, classes array<{self.kind}>")
        meta.write.parquet(f"{path}/meta")

    @staticmethod
    def load(path: str) -> "FittedModel":
        frame = SparkSession.active().read.parquet(f"{path}/meta")
        meta, kind = frame.first(), frame.schema["classes"].dataType.elementType.simpleString()
        return FittedModel(
            meta["model"], PipelineModel.load(f"{path}/pipeline"), list(meta["classes"]), meta["target"], kind)


def fit_model(name: str, features: FittedFeatures, prepared: DataFrame, settings: Settings) -> FittedModel:
    """Fit one classifier on prepared training rows."""
    start = time.monotonic()
    if name in TREES:
        kind = TREES[name]
        size, depth = (settings.rounds, settings.round_depth) if kind == "boosted" else (settings.trees, settings.tree_depth)
        model = fit_trees(kind, prepared, CODE, RAW, features.numeric, features.sizes, len(features.classes), features.rows,
                          size, depth, settings.seed, PREDICTION, settings.leaf_rows, features.cuts_of(prepared), features.blocks_of(prepared))
    else:
        model = estimator(name, len(features.classes), features.rows, settings).fit(prepared)
    seconds = time.monotonic() - start
    return FittedModel(name, PipelineModel(stages=[*features.stages.stages, model]), features.classes,
                       features.target, features.kind, seconds)
