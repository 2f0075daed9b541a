"""Text classification with MLlib: TF-IDF as published, logistic or boosted trees, calibration, registry."""

from __future__ import annotations

import json
import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import CountVectorizer, ElementwiseProduct, Normalizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import lookups as L
from ..functions import text as T
from ..sources import writers
from ..storage import materialize
from .features import vector_columns



def _folds() -> tuple[str, str]:
    """Letters whose compatibility decomposition is one other character once its marks are off, and that character."""
    pairs = []
    for o in (*range(0xA0, 0x2190), *range(0xFF10, 0xFF5B), *range(0x1D400, 0x1D800)):
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(o)) if not unicodedata.combining(c))
        if len(bare) == 1 and bare != chr(o) and not bare.isspace():
            pairs.append((chr(o), bare))
    return "".join(x for x, _ in pairs), "".join(y for _, y in pairs)


ACCENTED, PLAIN = _folds()


def fold(c: Column) -> Column:
    """Lower case, accents off in every script, loose marks deleted."""
    return F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), "[\u0300-\u036f]", "")


class Grams(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Words of two letters or more, accents folded, and pairs of them."""

    def _transform(self, df: DataFrame) -> DataFrame:
        words = F.regexp_extract_all(fold(T.text(self.getInputCol())), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
        # the words are bound once: an expression inside a lambda would be computed again for each of its elements
        both = lambda w: F.concat(w, F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, y: F.concat(x, F.lit(" "), y)))
        return df.withColumn(self.getOutputCol(), F.transform(F.array(words), both)[0])


def grams(input_col: str, output_col: str) -> Grams:
    g = Grams()
    return g._set(inputCol=input_col, outputCol=output_col)


def term_weights(rows: DataFrame, grams_col: str, n: int, min_df: int = 2) -> DataFrame:
    """(gram, df, idf) of the grams that min_df rows hold: smooth idf ln((1 + n) / (1 + df)) + 1 over n rows."""
    df = rows.select(F.explode(F.array_distinct(grams_col)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    return df.withColumn("idf", F.ln((1 + F.lit(n)) / (1 + F.col("df"))) + 1)


def tfidf(df: DataFrame, text_col: str, size: int = 30_000, min_df: int = 2):
    """A fitted vectoriser of grams and its smooth idf weights, n and df over all rows."""
    model = Pipeline(stages=[grams(text_col, "__grams"), CountVectorizer(inputCol="__grams", outputCol="__tf", vocabSize=size, minDF=min_df)]).fit(df)
    vocab = model.stages[-1].vocabulary
    wanted = df.sparkSession.createDataFrame([(g, i) for i, g in enumerate(vocab)], "gram string, i int")
    found = term_weights(model.stages[0].transform(df), "__grams", df.count(), 1)
    weights = [1.0] * len(vocab)
    for r in found.join(F.broadcast(wanted), "gram").select("i", "idf").collect():  # one row a vocabulary entry, at most `size`
        weights[r["i"]] = r["idf"]
    return model, weights


def _as_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from batches  # a struct of a vector's parts is how a vector travels


def weighted(model: PipelineModel, weights: list[float], df: DataFrame, out: str = "tfidf") -> DataFrame:
    """(1 + ln tf) * idf, scaled to length one, as a sparse vector. The logarithms are taken inside the JVM on the
    vector's parts; Python only hands whole batches back under the vector type."""
    tf = model.transform(df).drop("__grams")
    v = F.unwrap_udt(F.col("__tf"))
    log = F.struct(v["type"].alias("type"), v["size"].alias("size"), v["indices"].alias("indices"), F.transform(v["values"], lambda x: 1.0 + F.ln(x)).alias("values"))
    keep = [f for f in tf.schema.fields if f.name != "__tf"]
    tf = tf.select(*[f.name for f in keep], log.alias("__log")).mapInArrow(_as_vectors, StructType([*keep, StructField("__log", VectorUDT())]))
    tf = ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol="__log", outputCol="__w").transform(tf)
    return Normalizer(p=2.0, inputCol="__w", outputCol=out).transform(tf).drop("__log", "__w")


@dataclass
class TextModel:
    """A fitted classifier over TF-IDF and the numeric columns: scores any table that has both."""

    vectoriser: PipelineModel
    weights: list[float]
    names: list[str]
    model: PipelineModel

    def inputs(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        return weighted(self.vectoriser, self.weights, vector_columns(df.withColumn(text_col, T.text(text_col)), self.names).withColumn("__t", F.col(text_col)))

    def score(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """The table with p, the probability of class 1."""
        return probability(self.model.transform(self.inputs(df, text_col))).drop("__t", "__x", "__n", "__s", "tfidf", "rawPrediction", "probability", "prediction")

    def trees(self) -> int:
        """Trees kept after early stopping."""
        return self.model.stages[-1].getNumTrees

    def losses(self, df: DataFrame, text_col: str = "text") -> list[float]:
        """Loss after each tree."""
        inner = PipelineModel(self.model.stages[:-1]).transform(self.inputs(df, text_col))
        return list(self.model.stages[-1].evaluateEachIteration(inner))


def fit_text(train: DataFrame, text_col: str = "text", names: list[str] | None = None, trees: bool = False, valid: str | None = None, size: int = 30_000, c: float = 1.0, rounds: int = 60) -> TextModel:
    """train: text, numeric columns and y (0.0 or 1.0) to a classifier: logistic regression over TF-IDF and scaled
    columns, or boosted trees, which with `valid` (a boolean column: validation rows) stop where these no longer gain."""
    names = names or L.FEATURE_VECTOR
    learn = train if valid is None else train.where(~F.col(valid))
    vec, weights = tfidf(materialize(learn.select(T.text(text_col).alias("__t")), "model-texts"), "__t", size)
    out = TextModel(vec, weights, names, None)
    rows = materialize(out.inputs(train.select(text_col, "y", *([valid] if valid else []), *[c for c in names if c in train.columns]), text_col), "model-inputs")  # fitting reads them many times
    head = [VectorAssembler(inputCols=names, outputCol="__n")]
    if trees:
        gbt = GBTClassifier(featuresCol="__x", labelCol="y", maxDepth=5, maxIter=rounds, stepSize=0.1, seed=42, **({"validationIndicatorCol": valid} if valid else {}))
        stages = [*head, VectorAssembler(inputCols=["tfidf", "__n"], outputCol="__x"), gbt]
    else:
        rows = rows if valid is None else rows.where(~F.col(valid))
        stages = [*head, StandardScaler(inputCol="__n", outputCol="__s", withMean=False), VectorAssembler(inputCols=["tfidf", "__s"], outputCol="__x"),
                  LogisticRegression(featuresCol="__x", labelCol="y", regParam=1.0 / (c * max(learn.count(), 1)), standardization=False)]
    out.model = Pipeline(stages=stages).fit(rows)
    return out


def top_coefficients(model: TextModel, k: int = 20) -> list[tuple[str, float]]:
    """The k largest and k smallest coefficients of a logistic model with the grams or columns they belong to."""
    names = [*model.vectoriser.stages[-1].vocabulary, *model.names]
    ranked = sorted(zip(names, map(float, model.model.stages[-1].coefficients)), key=lambda x: (-x[1], x[0]))
    return ranked[:k] + ranked[-k:] if len(ranked) > 2 * k else ranked


def numeric_pipeline(names: list[str] | None = None, trees: bool = False, c: float = 1.0, n: int = 1) -> Pipeline:
    """The feature vector to a probability: scaled logistic regression, or boosted trees."""
    names = names or L.FEATURE_VECTOR
    head = [VectorAssembler(inputCols=names, outputCol="__x")]
    if trees:
        return Pipeline(stages=[*head, GBTClassifier(featuresCol="__x", labelCol="y", maxDepth=5, maxIter=30, stepSize=0.1, seed=42)])
    return Pipeline(stages=[*head, StandardScaler(inputCol="__x", outputCol="__s", withMean=False), LogisticRegression(featuresCol="__s", labelCol="y", regParam=1.0 / (c * max(n, 1)), standardization=False)])


def probability(df: DataFrame) -> DataFrame:
    return df.withColumn("p", vector_to_array("probability")[1])


def platt(df: DataFrame) -> tuple[float, float]:
    """(a, b) of sigmoid(a p + b), fitted on raw probabilities."""
    x = df.select(array_to_vector(F.array("p")).alias("x"), F.col("y").cast("double").alias("y"))
    m = LogisticRegression(featuresCol="x", labelCol="y", regParam=0.0, maxIter=200).fit(x)
    return float(m.coefficients[0]), float(m.intercept)


def _logit():
    q = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col("p")))
    return F.ln(q / (1 - q))


def temperature(df: DataFrame, lo: float = 0.1, hi: float = 10.0, steps: int = 40) -> float:
    """T of sigmoid(logit(p) / T) with the least loss: golden-section search over a histogram of logits, which is
    bounded by its 4000 bins, not by the rows."""
    bins = df.select(F.round(_logit() * 100).alias("z"), "y").groupBy("z").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).collect()

    def loss(t: float) -> float:
        out = 0.0
        for r in bins:
            z = r["z"] / 100 / t
            out += r["pos"] * math.log1p(math.exp(-z)) + r["neg"] * math.log1p(math.exp(z))
        return out

    g = (math.sqrt(5) - 1) / 2
    a, b = lo, hi
    for _ in range(steps):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return (a + b) / 2


def calibrated(df: DataFrame, method: str, **values: float) -> DataFrame:
    """p after Platt (a, b) or temperature (t) scaling."""
    z = values["a"] * F.col("p") + values["b"] if method == "platt" else _logit() / values["t"]
    return df.withColumn("p", 1 / (1 + F.exp(-z)))


def linear_attribution(df: DataFrame, coefficients: list[float], means: list[float], names: list[str]) -> DataFrame:
    """coefficient x (value - mean) of each feature, exact for a linear model, as a map."""
    return df.withColumn("attributions", F.create_map(*[x for n, c, m in zip(names, coefficients, means) for x in (F.lit(n), F.lit(c) * (F.col(n) - F.lit(m)))]))


class Registry:
    """Versions below one folder; a manifest names the one in use. Promotion needs at least the recall in use."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, version: str, model: PipelineModel, measures: dict) -> None:
        model.write().overwrite().save(f"{self.path}/{version}/model")
        self._put(f"{version}/manifest", measures | {"version": version})

    def promote(self, version: str) -> bool:
        new, old = self.manifest(version), self.current()
        good = not old or new.get("recall", 0) >= old.get("recall", 0)
        if good:
            self._put("current", new)
        event = self.spark.createDataFrame([(version, float(new.get("recall", 0)), good)], "version string, recall double, promoted boolean")
        writers.append_log(event.withColumn("at", F.current_timestamp()), f"{self.path}/promotions")
        return good

    def record(self, version: str, measures: dict) -> None:
        """The measures of a version whose model is kept elsewhere."""
        self._put(f"{version}/manifest", measures | {"version": version})

    def promotions(self) -> DataFrame:
        """(version, recall, promoted, at) of every attempt; the log is only ever appended to."""
        return self.spark.read.schema("version string, recall double, promoted boolean, at timestamp").json(f"{self.path}/promotions")

    def _put(self, name: str, value: dict) -> None:
        self.spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/{name}")

    def manifest(self, version: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/{version}/manifest").first()["value"])

    def current(self) -> dict | None:
        try:
            return json.loads(self.spark.read.text(f"{self.path}/current").first()["value"])
        except Exception:
            return None

    def load(self) -> PipelineModel | None:
        now = self.current()
        return PipelineModel.load(f"{self.path}/{now['version']}/model") if now else None
