"""A declared stand-in for the neural sentence classifier: hashed words and multinomial logistic regression. Data preparation and measures are the
engine's own; the recurrent network itself isn't reproduced."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens


def train_and_predict(train: DataFrame, test: DataFrame, text: str, label: str, features: int = 4096, rounds: int = 20) -> DataFrame:
    """[M15, M17] ``test`` with ``predicted``. Rows without text or label don't train; an unseen label counts as wrong. Texts and labels may be null
    in ``test``."""
    prep = lambda df: df.withColumn("_w", F.coalesce(tokens(F.lower(F.col(text))), F.array().cast("array<string>")))
    good = prep(train.filter(F.col(text).isNotNull() & F.col(label).isNotNull()))
    index = StringIndexer(inputCol=label, outputCol="_y", handleInvalid="keep", stringOrderType="alphabetAsc").fit(good)
    pipe = Pipeline(stages=[HashingTF(inputCol="_w", outputCol="_x", numFeatures=features), LogisticRegression(featuresCol="_x", labelCol="_y", predictionCol="_p", maxIter=rounds, regParam=0.01)])
    model = pipe.fit(index.transform(good))
    names = F.array(*[F.lit(x) for x in index.labels])
    return model.transform(prep(test)).select(*test.columns, F.get(names, F.col("_p").cast("int")).alias("predicted"))
