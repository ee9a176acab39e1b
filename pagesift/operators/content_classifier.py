"""The content model as a ``pyspark.ml`` stage (2.9): ``ContentClassifier``
fits labelled pages, ``ContentClassifierModel`` adds ``prediction`` to their
blocks; both fit a ``Pipeline`` and outlive the session by ``write`` / ``read``.
"""

from __future__ import annotations

from dataclasses import asdict

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable,
                             DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame

from pagesift.operators.features import SHALLOW_TEXT
from pagesift.operators.scale import ScalerModel
from pagesift.operators.svm import DEFAULT_COMPONENTS, DEFAULT_SEED, FourierMap, SVMModel
from pagesift.plans.jobs import ContentModel, predict_pages, train_content_model

_STORED = ("non_negative ARRAY<BOOLEAN>, minimum ARRAY<DOUBLE>, rng ARRAY<DOUBLE>, max_abs ARRAY<DOUBLE>, "
           "weights ARRAY<ARRAY<DOUBLE>>, offsets ARRAY<DOUBLE>, coefficients ARRAY<DOUBLE>, "
           "intercept DOUBLE, iterations INT, converged BOOLEAN, tokens ARRAY<STRING>")


def spec_of(names: list[str]) -> tuple:
    """``["a", "b:10"]`` -> ``("a", ("b", 10))``: extractors as the jobs take them."""
    split = [name.partition(":") for name in names]
    return tuple((name, int(top)) if top else name for name, _, top in split)


def names_of(spec) -> list[str]:
    return [f"{item[0]}:{item[1]}" if isinstance(item, tuple) else item for item in spec]


class _Features(Params):
    features = Param(Params._dummy(), "features", "extractors, as name or name:top_n",
                     typeConverter=TypeConverters.toListString)

    def spec(self) -> tuple:
        return spec_of(self.getOrDefault("features"))


class ContentClassifier(_Features, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """M1 as an estimator on pages with labelled ``blocks``."""

    unique = Param(Params._dummy(), "unique", "train on distinct examples", typeConverter=TypeConverters.toBoolean)
    components = Param(Params._dummy(), "components", "Fourier features", typeConverter=TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the Fourier map", typeConverter=TypeConverters.toInt)

    def __init__(self, features: list[str] | None = None, unique: bool = True,
                 components: int = DEFAULT_COMPONENTS, seed: int = DEFAULT_SEED):
        super().__init__()
        self._set(features=features or [SHALLOW_TEXT], unique=unique, components=components, seed=seed)

    def _fit(self, dataset: DataFrame) -> "ContentClassifierModel":
        fitted = train_content_model(dataset, self.spec(), self.getOrDefault("unique"),
                                     self.getOrDefault("components"), self.getOrDefault("seed"))
        return self._copyValues(ContentClassifierModel(fitted))


class ContentClassifierModel(_Features, Model, MLReadable, MLWritable):
    """M2 as a transformer: ``blocks`` get ``prediction``, without a shuffle and
    without need of labels."""

    def __init__(self, content: ContentModel):
        super().__init__()
        self.content = content
        self._set(features=names_of(content.spec))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return predict_pages(self.content, dataset)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    """Parameters beside one row of bounded arrays (D x d weights, D + 1
    coefficients, the learned tokens)."""

    def __init__(self, model: ContentClassifierModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        svm, tokens = self.model.content.svm, self.model.content.tokens
        scaler = asdict(svm.scaler)
        row = ([bool(v) for v in scaler["non_negative"]],
               *[[float(v) for v in scaler[name]] for name in ("minimum", "rng", "max_abs")],
               svm.fourier.weights.tolist(), svm.fourier.offsets.tolist(), np.asarray(svm.coefficients).tolist(),
               float(svm.intercept), int(svm.iterations), bool(svm.converged), tokens)
        self.sparkSession.createDataFrame([row], _STORED).coalesce(1).write.parquet(f"{path}/data")


class _Reader(MLReader):
    def load(self, path: str) -> ContentClassifierModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        row = self.sparkSession.read.schema(_STORED).parquet(f"{path}/data").first()
        svm = SVMModel(ScalerModel(row["non_negative"], row["minimum"], row["rng"], row["max_abs"]),
                       FourierMap(np.array(row["weights"]), np.array(row["offsets"])),
                       np.array(row["coefficients"]), row["intercept"], row["iterations"], row["converged"])
        model = ContentClassifierModel(ContentModel(
            spec_of(metadata["paramMap"]["features"]), row["tokens"], svm))
        model._resetUid(metadata["uid"])
        return model
