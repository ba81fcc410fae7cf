"""Fitted models on a shared file system, one directory per training run.

``<path>/<version>/`` holds ``pipeline``, ``weights`` or ``trees`` and ``bins``, ``scaler``, ``vocabulary`` and,
written last, ``manifest``, which lists the other parts, the features and the settings. A run that fails midway leaves no manifest and
is never picked up, and a scorer that runs during a retrain reads one whole version, never
a mixture.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.errors import ModelNotTrained
from tillcast.operators.encoding import VOCABULARY_SCHEMA, Categories
from tillcast.operators.scaling import SCALER_SCHEMA, Scaler
from tillcast.plans.models import WEIGHTS_SCHEMA, LinearModel
from tillcast.plans.wide_forest import BINS_SCHEMA, TREES_SCHEMA, Bins, TreeTable, slices

MANIFEST_SCHEMA = (
    "version string, kind string, base_year int, features array<string>, parts array<string>, "
    "settings map<string, string>"
)


@dataclass(frozen=True)
class TrainedModel:
    kind: str
    predictor: PipelineModel | LinearModel | TreeTable
    features: list[str]
    base_year: int | None = None
    scaler: Scaler = field(default_factory=lambda: Scaler({}))
    categories: Categories = field(default_factory=lambda: Categories({}))
    settings: dict[str, str] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        """The columns the predictor reads; indicators are one of them."""
        if isinstance(self.predictor, LinearModel):
            return self.features
        if isinstance(self.predictor, TreeTable):
            return self.predictor.columns
        return self.predictor.stages[0].getInputCols()


def save_model(spark: SparkSession, path: str, model: TrainedModel) -> str:
    """Write a new version and return its name; names sort by time."""
    version = f"{datetime.now(UTC):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    target = f"{path}/{version}"
    tables = {}
    if isinstance(model.predictor, LinearModel):
        tables["weights"] = model.predictor
    elif isinstance(model.predictor, TreeTable):
        tables["trees"], tables["bins"] = model.predictor, model.predictor.bins
    else:
        model.predictor.write().save(f"{target}/pipeline")
    if model.scaler.stats:
        tables["scaler"] = model.scaler
    if model.categories.values:
        tables["vocabulary"] = model.categories
    for name, table in tables.items():
        table.to_df(spark).write.parquet(f"{target}/{name}")
    manifest = [
        (version, model.kind, model.base_year, model.features, list(tables), model.settings)
    ]
    spark.createDataFrame(manifest, MANIFEST_SCHEMA).coalesce(1).write.parquet(
        f"{target}/manifest"
    )
    return version


def load_model(spark: SparkSession, path: str, kind: str) -> TrainedModel:
    """The newest completed version; raises :class:`ModelNotTrained` if there is none, or if
    a part that its manifest lists is gone."""
    try:
        versions = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/*/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise ModelNotTrained(f"no trained {kind} model under {path}") from None
    newest = versions.filter(F.col("kind") == kind).orderBy(F.desc("version")).first()
    if newest is None:
        raise ModelNotTrained(f"no trained {kind} model under {path}")
    target = f"{path}/{newest['version']}"
    parts = newest["parts"] or []
    read = {
        name: part.from_df(_read_part(spark, f"{target}/{name}", schema))
        for name, part, schema in (
            ("weights", LinearModel, WEIGHTS_SCHEMA),
            ("scaler", Scaler, SCALER_SCHEMA),
            ("vocabulary", Categories, VOCABULARY_SCHEMA),
            ("bins", Bins, BINS_SCHEMA),
        )
        if name in parts
    }
    settings = dict(newest["settings"] or {})
    if "trees" in parts:
        nodes = _read_part(spark, f"{target}/trees", TREES_SCHEMA)
        read["trees"] = TreeTable(
            read["bins"], nodes, int(settings["trees"]), slices(int(settings["rows"]))
        )
    return TrainedModel(
        kind=kind,
        predictor=read.get("weights") or read.get("trees") or PipelineModel.load(f"{target}/pipeline"),
        features=list(newest["features"]),
        base_year=newest["base_year"],
        scaler=read.get("scaler", Scaler({})),
        categories=read.get("vocabulary", Categories({})),
        settings=settings,
    )


def _read_part(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise ModelNotTrained(f"a part of the model is missing: {path}") from None
