"""Training and batch scoring with Spark ML.

Regressors are ``VectorAssembler -> StandardScaler -> GBTRegressor``; the
8-class vibe model is one multinomial booster over Spark ML regression trees
(see ``boosting``). With a share of the rows kept for validation the number of
trees is an upper bound: fitting stops when they no longer gain. Tree fitting is
distributed by Spark ML; scoring is a ``transform`` on a table, not a per-song call.
"""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versewise.functions import labels as L
from versewise.operators import boosting
from versewise.schema import MIN_LABELS_TO_TRAIN, MODEL_DEFAULTS, SMALL_MODEL_CAPS
from versewise.session import checkpoint_dir

#: Column that marks rows for validation while a model is fitted.
VALIDATION = "_validation"

PROFILES = ("default", "small")


def model_config(base: dict | None = None, profile: str = "default") -> dict:
    """M3: the settings of a named profile. ``small`` (meant for training sets
    of up to ``SMALL_TRAIN_ROWS`` rows) caps trees and depth; the caller
    chooses, row counts never do."""
    if profile not in PROFILES:
        raise ValueError(f"unknown model profile {profile!r}; one of {PROFILES}")
    cfg = dict(MODEL_DEFAULTS if base is None else base)
    if profile == "small":
        cfg["n_estimators"] = min(cfg["n_estimators"], SMALL_MODEL_CAPS["n_estimators"])
        cfg["max_depth"] = min(cfg["max_depth"], SMALL_MODEL_CAPS["max_depth"])
        cfg["learning_rate"] = max(cfg["learning_rate"], SMALL_MODEL_CAPS["learning_rate"])
    return cfg


def _front(features: list[str], prefix: str):
    va = VectorAssembler(inputCols=features, outputCol=f"{prefix}_raw", handleInvalid="keep")
    sc = StandardScaler(inputCol=f"{prefix}_raw", outputCol=f"{prefix}_x", withMean=True, withStd=True)
    return [va, sc]


def make_regressor(features: list[str], label: str, cfg: dict, prefix: str, validation: bool = False) -> Pipeline:
    """M1: scaled boosted-tree regressor predicting ``pred_<label>``. With
    ``validation`` the rows marked in ``VALIDATION`` tell when to stop."""
    gbt = GBTRegressor(featuresCol=f"{prefix}_x", labelCol=label, predictionCol=f"pred_{label}",
                       maxIter=cfg["n_estimators"], maxDepth=cfg["max_depth"], stepSize=cfg["learning_rate"],
                       seed=cfg["random_state"], cacheNodeIds=cfg["max_depth"] > 5, checkpointInterval=boosting.CHECKPOINT)
    if validation:
        gbt = gbt.setValidationIndicatorCol(VALIDATION)
    return Pipeline(stages=[*_front(features, prefix), gbt])


def fit_classifier(train: DataFrame, features: list[str], label: str, cfg: dict, validation: bool = False) -> boosting.BoostedClasses:
    """M2: the multinomial booster over the classes of ``label``."""
    return boosting.fit(train, features, label, cfg["n_estimators"], cfg["max_depth"], cfg["learning_rate"], cfg["random_state"],
                        VALIDATION if validation else None, parallelism=cfg.get("parallelism", 8))


def class_names(model: boosting.BoostedClasses) -> list[str]:
    """Class names of a fitted vibe model in the order of its scores."""
    return list(model.classes)


def rounds_used(models: dict) -> dict[str, int]:
    """Boosting rounds of each fitted model."""
    return {t: len(m.rounds) if t == "vibe" else int(m.stages[-1].getNumTrees) for t, m in models.items()}


def label_counts(df: DataFrame, targets: list[str]) -> dict[str, int]:
    """M4 gates: non-null label counts of all targets in one pass."""
    row = df.agg(*[F.count(F.col(t)).alias(t) for t in targets]).first()
    return {t: int(row[t]) for t in targets}


def train_models(train: DataFrame, feature_cols: dict[str, list[str]], cfg: dict | None = None,
                 profile: str = "default", validation_pct: int = 0) -> dict[str, PipelineModel | boosting.BoostedClasses]:
    """M4: fit a regressor per numeric target and the vibe classifier, each
    only with >= 10 labels, each on its own labelled rows (T22). When vibes
    are scarce, or the column is absent, but both regressions have labels,
    vibe is derived by J8. ``validation_pct`` of the rows, by the hash of their
    features, tell each model when to stop; with 0 all trees are grown."""
    checkpoint_dir(train.sparkSession)  # long fits write their state there
    numeric = [t for t in feature_cols if t != "vibe" and t in train.columns]
    if "vibe" in feature_cols and "vibe" not in train.columns:
        train = train.withColumn("vibe", F.lit(None).cast("string"))
    # every tree level is a pass over the input: keep it (memory, spilling
    # to disk; a lost block is recomputed from its lineage)
    train = train.withColumns({t: F.when(L.has_number(t), F.col(t)) for t in numeric})
    every = sorted({c for cols in feature_cols.values() for c in cols})
    held = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in every]), F.lit(100)) < validation_pct
    needed = dict.fromkeys([*every, *numeric, *(["vibe"] if "vibe" in feature_cols else [])])
    train = train.select(*[F.col(f"`{c}`") for c in needed], held.alias(VALIDATION)).persist(StorageLevel.MEMORY_AND_DISK)
    counts = label_counts(train, [t for t in feature_cols if t in train.columns])
    cfg = model_config(cfg, profile)
    models: dict[str, PipelineModel | boosting.BoostedClasses] = {}
    for t in numeric:
        if counts[t] >= MIN_LABELS_TO_TRAIN:
            models[t] = make_regressor(feature_cols[t], t, cfg, t, validation_pct > 0).fit(train.filter(F.col(t).isNotNull()))
    if "vibe" in feature_cols:
        tr, labelled = train, counts["vibe"]
        if labelled < MIN_LABELS_TO_TRAIN and "valence" in models and "energy" in models:
            tr = train.withColumn("vibe", L.nearest_anchor("valence", "energy"))
            labelled = tr.filter(F.col("vibe").isNotNull()).count()
        if labelled >= MIN_LABELS_TO_TRAIN:
            models["vibe"] = fit_classifier(tr.filter(F.col("vibe").isNotNull()), feature_cols["vibe"], "vibe", cfg, validation_pct > 0)
    train.unpersist()
    return models


NUMERIC_TARGETS = ("valence", "energy", "tempo")


def score(df: DataFrame, models: dict, feature_cols: dict[str, list[str]] | None = None,
          catalog_used: bool = False, audio_used: bool = False) -> DataFrame:
    """M5: batch scoring with fallbacks (X18 rule scores, J8 vibe), labels
    (X13), clipping and rounding (X14), sorted class scores (O3) and the flags
    of what the features came from. Every input row is scored, labelled or
    not; a tempo model adds ``score_tempo`` and ``raw_tempo``."""
    out = df
    for t in NUMERIC_TARGETS:
        if t in models:
            out = models[t].transform(out)
            out = out.drop(*[c for c in out.columns if c.startswith(f"{t}_") and c.endswith(("_raw", "_x"))])

    def num(c):
        return F.coalesce(F.col(c), F.lit(0.0)) if c in out.columns else F.lit(0.0)

    v = L.clip01("pred_valence") if "valence" in models else L.rule_valence(num("vader_compound"))
    e = L.clip01("pred_energy") if "energy" in models else L.rule_energy(num("tempo_bpm"), num("rms_mean"))
    out = out.withColumns({"_v": v, "_e": e})
    if "vibe" in models:
        out = models["vibe"].transform(out, "pred_vibe", "vibe_p")
        scores = F.map_from_arrays(F.array(*[F.lit(c) for c in class_names(models["vibe"])]), F.col("vibe_p"))
        out = out.withColumns({"vibe_out": F.col("pred_vibe"), "vibe_scores": L.sorted_scores(scores)})
    else:
        nv = L.nearest_anchor("_v", "_e")
        out = out.withColumns({"vibe_out": nv,
                               "vibe_scores": F.array(F.struct(nv.alias("key"), F.lit(1.0).alias("value")))})
    used = len(set().union(*(c for t, c in feature_cols.items() if t != "tempo"))) if feature_cols else 0
    res = out.withColumns({
        "score_valence": F.round("_v", 3), "score_energy": F.round("_e", 3),
        "raw_valence": F.col("_v"), "raw_energy": F.col("_e"),
        "valence_label": L.valence_bucket("_v"), "energy_label": L.energy_bucket("_e"),
        "features_used": F.lit(used), "spotify_features_used": F.lit(catalog_used), "audio_analyzed": F.lit(audio_used),
    })
    if "tempo" in models:
        res = res.withColumns({"score_tempo": F.round("pred_tempo", 3), "raw_tempo": F.col("pred_tempo")})
    drop = [c for c in res.columns if c == "vibe_p"] + ["_v", "_e"]
    return res.drop(*drop)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions under ``path``: those whose metadata, written last, is complete."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [st.getPath().getName() for st in fs.listStatus(root)] if fs.exists(root) else []
    found = [int(n.split("=", 1)[1]) for n in names if n.startswith("version=") and n.split("=", 1)[1].isdigit()]
    return sorted(v for v in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/version={v}/metadata/_SUCCESS")))


def save_models(models: dict, path: str, meta: dict) -> str:
    """A new version of the models: a folder a target and, last, a JSON
    metadata table that names them, whose presence commits the version. Earlier
    versions stay. The folder of the version is returned."""
    spark = SparkSession.getActiveSession()
    version = f"{path}/version={max(_versions(spark, path), default=0) + 1}"
    for t, m in models.items():
        if isinstance(m, boosting.BoostedClasses):
            spark.createDataFrame([(m.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{version}/{t}_model")
        else:
            m.write().overwrite().save(f"{version}/{t}_model")
    spark.createDataFrame([(json.dumps({"meta": meta, "models": sorted(models)}),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(f"{version}/metadata")
    return version


def load_models(path: str, targets=(*NUMERIC_TARGETS, "vibe")) -> tuple[dict, dict]:
    """The newest committed version. A target that it doesn't name is
    absent, so scoring falls back to rules; one that it names but that can't be
    read is an error, never a fallback."""
    spark = SparkSession.getActiveSession()
    versions = _versions(spark, path)
    if not versions:
        return {}, {}
    version = f"{path}/version={versions[-1]}"
    about = json.loads(spark.read.text(f"{version}/metadata").first()[0])
    models = {}
    for t in targets:
        if t in about["models"]:
            models[t] = (boosting.BoostedClasses.from_json(spark.read.text(f"{version}/{t}_model").first()[0]) if t == "vibe"
                         else PipelineModel.load(f"{version}/{t}_model"))
    return models, about["meta"]
