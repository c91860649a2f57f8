"""The cleaning and feature chain of a blueprint, fitted once and applied to any table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.blueprints import get_blueprint
from plumbline.operators import clean as C
from plumbline.operators.features import ChurnFeatures, fit_churn_features, fit_price_tiers, price_features, revenue_features
from plumbline.operators.rank import TierModel
from plumbline.session import materialise

KEY_COLUMNS = {"customer_churn": ["customer_id"], "revenue_projection": [], "price_optimization": ["product_id"]}


@dataclass
class PreprocessConfig:
    missing_value_strategy: str = "auto"
    outlier_method: str = "iqr"
    encoding_strategy: str = "auto"
    scaling_method: str = "robust"
    target: str | None = None
    encode_keys: bool = False
    narrow: bool = True
    exact: bool = True


@dataclass
class FittedPreprocess:
    """The fitted steps in order; ``transform`` applies them to new rows.

    All bounds, fills, codes, scales and tiers are those of the fit. For churn it runs on a stream too; the windows over
    time of the other use cases need stored rows, and the percentile of a price is its place among the rows given.
    """

    blueprint: str
    as_of: Column
    impute: C.ImputeModel
    cap: C.CapModel
    churn: ChurnFeatures | None
    encode: C.EncodeModel
    scale: C.ScaleModel
    narrow: C.NarrowModel
    tiers: TierModel | None = None
    report: list[tuple[str, str, str]] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.cap.transform(self.impute.transform(df))
        out = _features(out, self.blueprint, self.as_of, self.churn, self.tiers)
        out = self.scale.transform(self.encode.transform(out))
        return self.narrow.transform(out)

    def save(self, spark: SparkSession, path: str) -> None:
        """Store all steps below ``path``."""
        for name in STEPS:
            C.save_model(getattr(self, name), spark, f"{path}/{name}")
        churn = None if self.churn is None else {"tiers": _plain(self.churn.tiers), "maxima": self.churn.maxima}
        body = C.to_json({"blueprint": self.blueprint, "churn": churn, "tiers": _plain(self.tiers), "report": self.report})
        spark.createDataFrame([(body,)], "chain string").coalesce(1).write.mode("overwrite").parquet(f"{path}/chain")


STEPS = ("impute", "cap", "encode", "scale", "narrow")


def _plain(tiers: TierModel | None) -> dict | None:
    return None if tiers is None else vars(tiers)


def _tiers(found: dict | None) -> TierModel | None:
    if found is None:
        return None
    cuts = [(value, None if keys is None else tuple(keys)) for value, keys in found["cuts"]]
    return TierModel(found["column"], tuple(found["ties"]), tuple(found["labels"]), cuts)


def load_preprocess(spark: SparkSession, path: str, as_of: Column) -> FittedPreprocess:
    """A chain that was stored by ``save``, to be applied as of another time."""
    body = C.from_json(spark.read.parquet(f"{path}/chain").first()["chain"])
    churn = body["churn"] and ChurnFeatures(_tiers(body["churn"]["tiers"]), body["churn"]["maxima"])
    steps = {name: C.load_model(spark, f"{path}/{name}") for name in STEPS}
    return FittedPreprocess(body["blueprint"], as_of, churn=churn, tiers=_tiers(body["tiers"]), report=[tuple(r) for r in body["report"]], **steps)


def _features(df: DataFrame, blueprint: str, as_of: Column, churn: ChurnFeatures | None, tiers: TierModel | None) -> DataFrame:
    if blueprint == "customer_churn":
        return churn.transform(df, as_of)
    if blueprint == "revenue_projection":
        return revenue_features(df)
    if blueprint == "price_optimization":
        return price_features(df, tiers=tiers)
    return df


def preprocess(
    df: DataFrame, blueprint: str, as_of: Column, config: PreprocessConfig | None = None, *, keys: Sequence[str] | None = None,
    store: bool = True,
) -> tuple[DataFrame, FittedPreprocess]:
    """Impute, cap, build features, encode and scale; keys and timestamps pass through.

    With ``store`` the feature table is written once to shared scratch space, so that the later fits and
    the result do not compute the features again.
    """
    config = config or PreprocessConfig()
    name = get_blueprint(blueprint).name
    keys = list(KEY_COLUMNS.get(name, []) if keys is None else keys)
    untouched = [c for c in keys if c in df.columns] + ([config.target] if config.target else [])
    skip = [] if config.encode_keys else untouched

    impute = C.fit_impute(df, config.missing_value_strategy, skip=untouched, exact=config.exact)
    imputed = impute.transform(df)
    cap = C.fit_cap(imputed, config.outlier_method, skip=untouched, exact=config.exact)
    capped = cap.transform(imputed)
    churn = fit_churn_features(capped, as_of) if name == "customer_churn" else None
    tiers = fit_price_tiers(capped) if name == "price_optimization" else None
    featured = _features(capped, name, as_of, churn, tiers)
    if store and featured is not capped:
        featured = materialise(featured, f"{name}-features")
    encode = C.fit_encode(featured, config.encoding_strategy, skip=skip, target=config.target)
    encoded = encode.transform(featured)
    scale = C.fit_scale(encoded, config.scaling_method, skip=untouched, exact=config.exact)
    scaled = scale.transform(encoded)
    result = C.unique_columns(scaled)
    narrow = C.fit_narrow(result, skip=untouched if config.narrow else result.columns, drop_empty=True)
    result = narrow.transform(result)

    fitted = FittedPreprocess(name, as_of, impute, cap, churn, encode, scale, narrow, tiers)
    fitted.report += [("impute", c, s) for c, s in impute.strategies.items()]
    fitted.report += [("cap", c, f"{cap.method} [{lo:.2f}, {hi:.2f}]") for c, (lo, hi) in cap.bounds.items()]
    fitted.report += [("feature", c, "created") for c in featured.columns if c not in df.columns]
    fitted.report += [("encode", c, m) for c, m in encode.methods.items()]
    fitted.report += [("scale", c, scale.method) for c in scale.centers]
    fitted.report += [("narrow", c, t) for c, t in narrow.types.items()]
    return result, fitted


def report_table(df: DataFrame, fitted: FittedPreprocess) -> DataFrame:
    """What each step did to which column."""
    return df.sparkSession.createDataFrame(fitted.report, "step string, column string, detail string")


def mixed_preprocess(df: DataFrame, *, skip: Sequence[str] = (), groups: Sequence[str] = ()) -> DataFrame:
    """Numbers: impute, standardise, clip; text: fill ``unknown`` and one-hot; timestamps: calendar columns.

    Column names get the prefix of their branch. With ``groups`` numbers are filled by group median.
    """
    from plumbline.functions.scalars import datetime_parts

    numbers = [c for c in C.numeric_columns(df) if c not in skip]
    text = [c for c in C.string_columns(df) if c not in skip]
    times = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) and f.name not in skip]
    if groups:
        for c in numbers:
            df = C.group_median_impute(df, c, groups)
    df = C.fit_impute(df, "median", columns=numbers).transform(df)
    scaled = C.fit_scale(df, "standard", columns=numbers).transform(df)
    clipped = C.fit_cap(scaled, "iqr", columns=numbers).transform(scaled)
    encode = C.fit_encode(clipped, "onehot", columns=text, fill="unknown", dummy_missing=False)
    parts = {n: c for t in times for n, c in datetime_parts(t).items()}
    out = encode.transform(clipped.withColumns(parts) if parts else clipped).drop(*times)
    return out.withColumnsRenamed({c: f"num_{c}" for c in numbers})
