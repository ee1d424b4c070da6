"""Random forest nowcasts and forecasts, pooled over all series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.operators.forest import Forest, fit_forests, predict_forests
from tidemark.operators.lookup import null_safe_join
from tidemark.operators.monthly import annual_sum, history_and_future, with_balance, with_lags
from tidemark.operators.ranking import split_train_test
from tidemark.operators.stats import fill_with_mean, trend
from tidemark.session import materialise

LAGS = ["lag1", "lag2", "lag3"]
#: Trees grow until their leaves are pure.
DEPTH = None


def training_frame(
    df: DataFrame, inputs: list[str], labels: list[str], keys: list[str]
) -> DataFrame:
    """Training rows, written once. The keys tell rows apart that are equal otherwise."""
    cols = list(dict.fromkeys([*keys, *inputs, *labels]))
    return materialise(df.select(*[F.col(f"`{c}`") for c in cols]), "train")


def fit_forest(
    train: DataFrame, inputs: list[str], label: str, trees: int, depth: int | None = DEPTH, seed: int = 42,
    bootstrap: bool = True,
) -> Forest:
    """All inputs are tried at every split, rows are bootstrapped; null labels are left out."""
    return fit_forests(train, inputs, [label], trees, depth, seed, bootstrap)[label]


def predict(model: Forest, df: DataFrame, inputs: list[str], out: str) -> DataFrame:
    """Add a prediction; null where an input is missing."""
    return predict_forests({out: model}, df, inputs, {out: out})


def fit_lag_forest(
    annual: DataFrame,
    keys: list[str],
    first_year: int,
    last_year: int,
    value: str = C.VALUE,
    trees: int = 300,
    depth: int | None = DEPTH,
    seed: int = 42,
) -> Forest:
    """Forest on three lags, trained on the complete rows of the given years."""
    lagged = with_lags(annual, keys, value)
    rows = lagged.where(F.col(C.YEAR).between(first_year, last_year)).na.drop(
        subset=[value, *LAGS]
    )
    train = training_frame(rows, LAGS, [value], [*keys, C.YEAR])
    return fit_forest(train, LAGS, value, trees, depth, seed)


def recursive_forecast(
    model: Forest,
    annual: DataFrame,
    keys: list[str],
    years: list[int],
    value: str = C.VALUE,
    seed_from: str = "last_row",
) -> DataFrame:
    """Predict the years one after the other, each prediction feeding the next lags.

    ``seed_from="last_row"`` starts from the latest known year even when it lies after
    the gap; ``"before_gap"`` from the last year before the first forecast. The state is
    one row per series and the steps are narrow: one pass, no window or union per step.
    """
    if seed_from not in ("last_row", "before_gap"):
        raise ValueError("seed_from must be 'last_row' or 'before_gap'")
    known = annual if seed_from == "last_row" else annual.where(F.col(C.YEAR) < min(years))
    w_last = F.max_by(F.struct(F.col(value).alias("lag1"), F.col("lag1").alias("lag2"),
                               F.col("lag2").alias("lag3")), F.col(C.YEAR))
    state = (
        with_lags(known, keys, value, 2).groupBy(*keys).agg(w_last.alias("s")).select(*keys, "s.*")
    )
    for i in range(len(years)):
        step = f"p{i}"
        state = predict(model, state, LAGS, step).select(
            *keys,
            *[f"p{j}" for j in range(i)],
            step,
            F.col(step).alias("lag1"),
            F.col("lag1").alias("lag2"),
            F.col("lag2").alias("lag3"),
        )
    rows = F.array(
        *[
            F.struct(F.lit(y).alias(C.YEAR), F.col(f"p{i}").alias(value))
            for i, y in enumerate(years)
        ]
    )
    return state.select(*keys, F.inline(rows))


def extend_indicators(
    mart: DataFrame,
    indicators: list[str],
    keys: list[str],
    cut_year: int,
    value: str = C.VALUE,
    trees: int = 100,
    depth: int | None = DEPTH,
    seed: int = 42,
) -> DataFrame:
    """Overwrite the indicators after ``cut_year`` by one forest each on the monthly value.

    The forests of all indicators are grown together and score in one pass.
    """
    past = mart.where(F.col(C.YEAR) <= cut_year).na.drop(subset=[value])
    train = training_frame(past, [value], indicators, [*keys, C.DATE])
    models = fit_forests(train, [value], indicators, trees, depth, seed)
    names = {ind: f"pred__{i}" for i, ind in enumerate(indicators)}
    out = predict_forests(models, mart, [value], names)
    later = F.col(C.YEAR) > cut_year
    extended = {ind: F.when(later, F.col(name)).otherwise(F.col(f"`{ind}`")) for ind, name in names.items()}
    return out.withColumns(extended).drop(*names.values())


def forecast_with_trend(
    annual: DataFrame,
    keys: list[str],
    inputs: list[str],
    target: str,
    fitted: str,
    horizon: int = 4,
    trees: int = 400,
    depth: int = 5,
    noise: float = 0.5,
    seed: int = 42,
    last_year: int | None = None,
) -> DataFrame:
    """In-sample fit plus ``horizon`` years whose inputs follow their linear trend.

    Four fifths of each series train the forest; its predictions cover all years. The horizon
    begins after ``last_year``, for instance the last of an unfiltered table, or else after the
    last year of each series.
    """
    annual = materialise(annual, "annual")
    filled = fill_with_mean(annual.withColumn("label__v", F.col(f"`{target}`")), keys, "label__v")
    split = split_train_test(filled, keys, [*keys, C.YEAR], seed=seed)
    train = training_frame(split.where(~F.col("is_test")), inputs, ["label__v"], [*keys, C.YEAR])
    model = fit_forest(train, inputs, "label__v", trees, depth, seed)
    history = predict(model, annual, inputs, fitted)
    last = None if last_year is None else F.lit(last_year)
    future = predict(model, trend(annual, keys, inputs, horizon, noise, seed, last), inputs, fitted)
    return history_and_future(history, future, keys, target, fitted)


def rolling_holdout(
    annual: DataFrame,
    keys: list[str],
    origins: list[int],
    value: str = C.VALUE,
    trees: int = 100,
    depth: int | None = DEPTH,
    seed: int = 42,
) -> DataFrame:
    """One row per origin and series: the year after the origin as known, as the lag forest, the
    trend and the year before tell it, and the absolute errors.

    Nothing after an origin is used for its forecasts. The forests of all origins are grown together,
    as one label each, known up to its origin only. Years with a missing value are left out, so the year before is
    the last known one. A series with fewer than three known years has no forest value, with fewer than two no
    trend; without the year after the origin it has no row.
    """
    lagged = with_lags(annual.where(F.col(value).isNotNull()), keys, value)
    rows = materialise(lagged.select(*keys, C.YEAR, F.col(value).alias("actual"), *LAGS), "holdout")
    known = rows.where(F.col(C.YEAR) <= max(origins)).na.drop(subset=LAGS)
    labels = {o: f"until__{o}" for o in origins}
    train = known.withColumns({name: F.when(F.col(C.YEAR) <= o, F.col("actual")) for o, name in labels.items()})
    models = fit_forests(training_frame(train, LAGS, list(labels.values()), [*keys, C.YEAR]), LAGS, list(labels.values()), trees, depth, seed)
    after = {o: rows.where(F.col(C.YEAR) == o + 1).withColumn("origin", F.lit(o)) for o in origins}
    out = None
    for o in origins:
        line = trend(rows.where(F.col(C.YEAR) <= o), keys, ["actual"], 1, 0, seed, F.lit(o))
        line = line.select(*keys, F.col("actual").alias("trend"))
        told = predict(models[labels[o]], after[o], LAGS, "forest").withColumn("last", F.col("lag1"))
        part = null_safe_join(told, line, keys)
        out = part if out is None else out.unionByName(part)
    errors = {f"{how}_error": F.abs(F.col(how) - F.col("actual")) for how in ("forest", "trend", "last")}
    return out.drop(*LAGS).withColumns(errors)


def forecast_arrivals(monthly: DataFrame, keys: list[str], **options) -> DataFrame:
    """Year, actual and fitted arrivals, then four forecast years."""
    annual = annual_sum(monthly, keys, [C.VALUE])
    out = forecast_with_trend(annual, keys, [C.VALUE], C.VALUE, "Prévision Arrivées", **options)
    return out.withColumnRenamed(C.VALUE, "Arrivées")


def forecast_balance(mart: DataFrame, keys: list[str], **options) -> DataFrame:
    """Year, actual and fitted balance from receipts and expenses, then four forecast years."""
    annual = with_balance(annual_sum(mart, keys, [C.RECEIPTS, C.EXPENSES]))
    return forecast_with_trend(
        annual, keys, [C.RECEIPTS, C.EXPENSES], C.BALANCE, "Valeur", **options
    )
