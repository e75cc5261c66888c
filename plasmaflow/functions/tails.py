"""Arrow UDFs over the distribution functions; null in, null out. Each distinct tuple of arguments in an Arrow batch is evaluated once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plasmaflow.functions import special


def _once(f: Callable[[list[np.ndarray]], np.ndarray], columns: tuple[pd.Series, ...], width: int) -> np.ndarray:
    """f over the distinct argument tuples of a batch, a row of `width` results for each row; nan where an argument is null."""
    arrays = np.stack([c.to_numpy(float, na_value=np.nan) for c in columns], axis=1)
    out = np.full((len(arrays), width), np.nan)
    known = ~np.isnan(arrays).any(axis=1)
    if known.any():
        distinct, back = np.unique(arrays[known], axis=0, return_inverse=True)
        out[known] = f(list(distinct.T))[back.reshape(-1)]
    return out


def _udf(f: Callable[..., np.ndarray]) -> Callable[..., Column]:
    @F.pandas_udf(T.DoubleType())
    def run(*columns: pd.Series) -> pd.Series:
        out = _once(lambda arrays: np.asarray(f(*arrays), float).reshape(-1, 1), columns, 1)[:, 0]
        return pd.Series(out).astype("Float64").mask(np.isnan(out), pd.NA).astype(object).where(~np.isnan(out), None)

    return lambda *columns: run(*(F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in columns))


poisson_two_sided = _udf(special.poisson_two_sided)
poisson_greater = _udf(lambda k, lam: special.poisson_tail(k, lam, "greater"))
poisson_less = _udf(lambda k, lam: special.poisson_tail(k, lam, "less"))
binom_two_sided = _udf(special.binom_two_sided)
binom_greater = _udf(special.binom_sf)
binom_less = _udf(lambda k, n, p: special.binom_tail(k, n, p, "less"))
beta_binomial_sf = _udf(special.beta_binomial_sf)
fisher = _udf(special.fisher_two_sided)
beta_ppf = _udf(special.beta_ppf)
norm_isf = _udf(special.norm_isf)
norm_sf = _udf(special.norm_sf)
t_quantile = _udf(special.t_quantile)
chi2_sf = _udf(special.chi2_sf)
kolmogorov_sf = _udf(special.kolmogorov_sf)


def _struct_udf(fields: list[str], f: Callable[..., tuple[np.ndarray, ...]]) -> Callable[..., Column]:
    """Like `_udf` for a function of several results: a struct of doubles, null where an argument is."""

    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in fields]))
    def run(*columns: pd.Series) -> pd.DataFrame:
        out = _once(lambda arrays: np.stack(f(*arrays), axis=1), columns, len(fields))
        return pd.DataFrame({n: pd.Series(out[:, i]).astype(object).where(~np.isnan(out[:, i]), None) for i, n in enumerate(fields)})

    return lambda *columns: run(*(F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in columns))


#: By alternative: (k, n, p) to the exact binomial p_value and the Clopper-Pearson bounds ci_lower and ci_upper of k / n.
binomial_test = {a: _struct_udf(["p_value", "ci_lower", "ci_upper"], lambda k, n, p, a=a: (special.binom_tail(k, n, p, a), *special.clopper_pearson(k, n, a))) for a in ("greater", "less", "two-sided")}
#: (a, b, c, d) to Fisher's two-sided p_value and the odds_ratio a d / (b c): null where a margin is empty, infinite where only b c is 0.
fisher_test = _struct_udf(["p_value", "odds_ratio"], lambda a, b, c, d: (special.fisher_two_sided(a, b, c, d), special.odds_ratio(a, b, c, d)))


def poisson_power(null: str | Column, alt: str | Column, alpha: float) -> Column:
    return _udf(lambda a, b: special.poisson_power(a, b, alpha))(null, alt)
