"""Dense numeric kernels on numpy arrays: cointegration and spread statistics of one window."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

# Trace critical values at 90, 95 and 99 percent, by the number of assets less the rank, from 0 on.
TRACE_CRIT = np.array([
    [0.0, 0.0, 0.0],
    [2.7055, 3.8415, 6.6349],
    [13.4294, 15.4943, 19.9349],
    [27.0669, 29.7961, 35.4628],
    [44.4929, 47.8545, 54.6815],
    [65.8202, 69.8189, 77.8202],
    [91.1090, 95.7542, 104.9637],
    [120.3673, 125.6185, 136.0600],
    [153.6341, 159.5290, 171.0905],
    [190.8714, 197.3772, 210.0366],
    [232.1030, 239.2468, 253.2526],
    [277.3740, 285.1402, 300.2821],
    [326.5354, 334.9795, 351.2150],
])
# Response surfaces of the unit-root test with a constant, at 1, 5 and 10 percent.
ADF_CRIT = np.array([[-3.4336, -5.999, -29.25], [-2.8621, -2.738, -8.36], [-2.5671, -1.438, -4.48]])

RIDGE = 1e-10


def phi(x: float) -> float:
    """Distribution function of the standard normal."""
    return 0.5 * (1.0 + math.erf(x / math.sqrt(2.0)))


def critical(n: int) -> np.ndarray:
    return TRACE_CRIT[n] if 0 < n < len(TRACE_CRIT) else TRACE_CRIT[-1] * (n / 12.0)


@dataclass
class Johansen:
    rank: int
    trace_stats: np.ndarray
    eigenvalues: np.ndarray
    eigenvectors: np.ndarray
    crit_values: np.ndarray
    p_value: float
    score: float


def trace_p_value(trace: float, crit: np.ndarray) -> float:
    c90, c95, c99 = crit
    if trace >= c99:
        p = 0.005
    elif trace >= c95:
        p = 0.05 - 0.04 * (trace - c95) / (c99 - c95)
    elif trace >= c90:
        p = 0.10 - 0.05 * (trace - c90) / (c95 - c90)
    else:
        p = 0.50
    return min(max(p, 0.001), 1.0)


def regressors(data: np.ndarray, det_order: int, lags: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None] | None:
    """Differences, lagged levels (with a column of ones unless det_order < 0) and lagged differences, latest lag first."""
    t, n = data.shape
    if t < n + lags + 10 or lags >= t - 1:
        return None
    steps = np.diff(data, axis=0)
    rows = t - 1 - lags
    levels = data[lags : t - 1]
    if det_order >= 0:
        levels = np.hstack([levels, np.ones((rows, 1))])
    if rows < levels.shape[1] + 5:
        return None
    past = np.hstack([steps[lags - j : t - 1 - j] for j in range(1, lags + 1)]) if lags else None
    return steps[lags:], levels, past


def johansen(data: np.ndarray, det_order: int = 0, lags: int = 1) -> Johansen | None:
    """Trace test of a rows x assets matrix; None if it cannot be done."""
    parts = regressors(np.asarray(data, float), det_order, lags)
    if parts is None:
        return None
    steps, levels, past = parts
    rows, n = steps.shape
    try:
        if past is None:
            r0, r1 = steps - steps.mean(0), levels - levels.mean(0)
        else:
            both = np.linalg.solve(past.T @ past, past.T @ np.hstack([steps, levels]))
            r0, r1 = steps - past @ both[:, :n], levels - past @ both[:, n:]
        s00, s11, s01 = r0.T @ r0 / rows, r1.T @ r1 / rows, r0.T @ r1 / rows
        lower = np.linalg.cholesky(s11 + RIDGE * np.eye(len(s11)))
        half = np.linalg.solve(lower, s01.T @ np.linalg.solve(s00, s01))
        core = np.linalg.solve(lower, half.T)
        values, vectors = np.linalg.eigh((core + core.T) / 2)
    except np.linalg.LinAlgError:
        return None
    if not np.isfinite(values).all():
        return None
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], np.linalg.solve(lower.T, vectors[:, order])
    clipped = np.clip(values, 0.0, 1.0 - 1e-15)
    logs = np.log(np.maximum(1.0 - clipped[:n], 1e-15))
    stats = -rows * np.cumsum(logs[::-1])[::-1]
    crit = np.array([critical(n - r) for r in range(n)])
    over = stats > crit[:, 1]
    rank = n if over.all() else int(np.argmin(over))
    return Johansen(rank, stats, clipped, vectors, crit, trace_p_value(stats[0], crit[0]), stats[0] / crit[0, 1])


def hedge_vector(result: Johansen, n: int) -> np.ndarray:
    """The first eigenvector's weights of the assets, relative to the first."""
    v = result.eigenvectors[:n, 0]
    return v / v[0] if abs(v[0]) > 1e-15 else v.copy()


class Moments:
    """One window's cross products, from which the trace statistic of every subset of its assets follows.

    With m the matrix of products of [differences | levels | ones | lagged differences], all blocks of a subset are Schur
    complements of sub-blocks of m, and the statistic is T (ln det S00 - ln det (S00 - S01 S11^-1 S10)).
    """

    def __init__(self, data: np.ndarray, det_order: int = 0, lags: int = 1):
        data = np.asarray(data, float)
        self.n, self.lags, self.det_order, self.rows = data.shape[1], lags, det_order, data.shape[0]
        spread = data.std(0)
        self.data = data / np.where(spread > 0, spread, 1.0)  # the statistic does not depend on scale
        parts = regressors(self.data, det_order, lags)
        self.usable = parts is not None
        if self.usable:
            steps, levels, past = parts
            if past is None:
                steps, levels = steps - steps.mean(0), levels - levels.mean(0)
            blocks = [steps, levels] + ([] if past is None else [past])
            joined = np.hstack(blocks)
            self.eff = len(steps)
            self.products = joined.T @ joined / self.eff

    def trace(self, subsets: np.ndarray) -> np.ndarray:
        """Statistics of subsets of one size (rows of indices); NaN where the test cannot be done."""
        k = subsets.shape[1]
        out = np.full(len(subsets), np.nan)
        m = k + (self.det_order >= 0)
        if not self.usable or self.rows < k + self.lags + 10 or self.eff < m + 5:
            return out
        own = [subsets, self.n + subsets]
        if self.det_order >= 0:
            own.append(np.full((len(subsets), 1), 2 * self.n))
        base = 2 * self.n + (self.det_order >= 0)
        own += [base + j * self.n + subsets for j in range(self.lags)]
        at = np.hstack(own)
        g = self.products[at[:, :, None], at[:, None, :]]
        a, b = k, k + m
        with np.errstate(all="ignore"):
            try:
                if self.lags:
                    past = g[:, b:, b:]
                    s = g[:, :b, :b] - g[:, :b, b:] @ np.linalg.solve(past, g[:, b:, :b])
                else:
                    s = g
                s00, s01, s11 = s[:, :a, :a], s[:, :a, a:b], s[:, a:b, a:b] + RIDGE * np.eye(m)
                rest = s00 - s01 @ np.linalg.solve(s11, np.swapaxes(s01, 1, 2))
            except np.linalg.LinAlgError:
                return np.array([self._alone(x) for x in subsets])
            sign0, log0 = np.linalg.slogdet(s00)
            sign1, log1 = np.linalg.slogdet(rest)
            found = self.eff * (log0 - log1)
        crit = critical(k)[1]
        doubt = (sign0 <= 0) | (sign1 <= 0) | ~np.isfinite(found) | (np.abs(found / crit - 1) < 1e-5)
        for i in np.flatnonzero(doubt):  # close calls and odd matrices go through the eigenvalues
            found[i] = self._alone(subsets[i])
        return found

    def _alone(self, subset: np.ndarray) -> float:
        result = johansen(self.data[:, subset], self.det_order, self.lags)
        return np.nan if result is None else float(result.trace_stats[0])


def _least_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    try:
        inverse = np.linalg.inv(x.T @ x)
    except np.linalg.LinAlgError:
        return None
    beta = inverse @ (x.T @ y)
    return beta, y - x @ beta, inverse


def _adf_design(series: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    steps = np.diff(series)
    rows = len(steps) - lag
    past = [steps[lag - j : lag - j + rows] for j in range(1, lag + 1)]
    return np.column_stack([np.ones(rows), series[lag : lag + rows], *past]), steps[lag:]


def adf_lag(series: np.ndarray, max_lag: int) -> int:
    """The lag with the smallest AIC, each on its own sample; of equals the lowest."""
    best, chosen = math.inf, 0
    for lag in range(max_lag + 1):
        rows = len(series) - 1 - lag
        if rows < lag + 5:
            break
        x, y = _adf_design(series, lag)
        fit = _least_squares(x, y)
        sse = float(fit[1] @ fit[1]) if fit else 0.0
        if sse > 0:
            aic = rows * math.log(sse / rows) + 2.0 * (2 + lag)
            if aic < best:
                best, chosen = aic, lag
    return chosen


def adf_statistic(series: np.ndarray, lag: int) -> tuple[float, int] | None:
    """t-value of the level and the number of rows; None where no test can be done."""
    x, y = _adf_design(series, lag)
    if len(y) < lag + 5:
        return None
    fit = _least_squares(x, y)
    if fit is None:
        return None
    beta, rest, inverse = fit
    variance = float(rest @ rest) / (len(y) - x.shape[1])
    if not variance > 0:
        return None
    error = math.sqrt(max(variance * inverse[1, 1], 0.0))
    return None if error < 1e-15 else (float(beta[1]) / error, len(y))


def adf_p_value(series: np.ndarray) -> float:
    series = np.asarray(series, float)
    n = len(series)
    if n < 20:
        return 1.0
    found = adf_statistic(series, adf_lag(series, min(int(12.0 * (n / 100.0) ** 0.25), n // 4)))
    if found is None:
        return 1.0
    t, rows = found
    c1, c5, c10 = ADF_CRIT @ [1.0, 1.0 / rows, 1.0 / rows**2]
    if t <= c1:
        return min(max(phi(0.3 * (t - c1)) * 0.01, 1e-4), 0.01)
    if t <= c5:
        return 0.01 + 0.04 * (t - c1) / (c5 - c1)
    if t <= c10:
        return 0.05 + 0.05 * (t - c5) / (c10 - c5)
    return min(max(0.1 + 0.9 * phi(0.5 * (t - c10)), 0.1), 1.0)


def half_life(series: np.ndarray) -> float:
    s = np.asarray(series, float)
    if len(s) < 10:
        return math.inf
    below = float(s[:-1] @ s[:-1])
    if below < 1e-15:
        return math.inf
    theta = float(s[:-1] @ np.diff(s)) / below
    return math.inf if theta >= 0 else -math.log(2.0) / theta


def hurst(series: np.ndarray, max_lag: int = 100) -> float:
    return float(hursts(np.asarray(series, float)[None, :], max_lag)[0])


def hursts(series: np.ndarray, max_lag: int = 100) -> np.ndarray:
    """The exponent of each row: the slope of ln(R/S) on ln(lag) over blocks of so many values."""
    count, n = series.shape
    if n < 20:
        return np.full(count, 0.5)
    lags = np.arange(2, min(max_lag, n // 2) + 1)
    means = np.zeros((count, len(lags)))
    for k, lag in enumerate(lags.tolist()):
        parts = series[:, : n // lag * lag].reshape(count, -1, lag)
        centred = parts - parts.mean(2, keepdims=True)
        walk = np.cumsum(centred, axis=2)
        deviation = np.sqrt((centred**2).mean(2))
        good = deviation > 1e-12
        ratio = np.where(good, (walk.max(2) - walk.min(2)) / np.where(good, deviation, 1.0), 0.0)
        means[:, k] = ratio.sum(1) / np.maximum(good.sum(1), 1)
    used = means > 0
    x, y = np.where(used, np.log(lags), 0.0), np.log(np.where(used, means, 1.0))
    m, sx, sy = used.sum(1), x.sum(1), y.sum(1)
    below = m * (x * x).sum(1) - sx**2
    told = (m >= 3) & (np.abs(below) >= 1e-12)
    return np.where(told, np.clip((m * (x * y).sum(1) - sx * sy) / np.where(told, below, 1.0), 0.0, 1.0), 0.5)


def variance_ratio(series: np.ndarray, lag: int = 10) -> float:
    s = np.asarray(series, float)
    if len(s) < lag + 10:
        return 1.0
    one = float(np.var(np.diff(s), ddof=1))
    return 1.0 if one < 1e-12 else float(np.var(s[lag:] - s[:-lag], ddof=1)) / lag / one
