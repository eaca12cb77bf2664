"""The Lasso as a path: coefficients are piecewise linear in alpha, so its knots say everything.

From large to small alpha a column enters when its gradient reaches alpha, and leaves when its coefficient reaches zero.
Between two knots nothing changes but along a straight line. Cross-validation errors are quadratic between the knots of all
folds, so the best alpha is found exactly, not on a grid.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .moments import Moments, fit_moments, total
from .regression import LassoModel
from .sampling import kfold

KNOTS = "step int, alpha double, feature string, change string, coefficients map<string,double>"
ENTERS, LEAVES = "enters", "leaves"


@dataclass
class Path:
    """Knots from the largest alpha on: ``coefs[k]`` at ``alphas[k]``; ``changes[k]``: (column, if it enters), none at the end."""

    alphas: np.ndarray
    coefs: np.ndarray
    changes: list[tuple[int, bool] | None]

    def at(self, alpha: float) -> np.ndarray:
        """Coefficients at any alpha: those of the first knot above it, of the last one below it."""
        k = int(np.searchsorted(-self.alphas, -alpha))
        if k == 0:
            return self.coefs[0].copy()
        if k == len(self.alphas):
            return self.coefs[-1].copy()
        high, low = self.alphas[k - 1], self.alphas[k]
        t = (high - alpha) / (high - low)
        return (1 - t) * self.coefs[k - 1] + t * self.coefs[k]

    def table(self, spark: SparkSession, names: Sequence[str]) -> DataFrame:
        """One row per knot; coefficients of zero are left out."""
        rows = []
        for k, (alpha, b, change) in enumerate(zip(self.alphas, self.coefs, self.changes)):
            feature, how = (None, None) if change is None else (names[change[0]], ENTERS if change[1] else LEAVES)
            rows.append((k, float(alpha), feature, how, {names[j]: float(b[j]) for j in np.flatnonzero(b)}))
        return spark.createDataFrame(rows, KNOTS)


def path(s: np.ndarray, c: np.ndarray, free: Sequence[int] = (), floor: float = 0.0, tol: float = 1e-12) -> Path:
    """Knots of  b'Sb/2 - c'b + alpha |b|_1  down to ``floor``; columns in ``free`` bear no penalty and are on from the start.

    A column that the active ones determine (to ``tol`` of its own size) does not enter. With equal gradients the
    first column enters first.
    """
    p, diag = len(c), np.diag(s).copy()
    on, sign = list(free), np.zeros(p)
    b = np.zeros(p)
    if on:
        b[on] = np.linalg.lstsq(s[np.ix_(on, on)], c[on], rcond=None)[0]
    shut = {j for j in range(p) if diag[j] <= tol * max(float(diag.max(initial=0.0)), 1e-300)}
    grad = c - s @ b
    outside = [j for j in range(p) if j not in on and j not in shut]
    alpha = float(np.max(np.abs(grad[outside]), initial=0.0))
    alphas, coefs, changes = [alpha], [b.copy()], []
    if not outside or alpha <= floor:
        return Path(np.array(alphas), np.array(coefs), [None])
    newest, left = int(outside[int(np.argmax(np.abs(grad[outside])))]), -1
    while True:
        if newest >= 0:
            others = [j for j in on if diag[j] > 0]
            rest = diag[newest]
            if others:
                rest -= s[newest, others] @ np.linalg.lstsq(s[np.ix_(others, others)], s[others, newest], rcond=None)[0]
            if rest <= tol * diag[newest]:
                shut.add(newest)
            else:
                on.append(newest)
                sign[newest] = np.sign(grad[newest])
                changes.append((newest, True))
        step = np.zeros(p)  # change of b as alpha falls by one
        if on:
            step[on] = np.linalg.solve(s[np.ix_(on, on)], sign[on])
        slope = s @ step
        best, who, enters = alpha - floor, -1, False
        for j in range(p):
            if j in on or j in shut:
                continue
            # the column that just left starts at the bound and moves away from it
            for reach, speed in ((alpha - grad[j], 1 - slope[j]), (alpha + grad[j], 1 + slope[j])):
                if speed > tol and not (j == left and reach <= 1e-9 * max(alpha, 1e-300)):
                    gamma = max(reach, 0.0) / speed
                    if gamma < best:
                        best, who, enters = gamma, j, True
        for j in on:
            if sign[j] and step[j] * sign[j] < 0:
                gamma = -b[j] / step[j]
                if 0 <= gamma < best and not (j == newest and gamma <= 0):
                    best, who, enters = gamma, j, False
        alpha, b = alpha - best, b + best * step
        left = -1
        if who >= 0 and not enters:
            on.remove(who)
            b[who] = sign[who] = 0.0
            left = who
        grad = c - s @ b
        if len(changes) < len(alphas):  # the column at the last knot did not enter after all: the line goes on
            alphas.pop(), coefs.pop()
        alphas.append(alpha), coefs.append(b.copy())
        if who < 0:
            changes.append(None)
            return Path(np.array(alphas), np.array(coefs), changes)
        if enters:
            newest = who
        else:
            newest = -1
            changes.append((who, False))


def _scaled(m: Moments, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sxx, sxy, _, _, _ = m.centred()
    return sxx / np.outer(scale, scale) / m.n, sxy / scale / m.n


def _scales(m: Moments) -> np.ndarray:
    sxx = m.centred()[0]
    scale = np.sqrt(np.maximum(np.diag(sxx), 0) / m.n)
    scale[scale < 1e-12] = 1.0
    return scale


def _error(held: Moments, fit_on: Moments, scale: np.ndarray):
    """Mean squared error on ``held`` as a quadratic form of the coefficients: (constant, linear, matrix)."""
    _, _, _, mx, my = fit_on.centred()
    # the residual is a (1, x, y) product with v(b) = (-(my - b'mx / scale), -b / scale, 1)
    p = len(scale)
    to = np.zeros((p + 2, p))
    to[0], to[1:-1] = mx / scale, -np.diag(1 / scale)
    base = np.zeros(p + 2)
    base[0], base[-1] = -my, 1.0
    a = held.a / held.n
    return float(base @ a @ base), to.T @ a @ base, to.T @ a @ to


def cv_from_moments(parts: dict[int, Moments], names: Sequence[str], unpenalized: Sequence[str] = ()) -> tuple[LassoModel, Path]:
    """The alpha with the smallest mean error over the folds, over all alphas, and the path of the whole table."""
    if not parts:
        raise ValueError("no complete row to fit")
    whole = total(parts)
    scale, free = _scales(whole), [list(names).index(n) for n in unpenalized]
    own = path(*_scaled(whole, scale), free)
    folds = []
    for held in parts.values():
        train = whole - held
        if held.n > 0 and train.n > 0:
            folds.append((path(*_scaled(train, scale), free), _error(held, train, scale)))
    knots = np.unique(np.concatenate([own.alphas, *[f.alphas for f, _ in folds], [0.0]]))[::-1]
    knots = knots[knots <= own.alphas[0]]

    def error(alpha: float) -> float:
        out = 0.0
        for f, (e, g, h) in folds:
            b = f.at(alpha)
            out += e + 2 * g @ b + b @ h @ b
        return out / max(len(folds), 1)

    best, least = float(own.alphas[0]), error(float(own.alphas[0]))
    for high, low in zip(knots, knots[1:]):
        left, middle, right = error(high), error((high + low) / 2), error(low)
        tries = [(right, low)]
        bend = 2 * (left + right - 2 * middle)  # of the parabola through the three points, on [0, 1]
        if bend > 0:
            t = (bend - (right - left)) / (2 * bend)
            if 0 < t < 1:
                alpha = high - t * (high - low)
                tries.append((error(alpha), alpha))
        for value, alpha in tries:
            if value < least * (1 - 1e-12):
                least, best = value, float(alpha)
    _, _, _, mx, my = whole.centred()
    model = LassoModel(list(names), own.at(best), mx + whole.shift[:-1], scale, my + whole.shift[-1], best, knots,
                       np.array([error(a) for a in knots]), int(round(whole.n)))
    return model, own


def lasso_knots(df: DataFrame, xs: Sequence[str], y: str, unpenalized: Sequence[str] = ()) -> DataFrame:
    """The whole path of standardised columns as rows of ``KNOTS``, from one data pass; missing regressors count as zero."""
    m = fit_moments(df.fillna(0.0, list(xs)), xs, y)
    if () not in m:
        return df.sparkSession.createDataFrame([], KNOTS)
    scale = _scales(m[()])
    return path(*_scaled(m[()], scale), [list(xs).index(n) for n in unpenalized]).table(df.sparkSession, list(xs))


def lasso_cv_knots(df: DataFrame, xs: Sequence[str], y: str, folds: int = 5, key: Sequence[str] = (), unpenalized: Sequence[str] = (),
                   seed: int = 42) -> LassoModel:
    """As ``regression.lasso_cv``, with alpha from the whole path instead of a grid."""
    data = kfold(df.where(df[y].isNotNull()).fillna(0.0, list(xs)), folds, list(key) or [*xs, y], seed)
    parts = fit_moments(data, xs, y, ["fold"])
    return cv_from_moments({k[0]: m for k, m in parts.items()}, xs, unpenalized)[0]
