"""Linear systems and their identification: mode decompositions read off, sparse dynamics with inputs, state space, sensing.

Kernels take the arrays of one series; transfer entropies of labels are aggregations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.operators import dynamics, signal
from tidewave.operators.grouped import table
from tidewave.operators.models import lcg
from tidewave.operators.series import ID, over


def snapshots(states) -> np.ndarray:
    """States, or rows of an embedding, as columns; all of one length."""
    rows = [np.asarray(s, float) for s in states]
    if not rows or len({len(r) for r in rows}) > 1:
        raise ValueError("states of one length are needed")
    return np.stack(rows, axis=1)


def dmd_at(fit: dict, t: float, dt: float) -> np.ndarray:
    """The state at time t of a decomposition of snapshots dt apart."""
    return (fit["modes"] @ (fit["amplitudes"] * np.exp(np.log(fit["values"].astype(complex)) / dt * t))).real


def dmd_error(fit: dict, x: np.ndarray) -> float:
    """Mean distance of the reconstructed snapshots from x, each over its length (at least 1e-15); 0 for none."""
    if not x.shape[1]:
        return 0.0
    off = np.linalg.norm(dynamics.dmd_predict(fit, x.shape[1]) - x, axis=0)
    return float((off / np.maximum(np.linalg.norm(x, axis=0), 1e-15)).mean())


def input_library(x: np.ndarray, u: np.ndarray, degree: int = 2, input_degree: int = 1, constant: bool = True, products: bool = True) -> np.ndarray:
    """Monomials of the states, then of the inputs without a constant, then all products of the two but for the constant."""
    a, b = dynamics.polynomial_library(x, degree, constant), dynamics.polynomial_library(u, input_degree, False)
    both = (a[:, int(constant) :, None] * b[:, None, :]).reshape(len(a), -1) if products else np.zeros((len(a), 0))
    return np.concatenate([a, b, both], axis=1)


def sindyc(x: np.ndarray, u: np.ndarray, dt: float | None = None, dx: np.ndarray | None = None, threshold: float = 0.1, most: int = 10, ridge: float = 0.0, **library) -> dict:
    """Sparse coefficients[term, state] of dx/dt over the library of states and inputs, with the mean relative error of the fit.

    Rows are samples; without dx it is the forward difference over dt. Coefficients under the threshold are dropped and the
    others fitted anew, most times at most.
    """
    if dx is None:
        x, u, dx = x[:-1], u[:-1], np.diff(x, axis=0) / dt
    lib = input_library(x, u, **library)
    solve = lambda a, b: np.linalg.solve(a.T @ a + ridge * np.eye(a.shape[1]), a.T @ b) if ridge else np.linalg.lstsq(a, b, rcond=None)[0]
    xi = solve(lib, dx)
    for _ in range(most):
        keep = np.abs(xi) >= threshold
        new = np.zeros_like(xi)
        for j in range(dx.shape[1]):
            if keep[:, j].any():
                new[keep[:, j], j] = solve(lib[:, keep[:, j]], dx[:, j])
        done = np.allclose(new, xi, rtol=0, atol=1e-12)
        xi = new
        if done:
            break
    scale = np.linalg.norm(dx, axis=0)
    error = np.linalg.norm(dx - lib @ xi, axis=0) / np.where(scale > 1e-15, scale, 1.0)
    return {"xi": xi, "library": library, "error": float(error.mean())}


def sindyc_rate(fit: dict, x: np.ndarray, u: np.ndarray) -> np.ndarray:
    return (input_library(np.atleast_2d(x), np.atleast_2d(u), **fit["library"]) @ fit["xi"])[0]


def sindyc_run(fit: dict, x0: np.ndarray, inputs: np.ndarray, dt: float) -> np.ndarray:
    """States from x0 on by Euler steps, one for each row of inputs."""
    out = [np.asarray(x0, float)]
    for u in inputs:
        out.append(out[-1] + dt * sindyc_rate(fit, out[-1], u))
    return np.array(out)


def sparsity(fit: dict, tol: float = 1e-12) -> int:
    """How many coefficients are larger than tol."""
    return int((np.abs(fit["xi"]) > tol).sum())


def closed_loop(a: np.ndarray, b: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """A - B K."""
    return a - b @ gain


@dataclass(frozen=True)
class LinearSystem:
    """x' = A x + B u, y = C x + D u in whole steps; without B or D inputs count for nothing there."""

    a: np.ndarray
    c: np.ndarray
    b: np.ndarray | None = None
    d: np.ndarray | None = None

    def __post_init__(self) -> None:
        n = len(self.a)
        fits = self.a.shape == (n, n) and self.c.shape[1] == n and (self.b is None or len(self.b) == n)
        fits = fits and (self.d is None or self.b is not None and self.d.shape == (len(self.c), self.b.shape[1]))
        if not fits:
            raise ValueError("the matrices don't fit one another")

    def step(self, x: np.ndarray, u: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(the next state, the output of this one)."""
        put = lambda m: 0.0 if m is None or u is None else m @ np.atleast_1d(u)
        return self.a @ x + put(self.b), self.c @ x + put(self.d)

    def simulate(self, x0: np.ndarray, inputs) -> tuple[np.ndarray, np.ndarray]:
        """(the states from x0 on, one more than there are inputs; the output at each input). An input may be None."""
        xs, ys = [np.asarray(x0, float)], []
        for u in inputs:
            x, y = self.step(xs[-1], u)
            xs.append(x)
            ys.append(y)
        return np.array(xs), np.array(ys).reshape(len(ys), len(self.c))

    def feedback(self, gain: np.ndarray) -> LinearSystem:
        """The system under u = r - K x, r being the new input."""
        if self.b is None:
            raise ValueError("feedback needs an input")
        return LinearSystem(closed_loop(self.a, self.b, gain), self.c, self.b, self.d)

    def responses(self, df: DataFrame, x0, names: list[str]) -> DataFrame:
        """df of series (series_id, i, x) with the outputs, under their names, to x as the only input, each series from x0."""

        def run(x: np.ndarray, i: np.ndarray) -> dict:
            return {"i": i} | dict(zip(names, self.simulate(np.asarray(x0, float), x)[1].T, strict=True))

        return table(df, run, f"i {dict(df.dtypes)['i']}, " + ", ".join(f"{n} double" for n in names), columns=["x", "i"])


def double_integrator(dt: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A, B, C) of position and velocity moved by an acceleration."""
    if dt <= 0:
        raise ValueError("a time step above 0 is needed")
    return np.array([[1, dt], [0, 1.0]]), np.array([[dt * dt / 2], [dt]]), np.array([[1.0, 0]])


def local_linear_trend(z: np.ndarray, dt: float, q_level: float, q_drift: float, r: float) -> dict:
    """Level and drift from measurements of the level, from 0 with variance 1000."""
    return signal.kalman(z, np.array([[1, dt], [0, 1.0]]), np.array([[1.0, 0]]), np.diag([q_level, q_drift]), np.array([[r]]), np.zeros(2), np.eye(2) * 1e3)


def kalman_with_inputs(z: np.ndarray, u: np.ndarray, f, h, q, r, b, x0, p0) -> np.ndarray:
    """Filtered states of x' = F x + B u, z = H x, for rows of measurements and inputs."""
    x, p, out = np.asarray(x0, float), np.asarray(p0, float), []
    for m, v in zip(np.atleast_2d(z.T).T, np.atleast_2d(u.T).T, strict=True):
        x, p = f @ x + b @ v, f @ p @ f.T + q
        if np.isfinite(m).all():
            k = p @ h.T @ np.linalg.inv(h @ p @ h.T + r)
            x, p = x + k @ (m - h @ x), (np.eye(len(x)) - k @ h) @ p
        out.append(x)
    return np.array(out)


def decibels(magnitude: np.ndarray, least: float = -120.0) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.maximum(20 * np.log10(magnitude), least)


def gaussian_sensing(m: int, n: int, seed: int) -> np.ndarray:
    """m x n normal entries by the generator, columns of length 1."""
    draw, top = lcg(seed), float(2**64 - 1)
    u = np.array([next(draw) / top for _ in range(2 * m * n)]).reshape(n, m, 2)
    z = np.sqrt(-2 * np.log(np.clip(u[..., 0], 1e-12, 1 - 1e-12))) * np.cos(2 * np.pi * u[..., 1])
    phi = z.T / np.sqrt(m)
    size = np.linalg.norm(phi, axis=0)
    return phi / np.where(size > 1e-15, size, 1.0)


def row_selection(n: int, rows: list[int]) -> np.ndarray:
    return np.eye(n)[list(rows)]


def sensed(phi: np.ndarray, x: np.ndarray, basis: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(measurements of x, the sensing matrix of its coefficients in the basis)."""
    return phi @ x, phi if basis is None else phi @ basis


def restored(coefficients: np.ndarray, basis: np.ndarray | None = None) -> np.ndarray:
    return coefficients if basis is None else basis @ coefficients


def transfer_entropy_given(df: DataFrame, sources: list[str], target: str, given: list[str] | None = None) -> DataFrame:
    """(series_id, te) from the joint sources to the target, beside its own last value and those given; lag one, in nats."""
    z, s = ["p", *(given or [])], list(sources)
    d = df.select(ID, *s, *(given or []), F.col(target).alias("p"), F.lead(target).over(over()).alias("f")).where("f is not null")
    parts = {"a": ["f", *z], "b": z, "c": ["f", *z, *s], "d": [*z, *s]}
    h = [dynamics.entropy_of(d, [ID], cols).withColumnRenamed("h", f"h_{k}") for k, cols in parts.items()]
    j = h[0].join(h[1], ID).join(h[2], ID).join(h[3], ID)
    return j.select(ID, F.greatest(F.col("h_a") - F.col("h_b") - F.col("h_c") + F.col("h_d"), F.lit(0.0)).alias("te"))
