"""Nonlinear dynamics: embedding, recurrence, entropies, transfer entropy, phase, mode decompositions, control.

Kernels take arrays of one series; grouped.summary and grouped.table run them per series. Information measures of discrete
labels are also given as aggregations.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions.compat import NAN, finite
from tidewave.operators.grouped import MAX_SQUARE
from tidewave.operators.series import ID, over


def embed(x: np.ndarray, dim: int, tau: int) -> np.ndarray:
    """Rows of delayed samples x[k], x[k + tau], ..."""
    n = len(x) - (dim - 1) * tau
    return np.stack([x[j * tau : j * tau + n] for j in range(dim)], axis=1) if n > 0 else np.zeros((0, dim))


def fnn(x: np.ndarray, m: int, tau: int, rtol: float = 10.0, atol: float = 2.0, theiler: int = 0) -> float:
    """Share of points whose nearest neighbour in m dimensions is false in m + 1.

    False: the distance grows by over rtol times itself, or the new coordinates lie over atol apart. Neighbours within
    theiler samples don't count. NaN if the series is too short for a point, or no point has a neighbour.
    """
    wide = embed(np.asarray(x, float), m + 1, tau)
    n = len(wide)
    j = nearest(wide[:, :m], theiler)
    i = np.flatnonzero(j >= 0)
    j = j[i]
    near = np.sqrt(((wide[i, :m] - wide[j, :m]) ** 2).sum(1))
    step = np.abs(np.sqrt(((wide[i] - wide[j]) ** 2).sum(1)) - near)
    with np.errstate(divide="ignore", invalid="ignore"):
        bad = (step / near > rtol) | (np.abs(wide[i, m] - wide[j, m]) > atol)
    return float(bad.sum() / n) if len(i) else float("nan")


def nearest(a: np.ndarray, theiler: int = 0) -> np.ndarray:
    """The nearest other row of each row, by Euclidean distance and then by place; -1 if all lie within theiler rows.

    Equal rows are one point with several places. Points are swept outwards in the order of their first coordinate, all at
    once, each until that coordinate alone is farther away than the nearest found. Memory grows with the rows.
    """
    n = len(a)
    if not n:
        return np.zeros(0, np.int64)
    points, group = np.unique(a, axis=0, return_inverse=True)  # sorted by the first coordinate
    group = group.ravel()
    places = np.argsort(group, kind="stable")
    first, end = np.searchsorted(group[places], np.arange(len(points))), np.searchsorted(group[places], np.arange(len(points)), side="right")
    best, found = np.full(n, np.inf), np.full(n, -1)

    def look(rows: np.ndarray, at: np.ndarray) -> None:
        """Take the first place of the points at that is far enough in time, where it is nearer than what was found."""
        d = np.sqrt(((a[rows] - points[at]) ** 2).sum(1))
        ok = d <= best[rows]
        rows, at, d = rows[ok], at[ok], d[ok]
        k = first[at].copy()
        # places ascend: those within theiler of a row are at most 2 * theiler + 1 in a row
        for _ in range(2 * theiler + 2):
            close = (k < end[at]) & (np.abs(places[np.minimum(k, n - 1)] - rows) <= theiler)
            if not close.any():
                break
            k[close] += 1
        ok = k < end[at]
        rows, d, j = rows[ok], d[ok], places[k[ok]]
        ok = (d < best[rows]) | (d == best[rows]) & (j < found[rows])
        best[rows[ok]], found[rows[ok]] = d[ok], j[ok]

    for c in range(0, n, 1 << 15):
        rows = np.arange(c, min(c + (1 << 15), n))
        look(rows, group[rows])
        for side in (1, -1):
            live, step = rows, 1
            while len(live):
                at = group[live] + side * step
                ok = (at >= 0) & (at < len(points))
                live, at = live[ok], at[ok]
                ok = np.abs(points[at, 0] - a[live, 0]) <= best[live]
                live, at = live[ok], at[ok]
                look(live, at)
                step += 1
    return found


def close_pairs(a: np.ndarray, r: float, most: int = 1 << 18):
    """Blocks of (i, j), each pair of rows once, whose first coordinates lie within r; a float's breadth more may come."""
    order = np.argsort(a[:, 0], kind="stable")
    s = a[order, 0]
    hi = np.searchsorted(s, s + r * (1 + 1e-12) + 1e-300, side="right")
    n = np.maximum(hi - np.arange(len(s)) - 1, 0)
    done = np.r_[0, np.cumsum(n)]
    at = 0
    while at < len(s):
        to = max(int(np.searchsorted(done, done[at] + most, side="right")) - 1, at + 1)
        i = np.repeat(np.arange(at, to), n[at:to])
        j = np.arange(len(i)) - np.repeat(done[at:to] - done[at], n[at:to]) + i + 1
        yield order[i], order[j]
        at = to


def sample_entropy(x: np.ndarray, m: int, r: float) -> float:
    """-ln(A / B) of matches within r of templates of m + 1 and m samples; 0 for degenerate series. r is absolute."""
    x = np.asarray(x, float)
    if len(x) <= m + 1 or x.std() < 1e-12 or r < 1e-10:
        return 0.0
    wide = embed(x, m + 1, 1)
    b = a = 0
    for i, j in close_pairs(wide, r):
        near = np.abs(wide[i] - wide[j]) <= r
        short = near[:, :m].all(axis=1)
        b, a = b + int(short.sum()), a + int((short & near[:, m]).sum())
    return float(-np.log(a / b)) if a and b else 0.0


def cross_sample_entropy(x: np.ndarray, y: np.ndarray, m: int, r: float) -> float:
    """The same of templates of x against those of y, of as many samples as the shorter has."""
    n = min(len(x), len(y))
    if n <= m or r < 1e-10:
        return 0.0
    wide = np.concatenate([embed(np.asarray(s[:n], float), m + 1, 1) for s in (x, y)])
    half, b, a = len(wide) // 2, 0, 0
    for i, j in close_pairs(wide, r):
        across = (i < half) != (j < half)
        near = np.abs(wide[i[across]] - wide[j[across]]) <= r
        short = near[:, :m].all(axis=1)
        b, a = b + int(short.sum()), a + int((short & near[:, m]).sum())
    return float(-np.log(a / b)) if a and b else 0.0


def multiscale_entropy(x: np.ndarray, m: int, r: float, scales: int) -> np.ndarray:
    """Sample entropy of means of 1 to scales neighbouring samples, r the same for all."""
    return np.array([sample_entropy(x[: len(x) // s * s].reshape(-1, s).mean(1), m, r) for s in range(1, scales + 1)])


def _entropy(labels: np.ndarray) -> float:
    _, n = np.unique(labels, return_counts=True, axis=0)
    p = n / n.sum()
    return float(-(p * np.log(p)).sum())


def quantize(x: np.ndarray, bins: int) -> np.ndarray:
    """Bin of each value between interpolated quantiles."""
    return np.searchsorted(np.quantile(x, np.arange(1, bins) / bins), x, side="right")


def mutual_information_discrete(a: np.ndarray, b: np.ndarray) -> float:
    """H(a) + H(b) - H(a, b) in nats, not under 0; 0 for unequal lengths or none."""
    if len(a) != len(b) or not len(a):
        return 0.0
    return max(0.0, _entropy(a) + _entropy(b) - _entropy(np.stack([a, b], 1)))


def mutual_information(x: np.ndarray, y: np.ndarray, bins: int = 8) -> float:
    return mutual_information_discrete(quantize(x, bins), quantize(y, bins)) if len(x) == len(y) and len(x) else 0.0


def ami(x: np.ndarray, max_lag: int, bins: int = 8) -> np.ndarray:
    """Mutual information of x with itself lag samples later."""
    return cross_ami(x, x, max_lag, bins)


def cross_ami(driver: np.ndarray, target: np.ndarray, max_lag: int, bins: int = 8) -> np.ndarray:
    n = min(len(driver), len(target))
    return np.array([mutual_information(driver[: n - k], target[k:n], bins) if n - k > 1 else 0.0 for k in range(max_lag + 1)])


def first_local_minimum(v: np.ndarray) -> int | None:
    for k in range(1, len(v) - 1):
        if v[k] < v[k - 1] and v[k] <= v[k + 1]:
            return k
    return None


def transfer_entropy_discrete(source: np.ndarray, target: np.ndarray, k: int = 1, l: int = 1, tau: int = 1, horizon: int = 1, given: list[np.ndarray] | None = None) -> float:
    """H(future | past, given) - H(future | past, given, source's past) in nats, not under 0.

    k and l are how many past values of target and source are looked at, tau apart; given are further series, with k values each.
    """
    n = len(target)
    first = max((k - 1) * tau, (l - 1) * tau)
    at = np.arange(first, n - horizon)
    if len(source) != n or len(at) < 1:
        return 0.0
    past = lambda s, m: [s[at - j * tau] for j in range(m)]
    z = past(target, k) + [c for g in given or [] for c in past(g, k)]
    f, s = [target[at + horizon]], past(source, l)
    h = lambda cols: _entropy(np.stack(cols, 1))
    return max(0.0, (h(f + z) - h(z)) - (h(f + z + s) - h(z + s)))


def transfer_entropy(source: np.ndarray, target: np.ndarray, bins: int = 4, given: list[np.ndarray] | None = None, **kw) -> float:
    return transfer_entropy_discrete(quantize(source, bins), quantize(target, bins), given=[quantize(g, bins) for g in given or []], **kw) if len(source) else 0.0


def entropy_of(df: DataFrame, by: list[str], labels: list[str]) -> DataFrame:
    """(by, h): entropy in nats of the joint labels of each group, from grouped counts."""
    c = df.groupBy(*by, *labels).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    return c.groupBy(*by).agg((F.ln(F.sum("_n")) - F.sum(F.col("_n") * F.ln("_n")) / F.sum("_n")).alias("h"))


def mutual_information_labels(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """(by, mi) of two label columns, by aggregation only."""
    by = by or []
    h = [entropy_of(df, by, cols).withColumnRenamed("h", f"h{k}") for k, cols in enumerate(([a], [b], [a, b]))]
    j = h[0].join(h[1], by).join(h[2], by) if by else h[0].join(F.broadcast(h[1])).join(F.broadcast(h[2]))
    return j.select(*by, F.greatest(F.col("h0") + F.col("h1") - F.col("h2"), F.lit(0.0)).alias("mi"))


def transfer_entropy_labels(df: DataFrame, source: str, target: str) -> DataFrame:
    """(series_id, te): lag one, one past value each, by aggregation only."""
    d = df.select(ID, F.col(source).alias("s"), F.col(target).alias("p"), F.lead(target).over(over()).alias("f")).where("f is not null")
    h = {k: entropy_of(d, [ID], list(k)).withColumnRenamed("h", "h_" + k) for k in ("fp", "p", "fps", "ps")}
    j = h["fp"].join(h["p"], ID).join(h["fps"], ID).join(h["ps"], ID)
    return j.select(ID, F.greatest(F.col("h_fp") - F.col("h_p") - F.col("h_fps") + F.col("h_ps"), F.lit(0.0)).alias("te"))


def recurrence(a: np.ndarray, b: np.ndarray | None = None, radius: float = 0.5, theiler: int = 0) -> np.ndarray:
    """Whether rows of a and b lie within radius (Euclidean); a series' own pairs nearer than theiler samples don't count."""
    other = a if b is None else b
    if len(a) > MAX_SQUARE or len(other) > MAX_SQUARE:
        raise ValueError(f"recurrence matrices of over {MAX_SQUARE} rows aren't built")
    m = np.empty((len(a), len(other)), bool)
    for k in range(0, len(a), 256):
        m[k : k + 256] = np.sqrt(((a[k : k + 256, None, :] - other[None]) ** 2).sum(2)) <= radius
    if b is None and theiler > 0:
        i = np.arange(len(a))
        m[np.abs(i[:, None] - i[None]) < theiler] = False
    return m


def _runs(line: np.ndarray) -> np.ndarray:
    edge = np.diff(np.r_[0, line.astype(np.int8), 0])
    return np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)


def line_length_entropy(lengths: np.ndarray) -> float:
    """Entropy in bits of the distribution of line lengths."""
    if not len(lengths):
        return 0.0
    _, n = np.unique(lengths, return_counts=True)
    p = n / n.sum()
    return float(-(p * np.log2(p)).sum())


def rqa(m: np.ndarray, lmin: int = 2, vmin: int = 2) -> dict:
    """Recurrence measures of a matrix, both triangles counted, the main diagonal of a square one left out of the lines."""
    n, k = m.shape
    total = int(m.sum())
    diag = np.concatenate([_runs(np.diagonal(m, o)) for o in range(-n + 1, k) if o or n != k] or [np.zeros(0, int)])
    vert = np.concatenate([_runs(m[:, j]) for j in range(k)] or [np.zeros(0, int)])
    d, v = diag[diag >= lmin], vert[vert >= vmin]
    share = lambda s: float(s.sum() / total) if total else 0.0
    return {
        "rr": total / (n * k) if n * k else 0.0,
        "det": share(d),
        "lam": share(v),
        "lmean": float(d.mean()) if len(d) else 0.0,
        "lmax": int(d.max()) if len(d) else 0,
        "tt": float(v.mean()) if len(v) else 0.0,
        "vmax": int(v.max()) if len(v) else 0,
        "entropy": line_length_entropy(d),
    }


def rqa_sparse(a: np.ndarray, radius: float, theiler: int = 0, lmin: int = 2, vmin: int = 2) -> dict:
    """rqa(recurrence(a, None, radius, theiler)) from the recurrent pairs alone, without the matrix."""
    n = len(a)
    found = [np.zeros((2, 0), np.int64)]
    for i, j in close_pairs(a, radius):
        near = np.sqrt(((a[i] - a[j]) ** 2).sum(1)) <= radius
        found.append(np.stack([np.minimum(i, j)[near], np.maximum(i, j)[near]]))
    i, j = np.concatenate(found, axis=1)
    if theiler > 1:
        far = j - i >= theiler
        i, j = i[far], j[far]
    diag = np.repeat(_line_lengths((j - i) * n + i, i), 2)  # both triangles
    row, col = np.r_[i, j], np.r_[j, i]
    if theiler == 0:
        row, col = np.r_[row, np.arange(n)], np.r_[col, np.arange(n)]
    vert, total = _line_lengths(col * n + row, row), len(row)
    d, v = diag[diag >= lmin], vert[vert >= vmin]
    share = lambda s: float(s.sum() / total) if total else 0.0
    mean, most = (lambda s: float(s.mean()) if len(s) else 0.0), (lambda s: int(s.max()) if len(s) else 0)
    return {"rr": total / (n * n) if n else 0.0, "det": share(d), "lam": share(v), "lmean": mean(d), "lmax": most(d), "tt": mean(v), "vmax": most(v), "entropy": line_length_entropy(d)}


def _line_lengths(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Lengths of runs of neighbouring keys; a run ends where place begins anew."""
    order = np.argsort(key)
    k, p = key[order], place[order]
    cut = np.flatnonzero(np.r_[True, (np.diff(k) != 1) | (np.diff(p) != 1), True]) if len(k) else np.zeros(1, int)
    return np.diff(cut)


def embedded(df: DataFrame, dim: int, tau: int, x: str = "x", at: str = "i", id_: str = ID) -> DataFrame:
    """(series_id, i, v): rows of delayed samples as arrays; the last (dim - 1) * tau samples of a series begin none."""
    w = over(id_=id_, at=at)
    d = df.select(F.col(id_).alias(ID), F.col(at).alias("i"), F.array(*[F.lead(x, j * tau).over(w) if j else F.col(x) for j in range(dim)]).alias("v"))
    return d.where(F.col("v")[dim - 1].isNotNull()) if dim > 1 else d


def near_pairs(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """(series_id, i, j): the rows of two trajectories (series_id, i, v) of a series within radius (Euclidean) of each other.

    A join on cells of that width in the first two coordinates, each row of b in the cells around its own: rows that share
    no cell never meet, and a long series is dealt to many tasks.
    """
    two = F.size("v") > 1
    cell = lambda k: F.floor(F.when(F.lit(k == 0) | two, F.get("v", F.lit(k))).otherwise(0.0) / radius)
    around = lambda k: F.explode(F.array(*[F.col(f"_c{k}") + d for d in (-1, 0, 1)]))
    left = a.select(ID, "i", F.col("v").alias("_a"), cell(0).alias("_c0"), cell(1).alias("_c1"))
    right = b.select(ID, F.col("i").alias("j"), F.col("v").alias("_b"), cell(0).alias("_c0"), cell(1).alias("_c1"))
    right = right.withColumn("_c0", around(0)).withColumn("_c1", around(1))
    apart = F.aggregate(F.zip_with("_a", "_b", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d)
    return left.join(right, [ID, "_c0", "_c1"]).where(F.sqrt(apart) <= radius).select(ID, "i", "j")


def line_lengths(pairs: DataFrame, along: str) -> DataFrame:
    """(series_id, length) of the lines of pairs (series_id, i, j): diagonal ones, or vertical ones of one j. Each line
    that pairs may lie on is sorted by itself."""
    line = F.col("j") - F.col("i") if along == "diagonal" else F.col("j")
    d = pairs.select(ID, "i", line.alias("_l"))
    d = d.withColumn("_g", F.col("i") - F.row_number().over(Window.partitionBy(ID, "_l").orderBy("i")))
    return d.groupBy(ID, "_l", "_g").agg(F.count(F.lit(1)).alias("length")).select(ID, "length")


def crqa(a: DataFrame, b: DataFrame, radius: float, lmin: int = 2, vmin: int = 2) -> DataFrame:
    """Cross recurrence of two trajectories of each series, as rqa(recurrence(a, b, radius)) gives it, from near pairs alone.

    a and b: (series_id, i, v), i counting from 0 without gaps. One row for each series that both have: rr, det, lam, lmean,
    lmax, tt, vmax, entropy (in bits, of the lengths of diagonal lines). All lines of equal-sized trajectories but the main
    diagonal count; of others all do. No matrix and no series is in one place.
    """
    count = lambda f, n: f.groupBy(ID).agg(F.count(F.lit(1)).alias(n))
    sizes = count(a, "_n").join(count(b, "_k"), ID)
    pairs = near_pairs(a, b, radius)
    total = count(pairs, "_total")
    off = pairs.join(sizes, ID).where("i <> j or _n <> _k").select(ID, "i", "j")
    lines = line_lengths(off, "diagonal").where(F.col("length") >= lmin).groupBy(ID, "length").agg(F.count(F.lit(1)).alias("_c"))
    diag = lines.groupBy(ID).agg(F.sum(F.col("length") * F.col("_c")).alias("_ds"), F.sum("_c").alias("_dn"), F.max("length").alias("lmax"), F.sum(F.col("_c") * F.log2("_c")).alias("_h"))
    vert = line_lengths(pairs, "vertical").where(F.col("length") >= vmin).groupBy(ID).agg(F.sum("length").alias("_vs"), F.count(F.lit(1)).alias("_vn"), F.max("length").alias("vmax"))
    m = sizes.join(total, ID, "left").join(diag, ID, "left").join(vert, ID, "left")
    part = lambda x, y: F.coalesce(F.try_divide(F.col(x), F.col(y)), F.lit(0.0))
    return m.select(
        ID,
        F.coalesce(F.col("_total") / (F.col("_n") * F.col("_k")), F.lit(0.0)).alias("rr"),
        *[part(x, y).alias(n) for x, y, n in (("_ds", "_total", "det"), ("_vs", "_total", "lam"), ("_ds", "_dn", "lmean"))],
        F.coalesce("lmax", F.lit(0)).alias("lmax"),
        part("_vs", "_vn").alias("tt"),
        F.coalesce("vmax", F.lit(0)).alias("vmax"),
        F.coalesce(F.log2("_dn") - F.col("_h") / F.col("_dn"), F.lit(0.0)).alias("entropy"),
    )


def recurrence_pairs(df: DataFrame, radius: float, theiler: int = 1, x: str = "x", at: str = "i") -> DataFrame:
    """(series_id, i, j): sparse recurrences i < j of scalar series, as a range join on cells of width radius."""
    cell = F.floor(F.col(x) / radius)
    a = df.select(ID, F.col(at).alias("i"), F.col(x).alias("xi"), cell.alias("c"))
    b = df.select(ID, F.col(at).alias("j"), F.col(x).alias("xj"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("c"))
    return a.join(b, [ID, "c"]).where((F.col("j") - F.col("i") >= theiler) & (F.abs(F.col("xi") - F.col("xj")) <= radius)).select(ID, "i", "j")


def kuramoto(df: DataFrame, t: str = "t", phi: str = "phi") -> DataFrame:
    """(t, r, mean_phase): order parameter over the series present at each time."""
    c, s = F.avg(F.cos(phi)), F.avg(F.sin(phi))
    return df.where(finite(F.col(phi))).groupBy(t).agg(F.hypot(c, s).alias("r"), F.atan2(s, c).alias("mean_phase"))


def cluster_phase(df: DataFrame, t: str = "t", phi: str = "phi", id_: str = ID) -> DataFrame:
    """(series_id, rho): the resultant of each series' phase about the cluster's, less its mean."""
    d = df.join(kuramoto(df, t, phi), t).select(id_, (F.col(phi) - F.col("mean_phase")).alias("d"))
    return d.groupBy(id_).agg(F.hypot(F.avg(F.cos("d")), F.avg(F.sin("d"))).alias("rho"))


def relative_phase(a: np.ndarray, b: np.ndarray) -> dict:
    """Differences wrapped to (-pi, pi], their circular mean and resultant length."""
    d = np.angle(np.exp(1j * (a - b)))
    z = np.exp(1j * d).mean() if len(d) else 0
    return {"phase": d, "mean": float(np.angle(z)), "r": float(abs(z))}


def dmd(x: np.ndarray, y: np.ndarray | None = None, rank: int | None = None) -> dict:
    """Eigenvalues, modes and amplitudes of y = A x; columns are snapshots, y the next ones."""
    if y is None:
        x, y = x[:, :-1], x[:, 1:]
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    r = min(rank or len(s), int((s > s[0] * 1e-12).sum()) if len(s) else 0)
    u, s, v = u[:, :r], s[:r], vt[:r].T
    values, w = np.linalg.eig(u.T @ y @ v / s)
    modes = y @ v / s @ w
    return {"values": values, "modes": modes, "amplitudes": np.linalg.lstsq(modes, x[:, 0].astype(complex), rcond=None)[0]}


def dmd_predict(fit: dict, steps: int) -> np.ndarray:
    return np.stack([(fit["modes"] @ (fit["amplitudes"] * fit["values"] ** k)).real for k in range(steps)], axis=1)


def polynomial_library(x: np.ndarray, degree: int = 2, constant: bool = True) -> np.ndarray:
    """Monomials of the columns of x up to the degree, by degree and then by column."""
    import itertools

    cols = [np.ones(len(x))] if constant else []
    for d in range(1, degree + 1):
        cols += [np.prod(x[:, list(c)], axis=1) for c in itertools.combinations_with_replacement(range(x.shape[1]), d)]
    return np.stack(cols, axis=1)


def edmd(x: np.ndarray, y: np.ndarray, degree: int = 2, ridge: float = 1e-10) -> np.ndarray:
    """The Koopman matrix over monomials; rows of x and y are states and the next ones."""
    a, b = polynomial_library(x, degree).T, polynomial_library(y, degree).T
    return b @ a.T @ np.linalg.inv(a @ a.T + ridge * np.eye(len(a)))


def sindy(x: np.ndarray, dt: float, degree: int = 2, threshold: float = 0.1, ridge: float = 0.0, inputs: np.ndarray | None = None) -> np.ndarray:
    """Coefficients[term, state] of dx/dt over a polynomial library of states (and inputs), small ones dropped until none is left to drop."""
    dx = np.diff(x, axis=0) / dt
    lib = polynomial_library((x if inputs is None else np.hstack([x, inputs]))[:-1], degree)
    out = np.zeros((lib.shape[1], x.shape[1]))
    for j in range(x.shape[1]):
        on = np.ones(lib.shape[1], bool)
        while on.any():
            a = lib[:, on]
            w = np.linalg.solve(a.T @ a + ridge * np.eye(a.shape[1]), a.T @ dx[:, j]) if ridge else np.linalg.lstsq(a, dx[:, j], rcond=None)[0]
            small = np.abs(w) < threshold
            out[:, j] = 0
            out[on, j] = np.where(small, 0, w)
            if not small.any():
                break
            on[np.flatnonzero(on)[small]] = False
    return out


def lti(a, b, c, u: np.ndarray, x0) -> tuple[np.ndarray, np.ndarray]:
    """States (from x0) and outputs of x' = A x + B u, y = C x for rows of inputs."""
    x, xs, ys = np.asarray(x0, float), [np.asarray(x0, float)], []
    for v in u:
        ys.append(c @ x)
        x = a @ x + b @ np.atleast_1d(v)
        xs.append(x)
    return np.array(xs), np.array(ys)


def pid(error: np.ndarray, dt: float, kp: float, ki: float, kd: float, i_limit: float = np.inf, limit: float = np.inf) -> np.ndarray:
    """Outputs for a series of errors: integral and output clamped, no derivative at the first step."""
    i, last, out = 0.0, None, np.empty(len(error))
    for k, e in enumerate(error):
        i = min(max(i + e * dt, -i_limit), i_limit)
        out[k] = min(max(kp * e + ki * i + kd * (0.0 if last is None else (e - last) / dt), -limit), limit)
        last = e
    return out


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("np", "F", "Window", "NAN")]
