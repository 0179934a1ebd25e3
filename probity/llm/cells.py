"""Two levels of unit centroids, by which vectors are parted into shards and routed to the shards near them.

Both levels come from bounded hashed samples: about SAMPLE rows on the driver for the coarse level, about
FINE rows a coarse cell, in one task each, for the fine level. The centroids that travel with the tasks are one
vector for each shard. A vector costs one product with the coarse centroids and one with the fine centroids of
the coarse cells it is near, so routing grows with the root of the number of shards.

A vector is near a cell if it lies at most `margin` beyond the plane that bisects its own centroid and the
cell's, on either level. In d dimensions a neighbour at distance r moves by about r / sqrt(d) along a given
direction, so a margin of an eighth of the reach finds nearly all neighbours at any number of cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000  # rows that the coarse centroids are fitted on
FINE = 4_000  # rows that the fine centroids of a coarse cell are fitted on


def unit_rows(thumbs: np.ndarray) -> np.ndarray:
    """Rows centred and scaled to length 1; constant rows become null vectors."""
    x = thumbs.astype(np.float64)
    x -= x.mean(axis=1, keepdims=True)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-12)


def encoded(thumb: np.ndarray) -> bytes:
    """A row of small integers, a byte each where they all fit and two bytes otherwise; the first byte tells. Equal rows have equal bytes."""
    if len(thumb) and 0 <= thumb.min() and thumb.max() <= 255:
        return b"\1" + thumb.astype(np.uint8).tobytes()
    return b"\2" + thumb.astype("<i2").tobytes()


def stacked(payload) -> np.ndarray:
    """The rows of encoded ones, which are equally long."""
    payload = list(payload)
    if len({len(p) for p in payload}) == 1:
        return rows_of(b"".join(payload), len(payload))
    return np.array([rows_of(p, 1)[0] for p in payload], dtype=np.int16).reshape(len(payload), -1)


def joined(payload) -> bytes:
    """Encoded rows after one another, all as wide as the widest."""
    payload = list(payload)
    return b"".join(payload) if len({len(p) for p in payload}) <= 1 else b"".join(b"\2" + r.astype("<i2").tobytes() for r in stacked(payload))


def rows_of(blob: bytes, n: int) -> np.ndarray:
    """The n rows of a blob of encoded ones of one width."""
    x = np.frombuffer(blob, dtype=np.uint8).reshape(n, -1)
    return x[:, 1:] if x[0, 0] == 1 else np.ascontiguousarray(x[:, 1:]).view("<i2")


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of spherical k-means over the rows of x, k at most."""
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(x[i:i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-6, sums / np.maximum(size, 1e-6), c)
    return c


def _apart(c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * c @ c.T, 1e-6))


class Cells:
    """Coarse centroids and, of each coarse cell, its fine ones; a fine centroid is a cell."""

    def __init__(self, coarse: np.ndarray, fine: list[np.ndarray]) -> None:
        self.coarse, self.fine = coarse, fine
        self.first = np.concatenate([[0], np.cumsum([len(f) for f in fine])])
        self.apart, self.fine_apart = _apart(coarse), [_apart(f) for f in fine]

    def __len__(self) -> int:
        return int(self.first[-1])

    def route(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, own): every cell a row is near, and whether it is its own."""
        w = x @ self.coarse.T
        top = w.argmax(axis=1)
        beyond = (w[np.arange(len(x)), top][:, None] - w) / self.apart[top]
        rows, cells, owns = [], [], []
        for i, fine in enumerate(self.fine):
            at = np.nonzero(beyond[:, i] <= margin)[0] if margin >= 0 else np.nonzero(top == i)[0]
            if not len(at):
                continue
            v = x[at] @ fine.T
            best = v.argmax(axis=1)
            over = (v[np.arange(len(at)), best][:, None] - v) / self.fine_apart[i][best]
            r, c = np.nonzero((over <= margin) | (np.arange(len(fine)) == best[:, None]))
            rows.append(at[r])
            cells.append(self.first[i] + c)
            owns.append((c == best[r]) & (top[at[r]] == i))
        return np.concatenate(rows), np.concatenate(cells).astype(np.int32), np.concatenate(owns)


def _sampled(vectors: DataFrame, share: float, seed: int) -> DataFrame:
    return vectors.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30))))


def fit_cells(vectors: DataFrame, n: int, cells: int, seed: int = 7) -> Cells:
    """Cells for n (id, payload) rows; about `cells` of them."""
    wide = max(1, round(cells ** 0.5))
    sample = _sampled(vectors.select("id", "payload"), SAMPLE / max(n, 1), seed).orderBy("id").toPandas()
    if sample.empty:
        return Cells(np.zeros((1, 1), dtype=np.float32), [np.zeros((1, 1), dtype=np.float32)])
    coarse = k_means(unit_rows(stacked(sample["payload"])).astype(np.float32), wide, seed)
    deep = -(-cells // len(coarse))
    top = Cells(coarse, [c[None] for c in coarse])

    def assign(batches):
        for pdf in batches:
            row, cell, own = top.route(unit_rows(stacked(pdf["payload"])).astype(np.float32), -1.0)
            yield pd.DataFrame({"c": cell[own], "id": pdf["id"].to_numpy()[row[own]], "payload": pdf["payload"].to_numpy()[row[own]]})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        found = k_means(unit_rows(stacked(pdf["payload"])).astype(np.float32), deep, seed)
        return pd.DataFrame({"c": int(pdf["c"].iloc[0]), "centroid": [f.tobytes() for f in found]})

    fine: list[list[np.ndarray]] = [[] for _ in coarse]
    drawn = _sampled(vectors, FINE * len(coarse) / max(n, 1), seed + 1).mapInPandas(assign, "c int, id bigint, payload binary")
    for r in drawn.groupBy("c").applyInPandas(fit, "c int, centroid binary").collect():  # one row a cell
        fine[r["c"]].append(np.frombuffer(r["centroid"], dtype=np.float32))
    return Cells(coarse, [np.stack(f) if f else c[None] for c, f in zip(coarse, fine)])
