"""Distributed prototype fit (R3): proxies and margins on frozen embeddings.

One optimisation step = one Spark job (``fit_epoch`` runs the steps of an epoch in one):

1. every partition of the (checkpointed, unit-normalised) training table
   computes, with numpy, per class c and per term kind q in {positive,
   negative} x {inside, outside} the partial sums
   ``W = sum w``, ``Ws = sum w*s``, ``X = sum w*x_hat`` (a dim-vector) and the
   positive-row count, where w is the masked exponential of the loss and s is
   ``cos`` or ``xm`` -- one row per (class, kind) leaves the partition;
2. ``groupBy(cls, kind)`` merges the partials (``Summarizer`` for the vectors):
   at most 4 x n_classes rows reach the driver, however many rows there are;
3. the driver turns the sums into the exact gradient of the loss (the
   per-class factors 1/(1+S) are known only after the sums, which is why
   the unnormalised sums are accumulated), clips the joint norm and applies
   AdamW with linear warm-up and decay, as the reference does.

Gradients (vector margins), with p = P/|P|, m = M/|M| (epsilon norms):
d cos/dP = (x - cos p)/|P|;  d xm/dM = (x - xm m)/|M|;
d r/dP = (m - r p)/|P|;      d r/dM = (p - r m)/|M|.
Scalar margins: d pos/dm = -1, d neg/dm = +1.
The encoder stays frozen (the reference fine-tunes it; that is out of scope).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import NORM_EPS, is_usable, l2_normalize, safe_norm
from ..session import cut_lineage
from .loss import VARIANTS
from .prototypes import Prototypes

# fixed values: the reference's optimiser settings
LR = 2e-5
PROXY_LR_SCALE = 100
MARGIN_LR_SCALE = 10
WEIGHT_DECAY = 1e-3
CLIP = 0.6
WARMUP = 0.1
BETAS = (0.9, 0.999)
ADAM_EPS = 1e-8

_KINDS = ("pos_in", "pos_out", "neg_in", "neg_out")


def _unit(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.sqrt((a * a).sum(axis=1) + NORM_EPS)
    return a / n[:, None], n


def partial_sums(xh: np.ndarray, y: np.ndarray, protos: Prototypes, variant: str,
                 alpha: float) -> dict:
    """Per (class, kind) partial sums for one block of unit rows (numpy)."""
    kind, shared = VARIANTS[variant]
    C = protos.n_classes
    ph, _ = _unit(protos.proxy)
    cos = xh @ ph.T
    pos_mask = (y[:, None] == np.arange(C)[None, :])
    if shared:
        pos_mask[:, C - 1] = True
    if kind == "vector":
        cos = np.clip(cos, -1.0, 1.0)
        mh, _ = _unit(protos.margin_vec)
        xm = np.clip(xh @ mh.T, -1.0, 1.0)
        r = protos.radius()[None, :]
        inside = cos > r
        pos_v = np.where(inside, xm, cos - r)
        neg_v = np.where(inside, cos - r, xm)
        s_pos = np.where(inside, xm, cos)     # s multiplies the unit vector of the term
        s_neg = np.where(inside, cos, xm)
    else:
        m = protos.margin[None, :]
        inside = cos > m
        pos_v, neg_v = cos - m, cos + m
        s_pos = s_neg = cos
    w_pos = np.where(pos_mask, np.exp(-alpha * pos_v), 0.0)
    w_neg = np.where(~pos_mask, np.exp(alpha * neg_v), 0.0)
    out = {}
    for name, w, s, sel in (("pos_in", w_pos, s_pos, inside), ("pos_out", w_pos, s_pos, ~inside),
                            ("neg_in", w_neg, s_neg, inside), ("neg_out", w_neg, s_neg, ~inside)):
        ww = np.where(sel, w, 0.0)
        out[name] = (ww.sum(axis=0), (ww * s).sum(axis=0), ww.T @ xh)
    out["npos"] = pos_mask.sum(axis=0)
    return out


def _partials_fn(shipped, variant: str, alpha: float):
    def fn(batches):
        # sums accumulate over the partition: 4 rows per class leave it
        p, total = shipped.value, None
        for pdf in batches:
            if pdf.empty:
                continue
            ps = partial_sums(np.stack(pdf["xh"].to_numpy()), pdf["y"].to_numpy(), p, variant, alpha)
            if total is None:
                total = ps
            else:
                total = {k: total[k] + v if k == "npos" else tuple(a + b for a, b in zip(total[k], v)) for k, v in ps.items()}
        if total is None:
            return
        rows = [(c, q, float(total[name][0][c]), float(total[name][1][c]), int(total["npos"][c]) if q == 0 else 0,
                 total[name][2][c].tolist()) for q, name in enumerate(_KINDS) for c in range(p.n_classes)]
        yield pd.DataFrame(rows, columns=["cls", "kind", "w", "ws", "npos", "xs"])
    return fn


def class_partials(train_unit: DataFrame, protos: Prototypes, variant: str, alpha: float) -> DataFrame:
    """``(cls, kind, w, ws, npos, xs)``: the sums a gradient step needs, four rows per class of the
    model (kinds: positive inside/outside, negative inside/outside)."""
    shipped = train_unit.sparkSession.sparkContext.broadcast(protos)
    parts = train_unit.mapInPandas(_partials_fn(shipped, variant, alpha),
                                   "cls int, kind int, w double, ws double, npos long, xs array<double>")
    return (parts.groupBy("cls", "kind")
            .agg(F.sum("w").alias("w"), F.sum("ws").alias("ws"), F.sum("npos").alias("npos"),
                 vector_to_array(Summarizer.sum(array_to_vector("xs"))).alias("xs")))


def aggregate_sums(train_unit: DataFrame, protos: Prototypes, variant: str, alpha: float) -> dict:
    """One Spark job: the per-(class, kind) sums over the whole (or batch) table."""
    rows = class_partials(train_unit, protos, variant, alpha).collect()
    C, d = protos.n_classes, protos.dim
    out = {k: (np.zeros(C), np.zeros(C), np.zeros((C, d))) for k in _KINDS}
    npos = np.zeros(C)
    for r in rows:
        w, ws, xs = out[_KINDS[r["kind"]]]
        w[r["cls"]], ws[r["cls"]], xs[r["cls"]] = r["w"], r["ws"], r["xs"]
        npos[r["cls"]] += r["npos"]
    out["npos"] = npos
    return out


def loss_and_grad(sums: dict, protos: Prototypes, variant: str, alpha: float):
    """Loss and exact gradients (dP, dM or dm) from the aggregated sums."""
    kind, _ = VARIANTS[variant]
    C = protos.n_classes
    s_pos = sums["pos_in"][0] + sums["pos_out"][0]
    s_neg = sums["neg_in"][0] + sums["neg_out"][0]
    n_valid = max(1, int((sums["npos"] > 0).sum()))
    loss = np.log1p(s_pos).sum() / n_valid + np.log1p(s_neg).sum() / C
    kp = -alpha / (n_valid * (1.0 + s_pos))      # dL/dS+ * dS+/d(pos) per unit weight
    kn = alpha / (C * (1.0 + s_neg))
    ph, pn = _unit(protos.proxy)
    if kind == "scalar":
        xs = kp[:, None] * (sums["pos_in"][2] + sums["pos_out"][2]) + kn[:, None] * (
            sums["neg_in"][2] + sums["neg_out"][2])
        wc = kp * (sums["pos_in"][1] + sums["pos_out"][1]) + kn * (sums["neg_in"][1] + sums["neg_out"][1])
        d_p = (xs - wc[:, None] * ph) / pn[:, None]
        d_m = alpha * s_pos / (n_valid * (1.0 + s_pos)) + alpha * s_neg / (C * (1.0 + s_neg))
        return loss, d_p, d_m
    mh, mn = _unit(protos.margin_vec)
    r = protos.radius()
    # terms in (cos - r): positive-outside and negative-inside
    a_x = kp[:, None] * sums["pos_out"][2] + kn[:, None] * sums["neg_in"][2]
    a_s = kp * sums["pos_out"][1] + kn * sums["neg_in"][1]
    a_w = kp * sums["pos_out"][0] + kn * sums["neg_in"][0]
    # terms in xm: positive-inside and negative-outside
    b_x = kp[:, None] * sums["pos_in"][2] + kn[:, None] * sums["neg_out"][2]
    b_s = kp * sums["pos_in"][1] + kn * sums["neg_out"][1]
    d_p = (a_x - a_s[:, None] * ph) / pn[:, None] - a_w[:, None] * (mh - r[:, None] * ph) / pn[:, None]
    d_mv = -a_w[:, None] * (ph - r[:, None] * mh) / mn[:, None] + (b_x - b_s[:, None] * mh) / mn[:, None]
    return loss, d_p, d_mv


@dataclass
class AdamW:
    lr: float
    weight_decay: float = WEIGHT_DECAY
    betas: tuple = BETAS
    eps: float = ADAM_EPS
    t: int = 0
    m: dict = field(default_factory=dict)
    v: dict = field(default_factory=dict)

    def step(self, name: str, param: np.ndarray, grad: np.ndarray, lr: float) -> np.ndarray:
        b1, b2 = self.betas
        m = self.m.get(name, np.zeros_like(param))
        v = self.v.get(name, np.zeros_like(param))
        m = b1 * m + (1 - b1) * grad
        v = b2 * v + (1 - b2) * grad * grad
        self.m[name], self.v[name] = m, v
        mhat = m / (1 - b1 ** self.t)
        vhat = v / (1 - b2 ** self.t)
        param = param * (1 - lr * self.weight_decay)
        return param - lr * mhat / (np.sqrt(vhat) + self.eps)


def schedule(step: int, total: int, warmup: float = WARMUP) -> float:
    """Linear warm-up over the first ``warmup`` share of steps, then linear decay to 0."""
    w = int(total * warmup)
    if step < w:
        return step / max(1, w)
    return max(0.0, (total - step) / max(1, total - w))


@dataclass
class FitResult:
    protos: Prototypes
    history: list = field(default_factory=list)     # (step, loss)


def unit_training_table(train: DataFrame, x_col: str = "x", y_col: str = "y",
                        checkpoint: bool = True, id_col: str | None = None) -> DataFrame:
    cols = [F.col(id_col).alias("row_id")] if id_col else []
    # rows that cannot be scored add nothing to a loss
    t = train.filter(is_usable(safe_norm(x_col))).select(*cols, F.col(y_col).cast("int").alias("y"), l2_normalize(x_col).alias("xh"))
    return cut_lineage(t) if checkpoint else t


class Optimiser:
    """The reference's optimiser state: AdamW groups, joint clipping, schedule."""

    def __init__(self, variant: str, total_steps: int, lr: float = LR, clip: float = CLIP):
        self.kind, _ = VARIANTS[variant]
        self.opt = AdamW(lr)
        self.proxy_lr = lr * PROXY_LR_SCALE
        self.margin_lr = lr * (PROXY_LR_SCALE if variant == "org" else MARGIN_LR_SCALE)
        self.total, self.clip, self.step_no = total_steps, clip, 0

    def apply(self, p: Prototypes, d_p: np.ndarray, d_m) -> Prototypes:
        norm = np.sqrt((d_p ** 2).sum() + (np.asarray(d_m) ** 2).sum())
        if norm > self.clip:
            d_p, d_m = d_p * (self.clip / (norm + 1e-6)), d_m * (self.clip / (norm + 1e-6))
        self.opt.t += 1
        f = schedule(self.step_no, self.total)
        self.step_no += 1
        p.proxy = self.opt.step("proxy", p.proxy, d_p, self.proxy_lr * f)
        if self.kind == "vector":
            p.margin_vec = self.opt.step("margin", p.margin_vec, d_m, self.margin_lr * f)
        else:
            p.margin = self.opt.step("margin", p.margin, np.asarray(d_m), self.margin_lr * f)
        return p


def fit_prototypes(train: DataFrame, protos: Prototypes, variant: str = "new", alpha: float = 64.0,
                   steps: int = 20, lr: float = LR, clip: float = CLIP,
                   x_col: str = "x", y_col: str = "y", checkpoint: bool = True) -> FitResult:
    """Full-batch fit: ``steps`` optimisation steps, one Spark job each."""
    unit = unit_training_table(train, x_col, y_col, checkpoint)
    p = protos.copy()
    opt = Optimiser(variant, steps, lr, clip)
    res = FitResult(p)
    for step in range(steps):
        sums = aggregate_sums(unit, p, variant, alpha)
        loss, d_p, d_m = loss_and_grad(sums, p, variant, alpha)
        res.history.append((step, float(loss)))
        p = opt.apply(p, d_p, d_m)
    res.protos = p
    return res
