"""Scoring neural nets of known weights.

Inference only, in evaluation mode (no dropout, stored batch statistics). All
nets are column expressions and never leave the JVM. Their numpy forms are what
the expressions are tested against.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.maths import sigmoid

Weights = Mapping[str, np.ndarray]


def _dense(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    return x @ w.T + b


def tanh_unit(x: np.ndarray, p: Weights) -> np.ndarray:
    """One tanh neuron: ``tanh(sum(w * x) + b)``."""
    return np.tanh((x * p["w"]).sum(axis=1) + p["b"])


def one_hidden(x: np.ndarray, p: Weights) -> np.ndarray:
    """Dense, ReLU, dense."""
    return _dense(np.maximum(_dense(x, p["w1"], p["b1"]), 0.0), p["w2"], p["b2"])[:, 0]


def deep(x: np.ndarray, p: Weights, eps: float = 1e-5) -> np.ndarray:
    """Any number of dense + batch norm + ReLU layers (``w0, b0, gamma0, beta0, mean0, var0``, ...), then ``w, b``."""
    layer = 0
    while f"w{layer}" in p:
        x = _dense(x, p[f"w{layer}"], p[f"b{layer}"])
        x = (x - p[f"mean{layer}"]) / np.sqrt(p[f"var{layer}"] + eps) * p[f"gamma{layer}"] + p[f"beta{layer}"]
        x = np.maximum(x, 0.0)
        layer += 1
    return _dense(x, p["w"], p["b"])[:, 0]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def lstm(x: np.ndarray, p: Weights) -> np.ndarray:
    """Stacked LSTM over rows laid out as (steps, inputs); a dense layer reads the last hidden state.

    Gate order in the stacked matrices: input, forget, cell, output.
    """
    inputs = p["wx0"].shape[1]
    sequence = x.reshape(len(x), -1, inputs)
    layer = 0
    while f"wx{layer}" in p:
        wx, wh, b = p[f"wx{layer}"], p[f"wh{layer}"], p[f"b{layer}"]
        size = wh.shape[1]
        h, c = np.zeros((len(x), size)), np.zeros((len(x), size))
        states = []
        for step in range(sequence.shape[1]):
            i, f, g, o = np.split(_dense(sequence[:, step], wx, b) + h @ wh.T, 4, axis=1)
            c = _logistic(f) * c + _logistic(i) * np.tanh(g)
            h = _logistic(o) * np.tanh(c)
            states.append(h)
        sequence = np.stack(states, axis=1)
        layer += 1
    return _dense(sequence[:, -1], p["w"], p["b"])[:, 0]


def attention(x: np.ndarray, p: Weights) -> np.ndarray:
    """Query/key/value projections; each hidden unit attends over the others; a dense layer reads the result."""
    q, k, v = (_dense(x, p[f"w{n}"], p[f"b{n}"]) for n in "qkv")
    scores = q[:, :, None] * k[:, None, :] / np.sqrt(k.shape[1])
    powers = np.exp(scores - scores.max(axis=2, keepdims=True))
    mixed = np.einsum("bij,bj->bi", powers / powers.sum(axis=2, keepdims=True), v)
    return _dense(mixed, p["w"], p["b"])[:, 0]


NETS: dict[str, Callable[[np.ndarray, Weights], np.ndarray]] = {
    "tanh_unit": tanh_unit, "one_hidden": one_hidden, "deep": deep, "lstm": lstm, "attention": attention,
}


def _affine(xs: Sequence[Column], w: np.ndarray, b: np.ndarray) -> list[Column]:
    rows, shifts = np.atleast_2d(w), np.broadcast_to(np.asarray(b, float).reshape(-1), (len(np.atleast_2d(w)),))
    return [sum((x * F.lit(float(k)) for x, k in zip(xs, row, strict=True)), F.lit(float(s))) for row, s in zip(rows, shifts)]


def _once(values: Sequence[Column], then: Callable[[list[Column]], Column]) -> Column:
    """``then(values)`` with every value computed once, however often it is used."""
    return F.transform(F.array(F.array(*values)), lambda a: then([F.get(a, F.lit(i)) for i in range(len(values))]))[0]


def _positive(xs: Sequence[Column]) -> list[Column]:
    return [F.greatest(x, F.lit(0.0)) for x in xs]


def _tanh_columns(xs: list[Column], p: Weights) -> Column:
    return F.tanh(_affine(xs, p["w"], p["b"])[0])


def _hidden_columns(xs: list[Column], p: Weights) -> Column:
    return _affine(_positive(_affine(xs, p["w1"], p["b1"])), p["w2"], p["b2"])[0]


def _deep_columns(xs: list[Column], p: Weights, layer: int = 0, eps: float = 1e-5) -> Column:
    if f"w{layer}" not in p:
        return _affine(xs, p["w"], p["b"])[0]
    size = p[f"gamma{layer}"] / np.sqrt(p[f"var{layer}"] + eps)
    shift = p[f"beta{layer}"] - p[f"mean{layer}"] * size
    out = _affine(xs, p[f"w{layer}"] * size[:, None], p[f"b{layer}"] * size + shift)
    return _once(_positive(out), lambda hs: _deep_columns(hs, p, layer + 1, eps))


def _attention_columns(xs: list[Column], p: Weights) -> Column:
    q, k, v = (_affine(xs, p[f"w{n}"], p[f"b{n}"]) for n in "qkv")
    n = len(k)

    def mixed(cells: list[Column]) -> Column:
        q, k, v = cells[:n], cells[n : 2 * n], cells[2 * n :]

        def unit(i: int) -> Column:
            scores = [q[i] * x * F.lit(1 / n**0.5) for x in k]
            return _once(scores, lambda s: weighted(s, F.greatest(*s) if n > 1 else s[0]))

        def weighted(s: list[Column], top: Column) -> Column:
            powers = [F.exp(x - top) for x in s]
            return sum((a * b for a, b in zip(powers, v)), F.lit(0.0)) / sum(powers, F.lit(0.0))

        return _affine([unit(i) for i in range(n)], p["w"], p["b"])[0]

    return _once([*q, *k, *v], mixed)


def _lstm_layer(sequence: Column, steps: int, wx: np.ndarray, wh: np.ndarray, b: np.ndarray) -> Column:
    """Hidden states of every step: the recurrence as an aggregate over the array of steps."""
    size, both = wh.shape[1], np.hstack([wx, wh])

    def moved(cells: list[Column]) -> Column:
        gates, c = cells[: 4 * size], cells[4 * size :]
        i, f, g, o = (gates[k * size : (k + 1) * size] for k in range(4))
        held = [sigmoid(f[k]) * c[k] + sigmoid(i[k]) * F.tanh(g[k]) for k in range(size)]
        return _once([*held, *map(sigmoid, o)], lambda v: F.array(*[v[size + k] * F.tanh(v[k]) for k in range(size)], *v[:size]))

    def step(states: Column, x: Column) -> Column:
        before = F.element_at(states, -1)  # hidden states, then cells
        values = [F.get(x, F.lit(k)) for k in range(wx.shape[1])] + [F.get(before, F.lit(k)) for k in range(2 * size)]

        def cell(v: list[Column]) -> Column:
            known, c = v[: both.shape[1]], v[both.shape[1] :]
            return _once([*_affine(known, both, b), *c], moved)

        return F.concat(states, F.array(_once(values, cell)))

    states = F.aggregate(sequence, F.array(F.array(*[F.lit(0.0)] * (2 * size))), step)
    return F.transform(F.slice(states, 2, steps), lambda s: F.slice(s, 1, size))


def _lstm_columns(xs: list[Column], p: Weights) -> Column:
    inputs, layer = p["wx0"].shape[1], 0
    steps = [F.array(*xs[k : k + inputs]) for k in range(0, len(xs), inputs)]
    sequence = F.array(*steps)
    while f"wx{layer}" in p:
        sequence = _lstm_layer(sequence, len(steps), p[f"wx{layer}"], p[f"wh{layer}"], p[f"b{layer}"])
        layer += 1
    size = p[f"wh{layer - 1}"].shape[1]
    last = F.transform(F.slice(sequence, -1, 1), lambda h: _affine([F.get(h, F.lit(k)) for k in range(size)], p["w"], p["b"])[0])
    return last[0]


COLUMNS: dict[str, Callable[[list[Column], Weights], Column]] = {
    "tanh_unit": _tanh_columns, "one_hidden": _hidden_columns, "deep": _deep_columns, "lstm": _lstm_columns, "attention": _attention_columns,
}


def net_model(kind: str, weights: Weights) -> Callable[[Sequence[str]], Column]:
    """A model for :func:`~tidemark.plans.research.add_model_predictions`. A row with a NULL feature scores NULL."""
    frozen = {k: np.asarray(v, dtype=float) for k, v in weights.items()}

    def model(features: Sequence[str]) -> Column:
        known = F.lit(True)
        for f in features:
            known = known & F.col(f).isNotNull()
        return F.when(known, COLUMNS[kind]([F.col(f).cast("double") for f in features], frozen))

    return model
