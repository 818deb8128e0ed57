"""A small linear-chain conditional random field in numpy: training and batched Viterbi."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass
class Model:
    """Weights by feature name; an unknown feature weighs nothing."""

    labels: list[str]
    features: dict[str, int]
    emit: np.ndarray  # (features + 1, labels), the last row is zero
    move: np.ndarray  # (labels, labels)
    begin: np.ndarray


def _indexed(model: Model, sequences: Sequence[Sequence[Sequence[str]]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (sequences, tokens, features), padded, and lengths."""
    none = len(model.features)
    lengths = np.array([len(s) for s in sequences])
    width = max((len(f) for s in sequences for f in s), default=1)
    out = np.full((len(sequences), lengths.max(), width), none)
    for b, sequence in enumerate(sequences):
        for t, names in enumerate(sequence):
            out[b, t, :len(names)] = [model.features.get(n, none) for n in names]
    return out, lengths


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(sequences: Sequence[Sequence[Sequence[str]]], tags: Sequence[Sequence[str]], labels: list[str],
          epochs: int = 60, rate: float = 0.3, l2: float = 1e-3) -> Model:
    """Maximise the penalised likelihood by AdaGrad over the whole labelled table."""
    names = sorted({f for s in sequences for token in s for f in token})
    k = len(labels)
    model = Model(labels, {n: i for i, n in enumerate(names)}, np.zeros((len(names) + 1, k)), np.zeros((k, k)), np.zeros(k))
    features, lengths = _indexed(model, sequences)
    batch, steps, _ = features.shape
    gold = np.zeros((batch, steps), int)
    for b, row in enumerate(tags):
        gold[b, :len(row)] = [labels.index(t) for t in row]
    real = np.arange(steps) < lengths[:, None]
    rows, last = np.arange(batch), lengths - 1
    seen = [np.full_like(p, 1e-8) for p in (model.emit, model.move, model.begin)]
    for _ in range(epochs):
        score = model.emit[features].sum(2)
        forward, backward = np.zeros((batch, steps, k)), np.zeros((batch, steps, k))
        forward[:, 0] = model.begin + score[:, 0]
        for t in range(1, steps):
            step = _logsum(forward[:, t - 1, :, None] + model.move, 1) + score[:, t]
            forward[:, t] = np.where(real[:, t, None], step, forward[:, t - 1])
        total = _logsum(forward[rows, last], 1)
        for t in range(steps - 2, -1, -1):
            step = _logsum(model.move + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(real[:, t + 1, None], step, 0)
        belief = np.exp(forward + backward - total[:, None, None]) * real[..., None]
        error = -belief
        error[rows[:, None], np.arange(steps), gold] += real
        grad_emit = np.zeros_like(model.emit)
        np.add.at(grad_emit, features.reshape(-1), np.repeat(error.reshape(-1, k), features.shape[2], 0))
        grad_emit[-1] = 0
        grad_move = np.zeros_like(model.move)
        for t in range(1, steps):
            on = real[:, t]
            pair = np.exp(forward[on, t - 1, :, None] + model.move + (score[on, t] + backward[on, t])[:, None, :] - total[on, None, None])
            grad_move -= pair.sum(0)
            np.add.at(grad_move, (gold[on, t - 1], gold[on, t]), 1)
        for value, grad, squares in zip((model.emit, model.move, model.begin), (grad_emit, grad_move, error[:, 0].sum(0)), seen):
            grad = grad - l2 * batch * value
            squares += grad * grad
            value += rate * grad / np.sqrt(squares)
    return model


def viterbi(model: Model, sequences: Sequence[Sequence[Sequence[str]]]) -> list[list[str]]:
    """The likeliest labels of every sequence, all sequences at once."""
    if not sequences:
        return []
    features, lengths = _indexed(model, sequences)
    score = model.emit[features].sum(2)
    batch, steps, k = score.shape
    best, back = model.begin + score[:, 0], np.zeros((batch, steps, k), np.int32)
    for t in range(1, steps):
        ways = best[:, :, None] + model.move
        step, on = ways.max(1) + score[:, t], t < lengths
        back[:, t] = np.where(on[:, None], ways.argmax(1), np.arange(k))
        best = np.where(on[:, None], step, best)
    path = np.empty((batch, steps), np.int32)
    path[:, -1] = best.argmax(1)
    for t in range(steps - 1, 0, -1):
        path[:, t - 1] = back[np.arange(batch), t, path[:, t]]
    return [[model.labels[i] for i in row[:n]] for row, n in zip(path, lengths)]
