"""Logistic fits one origin at a time, to compare the batched ones with."""

import numpy as np


def softmax_fit(x: np.ndarray, label: np.ndarray, n_classes: int, c: float = 1.0, steps: int = 50) -> np.ndarray:
    """Multinomial logistic weights (intercept first, unpenalised) by Newton's method.

    Minimises log loss plus ``|w|^2 / 2c``; two classes use the single-logit form.
    """
    k = 1 if n_classes == 2 else n_classes
    z = np.column_stack([np.ones(len(x)), x])
    d = z.shape[1]
    penalty = np.tile(np.r_[0.0, np.full(d - 1, 1.0 / c)], k)
    target = (label[:, None] == (np.array([1]) if k == 1 else np.arange(k))).astype(float)
    w = np.zeros(k * d)
    for _ in range(steps):
        p = _softmax(z @ w.reshape(k, d).T)
        grad = ((p - target).T @ z).ravel() + penalty * w
        hess = np.diag(penalty)
        for i in range(k):
            for j in range(k):
                weight = p[:, i] * ((i == j) - p[:, j])
                hess[i * d : (i + 1) * d, j * d : (j + 1) * d] += (z * weight[:, None]).T @ z
        step = np.linalg.lstsq(hess, grad, rcond=None)[0]
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    return w.reshape(k, d)


def _softmax(logits: np.ndarray) -> np.ndarray:
    if logits.shape[1] == 1:
        return 1.0 / (1.0 + np.exp(-logits))
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
