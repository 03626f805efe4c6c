"""Sequence models in numpy, for scoring with given weights: an LSTM and a GPT-2, as plug-ins of ``bigrams.score_with``.

Weights are a dict of arrays under the usual names of such checkpoints (torch's for the LSTM). Training is not done here. A
sequence of fewer than two tokens scores 0 over none; null sequences are left to the caller, which gives them null scores.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tokenloom.operators import checkpoints
from tokenloom.sources import tensors

Weights = dict[str, np.ndarray]
Scorer = Callable[[list[list[int]]], list[tuple[float, int]]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def lstm_logits(w: Weights, tokens: np.ndarray) -> np.ndarray:
    """Logits after each token."""
    x, layer = w["embedding.weight"][tokens], 0
    while f"lstm.weight_ih_l{layer}" in w:
        inner, bias = w[f"lstm.weight_hh_l{layer}"].T, w[f"lstm.bias_ih_l{layer}"] + w[f"lstm.bias_hh_l{layer}"]
        given, n = x @ w[f"lstm.weight_ih_l{layer}"].T + bias, inner.shape[0]
        h, c, out = np.zeros(n), np.zeros(n), np.empty((len(tokens), n))
        for t, g in enumerate(given):
            i, f, m, o = np.split(g + h @ inner, 4)
            c = _sigmoid(f) * c + _sigmoid(i) * np.tanh(m)
            h = out[t] = _sigmoid(o) * np.tanh(c)
        x, layer = out, layer + 1
    return x @ w["output.weight"].T + w["output.bias"]


def _norm(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5) * w[f"{name}.weight"] + w[f"{name}.bias"]


def gpt2_logits(w: Weights, tokens: np.ndarray, heads: int) -> np.ndarray:
    """Logits after each token; the head is the embedding unless there is one of its own."""
    n = len(tokens)
    x = w["transformer.wte.weight"][tokens] + w["transformer.wpe.weight"][:n]
    hidden, layer = np.triu(np.full((n, n), -np.inf), 1), 0
    while f"transformer.h.{layer}.ln_1.weight" in w:
        at = f"transformer.h.{layer}"
        qkv = _norm(x, w, f"{at}.ln_1") @ w[f"{at}.attn.c_attn.weight"] + w[f"{at}.attn.c_attn.bias"]
        q, k, v = (a.reshape(n, heads, -1).transpose(1, 0, 2) for a in np.split(qkv, 3, -1))
        e = q @ k.transpose(0, 2, 1) / np.sqrt(q.shape[-1]) + hidden
        e = np.exp(e - e.max(-1, keepdims=True))
        mixed = (e / e.sum(-1, keepdims=True) @ v).transpose(1, 0, 2).reshape(n, -1)
        x = x + mixed @ w[f"{at}.attn.c_proj.weight"] + w[f"{at}.attn.c_proj.bias"]
        u = _norm(x, w, f"{at}.ln_2") @ w[f"{at}.mlp.c_fc.weight"] + w[f"{at}.mlp.c_fc.bias"]
        u = 0.5 * u * (1 + np.tanh(np.sqrt(2 / np.pi) * (u + 0.044715 * u**3)))
        x, layer = x + u @ w[f"{at}.mlp.c_proj.weight"] + w[f"{at}.mlp.c_proj.bias"], layer + 1
    return _norm(x, w, "transformer.ln_f") @ w.get("lm_head.weight", w["transformer.wte.weight"]).T


def scorer(logits: Callable[[np.ndarray], np.ndarray]) -> Scorer:
    """(sum of the log probabilities of the next tokens, their number) of each wrapped sequence."""

    def score(sequences: list[list[int]]) -> list[tuple[float, int]]:
        out = []
        for s in sequences:
            t = np.asarray(s, np.int64)
            if len(t) < 2:
                out.append((0.0, 0))
                continue
            z = logits(t)[:-1]
            z = z - z.max(1, keepdims=True)
            out.append((float((z[np.arange(len(z)), t[1:]] - np.log(np.exp(z).sum(1))).sum()), len(t) - 1))
        return out

    return score


def load_model(folder: str, kind: str, heads: int = 12, store: str = "") -> Scorer:
    """The scorer of the .safetensors files of a folder that all workers see, or else of its ``model.npz``."""
    w = {k: v.astype(float) for k, v in tensors.load(folder, store).items()}
    if not w:
        with np.load(f"{folder}/model.npz") as f:
            w = {k: f[k].astype(float) for k in f.files}
    return scorer((lambda t: lstm_logits(w, t)) if kind == "lstm" else (lambda t: gpt2_logits(w, t, heads)))


checkpoints.register("lstm", lambda folder, **options: load_model(folder, "lstm", **options))
checkpoints.register("gpt2", lambda folder, **options: load_model(folder, "gpt2", **options))
