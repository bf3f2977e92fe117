"""Random streams keyed by seed, iteration and row key, so that results don't depend on partitions."""

from __future__ import annotations

import hashlib

import numpy as np

_GAMMA = np.uint64(0x9E3779B97F4A7C15)


def splitmix(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser of 64-bit states."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sub_seed(seed: int, iteration: int) -> int:
    """The seed of an iteration's own stream; seed 0 counts as the increment."""
    with np.errstate(over="ignore"):
        base = np.uint64(seed % (1 << 64)) if seed else _GAMMA
        return int(splitmix(base + _GAMMA * np.uint64(iteration + 1)))


def stream(seed: int, *key: object) -> np.random.Generator:
    """A generator of its own for a seed and a key of any parts."""
    text = "\x1f".join(map(str, (seed, *key)))
    return np.random.default_rng(int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big"))
