"""Calibration of the read noise: dispersion a0 / rel + a1 from replicates with latent abundances, by tuned Metropolis steps."""

from __future__ import annotations

import numpy as np

from strandline.functions.distributions import generator, lgamma

PRIOR_SD = 1.0  #: of a log relative abundance around its replicates' mean


def tuned(scale: np.ndarray, taken: np.ndarray, tries: int, target: float = 0.44) -> np.ndarray:
    """Steps made longer or shorter by half, towards the share of accepted ones."""
    return scale * np.where(taken / tries > target, 1.5, 1 / 1.5)


def calibrate(reads: np.ndarray | list[np.ndarray], seed: int = 0, chain: int = 0, burnin: int = 400, n_samples: int = 1000, every: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Draws of (a0, a1) from replicate reads, a matrix (replicates, taxa) for each community.

    The communities' relative abundances are latent: each taxon's is walked in its logarithm, its prior a normal around
    the replicates' mean share; given them a0 and a1 are walked in theirs.  Taxa never read are left out.

    All communities are weighed at once, as one array of (community, taxon) sites with their replicates side by side; a
    density is worked out once for each proposal, and gamma functions only where there are reads.
    """
    rng = generator(seed, "negbin", chain)
    groups = [reads] if isinstance(reads, np.ndarray) else reads
    groups = [r[:, r.sum(0) > 0] for r in groups if r.sum() > 0]
    depth = [r.sum(1, keepdims=True) for r in groups]
    centre = [np.log(np.maximum((r / np.maximum(d, 1)).mean(0), 1e-9)) for r, d in zip(groups, depth)]
    width = [r.shape[1] for r in groups]
    border = np.concatenate([[0], np.cumsum(width)]).astype(np.int64)
    reps = np.repeat([len(r) for r in groups], width).astype(np.int64)  # of each site
    first = np.cumsum(reps) - reps
    flat = lambda parts, kind: np.concatenate([*(x.T.ravel() for x in parts), np.empty(0)]).astype(kind)
    depths = flat([np.broadcast_to(d, r.shape) for r, d in zip(groups, depth)], float)
    counts = flat(groups, float)
    read = np.flatnonzero(counts)
    some = counts[read]
    middle = np.concatenate([*centre, np.empty(0)])
    log_rel = middle.copy()
    state = np.array([1e-6, 0.1])
    out = np.empty((n_samples, 2))
    scale, taken = np.array([1.0, 0.5]), np.zeros(2)
    walk, moved = np.full(len(middle), 0.3), np.zeros(len(middle))

    def per_site(lr: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Log density of each site's reads and of its place, up to what neither ``lr`` nor ``a`` changes."""
        if not len(lr):
            return np.zeros(0)
        rel = np.exp(lr)
        r = 1 / (a[0] / rel + a[1])
        size, mean = np.repeat(r, reps), np.repeat(rel, reps) * depths
        ll = size * np.log(size / (size + mean))
        r, mean = size[read], mean[read]
        ll[read] += lgamma(some + r) - lgamma(r) + some * np.log(np.maximum(mean, 1e-300) / (r + mean))
        return np.add.reduceat(ll, first) - 0.5 * ((lr - middle) / PRIOR_SD) ** 2

    now = per_site(log_rel, state)
    z, u = np.empty(len(middle)), np.empty(len(middle))
    for g in range(n_samples):
        for i, j in zip(border[:-1].tolist(), border[1:].tolist()):
            rng.standard_normal(out=z[i:j])
            rng.random(out=u[i:j])
        new = log_rel + walk * z  # sites are independent given a0 and a1
        then = per_site(new, state)
        ok = np.log(u) < then - now
        log_rel[ok], now[ok] = new[ok], then[ok]
        moved += ok
        for j in (0, 1):
            new = state.copy()
            new[j] *= np.exp(scale[j] * rng.standard_normal())
            fits = bool(((new > 0) & (new < 1e5)).all())
            then = per_site(log_rel, new) if fits else now
            gain = float((then - now).sum()) if fits else -np.inf
            if np.log(rng.random()) < gain + np.log(new[j]) - np.log(state[j]):
                state, now = new, then
                taken[j] += 1
        out[g] = state
        if (g + 1) % every == 0:
            if g < burnin // 2:
                scale, walk = tuned(scale, taken, every), tuned(walk, moved, every)
            taken[:] = 0
            moved[:] = 0
    return out[:, 0], out[:, 1]
