import numpy as np


def unit(v):
    v = np.asarray(v, np.float64)
    return v / np.linalg.norm(v)


def rows_of(collection, vectors, segment=0):
    return [(collection, f"k{i:05}", v, 1, segment) for i, v in enumerate(vectors)]
def clustered(seed, sizes, noise=0, spread=0.07, scale=True):
    """Unit vectors around random centres, and noise; vectors are scaled if asked."""
    rng = np.random.default_rng(seed)
    out = []
    for n in sizes:
        centre = rng.normal(size=128)
        centre /= np.linalg.norm(centre)
        out.append(centre + spread * rng.normal(size=(n, 128)))
    out.append(rng.normal(size=(noise, 128)))
    rows = np.concatenate(out)
    if scale:
        rows *= rng.uniform(0.1, 10, size=(len(rows), 1))
    return rows.astype(np.float32)
