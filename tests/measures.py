import numpy as np


def trustworthiness(df, at, k=15, key="arxiv_id"):
    """Share in [0, 1] by which neighbours in the plane are neighbours in the vector space. It ranks all pairs."""
    joined = df.select(key, "embedding").join(at, key).orderBy(key).toPandas()
    vectors, plane = np.stack(joined["embedding"]).astype(float), joined[["x", "y"]].to_numpy()

    def order(m):
        squares = ((m[:, None, :] - m[None, :, :]) ** 2).sum(axis=2)
        np.fill_diagonal(squares, np.inf)
        return squares.argsort(axis=1, kind="stable")

    n = len(joined)
    rank = np.empty((n, n), dtype=int)
    rank[np.arange(n)[:, None], order(vectors)] = np.arange(n)
    penalty = np.maximum(rank[np.arange(n)[:, None], order(plane)[:, :k]] - k + 1, 0).sum()
    return 1.0 - 2.0 * penalty / (n * k * (2 * n - 3 * k - 1))
