"""Grouped NumPy work that has no relational form: each group is one small matrix, groups are spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def effective_resistance(edges: DataFrame, component: str = "component") -> DataFrame:
    """(src, dst, resistance) for all pairs src < dst of each component, by the Laplacian's pseudo-inverse.

    edges (component, src, dst, weight) are conductances, taken as undirected sums.
    """

    def solve(pdf):
        import numpy as np
        import pandas as pd

        names = np.unique(np.concatenate([pdf["src"], pdf["dst"]]))
        a, b = np.searchsorted(names, pdf["src"]), np.searchsorted(names, pdf["dst"])
        g = np.zeros((len(names), len(names)))
        np.add.at(g, (a, b), pdf["weight"])
        g = g + g.T
        np.fill_diagonal(g, 0)
        inv = np.linalg.pinv(np.diag(g.sum(axis=1)) - g, hermitian=True)
        i, j = np.triu_indices(len(names), 1)
        return pd.DataFrame({"src": names[i], "dst": names[j], "resistance": inv[i, i] + inv[j, j] - 2 * inv[i, j]})

    return edges.select(component, F.col("src").cast("long"), F.col("dst").cast("long"), F.col("weight").cast("double")).groupBy(component).applyInPandas(solve, "src long, dst long, resistance double")


def effective_rank(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, rank): exponential of the entropy of a group's normalised singular values."""

    def rank(pdf):
        import numpy as np
        import pandas as pd

        s = np.linalg.svd(np.stack(pdf[vector].to_list()).astype(float), compute_uv=False)
        p = s[s > 1e-12] / s.sum() if s.sum() > 0 else np.ones(0)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "rank": [float(np.exp(-(p * np.log(p)).sum())) if len(p) else 0.0]})

    return rows.select(by, vector).groupBy(by).applyInPandas(rank, f"{by} {dict(rows.dtypes)[by]}, rank double")


def principal_signals(panel: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """(grp, component, t, value, share): leading principal components of each group's centred series; gaps count as the mean.

    The sign of a component is that of its largest loading.
    """

    def pca(pdf):
        import numpy as np
        import pandas as pd

        wide = pdf.pivot_table(index="t", columns="node", values="value", dropna=False).sort_index()
        x = (wide - wide.mean()).fillna(0.0).to_numpy()
        u, s, vt = np.linalg.svd(x, full_matrices=False)
        total = (s**2).sum() or 1.0
        out = []
        for c in range(min(k, len(s))):
            sign = np.sign(vt[c][np.argmax(np.abs(vt[c]))]) or 1.0
            out.append(pd.DataFrame({"grp": pdf["grp"].iloc[0], "component": c, "t": wide.index, "value": sign * u[:, c] * s[c], "share": s[c] ** 2 / total}))
        return pd.concat(out)

    j = panel.join(groups, "node").select(F.col("grp").cast("long"), "node", "t", "value")
    return j.groupBy("grp").applyInPandas(pca, "grp long, component int, t long, value double, share double")


def k_center(points: DataFrame, by: str, k: int) -> DataFrame:
    """(by, id, turn): farthest-first choice of k points (id, v) per group, from the smallest id; ties to the smaller id."""

    def choose(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("id")
        v, ids = np.stack(pdf["v"].to_list()).astype(float), pdf["id"].to_numpy()
        picked, d = [0], ((v - v[0]) ** 2).sum(axis=1)
        while len(picked) < min(k, len(ids)):
            far = int(np.argmax(np.round(d, 9)))
            picked.append(far)
            d = np.minimum(d, ((v - v[far]) ** 2).sum(axis=1))
        return pd.DataFrame({by: pdf[by].iloc[0], "id": ids[picked], "turn": range(len(picked))})

    kind = dict(points.dtypes)
    return points.select(by, "id", "v").groupBy(by).applyInPandas(choose, f"{by} {kind[by]}, id {kind['id']}, turn int")


def independent_columns(panel: DataFrame, by: str, min_std: float = 1e-8) -> DataFrame:
    """(by, node, pos): of each group's series (by, node, t, value) those that raise the rank of the centred matrix when taken in order of node, and vary by more than min_std.

    A group is one small sample's matrix; steps at which any series has a gap are left out.
    """

    def choose(pdf):
        import numpy as np
        import pandas as pd

        wide = pdf.pivot_table(index="t", columns="node", values="value").sort_index().dropna()
        x = wide.to_numpy() - wide.to_numpy().mean(axis=0) if len(wide) else np.zeros((0, wide.shape[1]))
        kept, basis = [], np.zeros((len(x), 0))
        for j in range(x.shape[1]):
            rest = x[:, j] - basis @ (basis.T @ x[:, j])
            size = np.linalg.norm(x[:, j])
            if size > 0 and np.linalg.norm(rest) > 1e-9 * size and x[:, j].std() > min_std:
                kept.append(wide.columns[j])
                basis = np.column_stack([basis, rest / np.linalg.norm(rest)])
        return pd.DataFrame({by: [pdf[by].iloc[0]] * len(kept), "node": kept, "pos": range(len(kept))})

    kind = dict(panel.dtypes)
    return panel.select(by, "node", "t", "value").groupBy(by).applyInPandas(choose, f"{by} {kind[by]}, node {kind['node']}, pos int")


def breadth_chunks(edges: DataFrame, size: int, component: str = "component") -> DataFrame:
    """(node, component, chunk): nodes of each component (component, src, dst) in chunks of at most `size` by breadth-first search, seeds and neighbours in order of falling degree, then node.

    The order is sequential, so a component is one task; components must fit an executor.
    """

    def chunks(pdf):
        import pandas as pd

        near: dict = {}
        for a, b in zip(pdf["src"], pdf["dst"]):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        order = sorted(near, key=lambda n: (-len(near[n] - {n}), n))
        place = {n: k for k, n in enumerate(order)}
        out, chunk = {}, 0
        for seed in order:
            if seed in out:
                continue
            queue, n = [seed], 0
            seen = {seed}
            while queue and n < size:
                at = queue.pop(0)
                out[at] = chunk
                n += 1
                for m in sorted(near[at], key=place.get):
                    if m not in out and m not in seen:
                        seen.add(m)
                        queue.append(m)
            chunk += 1
        return pd.DataFrame({"node": list(out), "component": pdf[component].iloc[0], "chunk": list(out.values())})

    e = edges.select(component, F.col("src").cast("long"), F.col("dst").cast("long"))
    return e.groupBy(component).applyInPandas(chunks, f"node long, component {dict(edges.dtypes)[component]}, chunk int")
