"""Eigenvalues and eigenvectors of small symmetric matrices by Jacobi rotations, as Spark expressions alone.

Each rotation turns the plane of two axes so that the element between them becomes 0; going through all pairs of axes a
few times leaves a diagonal of eigenvalues. Only sums, products, quotients and roots are taken, so other engines that do
the same steps get the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import once

#: Times that all pairs of axes are gone through.
SWEEPS_3, SWEEPS_6 = 5, 7


def pairs(n: int, sweeps: int) -> list[tuple[int, int]]:
    return [(p, q) for _ in range(sweeps) for p in range(n) for q in range(p + 1, n)]


def tangent(app: Column, aqq: Column, apq: Column) -> Column:
    """Tangent of the angle that makes apq vanish, the lesser of the two; 0 if it is 0 already."""
    tau = (aqq - app) / F.nullif(2 * apq, F.lit(0.0))
    return F.coalesce(F.when(tau >= 0, 1.0).otherwise(-1.0) / (F.abs(tau) + F.sqrt(1 + tau * tau)), F.lit(0.0))


def eigen3(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Of one symmetric 3 x 3 matrix a row (sxx, syy, szz, sxy, sxz, syz): keys, eigenvectors e0x .. e2z of length 1 with a
    positive first part (that isn't 0), and eigenvalues l0 <= l1 <= l2.

    Equal eigenvalues go by their vectors. The zero matrix has the axes as vectors, last axis first; null or NaN sums give
    null or NaN.
    """
    name = lambda i, j: f"_a{min(i, j)}{max(i, j)}"
    df = sums.select(*keys, *[F.col(f"s{'xyz'[i]}{'xyz'[j]}").cast("double").alias(name(i, j)) for i in range(3) for j in range(i, 3)], *[F.lit(float(i == j)).alias(f"_v{i}{j}") for i in range(3) for j in range(3)])
    a = lambda i, j: F.col(name(i, j))
    every = [name(i, j) for i in range(3) for j in range(i, 3)] + [f"_v{i}{j}" for i in range(3) for j in range(3)]
    for p, q in pairs(3, SWEEPS_3):
        r = 3 - p - q
        t = F.col("_t")
        df = once(df, tangent(a(p, p), a(q, q), a(p, q)).alias("_t"))
        df = once(df, (1 / F.sqrt(1 + t * t)).alias("_c"))
        c, s = F.col("_c"), F.col("_t") * F.col("_c")
        new = {name(p, p): a(p, p) - t * a(p, q), name(q, q): a(q, q) + t * a(p, q), name(p, q): F.lit(0.0), name(r, p): c * a(r, p) - s * a(r, q), name(r, q): s * a(r, p) + c * a(r, q), name(r, r): a(r, r)}
        for i in range(3):
            new |= {f"_v{i}{p}": c * F.col(f"_v{i}{p}") - s * F.col(f"_v{i}{q}"), f"_v{i}{q}": s * F.col(f"_v{i}{p}") + c * F.col(f"_v{i}{q}"), f"_v{i}{r}": F.col(f"_v{i}{r}")}
        df = df.select(*keys, F.inline(F.array(F.struct(*[new[n].alias(n) for n in every]))))
    found = F.array_sort(F.array(*[F.struct(a(k, k).alias("l"), *[F.col(f"_v{i}{k}").alias("xyz"[i]) for i in range(3)]) for k in range(3)]))
    df = once(df.select(*keys, found.alias("_e")), *[F.element_at("_e", k + 1).alias(f"_e{k}") for k in range(3)])
    lead = [F.coalesce(*[F.when(F.abs(f"_e{k}.{c}") > 1e-9, F.col(f"_e{k}.{c}")) for c in "xyz"]) for k in range(3)]
    turned = [F.when(lead[k] < 0, -F.col(f"_e{k}.{c}")).otherwise(F.col(f"_e{k}.{c}")).alias(f"e{k}{c}") for k in range(3) for c in "xyz"]
    return df.select(*keys, *turned, *[F.col(f"_e{k}.l").alias(f"l{k}") for k in range(3)])


def eigen3_rows(sums: DataFrame, keys: list[str]) -> DataFrame:
    """``eigen3`` with the same steps in numpy, for long tables: its plan is one step, so the driver holds no long expressions.

    Sums must be finite; the columns ``keys`` stay as they are.
    """
    six, out = [f"s{a}" for a in ("xx", "yy", "zz", "xy", "xz", "yz")], [*[f"e{k}{c}" for k in range(3) for c in "xyz"], "l0", "l1", "l2"]
    df = sums.select(*keys, *[F.col(c).cast("double").alias(c) for c in six])

    def turned(batches):
        import pyarrow as pa

        for batch in batches:
            found = jacobi3(*[batch.column(c).to_numpy(zero_copy_only=False) for c in six])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], *[pa.array(c) for c in found]], names=[*keys, *out])

    kinds = dict(df.dtypes)
    return df.mapInArrow(turned, ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], *[f"{c} double" for c in out]]))


def jacobi3(xx, yy, zz, xy, xz, yz) -> list:
    """Columns e0x .. e2z, l0, l1, l2 of arrays of sums, by the steps of ``eigen3``."""
    import numpy as np

    a = {(0, 0): xx, (1, 1): yy, (2, 2): zz, (0, 1): xy, (0, 2): xz, (1, 2): yz}
    a = {k: np.asarray(v, float) for k, v in a.items()}
    at = lambda i, j: (min(i, j), max(i, j))
    v = {(i, j): np.full(len(a[0, 0]), float(i == j)) for i in range(3) for j in range(3)}
    with np.errstate(all="ignore"):
        for p, q in pairs(3, SWEEPS_3):
            r, off = 3 - p - q, a[at(p, q)]
            tau = (a[q, q] - a[p, p]) / (2 * off)
            t = np.where(2 * off == 0, 0.0, np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.sqrt(1 + tau * tau)))
            c = 1 / np.sqrt(1 + t * t)
            s = t * c
            rp, rq = a[at(r, p)], a[at(r, q)]
            a |= {(p, p): a[p, p] - t * off, (q, q): a[q, q] + t * off, at(p, q): np.zeros(len(off)), at(r, p): c * rp - s * rq, at(r, q): s * rp + c * rq}
            for i in range(3):
                vp, vq = v[i, p], v[i, q]
                v |= {(i, p): c * vp - s * vq, (i, q): s * vp + c * vq}
    stack = [np.stack([a[k, k] for k in range(3)], 1), *[np.stack([v[i, k] for k in range(3)], 1) for i in range(3)]]
    order = np.lexsort(stack[::-1], axis=1)
    low, *e = (np.take_along_axis(x, order, 1) for x in stack)
    big = [np.abs(x) > 1e-9 for x in e]
    lead = np.where(big[0], e[0], np.where(big[1], e[1], np.where(big[2], e[2], 0.0)))
    e = [np.where(lead < 0, -x, x) for x in e]
    return [*[e[i][:, k] for k in range(3) for i in range(3)], *[low[:, k] for k in range(3)]]


def eigenvalues(matrix: Column, n: int, sweeps: int = SWEEPS_6) -> Column:
    """Eigenvalues, in ascending order, of a symmetric n x n matrix held as an array row by row."""

    def turn(m: Column, pq: Column) -> Column:
        p, q = pq["p"], pq["q"]
        at = lambda i, j: F.element_at(m, i * n + j + 1)
        angle = F.array(F.struct(tangent(at(p, p), at(q, q), at(p, q)).alias("t")))

        def rotated(x: Column) -> Column:
            t = x["t"]
            c = 1 / F.sqrt(1 + t * t)

            def element(k: Column) -> Column:
                i, j = F.floor(k / n).cast("int"), k % n
                turns = lambda z: (z == p) | (z == q)
                r, hit = F.when(turns(i), j).otherwise(i), F.when(turns(i), i).otherwise(j)  # the row that stays, and the axis that turns
                far = F.when(hit == p, c * at(r, p) - t * c * at(r, q)).otherwise(t * c * at(r, p) + c * at(r, q))
                both = F.when(i != j, F.lit(0.0)).when(i == p, at(p, p) - t * at(p, q)).otherwise(at(q, q) + t * at(p, q))
                return F.when(turns(i) & turns(j), both).when(turns(i) | turns(j), far).otherwise(F.element_at(m, k + 1))

            return F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), element)

        return F.element_at(F.transform(angle, rotated), 1)

    order = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in pairs(n, 1)])
    diagonal = lambda m: F.array_sort(F.array(*[F.element_at(m, i * n + i + 1) for i in range(n)]))
    return F.aggregate(F.flatten(F.array_repeat(order, sweeps)), matrix, turn, diagonal)


def jacobi_sql(source: str, keys: str, n: int, sweeps: int, tag: str = "") -> str:
    """The same rotations in DuckDB SQL: table ``turned<tag>`` of (keys, m, v), from a select of (keys, m), m row by row.

    To be put after ``with recursive``.
    """
    order = ", ".join(f"{{p: {p}, q: {q}}}" for p, q in pairs(n, sweeps))
    unit = ", ".join(f"{float(i == j)}::double" for i in range(n) for j in range(n))
    i, j = f"(x//{n})", f"(x%{n})"
    at = lambda i, j: f"m[{i}*{n}+{j}+1]"
    tau = f"(({at('q', 'q')}-{at('p', 'p')})/nullif(2*{at('p', 'q')}, 0))"
    row_turns, column_turns = f"({i} = p or {i} = q)", f"({j} = p or {j} = q)"
    stays, turns = f"(case when {row_turns} then {j} else {i} end)", f"(case when {row_turns} then {i} else {j} end)"
    both = f"case when {i} <> {j} then 0.0::double when {i} = p then {at('p', 'p')}-t*{at('p', 'q')} else {at('q', 'q')}+t*{at('p', 'q')} end"
    far = f"case when {turns} = p then c*{at(stays, 'p')}-t*c*{at(stays, 'q')} else t*c*{at(stays, 'p')}+c*{at(stays, 'q')} end"
    element = f"case when {row_turns} and {column_turns} then {both} when {row_turns} or {column_turns} then {far} else m[x+1] end"
    vector = f"case when {j} = p then c*v[x+1]-t*c*v[{i}*{n}+q+1] when {j} = q then t*c*v[{i}*{n}+p+1]+c*v[x+1] else v[x+1] end"
    return f"""turns{tag} as (select unnest(range({len(pairs(n, sweeps))})) k, unnest([{order}], recursive := true)),
jac{tag} as (select {keys}, 0 k, m, [{unit}] v from ({source}) union all
 select {keys}, k + 1, list_transform(range({n * n}), lambda x: {element}) m, list_transform(range({n * n}), lambda x: {vector}) v from
 (select *, 1 / sqrt(1 + t*t) c from (select jac{tag}.*, p, q, coalesce(case when {tau} >= 0 then 1.0::double else -1.0::double end / (abs({tau}) + sqrt(1 + {tau}*{tau})), 0) t from jac{tag} join turns{tag} using (k)))),
turned{tag} as (select {keys}, m, v from jac{tag} where k = {len(pairs(n, sweeps))})"""


def eigen3_sql(source: str, keys: str, tag: str = "") -> str:
    """``eigen3`` in DuckDB SQL: table ``eigen<tag>`` of (keys, e0x .. e2z, l0, l1, l2) from a select of (keys, sxx .. syz)."""
    m = f"select {keys}, [sxx, sxy, sxz, sxy, syy, syz, sxz, syz, szz]::double[] m from ({source})"
    found = ", ".join(f"{{l: m[{k * 4 + 1}], x: v[{k + 1}], y: v[{k + 4}], z: v[{k + 7}]}}" for k in range(3))
    sign = lambda k: "case when coalesce(" + ", ".join(f"case when abs(e[{k + 1}].{c}) > 1e-9 then e[{k + 1}].{c} end" for c in "xyz") + ") < 0 then -1 else 1 end"
    out = ", ".join(f"e[{k + 1}].{c} * ({sign(k)}) e{k}{c}" for k in range(3) for c in "xyz") + ", " + ", ".join(f"e[{k + 1}].l l{k}" for k in range(3))
    return f"{jacobi_sql(m, keys, 3, SWEEPS_3, tag)},\neigen{tag} as (select {keys}, {out} from (select {keys}, list_sort([{found}]) e from turned{tag}))"
