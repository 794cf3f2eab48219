"""SQL twin of operators.trees: fits and predictions as a chain of common table expressions.

The source ``mi`` has rid, train, ys (whole numbers) and xs (doubles). A unit ``u`` is one boosted model or one tree of a forest.
Rows whose ``train`` is null are scored but neither learnt from nor tested on.
"""

from __future__ import annotations

import re

from ..operators.trees import BINS, FACTOR, POISSON, PRIME, Learner


def drawn(*numbers: str) -> str:
    out = "0::BIGINT"
    for x in numbers:
        out = f"(({out} + ({x}) % {PRIME}) % {PRIME} * {FACTOR} % {PRIME})"
    return f"({out} * {FACTOR} % {PRIME})"


def divided(a: str, b: str) -> str:
    """a / b towards zero; a may be negative."""
    return f"(sign({a}) * (abs({a}) // ({b})))::BIGINT"


def units(learners: list[Learner]) -> list[tuple]:
    """(u, model, boosted, tree, rounds, depth, rate, smoothing, min_rows, share, seed, target)."""
    out = []
    for m, x in enumerate(learners):
        for t in [0] if x.boosted else range(x.rounds):
            out.append((len(out), m, x.boosted, t, x.rounds if x.boosted else 1, x.depth, x.rate, x.smoothing, x.min_rows, x.columns_share, x.seed, x.target))
    return out


def grown(learners: list[Learner], n_columns: int) -> dict[str, str]:
    """CTEs from ``mi`` to ``best`` (m, k: trees that count), ``pred`` (m, rid, y, train, y_pred), ``splits`` and ``leaves``."""
    rows = ", ".join(map(str, units(learners)))
    poisson = " + ".join(f"({drawn('rid', 'tree', 'seed')} % 10000 >= {p})::INT" for p in POISSON)
    deepest, rounds = max(x.depth for x in learners), max(x.rounds if x.boosted else 1 for x in learners)
    out = {
        "params": f"SELECT * FROM (VALUES {rows}) AS v(u, m, boosted, tree, rounds, depth, rate, smoothing, min_rows, share, seed, target)",
        "cells": "SELECT rid, train, unnest(range(len(xs))) AS f, unnest(xs) AS x FROM mi",
        "edges": f"""SELECT f, list(x ORDER BY x)[: -2] AS es FROM (
          SELECT f, b, max(x) AS x FROM (
            SELECT f, x, (rank() OVER (PARTITION BY f ORDER BY x) - 1) * {BINS} // count(*) OVER (PARTITION BY f) AS b
            FROM cells WHERE train) GROUP BY f, b) GROUP BY f""",
        "bi": """SELECT rid, any_value(train) AS train, any_value(ys) AS ys, list(b ORDER BY f) AS bs FROM (
          SELECT rid, f, len(list_filter(es, lambda e: e < x)) AS b FROM cells JOIN edges USING (f)) JOIN mi USING (rid) GROUP BY rid""",
        "base": f"""SELECT u, CASE WHEN boosted THEN {divided('s', 'n')} ELSE 0 END AS base FROM (
          SELECT u, any_value(boosted) AS boosted, sum(ys[target + 1])::HUGEINT AS s, count(ys[target + 1]) AS n FROM mi, params WHERE train GROUP BY u)""",
        "st_0": f"""SELECT u, rid, train, bs, ys[target + 1] AS y, base AS p,
          CASE WHEN train IS NOT TRUE THEN 0 WHEN boosted THEN 1 ELSE {poisson} END AS w
          FROM bi, params JOIN base USING (u) WHERE ys[target + 1] IS NOT NULL""",
    }
    for t in range(rounds):
        tree = f"CASE WHEN boosted THEN {t} ELSE tree END"
        out[f"s_{t}_0"] = f"SELECT s.*, CASE WHEN boosted THEN y - p ELSE y END AS g, 1 AS node FROM st_{t} s JOIN params USING (u) WHERE rounds > {t}"
        for level in range(deepest):
            whole, along = "OVER (PARTITION BY u, node, f)", "OVER (PARTITION BY u, node, f ORDER BY b)"
            out[f"d_{t}_{level}"] = f"""SELECT u, node, f, b, ln, lg, tn, tg, gain FROM (
              SELECT *, CASE WHEN ln >= min_rows AND tn - ln >= min_rows AND tn > ln AND {drawn(tree, 'node', 'f', 'seed')} % 1000 < share
                THEN lg::DOUBLE * lg::DOUBLE / (ln + smoothing)::DOUBLE
                  + (tg::DOUBLE - lg::DOUBLE) * (tg::DOUBLE - lg::DOUBLE) / (tn - ln + smoothing)::DOUBLE
                  - tg::DOUBLE * tg::DOUBLE / (tn + smoothing)::DOUBLE END AS gain
              FROM (SELECT u, node, f, b, sum(n) {along} AS ln, sum(g) {along} AS lg, sum(n) {whole} AS tn, sum(g) {whole} AS tg FROM (
                SELECT u, node, f, b, sum(w)::BIGINT AS n, sum(w * g)::BIGINT AS g FROM (
                  SELECT u, node, w, g, unnest(range({n_columns})) AS f, unnest(bs) AS b FROM s_{t}_{level} WHERE w > 0 AND node >= {1 << level})
                GROUP BY u, node, f, b)) JOIN params USING (u) WHERE depth > {level})
              WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY u, node ORDER BY gain DESC, f, b) = 1"""
            out[f"s_{t}_{level + 1}"] = f"""SELECT s.* REPLACE (
              CASE WHEN d.f IS NULL THEN s.node ELSE 2 * s.node + (bs[d.f + 1] > d.b)::INT END AS node)
              FROM s_{t}_{level} s LEFT JOIN d_{t}_{level} d ON d.u = s.u AND d.node = s.node"""
        both = " UNION ALL ".join(
            f"SELECT u, 2 * node, ln, lg FROM d_{t}_{k} UNION ALL SELECT u, 2 * node + 1, tn - ln, tg - lg FROM d_{t}_{k}" for k in range(deepest)
        )
        out[f"v_{t}"] = f"""SELECT u, node, n, {divided('g::HUGEINT * rate', '(n + smoothing) * 1000')} AS value FROM (
          SELECT u, 1 AS node, sum(w)::BIGINT AS n, sum(w * g)::BIGINT AS g FROM s_{t}_0 GROUP BY u UNION ALL {both}) JOIN params USING (u)"""
        out[f"st_{t + 1}"] = f"SELECT s.u, rid, train, bs, y, p + value AS p, w FROM s_{t}_{deepest} s JOIN v_{t} v ON v.u = s.u AND v.node = s.node"
        out[f"at_{t}"] = f"SELECT u, rid, {t} AS k, s.node, value FROM s_{t}_{deepest} s JOIN v_{t} v USING (u, node)"
    errors = " UNION ALL ".join(f"SELECT u, {k} AS k, coalesce(sum((y - p)::HUGEINT * (y - p)) FILTER (NOT train), 0) AS e FROM st_{k} GROUP BY u" for k in range(rounds + 1))
    out["err"] = errors
    out["best"] = f"""SELECT m, CASE WHEN NOT any_value(boosted) THEN max(rounds) WHEN max(e) = 0 THEN max(k)
      ELSE greatest(1, (list(k ORDER BY e, k))[1]) END AS k
      FROM err JOIN params USING (u) GROUP BY m"""
    out["splits"] = " UNION ALL ".join(f"SELECT u, {t} AS k, node, f, b, gain FROM d_{t}_{k}" for t in range(rounds) for k in range(deepest))
    values = " UNION ALL ".join(f"SELECT *, {t} AS k FROM v_{t}" for t in range(rounds))
    out["leaves"] = f"""SELECT u, k, node, row_number() OVER (PARTITION BY u, k
        ORDER BY node << ({deepest} - floor(log2(node))::INT)) - 1 AS leaf
      FROM ({values}) ANTI JOIN splits USING (u, k, node)"""
    stages = " UNION ALL ".join(f"SELECT u, rid, y, train, p, {k} AS k FROM st_{k}" for k in range(1, rounds + 1))
    out["pred"] = f"""SELECT m, rid, any_value(y) AS y, bool_or(s.train) AS train,
        CASE WHEN any_value(boosted) THEN sum(p)::BIGINT ELSE {divided('sum(p)', 'count(*)')} END / 1000000.0::DOUBLE AS y_pred
      FROM ({stages}) s JOIN params USING (u) JOIN best USING (m) WHERE s.k = best.k OR NOT boosted GROUP BY m, rid"""
    return out


def reached(rounds: int) -> str:
    """u, rid, k, node, value of every row and tree."""
    return " UNION ALL ".join(f"SELECT * FROM at_{t}" for t in range(rounds))


def prefixed(prefix: str, ctes: dict[str, str]) -> dict[str, str]:
    """The same chain under other names, ``mi`` included, so that two can stand in one statement."""
    names = re.compile(r"\b(" + "|".join(sorted([*ctes, "mi"], key=len, reverse=True)) + r")\b")
    return {prefix + k: names.sub(prefix + r"\1", text) for k, text in ctes.items()}
