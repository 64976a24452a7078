"""Paths, invariants and atom maps of one molecule's graph: molecules are small, so each is a group of its own."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators.graph import groups, neighbours


def base_atoms(bonds: DataFrame, origin: int, direction: int) -> DataFrame:
    """(mol_id, origin, direction, third): the smallest neighbour of `direction` but `origin`, else of `origin` but `direction`; null
    where neither has one."""
    n = neighbours(bonds)
    far = F.min(F.when((F.col("atom") == direction) & (F.col("other") != origin), F.col("other")))
    near = F.min(F.when((F.col("atom") == origin) & (F.col("other") != direction), F.col("other")))
    return n.groupBy("mol_id").agg(F.coalesce(far, near).alias("third")).select("mol_id", F.lit(origin).alias("origin"), F.lit(direction).alias("direction"), "third")


def accompanied(atom_map: DataFrame, bonds: DataFrame) -> DataFrame:
    """Rows of atom_map(mol_id, old_idx, new_idx) whose old atom is bonded to another mapped one."""
    mapped = atom_map.select("mol_id", F.col("old_idx").alias("other"))
    held = neighbours(bonds).join(mapped, ["mol_id", "other"], "left_semi").select("mol_id", F.col("atom").alias("old_idx"))
    return atom_map.join(held, ["mol_id", "old_idx"], "left_semi")


def bonds_of(bonds: DataFrame, atoms: DataFrame, symbols: list[str], without: bool = False) -> DataFrame:
    """Bonds with an atom of these elements at an end, or those without."""
    own = atoms.where(F.col("symbol").isin(symbols)).select("mol_id", "atom_idx")
    keep = bonds.select("mol_id", "a1", "a2", F.explode(F.array("a1", "a2")).alias("atom_idx")).join(own, ["mol_id", "atom_idx"], "left_semi").select("mol_id", "a1", "a2").distinct()
    return bonds.join(keep, ["mol_id", "a1", "a2"], "left_anti" if without else "left_semi")


def _near(pdf: pd.DataFrame) -> dict[int, list[int]]:
    near: dict[int, list[int]] = {}
    for a, b in zip(pdf["a1"].tolist(), pdf["a2"].tolist(), strict=True):
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    return {a: sorted(set(b)) for a, b in sorted(near.items())}


def _shortest(near: dict[int, list[int]], source: int) -> dict[int, list[int]]:
    paths, queue = {source: [source]}, deque([source])
    while queue:
        a = queue.popleft()
        for b in near[a]:
            if b not in paths:
                paths[b] = paths[a] + [b]
                queue.append(b)
    return paths


def diameter_path(bonds: DataFrame) -> DataFrame:
    """(mol_id, length, path): the longest of all shortest paths; of equally long ones the first in order of atoms."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        near = _near(pdf)
        best = min((p for a in near for p in _shortest(near, a).values()), key=lambda p: (-len(p), p))
        return pd.DataFrame({"mol_id": [pdf["mol_id"].iloc[0]], "length": [len(best) - 1], "path": [best]})

    return groups(bonds.select("mol_id", "a1", "a2")).applyInPandas(one, f"mol_id {dict(bonds.dtypes)['mol_id']}, length int, path array<int>")


def classes(atoms: list[int], symbols: list[str], bonds: Iterable[tuple[int, int]]) -> dict[int, int]:
    """atom_classes() of one molecule."""
    symbol, near = dict(zip(atoms, symbols, strict=True)), {i: set() for i in atoms}
    for i, j in bonds:
        if i in near and j in near:
            near[i].add(j)
            near[j].add(i)
    sign, count = {i: (s,) for i, s in symbol.items()}, 0
    while True:
        order = {s: k for k, s in enumerate(sorted(set(sign.values())))}
        kind = {i: order[s] for i, s in sign.items()}
        if len(order) == count:
            return kind
        count = len(order)
        sign = {i: (kind[i], *sorted(kind[j] for j in near[i])) for i in symbol}


def atom_classes(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(mol_id, atom_idx, class): atoms that elements and neighbourhoods, refined until they part no more, can't tell apart share a
    class; classes count from 0 in an order that doesn't depend on the numbering of atoms."""

    def one(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        kind = classes(a["atom_idx"].tolist(), a["symbol"].tolist(), zip(b["a1"].tolist(), b["a2"].tolist(), strict=True))
        return pd.DataFrame({"mol_id": [key[0]] * len(kind), "atom_idx": list(kind), "class": list(kind.values())})

    left, right = groups(atoms.select("mol_id", "atom_idx", "symbol")), groups(bonds.select(F.col("mol_id").alias("mol_id"), "a1", "a2"))  # a column of its own, should both come of one table
    return left.cogroup(right).applyInPandas(one, f"mol_id {dict(atoms.dtypes)['mol_id']}, atom_idx int, class int")


def closed(atom_map: Iterable[tuple[int, int]], atoms: list[int]) -> list[tuple[int, int]]:
    """closed_map() of one molecule."""
    own, to, taken = set(atoms), {}, set()
    for old, new in sorted(atom_map):
        if old in own and new in own and old not in to and new not in taken:
            to[old] = new
            taken.add(new)
    for start in [i for i in to if i not in taken]:
        end = start
        while end in to:
            end = to[end]
        to[end] = start
    return [(i, to.get(i, i)) for i in sorted(atoms)]


def closed_map(atom_map: DataFrame, atoms: DataFrame) -> DataFrame:
    """(mol_id, old_idx, new_idx) of every atom, one to one. Rows out of range and later claims to a place go; a chain's end gets the
    place that its start left, and atoms beyond all chains stay."""

    def one(key, m: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        rows = closed(zip(m["old_idx"].tolist(), m["new_idx"].tolist(), strict=True), a["atom_idx"].tolist())
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["mol_id", "old_idx", "new_idx"])

    left, right = groups(atom_map.select("mol_id", "old_idx", "new_idx")), groups(atoms.select(F.col("mol_id").alias("mol_id"), "atom_idx"))
    return left.cogroup(right).applyInPandas(one, f"mol_id {dict(atoms.dtypes)['mol_id']}, old_idx int, new_idx int")
