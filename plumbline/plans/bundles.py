"""Feature bundles: named column lists with inheritance."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

KINDS = ("numeric", "categorical")


def resolve_bundles(config: Mapping[str, Mapping[str, object]]) -> dict[str, dict[str, list[str]]]:
    """name -> {numeric, categorical, columns}; ``base`` inherits, ``<kind>_add`` appends, ``drop`` removes.

    Order is kept and repeats are removed; an unknown or circular base raises.
    """
    done: dict[str, dict[str, list[str]]] = {}

    def visit(name: str, trail: tuple[str, ...]) -> dict[str, list[str]]:
        if name in done:
            return done[name]
        if name in trail or name not in config:
            raise ValueError(f"unresolved bundle base: {' -> '.join((*trail, name))}")
        raw = config[name]
        base = visit(raw["base"], (*trail, name)) if raw.get("base") else {k: [] for k in KINDS}
        dropped = set(raw.get("drop", ()))
        lists = {k: [c for c in dict.fromkeys([*base[k], *raw.get(k, ()), *raw.get(f"{k}_add", ())]) if c not in dropped]
                 for k in KINDS}
        done[name] = {**lists, "columns": list(dict.fromkeys([*lists["categorical"], *lists["numeric"]]))}
        return done[name]

    for bundle in config:
        visit(bundle, ())
    return {name: done[name] for name in config}


def select_bundle(df: DataFrame, bundles: Mapping[str, Mapping[str, list[str]]], name: str, *keep: str) -> DataFrame:
    """Only the columns a bundle needs: the scan reads nothing else."""
    missing = [c for c in bundles[name]["columns"] if c not in df.columns]
    if missing:
        raise ValueError(f"table lacks bundle columns: {missing}")
    return df.select(*keep, *bundles[name]["columns"])
