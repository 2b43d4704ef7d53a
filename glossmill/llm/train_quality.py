"""Learns quality_rules.json: an ordered rule list by incremental reduced-error pruning.

    python -m glossmill.llm.train_quality FOLDER

FOLDER holds the documents that ``quality_labels.json`` labels (ids of the tables of scale 0.1). The labels are a reading:
3262 documents to learn from, the bound of the sample, and 220 to judge by, none of which repeats a text of the others.
The rules see the SQL statistics only.
"""

from __future__ import annotations

import json
import sys
from importlib import resources
from math import log2
from pathlib import Path

import numpy as np

from glossmill.llm.quality import STATISTICS


def labels() -> dict[str, dict[int, str]]:
    """Kinds by document, of the documents to learn from ("learn") and to judge by ("judge")."""
    read = json.loads(resources.files(__package__).joinpath("quality_labels.json").read_text())
    return {part: {i: kind for kind, ids in kinds.items() for i in ids} for part, kinds in read.items()}


class Irep:
    """Incremental reduced-error pruning.

    For each kind in turn a rule is grown on two thirds of the rows, condition by condition by information gain, until it
    covers no other kind; its last conditions are dropped while that does not lower (p - n) / (p + n) on the other third;
    the kind is done when its rule is wrong on more than half of what it covers there, or no row of the kind is left.
    """

    def __init__(self, names: tuple[str, ...], seed: int = 7):
        self.names, self.random = names, np.random.default_rng(seed)

    @staticmethod
    def covers(rule, x: dict[str, np.ndarray]) -> np.ndarray:
        got = np.ones(len(next(iter(x.values()))), bool)
        for s, op, at in rule:
            got &= (x[s] <= at) if op == "<=" else (x[s] > at)
        return got

    def _best(self, x, mine, inside):
        """The condition of highest gain: every place between two values that occur is tried."""
        before, best, top = log2(mine[inside].mean()), None, 0.0
        for s in self.names:
            order = np.flatnonzero(inside)[np.argsort(x[s][inside], kind="stable")]
            values, hits = x[s][order], mine[order]
            at = np.flatnonzero(values[1:] > values[:-1])
            if not len(at):
                continue
            below = np.cumsum(hits)[at].astype(float)
            for op, p, n in (("<=", below, at + 1.0), (">", hits.sum() - below, len(hits) - at - 1.0)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / n) - before), 0.0)
                k = int(gain.argmax())
                if gain[k] > top + 1e-9:
                    best, top = (s, op, float((values[at[k]] + values[at[k] + 1]) / 2)), gain[k]
        return best

    def _grow(self, x, mine):
        rule, inside = [], np.ones(len(mine), bool)
        while not mine[inside].all() and (found := self._best(x, mine, inside)):
            rule.append(found)
            inside &= self.covers([found], x)
        return rule

    def _prune(self, rule, x, mine):
        def worth(k: int) -> float:
            got = mine[self.covers(rule[:k], x)]
            return 2 * got.mean() - 1 if len(got) else -1.0

        return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))]

    def fit(self, x: dict[str, np.ndarray], kinds: np.ndarray, order: tuple[str, ...]) -> list[dict]:
        """Rules of each kind in order; rows that earlier rules cover are gone for later ones."""
        out, left = [], np.ones(len(kinds), bool)
        for kind in order:
            mine = kinds == kind
            while (left & mine).any():
                grow = np.zeros(len(kinds), bool)
                for part in (left & mine, left & ~mine):
                    rows = self.random.permutation(np.flatnonzero(part))
                    grow[rows[: -(-2 * len(rows) // 3)]] = True
                prune = left & ~grow
                rule = self._grow({s: v[grow] for s, v in x.items()}, mine[grow])
                rule = rule and self._prune(rule, {s: v[prune] for s, v in x.items()}, mine[prune])
                got = mine[prune & self.covers(rule, x)] if rule else mine[:0]
                if not len(got) or got.mean() < 0.5:
                    break
                out.append({"kind": kind, "when": tightest(rule)})
                left &= ~self.covers(out[-1]["when"], x)
        return out


def tightest(rule: list[tuple]) -> list[list]:
    """The conditions of a rule, of several on one side of a statistic only the tightest, with four digits."""
    kept: dict[tuple, float] = {}
    for s, op, at in rule:
        kept[s, op] = (min if op == "<=" else max)(at, kept.get((s, op), at))
    return [[s, op, float(f"{at:.4g}")] for (s, op), at in kept.items()]


def apply(rules: list[dict], x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.full(len(next(iter(x.values()))), "prose", object)
    for r in reversed(rules):
        out[Irep.covers(r["when"], x)] = r["kind"]
    return out


def main(folder: str) -> None:
    from pyspark.sql import SparkSession

    from glossmill.llm.quality import with_statistics

    spark = SparkSession.builder.master("local[6]").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    rows = with_statistics(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", "text").toPandas().set_index("doc_id")
    parts = {part: (list(ids), np.array(list(ids.values()), object)) for part, ids in labels().items()}
    taken = {part: {s: rows.loc[ids, s].to_numpy() for s in STATISTICS} for part, (ids, _) in parts.items()}
    names, counts = np.unique(parts["learn"][1][parts["learn"][1] != "prose"], return_counts=True)
    model = Irep(STATISTICS).fit(taken["learn"], parts["learn"][1], tuple(names[np.argsort(counts)]))  # the rarest first
    Path(__file__).with_name("quality_rules.json").write_text("{\n \"rules\": [\n  " + ",\n  ".join(map(json.dumps, model)) + "\n ]\n}\n")
    for part, (ids, kinds) in parts.items():
        got = apply(model, taken[part])
        print(f"{part}: {len(ids)} documents, wrong {(got != kinds).sum()}: {[(i, a, b) for i, a, b in zip(ids, kinds, got) if a != b][:40]}")
    print(f"{len(model)} rules")


if __name__ == "__main__":
    main(sys.argv[1])
