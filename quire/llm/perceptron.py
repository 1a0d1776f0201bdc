"""Averaged perceptron over string features."""

from __future__ import annotations

from collections import defaultdict


class Perceptron:
    """Scores each candidate label by the sum of weights of (feature, label); training averages all steps."""

    def __init__(self):
        self.w: dict[tuple[str, str], float] = {}

    def best(self, features: list[str], labels: list[str], w: dict | None = None) -> str:
        w = self.w if w is None else w
        return max(labels, key=lambda x: (sum(w.get((f, x), 0.0) for f in features), x == labels[0]))

    def train(self, examples: list[tuple[list[str], list[str], str]], epochs: int) -> float:
        """examples: features, candidate labels (the first wins ties) and the right label; share right in the last epoch."""
        now: dict[tuple[str, str], float] = defaultdict(float)
        total: dict[tuple[str, str], float] = defaultdict(float)
        step, right = 1, 0
        for _ in range(epochs):
            right = 0
            for features, labels, gold in examples:
                got = self.best(features, labels, now)
                right += got == gold
                if got != gold:
                    for f in features:
                        now[f, gold] += 1
                        total[f, gold] += step
                        now[f, got] -= 1
                        total[f, got] -= step
                step += 1
        self.w = {k: v - total[k] / step for k, v in now.items() if v - total[k] / step}
        return right / max(1, len(examples))
