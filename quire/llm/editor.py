"""A character editor: an averaged perceptron that generates keep, replace, delete, insert and line-join operations."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

#: Partial edits kept at every letter.
BEAM = 6
#: Bounds of what the editor is trained on: made pairs, words of the list, and unknown words of the lines.
TRAIN_PAIRS, TRAIN_LIST, TRAIN_UNKNOWN, EPOCHS = 2500, 20_000, 5000, 3
#: A break is written as this sign between the two parts in front of the mark.
BREAK = "\n"

Weights = dict[tuple, float]


def kind_of(c: str, y: str) -> str:
    """The operation that turns the letter c into y: keep, delete, replace or insert."""
    return "keep" if y == c else "delete" if not y else "replace" if len(y) == 1 else "insert"


def _shape(c: str) -> str:
    return "9" if c.isdecimal() else "a" if c.isalpha() else c


class Editor:
    """Edits words letter by letter.

    An operation writes a string for a letter: the letter itself, nothing, another letter, or two. Which ones a letter
    may become is learned (see confusions()). A beam of partial edits is scored by the perceptron's weights on the letter,
    its neighbours, the operation before it, whether what is written so far begins a known word, and at the end whether
    it is one, how much was edited and how often the word stands in the lines. Known words are features, no more.
    """

    def __init__(self, known: dict[str, int], becomes: dict[str, list[str]], weights: Weights | None = None):
        self.known, self.becomes, self.w = known, becomes, weights if weights is not None else {}
        self.prefixes = {w[:i] for w in known for i in range(len(w) + 1)}
        self._local: dict[tuple, tuple[float, tuple]] = {}

    def local(self, p: str, c: str, n: str, last: str, y: str) -> tuple[float, tuple]:
        """Score and features of writing y for c between p and n after the operation `last`."""
        key = (p, c, n, last, y)
        got = self._local.get(key)
        if got is None:
            k = kind_of(c, y)
            f = [("k", k), ("cy", c, y), ("s", _shape(p), _shape(c), _shape(n), k)]
            if k != "keep":
                f += [("pcy", p, c, y), ("cny", c, n, y), ("l", last, c, y), ("ss", _shape(p), c, _shape(n), y)]
            elif last:
                f.append(("lk", last, c))
            got = self._local[key] = (sum(self.w.get(x, 0.0) for x in f), tuple(f))
        return got

    def ending(self, word: str, out: str, edits: int, count: int, cased: bool, names: dict[str, int]) -> list[tuple]:
        """Features of a whole edit of a word that stands `count` times in the lines."""
        there = "listed" if out in self.known else "name" if out in names else ""
        size = "1-3" if len(word) <= 3 else "4-5" if len(word) <= 5 else "6-7" if len(word) <= 7 else "8+"
        e = min(edits, 3)
        f = [("end", there, e), ("end", there, e, size), ("odd", there, e > 0, not word.isalpha(), not out.isalpha()), ("cased", there, e > 0, cased), ("was", word in self.known, e > 0)]
        if edits and there:
            share = count / max(1, self.known.get(out, 0), names.get(out, 0))
            f += [("share", next((i for i, x in enumerate((0.004, 0.016, 0.06, 0.25, 1.0)) if share < x), 5)), ("out", size, e, min(len(out), 4))]
        return f

    def paths(self, word: str, count: int, cased: bool, names: dict[str, int]) -> list[tuple[float, str, tuple[str, ...], list[tuple]]]:
        """(score, text, what is written for each letter, features) of the beam's edits of a word, best first.

        names: unlisted words of the lines that this one may be a misreading of, with their counts.
        """
        w, n = self.w, len(word)
        prefixes = _either(self.prefixes, names)
        beam = [(0.0, "", (), (), 0, "")]  # score, text, operations, features, edits, last edit
        for i, c in enumerate(word):
            p, nx = word[i - 1] if i else "^", word[i + 1] if i + 1 < n else "$"
            new = []
            for score, out, ops, feats, edits, last in beam:
                was = out in prefixes
                for y in (c, *self.becomes.get(c, ())):
                    s, f = self.local(p, c, nx, last, y)
                    text = out + y
                    change = y != c
                    t = ("trie", change, was, text in prefixes)
                    follows = change and bool(last)  # one misreading may take several letters
                    new.append((score + s + w.get(t, 0.0), text, (*ops, y), (*feats, *f, t), edits + (change and not follows), c + ">" + y if change else ""))
            new.sort(key=lambda x: (-x[0], x[4], x[1]))
            beam = new[:BEAM]
            keep = next((x for x in new[BEAM:] if x[1] == word[: i + 1] and x[4] == 0), None)
            if keep is not None:
                beam.append(keep)
        out = []
        for score, text, ops, feats, edits, _ in beam:
            f = self.ending(word, text, edits, count, cased, names)
            out.append((score + sum(w.get(x, 0.0) for x in f), text, ops, [*feats, *f]))
        out.sort(key=lambda x: (-x[0], x[1] != word, x[1]))
        return out

    def edit(self, word: str, count: int = 1, cased: bool = False, names: dict[str, int] | None = None) -> tuple[str, tuple[str, ...]]:
        """The text of a word (in lower case) and what is written for each of its letters."""
        if not any(c.isalpha() for c in word):
            return word, tuple(word)
        _, text, ops, _ = self.paths(word, count, cased, names or {})[0]
        return text, ops

    def joining(self, left: str, mark: str, right: str, cased: tuple[bool, bool], join: bool, whole: str, seen: bool) -> list[tuple]:
        """Features of joining or keeping a break; whole: the edited text of the two parts as one word; seen: it stands in other lines."""
        a, b, k = left in self.known, right in self.known, whole in self.known
        begins, exact = left in self.prefixes, left + right in self.known
        return [("join", join), ("mark", join, mark), ("whole", join, k, exact), ("parts", join, a, b), ("all", join, k, a, b), ("named", join, k, a, b, *cased), ("capital", join, cased[1]), ("right", join, right if b else "?"), ("begins", join, begins, k), ("seen", join, seen, k, a, b)]

    def breaks(self, left: str, mark: str, right: str, count: int, cased: tuple[bool, bool], names: dict[str, int] | None = None) -> list[tuple[float, bool, str, tuple[str, ...], list[tuple]]]:
        """(score, joined, text, what is written for each letter of both parts, features) of a broken word, best first."""
        score, text, ops, feats = self.paths(left + right, count, cased[0], names or {})[0]
        join = self.joining(left, mark, right, cased, True, text, count > 0)
        keep = self.joining(left, mark, right, cased, False, text, count > 0)
        value = lambda f: sum(self.w.get(x, 0.0) for x in f)
        out = [(value(join), True, text, ops, join), (value(keep), False, left + right, tuple(left + right), keep)]
        out.sort(key=lambda x: (-x[0], not x[1]))
        return out


class _Either:
    """Prefixes of listed words and of a few names."""

    def __init__(self, listed: set[str], names: set[str]):
        self.listed, self.names = listed, names

    def __contains__(self, x: str) -> bool:
        return x in self.listed or x in self.names


def _either(listed: set[str], names: dict[str, int]) -> set[str] | _Either:
    return _Either(listed, {x[:i] for x in names for i in range(len(x) + 1)}) if names else listed


def shortened(w: str) -> list[str]:
    """A word, and what is left of it without one letter or two neighbouring ones."""
    return sorted({w} | {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + w[i + 2 :] for i in range(len(w) - 1)})


def one_place(w: str, x: str) -> bool:
    """Whether w and x differ in one place, by two letters for one at most."""
    a, b, _ = differing(w, x)
    return max(len(a), len(b)) <= 2 and len(a) + len(b) <= 3


class _Learning:
    """Averaged weights: now, and the sums that make the average."""

    def __init__(self, editor: Editor):
        self.editor, self.sums, self.step = editor, defaultdict(float), 1

    def update(self, gold: Iterable[tuple], got: Iterable[tuple]) -> None:
        change = Counter(gold)
        change.subtract(Counter(got))
        for f, v in change.items():
            if v:
                self.editor.w[f] = self.editor.w.get(f, 0.0) + v
                self.sums[f] += self.step * v
        self.editor._local.clear()

    def finish(self) -> None:
        self.editor.w = {f: x for f, v in self.editor.w.items() if abs(x := v - self.sums[f] / self.step) > 1e-9}
        self.editor._local.clear()


def _deletes(w: str) -> set[str]:
    one = {w[:i] + w[i + 1 :] for i in range(len(w))}
    two = {x[:i] + x[i + 1 :] for x in one for i in range(len(x))} if len(w) >= 4 else set()
    return {w} | one | two


def differing(w: str, x: str) -> tuple[str, str, int]:
    """What stands in w and in x between their common beginning and end, and where it begins."""
    i = 0
    while i < min(len(w), len(x)) and w[i] == x[i]:
        i += 1
    j = 0
    while j < min(len(w), len(x)) - i and w[-1 - j] == x[-1 - j]:
        j += 1
    return w[i : len(w) - j], x[i : len(x) - j], i


def confusions(unknown: dict[str, int], known: dict[str, int]) -> tuple[Counter, dict[str, list[tuple[str, str, str]]]]:
    """How the lines misread: counts of (read, meant) over unknown words that differ from a known one in one place, and those words' explanations."""
    near: dict[str, list[str]] = defaultdict(list)
    for w in sorted(known)[:TRAIN_LIST]:
        for d in _deletes(w):
            near[d].append(w)
    found: Counter = Counter()
    explained: dict[str, list[tuple[str, str, str]]] = defaultdict(list)
    for w in unknown:
        for x in sorted({x for d in _deletes(w) for x in near.get(d, ())}):
            a, b, _ = differing(w, x)
            if one_place(w, x) and unknown[w] <= 0.1 * max(10, known[x]):
                explained[w].append((a, b, x))
    for _ in range(2):  # a word several known ones may explain counts for the likelier misreading
        now: Counter = Counter()
        for why in explained.values():
            a, b, _ = max(why, key=lambda y: (found[y[:2]], y))
            now[a, b] += 1
        found = now
    least = max(1.0, 0.001 * found.total())  # what is rarer among all misreadings is chance
    return Counter({k: v for k, v in found.items() if v >= least}), explained


def written(w: str, read: str, meant: str, at: int) -> tuple[str, ...]:
    """What the gold edit writes for each letter of w, in which `read` stands at `at` for `meant`."""
    ops = list(w)
    if not read:  # a lost letter is written after the one before it
        i = max(0, at - 1)
        ops[i] = w[i] + meant if at else meant + w[i]
    elif len(read) == 2 and len(meant) == 1:
        ops[at], ops[at + 1] = meant, ""
    else:
        for j in range(len(read)):
            ops[at + j] = meant[j] if j < len(meant) else ""
        if len(meant) > len(read):
            ops[at + len(read) - 1] = meant[len(read) - 1 :]
    return tuple(ops)


def corrupt(r: random.Random, x: str, places: dict[str, list[tuple[str, str, int]]], most: int = 2) -> tuple[str, tuple[str, ...]] | None:
    """A misreading of x with the operations that undo it; places: what may stand for a meant string: (read, meant, count)."""
    may = [(i, read, meant, n) for i in range(len(x) + 1) for size in (0, 1, 2) if i + size <= len(x) for read, meant, n in places.get(x[i : i + size], ())]
    if not may:
        return None
    i, read, meant, _ = r.choices(may, [m[3] for m in may])[0]
    w = x[:i] + read + x[i + len(meant) :]
    if w == x or not w:
        return None
    ops = list(written(w, read, meant, i))
    if most > 1 and len(x) >= 6 and r.random() < 0.15:
        after = i + len(meant) + 1
        more = corrupt(r, x[after:], places, 1) if after < len(x) else None
        if more is not None:
            at = i + len(read) + 1
            w, ops = w[:at] + more[0], ops[:at] + list(more[1])
    return w, tuple(ops)


def train(known: dict[str, int], unknown: dict[str, tuple[int, bool]], pairs: list[tuple[str, str, str, tuple[bool, bool], int, bool]], seed: int = 3) -> Editor:
    """Train the editor on pairs of misread and clean words.

    known: listed words and how often they stand in the lines; unknown: a bounded sample of other words with (count,
    capital). How the lines misread is counted first; clean words misread that way, with the operations that undo it, are
    the pairs to learn from, beside clean words, and unknown words that no misreading of a rarer kind explains, which are
    names and are kept (or, misread by a digit or sign, restored). pairs: (left, mark, right, capitals, count, joined) of
    breaks.
    """
    r = random.Random(seed)
    counts = {w: n for w, (n, _) in unknown.items()}
    found, explained = confusions(counts, known)
    becomes: dict[str, set[str]] = defaultdict(set)
    places: dict[str, list[tuple[str, str, int]]] = defaultdict(list)
    for (read, meant), n in sorted(found.items()):
        places[meant].append((read, meant, n))
        for c, y in zip("x" + read + "x", written("x" + read + "x", read, meant, 1)):
            if c != "x" and y != c:
                becomes[c].add(y)
        if not read:
            for w in known:
                for i in range(len(w) - 1):
                    if w[i + 1] == meant:
                        becomes[w[i]].add(w[i] + meant)
    editor = Editor(known, {c: sorted(ys) for c, ys in becomes.items()})
    signs = {m: [x for x in xs if x[0] and not x[0].isalpha()] for m, xs in places.items()}
    listed = r.sample(sorted(known), min(len(known), TRAIN_PAIRS))
    examples: list[tuple[str, tuple[str, ...], int, bool, dict[str, int]]] = [(w, tuple(w), known[w], False, {}) for w in listed]
    names = [w for w in sorted(unknown) if w not in explained]
    examples += [(w, tuple(w), unknown[w][0], unknown[w][1], {}) for w in r.sample(names, min(len(names), TRAIN_PAIRS // 2)) if w.isalpha()]
    pool = [w for w in sorted(known) if known[w] > 0] or sorted(known)
    for _ in range(TRAIN_PAIRS if pool else 0):
        x = r.choice(pool)
        made = corrupt(r, x, places)
        if made and made[0] not in known:
            examples.append((*made, counts.get(made[0], 1), r.random() < 0.1, {}))
    for x in r.choices(names, k=TRAIN_PAIRS // 4) if names else []:
        often = unknown[x][0] >= 10
        made = corrupt(r, x, places if often else signs, 1) if x.isalpha() else None
        if made and made[0] not in known:
            examples.append((*made, counts.get(made[0], 1), unknown[x][1], {x: unknown[x][0]} if often else {}))
    learning = _Learning(editor)
    for _ in range(EPOCHS):
        r.shuffle(examples)
        for w, gold, n, cased, near in examples:
            best = editor.paths(w, n, cased, near)[0]
            if best[2] != gold:
                learning.update(_features(editor, w, gold, n, cased, near), best[3])
            learning.step += 1
    learning.finish()
    learning = _Learning(editor)
    base = dict(editor.w)
    for _ in range(EPOCHS):
        r.shuffle(pairs)
        for left, mark, right, cased, n, joined in pairs:
            both = editor.breaks(left, mark, right, n, cased)
            if both[0][1] != joined:
                learning.update(both[1][4], both[0][4])
            learning.step += 1
    learning.finish()
    editor.w |= base
    return editor


def _features(editor: Editor, word: str, ops: tuple[str, ...], count: int, cased: bool, names: dict[str, int]) -> list[tuple]:
    """Features of a given edit."""
    prefixes = _either(editor.prefixes, names)
    out, last, edits, feats = "", "", 0, []
    for i, (c, y) in enumerate(zip(word, ops)):
        p, n = word[i - 1] if i else "^", word[i + 1] if i + 1 < len(word) else "$"
        was, change = out in prefixes, y != c
        feats += editor.local(p, c, n, last, y)[1]
        out += y
        feats.append(("trie", change, was, out in prefixes))
        edits += change and not last
        last = c + ">" + y if change else ""
    return feats + editor.ending(word, out, edits, count, cased, names)
