"""Repair of text from scanned pages: furniture, broken words, misread letters."""

from __future__ import annotations

import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quire.functions.text import blank_to_null
from quire.llm import editor as E
from quire.llm.perceptron import Perceptron
from quire.operators.ordering import with_neighbours
from quire.session import cut, hashed_share, release, table

#: Bounds of what the perceptrons are trained on: lines, lines of which breaks are made, and pages, taken by a hash; epochs.
TRAIN_LINES, BREAK_LINES, TRAIN_PAGES, EPOCHS = 16_000, 4000, 800, 5
#: Tokens a task remembers.
REMEMBERED = 200_000
#: Lines in which an unknown word stands that others may be misreadings of.
NAME_LINES = 5
#: Pages on which a running title stands at least.
HEAD_PAGES = 2
#: Most words of a word list, which goes to every task.
LIST_WORDS = 2_000_000

_FORMAT = dict.fromkeys([*range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2066, 0x206A), 0x2060])
_MARKS = "-¬\xad‐‑=⸗"
_TOKEN = re.compile(r"\S+")
_SENTENCE_END = re.compile(r"[.!?…][”\")]*$")
_EDGE = re.compile(r"^[^\w'!|]+|[^\w'!|]+$")
#: Shelfmarks and numbers of several digits are no words.
_SHELF = re.compile(r"[A-Z]{2,}-[A-Z]?\d|\d[.\d]*\d")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
# The numbers Hebrew letters stand for.
_HEBREW = dict(zip("אבגדהוזחטיכלמנסעפצקרשת", [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100, 200, 300, 400]))
_NUMBER = re.compile(r"^(?:(?:pp?|s|f|fol|pag|pág|seite|page|דף|עמ|עמוד|صفحة|ص)\b)?[\s.'’]*[\[(\-–—.~*]*\s*([^\W_]+|[\dlIO!|]+)\s*[\])\-–—~*]*$", re.I)


def plain(text: str | None, words: list[str] | None) -> str:
    """The line's text, else its words; without format characters and white space at the ends."""
    t = text if text is not None else " ".join(w for w in words or [] if w)
    return t.translate(_FORMAT).strip()


def number_in(text: str) -> tuple[int | None, bool]:
    """The number a line holds alone, and whether it is written in digits; letters read for digits count."""
    m = _NUMBER.match(text.strip())
    if not m:
        return None, False
    x = m.group(1)
    digits = x.translate(str.maketrans({"l": "1", "I": "1", "!": "1", "|": "1", "O": "0", "o": "0", "S": "5", "B": "8", "Z": "2", "b": "6", "g": "9"}))
    if digits.isdecimal() and len(digits) <= 18 and (any(c.isdecimal() for c in x) or len(x) <= 3 and set(x) <= set("lIO!|")):
        return int(digits), True
    low = x.lower()
    if set(low) <= set(_ROMAN):
        values = [_ROMAN[c] for c in low]
        return sum(-v if v < max(values[i:]) else v for i, v in enumerate(values)), False
    if all(c in _HEBREW for c in x):
        return sum(_HEBREW[c] for c in x), False
    return None, False


def title_keys(text: str) -> list[str]:
    """Forms under which a running title is counted: whole, without its first and without its last token.

    A line with a number inside is no title.
    """
    if any(t.strip(".,:;()[]").isdecimal() for t in text.split()[1:-1]):
        return []
    tokens = [t for t in (re.sub(r"[\W\d_]", "", x).lower() for x in text.split())]
    whole = [t for t in tokens if t]
    forms = {" ".join(whole)}
    raw = text.split()
    if len(raw) > 2:
        forms |= {" ".join(t for t in tokens[1:] if t), " ".join(t for t in tokens[:-1] if t)}
    return sorted(f for f in forms if len(f) >= 5 and " " in f or len(f) >= 8)


def near_keys(forms: list[str]) -> list[str]:
    """The forms with one word left open, so that a title misread in one word meets the title."""
    out = set()
    for form in forms:
        words = form.split()
        if len(words) >= 2:
            out |= {"~" + " ".join("_" if i == j else w for i, w in enumerate(words)) for j in range(len(words)) if sum(map(len, words)) - len(words[j]) >= 3}
    return sorted(out)


def offset_key(value: int, page: int) -> str:
    return f"#{value - page}"


def first_pass(page: int, lines: list[str]) -> list[str]:
    """What a page adds to the counts of its volume: title forms of its top lines and offsets of its page numbers."""
    keys: set[str] = set()
    for i in (0, 1):
        if i < len(lines):
            forms = title_keys(lines[i])
            keys.update(forms)
            keys.update(near_keys(forms))
    for i in {0, 1, len(lines) - 1}:
        if 0 <= i < len(lines):
            value, _ = number_in(lines[i])
            if value is not None:
                keys.add(offset_key(value, page))
    return sorted(keys)


KINDS = ["body", "header", "page_number"]


def line_signs(i: int, page: int, lines: list[str], repeated: set[str]) -> dict[str, str]:
    """Where a line stands on its page and what of it repeats in the volume."""
    text, n = lines[i], len(lines)
    forms = title_keys(text)
    value, digits = number_in(text)
    words = len(text.split())
    return {
        "place": f"top{i}" if i < 3 else f"end{n - 1 - i}" if i >= n - 2 else "inner", "last": str(i == n - 1),
        "title": "exact" if any(f in repeated for f in forms) else "near" if any(f in repeated for f in near_keys(forms)) else "none",
        "number": "no" if value is None else "digits" if digits else "letters",
        "offset": "no" if value is None else str(offset_key(value, page) in repeated),
        "words": "0" if not words else "1" if words == 1 else "2-6" if words < 7 else "7+", "stop": str(bool(_SENTENCE_END.search(text))),
    }


def line_features(s: dict[str, str], before: list[str]) -> list[str]:
    seen = ("h" if "header" in before else "") + ("n" if "page_number" in before else "")
    one = [f"{k}={v}" for k, v in s.items()]
    two = [f"{x}={s[x]}|{y}={s[y]}" for x, y in (("place", "title"), ("place", "number"), ("number", "offset"), ("title", "words"), ("title", "number"), ("last", "number"))]
    return [*one, *two, f"{seen}|{s['title']}", f"{seen}|{s['number']}|{s['offset']}", f"{s['place']}|{s['number']}|{s['offset']}", f"{s['last']}|{s['number']}|{s['offset']}"]


def furniture(page: int, lines: list[str], repeated: set[str], model: Perceptron) -> list[str]:
    """'header', 'page_number' or 'body' for each line of a page; a perceptron decides for the lines at its ends.

    A page has one running title and one page number at most.
    """
    kinds = ["body"] * len(lines)
    for i in range(len(lines)):
        if i < 3 or i >= len(lines) - 2:
            kinds[i] = model.best(line_features(line_signs(i, page, lines, repeated), kinds[:i]), [k for k in KINDS if k == "body" or k not in kinds])
    return kinds


def furniture_examples(page: int, lines: list[str], repeated: set[str], r: random.Random) -> list[tuple[list[str], list[str], str]]:
    """Lines of a page whose kind the volume tells: what repeats at the top, numbers that go up with the pages, and lines with
    nothing of either. Half of the titles are shown as if misread, and half of the numbers in digits as if out of order,
    so that place and shape are learned too.
    """
    out, kinds = [], []
    for i in range(len(lines)):
        if not (i < 3 or i >= len(lines) - 2):
            kinds.append("body")
            continue
        s, gold = line_signs(i, page, lines, repeated), None
        if s["title"] == "exact" and i < 2 and "header" not in kinds:
            gold = "header"
            s["title"] = r.choice(["exact", "near"])
        elif s["title"] == "none" and s["number"] != "no" and s["offset"] == "True":
            gold = "page_number"
            s["offset"] = r.choice(["True", "False"]) if s["number"] == "digits" else "True"
        elif s["title"] == "none" and (s["number"] == "no" or s["number"] == "letters" and s["offset"] == "False"):
            gold = "body"
        if gold is not None:
            out.append((line_features(s, kinds), KINDS, gold))
        kinds.append(gold or "body")
    return out


def unchanged(word: str, ops: tuple[str, ...]) -> bool:
    return "".join(ops) == word


class Reader:
    """Takes tokens apart; remembers them. What it gives for a token of settled words, which stay as they are, is None."""

    def __init__(self, settled: set[str]):
        self.settled, self.memory = settled, {}

    def __call__(self, token: str) -> tuple[str, list[str]] | None:
        got = self.memory.get(token, 0)
        if got == 0:
            core = core_of(token)
            pieces = pieces_of(core, self.settled)
            got = None if all(p.lower() in self.settled or not is_word(p) for p in pieces) else (core, pieces)
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            self.memory[token] = got
        return got


def page_questions(lines: list[str], kinds: list[str], before: str | None, after: str | None, reader: Reader) -> set[str]:
    """What examine() may ask of a page: its unsettled words and its breaks, whether these are joined or not."""
    body = [x for x, k in zip(lines, kinds) if k == "body"]
    out = set()
    for text in body:
        for token in _TOKEN.findall(text):
            got = reader(token)
            if got is not None:
                out |= {question(p.lower(), p[:1].isupper()) for p in got[1] if p.lower() not in reader.settled and is_word(p)}
    if body:
        for left, right in zip([before, *body], [*body, after]):
            part = break_parts(left) if left is not None else None
            first = _TOKEN.search(right) if part is not None and right is not None else None
            if first is not None:
                out.add(break_question(part, first.group()))
    return out


def break_question(left: str, right: str) -> str:
    front, a, b, _ = parts_of(left, right)
    return question(a + E.BREAK + left[-1] + b, left[len(front) : len(front) + 1].isupper(), core_of(right)[:1].isupper())


class Answers:
    """The edits of words and breaks that stand on a page. What has no answer is a word that stays as it is."""

    def __init__(self, reader: Reader, rows: list[dict]):
        self.reader, self.rows = reader, {x["q"]: x for x in rows}

    def edit(self, token: str) -> tuple[str, tuple[str, ...], bool]:
        """(text, what is written for each letter, whether it is a known word)."""
        low = token.lower()
        x = self.rows.get(question(low, token[:1].isupper()))
        return (low, tuple(low), True) if x is None else (x["text"], tuple(x["ops"]), x["there"])

    def broken(self, left: str, right: str) -> tuple[bool, str, tuple[str, ...], bool]:
        """(joined, text of the divided word, what is written for each letter of the tokens, whether it is a known word)."""
        front, a, b, end = parts_of(left, right)
        x = self.rows.get(break_question(left, right))
        joined, text, ops, there = (False, a + b, tuple(a + b), True) if x is None else (x["joined"], x["text"], tuple(x["ops"]), x["there"])
        return joined, text, (*front.lower(), *ops, *end.lower()), there


def question(word: str, cased: bool, next_cased: bool = False) -> str:
    return word + "\t" + ("^" if cased else "") + (">" if next_cased else "")


def answer(editor: E.Editor, q: str, count: int, names: dict[str, int]) -> dict:
    word, flags = q[: q.rindex("\t")], q[q.rindex("\t") :]
    cased = "^" in flags
    if E.BREAK in word:
        left, rest = word.split(E.BREAK, 1)
        _, joined, text, ops, _ = editor.breaks(left, rest[:1], rest[1:], count, (cased, ">" in flags), names)[0]
    else:
        joined, (text, ops) = None, editor.edit(word, count, cased, names)
    return {"q": q, "text": text, "ops": list(ops), "joined": joined, "there": text in editor.known or text != word and text in names}


def confidence_features(confidence: float | None) -> list[str]:
    if confidence is None or confidence != confidence:
        return ["null"]
    return ["any", f"b{min(99, int(confidence * 100))}", *[f"<{k}" for k in range(80, 100, 2) if confidence * 100 < k]]


def doubtful(confidence: float | None, trust: Perceptron) -> bool:
    known = confidence is not None and confidence == confidence
    return known and trust.best(confidence_features(confidence), ["clean", "misread"]) == "misread"


def core_of(token: str) -> str:
    return _EDGE.sub("", token)


def pieces_of(core: str, known: set[str]) -> list[str]:
    """The words of a token; a hyphen divides words, and an apostrophe those of Latin letters, but in a known word."""
    return [core] if core.lower() in known or _SHELF.search(core) else re.split(r"(['’-])" if core[:1].isascii() else r"(-)", core)


def parts_of(left: str, right: str) -> tuple[str, str, str, str]:
    """What stands in front of the word that a break divides, its two parts in lower case, and what follows it."""
    stem, rest = core_of(left[:-1]), core_of(right)
    a = re.split(r"['’-]" if stem[:1].isascii() else "-", stem)[-1]
    b = re.split(r"['’-]" if rest[:1].isascii() else "-", rest)[0]
    return stem[: len(stem) - len(a)], a.lower(), b.lower(), rest[len(b) :]


def is_word(piece: str) -> bool:
    return any(c.isalpha() for c in piece) and not _SHELF.search(piece)


def break_parts(text: str) -> str | None:
    """The last token of a line that ends in a mark after a letter, else None."""
    t = text.rstrip()
    if len(t) < 2 or t[-1] not in _MARKS or not t[-2].isalpha():
        return None
    return _TOKEN.findall(t)[-1]


def part_edited(part: str, ops: tuple[str, ...]) -> str:
    """A part of a word with its letters' operations applied."""
    if unchanged(part.lower(), ops):
        return part
    new = "".join(ops)
    return new.capitalize() if part[:1].isupper() else new


def examine(lines: list[str], confidence: list, kinds: list[str], before: str | None, after: str | None, answers: Answers, trust: Perceptron) -> tuple[list[set[str]], list[str], list[bool]]:
    """For the lines of a page: kinds of each, repaired text of each, and whether each joins the next body line.

    before and after: the last body line of the page before and the first of the page after.
    """
    body = [i for i, k in enumerate(kinds) if k == "body"]
    out: list[set[str]] = [{k} if k != "body" else set() for k in kinds]
    fixed = list(lines)
    joins = [False] * len(lines)
    taken: str | None = None  # the first token, repaired, if it belongs to a word of the line before
    if before is not None and body and (part := break_parts(before)) is not None:
        first = (_TOKEN.findall(lines[body[0]]) or [""])[0]
        joined, _, ops, _ = answers.broken(part, first) if first else (False, "", (), True)
        if joined:
            rest = core_of(first)
            ops = ops[len(core_of(part[:-1])) :]
            taken = first.replace(rest, part_edited(rest, ops), 1) if rest else first
            if not unchanged(rest.lower(), ops):
                out[body[0]].add("misread")
    for at, i in enumerate(body):
        tokens, strange = _TOKEN.findall(lines[i]), False
        nxt = lines[body[at + 1]] if at + 1 < len(body) else after
        part = break_parts(lines[i])
        first = (_TOKEN.findall(nxt) or [""])[0] if nxt else ""
        joins[i], _, ops, there = answers.broken(part, first) if part is not None and first else (False, "", (), True)
        made, follow = [], None
        for k, token in enumerate(tokens):
            if k == 0 and taken is not None:
                made.append(taken)
                if k == len(tokens) - 1 and joins[i]:
                    follow = first
                continue
            if k == len(tokens) - 1 and joins[i]:
                stem, rest = core_of(token[:-1]), core_of(first)
                head, tail = ops[: len(stem)], ops[len(stem) :]
                strange |= not there
                if not unchanged(stem.lower(), head):
                    out[i].add("misread")
                if at + 1 < len(body) and not unchanged(rest.lower(), tail):
                    out[body[at + 1]].add("misread")
                made.append(token.replace(stem, part_edited(stem, head), 1) if stem else token)
                follow = first.replace(rest, part_edited(rest, tail), 1) if rest else first
                continue
            read, new = answers.reader(token), []
            if read is None:
                made.append(token)
                continue
            core, pieces = read
            for piece in pieces:
                if is_word(piece):
                    text, letters, known = answers.edit(piece)
                    strange |= not known
                    if text != piece.lower():
                        out[i].add("misread")
                        piece = part_edited(piece, letters)
                new.append(piece)
            made.append(token.replace(core, "".join(new), 1) if core else token)
        fixed[i] = " ".join(made)
        if joins[i]:
            out[i].add("hyphen_break")
        if strange and doubtful(confidence[i], trust):  # a name or another word that cannot be judged by its letters
            out[i].add("misread")
        taken = follow
    return out, fixed, joins


def paragraphs(fixed: list[str], kinds: list[str], joins: list[bool], started: str | None) -> list[tuple[int, bool, str, bool]]:
    """(first line, goes on from the page before, text, last word goes on without a blank) of a page's paragraphs.

    A paragraph ends with a line that ends a sentence and is shorter than 85 % of the page's longest line. It goes on
    over the page's end if its last line there ends no sentence; continuous() joins such pieces.
    """
    body = [i for i, k in enumerate(kinds) if k == "body" and fixed[i]]
    if not body:
        return []
    width = max(len(fixed[i]) for i in body)
    out, text, first = [], "", None
    goes_on = started is not None and not _SENTENCE_END.search(started)
    for i in body:
        if first is None:
            first = i
        line = fixed[i]
        text += line.rstrip().rstrip(_MARKS) if joins[i] else line + " "
        if _SENTENCE_END.search(line) and len(line) < 0.85 * width:
            out.append((first, goes_on and not out, text.strip(), False))
            text, first = "", None
    if text:
        out.append((first, goes_on and not out, text.strip(), joins[body[-1]]))
    return out


def inner_words(text: str, known: set[str], memory: dict[str, list[str]]) -> list[str]:
    """The words of a line but its first and last tokens, which may be parts of words. memory: those of tokens seen before."""
    out = []
    for t in _TOKEN.findall(text)[1:-1]:
        words = memory.get(t)
        if words is None:
            if len(memory) >= REMEMBERED:
                memory.clear()
            words = memory[t] = [p for p in pieces_of(core_of(t), known) if is_word(p)]
        out += words
    return out


def made_breaks(lines: list[str], counts: dict[str, int], r: random.Random) -> list[tuple[str, str, str, tuple[bool, bool], int, bool]]:
    """(left, mark, right, capitals of both, how often they as one word stand in other lines, joined) of breaks whose truth is known: words inside lines broken anywhere, words inside
    lines with a mark put after them, and words inside lines that bear one.
    """
    out = []
    for text in lines:
        tokens = _TOKEN.findall(text)[1:-1]
        for a, b in zip(tokens, tokens[1:]):
            left, right = re.split("['’-]", core_of(a))[-1], re.split("['’-]", core_of(b))[0]
            if not (left and right and is_word(left) and is_word(right)):
                continue
            if a[-1] in _MARKS and a[-2:-1].isalpha():
                out.append((core_of(a[:-1]).lower(), a[-1], right.lower(), (a[:1].isupper(), right[:1].isupper()), 0, False))
            elif r.random() < 0.05:
                out.append((left.lower(), r.choice("-¬‐"), right.lower(), (left[:1].isupper(), right[:1].isupper()), counts.get((left + right).lower(), 0), False))
            elif len(left) >= 4 and left.isalpha() and r.random() < 0.25:
                at = r.randrange(2, len(left) - 1)
                out.append((left[:at].lower(), r.choice("-¬‐"), left[at:].lower(), (left[:1].isupper(), left[at].isupper()), max(0, counts.get(left.lower(), 1) - 1), True))
    return out


def trust_examples(lines: list[tuple[str, float | None]], editor: E.Editor, counts: dict[str, int], r: random.Random) -> list[tuple[list[str], list[str], str]]:
    """What a line's confidence tells of words that cannot be judged by their letters, learned from words that can.

    A misread word is as likely to be an unlisted one as any word, so of the lines with a word the editor repairs the share
    that unlisted words have among all words is taken; against them stand the lines with unlisted words and nothing to repair.
    """
    memory: dict[tuple[str, bool], tuple[bool, bool]] = {}
    tokens: dict[str, list[str]] = {}
    repaired, strange, total, unlisted = [], [], 0, 0
    for text, confidence in lines:
        found = []
        for w in inner_words(text, editor.known, tokens):
            key = (w.lower(), w[:1].isupper())
            if key not in memory:
                new = editor.edit(key[0], counts.get(key[0], 1), key[1])[0]
                memory[key] = (new != key[0], new in editor.known)
            found.append(memory[key])
        total += len(found)
        names = sum(not known for _, known in found)
        unlisted += names
        if any(x for x, _ in found):
            repaired.append(confidence)
        elif names:
            strange.append(confidence)
    some = r.sample(repaired, -(-len(repaired) * unlisted // max(1, total)))
    out = [(confidence_features(c), ["clean", "misread"], k) for c, k in [(c, "misread") for c in some] + [(c, "clean") for c in strange]]
    r.shuffle(out)
    return out


def list_of(words: DataFrame) -> set[str]:
    """The words of a list, in lower case; the list goes to every task, so it may hold LIST_WORDS at most."""
    known = words.filter("word IS NOT NULL").select(F.lower("word").alias("w")).distinct()
    n = known.count()
    if n > LIST_WORDS:
        raise ValueError(f"a word list may hold {LIST_WORDS} words, this one holds {n}")
    return {r.w for r in known.toLocalIterator()}


def count_words(lines: DataFrame, known: set[str]) -> DataFrame:
    """(w, k, cased): in how many lines every word stands inside, over all lines (column text), and whether ever with a capital."""
    sent = lines.sparkSession.sparkContext.broadcast(known)

    def split(batches):
        memory: dict[str, list[str]] = {}
        for batch in batches:
            words, cased = [], []
            for text in batch.column(0).to_pylist():
                found: dict[str, bool] = {}
                for t in inner_words(text, sent.value, memory):
                    found[t.lower()] = found.get(t.lower(), False) or t[:1].isupper()
                words += found
                cased += found.values()
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(cased, pa.bool_())], names=["w", "cased"])

    return lines.select("text").mapInArrow(split, "w string, cased boolean").groupBy("w").agg(F.count(F.lit(1)).alias("k"), F.bool_or("cased").alias("cased"))


def like_names(asked: DataFrame, counted: DataFrame, sent) -> DataFrame:
    """(w, names): for unknown words of asked (w, k) the frequent unknown words they differ from in one place.

    names: array of (name, n) of words that stand in NAME_LINES lines and more and in ten times as many as w. Words meet by what
    is left of them without one or two neighbouring letters, so no word is compared with all others.
    """

    def keyed(batches):
        for batch in batches:
            w, n, keys = [], [], []
            for x, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(x) >= 4 and x not in sent.value:
                    parts = E.shortened(x)
                    w += [x] * len(parts)
                    n += [k or 0] * len(parts)
                    keys += parts
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(n, pa.int64()), pa.array(keys, pa.string())], names=["w", "n", "key"])

    def verified(batches):
        for batch in batches:
            keep = [E.one_place(w, x) for w, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    schema = "w string, n bigint, key string"
    rare = asked.groupBy("w").agg(F.max("k").alias("k")).mapInArrow(keyed, schema)
    names = counted.filter(F.col("k") >= NAME_LINES).select("w", "k").mapInArrow(keyed, schema).select(F.col("w").alias("name"), F.col("n").alias("m"), "key")
    pairs = rare.join(names, "key").filter((F.col("w") != F.col("name")) & (F.col("n") * 10 <= F.col("m"))).groupBy("w", "name").agg(F.max("m").alias("n"))
    pairs = pairs.mapInArrow(verified, "w string, name string, n bigint")
    return pairs.groupBy("w").agg(F.array_sort(F.collect_list(F.struct("name", "n"))).alias("names"))


def train_editor(lines: DataFrame, counted: DataFrame, known: set[str]) -> tuple[E.Editor, Perceptron]:
    """The character editor and the perceptron that judges confidences.

    lines: text, confidence and line_id of body lines; counted: count_words(). Listed words come with their counts over all
    lines; of unknown words and of lines bounded samples are taken by a hash (TRAIN_UNKNOWN, TRAIN_LINES).
    """
    spark = lines.sparkSession
    listed = spark.createDataFrame([(w,) for w in sorted(known)], "w string")
    is_known = counted.join(listed.withColumn("listed", F.lit(True)), "w", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    totals = {r.listed: r.n for r in is_known.groupBy("listed").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = min(1.0, E.TRAIN_UNKNOWN / max(1, totals.get(False, 0)))
    rows = is_known.filter(F.col("listed") | hashed_share(["w"], share)).orderBy("w").toLocalIterator()
    counts, unknown = dict.fromkeys(known, 0), {}
    for r in rows:
        if r.listed:
            counts[r.w] = r.k
        else:
            unknown[r.w] = (r.k, r.cased)
    n = lines.count()
    some = lines.filter(hashed_share(["line_id"], min(1.0, TRAIN_LINES / max(1, n)))).select("line_id", "text", "confidence")
    sample = [(r.text, r.confidence) for r in sorted(some.toLocalIterator(), key=lambda r: (r.line_id, r.text))]
    every = {w: k for w, (k, _) in unknown.items()} | counts
    editor = E.train(counts, unknown, made_breaks([t for t, _ in sample[:BREAK_LINES]], every, random.Random(4)))
    trust = Perceptron()
    trust.train(trust_examples(sample, editor, every, random.Random(8)), 4 * EPOCHS)
    return editor, trust


PAGE_SCHEMA = "ms string, page int, page_key string, lines array<struct<line_idx:int,line_id:bigint,text:string,confidence:double>>"


def pages_of(lines: DataFrame) -> DataFrame:
    """One row per page: volume, page order, and its lines in order; a line delivered twice counts once.

    Lines without id, or with neither text nor words, are dropped. A null volume is a volume, a null page number
    comes first in it, a null line_idx first on its page.
    """
    text = F.trim(F.translate(F.coalesce("text", F.array_join("words", " ")), "".join(map(chr, _FORMAT)), ""))
    rows = lines.filter("line_id IS NOT NULL").select(
        F.col("line_id").cast("bigint").alias("line_id"), blank_to_null("manuscript_id").alias("ms"), blank_to_null("page_number").alias("page_key"),
        F.col("line_idx").cast("int").alias("line_idx"), text.alias("text"), F.col("confidence").cast("double").alias("confidence"),
    ).filter("text IS NOT NULL")
    once = rows.groupBy("line_id").agg(F.min(F.struct("ms", "page_key", "line_idx", "text", "confidence")).alias("r")).select("line_id", "r.*")
    page = F.coalesce(F.expr("try_cast(regexp_extract(page_key, '([0-9]+)', 1) AS int)"), F.lit(0))
    return once.groupBy("ms", page.alias("page"), "page_key").agg(F.array_sort(F.collect_list(F.struct("line_idx", "line_id", "text", "confidence"))).alias("lines")).select(
        "ms", "page", "page_key", "lines"
    )


def repair(lines: DataFrame, words: DataFrame) -> DataFrame:
    """One row per page: ms, page, page_key, found (array of line_id, kind) and paragraphs (line_id, continues, text, joined).

    Pages are made of their lines. The title forms and the offsets of page numbers that repeat in a volume are counted over
    all pages and meet the pages that have them; a perceptron tells furniture by place and repetition. The body lines at a
    page's end and start are looked up from the nearest pages with body lines. The listed words are put to the character
    editor first; those it leaves alone are settled. Every other different word and every break of the pages, with its count
    over all lines, is put to it once, and the answers go back to the pages. Then every page is worked on by itself. See pages_of() for nulls and repeated rows.
    """
    pages = cut(pages_of(lines), "pages")
    context = lines.sparkSession.sparkContext

    def count(batches):
        for batch in batches:
            ms, at, keys = [], [], []
            for m, p, ls in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                for k in first_pass(p, [x["text"] for x in ls]):
                    ms.append(m)
                    at.append(ls[0]["line_id"])
                    keys.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(ms, pa.string()), pa.array(at, pa.int64()), pa.array(keys, pa.string())], names=["ms", "at", "k"])

    keys = cut(pages.mapInArrow(count, "ms string, at bigint, k string"), "keys")
    repeated = keys.groupBy("ms", "k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HEAD_PAGES).select(F.col("ms").alias("cms"), F.col("k").alias("ck"))
    own = keys.join(repeated, F.col("ms").eqNullSafe(F.col("cms")) & (F.col("k") == F.col("ck"))).groupBy("at").agg(F.sort_array(F.collect_set("k")).alias("own"))
    met = pages.withColumn("at", F.col("lines")[0]["line_id"]).join(own, "at", "left")
    met = cut(met.select("ms", "page", "page_key", "lines", F.coalesce("own", F.array().cast("array<string>")).alias("own")), "met", drop=keys)
    release(pages)
    r, examples = random.Random(6), []
    n = met.count()
    few = met.filter(hashed_share(["ms", "page", "page_key"], min(1.0, TRAIN_PAGES / max(1, n)))).select("ms", "page", "page_key", F.transform("lines", lambda x: x["text"]).alias("texts"), "own")
    for row in sorted(few.toLocalIterator(), key=lambda x: (x.ms or "", x.page, x.page_key or "")):
        examples += furniture_examples(row.page, row.texts, set(row.own), r)
    layout = Perceptron()
    layout.train(examples, EPOCHS)
    sent_layout = context.broadcast(layout)

    def classify(batches):
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(5)]
            kinds, first, last = [], [], []
            for p, ls, own in zip(cols[1], cols[3], cols[4]):
                texts = [x["text"] for x in ls]
                k = furniture(p, texts, set(own), sent_layout.value)
                body = [t for t, x in zip(texts, k) if x == "body" and t]
                kinds.append(k)
                first.append(body[0] if body else None)
                last.append(body[-1] if body else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(kinds, pa.list_(pa.string())), pa.array(first, pa.string()), pa.array(last, pa.string())], names=["ms", "page", "page_key", "lines", "kinds", "head", "tail"])

    ready = cut(met.mapInArrow(classify, PAGE_SCHEMA + ", kinds array<string>, head string, tail string"), "kinds", drop=met)
    columns = ["ms", "page", "page_key", "lines", "kinds"]
    bare = ready.filter("tail IS NULL").select(*columns, *(F.lit(None).cast("string").alias(c) for c in ("next_head", "prev_tail")))
    beside = with_neighbours(ready.filter("tail IS NOT NULL"), "ms", ["page", "page_key"], ["head", "tail"])
    ready = cut(beside.select(*columns, "next_head", "prev_tail").unionByName(bare).withColumn("at", F.col("lines")[0]["line_id"]), "pages", drop=ready)
    body = F.filter(F.zip_with("lines", "kinds", lambda x, k: x.withField("kind", k)), lambda x: x["kind"] == "body")
    body = ready.select(F.explode(body).alias("x")).select("x.line_id", "x.text", "x.confidence")
    known = list_of(words)
    counted = cut(count_words(body, known), "counted")
    editor, trust = train_editor(body, counted, known)
    sent, sent_known, sent_trust = context.broadcast((editor.known, editor.becomes, editor.w)), context.broadcast(known), context.broadcast(trust)

    answer_type = pa.struct([("q", pa.string()), ("text", pa.string()), ("ops", pa.list_(pa.string())), ("joined", pa.bool_()), ("there", pa.bool_())])
    answer_schema = "struct<q:string,text:string,ops:array<string>,joined:boolean,there:boolean>"

    def reply(batches):
        own = E.Editor(*sent.value)
        for batch in batches:
            out = [answer(own, q, k or 0, {x["name"]: x["n"] for x in names or []}) for q, k, names in zip(*(c.to_pylist() for c in batch.columns))]
            out = [x for x in out if x["joined"] is not None or not x["there"] or x["text"] != x["q"][: x["q"].rindex("\t")]]
            yield pa.RecordBatch.from_arrays([pa.array([x["q"] for x in out], pa.string()), pa.array(out, answer_type)], names=["q", "x"])

    listed = lines.sparkSession.createDataFrame([(question(w, c), k) for w, k in sorted(editor.known.items()) for c in (False, True)], "q string, k bigint")
    listed = listed.withColumn("names", F.lit(None).cast("array<struct<name:string,n:bigint>>")).repartition(context.defaultParallelism)
    changed = {r.q[: r.q.rindex("\t")] for r in listed.mapInArrow(reply, f"q string, x {answer_schema}").select("q").collect()}  # listed words, of which there are LIST_WORDS at most
    sent_settled = context.broadcast(known - changed)

    def ask(batches):
        reader = Reader(sent_settled.value)
        for batch in batches:
            at, questions = [], []
            for page, ls, kinds, after, before in zip(*(batch.column(i).to_pylist() for i in range(5))):
                found = page_questions([x["text"] for x in ls], kinds, before, after, reader)
                at += [page] * len(found)
                questions += sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(questions, pa.string())], names=["at", "q"])

    asked = cut(ready.select("at", "lines", "kinds", "next_head", "prev_tail").mapInArrow(ask, "at bigint, q string"), "asked")
    word = F.regexp_replace(F.regexp_replace("q", "\t.*$", ""), "\n.", "")
    different = cut(asked.select("q").distinct().withColumn("w", word).join(counted.select("w", "k"), "w", "left"), "different")
    names = like_names(different, counted, sent_known)
    different = different.join(names, "w", "left").select("q", "k", "names")
    tasks = max(1, min(context.defaultParallelism * 4, different.sparkSession.conf.get("spark.sql.shuffle.partitions") and int(different.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    answers = cut(different.repartition(tasks, "q").mapInArrow(reply, f"q string, x {answer_schema}"), "answers", drop=counted)
    given = asked.join(answers, "q").groupBy("at").agg(F.collect_list("x").alias("answers"))
    found_type = pa.list_(pa.struct([("line_id", pa.int64()), ("kind", pa.string())]))
    text_type = pa.list_(pa.struct([("line_id", pa.int64()), ("continues", pa.bool_()), ("text", pa.string()), ("joined", pa.bool_())]))

    def work(batches):
        reader = Reader(sent_settled.value)
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(3, 8)]
            found, texts = [], []
            for ls, kinds, after, before, rows in zip(*cols):
                out, fixed, joins = examine([x["text"] for x in ls], [x["confidence"] for x in ls], kinds, before, after, Answers(reader, rows or []), sent_trust.value)
                found.append([{"line_id": x["line_id"], "kind": k} for x, ks in zip(ls, out) for k in sorted(ks)])
                texts.append([{"line_id": ls[i]["line_id"], "continues": c, "text": t, "joined": j} for i, c, t, j in paragraphs(fixed, kinds, joins, before)])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(found, found_type), pa.array(texts, text_type)], names=["ms", "page", "page_key", "found", "paragraphs"])

    full = ready.join(given, "at", "left").select(*columns, "next_head", "prev_tail", "answers")
    return full.mapInArrow(work, "ms string, page int, page_key string, found array<struct<line_id:bigint,kind:string>>, paragraphs array<struct<line_id:bigint,continues:boolean,text:string,joined:boolean>>")


def continuous(pages: DataFrame) -> DataFrame:
    """(ms, paragraph, page_key, line_id, pages, text): the paragraphs of every volume, over page ends.

    pages: result of repair(). paragraph counts from 0 in the volume; page_key and line_id are of its first line; pages
    is the number of pages it stands on. Pieces join with a blank, halves of a broken word without. The pages of a
    volume are counted by one window over ids alone; texts are shuffled by paragraph.
    """
    pages = cut(pages.filter(F.size("paragraphs") > 0).select("ms", "page", "page_key", "paragraphs"), "repaired")
    first = F.col("paragraphs")[0]
    goes_on = first["continues"].cast("int")
    small = pages.select(first["line_id"].alias("key"), "ms", "page", "page_key", (F.size("paragraphs") - goes_on).alias("started"))
    w = Window.partitionBy("ms").orderBy("page", "page_key")
    before = F.coalesce(F.sum("started").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    small = small.withColumns({"place": F.row_number().over(w), "before": before}).select("key", "place", "before")
    rows = pages.withColumns({"key": first["line_id"], "goes_on": goes_on}).join(small, "key").select("ms", "page_key", "place", "before", "goes_on", F.posexplode("paragraphs").alias("i", "x"))
    rows = rows.withColumn("paragraph", F.col("before") + F.col("i") - F.col("goes_on"))
    piece = F.struct("place", "page_key", "x.line_id", "x.text", "x.joined")
    rows = rows.groupBy("ms", "paragraph").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    text = F.aggregate("p", F.lit(""), lambda a, x: F.concat(a, x["text"], F.when(x["joined"], F.lit("")).otherwise(F.lit(" "))))
    return rows.select("ms", "paragraph", F.col("p")[0]["page_key"].alias("page_key"), F.col("p")[0]["line_id"].alias("line_id"), F.size("p").alias("pages"), F.trim(text).alias("text"))


def _repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "alto_text_lines"), table(spark, sf_dir, "word_list"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir).select(F.explode("found").alias("x")).select("x.line_id", "x.kind")


def p6_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous paragraphs of every volume: number, page and line of its start, pages it stands on, repaired text."""
    rows = continuous(_repaired(spark, sf_dir))
    return rows.select(F.col("ms").alias("manuscript_id"), F.col("page_key").alias("page_number"), "paragraph", "line_id", "pages", "text")


QUERIES = {"p6_found": p6_found, "p6_paragraphs": p6_paragraphs}
SQL: dict[str, str] = {}
