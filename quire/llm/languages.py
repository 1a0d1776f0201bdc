"""Languages of documents and of their segments, by a bidirectional recurrent network over bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.functions.text import blank_to_null
from quire.llm.bigru import BiGRU
from quire.session import hashed_share, table

LANGS = ["en", "de", "fr", "es", "it", "he", "ar", "jrb"]
#: Bounds of what the network is fitted on: documents and sentences as they come (in all), and of each language; sequences
#: made of the list of each language.
FIRST_DOCS, FIRST_SENTENCES, TRAIN_DOCS, TRAIN_SENTENCES, TRAIN_LISTED = 1500, 5000, 250, 700, 250
EPOCHS, RATE = (3, 6), 0.02
#: Bytes of a row of the network; a longer sentence is divided into rows.
ROW_BYTES = 256
#: Bytes of texts that are taken apart together.
CHUNK_BYTES = 1 << 20
#: Neighbouring bytes speak alike: so many count as one observation.
BYTES_PER_OBSERVATION = 25
#: Probability from which a sentence is of a language of its text.
LEAST_CONFIDENCE = 0.9

# Names and codes of the languages in labels.
_NAMES = {
    "en": "en eng english anglais englisch",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais französisch",
    "es": "es spa spanish español espanol castellano",
    "it": "it ita italian italiano",
    "he": "he heb iw hebrew עברית",
    "ar": "ar ara arabic العربية",
    "jrb": "jrb judeo-arabic judeoarabic judaeo-arabic judeo_arabic",
}
_OF_NAME = {n: lang for lang, names in _NAMES.items() for n in names.split()}
_NONE = {"", "und", "unknown", "mul", "zxx", "mis", "none", "null", "n/a", "na", "?", "??", "???", "-"}

_HEAD = re.compile(r"[^\W\d_]+(?: [^\W\d_]+){0,2}: ?\S+(?: \S+){0,2}|\S*\d\S*")
#: Longest heading.
HEAD_BYTES = 120

OTHER, DROP, END, CLOSE, QUOTE, MORE = 1, 2, 4, 8, 16, 32
#: Marks of quotations and what may close each.
_QUOTES = {"“": "”", "„": "“”", "«": "»", '"': '"'}


def _classes() -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Classes of single bytes, of pairs of bytes, and of the three-byte characters whose first two bytes are MORE."""
    one, two, three = np.zeros(256, dtype=np.uint8), np.zeros(65536, dtype=np.uint8), {}
    one[:128] = OTHER
    one[[*range(65, 91), *range(97, 123)]] = 0
    for marks, flag in ((".!?", END), (")]\"", CLOSE), ('"', QUOTE)):
        one[[ord(c) for c in marks]] |= flag
    two[0xC280:0xC2C0] = OTHER
    groups = {
        0: "ªµº", DROP: "\xad\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2066\u2067\u2068\u2069\ufeff", OTHER: "×÷،؛٪٫٬־׀׃׆׳״、" + "".join(chr(0x660 + i) + chr(0x6F0 + i) for i in range(10)),
        OTHER | END: "…؟۔。", OTHER | CLOSE: "’", OTHER | CLOSE | QUOTE: "”“»", OTHER | QUOTE: "«„",
    }
    for flag, marks in groups.items():
        for c in marks:
            raw = c.encode()
            if len(raw) == 2:
                two[raw[0] * 256 + raw[1]] = flag
            else:
                three[int.from_bytes(raw)] = flag
    two[[0xE280, 0xE281, 0xE380, 0xEFBB]] = MORE
    return one, two, three


_ONE, _TWO, _THREE = _classes()
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def label_language(label: str | Column) -> Column:
    """The language a label names: one of LANGS, 'other' for another language, null where it names none."""
    c = F.lower(blank_to_null(label if isinstance(label, Column) else F.col(label)))
    base = F.element_at(F.split(c, "[-_ ]"), 1)
    names = F.create_map(*[F.lit(x) for pair in _OF_NAME.items() for x in pair])
    return F.when(c.isNull() | c.isin(*_NONE) | c.rlike(r"^\W+$"), None).otherwise(F.coalesce(names[c], names[base], F.lit("other")))


@dataclass
class Sentences:
    """The sentences of several texts: text, byte range, whether an end mark closes it, and the letters for the network."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    whole: np.ndarray
    values: np.ndarray
    first: np.ndarray
    length: np.ndarray


def _blank_lines(b: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Line ends with nothing but blanks before them."""
    if len(lines) < 2:
        return lines[:0]
    a, z = lines[:-1], lines[1:]
    blank = z - a == 1
    for i in np.flatnonzero(~blank & _SPACE[b[a + 1]] & _SPACE[b[z - 1]]):
        blank[i] = not b[a[i] : z[i]].tobytes().strip()
    return z[blank]


def _quotations(b: np.ndarray, at: np.ndarray, breaks: np.ndarray, letters: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges of quotations among the marks at `at`; one closes in its own paragraph. A straight mark between letters is none."""
    straight = b[at] == 34
    at = at[~(straight & letters[np.maximum(at - 1, 0)] & letters[np.minimum(at + 1, len(b) - 1)])]
    out, opened = [], None
    for i, paragraph in zip(at.tolist(), np.searchsorted(breaks, at, side="right").tolist()):
        size = 1 if b[i] == 34 else 2 if b[i] == 0xC2 else 3
        mark = b[i : i + size].tobytes().decode()
        if opened is not None and opened[2] != paragraph:
            opened = None
        if opened is None:
            opened = (i, mark, paragraph) if mark in _QUOTES else None
        elif mark in _QUOTES[opened[1]]:
            out.append((opened[0], i + size))
            opened = None
    return out


def _headings(b: np.ndarray, lines: np.ndarray, leading: set[int]) -> list[tuple[int, int]]:
    """Byte ranges of headings: lines 'Name: value', or a mark alone, that begin a paragraph or follow another heading."""
    out = []
    first = np.concatenate([[0], lines[:-1] + 1]) if len(lines) else lines
    short = np.flatnonzero(lines - first <= HEAD_BYTES)
    for i in short:
        a, z = int(first[i]), int(lines[i])
        if a in leading and z > a and _HEAD.fullmatch(b[a:z].tobytes().decode("utf-8", "replace").strip()):
            out.append((a, z))
            leading.add(z + 1)
    return out


def sentences(texts: list[bytes]) -> Sentences:
    """Take texts apart. Paragraphs end at blank lines, sentences at an end mark before white space.

    Headings and quotations hold no letters for the network; digits and marks are blanks to it, runs of blanks one; format
    characters and the breaks of hyphenated lines vanish; letters are lower case. A piece without an end mark is not
    whole. Texts are read to their ends, and a sentence may have any length.
    """
    sizes = np.array([len(t) + 2 for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    b = np.frombuffer(b"\n\n".join([*texts, b""]), dtype=np.uint8).copy()
    n = len(b)
    lines = np.flatnonzero(b == 10)
    breaks = np.union1d(_blank_lines(b, lines) + 1, starts + sizes)
    kind = _ONE[b]
    pairs = b[:-1].astype(np.uint16)
    pairs <<= 8
    pairs |= b[1:]
    pairs = _TWO[pairs]
    marks = np.flatnonzero(pairs)
    flags, triple = pairs[marks], pairs[marks] == MORE
    third = marks[triple]
    third = third[third + 2 < n]
    codes = (b[third].astype(np.int32) << 16) + (b[third + 1].astype(np.int32) << 8) + b[np.minimum(third + 2, n - 1)]
    known, back = np.unique(codes, return_inverse=True)
    third_flags = np.array([_THREE.get(int(c), OTHER) for c in known], dtype=np.uint8)[back] if len(codes) else codes.astype(np.uint8)
    marks, flags = marks[~triple], flags[~triple]
    for i in (0, 1):
        kind[marks + i] = flags
    for i in (0, 1, 2):
        kind[third + i] = third_flags
    quotes = np.concatenate([np.flatnonzero(b == 34), marks[flags & QUOTE > 0], third[third_flags & QUOTE > 0]])
    hidden = _headings(b, lines, {0, *breaks.tolist()})
    if len(quotes):
        hidden += _quotations(b, np.sort(quotes), breaks, kind == 0)
    for i, j in hidden:
        kind[i:j] = OTHER
    hyphens = lines[(lines > 0) & (lines + 1 < n)]
    for mark in ("-", "¬", "‐", "\xad"):
        raw = mark.encode()
        at = hyphens[hyphens > len(raw)]
        for i, c in enumerate(reversed(raw), 1):
            at = at[b[at - i] == c]
        at = at[(kind[at - len(raw) - 1] == 0) & (kind[at + 1] == 0)]
        for i in range(len(raw) + 1):
            kind[at - i] = DROP
    run = (kind & (END | CLOSE)) > 0
    edge = np.flatnonzero(run[1:] != run[:-1]) + 1
    edge = np.concatenate([[0] if run[0] else [], edge, [n] if run[-1] else []]).astype(np.int64) if n else edge
    run_from, run_to = edge[::2], edge[1::2]
    ends = run_to[:0]
    if len(run_from):
        follow = b[np.minimum(run_to, n - 1)]
        run_from, run_to = (x[(run_to >= n) | _SPACE[follow]] for x in (run_from, run_to))
        stops = np.zeros(len(run_from), dtype=bool)
        wide = run_to - run_from
        for i in range(int(wide.max(initial=0))):  # marks in a row are few
            here = wide > i
            stops[here] |= (kind[run_from[here] + i] & END) > 0
        ends = run_to[stops]
    cuts = np.union1d(ends, breaks)
    cuts = cuts[(cuts > 0) & (cuts <= n)]
    start = np.concatenate([[0], cuts[:-1]]).astype(np.int64)
    doc = np.searchsorted(starts, start, side="right") - 1
    letter = kind == 0
    before = letter
    drops = np.flatnonzero(kind == DROP)
    if len(drops):  # what vanishes passes on what stands before it
        before = letter.copy()
        new = np.append(True, np.diff(drops) > 1)
        heads = drops[new]
        before[drops] = np.where(heads > 0, letter[heads - 1], False)[np.cumsum(new) - 1]
    stay = letter.copy()
    stay[1:] |= before[:-1]
    stay[drops] = False
    values = np.where(letter, _LOWER[b], np.uint8(32))[stay]
    up = np.flatnonzero(values[:-1] == 0xC3)
    values[up + 1] += np.where((values[up + 1] >= 0x80) & (values[up + 1] <= 0x9E) & (values[up + 1] != 0x97), np.uint8(32), np.uint8(0))
    length = np.add.reduceat(stay, start, dtype=np.int64) if len(start) else start
    first = np.cumsum(length) - length
    some = np.flatnonzero(np.logical_or.reduceat(~_SPACE[b], start)) if len(start) else start  # pieces that are not blank
    doc, start, stop = doc[some], start[some], cuts[some]
    return Sentences(doc, start - starts[doc], np.minimum(stop - starts[doc], sizes[doc] - 2), np.isin(stop, ends), values, first[some], length[some])


def probabilities(net: BiGRU, s: Sentences) -> np.ndarray:
    """Probability of each language for each sentence: the product over its bytes, of which several count as one."""
    rows = np.maximum(1, -(-s.length // ROW_BYTES))
    own = np.repeat(np.arange(len(rows)), rows)
    part = np.arange(len(own)) - np.repeat(np.cumsum(rows) - rows, rows)
    first = s.first[own] + part * ROW_BYTES
    sums = net.pooled(s.values, first, np.minimum(s.length[own] - part * ROW_BYTES, ROW_BYTES))
    if len(sums):
        sums = np.add.reduceat(sums, np.cumsum(rows) - rows, axis=0)
    p = np.exp((sums - sums.max(axis=1, keepdims=True, initial=-np.inf)) / BYTES_PER_OBSERVATION)
    return p / p.sum(axis=1, keepdims=True)


def fit_network(docs: DataFrame, text: str, lang: str, words: DataFrame | None, seed: int = 5) -> BiGRU:
    """Train the network on sentences of labelled documents and, if given, on a word list (word, lang).

    Every byte of a sentence has the language its document is labelled with. Labels are wrong in places, so the network
    first learns from a sample in which every language has its natural share, where a wrong label is outnumbered by right
    ones of like texts. It then judges sentences of at most about TRAIN_DOCS documents of each language, and goes on with
    those it gives to the language they are labelled with. Documents are taken by a hash; TRAIN_LISTED sequences of listed
    words of each language take part in both.
    """
    rng = np.random.default_rng(seed)
    label = docs.select(F.col(text).alias("t"), label_language(lang).alias("l")).filter(F.col("l").isin(*LANGS) & F.col("t").isNotNull())
    many = {r.l: r.n for r in label.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}  # eight rows
    share = lambda most, n: hashed_share(["t"], most / n) if n > most else F.lit(True)
    every, of_language = share(FIRST_DOCS, sum(many.values())) if many else F.lit(False), F.lit(False)
    for k, n in many.items():
        of_language = F.when(F.col("l") == k, share(TRAIN_DOCS, n)).otherwise(of_language)
    sample = label.withColumns({"every": every, "own": of_language}).filter("every OR own").groupBy("l", F.xxhash64("t").alias("h"), "every", "own").agg(F.first("t").alias("t"))
    sample = sample.toPandas().sort_values(["l", "h"], ignore_index=True)
    s = sentences([t.encode("utf-8", "replace") for t in sample["t"]])
    y = np.array([LANGS.index(k) for k in sample["l"]], dtype=np.int64)[s.doc]
    every, own = (sample[c].to_numpy(bool)[s.doc] & (s.length >= 12) for c in ("every", "own"))
    mixed = rng.permutation(np.flatnonzero(every))[:FIRST_SENTENCES]
    even = [rng.permutation(np.flatnonzero(own & (y == k)))[:TRAIN_SENTENCES] for k in range(len(LANGS))]
    part = lambda s, at: [s.values[i : i + min(n, ROW_BYTES)] for i, n in zip(s.first[at], s.length[at])]
    listed, listed_y = [], []
    if words is not None:
        known = words.filter(F.col("word").isNotNull() & F.col("lang").isin(*LANGS)).select("lang", "word").distinct()
        known = known.filter(hashed_share(["word"], min(1.0, 200_000 / max(1, known.count())))).toPandas().sort_values(["lang", "word"])
        for k, group in known.groupby("lang"):
            w = group["word"].to_numpy()
            made = sentences([" ".join(rng.choice(w, int(rng.integers(1, 12)))).encode() for _ in range(min(TRAIN_LISTED, 8 * len(w)))])
            some = np.flatnonzero(made.length > 0)
            listed += part(made, some)
            listed_y += [LANGS.index(k)] * len(some)
    net = BiGRU(len(LANGS), seed=seed)

    def train(at: np.ndarray, epochs: int, rate: float, end: float) -> None:
        rows = part(s, at) + listed
        if rows:
            length = np.array([len(v) for v in rows])
            net.train(np.concatenate(rows), np.cumsum(length) - length, length, np.concatenate([y[at], listed_y]).astype(np.int64), epochs, rate=rate, end=end)

    train(mixed, EPOCHS[0], RATE, 0.5)
    even = np.concatenate(even)
    judged = Sentences(s.doc[even], s.start[even], s.end[even], s.whole[even], s.values, s.first[even], s.length[even])
    right = probabilities(net, judged)[np.arange(len(even)), y[even]] >= 0.5
    train(even[right], EPOCHS[1], RATE / 2, 0.05)
    return net


_SEGMENT = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])


def label_texts(net: BiGRU, texts: list[bytes]) -> list[pa.Array]:
    """langs, lang, confidence and segments of texts, as label_documents() gives them."""
    names = pa.array(LANGS)
    s = sentences(texts)
    p = probabilities(net, s)
    best, n = p.argmax(axis=1), len(texts)
    conf = p[np.arange(len(p)), best]
    sure = (conf >= LEAST_CONFIDENCE) & (s.length > 0)
    votes = np.zeros((n, len(LANGS)))
    np.add.at(votes, (s.doc, best), conf * s.length)
    total, top = votes.sum(axis=1), votes.argmax(axis=1)
    there = np.zeros((n, len(LANGS)), dtype=bool)
    counts = sure & s.whole
    there[s.doc[counts], best[counts]] = True
    none = (total > 0) & ~there.any(axis=1)
    there[none, top[none]] = True
    # a sentence that is not sure takes the language before it, at a text's start that of its first sure one
    before = np.maximum.accumulate(np.where(sure, np.arange(len(best)), -1)) if len(best) else best
    after = np.minimum.accumulate(np.where(sure, np.arange(len(best)), len(best))[::-1])[::-1] if len(best) else best
    same = lambda i: (i >= 0) & (i < len(best)) & (s.doc[np.clip(i, 0, len(best) - 1)] == s.doc)
    if len(best):
        best = np.where(same(before), best[np.maximum(before, 0)], np.where(same(after), best[np.minimum(after, len(best) - 1)], top[s.doc]))
    real = total[s.doc] > 0
    new = real & np.append(True, (np.diff(s.doc) != 0) | (np.diff(best) != 0))[: len(best)]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(best)) - 1
    while (wrong := ~real[last]).any():  # sentences of texts without letters belong to no segment
        last[wrong] -= 1
    weight = np.maximum(s.length, 1e-9)
    share = np.add.reduceat(conf * weight * real, at) / np.add.reduceat(weight * real, at) if len(at) else np.zeros(0)
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(b"".join(texts), dtype=np.uint8) & 0xC0) != 0x80)])
    base = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    place = lambda i, x: (chars[base[s.doc[i]] + x[i]] - chars[base[s.doc[i]]]).astype(np.int32)
    segments = pa.StructArray.from_arrays([pa.array(place(at, s.start)), pa.array(place(last, s.end)), names.take(pa.array(best[at])), pa.array(share, pa.float64())], fields=list(_SEGMENT))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(s.doc[at], minlength=n))]).astype(np.int32)
    which, lang = np.nonzero(there)
    lang_offsets = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=n))]).astype(np.int32)
    by_name = np.argsort(LANGS)
    rank = np.argsort(by_name)
    lang = lang[np.lexsort((rank[lang], which))]
    empty = total <= 0
    return [
        pa.ListArray.from_arrays(pa.array(lang_offsets), names.take(pa.array(lang))),
        pa.array(np.array(LANGS, dtype=object)[top], pa.string(), mask=empty),
        pa.array(votes[np.arange(n), top] / np.where(empty, 1, total), pa.float64(), mask=empty),
        pa.ListArray.from_arrays(pa.array(offsets), segments),
    ]


def label_documents(docs: DataFrame, doc_id: str, text: str, net: BiGRU) -> DataFrame:
    """(doc_id, langs, lang, confidence, segments) for every document.

    The network labels every byte of a sentence in the sentence's context; its bytes' probabilities make the sentence's,
    its sentences' the document's. segments: runs of sentences of one language as (start, end, lang, confidence), in
    order, over the whole text. langs: the languages of which a whole sentence stands in the text, sorted. lang and
    confidence: the language of most of the text, and its share. A sentence of doubtful language takes the language before it.
    Null and blank texts, and texts without letters, have no segments, langs empty and lang null. Repeated rows are
    labelled alike. Whole texts are read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            sizes = np.cumsum([len(t) for t in texts])
            ends = [*np.searchsorted(sizes, np.arange(CHUNK_BYTES, sizes[-1], CHUNK_BYTES)).tolist(), len(texts)]
            done = 0
            for end in ends:
                if end > done:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, end - done), *label_texts(sent.value, texts[done:end])], names=["d", "langs", "lang", "confidence", "segments"])
                    done = end

    out = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInArrow(
        run, f"d {kind}, langs array<string>, lang string, confidence double, segments array<struct<start:int,end:int,lang:string,confidence:double>>"
    )
    return out.withColumnRenamed("d", doc_id)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = fit_network(docs, "text", "lang", table(spark, sf_dir, "word_list"))
    named = docs.select(F.struct("doc_id", label_language("lang").alias("label")).alias("doc"), "text")
    return label_documents(named, "doc", "text", net).select("doc.doc_id", "doc.label", "langs", "lang", "confidence", "segments")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).filter("size(langs) > 0")
    wrong = (F.size("langs") > 1) | ~F.coalesce(F.col("label") == F.element_at("langs", 1), F.lit(False))
    return rows.filter(wrong).select("doc_id", F.explode("langs").alias("lang"))


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's segments with language and confidence, beside the document's own."""
    rows = _labelled(spark, sf_dir).select("doc_id", F.col("lang").alias("doc_lang"), F.round("confidence", 4).alias("doc_confidence"), F.posexplode_outer("segments").alias("segment", "s"))
    return rows.select("doc_id", "doc_lang", "doc_confidence", "segment", F.col("s.start").alias("first"), F.col("s.end").alias("last"), "s.lang", F.round("s.confidence", 4).alias("confidence"))


QUERIES = {"p10_found": p10_found, "p10_segments": p10_segments}
SQL: dict[str, str] = {}
