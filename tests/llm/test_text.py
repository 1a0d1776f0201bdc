"""Languages and OCR repair on small made texts."""

import random

import numpy as np
from pyspark.sql import functions as F

from quire.llm import editor as E, languages as L, ocr as O
from quire.llm.bigru import BiGRU
from quire.llm.perceptron import Perceptron


def test_bigru_gradient():
    m = BiGRU(3, 4, patch=2, width=3, bits=6)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    values, first, length = np.frombuffer(b"abcxyzwqabab", dtype=np.uint8), np.array([0, 3, 8]), np.array([5, 3, 2])
    slots, y = m.steps(m.codes(values), first, length), np.arange(3)
    g, _ = m.gradients(slots, length, y)
    for k in m.p:
        at = np.unravel_index(np.argmax(abs(g[k])), g[k].shape)
        m.p[k][at] += 1e-5
        a = m.gradients(slots, length, y)[1]
        m.p[k][at] -= 2e-5
        b = m.gradients(slots, length, y)[1]
        m.p[k][at] += 1e-5
        assert abs((a - b) / 2e-5 - g[k][at]) < 1e-6
    each, sums = m.label(values, first, length), m.pooled(values, first, length)
    for i, n in enumerate(length):  # the sums of scores give the product of the bytes' probabilities
        p = np.log(each[i, :n]).sum(axis=0)
        assert np.allclose(np.exp(p - p.max()) / np.exp(p - p.max()).sum(), np.exp(sums[i] - sums[i].max()) / np.exp(sums[i] - sums[i].max()).sum(), atol=1e-5)


EN = "the old copy still shows a long note about paper and ink while another hand adds some words near that line".split()
DE = "der alte bogen zeigt noch eine lange notiz über papier und tinte während andere hände einige wörter neben jener zeile".split()
HE = "הדף הישן עדיין מראה רשימה ארוכה על נייר ודיו וסופר אחר מוסיף כמה מילים ליד אותה שורה".split()


def sentence(r, words):
    return " ".join(r.choice(words) for _ in range(9)).capitalize() + "."


def test_languages(spark):
    r = random.Random(0)
    docs = []
    for i in range(120):
        lang, w = [("en", EN), ("de", DE), ("he", HE)][i % 3]
        docs.append((i, " ".join(sentence(r, w) for _ in range(4)), lang))
    docs[0] = (0, docs[0][1], "German")
    docs[1] = (1, docs[1][1], "de-AT ")
    docs[2] = (2, docs[2][1], None)
    docs[3] = (3, sentence(r, EN) + " " + sentence(r, DE) + "\n\n" + sentence(r, EN), "en")
    docs[6] = (6, sentence(r, EN)[:-1] + " (“" + sentence(r, DE) + " " + sentence(r, DE) + "”).", "EN")
    docs += [(200, None, "en"), (201, " \n", "en"), (202, "123 -- 4.", "en"), (203, docs[5][1] * 300, "iw"), (1, docs[1][1], "de-AT ")]
    words = [(w, k, 3) for k, ws in (("en", EN), ("de", DE), ("he", HE)) for w in ws] + [(None, "en", 1), ("x", None, 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    net = L.fit_network(df, "text", "lang", spark.createDataFrame(words, "word string, lang string, tf bigint"))
    out = {x.doc_id: x for x in L.label_documents(df, "doc_id", "text", net).collect()}
    assert out[3].langs == ["de", "en"] and [s.lang for s in out[3].segments] == ["en", "de", "en"]
    assert out[6].langs == ["en"] and out[203].langs == ["he"]
    assert all(out[i].langs == [] and out[i].lang is None for i in (200, 201, 202))
    good = [out[i].langs == [("en", "de", "he")[i % 3]] for i in range(120) if i not in (3, 6)]
    assert np.mean(good) > 0.97
    for x in out.values():
        if x.segments:
            text = next(d[1] for d in docs if d[0] == x.doc_id)
            assert all(a.end <= b.start for a, b in zip(x.segments, x.segments[1:])) and x.segments[-1].end <= len(text)
            assert all(0 <= s.confidence <= 1 for s in x.segments)
    labels = [x[0] for x in spark.createDataFrame([("en-GB",), ("Hebrew ",), ("iw",), ("nl",), ("und",), (" ",), ("??",), (None,), ("JRB",), ("fr_FR",)], "l string").select(L.label_language("l")).collect()]
    assert labels == ["en", "he", "he", "other", None, None, None, None, "jrb", "fr"]
    assert L.label_documents(df.limit(0), "doc_id", "text", net).count() == 0


def parts(text):
    s = L.sentences([text.encode()])
    return [(s.values[i : i + n].tobytes().decode().split(), w) for i, n, w in zip(s.first.tolist(), s.length.tolist(), s.whole.tolist()) if n]


def test_sentences():
    got = parts("Mark: AB-C1.2\nLines: 8\n\nOne two. Three “four. Five” six?\nShelf XY-Z3.4 holds it")
    assert got == [(["one", "two"], True), (["three", "six"], True), (["shelf", "xy", "z", "holds", "it"], False)]
    assert parts("A “" + "long quotation. " * 60 + "” b!") == [(["a", "b"], True)]  # of any length
    assert parts("A “ b. C\n\nd” e. F \"g h\" צה\"ל i.") == [(["a", "b"], True), (["c"], False), (["d", "e"], True), (["f", "צה", "ל", "i"], True)]
    assert parts("Ein Be-\ngriff, ÜBER\xad\nall… Ça «x. y» „z“ dît‎es (oui!). ٣ مرة؟ لا") == [(["ein", "begriff", "überall"], True), (["ça", "dîtes", "oui"], True), (["مرة"], True), (["لا"], False)]
    assert parts("") == [] and parts(" \n\n 12 - 4.") == []
    s = L.sentences([b"", b"One. Two", b" ", "é, é. Ü".encode()])
    assert s.doc.tolist() == [1, 1, 3, 3] and s.start.tolist() == [0, 4, 0, 7] and s.end.tolist() == [4, 8, 7, 10]


def test_perceptron():
    p = Perceptron()
    data = [([f"c{c}"], ["=", "x"], "x" if c in "ab" else "=") for c in "abcdefab" * 5]
    assert p.train(data, 4) == 1.0 and p.best(["ca"], ["=", "x"]) == "x" and p.best(["unseen"], ["=", "x"]) == "="


def test_numbers_and_titles():
    assert [O.number_in(t)[0] for t in ("- 157 -", "[l36]", ". 9", "p. 12", "cxlvi", "דף קפד", "1063.", "1234567", "red.", "")] == [157, 136, 9, 12, 146, 184, None, 1234567, None, None]
    keys = set(O.first_pass(3, ["THE OLD BOOK", "first line of text here", "12"]))
    assert "the old book" in keys and "#9" in keys and "~the _ book" in keys
    assert set(O.near_keys(O.title_keys("THE 0LD BOOK"))) & keys and not set(O.title_keys("THE 0LD BOOK")) & keys
    assert O.title_keys("Leaf 12 of the book") == []


def test_furniture_is_learned():
    r = random.Random(3)
    words = "river stone letter garden window silver winter paper corner little between another morning".split()
    page = lambda p: [f"The Book of Gardens {p + 40}" if p % 2 else f"{p + 40} The Book of Rivers", *[" ".join(r.choice(words) for _ in range(7)) for _ in range(9)], f"- {p + 40} -"]
    pages = {p: page(p) for p in range(1, 41)}
    counts = {}
    for p, lines in pages.items():
        for k in O.first_pass(p, lines):
            counts[k] = counts.get(k, 0) + 1
    own = lambda p, lines: {k for k in O.first_pass(p, lines) if counts.get(k, 0) >= 2}
    model = Perceptron()
    model.train([x for p, lines in pages.items() for x in O.furniture_examples(p, lines, own(p, lines), r)], 5)
    for p, lines in pages.items():
        assert O.furniture(p, lines, own(p, lines), model) == ["header", *["body"] * 9, "page_number"]
    lines = ["The Bock of Gardens 47", *pages[7][1:]]
    assert O.furniture(7, lines, own(7, lines), model)[0] == "header"
    assert O.furniture(1, [], set(), model) == []


WORDS = "the of and river stone letter garden window silver winter paper corner little between another morning evening mountain horse candle".split()


def made_editor():
    r = random.Random(1)
    known = {w: 200 + 13 * i for i, w in enumerate(WORDS)}
    read = {"e": "c", "n": "ii", "m": "rn", "i": "1", "l": "I".lower(), "o": "0", "a": "o"}
    unknown = {}
    for w in WORDS:
        for a, b in read.items():
            if a in w and a != b:
                x = w.replace(a, b, 1)
                if x not in known and len(w) > 3:
                    unknown[x] = (1 + len(x) % 2, False)
    unknown |= {n: (25, True) for n in ("tunwyska", "velquin", "skazem", "dorprinu")}
    pairs = [(w[:k], r.choice("-¬"), w[k:], (False, False), 5, True) for w in WORDS for k in range(2, len(w) - 1)] + [(a, "-", b, (False, False), 0, False) for a in WORDS for b in WORDS[::4]]
    return E.train(known, unknown, pairs)


def test_editor_generates_edits():
    editor = made_editor()
    assert all(editor.edit(w, 200)[0] == w for w in WORDS)
    for w, x in (("gardcn", "garden"), ("rnorning", "morning"), ("wiiidow", "window"), ("l0tter", "lotter"), ("c0rner", "corner"), ("stonc", "stone"), ("mouiitain", "mountain")):
        text, ops = editor.edit(w, 1)
        assert "".join(ops) == text
        if x in WORDS:
            assert text == x, (w, text)
    assert editor.edit("tunwyska", 25, True)[0] == "tunwyska" and editor.edit("zzzz", 3)[0] == "zzzz"
    assert editor.edit("12.")[0] == "12." and editor.edit("")[0] == ""
    long = "garden" * 12
    assert editor.edit(long, 1)[0] == long  # of any length
    assert editor.breaks("mor", "-", "ning", 3, (False, False))[0][1:4] == (True, "morning", tuple("morning"))
    assert editor.breaks("mo", "¬", "rniiig", 0, (False, False))[0][2] == "morning"
    assert not editor.breaks("river", "-", "and", 0, (False, False))[0][1]


def test_written_undoes_a_misreading():
    for w, x in (("notecl", "noted"), ("smoll", "small"), ("srnall", "small"), ("certam", "certain"), ("iiiner", "inner"), ("th", "the"), ("tthe", "the"), ("mcrning", "morning")):
        a, b, at = E.differing(w, x)
        assert "".join(E.written(w, a, b, at)) == x and E.one_place(w, x)


def test_broken_word_is_repaired():
    known = set("letter garden morning den".split())
    row = lambda q, text, ops, joined=None: {"q": q, "text": text, "ops": list(ops), "joined": joined, "there": True}
    rows = [row("mcr\n-ning\t", "morning", ["m", "o", *"rning"], True), row("gar\n-cn\t", "garden", ["g", "a", "rd", "e", "n"], True), row("gard\n-cn\t", "garden", [*"gard", "e", "n"], True)]
    trust = Perceptron()
    found, fixed, joins = O.examine(["letter mcr-", "ning, gard-"], [0.9, 0.9], ["body", "body"], None, "cn letter", O.Answers(O.Reader(known), rows), trust)
    assert fixed == ["letter mor-", "ning, gard-"] and joins == [True, True] and found == [{"hyphen_break", "misread"}, {"hyphen_break"}]
    assert O.paragraphs(fixed, ["body", "body"], joins, None) == [(0, False, "letter morning, gard", True)]
    after = O.examine(["cn letter"], [0.9], ["body"], "ning, gard-", None, O.Answers(O.Reader(known), rows), trust)
    assert after[1] == ["en letter"] and after[0] == [{"misread"}]
    rows.append(row("gar\n-den\t", "garden", "garden", True))
    assert O.examine(["gar-", "den-", "letter"], [0.9] * 3, ["body"] * 3, None, None, O.Answers(O.Reader(known), rows), trust)[1][2] == "letter"
    asked = O.page_questions(["dell'mor-", "ning's le-tter AB-C1.2"], ["body"] * 2, None, None, O.Reader(known))
    assert asked >= {"mor\n-ning\t"} and not any("ab-c" in q or q.startswith("letter") for q in asked)


def test_words_and_names_are_counted_over_all_lines(spark):
    rows = [(i, "river stone letter " + ("Zqxwvy" if i % 40 == 0 else "Zqcwvy" if i == 7 else "garden") + " window", 0.97) for i in range(2400)]
    df = spark.createDataFrame(rows, "line_id bigint, text string, confidence double")
    known = set("river stone letter garden window".split())
    counted = O.count_words(df, known)
    assert {x.w: (x.k, x.cased) for x in counted.collect() if x.w[0] == "z"} == {"zqxwvy": (60, True), "zqcwvy": (1, True)}
    like = O.like_names(counted.select("w", "k"), counted, spark.sparkContext.broadcast(known)).collect()
    assert [(x.w, [tuple(y) for y in x.names]) for x in like] == [("zqcwvy", [("zqxwvy", 60)])]


def volume(r):
    words = "river stone letter garden window silver winter paper corner little between another morning".split()
    rows, truth, n = [], set(), 0
    for page in range(1, 13):
        lines = ["A Book of Gardens"] + [" ".join(r.choice(words) for _ in range(7)) for _ in range(14)] + [f"- {page + 40} -"]
        for i, t in enumerate(lines):
            n += 1
            if i == 0:
                truth.add((n, "header"))
            if i == 15:
                truth.add((n, "page_number"))
            conf = 0.97
            if 2 <= i <= 12 and r.random() < 0.25:
                k = r.randrange(1, 6)
                w = t.split()
                w[k] = w[k].replace("e", "c", 1) if "e" in w[k] else w[k].replace("i", "1", 1) if "i" in w[k] else w[k]
                if w != t.split():
                    truth.add((n, "misread"))
                    conf = 0.8
                t = " ".join(w)
            if i == 5:
                t += " morn-"
                truth.add((n, "hyphen_break"))
            if i == 6:
                t = "ing " + t
            rows.append((n, " v1", f"P{page:04d}", i, t, None, conf))
    return rows, truth, words


def test_repair(spark):
    rows, truth, words = volume(random.Random(1))
    rows[20] = (*rows[20][:4], None, rows[20][4].split(), None)
    extra = [rows[3], (9001, "v2", None, None, None, [], None), (9002, None, "P1", 1, "", None, float("nan")), (9003, "v3", "P1", 1, None, None, 0.5), (None, "v3", "P1", 1, "x", None, 0.5)]
    schema = "line_id bigint, manuscript_id string, page_number string, line_idx int, text string, words array<string>, confidence double"
    df = spark.createDataFrame(rows + extra, schema).withColumns({"page": F.lit(1), "kinds": F.lit("x")}).repartition(3)
    wl = spark.createDataFrame([(w, 5) for w in words], "word string, tf bigint")
    out = O.repair(df, wl).cache()
    got = {(x.line_id, x.kind) for x in out.select(F.explode("found").alias("x")).select("x.*").collect()}
    assert {x for x in truth if x[1] != "misread"} <= got
    wrong = got ^ truth
    assert len(wrong) <= 3, wrong
    text = " ".join(p.text for x in out.filter("ms = 'v1'").collect() for p in x.paragraphs)
    assert "morning" in text and "A Book" not in text and " morn-" not in text
    assert O.repair(df.limit(0), wl.limit(0)).count() == 0


def test_paragraphs_over_pages(spark):
    rows, _, words = volume(random.Random(2))
    lines = {(r[2], r[3]): r[4] for r in rows}
    lines["P0003", 14], lines["P0004", 1] = "river stone letter garden window silver morn-", "ing river stone letter garden window silver"
    lines["P0006", 14], lines["P0008", 1] = "river stone letter garden window silver gard-", "en river stone letter garden window silver"
    lines["P0009", 7] = "stone letter."
    rows = [(*r[:4], lines[r[2], r[3]], *r[5:]) for r in rows if r[2] != "P0007" or r[3] in (0, 15)]  # a page without body lines
    df = spark.createDataFrame(rows, "line_id bigint, manuscript_id string, page_number string, line_idx int, text string, words array<string>, confidence double").repartition(3)
    wl = spark.createDataFrame([(w, 5) for w in words], "word string, tf bigint")
    got = O.continuous(O.repair(df, wl)).orderBy("paragraph").collect()
    assert [(r.paragraph, r.page_key, r.pages) for r in got] == [(0, "P0001", 8), (1, "P0009", 4)]
    assert "silver morning river" in got[0].text and "silver garden river" in got[0].text and got[0].text.endswith("stone letter.")


def test_volume_of_many_titles(spark):
    r = random.Random(4)
    words = "river stone letter garden window silver winter paper corner little between another morning".split()
    title = lambda c: f"{words[c % 13]} {words[c // 13 + 3]} and the {words[(5 * c + 2) % 13]}".upper()
    rows = [(p * 10 + i, "v1", f"P{p:04d}", i, title(p // 2) if i == 0 else " ".join(r.choice(words) for _ in range(7)), None, 0.97) for p in range(60) for i in range(5)]
    df = spark.createDataFrame(rows, "line_id bigint, manuscript_id string, page_number string, line_idx int, text string, words array<string>, confidence double")
    wl = spark.createDataFrame([(w, 5) for w in [*words, "and", "the"]], "word string, tf bigint")
    out = O.repair(df, wl).select(F.explode("found").alias("x")).filter("x.kind = 'header'").select("x.line_id").collect()
    assert {x.line_id for x in out} == {p * 10 for p in range(60)}
