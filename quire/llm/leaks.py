"""Evaluation texts inside training texts: Wu-Manber search for runs of words."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quire.session import table

#: Consecutive words that make a passage, and words of a block of the shift table.
WORDS, BLOCK = 12, 3
#: Words of items searched for in one pass (their tables take some 200 bytes a word in a task); more items make more passes.
PASS_WORDS = 1_000_000
_FORMAT = dict.fromkeys([*range(0x200B, 0x2010), *range(0x202A, 0x202F), 0x2060, 0xAD])
_BROKEN = re.compile(r"(?<=[^\W\d_])-\n(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits, after format characters and line-break hyphens are removed."""
    if not text:
        return []
    return _WORD.findall(_BROKEN.sub("", text.translate(_FORMAT)).lower())


class Patterns:
    """Tables for all runs of `words` words of the items, under the hashes of blocks of `block` words.

    shift: for a block, how far the end of the window may move; blocks of no item move furthest. Two blocks of one
    hash keep the smaller shift, so nothing is passed over. buckets: for a block that ends runs, where they stand
    (item, first word). A run is settled by comparing its words, never by a hash.
    """

    def __init__(self, items: list[tuple[int, str | None]], words: int = WORDS, block: int = BLOCK):
        self.words, self.block = words, block
        self.ids = [item for item, _ in items]
        self.texts = [words_of(text) for _, text in items]
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, list[tuple[int, int]]] = {}
        for at, w in enumerate(self.texts):
            runs = len(w) - words + 1
            if runs <= 0:
                continue
            for start in range(len(w) - block + 1):
                # the block ends run number start + block - words, or lies before the end of later runs of the item
                key, last = hash(tuple(w[start : start + block])), start + block - words
                if last >= 0:
                    self.shift[key] = 0
                    self.buckets.setdefault(key, []).append((at, last))
                elif self.shift.get(key, words) > -last:
                    self.shift[key] = -last

    def search(self, w: list[str]) -> set[int]:
        """The items of which the words w contain a run."""
        found: set[int] = set()
        words, block, shift, buckets, texts = self.words, self.block, self.shift, self.buckets, self.texts
        far, at, n = words - block + 1, words, len(w)
        while at <= n:
            key = hash(tuple(w[at - block : at]))
            step = shift.get(key, far)
            if step:
                at += step
                continue
            run = w[at - words : at]
            found.update(self.ids[i] for i, start in buckets[key] if texts[i][start : start + words] == run)
            at += 1
        return found


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, words: int = WORDS) -> DataFrame:
    """(doc_id, item_id) for every document that contains at least `words` consecutive words of an item.

    Null, empty and short texts and items match nothing; a pair comes once for every row of the document, however
    often it holds the item. Ids may be of any type. Whole texts are searched. The items are collected in passes of
    about PASS_WORDS words and each pass searches all documents, so that what is sent to the tasks, and the tables
    made of it, never grow with the items.
    """
    kind, ikind = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    sized = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).filter("t IS NOT NULL AND i IS NOT NULL")
    total = sized.agg(F.sum(F.size(F.split("t", r"[\s\W]+")))).first()[0] or 0
    passes = max(1, -(-total // PASS_WORDS))
    arrow = [to_arrow_type(x.schema[c].dataType) for x, c in ((docs, doc_id), (items, item_id))]
    out = None
    for p in range(passes):
        part = [(r.i, r.t) for r in sized.filter(F.pmod(F.xxhash64("i"), F.lit(passes)) == p).toLocalIterator()]
        sent = docs.sparkSession.sparkContext.broadcast(part)

        def scan(batches, sent=sent):
            patterns = Patterns(sent.value, words)
            for batch in batches:
                ids, found = [], []
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for item in sorted(patterns.search(words_of(t))):
                        ids.append(d)
                        found.append(item)
                yield pa.RecordBatch.from_arrays([pa.array(ids, arrow[0]), pa.array(found, arrow[1])], names=["d", "i"])

        one = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).filter("t IS NOT NULL").mapInArrow(scan, f"d {kind}, i {ikind}")
        out = one if out is None else out.unionByName(one)
    return out.select(F.col("d").alias(doc_id), F.col("i").alias(item_id))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


QUERIES = {"p9_found": p9_found}


def _sql_words(text: str) -> str:
    clean = rf"regexp_replace({text}, '[\x{{200B}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{2060}}\x{{AD}}]', '', 'g')"
    return rf"regexp_extract_all(lower(regexp_replace({clean}, '(\p{{L}})-\n(\p{{L}})', '\1\2', 'g')), '[\p{{L}}\p{{N}}]+')"


SQL = {
    "p9_found": f"""
WITH d AS (SELECT doc_id, {_sql_words('text')} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_sql_words('text')} AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k : k + 11], ' '))) AS g FROM d WHERE len(w) >= 12),
ig AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k : k + 11], ' '))) AS g FROM i WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
