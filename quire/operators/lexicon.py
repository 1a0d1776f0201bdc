"""Word statistics: frequencies, inverted index, TF-IDF, lookups by word form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quire.functions.hebrew import ONE_LETTER_PREFIXES, TWO_LETTER_PREFIXES, base_letters, stripped_forms


def words(rows: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, place, word): runs of letters, lower case, of two letters or more."""
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(\p{L}+)"), F.lit(1))
    return rows.select(F.col(doc).alias("doc"), F.posexplode(found).alias("place", "word")).filter(F.length("word") > 1)


def counts(w: DataFrame) -> DataFrame:
    """(doc, word, n): how often a word stands in a document; the one shuffle of words that all the other figures start from."""
    return w.groupBy("doc", "word").agg(F.count(F.lit(1)).alias("n"))


def frequencies_of(c: DataFrame) -> DataFrame:
    """(word, tf, docs) from counts()."""
    return c.groupBy("word").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("docs"))


def frequencies(w: DataFrame) -> DataFrame:
    """(word, tf, docs): occurrences and documents of each word."""
    return frequencies_of(counts(w))


def inverted_index(w: DataFrame) -> DataFrame:
    """(word, doc): the postings as rows, so that a frequent word is no single value."""
    return w.select("word", "doc").distinct()


def inverse_document_frequency(f: DataFrame, documents: int) -> DataFrame:
    """(word, idf) = ln((N + 1) / (df + 1)) + 1."""
    return f.select("word", (F.log((F.lit(documents) + 1) / (F.col("docs") + 1)) + 1).alias("idf"))


def aggregated_tf(f: DataFrame) -> DataFrame:
    """(form, total): frequency of a form with and without every prefix: what counts for the form."""
    c = F.col("word")
    own = F.array(c)
    forms = F.array_distinct(F.concat(own, stripped_of_any(c)))
    return f.select(F.explode(forms).alias("form"), "tf").groupBy("form").agg(F.sum("tf").alias("total"))


def stripped_of_any(c):
    """Every form to which adding a known prefix gives the word."""
    cut = [F.when(c.startswith(p) & (F.length(c) > len(p)), F.substring(c, len(p) + 1, 1000)) for p in TWO_LETTER_PREFIXES + ONE_LETTER_PREFIXES]
    return F.filter(F.array(*cut), lambda x: x.isNotNull())


def base_forms(f: DataFrame, ratio: float = 1.2) -> DataFrame:
    """(word, base): the stripped form of the highest aggregated frequency, if it beats the word's own by `ratio`.

    Ties go to the form tried first; a word whose own forms do not occur may take any better form.
    """
    total = aggregated_tf(f)
    c = F.array_distinct(F.concat(F.array("word"), stripped_forms("word")))
    tried = f.select("word", F.posexplode(c).alias("i", "form")).join(total, "form", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    best = tried.groupBy("word").agg(F.max_by(F.struct("form", "total"), F.struct("total", -F.col("i"))).alias("b"), F.max(F.when(F.col("i") == 0, F.col("total"))).alias("own"))
    better = (F.col("own") == 0) | (F.col("b.total") >= F.col("own") * ratio)
    return best.select("word", F.when(better, F.col("b.form")).otherwise(F.col("word")).alias("base"))


def line_weights(w: DataFrame, line: list[str], idf: DataFrame) -> DataFrame:
    """Words with weight: count / highest count of the line, times idf (1 if missing), over the line's highest."""
    return weights_of(w.groupBy(*line, "word").agg(F.count(F.lit(1)).alias("n")), line, idf)


def weights_of(per: DataFrame, line: list[str], idf: DataFrame) -> DataFrame:
    """line_weights() from counted words (line, word, n)."""
    own = Window.partitionBy(*line)
    per = per.join(idf, "word", "left").withColumn("x", F.col("n") / F.max("n").over(own) * F.coalesce("idf", F.lit(1.0)))
    return per.withColumn("weight", F.col("x") / F.max("x").over(own)).select(*line, "word", "n", "weight")


def lookup(asked: DataFrame, word: str, values: DataFrame) -> DataFrame:
    """asked with value: of the exact form, else the base letters, else the first stripped form that has a positive value.

    values: (word, value).
    """
    forms = F.array_distinct(F.concat(F.array(F.col(word), base_letters(word)), stripped_forms(base_letters(word))))
    tried = asked.select(word).distinct().select(word, F.posexplode(forms).alias("i", "form"))
    hit = tried.join(values.select(F.col("word").alias("form"), "value"), "form").filter((F.col("value") > 0) & (F.col("value") < float("inf")))
    return asked.join(hit.groupBy(word).agg(F.min_by("value", "i").alias("value")), word, "left")


def check_words(asked: DataFrame, word: str, known: DataFrame) -> DataFrame:
    """(word, found, mode, prefix): exact, base letters, or a known prefix before a known rest; else not found.

    known: (word). Semi joins against the dictionary by each form, never a dictionary in every task.
    """
    k = known.select(F.explode(F.array_distinct(F.array("word", base_letters("word")))).alias("form")).distinct()
    a = asked.select(F.col(word).alias("word")).distinct()
    prefixes = TWO_LETTER_PREFIXES + ONE_LETTER_PREFIXES
    split = [F.struct(F.lit(i + 2).alias("i"), F.lit(p).alias("prefix"), F.substring("word", len(p) + 1, 1000).alias("form"), (F.col("word").startswith(p) & (F.length("word") > len(p))).alias("ok")) for i, p in enumerate(prefixes)]
    tried = a.select("word", F.explode(F.array(F.struct(F.lit(0).alias("i"), F.lit("").alias("prefix"), F.col("word").alias("form"), F.lit(True).alias("ok")), F.struct(F.lit(1).alias("i"), F.lit("").alias("prefix"), base_letters("word").alias("form"), F.lit(True).alias("ok")), *split)).alias("x")).select("word", "x.*").filter("ok")
    tried = tried.select("word", "i", "prefix", F.explode(F.array_distinct(F.array("form", base_letters("form")))).alias("form")).join(k, "form", "left_semi")
    heads = k.filter(F.col("form").isin(prefixes)).select(F.col("form").alias("prefix"))
    ok = tried.filter("prefix = ''").unionByName(tried.filter("prefix <> ''").join(heads, "prefix", "left_semi").select("form", "word", "i", "prefix"))
    best = ok.groupBy("word").agg(F.min(F.struct("i", "prefix")).alias("b"))
    mode = F.when(F.col("b.i") == 0, "exact").when(F.col("b.i") == 1, "base letters").when(F.col("b.i") > 1, "prefix split")
    return a.join(best, "word", "left").select("word", F.col("b").isNotNull().alias("found"), mode.alias("mode"), F.nullif(F.col("b.prefix"), F.lit("")).alias("prefix"))
