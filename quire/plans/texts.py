"""Text functions, word statistics and vector functions (T, X and V groups)."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window, functions as F

from quire.functions import hebrew as H, vectors as V
from quire.functions.text import normal_path, trimmed
from quire.operators import lexicon as L
from quire.session import cut, table as t

QUERIES, SQL = {}, {}
TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _sql_stripped(c: str) -> str:
    two = ", ".join(f"'{p}'" for p in H.TWO_LETTER_PREFIXES)
    one = ", ".join(f"'{p}'" for p in H.ONE_LETTER_PREFIXES)
    return f"list_transform(list_filter([{two}, {one}], lambda p: starts_with({c}, p) AND length({c}) > length(p) + 1), lambda p: substr({c}, length(p) + 1))"


_BASE = "translate({0}, 'ךםןףץ', 'כמנפצ')"


@query(r"SELECT word, lang, regexp_matches(word, '[\x{0590}-\x{05FF}]') AS hebrew FROM word_list")
def t1_is_hebrew(spark: SparkSession, d: str):
    return t(spark, d, "word_list").select("word", "lang", H.is_hebrew("word").alias("hebrew"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\p{Cf}', '', 'g'), '^[\p{P}\s]+', ''), '[\p{P}\s]+$', '') AS clean FROM documents")
def t2_clean(spark, d):
    return t(spark, d, "documents").select("doc_id", H.clean_word("text").alias("clean"))


@query("SELECT word, lang, strip_accents(word) AS plain FROM word_list WHERE lang IN ('en', 'de', 'fr', 'es', 'it', 'he')")
def t3_without_marks(spark, d):
    return t(spark, d, "word_list").filter(F.col("lang").isin("en", "de", "fr", "es", "it", "he")).select("word", "lang", H.without_marks("word").alias("plain"))


@query(r"SELECT doc_id, regexp_replace(text, '[\p{P}\p{S}]', '', 'g') AS plain FROM documents")
def t4_without_punctuation(spark, d):
    return t(spark, d, "documents").select("doc_id", H.without_punctuation("text").alias("plain"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(trim(text), '[\p{P}\p{S}]', '', 'g'), '\s+', ' ', 'g')) AS form FROM documents")
def t5_query_form(spark, d):
    return t(spark, d, "documents").select("doc_id", H.query_form("text").alias("form"))


@query(f"SELECT word, lang, {_BASE.format('word')} AS base FROM word_list")
def t6_base_letters(spark, d):
    return t(spark, d, "word_list").select("word", "lang", H.base_letters("word").alias("base"))


@query("SELECT p_partkey, regexp_replace(upper(p_name), '[^A-Z<>$]', '', 'g') AS can, translate(regexp_replace(upper(p_name), '[^A-Z<>$]', '', 'g'), 'AEIOU', '') AS con FROM part")
def t7_transliteration(spark, d):
    return t(spark, d, "part").select("p_partkey", H.transliteration("p_name").alias("can"), H.transliteration("p_name", vowels=False).alias("con"))


@query(f"SELECT word, lang, coalesce({_sql_stripped('word')}[1], word) AS rest FROM word_list")
def t8_strip_prefix(spark, d):
    return t(spark, d, "word_list").select("word", "lang", H.strip_prefix("word").alias("rest"))


_WORDS = r"w AS (SELECT doc_id AS doc, unnest(list_filter(regexp_extract_all(lower(text), '\p{L}+'), lambda x: length(x) > 1)) AS word FROM documents), f AS (SELECT word, count(*) AS tf, count(DISTINCT doc) AS docs FROM w GROUP BY word)"
_TOTAL = """ag AS (SELECT form, sum(tf) AS total FROM (SELECT DISTINCT word, tf, unnest([word] || list_transform(list_filter([{p}], lambda p: starts_with(word, p) AND length(word) > length(p)), lambda p: substr(word, length(p) + 1))) AS form FROM f) GROUP BY form)""".replace("{p}", ", ".join(f"'{p}'" for p in H.TWO_LETTER_PREFIXES + H.ONE_LETTER_PREFIXES))


def _words(spark, d):
    return L.words(t(spark, d, "documents"), "doc_id", "text")


@query(f"""
WITH {_WORDS}, {_TOTAL}, c AS (SELECT word, list_distinct([word]) || list_filter({_sql_stripped('word')}, lambda x: x <> word) AS forms FROM f),
e AS (SELECT word, unnest(range(0, len(forms))) AS i, unnest(forms) AS form FROM c), s AS (SELECT word, i, form, coalesce(total, 0) AS total FROM e LEFT JOIN ag USING (form)),
b AS (SELECT word, arg_max(form, total * 1000 - i) AS form, max(total) AS best, max(total) FILTER (i = 0) AS own FROM s GROUP BY word)
SELECT word, CASE WHEN own = 0 OR best >= own * 1.2::DOUBLE THEN form ELSE word END AS base FROM b""")
def t9_base_forms(spark, d):
    return L.base_forms(L.frequencies(_words(spark, d)))


@query()
def t10_check_words(spark, d):
    """Every word of the documents against the word list: exact, by base letters, or behind a known prefix."""
    return L.check_words(_words(spark, d), "word", t(spark, d, "word_list"))


@query("SELECT id, coalesce(TRY_CAST(nullif(regexp_extract(page_number, '([0-9]+)', 1), '') AS INT), 0) AS n FROM geniza_image_latents")
def t11_first_number(spark, d):
    from quire.operators.relational import page_number

    return t(spark, d, "geniza_image_latents").select("id", page_number().alias("n"))


@query(r"""
SELECT pos, regexp_replace(regexp_replace(trim(image_path), '/(\./)+', '/', 'g'), '/+', '/', 'g') AS path, regexp_extract(image_path, '([^/]*)$', 1) AS base, regexp_replace(regexp_extract(image_path, '([^/]*)$', 1), '\.[^.]*$', '') AS stem,
list_extract(string_split(regexp_replace(regexp_replace(trim(image_path), '/(\./)+', '/', 'g'), '/+', '/', 'g'), '/'), -3) AS third, split FROM split_labels""")
def t12_path_parts(spark, d):
    p = normal_path("image_path")
    base = F.regexp_extract("image_path", "([^/]*)$", 1)
    return t(spark, d, "split_labels").select("pos", p.alias("path"), base.alias("base"), F.regexp_replace(base, r"\.[^.]*$", "").alias("stem"), F.try_element_at(F.split(p, "/"), F.lit(-3)).alias("third"), "split")


@query(f"SELECT pos, image_path, CASE lower({TRIM.format('split')}) WHEN 'train' THEN 'stage1' WHEN 'val' THEN 'stage2' WHEN 'validation' THEN 'stage2' WHEN 'test' THEN 'final' END AS stage FROM split_labels")
def t13_alias_map(spark, d):
    names = F.create_map(*[F.lit(x) for x in ("train", "stage1", "val", "stage2", "validation", "stage2", "test", "final")])
    return t(spark, d, "split_labels").select("pos", "image_path", names[F.lower(trimmed("split"))].alias("stage"))


@query(r"SELECT p_partkey, substr(regexp_replace(regexp_replace(p_type || ' / ' || p_name, '[^A-Za-z0-9.\-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 30) AS name FROM part")
def t14_safe_name(spark, d):
    return t(spark, d, "part").select("p_partkey", H.safe_name(F.concat("p_type", F.lit(" / "), "p_name"), 30).alias("name"))


@query(f"""
SELECT manuscript_id, normalized_library, shelfmark_root, shelfmark_running_index AS idx, CASE WHEN {TRIM.format('normalized_library')} <> '' AND {TRIM.format('shelfmark_root')} <> '' THEN {TRIM.format('normalized_library')} || '||' || {TRIM.format('shelfmark_root')} END AS key,
CASE WHEN {TRIM.format('shelfmark_running_index')} <> '' THEN shelfmark_root || ' (' || shelfmark_running_index || ')' ELSE shelfmark_root END AS label FROM geniza_manuscript_shelfmark""")
def t15_composite_key(spark, d):
    lib, root = trimmed("normalized_library"), trimmed("shelfmark_root")
    key = F.when((lib != "") & (root != ""), F.concat_ws("||", lib, root))
    label = F.when(trimmed("shelfmark_running_index") != "", F.concat("shelfmark_root", F.lit(" ("), "shelfmark_running_index", F.lit(")"))).otherwise(F.col("shelfmark_root"))
    return t(spark, d, "geniza_manuscript_shelfmark").select("manuscript_id", "normalized_library", "shelfmark_root", F.col("shelfmark_running_index").alias("idx"), key.alias("key"), label.alias("label"))


@query("SELECT id, coalesce(nullif(CASE WHEN id % 3 = 0 THEN '' ELSE picture_id END, ''), regexp_extract(image_path, '([^/]*)$', 1)) AS name FROM geniza_image_latents")
def t17_display_name(spark, d):
    pic = F.when(F.col("id") % 3 == 0, "").otherwise(F.col("picture_id"))
    return t(spark, d, "geniza_image_latents").select("id", F.coalesce(F.nullif(pic, F.lit("")), F.regexp_extract("image_path", "([^/]*)$", 1)).alias("name"))


@query(r"SELECT line_id, regexp_matches(text, '^[^\p{L}\p{N}]+$') AS punctuation_only, text FROM alto_text_lines WHERE text <> ''")
def t18_only_punctuation(spark, d):
    return t(spark, d, "alto_text_lines").filter("text <> ''").select("line_id", H.only_punctuation("text").alias("punctuation_only"), "text")


@query("SELECT id, md5(image_path || '42') AS h FROM geniza_image_latents")
def t19_md5(spark, d):
    return t(spark, d, "geniza_image_latents").select("id", F.md5(F.concat("image_path", F.lit("42"))).alias("h"))


@query("""
WITH l AS (SELECT line_id, any_value(manuscript_id) AS m, any_value(coalesce(text, array_to_string(words, ' '))) AS t, any_value(CASE WHEN NOT isnan(confidence) THEN confidence END) AS c, any_value(page_number) AS p, any_value(line_idx) AS i FROM alto_text_lines GROUP BY line_id)
SELECT m, p, string_agg(t, chr(10) ORDER BY i, line_id) AS text, round(avg(c), 6) AS confidence FROM l WHERE length(t) >= 3 GROUP BY m, p""")
def t20_page_text(spark, d):
    l = t(spark, d, "alto_text_lines").dropDuplicates(["line_id"]).select("line_id", F.col("manuscript_id").alias("m"), F.col("page_number").alias("p"), "line_idx", F.coalesce("text", F.array_join("words", " ")).alias("t"), F.when(~F.isnan("confidence"), F.col("confidence")).alias("c")).filter(F.length("t") >= 3)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "line_id", "t"))), lambda x: x["t"]), "\n")
    return l.groupBy("m", "p").agg(text.alias("text"), F.round(F.avg("c"), 6).alias("confidence"))


@query(f"WITH {_WORDS} SELECT word, tf, docs FROM f")
def x1_frequencies(spark, d):
    return L.frequencies(_words(spark, d))


@query(f"WITH {_WORDS} SELECT DISTINCT word, doc FROM w")
def x2_inverted_index(spark, d):
    return L.inverted_index(_words(spark, d))


@query(f"WITH {_WORDS} SELECT word, round(ln(((SELECT count(*) FROM documents) + 1) / (docs + 1)) + 1, 6) AS idf FROM f")
def x3_idf(spark, d):
    n = t(spark, d, "documents").count()
    return L.inverse_document_frequency(L.frequencies(_words(spark, d)), n).select("word", F.round("idf", 6).alias("idf"))


@query(f"""
WITH {_WORDS}, n AS (SELECT count(*) AS n FROM documents), b AS (SELECT {_BASE.format('word')} AS form, count(DISTINCT doc) AS df FROM w GROUP BY 1)
SELECT f.word, round(ln((n.n + 1) / (f.docs + 1)) + 1, 6) AS surface, round(ln((n.n + 1) / (coalesce(b.df, 0) + 1)) + 1, 6) AS base FROM f CROSS JOIN n LEFT JOIN b ON {_BASE.format('f.word')} = b.form""")
def x4_idf_forms(spark, d):
    """IDF of a word's surface and of its base letters."""
    w, n = _words(spark, d), t(spark, d, "documents").count()
    idf = lambda c: F.round(F.log((F.lit(n) + 1) / (F.coalesce(c, F.lit(0)) + 1)) + 1, 6)
    b = w.groupBy(H.base_letters("word").alias("form")).agg(F.countDistinct("doc").alias("df"))
    return L.frequencies(w).withColumn("form", H.base_letters("word")).join(b, "form", "left").select("word", idf(F.col("docs")).alias("surface"), idf(F.col("df")).alias("base"))


@query(f"""
WITH {_WORDS}, idf AS (SELECT word, ln(((SELECT count(*) FROM documents) + 1) / (docs + 1)) + 1 AS v FROM f WHERE docs > 1), p AS (SELECT doc, word, count(*) AS n FROM w GROUP BY 1, 2),
x AS (SELECT doc, word, n, n / max(n) OVER (PARTITION BY doc) * coalesce(v, 1.0) AS x FROM p LEFT JOIN idf USING (word)) SELECT doc, word, n, round(x / max(x) OVER (PARTITION BY doc), 6) AS weight FROM x""")
def x5_tf_idf(spark, d):
    c, n = cut(L.counts(_words(spark, d)), "counts"), t(spark, d, "documents").count()
    idf = L.inverse_document_frequency(L.frequencies_of(c).filter("docs > 1"), n)
    return L.weights_of(c, ["doc"], idf).select("doc", "word", "n", F.round("weight", 6).alias("weight"))


@query(f"""
WITH {_WORDS}, b AS (SELECT doc, word, count(*) AS n FROM w GROUP BY 1, 2), t AS (SELECT doc, count(*) AS total FROM w GROUP BY 1), o AS (SELECT word, sum(n) AS df FROM b GROUP BY 1),
x AS (SELECT doc, word, n / max(n) OVER (PARTITION BY doc) * (ln(((SELECT count(*) FROM w) + 1) / (df + 1)) + 1) AS x FROM b JOIN o USING (word)) SELECT doc, word, round(x / max(x) OVER (PARTITION BY doc), 6) AS weight FROM x""")
def x6_batch_tf_idf(spark, d):
    """The older weights, whose document frequency counts occurrences in the batch."""
    w = _words(spark, d)
    total = w.count()
    idf = w.groupBy("word").agg((F.log((F.lit(total) + 1) / (F.count(F.lit(1)) + 1)) + 1).alias("idf"))
    return L.line_weights(w, ["doc"], idf).select("doc", "word", F.round("weight", 6).alias("weight"))


@query(f"""
WITH v AS (SELECT word, max(tf)::DOUBLE AS value FROM word_list WHERE tf IS NOT NULL GROUP BY word), {_WORDS.split(', f AS')[0]}, a AS (SELECT DISTINCT word FROM w),
c AS (SELECT word, list_filter([word, {_BASE.format('word')}] || {_sql_stripped(_BASE.format('word'))}, lambda x: x IS NOT NULL) AS forms FROM a), e AS (SELECT word, unnest(range(0, len(forms))) AS i, unnest(forms) AS form FROM c),
h AS (SELECT e.word, arg_min(v.value, i) AS value FROM e JOIN v ON e.form = v.word WHERE v.value > 0 GROUP BY e.word) SELECT a.word, h.value FROM a LEFT JOIN h USING (word)""")
def x7_lookup(spark, d):
    v = t(spark, d, "word_list").filter("tf IS NOT NULL").groupBy("word").agg(F.max("tf").cast("double").alias("value"))
    return L.lookup(_words(spark, d).select("word").distinct(), "word", v)


@query("SELECT vec_id, round(list_sum(list_transform(string_split(substr(t, 2, length(t) - 2), ','), lambda x: x::DOUBLE)), 5) AS total FROM (SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.6f', x::DOUBLE)), ',') || ']' AS t FROM embeddings)")
def v1_parse_vector(spark, d):
    """A vector written with six decimals and read again."""
    text = V.format_vector("embedding")
    return t(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(V.parse_vector(text), F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


_X = "x AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"


@query(f"WITH {_X} SELECT vec_id, round(x[1] / greatest(sqrt(list_inner_product(x, x)), 1e-12), 6) AS first, round(x[64] / greatest(sqrt(list_inner_product(x, x)), 1e-12), 6) AS last FROM x")
def v3_unit(spark, d):
    u = V.unit("embedding")
    return t(spark, d, "embeddings").select("vec_id", F.round(u[0], 6).alias("first"), F.round(u[63], 6).alias("last"))


@query(f"WITH {_X} SELECT a.vec_id, round(list_cosine_similarity(a.x, b.x), 6) AS cosine, round(1 - list_cosine_similarity(a.x, b.x), 6) AS drift FROM x a JOIN x b ON b.vec_id = a.vec_id + 1")
def v5_cosine(spark, d):
    """Each vector and the next: cosine, and drift."""
    e = t(spark, d, "embeddings").select("vec_id", "embedding")
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    return j.select("vec_id", F.round(V.cosine("embedding", "other"), 6).alias("cosine"), F.round(1 - V.cosine("embedding", "other"), 6).alias("drift"))


@query(f"""
WITH {_X}, p AS (SELECT a.vec_id, a.x AS a, CASE WHEN a.vec_id % 5 <> 0 THEN b.x END AS b FROM x a JOIN x b ON b.vec_id = a.vec_id + 1), s AS (SELECT vec_id, CASE WHEN b IS NULL THEN a ELSE list_transform(list_zip(a, b), lambda z: z[1] + z[2]) END AS v FROM p)
SELECT vec_id, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first FROM s""")
def v7_ensemble(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", "embedding")
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").withColumn("other", F.when(F.col("vec_id") % 5 != 0, F.col("other")))
    return j.select("vec_id", F.round(V.ensemble("embedding", "other")[0], 6).alias("first"))


@query(f"""
WITH {_X}, p AS (SELECT vec_id, list_transform(x[1:32], lambda y: y * sqrt(0.6::DOUBLE / 1.0)) || list_transform(x[33:64], lambda y: y * sqrt(0.4::DOUBLE / 1.0)) AS v FROM x)
SELECT vec_id, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first, round(v[64] / sqrt(list_inner_product(v, v)), 6) AS last FROM p""")
def v9_weighted_concat(spark, d):
    c = V.weighted_concat([(F.slice("embedding", 1, 32), 0.6), (F.slice("embedding", 33, 32), 0.4)])
    return t(spark, d, "embeddings").select("vec_id", c.alias("c")).select("vec_id", F.round(F.col("c")[0], 6).alias("first"), F.round(F.col("c")[63], 6).alias("last"))


@query()
def v10_pca(spark, d):
    """Eight principal components, centred, at unit length."""
    from quire.operators.reduction import pca

    return pca(t(spark, d, "embeddings"), "vec_id", "embedding", 8)


@query(f"""
WITH {_X} SELECT i, j, round(corr(x[i], x[j]), 6) AS r FROM x CROSS JOIN range(1, 9) a(i) CROSS JOIN range(1, 9) b(j) GROUP BY i, j""")
def v11_correlation(spark, d):
    from quire.operators.reduction import correlation

    return correlation(t(spark, d, "embeddings"), "embedding", 8).withColumn("r", F.round("r", 6))


@query("SELECT vec_id, round(e[1] / list_sum(e), 6) AS first FROM (SELECT vec_id, list_transform(embedding, lambda y: exp(y::DOUBLE / 0.5::DOUBLE)) AS e FROM embeddings)")
def v15_softmax(spark, d):
    return t(spark, d, "embeddings").select("vec_id", F.round(V.softmax("embedding", 0.5)[0], 6).alias("first"))


@query(f"""
WITH {_X}, p AS (SELECT vec_id, list_transform(x, lambda y: sqrt(abs(y) / list_sum(list_transform(x, lambda q: abs(q))))) AS v FROM x) SELECT vec_id, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first FROM p""")
def v18_root_sift(spark, d):
    return t(spark, d, "embeddings").select("vec_id", F.round(V.root_sift("embedding")[0], 6).alias("first"))


@query("SELECT word, lang, list_sum(list_transform(range(1, length(word) + 1), lambda i: i * unicode(substr(word, i, 1))))::BIGINT % 1000003 AS h FROM word_list")
def v23_text_hash(spark, d):
    h = F.aggregate(F.transform(F.split("word", ""), lambda x, i: (i + 1) * F.ascii(x).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x) % 1000003
    return t(spark, d, "word_list").select("word", "lang", h.alias("h"))
