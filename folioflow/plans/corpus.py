"""Queries over the corpus: tokens, languages, samples, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.common import table
from folioflow.functions import languages
from folioflow.functions.text import letters_key, masked, strip_markup, tokens
from folioflow.operators import catalog, measures, sampling
from folioflow.plans.register import Register

TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
query = Register()
QUERIES, ORACLE = query.queries, query.oracle


def _lang(df: DataFrame) -> DataFrame:
    return df.withColumn("lang", F.coalesce(F.lower(F.trim("lang")), F.lit("?")))


@query(f"SELECT coalesce(lower(trim(lang)), '?') AS lang, count(*) AS documents, coalesce(sum(len({TOKENS.format('text')})), 0)::BIGINT AS tokens FROM documents GROUP BY 1")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = F.coalesce(F.sum(F.when(F.col("text").isNotNull(), F.size(tokens(F.col("text")))).otherwise(0)), F.lit(0)).cast("long")
    return _lang(table(spark, sf, "documents")).groupBy("lang").agg(F.count("*").alias("documents"), n.alias("tokens"))


_GUESS_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(lower(trim(lang)), '?') AS lang, {TOKENS.format("coalesce(text, '')")} AS k FROM documents),
g AS (SELECT doc_id, lang, {languages.guess_sql('k')} AS guess FROM t)
"""


def _guesses(spark: SparkSession, sf: str) -> DataFrame:
    found = _lang(table(spark, sf, "documents")).select("doc_id", "lang", tokens(F.coalesce("text", F.lit(""))).alias("k"))
    return found.select("doc_id", "lang", languages.guess(F.col("k")).alias("guess"))


@query(_GUESS_SQL + "SELECT doc_id, guess FROM g")
def language_guess(spark: SparkSession, sf: str) -> DataFrame:
    return _guesses(spark, sf).select("doc_id", "guess")


@query(_GUESS_SQL + "SELECT lang, count(*) AS documents, count(*) FILTER (WHERE guess = lang) AS agreed, count(*) FILTER (WHERE guess = '?') AS unknown, round(count(*) FILTER (WHERE guess = lang) / count(*), 6) AS share FROM g GROUP BY lang")
def language_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    agreed = F.count_if(F.col("guess") == F.col("lang"))
    return _guesses(spark, sf).groupBy("lang").agg(
        F.count("*").alias("documents"), agreed.alias("agreed"), F.count_if(F.col("guess") == "?").alias("unknown"), F.round(agreed / F.count("*"), 6).alias("share")
    )


@query(f"""
WITH w AS (SELECT DISTINCT unnest({TOKENS.format('text')}) AS w FROM documents)
SELECT list_aggregate(list_sort(string_split(w, '')), 'string_agg', '') AS letters, count(*) AS words, min(w) AS first_word FROM w WHERE length(w) >= 4 GROUP BY 1 HAVING count(*) > 1
""")
def anagram_groups(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "documents").select(F.explode(tokens(F.col("text"))).alias("w")).distinct().filter(F.length("w") >= 4)
    return words.groupBy(letters_key(F.col("w")).alias("letters")).agg(F.count("*").alias("words"), F.min("w").alias("first_word")).filter("words > 1")


@query(f"""
SELECT doc_id, length(text) AS chars, len({TOKENS.format('text')}) AS tokens, len(regexp_extract_all(text, '[ąćęłńóśźżĄĆĘŁŃÓŚŹŻ]')) AS accented,
len(regexp_extract_all(text, '[^\\p{{L}}\\p{{N}}\\s.,;:()§/%"„”–-]')) AS odd, len(regexp_extract_all(text, '[0-9]+')) AS numbers FROM documents WHERE text IS NOT NULL
""")
def text_metrics(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("long")
    return table(spark, sf, "documents").filter("text is not null").select(
        "doc_id", F.length(t).cast("long").alias("chars"), F.size(tokens(t)).cast("long").alias("tokens"), count("[ąćęłńóśźżĄĆĘŁŃÓŚŹŻ]").alias("accented"),
        count(r'[^\p{L}\p{N}\s.,;:()§/%"„”–-]').alias("odd"), count("[0-9]+").alias("numbers"),
    )


@query(f"""
WITH t AS (SELECT unnest({TOKENS.format('text')}) AS token FROM documents),
k AS (SELECT DISTINCT unnest({TOKENS.format('text')}) AS token FROM act_lines WHERE mark = ''),
c AS (SELECT token, count(*) AS n FROM t GROUP BY 1)
SELECT c.token, n FROM c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.token = c.token) ORDER BY n DESC, token LIMIT 12
""")
def unknown_words_top(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent words that a dictionary (here the text-layer lines) lacks."""
    words = table(spark, sf, "documents").select(F.explode(tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    known = table(spark, sf, "act_lines").filter("mark = ''").select(F.explode(tokens(F.col("text"))).alias("token")).distinct()
    return words.join(known, "token", "left_anti").orderBy(F.desc("n"), "token").limit(12)


@query("""
WITH l AS (SELECT doc_id, trim(regexp_replace(regexp_replace(unnest(string_split(text, chr(10))), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')) AS line FROM documents)
SELECT line, count(DISTINCT doc_id) AS documents, count(*) AS n FROM l WHERE line <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3
""")
def repeated_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that return in several documents but for their numbers."""
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l")).select("doc_id", masked(F.col("l")).alias("line")).filter("line <> ''")
    per_doc = lines.groupBy("line", "doc_id").agg(F.count("*").alias("k"))
    return per_doc.groupBy("line").agg(F.count("*").alias("documents"), F.sum("k").alias("n")).filter("documents >= 3")


_SHAPE = """CASE WHEN regexp_matches(l, '^#{1,6} ') THEN 'h' || length(regexp_extract(l, '^(#+)', 1)) WHEN regexp_matches(l, '^§ ?[0-9]') THEN 'section' WHEN regexp_matches(l, '^Art[.] ?[0-9]') THEN 'article'
WHEN regexp_matches(l, '^ *[0-9]+[.)] ') THEN 'number' WHEN regexp_matches(l, '^ *[a-z][)] ') THEN 'letter' WHEN regexp_matches(l, '^ *[–-] ') THEN 'dash' WHEN regexp_matches(l, '^[*]') THEN 'emphasis' WHEN l = '' THEN 'blank' ELSE 'text' END"""


@query(f"WITH x AS (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) SELECT {_SHAPE} AS shape, count(*) AS n FROM x GROUP BY 1")
def line_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Lines by heading level or label class."""
    l = F.col("l")  # noqa: E741
    shape = (
        F.when(l.rlike("^#{1,6} "), F.concat(F.lit("h"), F.length(F.regexp_extract(l, "^(#+)", 1)).cast("string"))).when(l.rlike("^§ ?[0-9]"), "section")
        .when(l.rlike("^Art[.] ?[0-9]"), "article").when(l.rlike("^ *[0-9]+[.)] "), "number").when(l.rlike("^ *[a-z][)] "), "letter")
        .when(l.rlike("^ *[–-] "), "dash").when(l.rlike("^[*]"), "emphasis").when(l == "", "blank").otherwise("text")
    )
    return table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("l")).groupBy(shape.alias("shape")).agg(F.count("*").alias("n"))


@query(f"""
WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^---\\n(?:[^-]|-[^-]|--[^-])*\\n---\\n', '', 'g'), '(^|\\n)#{{1,6}} +', '\\1', 'g'), '(^|\\n)> ?', '\\1', 'g'), '\\[\\^[^\\]]*\\](?:: )?', '', 'g'), '\\*+', '', 'g') AS plain, text FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(plain) AS digest, len({TOKENS.format('plain')}) AS tokens, length(text) - length(plain) AS removed FROM s
""")
def markup_strip(spark: SparkSession, sf: str) -> DataFrame:
    plain = table(spark, sf, "documents").filter("text is not null").select("doc_id", "text", strip_markup(F.col("text")).alias("plain"))
    return plain.select("doc_id", F.md5("plain").alias("digest"), F.size(tokens(F.col("plain"))).cast("long").alias("tokens"), (F.length("text") - F.length("plain")).cast("long").alias("removed"))


@query("SELECT sha256(text) AS digest, count(*) AS n, count(DISTINCT source) AS sources, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def content_copies(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.digest_copies(table(spark, sf, "documents"), "text", F.countDistinct("source").alias("sources"), F.min("doc_id").alias("first_doc"))


@query("""
WITH d AS (SELECT coalesce(lower(trim(lang)), '?') AS lang, act_type, n_chars FROM documents)
SELECT lang, act_type, count(*) AS n, coalesce(sum(n_chars), 0)::BIGINT AS chars FROM d GROUP BY GROUPING SETS ((lang), (act_type), (lang, act_type), ())
""")
def grouping_totals(spark: SparkSession, sf: str) -> DataFrame:
    sets = [["lang"], ["act_type"], ["lang", "act_type"], []]
    docs = _lang(table(spark, sf, "documents"))
    return docs.groupingSets([[F.col(c) for c in s] for s in sets], "lang", "act_type").agg(F.count("*").alias("n"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))


@query("""
SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM subject_labels s WHERE s.doc_id = d.doc_id) ORDER BY md5('holdout|' || doc_id), doc_id LIMIT 100
""")
def holdout_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", 100, "holdout", table(spark, sf, "subject_labels"))


@query("""
WITH a AS (SELECT DISTINCT eli, act_year // 10 * 10 AS stratum FROM acts_meta WHERE act_year IS NOT NULL)
SELECT eli, stratum FROM a QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5('era|' || eli), eli) <= 5
""")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    acts = table(spark, sf, "acts_meta").filter("act_year is not null").select("eli", "act_year").distinct()
    decade = (F.floor(F.col("act_year") / 10) * 10).cast("int")
    return sampling.stratified(acts.select("eli", decade.alias("decade")).distinct(), "eli", F.col("decade"), 5, "era").select("eli", "stratum")


@query(r"""
WITH d AS (SELECT doc_id, eli, regexp_extract(eli, '^(?:.*/)?(DU|MP)/(\d{4})/(\d+)/?$', ['publisher', 'year', 'pos']) AS p FROM documents)
SELECT p.publisher AS publisher, count(*) AS n, count(DISTINCT p.year) AS years, max(CAST(p.pos AS INT)) AS last_pos FROM d WHERE regexp_matches(eli, '^(?:.*/)?(DU|MP)/(\d{4})/(\d+)/?$') GROUP BY 1
""")
def parsed_ids(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = catalog.parse_ids(table(spark, sf, "documents").select("doc_id", "eli"))
    return good.groupBy("publisher").agg(F.count("*").alias("n"), F.countDistinct("year").alias("years"), F.max("pos").alias("last_pos"))


@query("""
WITH p AS (SELECT DISTINCT eli, doc_id, sha256(trim(unnest(string_split(text, chr(10))))) AS h FROM documents WHERE eli IS NOT NULL AND text IS NOT NULL),
e AS (SELECT eli, min(doc_id) AS a, max(doc_id) AS b FROM documents WHERE eli IS NOT NULL AND text IS NOT NULL GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
x AS (SELECT e.eli, h FROM e JOIN p ON p.eli = e.eli AND p.doc_id = e.a), y AS (SELECT e.eli, h FROM e JOIN p ON p.eli = e.eli AND p.doc_id = e.b)
SELECT coalesce(x.eli, y.eli) AS eli, count(*) FILTER (WHERE y.h IS NULL) AS removed, count(*) FILTER (WHERE x.h IS NULL) AS added, count(*) FILTER (WHERE x.h = y.h) AS kept
FROM x FULL JOIN y ON x.eli = y.eli AND x.h = y.h GROUP BY 1
""")
def paragraph_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of the last text of each act against its first."""
    docs = table(spark, sf, "documents").filter("eli is not null and text is not null").select("eli", "doc_id", "text")
    ends = docs.groupBy("eli").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b")
    wanted = ends.select("eli", F.explode(F.array(F.struct(F.col("a").alias("doc_id"), F.lit(True).alias("old")), F.struct(F.col("b").alias("doc_id"), F.lit(False).alias("old")))).alias("x")).select("eli", "x.*")
    parts = docs.join(wanted, ["eli", "doc_id"]).select("eli", "old", F.explode(F.split("text", "\n")).alias("l")).select("eli", "old", F.sha2(F.trim("l"), 256).alias("h"))
    sides = parts.groupBy("eli", "h").agg(F.bool_or("old").alias("before"), F.bool_or(~F.col("old")).alias("after"))
    return sides.groupBy("eli").agg(F.count_if(F.expr("before and not after")).alias("removed"), F.count_if(F.expr("after and not before")).alias("added"), F.count_if(F.expr("before and after")).alias("kept"))


@query("""
WITH u AS (SELECT tree_id, unnest(regexp_extract_all(tree, '"num": ?"([0-9]+[a-z]?[¹²³⁴⁵⁶⁷⁸⁹⁰]*)"', 1)) AS num FROM act_trees),
f AS (SELECT tree_id, num, translate(num, '⁰¹²³⁴⁵⁶⁷⁸⁹', '0123456789') AS flat FROM u)
SELECT tree_id, flat, count(DISTINCT num) AS numbers FROM f GROUP BY 1, 2 HAVING count(DISTINCT num) > 1
""")
def flat_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Unit numbers of a record that are equal once raised digits are written as plain ones."""
    nums = table(spark, sf, "act_trees").select("tree_id", F.explode(F.regexp_extract_all("tree", F.lit('"num": ?"([0-9]+[a-z]?[¹²³⁴⁵⁶⁷⁸⁹⁰]*)"'), F.lit(1))).alias("num"))
    flat = nums.withColumn("flat", F.translate("num", "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789"))
    return flat.groupBy("tree_id", "flat").agg(F.countDistinct("num").alias("numbers")).filter("numbers > 1")


@query()
def bootstrap_length(spark: SparkSession, sf: str) -> DataFrame:
    return measures.bootstrap_median(table(spark, sf, "documents"), "n_chars", replicates=10_000, places=0)

