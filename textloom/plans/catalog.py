"""Registered queries: plan and DuckDB restatement of each, side by side.

Scores are uncalibrated heuristics of our own definition, no measure of who or what wrote a text. All plans but `unigram_ppl`,
`scored_windows` and `reach_multiple` are one scan and one projection: a row in, a row (or its sentences) out.

A null text counts as empty: no sentences, no words, shares null. Repeated rows and ids each have their own rows, null ids stay null;
`unigram_ppl` takes rows of one id for one document and gives null for null ids. An empty table gives no rows. Columns other than
those named are not read, so further ones can't clash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.detect import detect
from textloom.sources import files
from textloom.sources.files import spread


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: What the fixtures lack, put behind the texts of two residues of doc_id: {zw} is U+200B.
EXTRA = {
    0: "{zw}{zw} — “many” ‘some’ testament to delve latency pipeline don't 🚀🎉🔥\n\nWhy not?\n#one #two #three",
    1: " 🚀\n#a1 #b2 #c3 #d4 #e5",
}


def docs(spark: SparkSession, sf_dir: str, extra: bool) -> DataFrame:
    text = t = F.coalesce("text", F.lit(""))
    if extra:
        for k, s in EXTRA.items():
            t = F.when(F.pmod("doc_id", F.lit(7)) == k, F.concat(text, F.lit(s.replace("{zw}", "​")))).otherwise(t)
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")).select("doc_id", "lang", t.alias("text"))


def prelude(extra: bool) -> str:
    t = "coalesce(text, '')"
    if extra:
        lit = lambda s: " || ".join("decode(unhex('E2808B'))" if p == "{zw}" else quote(p) for p in s.replace("{zw}", "\0{zw}\0").split("\0") if p)
        t = "CASE " + " ".join(f"WHEN doc_id % 7 = {k} THEN coalesce(text, '') || {lit(s)}" for k, s in EXTRA.items()) + " ELSE coalesce(text, '') END"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, lang, {t} AS text FROM documents),
dw AS (SELECT *, regexp_extract_all(lower(text), {quote(T.WORD)}) AS ws FROM docs),
sa AS (SELECT rid, doc_id, lang, list_filter(list_transform(regexp_extract_all(text, {quote(T.SENT)}), lambda x: trim(x)), lambda x: length(x) > 0) AS ss FROM docs),
s AS (SELECT rid, doc_id, lang, generate_subscripts(ss, 1) - 1 AS i, unnest(ss) AS sent FROM sa),
w AS (SELECT *, regexp_extract_all(lower(sent), {quote(T.WORD)}) AS ws FROM s),
win AS (
    SELECT rid, doc_id, i, list(sent) OVER f AS sents, flatten(list(ws) OVER f) AS ws, list(ws[1]) OVER f AS firsts FROM w
    WINDOW f AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)
),
ws AS (
    SELECT rid, doc_id, i, CASE WHEN len(ws) = 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE * (1 - len(list_distinct(ws))::DOUBLE / len(ws))
        + 0.5::DOUBLE * (1 - len(list_distinct(list_filter(firsts, lambda x: x IS NOT NULL)))::DOUBLE / len(sents)) END AS score FROM win
),
sc AS (
    SELECT rid, doc_id, i, (CASE WHEN i >= 2 THEN lag(score, 2) OVER o + lag(score) OVER o + score WHEN i = 1 THEN lag(score) OVER o + score ELSE score END) / least(i + 1, 3) AS score
    FROM ws WINDOW o AS (PARTITION BY rid ORDER BY i)
),
near AS (
    SELECT sc.rid, sc.doc_id, sc.i, score, len(ws) AS n_words, sent, greatest(coalesce(lag(score) OVER o, 0), coalesce(lead(score) OVER o, 0)) AS beside
    FROM sc JOIN w USING (rid, i) WINDOW o AS (PARTITION BY sc.rid ORDER BY sc.i)
)"""


def by_doc(table: str) -> str:
    """All documents with their rows of a table."""
    return f"FROM docs LEFT JOIN (SELECT * EXCLUDE (doc_id) FROM {table}) {table} USING (rid) GROUP BY rid, docs.doc_id"


QUERIES: dict[str, Query] = {}


def per_doc(name: str, columns: Callable[[], dict[str, Column]], sql: str, extra: bool = False) -> None:
    """One row for each document. Columns are made in the session that runs them."""
    QUERIES[name] = Query(lambda spark, d: with_parts(docs(spark, d, extra)).select("doc_id", *[c.alias(n) for n, c in columns().items()]), f"{prelude(extra)}\nSELECT doc_id, {sql}")


def per_sentence(name: str, index: str, columns: Callable[[], dict[str, Column]], sql: str) -> None:
    """One row for each sentence, from arrays with an entry for each."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        made = columns()
        rows = with_parts(docs(spark, d, False)).select("doc_id", F.posexplode(F.arrays_zip(*[c.alias(n) for n, c in made.items()])).alias(index, "r"))
        return rows.select("doc_id", index, *[F.col("r").getField(n).alias(n) for n in made])

    QUERIES[name] = Query(run, f"{prelude(False)}\nSELECT doc_id, {sql}")


def with_parts(df: DataFrame) -> DataFrame:
    """ws: words; ss: sentences; sw: words of each; n: their numbers; wsc, sc: scores of windows and sentences.

    Each stands in a projection of its own, and what a query doesn't use is pruned.
    """
    df = df.withColumn("ws", T.words(F.col("text"))).withColumn("ss", T.sentences(F.col("text")))
    df = df.withColumn("sw", F.transform("ss", T.words)).withColumn("n", F.transform("sw", F.size))
    return df.withColumn("wsc", T.window_scores(F.col("sw"))).withColumn("sc", T.sentence_scores(F.col("wsc")))


total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y).cast("long")
OWN, LOW, SHORT = 0.65, 0.15, 5
SQL_GATED = lambda own, gate: f"(score >= {own} AND (n_words >= {SHORT} OR beside >= {gate}))"

_joined = lambda: T.let(F.col("ss"), lambda ss: F.transform(ss, lambda _, i: F.array_join(F.slice(ss, i + 1, 3), " ")))
_summed = lambda: T.let(F.col("n"), lambda n: F.transform(n, lambda _, i: total(F.slice(n, i + 1, 3))))
_gated = lambda own: T.gated_flags(F.col("sc"), F.col("n"), own, own, SHORT)
per_sentence("sentence_split", "sent_idx", lambda: {"sent": F.col("ss")}, "i::INT AS sent_idx, sent FROM s")
per_sentence("word_counts", "sent_idx", lambda: {"n_words": F.col("n")}, "i::INT AS sent_idx, len(ws)::INT AS n_words FROM w")
per_sentence("sliding_windows", "win_idx", lambda: {"text": _joined(), "n_words": _summed()}, "i::INT AS win_idx, array_to_string(sents, ' ') AS text, len(ws)::BIGINT AS n_words FROM win")
per_sentence("window_score", "win_idx", lambda: {"heuristic_score": F.transform("wsc", lambda x: F.round(x, 6))}, "i::INT AS win_idx, round(score, 6) AS heuristic_score FROM ws")
per_sentence("sentence_score", "sent_idx", lambda: {"heuristic_score": F.transform("sc", lambda x: F.round(x, 6))}, "i::INT AS sent_idx, round(score, 6) AS heuristic_score FROM sc")
per_sentence("sentence_flag", "sent_idx", lambda: {"flag": F.transform("sc", lambda x: x >= OWN)}, f"i::INT AS sent_idx, score >= {OWN} AS flag FROM sc")
for _name, _own in (("cluster_gate", OWN), ("cluster_gate_low", LOW)):
    per_sentence(_name, "sent_idx", lambda own=_own: {"flag": _gated(own)}, f"i::INT AS sent_idx, {SQL_GATED(_own, _own)} AS flag FROM near")
_flagged = lambda own: total(F.zip_with(_gated(own), "n", lambda f, n: F.when(f, n).otherwise(0)))
for _name, _own in (("flagged_word_index", OWN), ("flagged_word_index_low", LOW)):
    QUERIES[_name] = Query(
        lambda spark, d, own=_own: detect(docs(spark, d, False), own=own, gate=own).select("doc_id", "n_words", "flagged_words", F.round("flagged_word_pct", 4).alias("flagged_word_pct")),
        f"""{prelude(False)}
SELECT doc_id, coalesce(sum(n_words), 0)::BIGINT AS n_words, coalesce(sum(n_words) FILTER ({SQL_GATED(_own, _own)}), 0)::BIGINT AS flagged_words,
    round(100 * (coalesce(sum(n_words) FILTER ({SQL_GATED(_own, _own)}), 0)::DOUBLE / nullif(sum(n_words)::DOUBLE, 0)), 4) AS flagged_word_pct
{by_doc('near')}""")  # noqa: B023
per_doc("highlight", lambda: {"highlighted": F.array_join(F.zip_with("ss", _gated(LOW), lambda s, f: F.when(f, F.concat(F.lit("<<"), s, F.lit(">>"))).otherwise(s)), " ")},
        f"coalesce(string_agg(CASE WHEN {SQL_GATED(LOW, LOW)} THEN '<<' || sent || '>>' ELSE sent END, ' ' ORDER BY i), '') AS highlighted {by_doc('near')}")

_mean = lambda: T.ratio(total(F.col("n")), F.size("n"))
_var = lambda: T.let(_mean(), lambda m: F.aggregate("n", F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size("n"))
per_doc("burstiness_cv", lambda: {"burstiness_cv": F.when(F.size("n") > 0, F.round(F.try_divide(F.sqrt(_var()), _mean()), 6))},
        f"round(stddev_pop(len(ws)) / nullif(avg(len(ws)), 0), 6) AS burstiness_cv {by_doc('w')}")
per_doc("vocab_ttr", lambda: {"vocab_ttr": F.round(T.ttr(F.col("ws")), 6)}, "round(len(list_distinct(ws))::DOUBLE / nullif(len(ws), 0), 6) AS vocab_ttr FROM dw")
_be = ", ".join(map(quote, T.BE_FORMS))
per_doc("passive_share", lambda: {"passive_share": F.when(F.col("lang") == "en", F.round(T.ratio(F.size(F.filter("sw", T.passive)), F.size("sw")), 6))},
        f"""round(CASE WHEN any_value(docs.lang) = 'en' THEN (count(*) FILTER (len(list_filter(generate_series(1, len(ws) - 1), lambda k: ws[k] IN ({_be}) AND regexp_matches(ws[k + 1], '(ed|en)$'))) > 0))::DOUBLE
    / nullif(count(w.i), 0) END, 6) AS passive_share {by_doc('w')}""")
per_doc("start_diversity", lambda: {"start_diversity": F.round(T.start_diversity(F.col("sw")), 6)}, f"round(count(DISTINCT ws[1])::DOUBLE / nullif(count(w.i), 0), 6) AS start_diversity {by_doc('w')}")


def sql_hits(lexicon: list[str]) -> str:
    one = lambda p: f"len(list_filter(generate_series(1, len(ws)), lambda k: list_slice(ws, k, k + {len(p.split(' ')) - 1}) = [{', '.join(map(quote, p.split(' ')))}]))"
    return "(" + " + ".join(map(one, lexicon)) + ")"


per_cent = lambda c: F.round(100 * T.ratio(c, F.size("ws")), 6)
for _name, _lexicon, _column in (("phrase_density", T.BANNED, "banned_per_100"), ("quantifier_density", T.QUANTIFIERS, "quantifiers_per_100")):
    per_doc(_name, lambda lexicon=_lexicon, column=_column: {column: F.when(F.col("lang") == "en", per_cent(T.hits(F.col("ws"), lexicon)))},
            f"CASE WHEN lang = 'en' THEN round(100 * ({sql_hits(_lexicon)}::DOUBLE / nullif(len(ws), 0)), 6) END AS {_column} FROM dw", True)
count = lambda p: F.size(T.found(F.col("text"), p))
sql_count = lambda p: f"len(regexp_extract_all(text, {quote(p)}))::INT"
per_doc("cf_audit", lambda: {"n_invisible": count(T.INVISIBLE)}, f"{sql_count(T.INVISIBLE)} AS n_invisible FROM docs", True)
per_doc("cf_strip", lambda: {"text": F.col("text"), "stripped": F.regexp_replace("text", T.INVISIBLE, "")}, f"text, regexp_replace(text, {quote(T.INVISIBLE)}, '', 'g') AS stripped FROM docs", True)
per_doc("em_dash_audit", lambda: {"n_em_dashes": count("—"), "em_dashes_per_100": per_cent(count("—"))}, f"{sql_count('—')} AS n_em_dashes, round(100 * ({sql_count('—')}::DOUBLE / nullif(len(ws), 0)), 6) AS em_dashes_per_100 FROM dw", True)
per_doc("smart_punct_fold", lambda: {"n_smart": count("[“”‘’]"), "folded": F.translate("text", "“”‘’", "\"\"''")}, f"{sql_count('[“”‘’]')} AS n_smart, translate(text, '“”‘’', '\"\"''''') AS folded FROM docs", True)
_preferred = lambda: F.size(F.filter("ws", lambda x: x.isin(T.PREFERRED)))
_sql_preferred = f"len(list_filter(ws, lambda x: x IN ({', '.join(map(quote, T.PREFERRED))})))::INT"
per_doc("preferred_vocab", lambda: {"n_preferred": _preferred()}, f"{_sql_preferred} AS n_preferred FROM dw", True)
per_doc("banned_phrases", lambda: {f"n{k}": T.phrase_hits(F.col("ws"), p) for k, p in enumerate(T.BANNED)}, ", ".join(f"{sql_hits([p])}::INT AS n{k}" for k, p in enumerate(T.BANNED)) + " FROM dw", True)
per_doc("sentence_length", lambda: {"mean_words": F.round(_mean(), 6), "max_words": F.array_max("n")}, f"round(avg(len(ws)), 6) AS mean_words, max(len(ws))::INT AS max_words {by_doc('w')}")

#: Invisible characters that valid text needs: joiners of emoji and of Persian and Indic scripts.
JOINERS = "\u200c\u200d"
_SQL_JOINERS = "decode(unhex('E2808C')) || decode(unhex('E2808D'))"
per_doc("cf_strip_allowed", lambda: {"stripped": T.without_invisible(F.col("text"), JOINERS + "\u200b"), "stripped_all": T.without_invisible(F.col("text"))},
        f"array_to_string(list_filter(string_split(text, ''), lambda c: NOT regexp_matches(c, '\\p{{Cf}}') OR contains({_SQL_JOINERS} || decode(unhex('E2808B')), c)), '') AS stripped, regexp_replace(text, {quote(T.INVISIBLE)}, '', 'g') AS stripped_all FROM docs", True)
_ESC = "chr(27)"
per_doc("highlight_ansi", lambda: {"highlighted": F.array_join(F.zip_with("ss", _gated(LOW), T.ansi), " ")},
        f"coalesce(string_agg(CASE WHEN {SQL_GATED(LOW, LOW)} THEN {_ESC} || '[36m' || sent || {_ESC} || '[0m' ELSE sent END, ' ' ORDER BY i), '') AS highlighted {by_doc('near')}")

#: Style rules: columns of the measure and of the verdict, as Column and as SQL.
_SQL_LINES = "string_split(text, chr(10))"
_SQL_CLOSER = f"coalesce(suffix(trim(list_filter({_SQL_LINES}, lambda x: trim(regexp_replace(x, {quote(T.HASHTAG)}, '', 'g')) <> '')[-1]), '?'), false)"
_SQL_PARAGRAPH = f"coalesce(list_max(list_transform(string_split(array_to_string(list_transform({_SQL_LINES}, lambda x: CASE WHEN trim(x) = '' THEN '0' ELSE '1' END), ''), '0'), lambda x: length(x))), 0)"
_sql_contract = f"len(list_filter(ws, lambda x: regexp_matches(x, {quote(T.CONTRACTION)})))::INT"
MEASURES: dict[str, Callable[[], Column]] = {
    "emoji_limit": lambda: count(T.EMOJI),
    "contractions": lambda: F.size(F.filter("ws", lambda x: x.rlike(T.CONTRACTION))),
    "hook_length": lambda: F.length(F.get(F.split("text", "\n"), F.lit(0))),
    "paragraph_lines": lambda: T.longest_paragraph(F.col("text")),
    "word_length_band": lambda: F.size("ws"),
    "char_length_band": lambda: F.length("text"),
    "closer_question": lambda: T.last_line(F.col("text")),
    "hashtag_count": lambda: count(T.HASHTAG),
}
RULES: dict[str, tuple[str, Callable[[Column], Column], str, str]] = {
    "emoji_limit": ("n_emoji", lambda c: c <= 2, sql_count(T.EMOJI), f"{sql_count(T.EMOJI)} <= 2"),
    "contractions": ("n_contractions", lambda c: c > 0, _sql_contract, f"{_sql_contract} > 0"),
    "hook_length": ("hook_chars", lambda c: c < 130, f"length({_SQL_LINES}[1])::INT", f"length({_SQL_LINES}[1]) < 130"),
    "paragraph_lines": ("most_lines", lambda c: c <= 3, f"{_SQL_PARAGRAPH}::INT", f"{_SQL_PARAGRAPH} <= 3"),
    "word_length_band": ("n_words", lambda c: c.between(180, 230), "len(ws)::INT", "len(ws) BETWEEN 180 AND 230"),
    "char_length_band": ("n_characters", lambda c: c.between(1050, 1300), "length(text)::INT", "length(text) BETWEEN 1050 AND 1300"),
    "closer_question": ("last_line", lambda c: F.coalesce(F.trim(c).endswith("?"), F.lit(False)), f"list_filter({_SQL_LINES}, lambda x: trim(regexp_replace(x, {quote(T.HASHTAG)}, '', 'g')) <> '')[-1]", _SQL_CLOSER),
    "hashtag_count": ("n_hashtags", lambda c: c.between(3, 4), sql_count(T.HASHTAG), f"{sql_count(T.HASHTAG)} BETWEEN 3 AND 4"),
}
passes = lambda name: RULES[name][1](MEASURES[name]())
for _name, (_measure, _, _sc, _sok) in RULES.items():
    per_doc(_name, lambda name=_name, measure=_measure: {measure: MEASURES[name](), "ok": passes(name)}, f"{_sc} AS {_measure}, {_sok} AS ok FROM dw", True)
_SQL_ALL = {"preferred_vocab": f"{_sql_preferred} > 0", "banned_phrases": f"{sql_hits(T.BANNED)} = 0"} | {n: r[3] for n, r in RULES.items()}


def compliance() -> dict[str, Column]:
    """Every rule's verdict, both length bands at once, and how many rules hold."""
    every = {"preferred_vocab": _preferred() > 0, "banned_phrases": T.hits(F.col("ws"), T.BANNED) == 0} | {n: passes(n) for n in RULES}
    number = sum((c.cast("int") for c in every.values()), F.lit(0))
    return {f"{n}_ok": c for n, c in every.items()} | {"both_length_bands_ok": passes("word_length_band") & passes("char_length_band"), "n_pass": number}


per_doc("style_compliance", compliance,
        ", ".join(f"{s} AS {n}_ok" for n, s in _SQL_ALL.items()) + f", {RULES['word_length_band'][3]} AND {RULES['char_length_band'][3]} AS both_length_bands_ok, (" + " + ".join(f"({s})::INT" for s in _SQL_ALL.values()) + ")::INT AS n_pass FROM dw", True)


#: Words that more than one in so many (document, word) rows hold: there are no more than this of them, so they are broadcast.
MOST_WORDS = 50_000


def unigram_ppl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exp(-mean log probability) under add-one unigrams of the corpus. Words are counted per document first, which is what
    the shuffles move; frequent words, a bounded number, meet their counts by broadcast, so that none of them fills a task."""
    texts = docs(spark, sf_dir, False)
    per = texts.select("doc_id", F.explode(T.words(F.col("text"))).alias("word")).groupBy("word", "doc_id").agg(F.count("*").alias("n"))
    counts = per.groupBy("word").agg(F.sum("n").alias("c"), F.count("*").alias("d"))
    size = counts.agg(F.sum("c").alias("all"), F.count("*").alias("v"), F.sum("d").alias("rows"))
    logs = counts.crossJoin(F.broadcast(size)).select("word", F.log((F.col("c") + 1) / (F.col("all") + F.col("v"))).alias("lp"), (F.col("d") * MOST_WORDS > F.col("rows")).alias("frequent"))
    often = F.broadcast(logs.where("frequent").select("word", "lp"))
    met = per.join(often, "word", "left")
    rest = met.where("lp IS NULL").drop("lp").join(logs.where("NOT frequent").select("word", "lp"), "word")
    both = met.where("lp IS NOT NULL").unionByName(rest)
    ppl = both.groupBy("doc_id").agg(F.round(F.exp(-F.sum(F.col("n") * F.col("lp")) / F.sum("n")), 4).alias("unigram_ppl"))
    return texts.select("doc_id").join(ppl, "doc_id", "left")


QUERIES["unigram_ppl"] = Query(unigram_ppl, prelude(False) + """,
t AS (SELECT doc_id, unnest(ws) AS word FROM dw), c AS (SELECT word, count(*) AS c FROM t GROUP BY word), z AS (SELECT sum(c) AS n, count(*) AS v FROM c),
p AS (SELECT doc_id, round(exp(-avg(ln((c + 1) / (n + v)::DOUBLE))), 4) AS unigram_ppl FROM t JOIN c USING (word), z GROUP BY doc_id)
SELECT doc_id, unigram_ppl FROM docs LEFT JOIN p USING (doc_id)""")


per_doc("hashtags_at_end", lambda: {"n_at_end": T.hashtags_at_end(F.col("text")), "ok": T.hashtags_at_end(F.col("text")).between(3, 4) & (T.hashtags_at_end(F.col("text")) == count(T.HASHTAG))},
        f"""len(regexp_extract_all(regexp_extract(text, {quote(T.HASHTAG_TAIL)}, 0), {quote(T.HASHTAG)}))::INT AS n_at_end,
    len(regexp_extract_all(regexp_extract(text, {quote(T.HASHTAG_TAIL)}, 0), {quote(T.HASHTAG)})) BETWEEN 3 AND 4
    AND len(regexp_extract_all(regexp_extract(text, {quote(T.HASHTAG_TAIL)}, 0), {quote(T.HASHTAG)})) = len(regexp_extract_all(text, {quote(T.HASHTAG)})) AS ok FROM docs""", True)


def stand_in(texts: list[str]) -> list[float]:
    """A scorer for tests of the plug-in point: no measure of anything."""
    return [len(t) % 101 / 100 for t in texts]


QUERIES["scored_windows"] = Query(
    lambda spark, d: detect(docs(spark, d, False), scorer=stand_in, own=0.6, gate=0.6).select("doc_id", "n_words", "flagged_words"),
    prelude(False).replace("near AS (", """ps AS (SELECT rid, doc_id, i, (length(array_to_string(sents, ' ')) % 101)::DOUBLE / 100 AS score FROM win),
pc AS (
    SELECT rid, doc_id, i, (CASE WHEN i >= 2 THEN lag(score, 2) OVER o + lag(score) OVER o + score WHEN i = 1 THEN lag(score) OVER o + score ELSE score END) / least(i + 1, 3) AS score
    FROM ps WINDOW o AS (PARTITION BY rid ORDER BY i)
),
near AS (""").replace("FROM sc JOIN w USING (rid, i) WINDOW o AS (PARTITION BY sc.rid ORDER BY sc.i)", "FROM pc sc JOIN w USING (rid, i) WINDOW o AS (PARTITION BY sc.rid ORDER BY sc.i)")
    + f"""
SELECT doc_id, coalesce(sum(n_words), 0)::BIGINT AS n_words, coalesce(sum(n_words) FILTER ({SQL_GATED(0.6, 0.6)}), 0)::BIGINT AS flagged_words
{by_doc('near')}""")

#: Own samples of the two files that users fill in.
SAMPLE_TONES = """# A comment line
# and another one
{"plain": {"label": "Plain", "instructions": "Say it in short words."}, "warm": {"label": "Warm", "instructions": "Speak to one reader."}, "own": {"label": "Own tone", "instructions": "Any text # with a mark"}}"""
SAMPLE_PERSONA = """# Sheet

## Who you are
- **Name:** A. Writer
- **Role:** Keeps the tests green

## Topics
1. First topic
2. Second topic
3. Third topic
- **Words you like:** "stable", "plain"

## Limits
1. No promises
"""


def one_file(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([("sample", text)], "path string, text string")


_SQL_TONES = "tones AS (SELECT * FROM (VALUES ('plain', 'Plain', 'Say it in short words.'), ('warm', 'Warm', 'Speak to one reader.'), ('own', 'Own tone', 'Any text # with a mark')) v(tone, label, instructions))"
QUERIES["tone_profiles"] = Query(lambda spark, d: files.tones_of(one_file(spark, SAMPLE_TONES)).select("tone", "label", "instructions"), f"WITH {_SQL_TONES} SELECT tone, label, instructions FROM tones")
_tone = lambda: F.when(F.col("lang") == "en", "plain").when(F.col("lang") == "fr", "warm").otherwise(F.lit("unknown"))
QUERIES["tone_join"] = Query(
    lambda spark, d: files.with_tone(docs(spark, d, False).select("doc_id", _tone().alias("tone")), files.tones_of(one_file(spark, SAMPLE_TONES)).drop("path")).select("doc_id", "tone", "label", "instructions"),
    f"WITH {_SQL_TONES}, d AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'plain' WHEN lang = 'fr' THEN 'warm' ELSE 'unknown' END AS tone FROM documents) SELECT doc_id, d.tone, label, instructions FROM d LEFT JOIN tones ON d.tone = tones.tone")
QUERIES["persona_sheet"] = Query(
    lambda spark, d: files.persona_of(one_file(spark, SAMPLE_PERSONA)).select("section", F.coalesce("key", F.lit("")).alias("key"), "value", F.coalesce("position", F.lit(0)).alias("position")),
    """SELECT * FROM (VALUES ('Who you are', 'Name', 'A. Writer', 0), ('Who you are', 'Role', 'Keeps the tests green', 0), ('Topics', '', 'First topic', 1), ('Topics', '', 'Second topic', 2),
    ('Topics', '', 'Third topic', 3), ('Topics', 'Words you like', '"stable", "plain"', 0), ('Limits', '', 'No promises', 1)) v("section", "key", "value", "position")""")
QUERIES["persona_join"] = Query(
    lambda spark, d: files.with_persona(docs(spark, d, False).select("doc_id"), files.persona_row(files.persona_of(one_file(spark, SAMPLE_PERSONA)))).select(
        "doc_id", F.col("persona.fields")["Name"].alias("name"), F.array_join(F.col("persona.lists")["Topics"], "; ").alias("topics"), F.size(F.col("persona.lists")["Limits"]).alias("n_limits"), F.array_join(F.col("persona.quoted"), ", ").alias("quoted")),
    "SELECT doc_id, 'A. Writer' AS name, 'First topic; Second topic; Third topic' AS topics, 1 AS n_limits, 'stable, plain' AS quoted FROM documents")


def reach_multiple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A post's value over the mean of its author's 20 posts before; `events` stands in for posts, users for authors."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    before = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-20, -1)
    return events.select("event_id", "user_id", F.round(F.try_divide("value", F.avg("value").over(before)), 4).alias("reach_multiple"))


QUERIES["reach_multiple"] = Query(reach_multiple, """
SELECT event_id, user_id, round(value / nullif(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0), 4) AS reach_multiple FROM events""")


def corpus_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extra of ours: documents and words by language and source, with subtotals."""
    rows = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text")).select("lang", "source", F.size(T.words(F.coalesce("text", F.lit("")))).alias("n"))
    return rows.rollup("lang", "source").agg(F.count("*").alias("n_docs"), F.sum("n").cast("long").alias("n_words"))


QUERIES["corpus_rollup"] = Query(corpus_rollup, f"""
SELECT lang, source, count(*) AS n_docs, sum(len(regexp_extract_all(lower(coalesce(text, '')), {quote(T.WORD)})))::BIGINT AS n_words FROM documents GROUP BY ROLLUP (lang, source)""")
