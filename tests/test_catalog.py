import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if pd.isna(x) else f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.execute(f"CREATE VIEW {t} AS FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, db, name):
    got = rows(QUERIES[name].run(spark, SF).toPandas())
    assert got and got == rows(db.execute(QUERIES[name].sql).df())


ODD = [(1, "One. Two words. Three words here.", "en"), (1, "One. Two words. Three words here.", "en"), (2, None, "en"), (3, "", None), (4, "...", "fr"), (None, "No id. No id.", "en"), (7, None, "de"), (8, "x\u200d#a #b #c", None)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with nulls, repeated rows and ids, empty texts, clashing further columns; and empty ones."""
    full, empty = (str(tmp_path_factory.mktemp(n)) for n in ("full", "empty"))
    rows = [(*r, "a", "b", 1.5, "c") for r in ODD]
    schema = "doc_id long, text string, lang string, source string, rid string, score double, n_words string"
    events = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    for folder, some in ((full, rows), (empty, [])):
        spark.createDataFrame(some, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], events).write.parquet(f"{folder}/events.parquet")
    return full, empty


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"reach_multiple"}))
def test_query_equals_its_sql_on_odd_rows(spark, odd, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM read_parquet('{odd[0]}/documents.parquet/*.parquet')")
    got, found = QUERIES[name].run(spark, odd[0]), con.execute(QUERIES[name].sql)
    names = [c[0] for c in found.description]
    plain = lambda rows: sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows)
    assert plain(map(tuple, got.select(names).collect())) == plain(found.fetchall()) and sorted(got.columns) == sorted(names)
    if name not in ("tone_profiles", "persona_sheet", "corpus_rollup"):
        assert QUERIES[name].run(spark, odd[1]).count() == 0


def test_detect_options(spark):
    from textloom.operators.detect import detect

    df = spark.createDataFrame([(1, "Aa bb. Aa bb. Aa bb cc dd ee.", "x"), (2, None, "y")], "doc_id long, text string, n_words string")
    got = {r.doc_id: r for r in detect(df, scorer=lambda ts: [1.0] * len(ts), style=T.ansi).collect()}
    assert got[1].flagged_words == got[1].n_words == 9 and got[1].highlighted.startswith("\x1b[36mAa bb.\x1b[0m ") and got[2].n_words == 0 and got[2].flagged_word_pct is None
    got = detect(df, mode="sentence", scorer=lambda ts: [float(len(t) > 10) for t in ts]).where("doc_id = 1").first()
    assert (got.n_words, got.flagged_words, got.highlighted) == (9, 5, "Aa bb. Aa bb. <<Aa bb cc dd ee.>>")
    with pytest.raises(ValueError):
        detect(df, mode="other")


def test_allowed_invisible_characters(spark):
    got = spark.createDataFrame([("a\u200db\u200bc\u00add",)], "t string").select(T.without_invisible(F.col("t"), "\u200d"), T.without_invisible(F.col("t"))).first()
    assert tuple(got) == ("a\u200dbcd", "abcd")


@pytest.mark.parametrize("name", ["emoji_limit", "contractions", "hashtag_count", "closer_question", "hashtags_at_end"])
def test_rules_have_both_outcomes(spark, name):
    assert {r.ok for r in QUERIES[name].run(spark, SF).select("ok").distinct().collect()} == {True, False}


@pytest.mark.parametrize(("scores", "n_words", "flags"), [
    ([0.9, 0.1, 0.1], [3, 9, 9], [False, False, False]),  # short and alone
    ([0.9, 0.7, 0.1], [3, 9, 9], [True, True, False]),  # short beside a hot neighbour
    ([0.1, 0.9, 0.1], [9, 9, 9], [False, True, False]),  # long and alone
    ([0.1, 0.1, 0.9], [9, 9, 2], [False, False, False]),  # last, short, alone
    ([], [], []),
])
def test_gate(spark, scores, n_words, flags):
    df = spark.createDataFrame([(scores, n_words)], "s array<double>, n array<int>")
    assert df.select(T.gated_flags(F.col("s"), F.col("n"))).first()[0] == flags


def test_index_without_words_is_null(spark):
    from textloom.streaming.score import flagged_words

    got = {r.doc_id: r for r in flagged_words(spark.createDataFrame([(1, ""), (2, "..."), (3, "So it is. So it is. So it is.")], "doc_id long, text string")).collect()}
    assert got[1].flagged_word_pct is None and got[2].flagged_word_pct is None and 0 <= got[3].flagged_word_pct <= 100


def test_stream_equals_batch(spark, tmp_path):
    from textloom.streaming.score import flagged_words

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stream = flagged_words(spark.readStream.schema(docs.schema).parquet(f"{SF}/documents.parquet*"))
    stream.writeStream.format("memory").queryName("flagged").trigger(availableNow=True).option("checkpointLocation", str(tmp_path)).start().awaitTermination()
    assert sorted(spark.table("flagged").collect()) == sorted(flagged_words(docs).collect())


def test_files(spark, tmp_path):
    from textloom.sources import files

    (tmp_path / "t.json").write_text('# a note\n{"plain": {"label": "Plain", "instructions": "Say it."}, "own": {"label": "Own", "instructions": "x"}}')
    (tmp_path / "p.md").write_text("# Sheet\n\n## Who\n- **Name:** N\n\n## How\n- **Emoji:** Rarely\ntext\n")
    tones = files.tone_profiles(spark, str(tmp_path / "t.json"))
    assert {r.tone for r in tones.collect()} == {"plain", "own"}
    (tmp_path / "q.md").write_text("no heading yet\n1. first\n## How\n2. second\n")
    got = {tuple(r) for r in files.persona(spark, str(tmp_path / "[pq].md")).select("section", "key", "value", "position").collect()}
    assert got == {("Who", "Name", "N", None), ("How", "Emoji", "Rarely", None), (None, None, "first", 1), ("How", None, "second", 2)}
    joined = files.with_tone(spark.createDataFrame([("own",), ("none",)], "tone string"), tones)
    assert {r.tone: r.label for r in joined.collect()} == {"own": "Own", "none": None}
    assert files.drafts(spark, str(tmp_path / "p.md")).count() == 1


def test_scorer(spark):
    from textloom.operators.scorer import scored

    got = scored(spark.createDataFrame([("a",), ("bbb",)], "text string"), lambda ts: [len(t) for t in ts], batch=1)
    assert {r.text: r.score for r in got.collect()} == {"a": 1.0, "bbb": 3.0}
