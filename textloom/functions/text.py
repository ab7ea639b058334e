"""Column expressions on whole documents: sentences, words, windows, metrics, audits. No shuffle, no Python worker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SENT, WORD = r"[^.!?\n]+[.!?]*", r"[\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*"
#: Phrases and words of the style sheet.
BANNED = ["game-changer", "revolutionary", "delve", "testament to", "unlock", "seamless", "in today's fast-paced digital era", "thrilled to announce"]
PREFERRED = ["architecture", "latency", "throughput", "async", "pipeline", "bottleneck", "telemetry", "benchmark", "trade-off"]
QUANTIFIERS = ["many", "several", "various", "numerous", "most", "some", "few", "countless"]
BE_FORMS = ["is", "are", "was", "were", "be", "been", "being", "am"]
EMOJI, HASHTAG, INVISIBLE, CONTRACTION = r"[\x{1F300}-\x{1FAFF}]", r"#[\p{L}\p{N}_]+", r"\p{Cf}", r"^.+['’](t|s|re|ve|ll|d|m)$"


#: Hashtags, and white space between them, at the very end.
HASHTAG_TAIL = r"(?:\s*#[\p{L}\p{N}_]+)+\s*$"


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value computed once: a column used inside a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Lower-cased word tokens in order."""
    return found(F.lower(text), WORD)


def sentences(text: Column) -> Column:
    """Trimmed non-empty sentences; a new line always ends one."""
    return F.filter(F.transform(found(text, SENT), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ttr(ws: Column) -> Column:
    return ratio(F.size(F.array_distinct(ws)), F.size(ws))


def start_diversity(sentence_words: Column) -> Column:
    """Distinct first words over sentences."""
    first = F.filter(F.transform(sentence_words, lambda w: F.get(w, F.lit(0))), lambda x: x.isNotNull())
    return ratio(F.size(F.array_distinct(first)), F.size(sentence_words))


def heuristic(sentence_words: Column) -> Column:
    """Uncalibrated heuristic of a window: repeated words and repeated starts; 0 without words."""
    score = F.lit(0.5) * (1 - ttr(F.flatten(sentence_words))) + F.lit(0.5) * (1 - start_diversity(sentence_words))
    return F.coalesce(score, F.lit(0.0))


def window_scores(sentence_words: Column, size: int = 3) -> Column:
    """A window starts at every sentence and holds up to `size`."""
    return let(sentence_words, lambda sw: F.transform(sw, lambda _, i: let(F.slice(sw, i + 1, size), heuristic)))


def sentence_scores(scores: Column, size: int = 3) -> Column:
    """Mean score of the windows that hold a sentence."""
    def means(sc: Column) -> Column:
        def mean(_: Column, i: Column) -> Column:
            first = F.greatest(i - (size - 1), F.lit(0))
            return F.aggregate(F.slice(sc, first + 1, i - first + 1), F.lit(0.0), lambda a, x: a + x) / (i - first + 1)

        return F.transform(sc, mean)

    return let(scores, means)


def gated_flags(scores: Column, n_words: Column, own: float = 0.65, gate: float = 0.65, short: int = 5) -> Column:
    """A short sentence stays flagged only beside a neighbour whose ungated score reaches the gate."""
    def flags(v: Column) -> Column:
        sc, n = v["sc"], v["n"]
        near = lambda i: F.greatest(F.coalesce(F.when(i > 0, F.get(sc, i - 1)), F.lit(0.0)), F.coalesce(F.get(sc, i + 1), F.lit(0.0)))
        return F.transform(sc, lambda s, i: (s >= own) & ((F.get(n, i) >= short) | (near(i) >= gate)))

    return let(F.struct(scores.alias("sc"), n_words.alias("n")), flags)


def flagged_word_pct(flagged: Column, total: Column) -> Column:
    return 100 * ratio(flagged, total)


def phrase_hits(ws: Column, phrase: str) -> Column:
    """Places where the phrase's tokens stand in a row."""
    tokens = phrase.split(" ")
    if len(tokens) == 1:
        return F.size(F.filter(ws, lambda w: w == phrase))
    want = F.array(*map(F.lit, tokens))
    return let(ws, lambda ws: F.size(F.filter(F.transform(ws, lambda w, i: (w == tokens[0]) & (F.slice(ws, i + 1, len(tokens)) == want)), lambda x: x)))


def hits(ws: Column, lexicon: list[str]) -> Column:
    out = F.lit(0)
    for p in lexicon:
        out = out + phrase_hits(ws, p)
    return out


def passive(ws: Column) -> Column:
    """A form of be, and a token ending in ed or en right after it."""
    return let(ws, lambda ws: F.exists(F.transform(ws, lambda w, i: w.isin(BE_FORMS) & F.coalesce(F.get(ws, i + 1).rlike("(ed|en)$"), F.lit(False))), lambda x: x))


def longest_paragraph(text: Column) -> Column:
    """Most lines in a row that aren't blank."""
    step = lambda a, line: F.when(F.trim(line) == "", F.struct(F.lit(0).alias("run"), a["most"].alias("most"))).otherwise(
        F.struct((a["run"] + 1).alias("run"), F.greatest(a["most"], a["run"] + 1).alias("most")))
    return F.aggregate(F.split(text, "\n"), F.struct(F.lit(0).alias("run"), F.lit(0).alias("most")), step, lambda a: a["most"])


def last_line(text: Column) -> Column:
    """Last line with more than hashtags; null if there is none."""
    return F.get(F.reverse(F.filter(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, HASHTAG, "")) != "")), F.lit(0))


def without_invisible(text: Column, allowed: str = "") -> Column:
    """The text without invisible characters (category Cf), but for the allowed ones."""
    kept = "".join(f"\\x{{{ord(c):x}}}" for c in allowed)
    return F.regexp_replace(text, rf"[\p{{Cf}}&&[^{kept}]]" if allowed else INVISIBLE, "")


def hashtags_at_end(text: Column) -> Column:
    """Hashtags that nothing but white space and other hashtags follows."""
    return F.size(found(F.regexp_extract(text, HASHTAG_TAIL, 0), HASHTAG))


def ansi(sentence: Column, flag: Column) -> Column:
    """A flagged sentence in cyan for terminals."""
    return F.when(flag, F.concat(F.lit("\x1b[36m"), sentence, F.lit("\x1b[0m"))).otherwise(sentence)


def marked(sentence: Column, flag: Column) -> Column:
    """A flagged sentence between << and >>."""
    return F.when(flag, F.concat(F.lit("<<"), sentence, F.lit(">>"))).otherwise(sentence)
