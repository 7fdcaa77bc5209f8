"""Quality rules: a table of thresholds compiled into one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
GAPS = "\\x20\\x09-\\x0D"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
# fixed values: frequent function words of English, German, French and Spanish
STOP_WORDS = (
    "the of and to in a is that it for was on with as by at be this are from "
    "der die das und ist von zu den mit ein eine im nicht für auf des dem sich "
    "le la les de et un une du que est en pour dans qui sur par "
    "el los las y del se por con para al no lo su"
).split()
LISTED = ("en", "de", "fr", "es")  # languages whose stop words these are
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¿¡«»„“”‚‘’…–—"


@dataclass(frozen=True)
class Rule:
    """`measure` must lie within [least, most]; a null bound doesn't bind."""

    measure: str
    least: float | None = None
    most: float | None = None


#: Wide bounds: what they reject is junk by any of them, and prose in any of the four languages passes.
RULES = (
    Rule("mean_word_length", 2.0, 15.0),
    Rule("symbol_ratio", None, 0.2),
    Rule("capital_ratio", None, 0.5),
    Rule("stop_word_ratio", 0.02, None),
    Rule("duplicate_line_ratio", None, 0.5),
    Rule("same_as_previous_ratio", None, 0.3),
)


def _with_next(hashes: str, step: int) -> Column:
    """Each hash joined with that `step` places on; the last ones, which have none, are cut off later."""
    return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(F.col(hashes), i + step)))


def _gone(text: Column, characters: str) -> Column:
    """How many of these characters there are; a text without any isn't rebuilt."""
    left = F.length(F.regexp_replace(text, f"[{characters}]+", ""))
    return F.when(text.rlike(f"[{characters}]"), F.length(text) - left).otherwise(0)


def _text_counts(df: DataFrame, text: str, loose: bool) -> DataFrame:
    """Adds what is counted in the text, its words and its lines, and the hashes of the words. Stop words are found as
    they are written, or `loose` in any case and with marks around them."""
    kept = df.columns
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.btrim(t, F.lit(SPACE))
    df = df.select(
        *kept,
        F.when(F.length(bare) > 0, F.split(bare, f"[{GAPS}]+")).otherwise(F.array().cast("array<string>")).alias("__words"),
        F.filter(F.split(t, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0).alias("__lines"),
        _gone(t, SYMBOLS).cast("long").alias("__n_symbols"),
        _gone(t, "A-Z").alias("__capitals"),
    )
    return df.select(
        *kept,
        "__n_symbols",
        "__capitals",
        F.size("__words").cast("long").alias("__n_words"),
        F.length(F.concat_ws("", "__words")).cast("long").alias("__word_chars"),
        F.size(
            F.filter("__words", lambda w: (F.btrim(F.lower(w), F.lit(MARKS)) if loose else w).isin(STOP_WORDS))
        ).alias("__stops"),
        F.size("__lines").cast("long").alias("__n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("__n_dup_lines"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"),
    )


def _repeat_words(df: DataFrame) -> DataFrame:
    """Turns the hashes of the words into `__same`, how many words equal the one before them, and `__repeated`, how
    many are covered by windows that occur twice or more.

    A window's hash is made of those of its halves. Equal windows are neighbours when sorted with their positions;
    the covered words are the union of the runs that start there. Each step is a column of its own, since an
    expression inside a lambda would be evaluated for each element, and replaces the one before it.
    """
    kept = [c for c in df.columns if c != "__hashes"]
    as_before = F.filter("__hashes", lambda h, i: F.coalesce(F.get(F.col("__hashes"), i - 1) == h, F.lit(False)))
    df = df.select(*kept, F.size(as_before).alias("__same"), _with_next("__hashes", 1).alias("__run"))
    kept, step = [*kept, "__same"], 2
    while step < WINDOW:
        df, step = df.select(*kept, _with_next("__run", step).alias("__run")), 2 * step
    full = F.greatest(F.col("__n_words").cast("int") - (WINDOW - 1), F.lit(0))
    df = df.select(*kept, F.slice("__run", F.lit(1), full).alias("__windows"))
    w, pairs = F.col("__windows"), F.col("__pairs")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    sorted_pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.select(
        *kept, F.when(F.size(F.array_distinct(w)) < F.size(w), sorted_pairs).otherwise(none).alias("__pairs")
    )

    def twin(p: Column, k: Column) -> Column:
        return F.coalesce(F.get(pairs, k)["h"] == p["h"], F.lit(False))

    repeated = F.filter(pairs, lambda p, k: twin(p, k - 1) | twin(p, k + 1))
    covered = F.aggregate(
        F.sort_array(F.transform(repeated, lambda p: p["i"])),
        F.struct(F.lit(0).alias("total"), F.lit(-WINDOW).alias("last")),
        lambda a, x: F.struct((a["total"] + F.least(F.lit(WINDOW), x - a["last"])).alias("total"), x.alias("last")),
        lambda a: a["total"],
    )
    return df.select(*kept, covered.cast("long").alias("__repeated"))


def measures(df: DataFrame, text: str = "text", loose: bool = False) -> DataFrame:
    """`df` with counts and ratios of every whole text; a null text counts as empty, and ratios of nothing are 0.

    Columns of `df` under the names of the new ones are replaced; names that start with two underscores are reserved.
    """
    columns = df.columns
    df = _repeat_words(_text_counts(df, text, loose))
    words, chars = F.greatest(F.col("__n_words"), F.lit(1)), F.greatest(F.col("__word_chars"), F.lit(1))
    new = {
        "n_words": F.col("__n_words"),
        "word_chars": F.col("__word_chars"),
        "n_symbols": F.col("__n_symbols"),
        "n_dup_lines": F.col("__n_dup_lines"),
        "n_repeat_words": F.col("__repeated"),
        "mean_word_length": F.col("__word_chars") / words,
        "symbol_ratio": F.col("__n_symbols") / words,
        "capital_ratio": F.col("__capitals") / chars,
        "stop_word_ratio": F.col("__stops") / words,
        "duplicate_line_ratio": F.col("__n_dup_lines") / F.greatest(F.col("__n_lines"), F.lit(1)),
        "same_as_previous_ratio": F.col("__same") / words,
    }
    return df.select(*[c for c in columns if c not in new], *[c.alias(k) for k, c in new.items()])


def verdict(rules: tuple[Rule, ...] = RULES, listed: Column | None = None) -> Column:
    """True where every rule holds; that on stop words binds where the language is `listed`, everywhere if not given."""
    ok = F.lit(True)
    for rule in rules:
        free = F.lit(False) if listed is None or rule.measure != "stop_word_ratio" else ~listed
        if rule.least is not None:
            ok = ok & (free | (F.col(rule.measure) >= rule.least))
        if rule.most is not None:
            ok = ok & (free | (F.col(rule.measure) <= rule.most))
    return ok


def base_failed(least_words: int = 20, most_repeated_percent: int = 30) -> Column:
    return (F.col("n_words") < least_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeated_percent
    )


def assess(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds counts, ratios, `base_failed` and `kept`.

    Null and empty texts have no words, so they fail; repeated rows are judged alike; an empty table gives an empty
    one. Texts of any length are counted whole, in place; columns under the new names are replaced. One pass without a shuffle and without user functions.
    """
    return (
        measures(df, text)
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & verdict(rules))
    )


def keep_good(
    df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, language: str = "lang"
) -> DataFrame:
    """The rows that pass, with the columns they came with. Where a column names the language, the rule on stop words
    binds only texts in a language whose stop words are listed."""
    columns = df.columns
    listed = None
    if language in columns:
        code = F.lower(F.substring_index(F.translate(F.col("__row")[language], "_", "-"), "-", 1))
        listed = F.coalesce(code.isin(*LISTED), F.lit(False))
    inner = df.select(F.struct("*").alias("__row"), F.col(text).alias("__text"))
    # The row number is no condition. Without it the filter would move below the projections, and what they compute
    # once for a text would be computed again for each word inside the lambdas.
    judged = measures(inner, "__text", loose=True).withColumn("kept", ~base_failed() & verdict(rules, listed))
    judged = judged.withColumn("__number", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("__number") >= 0)).select(
        *[F.col("__row")[c].alias(c) for c in columns]
    )
