"""Personal data: patterns for known kinds, and identifiers that the words before them give away. Columns only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.storage import stored

KINDS = ("email", "ip", "card", "phone", "found")
# The quantifiers keep what they have taken: no shorter take could match either, and long runs need no stack. A match
# begins at the start of a run or where the last match ended, so that a long run is read once.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"  # a run with fewer digits fails wherever it begins
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What an identifier may look like: groups of digits with single blanks between them, which letters may lead, or a run
#: of five characters or more that has a digit or begins with @.
CANDIDATE = (
    r"(?<![A-Za-z0-9._%+@/#-])(?:[A-Z]{0,4}+[0-9]{2,}+(?:\x20[0-9]{2,}+)++(?![A-Za-z0-9])"
    r"|(?=@|[A-Za-z._/#@-]*+[0-9])[A-Za-z0-9#@][A-Za-z0-9._/#@-]{4,}(?<=[A-Za-z0-9]))"
)
#: Texts are read in parts of about this many characters, so that work is in proportion to their lengths. A part ends
#: where no match can go on: behind a character that none holds, or at a blank beside a letter.
PART = 1000
PARTS = (
    rf"(?s).{{{PART},}}?(?:(?<=[^A-Za-z0-9._%+@\x20()/#-])|(?<=[A-Za-z]\x20)|(?<=\x20)(?=[A-Za-z]))|.+"
)
LAST_WORDS = r"(?<!\S)(\S++\s++)?(\S++)\s*+$"
SPAN = "struct<s:int,e:int,m:string>"
PLACED = "array<struct<s:int,k:int,e:int,m:string>>"


@dataclass(frozen=True)
class Bootstrap:
    """A pattern counts from `support` distinct instances on that are known or taken, one of a single word from `single`
    on, and with `confidence` its unknown ones are taken; `rounds` times scores pass from instances to patterns and
    back."""

    rounds: int = 3
    support: int = 3
    single: int = 6
    confidence: float = 0.8


def _parts(text: Column) -> Column:
    some = text.rlike("[0-9@]")
    return F.when(some, F.regexp_extract_all(text, F.lit(PARTS), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _places(parts: str) -> Column:
    """Where each part begins, and where the last one ends."""
    return F.aggregate(
        parts,
        F.array(F.lit(0)),
        lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x))),
    )


def _spans(matches: Column, gaps: Column) -> Column:
    """All matches with their places in code points: what lies between matches gives the distances."""
    step = F.aggregate(
        F.sequence(F.lit(0), F.size(matches) - 1),
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")),
        lambda a, i: _extended(a, F.get(gaps, i), F.get(matches, i)),
        lambda a: a["out"],
    )
    return F.when(F.size(matches) > 0, step).otherwise(F.array().cast(f"array<{SPAN}>"))


def _extended(a: Column, gap: Column, match: Column) -> Column:
    start = a["at"] + F.length(gap)
    end = start + F.length(match)
    span = F.struct(start.alias("s"), end.alias("e"), match.alias("m"))
    return F.struct(end.alias("at"), F.concat(a["out"], F.array(span)).alias("out"))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    digits = F.reverse(_digits(match))

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        double = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(F.pmod(i, F.lit(2)) == 0, double).otherwise(digit)

    n = F.length(digits)
    return (n <= 19) & (F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0)


def _octets(match: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(match, r"\."), small)


CHECKS: tuple[tuple[str, str, Callable[[Column], Column]], ...] = (
    ("@", EMAIL, lambda m: F.lit(True)),
    ("[0-9]", IP, _octets),
    ("[0-9]", CARD, _luhn),
    ("[0-9]", PHONE, lambda m: F.length(_digits(m)).between(10, 15)),
)


def _of_kind(spans: str, k: int) -> Column:
    return F.filter(spans, lambda x: x["k"] == k)


def _numbered(span: Column, k: int, at: Column | int = 0) -> Column:
    return F.struct((span["s"] + at).alias("s"), F.lit(k).alias("k"), (span["e"] + at).alias("e"), span["m"].alias("m"))


def _text_key(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def _patterns(before: Column, instance: Column, after: Column) -> Column:
    """What may give an identifier away: the two words before it, the last of them, alone or with the shape of the
    identifier, the field name right before it, and its shape with the word after it."""
    word = F.regexp_replace(F.lower(F.regexp_extract(before, LAST_WORDS, 2)), r"[\"'(<\[]++", "")
    first = F.lower(F.regexp_replace(F.regexp_extract(before, LAST_WORDS, 1), r"\s++", ""))
    follows = F.lower(F.regexp_extract(after, r"^\S*+\s++(\S++)", 1))
    label = F.regexp_extract(word, r"(?<![\p{L}_-])([\p{L}_-]++)[:=]$", 1)
    shape = F.regexp_replace(F.regexp_replace(instance, "[A-Za-z]++", "a"), "[0-9]++", "9")
    forms = (
        ((first != "") & (word != ""), ("2", first, word)),
        (word != "", ("1", word)),
        (word != "", ("s", word, shape)),
        (label != "", ("f", label)),
        (follows != "", ("a", shape, follows)),
    )
    return F.array_compact(F.array(*[
        F.when(holds, F.concat_ws(" ", *[F.lit(x) if isinstance(x, str) else x for x in words])) for holds, words in forms
    ]))


def _scan(df: DataFrame, text: str) -> DataFrame:
    """Adds `__base`, the spans of the known kinds by start and kind, as structs of s, k (the kind's number), e, m, and
    `__mentions`: these and the candidates that touch none of them, each with its patterns. A match lies in one part;
    words around it may lie in the next ones."""
    kept = df.columns
    df = df.withColumn("__parts", _parts(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn("__places", _places("__parts"))

    def near(i: Column, regex: str) -> Column:
        return F.coalesce(F.regexp_extract(F.get("__parts", i), regex, 0), F.lit(""))

    def matched(placed: Column, i: Column) -> Column:
        part = placed["__parts"]
        fields = [
            placed["__places"].alias("at"), part.alias("t"),
            near(i - 1, LAST_WORDS).alias("lead"), near(i + 1, r"^\s*+\S++").alias("tail"),
        ]
        for k, (some, regex) in enumerate([*[(some, regex) for some, regex, _ in CHECKS], ("[0-9@]", CANDIDATE)]):
            none = F.array().cast("array<string>")
            found = part.rlike(some)
            fields.append(F.when(found, F.regexp_extract_all(part, F.lit(regex), F.lit(0))).otherwise(none).alias(f"m{k}"))
            fields.append(F.when(found, F.split(part, regex, -1)).otherwise(none).alias(f"g{k}"))
        return F.struct(*fields)

    def placed(part: Column) -> Column:
        base = []
        for k, (_, _, holds) in enumerate(CHECKS):
            good = F.filter(_spans(part[f"m{k}"], part[f"g{k}"]), _on_match(holds))
            base.append(F.transform(good, _numbering(k)))
        n = len(CHECKS)
        return F.struct(
            part["at"].alias("at"), part["t"].alias("t"), part["lead"].alias("lead"), part["tail"].alias("tail"),
            F.sort_array(F.concat(*base)).alias("base"),
            F.transform(_spans(part[f"m{n}"], part[f"g{n}"]), _numbering(n)).alias("others"),
        )

    def mentions(part: Column) -> Column:
        free = F.filter(
            part["others"], lambda x: ~F.exists(part["base"], lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
        )
        return F.transform(
            F.concat(part["base"], free),
            lambda x: F.struct(
                (x["s"] + part["at"]).alias("s"), x["k"].alias("k"), (x["e"] + part["at"]).alias("e"),
                x["m"].alias("instance"),
                _patterns(
                    F.concat(part["lead"], F.substring(part["t"], F.lit(1), x["s"])),
                    x["m"],
                    F.concat(F.substring(part["t"], x["e"] + 1, F.length(part["t"])), part["tail"]),
                ).alias("patterns"),
            ),
        )

    df = df.select(*kept, F.transform(F.arrays_zip("__parts", F.slice("__places", 1, F.size("__parts")).alias("__places")), matched).alias("__matched"))
    df = df.select(*kept, F.transform("__matched", placed).alias("__placed"))
    return df.select(
        *kept,
        F.flatten(
            F.transform(
                "__placed",
                lambda p: F.transform(
                    p["base"],
                    lambda x: F.struct((x["s"] + p["at"]).alias("s"), x["k"].alias("k"), (x["e"] + p["at"]).alias("e"), x["m"].alias("m")),
                ),
            )
        ).alias("__base"),
        F.flatten(F.transform("__placed", mentions)).alias("__mentions"),
    )


def _on_match(holds: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda span: holds(span["m"])


def _numbering(k: int) -> Callable[[Column], Column]:
    return lambda span: _numbered(span, k)


def discovered(mentions: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """(text_key, s, k, e, m): mentions of no known kind that patterns of high confidence bring up.

    Edges join patterns with instances. Known instances score 1, a pattern the mean over its instances, and an unknown
    instance what its best pattern scores, once that reaches the confidence: weak patterns don't confirm themselves.
    All are sums and maxima over edges, so a frequent pattern reaches its task as one row per map task."""
    base = F.col("k") < KINDS.index("found")
    edges = stored(
        mentions.select("k", "instance", F.explode("patterns").alias("pattern"))
        .groupBy("pattern", "instance").agg(F.max(base.cast("double")).alias("seed")),
        "edges",
    )
    instances = edges.groupBy("instance").agg(F.max("seed").alias("score"), F.max("seed").alias("seed"))
    least = F.when(F.substring("pattern", 1, 1).isin("1", "a"), how.single).otherwise(how.support)
    for _ in range(how.rounds):
        sure = stored(
            edges.select("pattern", "instance").join(instances, "instance").groupBy("pattern").agg(
                F.avg("score").alias("share"), F.count_if(F.col("score") >= how.confidence).alias("known"),
            ).where((F.col("known") >= least) & (F.col("share") >= how.confidence)).select("pattern", "share"),
            "patterns",
        )
        best = edges.select("pattern", "instance").join(sure, "pattern").groupBy("instance").agg(F.max("share").alias("best"))
        instances = stored(
            instances.join(best, "instance", "left").select(
                "instance", F.greatest("seed", F.coalesce("best", F.lit(0.0))).alias("score"), "seed"
            ),
            "instances",
        )
    unseen = mentions.where(~base).select("text_key", "s", "k", "e", "instance", F.explode("patterns").alias("pattern"))
    taken = unseen.join(sure, "pattern", "left_semi")
    return taken.select("text_key", "s", "k", "e", F.col("instance").alias("m")).distinct()


def _found(rows: DataFrame, text: str, how: Bootstrap, keep: list[str]) -> DataFrame:
    """The columns to keep, `__base`, and `__spans`, all spans of a row by start and kind. Texts are scanned once; equal
    ones count once in the graph."""
    scanned = _scan(rows.withColumn("__key", _text_key(text)), text)
    scanned = stored(scanned.select(*keep, "__key", "__base", "__mentions"), "scanned")
    mentions = (
        scanned.select(F.col("__key").alias("text_key"), F.explode("__mentions").alias("x"))
        .select("text_key", "x.*")
        .distinct()
    )
    found = stored(
        discovered(mentions, how).groupBy("text_key").agg(F.collect_list(F.struct("s", "k", "e", "m")).alias("__found")),
        "found",
    )
    joined = scanned.join(found, scanned["__key"] == found["text_key"], "left")
    spans = F.sort_array(F.concat("__base", F.coalesce("__found", F.array().cast(PLACED))))
    return joined.select(*keep, F.col("__base"), spans.alias("__spans"))


def _written(spans: str, kinds: Column) -> Column:
    return F.concat_ws(
        ",", F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string")))
    )


def find(docs: DataFrame, id_column: str = "doc_id", text: str = "text", how: Bootstrap = Bootstrap()) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_found, base, spans): `base` and `spans` list kind:start:end.

    Whole texts in code points; a null text is empty and has no spans. Repeated rows get the same spans; an empty
    table gives an empty one; other columns are ignored, whatever their names. A long text is read in parts, so its
    work grows with its length. The scan stays in place; what is shuffled are mentions. Spans that share places are all
    listed, by start, then kind.
    """
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("__text"))
    rows = _found(source, "__text", how, ["doc_id"])
    kinds = F.array(*[F.lit(k) for k in KINDS])
    count = [
        F.size(_of_kind("__spans", k)).cast("long").alias(f"n_{name}")
        for k, name in enumerate(KINDS)
    ]
    return rows.select(
        "doc_id", *count, _written("__base", kinds).alias("base"), _written("__spans", kinds).alias("spans")
    )


def redact(docs: DataFrame, text: str = "text", how: Bootstrap = Bootstrap()) -> DataFrame:
    """`docs` with each span of its texts replaced by its kind in brackets; null stays null, other columns as they
    are. Rows are scanned once and kept with their spans; a span that begins inside another adds only what reaches
    beyond it. Repeated rows stay, an empty table gives an empty one, and long texts are put together by parts."""
    columns = docs.columns
    rows = docs.select(F.struct("*").alias("__row"), F.col(text).alias("__text"))
    rows = _found(rows, "__text", how, ["__row"]).withColumn("__text", F.col("__row")[text])
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    rows = rows.withColumn("__parts", F.when(F.size("__spans") > 0, _parts(F.col("__text"))))
    rows = rows.withColumn("__places", _places("__parts"))

    def cleaned(part: Column, i: Column) -> Column:
        first, end = F.get("__places", i), F.get("__places", i + 1)
        begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def step(a: Column, x: Column) -> Column:
            before = F.substring(part, a["at"] + 1, x["s"] - first - a["at"])
            return F.struct(
                F.greatest(a["at"], x["e"] - first).alias("at"),
                F.when(x["s"] - first < a["at"], a["out"])
                .otherwise(F.concat(a["out"], F.array(before, F.get(tags, x["k"]))))
                .alias("out"),
            )

        def whole(a: Column) -> Column:
            return F.concat(F.concat_ws("", a["out"]), F.substring(part, a["at"] + 1, F.length(part)))

        return F.aggregate(F.filter("__spans", lambda x: (x["s"] >= first) & (x["s"] < end)), begun, step, whole)

    clean = F.when(F.size("__spans") > 0, F.concat_ws("", F.transform("__parts", cleaned))).otherwise(F.col("__text"))
    return rows.select(*[(clean if c == text else F.col("__row")[c]).alias(c) for c in columns])
