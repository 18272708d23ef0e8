"""Benchmark questions in documents, also with other numbers, names or units.

Texts become templates: numbers, names and units (after a number) turn into
typed placeholders, the rest into lower-case words. Five-token windows of the
templates are joined by hash. A document holds a question if it has 80 % of the
question's windows and the slots agree: along the best alignment each value of
the question stands for one value of the document. With equal values the copy is verbatim,
else re-parameterised.

Three readings of a text are matched, and a pair found in one of them counts:
the template; the template of the text with white space collapsed, in which a
capitalised word is a name also at the start of a sentence if it is one
elsewhere in the text; and its words alone in lower case, whose slots are the
numbers that follow them. Words alone are a copy even if these numbers do not
agree with each other; the pair is then told as ``edited``.

Readings are dear, so only documents that can hold a question are read. Who has
80 % of a question's windows has most of its pairs of neighbouring literal
words, so also a good part of its rarer ones: a question is looked for where
these stand. This loses nothing. Which pairs are rare is told by some of the
documents.

Document windows are met with the windows of the benchmark where they arise:
only hits are shuffled. The benchmark is broadcast if it is small, and shuffled
otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import keep, small
from .text import whole

WINDOW = 5
CONTAINED = 0.8
#: Literal words a window needs to say something; windows of placeholders match anywhere.
LITERAL = 3
#: Windows of benchmarks up to which they are broadcast (24 bytes each).
BROADCAST_WINDOWS = 1_000_000

NUMBER, NAME, UNIT = "#", "@", "~"
#: Readings of a text, in the order in which they tell the kind of a pair.
TEMPLATE, RENAMED, WORDS = range(3)
# The look back stands behind the capital, so that few places have to be looked at.
NAMES = r"\p{Lu}(?<=[\p{L}\p{N},;] \p{Lu})[\p{Ll}\p{M}]+(?: \p{Lu}[\p{Ll}\p{M}]+)*+"
NUMBERS = r"[0-9]++(?:[.,][0-9]++)*+"
#: A name that ends inside a word leaves a rest that is no word of the text.
BROKEN = r"\p{Lu}[\p{Ll}\p{M}]+[\p{L}&&[^\p{Ll}]]"
#: One of so many documents tells how rare pairs of words are; this changes no result.
RARITY = 64
RUNS = r"[\p{L}\p{M}]++"
UNITS = (
    "km|m|cm|mm|miles?|feet|foot|ft|inch(?:es)?|kg|g|mg|pounds?|lbs?|tons?|litres?|liters?|l|ml|"
    "hours?|minutes?|seconds?|days?|weeks?|months?|years?|mph|kmh|dollars?|euros?|cents?|percent|"
    "degrees?|watts?|volts?|joules?|newtons?|[%$€£°]"
)


def runs(text: Column, signs: str = "") -> Column:
    """The runs of letters, in order; with the given signs, which stand apart, among them.

    Splitting costs half of collecting matches.
    """
    return F.array_remove(F.split(text, rf"[^\p{{L}}\p{{M}}{signs}]++"), "")


def template(text: Column, valued: bool = False) -> Column:
    """Tokens of ``TEMPLATE``; see ``_tokens``."""
    return _tokens(text, valued, False)


def reading(text: Column, nth: int, valued: bool = False) -> Column:
    """Tokens of a text in one of the three readings."""
    if nth == TEMPLATE:
        return template(text, valued)
    if nth == WORDS:
        return runs(F.lower(text))
    tokens = _tokens(F.regexp_replace(text, r"[\s\p{Z}]++", " "), True, True)

    def named(t: Column) -> Column:
        names = F.flatten(
            F.transform(
                F.filter(t, lambda x: F.substring(x, 1, 1) == NAME),
                lambda x: F.split(F.translate(x, NAME, ""), " "),
            )
        )
        words = F.filter(F.array_intersect(t, names), lambda x: x.rlike(r"^\p{Lu}[\p{Ll}\p{M}]+$"))
        return F.struct(t.alias("t"), words.alias("names"))

    def mark(s: Column) -> Column:
        sign = F.lit(NAME)
        return F.transform(
            s["t"],
            # Only words with a capital are looked up among the names.
            lambda x: F.when(
                (F.lower(x) != x) & F.array_contains(s["names"], x), F.concat(sign, x, sign)
            ).otherwise(x),
        )

    def plain(x: Column) -> Column:
        first = F.substring(x, 1, 1)
        return F.lower(x) if valued else F.when(first.isin(NUMBER, NAME, UNIT), first).otherwise(F.lower(x))

    once = F.transform(F.array(tokens), named)
    return F.transform(F.transform(once, mark)[0], plain)


def _tokens(text: Column, valued: bool, cased: bool) -> Column:
    """Tokens of a text: words, and placeholders in the place of values.

    ``valued`` keeps the value inside its placeholder, as in ``#12#``; the
    tokens are the same ones in the same order.
    """

    def mark(sign: str, value: str) -> str:
        return f" {sign}{value}{sign} " if valued else f" {sign} "

    plain = F.regexp_replace(text, f"[{NUMBER}{NAME}{UNIT}]", " ")
    marked = F.regexp_replace(plain, NAMES, mark(NAME, "$0"))
    marked = F.regexp_replace(marked, NUMBERS, mark(NUMBER, "$0"))
    marked = F.regexp_replace(
        marked, rf"(?i){NUMBER} *+(?<![0-9] )({UNITS})(?![\p{{L}}\p{{M}}])", f"{NUMBER}{mark(UNIT, '$1')}"
    )
    marked = marked if cased else F.lower(marked)
    if not valued:
        return runs(marked, NUMBER + NAME + UNIT)
    one = "|".join(f"{s}[^{s}]*+{s}" for s in (NUMBER, NAME, UNIT))
    return F.regexp_extract_all(marked, F.lit(rf"{RUNS}|{one}"), F.lit(0))


def windows(tokens: Column, seed: int = TEMPLATE) -> Column:
    """Hash of each five tokens in a row; of all tokens if there are fewer, none if there are none.

    Equal windows of different readings, their ``seed``, have different hashes.
    """
    def hashes(t: Column) -> Column:
        many = F.transform(
            F.sequence(F.lit(0), F.size(t) - WINDOW),
            lambda i: F.xxhash64(F.lit(seed), *(t[i + k] for k in range(WINDOW))),
        )
        return (
            F.when(F.size(t) >= WINDOW, many)
            .when(F.size(t) > 0, F.array(F.xxhash64(F.lit(seed), F.array_join(t, " "))))
            .otherwise(F.array().cast("array<bigint>"))
        )

    # A lambda's variable is computed once; ``tokens`` itself would be once per use.
    return F.transform(F.array(tokens), hashes)[0]


def _readings(text: Column, valued: bool) -> Column:
    """(nth, text, tokens) of the three readings."""
    return F.array(
        *(
            F.struct(F.lit(k).alias("nth"), text.alias("text"), reading(text, k, valued).alias("tokens"))
            for k in (TEMPLATE, RENAMED, WORDS)
        )
    )


def benchmark_windows(told: DataFrame) -> DataFrame:
    """(item, digest, at, window, n): windows with enough words, ``n`` of them distinct per question.

    ``digest`` is of the text and its reading: each reading is a question of its own. A question without such a window keeps all it has.
    """
    n = told.groupBy(F.col("item").alias("of2"), F.col("digest").alias("of2_digest")).agg(
        F.countDistinct("window").alias("n")
    )
    return told.join(
        n, F.col("item").eqNullSafe(F.col("of2")) & (F.col("digest") == F.col("of2_digest"))
    ).select("item", "digest", "at", "window", "n")


def _told(items: DataFrame, id_: str, text: str) -> DataFrame:
    """(item, digest, at, window, marks, lone) of the windows that count; see ``_marks``."""
    tokens = items.select(
        F.col(id_).alias("item"), F.explode(_readings(whole(text), False)).alias("r")
    ).select("item", F.xxhash64("r.text", "r.nth").alias("digest"), "r.nth", "r.tokens")
    tokens = tokens.dropDuplicates(["item", "digest"])
    seeded = F.lit(None).cast("array<bigint>")
    for k in (TEMPLATE, RENAMED, WORDS):
        seeded = F.when(F.col("nth") == k, windows(F.col("tokens"), k)).otherwise(seeded)
    inside = F.slice("tokens", F.col("at") + 1, WINDOW)
    literal = F.filter(inside, lambda t: ~t.isin(NUMBER, NAME, UNIT))
    each = tokens.select(
        "item", "digest", "tokens", F.posexplode(seeded).alias("at", "window")
    ).select("item", "digest", "at", "window", literal.alias("literals"), _marks(inside).alias("m"))
    best = each.groupBy("item", "digest").agg(F.max(F.size("literals")).alias("most"))
    best = best.withColumnRenamed("item", "of").withColumnRenamed("digest", "of_digest")
    return each.join(
        best, F.col("item").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest"))
    ).filter(F.size("literals") >= F.least("most", F.lit(LITERAL))).select(
        "item", "digest", "at", "window", "m.marks", "m.lone"
    )


def _pairs(words: Column) -> Column:
    """Hashes of the words next to each other, and of the last word alone."""
    return F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.xxhash64(a, b))


def _marks(tokens: Column) -> Column:
    """What a text that has these tokens of a template has among its words alone.

    ``marks``: hashes of pairs of literal words with at most numbers between
    them, which are neighbours where words alone are read. Without such a pair
    the window is ``lone`` and has the hashes of its literal words.
    """
    def pair(a: Column, b: Column) -> Column:
        return F.when(~a.isin(NAME, UNIT) & ~b.isin(NAME, UNIT), F.xxhash64(a, b))

    def hashes(t: Column) -> Column:
        both = F.array_compact(F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.size(t)), pair))
        single = F.transform(F.filter(t, lambda x: ~x.isin(NAME, UNIT)), lambda x: F.xxhash64(x))
        lone = F.size(both) == 0
        return F.struct(F.array_distinct(F.when(lone, single).otherwise(both)).alias("marks"), lone.alias("lone"))

    return F.transform(F.array(F.filter(tokens, lambda t: t != NUMBER)), hashes)[0]


def telling_marks(told: DataFrame, rarity: DataFrame) -> DataFrame:
    """(mark, question, least): rarer marks of every question, of which a document that
    holds it has at least ``least``. ``rarity``: (mark, docs).

    A document with ``k`` windows of a question has all marks of each of them, so
    its marks of the question stand in as many windows as the ``k`` windows with
    the fewest marks have marks. If that takes ``m`` marks even where the most
    frequent ones are had, at most all but ``m`` are missing, and of the rarest
    all but m plus j it has j. A question whose windows may hold no mark has a
    null one.
    """
    each = told.select("digest", "window", "marks").dropDuplicates(["digest", "window"])
    fewest = F.sort_array(F.collect_list(F.size("marks")))
    taken = F.slice(fewest, 1, F.ceil(F.count(F.lit(1)) * CONTAINED).cast("int"))
    need = each.groupBy("digest").agg(F.aggregate(taken, F.lit(0), lambda s, x: s + x).alias("need"))
    spread = each.select("digest", F.explode("marks").alias("mark")).groupBy("digest", "mark").count()
    common = Window.partitionBy("digest").orderBy(F.col("count").desc(), "mark")
    rare = Window.partitionBy("digest").orderBy(F.coalesce("docs", F.lit(0)), "mark")
    have = F.coalesce(F.sum("count").over(common.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole_question = Window.partitionBy("digest")
    ranked = (
        spread.join(rarity, "mark", "left")
        .join(need, "digest")
        .withColumn("more", have < F.col("need"))
        .withColumn("nth", F.row_number().over(rare))
        .withColumn("m", F.sum(F.col("more").cast("int")).over(whole_question))
        .withColumn("all", F.count(F.lit(1)).over(whole_question))
        .withColumn("least", F.ceil(F.col("m") / 2).cast("int"))
    )
    picked = ranked.filter((F.col("m") > 0) & (F.col("nth") <= F.col("all") - F.col("m") + F.col("least")))
    none = need.filter("need = 0").select(F.lit(None).cast("long"), "digest", F.lit(0)).limit(1)
    return picked.select("mark", F.col("digest").alias("question"), "least").union(none)


def candidates(docs: DataFrame, body: Column, told: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold enough rarer marks of some question."""
    digest = F.xxhash64(body)
    # Single words are looked up only if some window has no pair.
    lone = told.filter("lone").limit(1).count()

    def marks_of(t: Column) -> Column:
        return F.array_distinct(F.concat(_pairs(t), F.transform(t, lambda x: F.xxhash64(x))) if lone else _pairs(t))

    own = F.transform(F.array(runs(F.lower(body))), marks_of)[0]
    asked = keep(told.select(F.explode("marks").alias("mark")).distinct(), "asked-marks")
    rarity = (
        docs.filter(F.pmod(digest, F.lit(RARITY)) == 0)
        .select(F.explode(own).alias("mark"))
        .join(small(asked, BROADCAST_WINDOWS), "mark", "left_semi")
        .groupBy("mark")
        .agg(F.count(F.lit(1)).alias("docs"))
    )
    marks = keep(telling_marks(told, rarity), "telling-marks")
    if marks.filter("mark is null").limit(1).count():
        return docs
    # A text in which a name ends inside a word is read in any case.
    always = F.lit(0).cast("long")
    marks = keep(marks.union(marks.select(always, always, F.lit(1)).limit(1)), "telling-marks")
    marked = F.when(body.rlike(BROKEN), F.array(always)).otherwise(own)
    hit = (
        docs.select(digest.alias("digest"), F.explode(marked).alias("mark"))
        .join(small(marks, BROADCAST_WINDOWS), "mark")
        .groupBy("digest", "question", "least")
        # Equal texts count alike, so a mark may be there more often; never less often.
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= F.col("least"))
        .select("digest")
        .distinct()
    )
    hit = keep(hit, "candidates")
    return (
        docs.select(F.struct(*(F.col(f"`{n}`") for n in docs.columns)).alias("row"), digest.alias("digest"))
        .join(small(hit, BROADCAST_WINDOWS), "digest", "left_semi")
        .select("row.*")
    )


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """Pairs of a document and a question it holds.

    Columns: doc_id, doc_digest, item_id, windows (of the question), found,
    containment, kind (``verbatim``, ``reparameterised``, or ``edited``: the
    question's words with numbers that differ from it in no consistent way),
    start (token of the reading of the document at which the question's
    alignment starts).

    * Null and empty texts have no windows and match nothing.
    * Texts of fewer than five tokens are one window, found only in texts
      with just these tokens.
    * Repeated rows make one pair; a null id is an id like any other, and
      texts under one id are told apart by ``doc_digest``.
    * The best alignment is the one with most windows, the first of equals.
    * Empty tables give no pairs.
    """
    body = whole(text)
    told = keep(_told(items, item_id, text), "told-windows")
    bench = keep(benchmark_windows(told), "benchmark-windows")
    # Names of other columns stay out of the joins.
    docs = docs.select(F.col(doc_id).alias("doc"), body.alias("body"))
    body = F.col("body")
    docs = candidates(docs, body, told)
    distinct = bench.select("window").distinct()
    hashes = keep(distinct, "benchmark-hashes")
    hashed = F.flatten(
        F.array(
            *(
                F.transform(windows(reading(body, k), k), lambda w, i: F.struct(i.alias("pos"), w.alias("window")))
                for k in (TEMPLATE, RENAMED, WORDS)
            )
        )
    )
    met = (
        docs.select(
            "doc", F.xxhash64(body).alias("doc_digest"), F.explode(hashed).alias("w")
        )
        .select("doc", "doc_digest", "w.pos", "w.window")
        .join(small(hashes, BROADCAST_WINDOWS), "window")
        .distinct()
    )
    met = keep(met, "met-windows")
    hits = met.join(small(bench, BROADCAST_WINDOWS), "window")
    pair = ["doc", "doc_digest", "item", "digest"]
    found = (
        hits.groupBy(*pair, "n")
        .agg(F.countDistinct("window").alias("found"))
        .filter(F.col("found") >= CONTAINED * F.col("n"))
    )
    # At most as many entries per pair as the question has windows.
    lines = hits.groupBy(*pair, (F.col("pos") - F.col("at")).alias("start")).agg(
        F.collect_set("at").alias("ats")
    )
    best = lines.groupBy(*pair).agg(
        F.min_by(F.struct("start", "ats"), F.struct(-F.size("ats"), F.col("start"))).alias("line")
    )

    def same(a: str, b: str) -> Column:
        x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
        return (
            x("doc").eqNullSafe(y("doc"))
            & (x("doc_digest") == y("doc_digest"))
            & x("item").eqNullSafe(y("item"))
            & (x("digest") == y("digest"))
        )

    pairs = keep(
        found.alias("f").join(best.alias("b"), same("f", "b")).select("f.*", "b.line.*"), "pairs"
    )
    questions = keep(
        items.select(F.explode(_readings(whole(text), True)).alias("r"))
        .select(
            F.xxhash64("r.text", "r.nth").alias("digest"),
            F.xxhash64("r.text").alias("text_digest"),
            "r.nth",
            F.when(F.col("r.nth") == WORDS, numbered(F.col("r.text"))).otherwise(F.col("r.tokens")).alias("asked"),
        )
        .dropDuplicates(["digest"]),
        "questions",
    )
    held = keep(pairs.select("doc_digest").distinct(), "held")
    answers = (
        docs.select(F.xxhash64(body).alias("doc_digest"), body.alias("body"))
        .join(small(held), "doc_digest", "left_semi")
        .groupBy("doc_digest")
        .agg(F.first("body").alias("body"))
        .select(
            "doc_digest",
            *(reading(F.col("body"), k, True).alias(f"said{k}") for k in (TEMPLATE, RENAMED)),
            numbered(F.col("body")).alias(f"said{WORDS}"),
        )
    )
    # A kept table: a text with very many copies can then be split in the join.
    answers = keep(answers, "answers")
    slots = F.when(
        F.col("nth") == WORDS, _number_slots(F.col("asked"), F.col(f"said{WORDS}"), F.col("start"), F.col("ats"))
    )
    for k in (TEMPLATE, RENAMED):
        slots = slots.when(
            F.col("nth") == k, _slots(F.col("asked"), F.col(f"said{k}"), F.col("start"), F.col("ats"))
        )
    asked = lambda s: s["asked"]
    said = lambda s: s["said"]
    n_pairs = F.size(F.array_distinct("slots"))
    consistent = n_pairs == F.size(F.array_distinct(F.transform("slots", asked)))
    return (
        pairs.join(small(questions), "digest")
        .join(answers, "doc_digest")
        .withColumn("slots", slots)
        .withColumn("agree", consistent)
        .filter(F.col("agree") | (F.col("nth") == WORDS))
        .select(
            F.col("doc").alias("doc_id"),
            "doc_digest",
            F.col("item").alias("item_id"),
            "text_digest",
            "nth",
            F.col("n").alias("windows"),
            "found",
            (F.col("found") / F.col("n")).alias("containment"),
            F.when(~F.col("agree"), "edited")
            .when(F.exists("slots", lambda s: asked(s) != said(s)), "reparameterised")
            .otherwise("verbatim")
            .alias("kind"),
            "start",
        )
        # Of the readings that find a pair the first one tells about it.
        .groupBy("doc_id", "doc_digest", "item_id", "text_digest")
        .agg(F.min(F.struct("nth", "windows", "found", "containment", "kind", "start")).alias("r"))
        .select("doc_id", "doc_digest", "item_id", "r.*")
        .drop("nth")
    )


def _slots(asked: Column, said: Column, start: Column, ats: Column) -> Column:
    """(asked, said) values of the slots that matched windows cover."""
    across = F.zip_with(
        F.transform(asked, lambda t, i: F.struct(t.alias("token"), i.alias("at"))),
        F.slice(said, start + 1, F.size(asked)),
        lambda q, d: F.struct(q["token"].alias("asked"), d.alias("said"), q["at"].alias("at")),
    )
    matched = F.filter(
        across,
        lambda p: F.substring(p["asked"], 1, 1).isin(NUMBER, NAME, UNIT)
        & (F.substring(p["asked"], 1, 1) == F.substring(p["said"], 1, 1))
        & F.exists(ats, lambda a: p["at"].between(a, a + WINDOW - 1)),
    )
    return F.transform(
        matched, lambda p: F.struct(p["asked"].alias("asked"), p["said"].alias("said"))
    )


def numbered(text: Column) -> Column:
    """The words of the reading of words alone, each with the numbers that follow it."""
    each = F.regexp_extract_all(F.lower(text), F.lit(RUNS + r"[^\p{L}\p{M}]*+"), F.lit(0))
    numbers = lambda t: F.array_join(F.regexp_extract_all(t, F.lit(NUMBERS), F.lit(0)), " ")
    return F.transform(each, lambda t: F.concat(F.regexp_extract(t, RUNS, 0), F.lit(NUMBER), numbers(t)))


def _number_slots(asked: Column, said: Column, start: Column, ats: Column) -> Column:
    """(asked, said) numbers behind equal words that matched windows cover."""
    across = F.zip_with(
        F.transform(asked, lambda t, i: F.struct(t.alias("token"), i.alias("at"))),
        F.slice(said, start + 1, F.size(asked)),
        lambda q, d: F.struct(
            F.substring_index(q["token"], NUMBER, 1).alias("word"),
            F.substring_index(d, NUMBER, 1).alias("other"),
            F.substring_index(q["token"], NUMBER, -1).alias("asked"),
            F.substring_index(d, NUMBER, -1).alias("said"),
            q["at"].alias("at"),
        ),
    )
    # What stands behind a window's last word may be beyond the copy.
    matched = F.filter(
        across,
        lambda p: (p["word"] == p["other"])
        & ((p["asked"] != "") | (p["said"] != ""))
        & F.exists(ats, lambda a: p["at"].between(a, a + WINDOW - 2)),
    )
    return F.transform(matched, lambda p: F.struct(p["asked"].alias("asked"), p["said"].alias("said")))


def clean_documents(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """Documents that hold no question of the benchmark.

    * All columns stay, whatever their names, and rows as often as they are.
    * A null id is an id like any other; null and empty texts hold nothing and stay.
    * Empty documents give none; an empty benchmark keeps all.
    """
    found = contaminated(docs.select("doc_id", text), items, text=text)
    held = keep(found.select(F.col("doc_id").alias("of"), F.col("doc_digest").alias("of_digest")).distinct(), "contaminated")
    rows = docs.select(
        F.struct(*(F.col(f"`{n}`") for n in docs.columns)).alias("row"),
        F.col("doc_id").alias("id"),
        F.xxhash64(whole(text)).alias("digest"),
    )
    return rows.join(
        small(held), F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest")), "left_anti"
    ).select("row.*")
