"""Personal data: patterns, and terms that give away what the patterns protect.

Masking an address leaves the words around it, and some of them tell as much
as the address itself. How much is read from the corpus: with lines as
contexts, let p(c) be the share of lines holding an entity of kind c and
p(c|t) that share among the lines with term t. The pointwise mutual
information log2 p(c|t)/p(c), over the information -log2 p(c) of the kind,
says how far seeing t reveals c: 1 if t never stands without it. In lines
that hold an entity of the kind, terms beyond a threshold are generalised to
a placeholder and terms beyond a higher one removed.

All of it is column expressions and one count of terms over all lines, summed
per task before it is shuffled. No match crosses a line break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import keep
from .text import whole

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Disclosure from which a term is generalised, and from which it is removed.
GENERALISE = 0.9
REMOVE = 0.99
#: Lines of a kind in which a term must stand to be judged.
SUPPORT = 5
#: Letters a term has at least.
TERM_PATTERN = r"\p{L}{3,}"

# Each finds the leftmost non-overlapping matches of the plain pattern in its
# comment, in time linear in the text: what can only fail again is not tried.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ : a run before @ is tried once.
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+) : a run of digits is tried once.
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ : a match is a whole run; runs of other lengths never count.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be worth trying.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
SPAN = "array<struct<start:long,end:long,value:string>>"


def find(text: Column, pattern: str) -> Column:
    """(start, end, value) of all matches, in code points, end exclusive.

    The matches and what lies between them, in turn, make up the text: running
    sums of their lengths are the positions.
    """
    pairs = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        F.split(text, pattern, -1),
        lambda value, gap: F.struct(value.alias("value"), F.length(gap).cast("long").alias("gap")),
    )

    def add(sum_: Column, pair: Column) -> Column:
        start = sum_["at"] + pair["gap"]
        end = start + F.length(pair["value"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(sum_["spans"], F.array(span)).alias("spans"))

    return F.aggregate(
        F.filter(pairs, lambda p: p["value"].isNotNull()),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("spans")),
        add,
        lambda s: s["spans"],
    )


def accepted(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """(start, nth, end) of all entities by start, then kind; ``nth`` counts in ``KINDS``."""

    def of(nth: int, kind: str) -> Column:
        good = F.filter(find(text, PATTERNS[kind]), lambda s: accepted(kind, s["value"]))
        spans = F.transform(
            good, lambda s: F.struct(s["start"].alias("start"), F.lit(nth).alias("nth"), s["end"].alias("end"))
        )
        none = F.array().cast("array<struct<start:long,nth:int,end:long>>")
        return F.when(text.rlike(HINTS[kind]), spans).otherwise(none)

    return F.array_sort(F.concat(*(of(n, k) for n, k in enumerate(KINDS))))


def terms_of(line: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(line), F.lit(TERM_PATTERN), F.lit(0)))


def lines_of(text: Column) -> Column:
    """(start, end, line) of each line."""
    kind = "array<struct<start:long,end:long,line:string>>"

    def add(sum_: Column, line: Column) -> Column:
        end = sum_["at"] + F.length(line)
        entry = F.struct(sum_["at"].alias("start"), end.alias("end"), line.alias("line"))
        return F.struct((end + 1).alias("at"), F.concat(sum_["lines"], F.array(entry)).alias("lines"))

    return F.aggregate(
        F.split(text, "\n", -1),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("lines")),
        add,
        lambda s: s["lines"],
    )


def disclosing_terms(texts: DataFrame, marked: DataFrame) -> DataFrame:
    """(nth, term, disclosure) of the terms that reveal a kind.

    ``texts``: all texts (text). ``marked``: lines with entities (nths, terms),
    ``terms`` free of the entities themselves.
    """
    lines = F.explode(F.split(F.col("text"), "\n", -1))
    counts = (
        texts.select(lines.alias("line"))
        .select(F.explode(terms_of(F.col("line"))).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n_t"))
    )
    each = marked.select(F.explode("nths").alias("nth"), "terms")
    together = (
        each.select("nth", F.explode("terms").alias("term"))
        .groupBy("nth", "term")
        .agg(F.count(F.lit(1)).alias("n_tc"))
        .filter(F.col("n_tc") >= SUPPORT)
    )
    # One row per kind, four at most, and one row: safe to broadcast.
    of_kind = F.broadcast(each.groupBy("nth").agg(F.count(F.lit(1)).alias("n_c")))
    all_ = F.broadcast(texts.agg(F.sum(F.size(F.split("text", "\n", -1))).alias("n")))
    informs = -F.log2(F.col("n_c") / F.col("n"))
    reveals = F.log2(F.col("n_tc") * F.col("n") / (F.col("n_t") * F.col("n_c")))
    return (
        together.join(counts, "term")
        .join(of_kind, "nth")
        .join(all_)
        .withColumn("disclosure", reveals / F.nullif(informs, F.lit(0.0)))
        .filter(F.col("disclosure") >= GENERALISE)
        .select("nth", "term", "disclosure")
    )


def _overlaps(spans: Column, start: Column, end: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < end) & (start < s["end"]))


def find_personal_data(
    docs: DataFrame, text: str = "text", columns: list[str] | None = None
) -> DataFrame:
    """(row, text, base, terms) for every row of ``docs``.

    ``row`` holds the named (by default all) columns; ``base`` the entities as (start,
    nth, end) by start; ``terms`` what the corpus shows to reveal them, as
    (start, end, disclosure) by start. ``text`` is null where there is
    nothing to mask.

    * Null text: empty. Positions count code points; ends are exclusive.
    * Equal rows and equal texts get equal spans.
    * An empty table gives an empty table.
    """
    body = whole(text)
    rows = docs.select(
        F.struct(*(docs[c] for c in columns or docs.columns)).alias("row"),
        F.sha2(body, 256).alias("digest"),
        body.alias("text"),
        base_spans(body).alias("base"),
    )
    has = F.size("base") > 0
    found = keep(
        rows.select(
            "row",
            F.when(has, F.col("digest")).alias("digest"),
            "base",
            F.when(has, F.col("text")).alias("text"),
        ),
        "entities",
    )
    hit = found.filter(F.col("digest").isNotNull())

    def in_line(spans: Column) -> Column:
        line = F.col("line")
        return F.filter(
            spans, lambda s: (s["start"] >= line["start"]) & (s["end"] <= line["end"])
        )

    lines = (
        hit.select("digest", "text", "base", F.explode(lines_of(F.col("text"))).alias("line"))
        .select("digest", "line", in_line(F.col("base")).alias("base"))
        .filter(F.size("base") > 0)
        .withColumn("nths", F.array_distinct(F.transform("base", lambda s: s["nth"])))
    )
    free = F.filter(
        F.transform(
            find(F.col("line.line"), TERM_PATTERN),
            lambda s: F.struct(
                (s["start"] + F.col("line.start")).alias("start"),
                (s["end"] + F.col("line.start")).alias("end"),
                F.lower(s["value"]).alias("value"),
            ),
        ),
        lambda s: ~_overlaps(F.col("base"), s["start"], s["end"]),
    )
    lines = keep(lines.select("digest", "nths", free.alias("words")), "entity-lines")
    marked = lines.select(
        "nths", F.array_distinct(F.transform("words", lambda s: s["value"])).alias("terms")
    )
    telling = keep(disclosing_terms(docs.select(body.alias("text")), marked), "telling-terms")
    # Copies of a text have the same spans: grouped by text, the copies are one.
    spans = (
        lines.select("digest", "nths", F.explode("words").alias("w"))
        .select("digest", F.explode("nths").alias("nth"), F.col("w.value").alias("term"), "w.start", "w.end")
        .join(telling, ["nth", "term"])
        .groupBy("digest", "start", "end")
        .agg(F.max("disclosure").alias("disclosure"))
        .groupBy("digest")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", "disclosure"))).alias("terms"))
    )
    spans = keep(spans, "term-spans")
    none = F.array().cast("array<struct<start:long,end:long,disclosure:double>>")
    with_terms = found.filter("digest is not null").join(spans, "digest", "left")
    return with_terms.select("row", "text", "base", F.coalesce("terms", none).alias("terms")).union(
        found.filter("digest is null").select("row", "text", "base", none)
    )


def span_strings(spans: Column) -> Column:
    """kind:start:end, comma-joined, of an array of (start, nth, end)."""
    names = F.array(*(F.lit(k) for k in (*KINDS, TERM)))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", names[s["nth"]], s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def all_spans(base: Column, terms: Column) -> Column:
    """Entities and terms as one array of (start, nth, end), by start, then kind."""
    as_base = F.transform(
        terms,
        lambda t: F.struct(
            t["start"].alias("start"), F.lit(len(KINDS)).alias("nth"), t["end"].alias("end")
        ),
    )
    return F.array_sort(F.concat(base, as_base))


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its texts sanitised and all other columns as they are.

    Entities become ``<EMAIL>``, ``<IP>``, ``<CARD>`` or ``<PHONE>``, where
    they overlap the one that starts first; terms that reveal one become
    ``<TERM>`` or, above ``REMOVE``, go. Texts with nothing to mask, null too,
    stay as they are.
    """
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    found = find_personal_data(docs, text)
    cuts = F.array_sort(
        F.concat(
            F.transform(
                "base",
                lambda s: F.struct(
                    s["start"].alias("start"), s["end"].alias("end"), names[s["nth"]].alias("by")
                ),
            ),
            F.transform(
                "terms",
                lambda s: F.struct(
                    s["start"].alias("start"),
                    s["end"].alias("end"),
                    F.when(s["disclosure"] >= REMOVE, "").otherwise("<TERM>").alias("by"),
                ),
            ),
        )
    )

    def cut(sum_: Column, span: Column) -> Column:
        gap = F.substring(
            F.col("text"), sum_["at"] + 1, (span["start"] - sum_["at"]).cast("int")
        )
        return F.when(
            span["start"] >= sum_["at"],
            F.struct(
                span["end"].cast("int").alias("at"),
                F.concat(sum_["out"], gap, span["by"]).alias("out"),
            ),
        ).otherwise(
            F.struct(
                F.greatest(sum_["at"], span["end"].cast("int")).alias("at"), sum_["out"].alias("out")
            )
        )

    clean = F.aggregate(
        cuts,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        cut,
        lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))),
    )
    row = F.col("row")
    return found.select(
        *(
            F.when(F.col("text").isNull(), row[c]).otherwise(clean).alias(c)
            if c == text
            else row[c].alias(c)
            for c in docs.columns
        )
    )
