r"""Personal data and information-theoretic sanitisation (operator 10), in DataFrame functions only.

Base: e-mail addresses, IP addresses, card and phone numbers, leftmost non-overlapping matches per
kind, failing matches dropped (``KINDS``). Positions are code points, the end exclusive.

Beyond them, terms that give a protected entity away. An entity is one base value. Its
contexts are the ``reach`` words on either side of each mention, however far; in scripts without blanks every letter is a word. Over the whole corpus,
with N words, c(e) mentions, c(t) occurrences of a term and c(e,t) of them inside contexts of e,

    PMI(e;t) = log2( c(e,t) N / (c(e) 2 reach c(t)) )      IC(e) = -log2( c(e) 2 reach / N )

PMI is at most IC, and equals it when the term occurs nowhere else. A term whose PMI reaches
``threshold`` of the IC for some entity, in at least ``min_contexts`` different contexts of it (copies of one
passage are one context), discloses that entity. Its occurrences become spans of kind ``term`` in every
document, generalised to a label when the text is sanitised.

Candidate pairs are linear in the mentions (at most 2 reach words each). Counts are
pre-aggregated in the tasks. The disclosing terms are counted before use: up to ``inline_terms`` they become a
set in the expression, beyond that they are joined by shuffle; both give the same spans.

The patterns are the plain ones with possessive loops and a look-behind, which take
the same matches without trying every start of a long run again.

Defined cases: a null text counts as empty and has no spans; a null id stays a row; repeated rows
each get a result; an empty table gives an empty result; other columns are not read.
Sanitising replaces spans that overlap as one, with the label of the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.arrays import let, replaced, scan, shifted
from ledgerflow.llm.common import keep, whole_row

REACH = 8  # words on either side of a mention
THRESHOLD, MIN_CONTEXTS, INLINE_TERMS = 0.9, 3, 5_000
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GUARDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}  # a text without it has no match
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}
# A word is a run of letters and digits; in scripts written without blanks every letter is one.
_BLANKLESS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
WORD = rf"[\p{{L}}\p{{N}}&&[^{_BLANKLESS}]]+|[\p{{L}}\p{{N}}&&[{_BLANKLESS}]]"
SPANS = "array<struct<start:int,end:int,value:string>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the last digit is the check digit of the others."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: _doubled(c.cast("int"), i))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def _doubled(value: Column, place: Column) -> Column:
    return F.when(place % 2 == 0, value).otherwise(value * 2 - F.when(value > 4, 9).otherwise(0))


def _in_byte(part: Column) -> Column:
    value = F.regexp_replace(part, "^0+", "")
    return (F.length(value) <= 3) & (F.coalesce(F.try_to_number(value, F.lit("999")), F.lit(0)) <= 255)


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), _in_byte)
    if kind == "card":
        d = _digits(match)
        return F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def spans_of(text: Column, pattern: str, valid) -> Column:
    """(start, end, value) of the valid matches: running sums over the pieces between matches give the positions."""
    def placed(matches: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), matches, lambda p, m: F.length(p) + F.length(m))
        spans = F.zip_with(scan(steps, lambda a, b: a + b), matches, lambda end, m: F.struct(
            (end - F.length(m)).alias("start"), end.alias("end"), m.alias("value")))
        return F.when(F.size(matches) > 0, F.filter(spans, lambda s: valid(s["value"]))).otherwise(F.array().cast(SPANS))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def base_spans(docs: DataFrame, text_col: str = "_text") -> DataFrame:
    """``docs`` with an array of spans for each kind, in columns ``_email``, ``_ip``, ``_card`` and ``_phone``."""
    text, none = F.col(text_col), F.array().cast(SPANS)
    out = docs
    for kind in KINDS:
        spans = spans_of(text, PATTERNS[kind], lambda m, kind=kind: _valid(kind, m))
        guard = GUARDS[kind]
        out = out.withColumn(f"_{kind}", F.when(text.contains(guard), spans).otherwise(none) if guard else spans)
    return out


def contexts_of(text: Column, pattern: str, reach: int) -> Column:
    """For each match of ``pattern`` the ``reach`` words on either side, other matches' own words among them.

    A match holds at least one word, so the words come from at most ``reach`` neighbouring pieces: each piece gives its
    nearest words, and the lists of 1, 2, 4, ... pieces are joined until they hold enough.
    """
    none = F.array().cast("array<string>")

    def last(words: Column) -> Column:
        return F.slice(words, F.greatest(F.size(words) - reach + 1, F.lit(1)), F.lit(reach))

    def first(words: Column) -> Column:
        return F.slice(words, F.lit(1), F.lit(reach))

    def widened(units: Column, by: int) -> Column:
        if by >= reach:
            return units
        return widened(let(units, lambda u: F.zip_with(shifted(u, by, none), u, lambda far, near: last(F.concat(far, near)))), 2 * by)

    def widened_right(units: Column, by: int) -> Column:
        if by >= reach:
            return units
        return widened_right(let(units, lambda u: F.zip_with(u, shifted(u, -by, none), lambda near, far: first(F.concat(near, far)))), 2 * by)

    def around(matches: Column, pieces: Column) -> Column:
        said = F.transform(matches, words_of)
        left = F.zip_with(shifted(said, 1, none), F.slice(pieces, F.lit(1), F.size(matches)), lambda m, p: last(F.concat(m, words_of(p))))
        right = F.zip_with(F.slice(pieces, F.lit(2), F.size(matches)), shifted(said, -1, none), lambda p, m: first(F.concat(words_of(p), m)))
        both = F.zip_with(widened(left, 1), widened_right(right, 1), lambda a, b: F.concat(a, b))
        return F.zip_with(matches, both, lambda m, w: F.struct(m.alias("value"), w.alias("words")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: let(F.split(text, pattern, -1), lambda p: around(m, p)))


def mentions(found: DataFrame, reach: int = REACH) -> DataFrame:
    """``entity`` and ``words``, the words of the context, one row a mention."""
    text, none = F.col("_text"), F.array().cast("array<struct<entity:string,words:array<string>>>")

    def of_kind(kind: str):
        plain = F.lower if kind in ("email", "ip") else _digits
        good = F.filter(contexts_of(text, PATTERNS[kind], reach), lambda m: _valid(kind, m["value"]))
        named = F.transform(good, lambda m: F.struct(F.concat(F.lit(f"{kind}:"), plain(m["value"])).alias("entity"), m["words"].alias("words")))
        return F.when(F.size(f"_{kind}") > 0, named).otherwise(none)

    some = found.where(" OR ".join(f"size(_{k}) > 0" for k in KINDS))
    return some.select(F.explode(F.concat(*map(of_kind, KINDS))).alias("m")).select("m.entity", "m.words")


def disclosing_terms(found: DataFrame, reach: int = REACH, threshold: float = THRESHOLD, min_contexts: int = MIN_CONTEXTS,
                     inline_terms: int = INLINE_TERMS) -> DataFrame:
    """The terms that disclose some entity, with the largest share of its information (``term``, ``share``).

    ``found``: the output of ``base_spans`` over the whole corpus.
    """
    said = keep(mentions(found, reach))
    entities = said.groupBy("entity").agg(F.count(F.lit(1)).alias("c_e"))
    pairs = (said.select("entity", F.xxhash64("words").alias("context"), F.explode("words").alias("term"))
             .groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("entity", "term").agg(F.sum("n").alias("c_et"), F.count(F.lit(1)).alias("contexts"))
             .where(F.col("contexts") >= min_contexts))
    candidates = keep(pairs)
    if candidates.isEmpty():  # no term to count in the texts
        return candidates.select("term", F.lit(0.0).alias("share"))
    terms = candidates.select("term").distinct()
    small = terms.limit(inline_terms + 1).count() <= inline_terms
    words = found.select(F.explode(words_of(F.col("_text"))).alias("word"))
    counted = (words.join(F.broadcast(terms) if small else terms, words["word"] == terms["term"], "left")
               .groupBy("term").agg(F.count(F.lit(1)).alias("c_t")))
    counts = keep(counted)  # the candidates and, under null, all other words
    n = float(counts.agg(F.sum("c_t")).first()[0] or 0)
    if not n:
        return candidates.select("term", F.lit(0.0).alias("share")).limit(0)
    near = F.col("c_e") * (2 * reach)
    both = F.least("c_et", "c_t")
    scored = (candidates.join(counts, "term").join(entities, "entity").where(near < n)
              .select("term", (F.log2(both * n / (near * F.col("c_t"))) / -F.log2(near / n)).alias("share")))
    return keep(scored.groupBy("term").agg(F.max("share").alias("share")).where(F.col("share") >= threshold))


def all_spans(docs: DataFrame, text_col: str = "text", reach: int = REACH, threshold: float = THRESHOLD,
              min_contexts: int = MIN_CONTEXTS, inline_terms: int = INLINE_TERMS) -> DataFrame:
    """``_row`` (all of ``docs`` as a struct), ``_text``, the base spans by kind and ``_term``, the disclosing terms' spans."""
    packed = docs.select(whole_row(docs).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = base_spans(packed)
    terms = disclosing_terms(found, reach, threshold, min_contexts, inline_terms)
    none = F.array().cast(SPANS)
    few = [r["term"] for r in terms.select("term").limit(inline_terms + 1).collect()]  # at most ``inline_terms`` + 1
    if not few:
        return found.withColumn("_term", none)
    if len(few) <= inline_terms:
        some = F.exists(words_of(F.col("_text")), lambda w: w.isin(few))
        return found.withColumn("_term", F.when(some, spans_of(
            F.col("_text"), WORD, lambda m: F.lower(m).isin(few))).otherwise(none))
    keyed = found.withColumn("_key", F.md5("_text"))
    each = keyed.select("_key", F.explode(F.array_distinct(words_of(F.col("_text")))).alias("term"))
    own = each.distinct().join(terms.select("term"), "term").groupBy("_key").agg(F.collect_set("term").alias("_own"))
    return keyed.join(own, "_key", "left").withColumn("_term", F.when(F.col("_own").isNotNull(), spans_of(
        F.col("_text"), WORD, lambda m: F.array_contains("_own", F.lower(m)))).otherwise(none)).drop("_key", "_own")


def written(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans of ``kinds``, comma-joined."""
    def one(kind: str):
        return F.transform(f"_{kind}", lambda s: F.concat(
            F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(one, kinds)), ",")


def sanitized(found: DataFrame) -> Column:
    """The text with every span replaced by its label, from the columns of ``all_spans``.

    Spans are sorted and merged where they overlap; the cost is linear in text and spans.
    """
    def marks(place: int, kind: str):
        return F.transform(f"_{kind}", lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("kind"), s["end"].alias("end")))

    marked = F.array_sort(F.concat(*(marks(i, k) for i, k in enumerate((*KINDS, "term")))))
    labels = F.array(*(F.lit(LABELS[k]) for k in (*KINDS, "term")))
    return replaced(F.col("_text"), marked, lambda s: F.get(labels, s["kind"]))


def sanitize(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """All documents with personal data and disclosing terms replaced by labels; all columns of ``docs`` stay.
    A null text stays null."""
    found = all_spans(docs, text_col, **options)
    text = F.when(F.col("_row").getField(text_col).isNotNull(), sanitized(found))
    done = found.select("_row", text.alias("_clean"))
    fresh = {text_col: F.col("_clean"), "n_chars": F.length("_clean").cast("long")}
    return done.select(*(fresh.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns))
