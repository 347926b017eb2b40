"""Quality rules: base counts, and the Jensen-Shannon distance of a document from its language."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.session import cut_lineage

WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?'\"()-"

# Frequent function words of each language.
COMMON = {
    "en": "the of and to in is it that for was on with as by be at".split(),
    "fr": "de la le les et des en un une que est pour dans qui sur par".split(),
    "de": "der die und in den von zu das mit des auf für ist im dem nicht".split(),
    "es": "de la que el en los del se las por un para con no una su".split(),
}
N_COMMON = 16
CLASSES = ("lower", "upper", "space", "digit", "symbol", "punctuation", "other")

# Guards: a shorter text's histograms say nothing. Distances lie between 0 and 1.
LEAST_CHARS = 200
LEAST_WORDS = 50
MOST_CHAR_DISTANCE = 0.3
# Words: the limit is on the divergence beyond what so few words show by chance, see `by_chance`.
MOST_WORD_DIVERGENCE = 0.06
# A text's part in a reference is its shares in whole parts of this, so that sums are exact in any order.
PARTS = 1_000_000


def bind(value: Column, f) -> Column:
    """f(value), with `value` evaluated once per row although lambdas inside use it again and again."""
    return F.transform(F.array(value), f)[0]


def repeat_words(w: Column) -> Column:
    """Words in 3-word windows that are found twice or more in the array `w`.

    Windows are sorted as numbers (33 bits of hash, 30 of position); neighbours with equal hashes are then compared as
    words. Covered words follow from the gaps between the confirmed positions."""
    third = F.size(w) - 3
    keys = F.transform(F.sequence(F.lit(0), third), lambda i: F.shiftleft(
        F.shiftrightunsigned(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), 31), 30).bitwiseOR(i.cast("long")))

    def beside(s: Column, same) -> Column:
        return F.filter(s, lambda x, j: ((j > 0) & F.coalesce(same(x, F.get(s, j - 1)), F.lit(False))) | F.coalesce(same(x, F.get(s, j + 1)), F.lit(False)))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def confirmed(likely: Column) -> Column:
        at = F.transform(likely, lambda x: x.bitwiseAND((1 << 30) - 1).cast("int"))
        texts = F.sort_array(F.transform(at, lambda i: F.struct(
            F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i"))))
        found = bind(texts, lambda s: beside(s, lambda x, y: x["t"] == y["t"]))
        return bind(F.sort_array(F.transform(found, lambda x: x["i"])), covered)

    likely = bind(F.sort_array(keys), lambda s: beside(s, lambda x, y: F.shiftright(x, 30) == F.shiftright(y, 30)))
    return F.when(third < 0, F.lit(0).cast("long")).otherwise(bind(likely, confirmed))


def jensen_shannon(p: Column, q: Column) -> Column:
    """The distance (root of the divergence in bits) between two arrays of counts; null if either is empty."""
    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def bits(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    pairs = F.zip_with(p, q, lambda x, y: F.struct((x / total(p)).alias("x"), (y / total(q)).alias("y")))
    sums = F.aggregate(pairs, F.lit(0.0), lambda s, v: s + bits(v["x"], (v["x"] + v["y"]) / 2) / 2 + bits(v["y"], (v["x"] + v["y"]) / 2) / 2)
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(sums, F.lit(0.0))))


def _word_stats(w: Column, common: Column, every: list[str]) -> Column:
    """Counts that need the words: how many, how many are repeated, and how often each common word occurs."""
    hits = F.concat(F.lit(" "), F.array_join(F.filter(F.transform(w, F.lower), lambda x: x.isin(every)), "  "), F.lit(" "))
    count = bind(hits, lambda s: F.transform(common, lambda c: (
        (F.length(s) - F.length(F.replace(s, F.concat(F.lit(" "), c, F.lit(" ")), F.lit("")))) / (F.length(c) + 2)).cast("long")))
    return F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"), count.alias("words"))


def _features(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    lang = F.col(f"`{lang_col}`").cast("string")
    source = df.select(F.col(f"`{id_col}`").alias("doc_id"), lang.alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    common = F.array().cast("array<string>")
    for name, words in COMMON.items():
        common = F.when(F.col("lang") == name, F.array(*map(F.lit, words))).otherwise(common)
    every = sorted({w for words in COMMON.values() for w in words})

    def char_stats(rest: Column) -> Column:
        # rest: the text without letters; each step looks at what the one before left
        def marks(other: Column) -> Column:
            symbols = F.length(F.regexp_replace(other, f"[^{SYMBOLS}]+", ""))
            points = F.length(F.regexp_replace(other, r"[^.,;:!?'\"()\-]+", ""))
            return F.struct(F.length(other).alias("n"), symbols.alias("symbol"), points.alias("punctuation"))
        solid = F.regexp_replace(rest, WHITE, "")
        return bind(solid, lambda t: F.struct(
            F.length(rest).alias("rest"), F.length(t).alias("solid"),
            bind(F.regexp_replace(t, "[0-9]+", ""), marks).alias("marks")))

    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    found = source.select(
        "doc_id", "lang", F.md5("text").alias("md5"),
        F.length("text").alias("n"), F.length(F.regexp_replace("text", "[^A-Z]+", "")).alias("upper"),
        bind(F.regexp_replace("text", r"\p{L}+", ""), char_stats).alias("c"),
        bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        bind(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda w: _word_stats(w, common, every)).alias("w"))
    space, digit = F.col("c.rest") - F.col("c.solid"), F.col("c.solid") - F.col("c.marks.n")
    classes = [F.col("n") - F.col("c.rest") - F.col("upper"), F.col("upper"), space, digit, F.col("c.marks.symbol"), F.col("c.marks.punctuation"),
               F.col("c.marks.n") - F.col("c.marks.symbol") - F.col("c.marks.punctuation")]
    return found.select(
        "doc_id", "lang", "md5", F.col("w.n_words").alias("n_words"), (F.col("n") - space).cast("long").alias("word_chars"),
        F.col("c.marks.symbol").cast("long").alias("n_symbols"), "n_dup_lines", F.col("w.n_repeat_words").alias("n_repeat_words"),
        F.array(*[x.cast("long") for x in classes]).alias("chars"),
        F.when(F.size("w.words") > 0, F.concat("w.words", F.array(F.col("w.n_words") - _size(F.col("w.words"))))).alias("words"))


def _size(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)


def by_chance(n: Column) -> Column:
    """The divergence (in bits) that `n` words drawn from the reference itself have from it on average, to first order: one degree of
    freedom for each common word."""
    return F.lit(N_COMMON / (8 * math.log(2))) / n


def references(found: DataFrame) -> DataFrame:
    """l, ref_chars, ref_words: the mean shares of each language, in whole PARTS, over its distinct texts that pass the base rule.

    Copies count once and long texts no more than short ones. Equal texts meet by md5: histograms are shuffled, texts are not."""
    shares = [F.floor(F.get(a, F.lit(i)) * PARTS / _size(F.col(a))).alias(f"{a}{i}") for a, n in (("chars", len(CLASSES)), ("words", N_COMMON + 1)) for i in range(n)]
    distinct = found.where(~F.col("base_failed")).groupBy("lang", "md5").agg(F.first("chars").alias("chars"), F.first("words").alias("words"))
    sums = distinct.select("lang", *shares).groupBy(F.col("lang").alias("l")).agg(
        *[F.sum(f"chars{i}").alias(f"c{i}") for i in range(len(CLASSES))], *[F.coalesce(F.sum(f"words{i}"), F.lit(0)).alias(f"w{i}") for i in range(N_COMMON + 1)])
    return sums.select("l", F.array(*[f"c{i}" for i in range(len(CLASSES))]).alias("ref_chars"), F.array(*[f"w{i}" for i in range(N_COMMON + 1)]).alias("ref_words"))


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  most_char_distance: float = MOST_CHAR_DISTANCE, most_word_divergence: float = MOST_WORD_DIVERGENCE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance.

    A document has two histograms: of character classes, and of its language's common words with one bin for all other words, so
    that too few common words are a distance too. It fails the method if its characters are further from its language's reference than
    the limit, or if the divergence of its words exceeds the limit by more than `by_chance`, so that short texts are judged as
    surely as long ones. Texts of fewer than LEAST_CHARS characters or LEAST_WORDS words are not judged by that histogram.
    References are the mean shares of the distinct texts that pass the base rule. All counts come from whole texts, however long, within
    the row: only the counts are written to the shared folder (runs a job), and histograms, not texts, are shuffled.

    A null or empty text has no words and fails the base rule. Documents without a language share a reference of characters;
    a language without a word list is judged by characters alone, and the only text of a language is its own reference.
    Repeated rows give repeated rows; an empty table gives an empty result; other columns are ignored."""
    found = _features(df, id_col, text_col, lang_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = cut_lineage(found.withColumn("base_failed", failed), "features")
    char = F.when(_size(F.col("chars")) >= LEAST_CHARS, jensen_shannon(F.col("chars"), F.col("ref_chars")))
    word = F.when(F.col("n_words") >= LEAST_WORDS, jensen_shannon(F.col("words"), F.col("ref_words")))
    far = F.coalesce(F.col("char_distance") > most_char_distance, F.lit(False)) | F.coalesce(
        F.pow("word_distance", F.lit(2.0)) - by_chance(F.col("n_words")) > most_word_divergence, F.lit(False))
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    # one row of 24 numbers per language; whether it is broadcast, adaptive execution decides by its measured size
    return (found.join(references(found), F.col("lang").eqNullSafe(F.col("l")), "left")
            .select(*counts, char.alias("char_distance"), word.alias("word_distance"))
            .select(*counts, (~F.col("base_failed") & ~far).alias("kept"), "char_distance", "word_distance"))


def verdicts(df: DataFrame) -> DataFrame:
    return quality_rules(df).drop("char_distance", "word_distance")


def _oracle() -> str:
    lists = " ".join(f"when '{lang}' then [{', '.join(repr(w) for w in words)}]" for lang, words in COMMON.items())
    return rf"""
with d as (select doc_id, lang, coalesce(text, '') as t, case lang {lists} else [] end as common from documents),
w as (select doc_id, regexp_extract_all(t, '{WORD}') as w from d),
win as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)),
dup as (select doc_id, i from win qualify count(*) over (partition by doc_id, g) > 1),
cov as (select doc_id, count(distinct i + k) as n from dup, (values (0), (1), (2)) v(k) group by doc_id),
c as (select doc_id, lang, t, common, length(t) as n, length(regexp_replace(t, '\p{{L}}+', '', 'g')) as rest,
        length(regexp_replace(t, '[^A-Z]+', '', 'g')) as upper, length(regexp_replace(t, '[^ 	-
]+', '', 'g')) as space,
        length(regexp_replace(t, '[^0-9]+', '', 'g')) as digit, length(regexp_replace(t, '[^{SYMBOLS}]+', '', 'g')) as symbol,
        length(regexp_replace(t, '[^.,;:!?''"()\-]+', '', 'g')) as point from d),
b as (select c.doc_id, c.lang, md5(c.t) as m, c.t, len(w.w) as n_words, c.n - space as word_chars, symbol as n_symbols,
        (select count(*) - count(distinct l) from (select unnest(string_split(c.t, chr(10))) as l) where regexp_matches(l, '[^ 	-
]')) as n_dup_lines,
        coalesce(cov.n, 0) as n_repeat_words, n_words < 50 or 100 * coalesce(cov.n, 0) > 50 * n_words as base_failed
      from c join w using (doc_id) left join cov using (doc_id)),
hits as (select d.doc_id, u.k, count(m.word) as x from (select doc_id, unnest(range(len(common))) as k, unnest(common) as word from d) u
        join d using (doc_id) left join (select doc_id, lower(unnest(w)) as word from w) m on m.doc_id = u.doc_id and m.word = u.word
        group by all),
h as (select doc_id, 'c' as kind, unnest(range(7)) as k,
        unnest([n - rest - upper, upper, space, digit, symbol, point, rest - space - digit - symbol - point]) as x from c
      union all select doc_id, 'w', k, x from hits
      union all select doc_id, 'w', {N_COMMON}, n_words - sum(x) from hits join b using (doc_id) group by doc_id, n_words),
z as (select doc_id, lang, kind, k, x, sum(x) over (partition by doc_id, kind) as all_x, n_words from h join b using (doc_id)),
one as (select min(doc_id) as doc_id from b where not base_failed group by lang, m),
r as (select lang, kind, k, sum((x * {PARTS}) // all_x)::double as y from z join one using (doc_id) group by all),
s as (select z.doc_id, z.kind, z.x / nullif(z.all_x, 0) as p, r.y / nullif(sum(r.y) over g, 0) as q, z.all_x, z.n_words
      from z join r on z.lang is not distinct from r.lang and z.kind = r.kind and z.k = r.k window g as (partition by z.doc_id, z.kind)),
j as (select doc_id, kind, max(all_x) as all_x, max(n_words) as n_words, sqrt(greatest(sum(case when p > 0 then p * log2(p / ((p + q) / 2)) / 2 else 0 end
        + case when q > 0 then q * log2(q / ((p + q) / 2)) / 2 else 0 end), 0)) as dist from s group by doc_id, kind),
far as (select distinct doc_id from j where kind = 'c' and all_x >= {LEAST_CHARS} and dist > {MOST_CHAR_DISTANCE}
        or kind = 'w' and n_words >= {LEAST_WORDS} and dist * dist - {N_COMMON} / (8 * ln(2)) / n_words > {MOST_WORD_DIVERGENCE})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and doc_id not in (select doc_id from far) as kept from b
"""


ORACLE = _oracle()
