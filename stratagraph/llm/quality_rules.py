"""Quality rules with adaptive thresholds (operator 2), in DataFrame and SQL functions only.

Fixed base rules look at each document alone. The method's verdict compares four ratios of a
document with what is usual for its language and source. For each (language, source) and ratio a
quantile sketch is kept: counts in buckets that are exact below 64 and at most 1/32 wide above, so
sketches merge by adding counts, in any order, with the same result. Most documents have none of what
the first three ratios count, so quartiles of all values would be zero everywhere and say nothing.
A group's sketch gives the share of documents above zero and the upper quartile q3 of their values;
their product is what a document of the group has, so to say, on the average, and a document may have
``SEVERITY`` times as much. Word lengths have thresholds q3 + 3 w and q1 - 3 w, where w is q3 - q1, or
the width of q3's bucket where both lie in one. No fixed cutoff takes part: a source of code keeps
what a source of prose rejects. A value of zero is never too much. To each group's sketch that of its language
is added with the weight of ``PRIOR`` documents, so a group of any size has thresholds of its own:
those of a small one lie near its language's, those of a large one are its own. Thresholds then
join the documents.

The text is read once; its numbers go to a table in the shared folder, from which both sketches
and filter are made. A hot source is summed before the shuffle (partial aggregation). The
threshold table is broadcast where it has at most ``BROADCAST_ROWS`` rows, else rows and thresholds
are dealt over ``SALTS`` salts, so the rows of one source never meet in one task.

Null text has no words and fails the base rules. Null language or source counts as the empty
name. Repeated rows and ids (null ones too) are judged row by row; ties do not arise. Windows of
words are compared by 64-bit hash within one document. Texts of any length are read whole, an empty
table gives an empty result, and further columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Documents a language's sketch counts as beside that of one of its groups.
PRIOR = 20
#: Rows (of about 100 bytes) up to which thresholds are broadcast, and tasks a group is dealt over beyond.
BROADCAST_ROWS, SALTS = 20_000, 16
#: ratio -> SQL of its whole-number value
RATIOS = {
    "symbols": "n_symbols * 10000 div greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines * 1000 div greatest(n_lines, 1)",
    "repeats": "n_repeat_words * 1000 div greatest(n_words, 1)",
    "word_length": "word_chars * 100 div greatest(n_words, 1)",
}
#: How many times the usual amount a document may have; ratios not named have fences on both sides.
SEVERITY = {"symbols": 2, "dup_lines": 24, "repeats": 24}
WHITE = r"[\\x20\\x09-\\x0D]+"

# The expression binds values once by one-element transforms: w words, h window hashes, s sorted
# hashes, d hashes found twice. A list lookup is cheap while d is short; else the hashes are
# sorted with their places.
REPEATED = """
element_at(transform(array({words}), w -> case when size(w) < 3 then 0L else
  element_at(transform(array(transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))), h ->
    element_at(transform(array(sort_array(h)), s ->
      element_at(transform(array(array_distinct(filter(s, (x, i) -> i > 0 and x = s[i - 1]))), d ->
        case when size(d) = 0 then 0L
        else cast(size(array_distinct(flatten(transform(
          case when size(d) <= 256 then filter(sequence(0, size(h) - 1), i -> array_contains(d, h[i]))
          else element_at(transform(array(sort_array(transform(h, (x, i) -> struct(x as x, i as i)))), p ->
            transform(filter(p, (y, k) -> (k > 0 and p[k - 1].x = y.x) or (k < size(p) - 1 and p[k + 1].x = y.x)), y -> y.i)), 1)
          end,
          i -> array(i, i + 1, i + 2))))) as bigint) end
      ), 1)), 1)), 1) end), 1)
"""


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and drop ``text``."""
    t = f"coalesce({text}, '')"
    words = F.expr(f"array_remove(split({t}, '{WHITE}'), '')")
    lines = F.expr(f"filter(split({t}, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')")
    return docs.select(
        *[c for c in docs.columns if c != text],
        F.element_at(
            F.transform(
                F.array(F.struct(words.alias("w"), lines.alias("l"))),
                lambda x: F.struct(
                    F.size(x["w"]).cast("long").alias("n_words"),
                    F.length(F.array_join(x["w"], "")).cast("long").alias("word_chars"),
                    F.length(F.expr(f"regexp_replace({t}, '[^#*$%&|<>]+', '')")).cast("long").alias("n_symbols"),
                    (F.size(x["l"]) - F.size(F.array_distinct(x["l"]))).cast("long").alias("n_dup_lines"),
                    F.size(x["l"]).cast("long").alias("n_lines"),
                ),
            ),
            1,
        ).alias("m"),
        F.expr(REPEATED.format(words=f"array_remove(split({t}, '{WHITE}'), '')")).alias("n_repeat_words"),
    ).select(*[c for c in docs.columns if c != text], "m.*", "n_repeat_words")


def bucket(value: str) -> Column:
    """Sketch bucket of a whole number >= 0: itself below 64, then 32 buckets for each doubling."""
    return F.expr(f"greatest(length(bin({value})) - 6, 0) * 32 + shiftright({value}, greatest(length(bin({value})) - 6, 0))")


def least_of(at: str) -> Column:
    """The smallest value in a bucket."""
    return F.expr(f"case when {at} < 64 then {at} else shiftleft({at} - ({at} div 32 - 1) * 32, cast({at} div 32 - 1 as int)) end")


def width_of(at: str) -> Column:
    """How many whole numbers share a bucket."""
    return F.expr(f"case when {at} < 64 then 1L else shiftleft(1L, cast({at} div 32 - 1 as int)) end")


def sketches(rows: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, ratio, bucket, n): one mergeable sketch for each group and ratio."""
    pairs = F.array(*[F.struct(F.lit(name).alias("ratio"), F.expr(f"cast({sql} as bigint)").alias("v")) for name, sql in RATIOS.items()])
    return rows.select(*groups, F.explode(pairs).alias("x")).select(*groups, "x.ratio", bucket("x.v").cast("long").alias("bucket")).groupBy(*groups, "ratio", "bucket").agg(F.count("*").alias("n"))


def merge(parts: DataFrame, groups: list[str]) -> DataFrame:
    """Merge sketches into coarser groups."""
    return parts.groupBy(*groups, "ratio", "bucket").agg(F.sum("n").alias("n"))


def quartiles(parts: DataFrame, groups: list[str], language: str) -> DataFrame:
    """(groups, ratio, q1, q3, least, above, total) of each group's sketch blended with its language's:
    quartiles of the values above zero, the width of q3's bucket, and how many values are above zero and
    in all. A sketch has a bounded number of buckets, so it is one row's worth of work. Counts are whole
    numbers: the group's times the language's total, and ``PRIOR`` times the language's."""
    own = parts.groupBy(*groups, "ratio").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("own"), F.sum("n").alias("total"))
    of_language = merge(parts, [language]).groupBy(language, "ratio").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("h"), F.sum("n").alias("whole"))
    both = own.join(of_language, [language, "ratio"])
    blended = F.expr(f"transform(filter(h, x -> x.bucket > 0), x -> struct(x.bucket as bucket, cast(cast(coalesce(own[x.bucket], 0L) as decimal(18, 0)) * cast(whole as decimal(18, 0)) + {PRIOR} * cast(x.n as decimal(18, 0)) as decimal(38, 0)) as n))")
    held = both.select(*groups, "ratio", blended.alias("h"), F.expr(f"cast(cast(whole as decimal(18, 0)) * (total + {PRIOR}) as decimal(38, 0))").alias("total"))
    held = held.withColumn("above", F.expr("aggregate(h, cast(0 as decimal(38, 0)), (a, x) -> cast(a + x.n as decimal(38, 0)))"))

    def reached(quarter: int) -> Column:
        return F.expr(f"nullif(aggregate(h, struct(cast(0 as decimal(38, 0)) as n, -1L as at), (a, x) -> struct(cast(a.n + x.n as decimal(38, 0)) as n, case when a.at < 0 and 4 * (a.n + x.n) >= {quarter} * above then x.bucket else a.at end as at)).at, -1L)")

    found = held.select(*groups, "ratio", "above", "total", reached(1).alias("at1"), reached(3).alias("at3"))
    return found.select(*groups, "ratio", "above", "total", least_of("at1").alias("q1"), least_of("at3").alias("q3"), width_of("at3").alias("least"))


def thresholds(rows: DataFrame, language: str = "lang", source: str = "source") -> DataFrame:
    """(language, source, and low and high of each ratio) for every group among ``rows``."""
    parts = materialize(sketches(rows, [language, source]), "sketches")
    both = quartiles(parts, [language, source], language)
    out = []
    w = F.greatest(F.col("q3") - F.col("q1"), F.col("least"))
    for name in RATIOS:
        mine = F.col("ratio") == name
        low, high = (F.lit(0).cast("bigint"), F.expr(f"cast({SEVERITY[name]} * q3 * above div total as bigint)")) if name in SEVERITY else (F.col("q1") - 3 * w, F.col("q3") + 3 * w)
        out += [F.max(F.when(mine, low)).alias(f"low_{name}"), F.max(F.when(mine, high)).alias(f"high_{name}")]
    return both.groupBy(language, source).agg(*out)


def with_limits(rows: DataFrame, limits: DataFrame, groups: list[str], key: str) -> DataFrame:
    """Every row beside the thresholds of its group."""
    if limits.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(limits), groups, "left")
    dealt = limits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(key, "word_chars", "n_words"), F.lit(SALTS)).cast("int")).join(dealt, [*groups, "salt"], "left").drop("salt")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", source: str = "source") -> DataFrame:
    """``key``, the measures, base_failed, kept."""
    named = docs.select(key, text, F.coalesce(language, F.lit("")).alias(language), F.coalesce(source, F.lit("")).alias(source))
    rows = materialize(measures(named, text).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")), "measures")
    limits = materialize(thresholds(rows.filter("not base_failed"), language, source), "thresholds")
    usual = F.lit(True)
    for name, sql in RATIOS.items():
        value = F.expr(f"cast({sql} as bigint)")
        usual = usual & ((value == 0) | value.between(F.col(f"low_{name}"), F.col(f"high_{name}")))
    return with_limits(rows, limits, [language, source], key).select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(~F.col("base_failed") & usual, F.lit(False)).alias("kept"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


_VALUES = {name: sql.replace(" div ", " // ") for name, sql in RATIOS.items()}
_HIGH = {n: f"{SEVERITY[n]} * q3 * above // total" if n in SEVERITY else "q3 + 3 * greatest(q3 - q1, least)" for n in RATIOS}
_LIMITS = ", ".join(f"max(case when ratio = '{n}' then {'0' if n in SEVERITY else 'q1 - 3 * greatest(q3 - q1, least)'} end) as low_{n}, max(case when ratio = '{n}' then {_HIGH[n]} end) as high_{n}" for n in RATIOS)
_USUAL = " and ".join(f"({_VALUES[n]} = 0 or {_VALUES[n]} between low_{n} and high_{n})" for n in RATIOS)
_FIRST = "case when b < 64 then b else (b - (b // 32 - 1) * 32) << (b // 32 - 1) end"
_WIDE = "case when b < 64 then 1 else 1 << (b // 32 - 1) end"
ORACLE_SQL = {
    "op2_quality_rules": f"""
with words as materialized (
    select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w
    from documents
), wins as (
    select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as win
    from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from words where len(w) >= 3)
), twice as (
    select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) as n from wins) where n > 1
), repeated as (
    select doc_id, count(distinct j) as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from twice) group by doc_id
), lines as (
    select doc_id, l from (select doc_id, unnest(string_split(text, chr(10))) as l from words) where regexp_matches(l, '[^\\x20\\x09-\\x0D]')
), by_line as (
    select doc_id, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines from lines group by doc_id
), m as materialized (
    select doc_id, lang, source, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
           cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint) as n_symbols,
           coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_lines, 0) as n_lines, coalesce(n, 0) as n_repeat_words
    from words left join by_line using (doc_id) left join repeated using (doc_id)
), judged as (
    select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m
), bucketed as (
    select lang, source, ratio, greatest(length(bin(v)) - 6, 0) * 32 + (v >> greatest(length(bin(v)) - 6, 0)) as b
    from (select lang, source, unnest([{", ".join(f"{{'ratio': '{n}', 'v': {v}}}" for n, v in _VALUES.items())}], recursive := true) from judged where not base_failed)
), own as (select lang, source, ratio, b, count(*)::hugeint as n from bucketed group by all),
merged as (select lang, ratio, b, sum(n) as n from own group by all),
totals as (select lang, ratio, sum(n) as whole from merged group by all),
sizes as (select lang, source, ratio, sum(n) as total from own group by all),
blended as (
    select sizes.lang, sizes.source, sizes.ratio, merged.b, coalesce(own.n, 0) * whole + {PRIOR} * merged.n as n, whole * (total + {PRIOR}) as total
    from sizes join totals using (lang, ratio) join merged using (lang, ratio)
    left join own on own.lang = sizes.lang and own.source = sizes.source and own.ratio = sizes.ratio and own.b = merged.b
), summed as (select *, sum(n) over (partition by lang, source, ratio order by b) as cum, sum(n) over (partition by lang, source, ratio) as above from blended where b > 0),
quarters as (select lang, source, ratio, min(above) as above, min(total) as total, min(case when 4 * cum >= above then {_FIRST} end) as q1, min(case when 4 * cum >= 3 * above then {_FIRST} end) as q3, min(case when 4 * cum >= 3 * above then {_WIDE} end) as least from summed group by all),
limits as (select lang, source, {_LIMITS} from quarters group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(not base_failed and {_USUAL}, false) as kept
from judged left join limits using (lang, source)
"""
}
