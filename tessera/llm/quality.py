"""Line-first cleaning: rules per line, failing lines removed, documents that lose too much text rejected.

Everything is array and string functions of one row: no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import read

SPACE = " \t\n\x0b\f\r"
LEAST_WORDS, MOST_REPEATED, MOST_LOST = 50, 0.5, 0.5
SYMBOLS = r"[#*$%&|<>]"
#: Phrases of pages' frames, lower case.
BOILERPLATE = ("all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of service", "subscribe to our newsletter", "enable javascript", "click here to", "skip to content", "share on facebook")


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``."""
    t = F.trim(text, F.lit(SPACE))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+"))


def bound(value: Column, use) -> Column:
    """use(value) with value computed once: the variable of a lambda over an array of one."""
    return F.get(F.transform(F.array(value), use), 0)


def repeated(w: Column) -> Column:
    """Words that stand in a window of three words found twice or more, the first included.

    Windows are told apart by a 64-bit hash. Where all differ there are none; else they are sorted, equal neighbours
    give the windows found again, and the distinct places these cover are counted.
    """
    at = F.sequence(F.lit(0), F.size(w) - 3)
    window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def covered(s: Column) -> Column:
        h = lambda k: F.get(s, k)["h"]
        alike = lambda k: F.coalesce(h(k) == h(k - 1), F.lit(False)) | F.coalesce(h(k) == h(k + 1), F.lit(False))
        places = F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), alike), lambda k: F.get(s, k)["i"])
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2)))))

    distinct = F.size(F.array_distinct(F.transform(at, window)))
    counted = bound(F.sort_array(F.transform(at, lambda i: F.struct(window(i).alias("h"), i.alias("i")))), covered)
    return F.when(F.size(w) < 4, 0).when(distinct == F.size(w) - 2, 0).otherwise(counted)


def fails(line: Column) -> Column:
    """Whether a line is punctuation (symbols, shouting), navigation, or a page's frame (its phrases over 1/25 of the letters)."""
    n = F.length(line)
    count = lambda p: F.regexp_count(line, F.lit(p))
    symbols = (count(SYMBOLS) * 8 > n) & (n >= 8)
    navigation = (count(r"\|") >= 3) & (count(r"\|") * 25 > n)
    shouting = (count("!") >= 5) & (count("!") * 14 > n)
    frame = 25 * (n - F.length(F.regexp_replace(F.lower(line), "|".join(BOILERPLATE), ""))) > n
    return symbols | navigation | shouting | frame


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost_words, base_failed, kept, cleaned.

    cleaned is the text without its failing lines. A document is kept if it has LEAST_WORDS words, at most
    MOST_REPEATED of them repeated, and at most MOST_LOST of them on failing lines. A null or empty text has no words
    and is not kept; rows are measured one by one, so repeated rows and null ids make no difference. Columns of docs
    with the names above are replaced.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "base_failed", "kept", "cleaned"]
    own = [c for c in docs.columns if c not in names]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*own).alias("_own"), text.alias("_t"), words(text).alias("_w"), F.split(text, "\n").alias("_lines"))
    filled = F.filter("_lines", lambda x: F.trim(x, F.lit(SPACE)) != "")
    rows = rows.select(
        "_own", "_t", "_lines",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        bound(filled, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated(F.col("_w")).cast("long").alias("n_repeat_words"),
        F.filter("_lines", fails).alias("_bad"),
    )
    lost = F.when(F.size("_bad") == 0, 0).otherwise(F.size(words(F.array_join("_bad", " "))))
    rows = rows.withColumn("n_lost_words", lost.cast("long"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 100 * MOST_REPEATED * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.col("n_lost_words") <= MOST_LOST * F.col("n_words")))
    cleaned = F.when(F.size("_bad") == 0, F.col("_t")).otherwise(F.array_join(F.filter("_lines", lambda x: ~fails(x)), "\n"))
    return rows.withColumn("cleaned", cleaned).select("_own.*", *names)


def clean(docs: DataFrame) -> DataFrame:
    """The documents kept, their text without its failing lines; columns of docs, which keep their values whatever their names.

    The test of the row number, always true, keeps the optimizer from copying the measures into the filter.
    """
    own = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("own"), F.col("text"))
    kept = measure(own).withColumn("row", F.monotonically_increasing_id()).where("kept and row >= 0")
    new = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    return kept.select(*[new.get(c, F.col("own")[c]).alias(c) for c in docs.columns])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return measure(read(spark, sf_dir, "documents").select("doc_id", "text")).select(*names)


SQL = r"""
with d as (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
w as (select r, list_filter(regexp_split_to_array(t, '[ 	-
]+'), lambda x: x <> '') ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) ls, string_split(t, chr(10)) lines from d),
tri as (select r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] g from (select r, ws, unnest(range(1, len(ws) - 1)) i from w)),
again as (select r, i from (select *, count(*) over (partition by r, g) c from tri) where c > 1),
rep as (select r, count(distinct p) n from (select r, unnest([i, i + 1, i + 2]) p from again) group by r),
li as (select r, unnest(lines) x from w),
cnt as (select r, x, length(x) n, len(regexp_extract_all(x, '[#*$%&|<>]')) y, length(x) - length(replace(x, '|', '')) p,
          length(x) - length(replace(x, '!', '')) e from li),
lost as (select r, sum(len(list_filter(regexp_split_to_array(x, '[ 	-
]+'), lambda z: z <> ''))) n from cnt
  where (y * 8 > n and n >= 8) or (p >= 3 and p * 25 > n) or (e >= 5 and e * 14 > n)
     or 25 * (n - length(regexp_replace(lower(x), '{frames}', '', 'g'))) > n group by r),
m as (select doc_id, len(ws)::bigint n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint n_symbols, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines,
        coalesce(rep.n, 0)::bigint n_repeat_words, coalesce(lost.n, 0)::bigint lost
      from d join w using (r) left join rep using (r) left join lost using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) base_failed,
  (not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and lost <= 0.5 * n_words) kept
from m""".replace("{frames}", "|".join(BOILERPLATE))
