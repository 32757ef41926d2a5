"""Queries over the document operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import formats as N
from tessera.operators import documents as D
from tessera.plans.views import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_BEFORE, _AFTER = D.CUT.split("{n}")[0], D.CUT.split("{n}")[1].replace("{budget}", str(D.CHAR_BUDGET))
_CONTEXT = f"case when length(t) <= {D.CHAR_BUDGET} then t else concat(substr(t, 1, {D.CHAR_BUDGET}), {q(_BEFORE)}, cast(length(t) as varchar), {q(_AFTER)}) end"


@query(f"select doc_id, length(t) characters, length(t) <= {D.CHAR_BUDGET} is_full, md5({_CONTEXT}) context, md5(case when length(t) > {D.PREVIEW_CHARS} then concat(substr(t, 1, {D.PREVIEW_CHARS}), '...') else t end) preview from (select doc_id, coalesce(text, '') t from documents) d")
def text_context(spark, d):
    rows = D.text_context(table(spark, d, "documents"))
    return rows.select("doc_id", "characters", "is_full", F.md5("model_context").alias("context"), F.md5("preview").alias("preview"))


_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")


@query(" union all ".join(f"""select '{c}' "column", count({c}) "count", round(avg({c}), 4) mean, round(stddev_samp({c}), 4) std, cast(min({c}) as double) "min", quantile_cont(cast({c} as double), 0.25) q25,
  quantile_cont(cast({c} as double), 0.5) q50, quantile_cont(cast({c} as double), 0.75) q75, cast(max({c}) as double) "max" from lineitem""" for c in _NUM))  # fmt: skip
def table_summary(spark, d):
    rows = D.describe(table(spark, d, "lineitem").select(*_NUM))
    return rows.select("column", "count", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", "q25", "q50", "q75", "max")


_CAT = ("p_brand", "p_type", "p_name")


@query("select * from (select \"column\", count(*) over (partition by \"column\") \"distinct\", row_number() over (partition by \"column\" order by n desc, value) rank, value, n from ("
       + " union all ".join(f"select '{c}' \"column\", {c} value, count(*) n from part where {c} is not null group by {c}" for c in _CAT) + ") a) b where rank <= 8")
def top_values(spark, d):
    rows = D.top_values(table(spark, d, "part").select(*_CAT))
    return rows.select("column", "distinct", F.col("rank").cast("long").alias("rank"), "value", "n")


@query(f"select doc_id, md5(concat({q(D.SYSTEM.split('{filename}')[0])}, source, {q(D.SYSTEM.split('{filename}')[1].split('{content}')[0])}, {_CONTEXT}, {q(D.SYSTEM.split('{content}')[1])})) prompt from (select doc_id, source, coalesce(text, '') t from documents) d")
def prompt(spark, d):
    rows = D.text_context(table(spark, d, "documents").select("doc_id", "source", "text"))
    return rows.select("doc_id", F.md5(D.system_prompt(F.col("source"), F.col("model_context"))).alias("prompt"))


@query("select conv_id, count(*) n_turns, md5(string_agg(concat(role, ':', text), '|' order by turn)) history from conversations group by conv_id")
def history_fold(spark, d):
    rows = D.fold_history(table(spark, d, "conversations"))
    joined = F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return rows.select("conv_id", "n_turns", F.md5(joined).alias("history"))


@query("select case when page_id % 5 = 0 then 'csv' when page_id % 5 = 1 then 'tsv' when page_id % 5 = 2 then 'pdf' when page_id % 5 = 3 then 'tsv' else 'txt' end kind, count(*) n from pages group by 1")
def file_kinds(spark, d):
    end = F.element_at(F.array(*[F.lit(x) for x in (".CSV", ".tsv", ".Pdf", ".tab", ".md")]), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, d, "pages").select(D.kind_of(F.concat(F.lit("file"), end)).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("select conv_id, string_agg(text, '' order by turn) filter (where role = 'assistant') answer from conversations group by conv_id having count(*) filter (where role = 'assistant') > 0")
def answer_text(spark, d):
    """The text blocks of each conversation's answers, one after another."""
    t = table(spark, d, "conversations")
    block = F.struct("turn", F.struct(F.when(F.col("role") == "assistant", "text").otherwise("other").alias("type"), F.col("text").alias("text")).alias("b"))
    rows = t.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]).alias("blocks"), F.count_if(F.col("role") == "assistant").alias("n")).where("n > 0")
    return rows.select("conv_id", D.text_of(F.col("blocks")).alias("answer"))


@query("""select event_id, format('{:.6g}', x) general, concat(format('{:.1f}', event_id % 1000 / 7.0), '%') percent, format('{:.4f}', event_id / 7.0) fixed, format('{:,}', event_id * 1009) grouped
  from (select event_id, case event_id % 4 when 0 then event_id / 7.0 when 1 then event_id / 7.0 * 1e5 when 2 then -event_id / 7.0 / 1e7 else cast(event_id as double) end x from events) e""")
def number_formats(spark, d):
    """Numbers as the reports show them."""
    k = F.col("event_id")
    x = F.when(k % 4 == 0, k / 7).when(k % 4 == 1, k / 7 * 1e5).when(k % 4 == 2, -k / 7 / 1e7).otherwise(k.cast("double"))
    return table(spark, d, "events").select("event_id", N.general(x).alias("general"), N.percent(k % 1000 / 700).alias("percent"), N.fixed(k / 7).alias("fixed"), N.grouped(k * 1009).alias("grouped"))
