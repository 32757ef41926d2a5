"""Documents and tables as size-bounded contexts for questions, and the conversation around them."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.order import quantiles
from tessera.sources.pdf import pages_of
from tessera.sources.table import of_text

# Budget of a context, rows and pages of a sample, preview sizes, values shown, tokens of an answer.
CHAR_BUDGET, SAMPLE_ROWS, SAMPLE_PAGES = 15_000, 50, 20
PREVIEW_CHARS, PREVIEW_ROWS, TOP_VALUES, MAX_TOKENS = 2_000, 10, 8, 2_048
CUT = "\n\n[Cut: the text has {n} characters, and only the first {budget} stand above. What follows is unknown.]"
SYSTEM = "Answer from the document {filename} below and from nothing else. Where it does not cover the question, say so.\n\n<document>\n{content}\n</document>"


def kind_of(path: Column) -> Column:
    """csv, tsv, pdf or txt by the name's ending, whatever its case."""
    p = F.lower(path)
    return F.when(p.endswith(".csv"), "csv").when(p.endswith(".tsv") | p.endswith(".tab"), "tsv").when(p.endswith(".pdf"), "pdf").otherwise("txt")


def text_context(docs: DataFrame, text: str = "text", budget: int = CHAR_BUDGET) -> DataFrame:
    """docs with characters, is_full, model_context and preview of each text."""
    t, n = F.coalesce(F.col(text), F.lit("")), F.length(F.coalesce(F.col(text), F.lit("")))
    before, after = CUT.split("{n}")[0], CUT.split("{n}")[1].replace("{budget}", str(budget))
    cut = F.concat(F.substring(t, 1, budget), F.lit(before), n.cast("string"), F.lit(after))
    preview = F.when(n > PREVIEW_CHARS, F.concat(F.substring(t, 1, PREVIEW_CHARS), F.lit("..."))).otherwise(t)
    return docs.withColumns({"characters": n.cast("long"), "is_full": n <= budget, "model_context": F.when(n <= budget, t).otherwise(cut), "preview": preview})


def is_numeric(kind: str) -> bool:
    return kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")


def describe(table: DataFrame) -> DataFrame:
    """One row a numeric column: count, mean, sample deviation, least, quartiles, greatest; over all rows, NaN left out.

    Quartiles are exact and come from counts by value range, not from a state that holds a column's values.
    """
    names = [c for c, kind in table.dtypes if is_numeric(kind)]
    if not names:
        return table.sparkSession.createDataFrame([], "column string, count long, mean double, std double, min double, q25 double, q50 double, q75 double, max double")
    value = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))

    def one(c: str) -> Column:
        v = value(c)
        return F.struct(F.lit(c).alias("column"), F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))

    rows = table.agg(F.array(*[one(c) for c in names]).alias("a")).select(F.explode("a").alias("a")).select("a.*")
    cells = table.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("v")) for c in names])).alias("c")).select("c.*")
    q = quantiles(cells, ["column"], "v", [0.25, 0.5, 0.75])
    q = q.groupBy(F.col("column").alias("_c")).agg(*[F.max(F.when(F.col("share") == x, F.col("value"))).alias(n) for n, x in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))])
    return rows.join(F.broadcast(q), F.col("column") == F.col("_c"), "left").select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")  # one row a column


def top_values(table: DataFrame, most: int = TOP_VALUES) -> DataFrame:
    """(column, distinct, rank, value, n): the most frequent values of each other column, ties by value; nulls do not count."""
    names = [c for c, kind in table.dtypes if not is_numeric(kind)]
    if not names:
        return table.sparkSession.createDataFrame([], "column string, distinct long, rank int, value string, n long")
    cells = table.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in names])).alias("c")).select("c.*")
    counts = cells.where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= most)
    distinct = counts.groupBy(F.col("column").alias("_c")).agg(F.count("*").alias("distinct"))
    return ranked.join(distinct, F.col("column") == F.col("_c")).select("column", "distinct", "rank", "value", "n")


def summarise(table: DataFrame) -> str:
    """Text of the exact summaries of a table."""
    out = []
    numbers = describe(table).collect()  # one row a column
    if numbers:
        out.append("Numeric columns, over all rows:")
        out += [f"{r.column}: count {r['count']}, mean {_g(r.mean)}, std {_g(r.std)}, min {_g(r.min)}, 25% {_g(r.q25)}, 50% {_g(r.q50)}, 75% {_g(r.q75)}, max {_g(r.max)}" for r in numbers]
    by: dict[str, list] = {}
    for r in top_values(table).orderBy("column", "rank").collect():  # TOP_VALUES rows a column
        by.setdefault(r.column, []).append(r)
    out += [f"Column {c}: {rows[0].distinct} distinct values; most frequent: " + ", ".join(f"{r.value!r}: {r.n}" for r in rows) for c, rows in by.items()]
    return "\n".join(out)


def _g(x: float | None) -> str:
    return "NA" if x is None else f"{x:.6g}"


@dataclass
class Document:
    filename: str
    kind: str
    model_context: str
    preview: str
    is_full: bool
    metadata: dict = field(default_factory=dict)
    digest: str = ""


def load(spark: SparkSession, filename: str, raw: bytes) -> Document:
    """Document of an uploaded file, by the kind of its name; a table that does not parse is loaded as text."""
    low = filename.lower()
    digest = hashlib.sha256(raw).hexdigest()
    if low.endswith(".pdf"):
        doc = load_pdf(filename, raw)
    elif low.endswith((".csv", ".tsv", ".tab")):
        doc = load_table(spark, filename, raw, "csv" if low.endswith(".csv") else "tsv")
    else:
        doc = load_text(filename, raw)
    doc.digest = digest
    return doc


def load_text(filename: str, raw: bytes, kind: str = "txt") -> Document:
    text = raw.decode("utf-8", "replace")
    full = len(text) <= CHAR_BUDGET
    context = text if full else text[:CHAR_BUDGET] + CUT.format(n=len(text), budget=CHAR_BUDGET)
    return Document(filename, kind, context, text[:PREVIEW_CHARS] + ("..." if len(text) > PREVIEW_CHARS else ""), full, {"characters": len(text)})


def load_table(spark: SparkSession, filename: str, raw: bytes, kind: str) -> Document:
    text = raw.decode("utf-8", "replace")
    try:
        table = of_text(spark, text, "," if kind == "csv" else "\t").persist()
        rows, names = table.count(), table.columns
    except (ValueError, PySparkException, Py4JError) as error:  # a table that does not parse
        doc = load_text(filename, raw, kind)
        doc.metadata["parse_error"] = str(error)[:300]
        return doc
    show = lambda n: "\n".join([",".join(names), *(",".join("" if v is None else str(v) for v in r) for r in table.limit(n).collect())])
    full = len(text) <= CHAR_BUDGET
    if full:
        context = f"The whole {kind.upper()} table, {rows} rows and {len(names)} columns:\n\n{text}"
    else:
        context = f"A {kind.upper()} table of {rows} rows and {len(names)} columns. First its first {min(rows, SAMPLE_ROWS)} rows, then summaries over all rows.\n\n{show(SAMPLE_ROWS)}\n\n{summarise(table)}"
    doc = Document(filename, kind, context, f"{rows} rows x {len(names)} columns\n\n{show(PREVIEW_ROWS)}", full, {"rows": rows, "columns": len(names), "column_names": names, "context_chars": len(context)})
    table.unpersist()
    return doc


def load_pdf(filename: str, raw: bytes) -> Document:
    """Document of one PDF at hand; ``tessera.sources.pdf`` reads many."""
    return pdf_document(filename, pages_of(raw))


def pdf_document(filename: str, pages: list[str]) -> Document:
    """Document of a PDF's pages: all of them within the budget, else the first SAMPLE_PAGES."""
    marked = [f"--- page {n} ---\n{p}" for n, p in enumerate(pages, 1)]
    whole = "\n\n".join(marked)
    full = len(whole) <= CHAR_BUDGET
    context = whole if full else "\n\n".join(marked[:SAMPLE_PAGES]) + f"\n\n[Cut: {min(len(pages), SAMPLE_PAGES)} of {len(pages)} pages.]"
    return Document(filename, "pdf", context, whole[:PREVIEW_CHARS] + ("..." if len(whole) > PREVIEW_CHARS else ""), full, {"pages": len(pages), "context_chars": len(context)})


def system_prompt(filename: Column | str, content: Column | str):
    """The system prompt, as text or as a column."""
    if isinstance(filename, str) and isinstance(content, str):
        return SYSTEM.replace("{filename}", filename, 1).replace("{content}", content, 1)
    a, rest = SYSTEM.split("{filename}")
    b, c = rest.split("{content}")
    return F.concat(F.lit(a), filename, F.lit(b), content, F.lit(c))


def text_of(blocks: Column) -> Column:
    """The text blocks of an answer (array of (type, text)), one after another."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "")


def fold_history(turns: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """(conv, n_turns, history): each conversation's turns in order, as an array of (role, content)."""
    item = F.struct(F.col(order).alias("k"), F.struct(F.col("role").alias("role"), F.col("text").alias("content")).alias("m"))
    rows = turns.groupBy(conv).agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(item)).alias("h"))
    return rows.select(conv, "n_turns", F.transform("h", lambda x: x["m"]).alias("history"))


USAGE = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")


def ask(client, doc: Document, question: str, history: list[dict], model: str = "default", max_tokens: int = MAX_TOKENS) -> tuple[str, list[dict], dict]:
    """Answer, new history and token usage; client is any object with messages.create(...), given by the caller."""
    turns = [*history, {"role": "user", "content": question}]
    system = [{"type": "text", "text": system_prompt(doc.filename, doc.model_context), "cache_control": {"type": "ephemeral"}}]
    got = client.messages.create(model=model, max_tokens=max_tokens, system=system, messages=turns)
    answer = _answer(got)
    return answer, [*turns, {"role": "assistant", "content": answer}], {k: getattr(got.usage, k, 0) or 0 for k in USAGE}


def ask_baseline(client, question: str, model: str = "default", max_tokens: int = MAX_TOKENS) -> str:
    """Answer to the question alone."""
    return _answer(client.messages.create(model=model, max_tokens=max_tokens, messages=[{"role": "user", "content": question}]))


def _answer(got) -> str:
    return "".join(b.text for b in got.content if getattr(b, "type", None) == "text")


#: Sample file names (lower case, in part) with questions to start from; the last of each may have no answer in the file.
QUESTIONS = {
    "differential_expression": ("How many genes have padj < 0.05 and an absolute log2FoldChange above 0.5?", "Which gene has the largest absolute log2FoldChange?", "In which tissue was the study done?"),
    "study_notes": ("What question does the study ask?", "Which samples were left out, and why?", "What did the sequencing cost?"),
}


def example_questions(filename: str) -> tuple[str, ...]:
    return next((q for part, q in QUESTIONS.items() if part in filename.lower()), ())


class Session:
    """A conversation about one document; another file, or other bytes under its name, start it anew."""

    ERRORS = (("auth", "The key was refused."), ("rate", "Too many requests; try again later."), ("connect", "The service cannot be reached."))

    def __init__(self, spark: SparkSession, client):
        self.spark, self.client = spark, client
        self.document: Document | None = None
        self.turns: list[dict] = []
        self.history: list[dict] = []

    def open(self, filename: str, raw: bytes) -> Document:
        digest = hashlib.sha256(raw).hexdigest()
        if not self.document or (self.document.filename, self.document.digest) != (filename, digest):
            self.document, self.turns, self.history = load(self.spark, filename, raw), [], []
        return self.document

    def _message(self, error: Exception) -> str:
        name = type(error).__name__.lower()
        return next((m for k, m in self.ERRORS if k in name), f"The request failed: {error}")

    def question(self, text: str, baseline: bool = False) -> dict:
        """The turn: question, answer, usage and (if asked for) the baseline, or an error message; errors keep the history."""
        if self.document is None:
            raise ValueError("no document is open")
        turn: dict = {"question": text}
        try:
            answer, self.history, usage = ask(self.client, self.document, text, self.history)
            turn |= {"answer": answer, "usage": usage}
        except Exception as error:  # noqa: BLE001  the client is the caller's
            turn["error"] = self._message(error)
        if baseline and "error" not in turn:
            try:
                turn["baseline"] = ask_baseline(self.client, text)
            except Exception as error:  # noqa: BLE001  the answer and its history stay
                turn["baseline_error"] = self._message(error)
        self.turns.append(turn)
        return turn
