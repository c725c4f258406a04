"""Readers and writers of the file shapes around the engine: raw trees, questions, templates, logs, evidence and submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.answers import slot_kind
from corpusloom.functions.text import all_matches, strip

# The folders of a raw tree: domain, folder, file pattern, kind.
RAW = (
    ("insurance", "insurance", "*.pdf", "pdf"),
    ("financial_contracts", "financial_contracts", "*.pdf", "pdf"),
    ("financial_reports", "financial_reports", "*.[pP][dD][fF]", "pdf"),
    ("research", "research", "*.pdf", "pdf"),
    ("regulatory", "regulatory/txt", "*.txt", "txt"),
    ("regulatory", "regulatory/html", "*.html", "html"),
    ("regulatory", "regulatory/attachments", "*.pdf", "pdf"),
)
# Answer formats by question type.
FORMATS = {"多选题": "multi", "单选题": "mcq", "判断题": "tf", "计算题": "calc", "抽取题": "calc"}


def discover(spark: SparkSession, root: str, specs=RAW) -> DataFrame:
    """``domain, doc_id, path, kind, bytes, place``: the files of a raw tree, in the order of the folders and then of their paths.

    Contents are not read: the column is pruned. Folders that are not there give no files.
    """
    every = None
    for i, (domain, folder, pattern, kind) in enumerate(specs):
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("ignoreMissingFiles", "true")
        try:
            found = files.load(f"{root}/{folder}").select("path", F.col("length").alias("bytes"))
            found.schema  # noqa: B018  (a missing folder shows here)
        except Exception as e:  # only a missing path is passed over
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        stem = F.regexp_replace(F.substring_index("path", "/", -1), "(?<=.)\\.[^.]*$", "")
        found = found.select(F.lit(domain).alias("domain"), stem.alias("doc_id"), "path", F.lit(kind).alias("kind"), "bytes", F.lit(i).alias("folder"))
        every = found if every is None else every.unionByName(found)
    if every is None:
        return spark.createDataFrame([], "domain string, doc_id string, path string, kind string, bytes long, place int")
    return every.withColumn("place", F.row_number().over(Window.partitionBy("domain").orderBy("folder", "path"))).drop("folder")


def duplicates(files: DataFrame) -> DataFrame:
    """Document ids that several files have."""
    return files.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, doc_id, text, title, n_chars`` of whole text files."""
    rows = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), "(?<=.)\\.[^.]*$", "")
    return rows.select("path", stem.alias("doc_id"), F.col("value").alias("text"), text_title(F.col("value"), stem).alias("title"), F.length("value").alias("n_chars"))


def text_title(text: Column, stem: Column) -> Column:
    """The first quoted title of 4 to 80 characters near the start, else the first line of 5 to 80, else the stem."""
    head = F.substring(text, 1, 4000)
    quoted = F.get(all_matches(head, "《([^》]{4,80})》", 1), F.lit(0))
    lines = F.filter(F.transform(F.split(head, "\\R", -1), strip), lambda x: (F.length(x) >= 5) & (F.length(x) <= 80))
    return F.substring(F.coalesce(quoted, F.get(lines, F.lit(0)), stem), 1, 80)


QUESTION = "qid string, domain string, question string, options map<string,string>, type string, answer_format string, doc_ids array<string>"


def publish(docs: DataFrame, to: str) -> None:
    """Writes parsed documents as Parquet by ``domain`` into the folder ``to``, which must not exist.

    Ids that several documents share are an error, before anything is written. Files show in their places only when their tasks are
    committed, and ``_SUCCESS`` when all are: a folder without it is not published. Texts are not shuffled.
    """
    shared = [r.doc_id for r in duplicates(docs).orderBy("doc_id").limit(5).collect()]
    if shared:
        raise ValueError(f"ids of several documents, the first of them {shared}")
    docs.write.mode("errorifexists").partitionBy("domain").parquet(to)


def read_questions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Questions of JSON arrays (.json) and lines (.jsonl) with ``answer_format``, in the order of file names.

    Without options a question is a calculation; a valid explicit format wins over the type's; all else is multiple choice.
    """
    every = None
    for p in sorted(paths):
        rows = spark.read.schema(QUESTION).option("multiLine", str(p.endswith(".json")).lower()).json(p)
        rows = rows.filter("qid is not null")
        every = rows if every is None else every.unionByName(rows)
    kind = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    none = F.coalesce(F.size("options"), F.lit(0)) <= 0
    fmt = F.when(none, "calc").when(F.col("answer_format").isin(*FORMATS.values()), F.col("answer_format")).otherwise(F.coalesce(F.try_element_at(kind, F.col("type")), F.lit("multi")))
    return every.withColumn("answer_format", fmt)


def read_template(spark: SparkSession, path: str) -> DataFrame:
    """``qid, slot_no, placeholder, kind`` of an answer template; its summary row is left out.

    Raises for a template without qid or answer columns; see template_problems() for rows that don't fit.
    """
    t = spark.read.option("header", "true").csv(path)
    t = t.toDF(*[c.lstrip("﻿") for c in t.columns])
    answers = sorted((int(c.lower().removeprefix("answer").lstrip("_")), c) for c in t.columns if c.lower().removeprefix("answer").lstrip("_").isdigit() and c.lower().startswith("answer"))
    if "qid" not in t.columns or not answers or len({n for n, _ in answers}) < len(answers):
        raise ValueError("a template needs a qid column and numbered answer columns")
    slots = F.array(*[F.struct(F.lit(n).alias("slot_no"), F.trim(F.coalesce(F.col(c), F.lit(""))).alias("placeholder")) for n, c in answers])
    rows = t.filter(F.lower(F.trim(F.coalesce("qid", F.lit("")))) != "summary").select(F.trim(F.coalesce("qid", F.lit(""))).alias("qid"), F.explode(slots).alias("s"))
    return rows.select("qid", "s.slot_no", "s.placeholder", F.when(F.col("s.placeholder") != "", slot_kind(F.col("s.placeholder"))).alias("kind"))


def template_problems(slots: DataFrame) -> DataFrame:
    """``qid, problem``: empty and repeated ids, rows without a slot, gaps between slots."""
    filled = F.col("placeholder") != ""
    g = slots.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("slot_no").alias("kinds"), F.count_if(filled).alias("filled"), F.max(F.when(filled, F.col("slot_no"))).alias("last"), F.min("slot_no").alias("first"))
    problem = F.when(F.col("qid") == "", "no qid").when(F.col("n") > F.col("kinds"), "repeated").when(F.col("filled") == 0, "no slot").when(F.col("last") - F.col("first") + 1 > F.col("filled"), "gap")
    return g.select("qid", problem.alias("problem")).filter("problem is not null")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines log with ``line`` (its order in the file) and ``bad``: whether the line is no such record.

    Blank lines are passed over. Line numbers come from where Spark reads each line, so they order a file's records; a log
    that is one split, as these are, is numbered from 1 without gaps.
    """
    raw = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_path").alias("file"))
    raw = raw.withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("at"))).filter(F.trim("value") != "")
    rec = F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return raw.select("line", rec.alias("r")).select("line", "r.*").withColumn("bad", F.col("_bad").isNotNull()).drop("_bad")


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """``qid, entry`` from a bundle that is a list, an object with a list under questions, items or evidence, or an object by qid.

    ``entry`` is a variant. Raises nothing: entries without a qid have a null one.
    """
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    listed = F.coalesce(*[F.try_variant_get("v", f"$.{k}", "array<variant>") for k in ("questions", "items", "evidence")], F.try_variant_get("v", "$", "array<variant>"))
    keyed = F.try_variant_get("v", "$", "map<string,variant>")
    rows = whole.select(F.when(listed.isNotNull(), F.transform(listed, lambda e: F.struct(F.lit(None).cast("string").alias("k"), e.alias("e")))).otherwise(F.transform(F.map_entries(keyed), lambda m: F.struct(m["key"].alias("k"), m["value"].alias("e")))).alias("x"))
    rows = rows.select(F.explode("x").alias("x"))
    return rows.select(F.coalesce(F.try_variant_get("x.e", "$.qid", "string"), F.col("x.k")).alias("qid"), F.col("x.e").alias("entry"))


AUDIT = ("prompt_tokens", "completion_tokens", "total_tokens", "reasoning")


def submission(results: DataFrame, ledger: DataFrame, n_slots: int) -> DataFrame:
    """The rows of a submission, summary first: ``place, qid, answer_1.., prompt_tokens, completion_tokens, total_tokens, reasoning``.

    Takes ``qid, ord, slots, reasoning`` and the ledger by qid. Newlines of a reasoning become spaces.
    """
    rows = results.join(ledger.select("qid", "prompt_tokens", "completion_tokens"), "qid", "left").fillna(0, ["prompt_tokens", "completion_tokens"])
    slots = [F.coalesce(F.get("slots", F.lit(i)), F.lit("")).alias(f"answer_{i + 1}") for i in range(n_slots)]
    body = rows.select(F.col("ord").cast("long").alias("place"), "qid", *slots, F.col("prompt_tokens").cast("long"), F.col("completion_tokens").cast("long"), F.trim(F.regexp_replace(F.coalesce("reasoning", F.lit("")), "\n", " ")).alias("reasoning"))
    total = ledger.agg(F.coalesce(F.sum("prompt_tokens"), F.lit(0)).cast("long").alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).cast("long").alias("completion_tokens"))
    summary = total.select(F.lit(-1).cast("long").alias("place"), F.lit("summary").alias("qid"), *[F.lit("").alias(f"answer_{i + 1}") for i in range(n_slots)], "prompt_tokens", "completion_tokens", F.lit("").alias("reasoning"))
    out = summary.unionByName(body).withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    return out.select("place", "qid", *[f"answer_{i + 1}" for i in range(n_slots)], *AUDIT)


def submission_problems(results: DataFrame, ledger: DataFrame, slots: DataFrame) -> DataFrame:
    """``qid, problem``: usage of unknown questions, and answers with more slots than their template."""
    stray = ledger.filter((F.col("prompt_tokens") > 0) | (F.col("completion_tokens") > 0)).join(results, "qid", "left_anti").select("qid", F.lit("usage of no question").alias("problem"))
    room = slots.filter("kind is not null").groupBy("qid").agg(F.count(F.lit(1)).alias("room"))
    crowded = results.join(room, "qid").filter(F.size("slots") > F.col("room")).select("qid", F.lit("too many slots").alias("problem"))
    return stray.unionByName(crowded)


def write_submission(rows: DataFrame, to: str) -> None:
    """Writes a submission as one CSV file, in order; its first header begins with a byte-order mark. One row a question: small by nature."""
    named = rows.orderBy("place").drop("place")
    named = named.withColumnRenamed("qid", "﻿qid")
    named.coalesce(1).write.option("header", "true").option("emptyValue", "").csv(to)
