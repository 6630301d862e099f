"""Readers of the text formats, each a scan of lines with Column expressions. Every reader takes a path, of a file or a folder; where a
line's place matters it is counted within its file, or where stated through all files in order of their paths. Empty lines and short lines give
no row unless stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import first_with_prefix

# Prefixed fields of a corpus line and their columns.
PREFIXES = {"relation": "REL$", "sentence": "sen#", "ner": "ner#", "path": "path#", "pos": "pos#", "lc": "lc#", "rc": "rc#", "lex": "lex#", "trigger": "trigger#"}
TAGS = ["POSITIVE", "NEGATIVE", "UNLABELED"]


#: Files up to which the table of splits is sent to all workers: one row of about 30 bytes for each split of each file.
MOST_FILES = 1_000_000


def _splits(rows: DataFrame, through: bool, *extra: Column) -> DataFrame:
    """One row for each split that was read: its key, the id of its first line and the number of lines before it, in its file or, with
    ``through``, in all files in order of their paths."""
    per = rows.groupBy("file", "_at").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"), *extra)
    w = (Window.orderBy("file", "_at") if through else Window.partitionBy("file").orderBy("_at")).rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))


def _keyed(df: DataFrame) -> DataFrame:
    """A short key of the split: the task that reads it, and a hash that tells the splits of one task apart."""
    return df.withColumns({"_task": F.shiftright("_first" if "_first" in df.columns else "_id", 33), "_split": F.xxhash64("file", "_at")})


def _raw(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    df = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), "value")
    # the text source keeps a line's bytes as they are, so any encoding that extends ASCII can be decoded from them
    return df if encoding == "UTF-8" else df.withColumn("value", F.decode(F.col("value").cast("binary"), encoding))


def _numbered(raw: DataFrame, through: bool) -> DataFrame:
    splits = _keyed(_splits(raw, through)).select("_task", "_split", "_first", "_before")
    if len(raw.inputFiles()) <= MOST_FILES:
        splits = F.broadcast(splits)
    return _keyed(raw).join(splits, ["_task", "_split"]).withColumn("line_no", F.col("_id") - F.col("_first") + F.col("_before") + 1)


def lines(spark: SparkSession, path: str, encoding: str = "UTF-8", through: bool = False) -> DataFrame:
    """(file, line_no, value): every line with its number from 1, empty lines too; with ``through`` numbers go on from file to file, in order of
    their paths.

    A large file is read in splits by many tasks. Each numbers its lines by itself, and the lines of the splits before are added: one
    small row for each split, from a first reading that only counts. No task sees more than its split.
    """
    return _numbered(_raw(spark, path, encoding), through).select("file", "line_no", "value")


def _tabs(df: DataFrame, at_least: int) -> DataFrame:
    return df.withColumn("_f", F.split("value", "\t")).filter(F.size("_f") >= at_least)


def _field(i: int) -> Column:
    return F.get("_f", F.lit(i))


def corpus_records(rows: DataFrame, keys: list[str], drop_last: int = 0) -> DataFrame:
    """[S1, F13] Lines (``value``) as records: label, ent_a, ent_b, then fields by prefix, the first of each, null where missing.
    ``#Document`` lines and lines of fewer than three fields give no row; ``drop_last`` characters are cut from each line (off by default)."""
    if drop_last:
        rows = rows.withColumn("value", F.substring(F.col("value"), F.lit(1), F.greatest(F.length("value") - drop_last, F.lit(0))))
    f = _tabs(rows.filter(~F.col("value").startswith("#Document")), 3)
    return f.select(*keys, _field(0).alias("label"), _field(1).alias("ent_a"), _field(2).alias("ent_b"), *[first_with_prefix(F.col("_f"), p).alias(c) for c, p in PREFIXES.items()])


def corpus_tsv(spark: SparkSession, path: str, drop_last: int = 0) -> DataFrame:
    """[S1] A corpus file."""
    return corpus_records(lines(spark, path), ["file", "line_no"], drop_last)


def value_list(spark: SparkSession, path: str) -> DataFrame:
    """[S2] One trimmed value of each line."""
    return lines(spark, path).select("file", "line_no", F.trim(F.col("value"), F.lit(" \t\r\n")).alias("value"))


def zipped(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """[S3] Column files (or folders of files, read in order of their paths) joined by line; a shorter one gives nulls."""
    out = None
    for name, path in files.items():
        one = lines(spark, path, through=True).select("line_no", F.col("value").alias(name))
        out = one if out is None else out.join(one, "line_no", "full")
    return out


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """[S5] (word, vec ARRAY<FLOAT>) of blank-separated lines."""
    df = lines(spark, path).withColumn("_f", F.split("value", " ")).filter(F.size("_f") > 1)
    return df.select(_field(0).alias("word"), F.slice("_f", F.lit(2), F.size("_f")).cast("array<float>").alias("vec"))


def wide_cells(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """[S6, S12] (tag, arg1, arg2, relation): lines of an optional tag, two arguments and relations, one row for each relation."""
    df = _tabs(lines(spark, path, encoding), 3)
    df = df.withColumn("_t", _field(0).isin(TAGS)).withColumn("_f", F.when(F.col("_t"), F.col("_f")).otherwise(F.concat(F.array(F.lit(None).cast("string")), "_f")))
    return df.select(_field(0).alias("tag"), _field(1).alias("arg1"), _field(2).alias("arg2"), F.explode(F.slice("_f", F.lit(4), F.size("_f"))).alias("relation")).filter("relation <> ''")


def compact_cells(spark: SparkSession, path: str) -> DataFrame:
    """[S7] (arg1, arg2, relation, value): ``a1|a2`` and relations; a score behind an @ is the value, else 1.0."""
    df = _tabs(lines(spark, path), 2).select(F.split(_field(0), r"\|").alias("_a"), F.explode(F.slice("_f", F.lit(2), F.size("_f"))).alias("r"))
    score = F.regexp_extract("r", r"@([-+0-9.eE]+)$", 1)
    return df.select(F.get("_a", F.lit(0)).alias("arg1"), F.get("_a", F.lit(1)).alias("arg2"), F.regexp_replace("r", r"@[-+0-9.eE]+$", "").alias("relation"), F.coalesce(F.nullif(score, F.lit("")).try_cast("double"), F.lit(1.0)).alias("value"))


def tuple_file(spark: SparkSession, path: str, hide: int = 0, limit: int | None = None, seed: int = 0, encoding: str = "ISO-8859-1") -> DataFrame:
    """[S8] (id, arg1, arg2, relation, count, hidden): of each tuple ``hide`` drawn cells are hidden. ``limit`` lines from the start."""
    df = lines(spark, path, encoding, through=True)
    if limit is not None:
        df = df.filter(F.col("line_no") <= limit)
    df = _tabs(df, 3).select(_field(0).alias("id"), F.split(_field(1), r"\|").alias("_a"), F.explode(F.slice("_f", F.lit(3), F.size("_f"))).alias("r"))
    df = df.select("id", F.get("_a", F.lit(0)).alias("arg1"), F.get("_a", F.lit(1)).alias("arg2"), F.regexp_replace("r", r"#\d+$", "").alias("relation"), F.when(F.col("r").rlike(r"#\d+$"), F.regexp_extract("r", r"#(\d+)$", 1).cast("int")).otherwise(1).alias("count"))
    w = Window.partitionBy("id").orderBy(F.xxhash64(F.lit(seed), "id", "relation"), "relation")
    return df.withColumn("hidden", F.row_number().over(w) <= hide)


def triples(spark: SparkSession, path: str, hidden: bool = False, unary: bool = False) -> DataFrame:
    """[S9, S11] (arg1, arg2, relation, hidden): two arguments (one, with ``unary``) and one or more relations of each line."""
    n = 1 if unary else 2
    df = _tabs(lines(spark, path), n + 1)
    return df.select(_field(0).alias("arg1"), (F.lit(None).cast("string") if unary else _field(1)).alias("arg2"), F.explode(F.slice("_f", F.lit(n + 1), F.size("_f"))).alias("relation"), F.lit(hidden).alias("hidden"))


def lookup(spark: SparkSession, path: str, keys: list[int], value: int | None, lower: bool = False) -> DataFrame:
    """[S14] A lookup of tab fields; of repeated keys the last line counts. Without ``value`` the distinct keys; ``lower`` folds them."""
    df = _tabs(lines(spark, path), max([*keys, value or 0]) + 1)
    ks = [(F.lower(_field(k)) if lower else _field(k)).alias(f"k{i}") for i, k in enumerate(keys)]
    if value is None:
        return df.select(*ks).distinct()
    names = [f"k{i}" for i in range(len(keys))]
    return df.select(*ks, _field(value).alias("value"), "line_no").groupBy(*names).agg(F.max_by("value", "line_no").alias("value"))


def multi_lookup(spark: SparkSession, path: str, keys: int = 1, sep: str = "\t") -> DataFrame:
    """[S14] Keys and the distinct values behind them, over all lines of a key."""
    df = lines(spark, path).withColumn("_f", F.split("value", sep)).filter(F.size("_f") > keys)
    names = [f"k{i}" for i in range(keys)]
    flat = df.select(*[_field(i).alias(n) for i, n in enumerate(names)], F.explode(F.slice("_f", F.lit(keys + 1), F.size("_f"))).alias("v")).distinct()
    return flat.groupBy(*names).agg(F.array_sort(F.collect_list("v")).alias("values"))


def documents(spark: SparkSession, folder: str, most: int = 80_000) -> DataFrame:
    """[S15] (file, text) of all files below a folder, long ones trimmed or left out."""
    df = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(folder).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    return trimmed_documents(df, "text", most)


def trimmed_documents(df: DataFrame, text: str, most: int = 80_000) -> DataFrame:
    """[S15] Documents longer than ``most`` characters end after their first ``</POST>``; those without a post are left out."""
    t = F.col(text)
    long = F.coalesce(F.length(t) > most, F.lit(False))
    post = F.contains(t, F.lit("<POST>")) & F.contains(t, F.lit("</POST>"))
    return df.filter(~long | post).withColumn(text, F.when(long, F.substring(t, F.lit(1), F.call_function("instr", t, F.lit("</POST>")) + 6)).otherwise(t))


def regions(docs: DataFrame, key: str, text: str, kinds: tuple[str, ...] = ("HEADLINE", "P", "POST", "TURN")) -> DataFrame:
    """[S16] (key, kind, region_no, block_no, block): text of each marked-up region, cut at empty lines, trimmed; empty blocks left out."""
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(text, F.lit(f"(?s)<{k}>(.*?)</{k}>"), F.lit(1)).alias("r")) for k in kinds])
    r = docs.filter(F.contains(text, F.lit("</"))).select(key, F.explode(found).alias("x")).select(key, "x.kind", F.posexplode("x.r").alias("region_no", "t"))
    b = r.select(key, "kind", "region_no", F.posexplode(F.split("t", "\n\n+")).alias("block_no", "b"))
    return b.select(key, "kind", "region_no", "block_no", F.trim(F.col("b"), F.lit(" \t\r\n")).alias("block")).filter("block <> ''")


def slot_annotations(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    """[S18] Annotation table: slot, label, doc, begin, end, phrase and whether it's right, the header line left out."""
    df = _tabs(lines(spark, path).filter("line_no > 1"), 11)
    out = df.select(_field(1).alias("slot_id"), _field(3).alias("label"), _field(4).alias("doc"), F.try_to_number(_field(5), F.lit("999999999")).cast("int").alias("begin"), F.try_to_number(_field(6), F.lit("999999999")).cast("int").alias("end"), _field(7).alias("phrase"), (_field(10) == "1").alias("state"))
    return out if label is None else out.filter(F.col("label") == label)


def gold_annotations(spark: SparkSession, path: str) -> DataFrame:
    """[S20] (label, arg1, arg2, correct): judgements, the last of each fact."""
    df = _tabs(lines(spark, path), 4).select((_field(0) == "1").alias("correct"), _field(1).alias("label"), _field(2).alias("arg1"), _field(3).alias("arg2"), "line_no")
    return df.groupBy("label", "arg1", "arg2").agg(F.max_by("correct", "line_no").alias("correct"))


def mention_sentences(spark: SparkSession, path: str) -> DataFrame:
    """[S21] (src, dst, sentences): the distinct sentences (last fields) of each pair."""
    df = _tabs(lines(spark, path).filter(~F.col("value").startswith("#Document")), 4)
    flat = df.select(_field(1).alias("src"), _field(2).alias("dst"), F.element_at("_f", -1).alias("s")).distinct()
    return flat.groupBy("src", "dst").agg(F.array_sort(F.collect_list("s")).alias("sentences"))


def rank_file(spark: SparkSession, path: str) -> DataFrame:
    """[S22] (line_no, score, arg1, arg2, gold, predicted) of lines of five fields, or of four with ``arg1|arg2``; numbered through all files."""
    df = _tabs(lines(spark, path, through=True), 4).withColumn("_f", F.when(F.size("_f") == 4, F.concat(F.slice("_f", 1, 1), F.split(_field(1), "[|]"), F.slice("_f", 3, 2))).otherwise(F.col("_f")))
    return df.select("line_no", _field(0).try_cast("double").alias("score"), *[_field(i + 1).alias(c) for i, c in enumerate(("arg1", "arg2", "gold", "predicted"))])


def dense_matrix(spark: SparkSession, path: str, sep: str = r"\s+") -> DataFrame:
    """[S23] (i, j, value) of a matrix written line by line, through all files; empty lines only at the end."""
    df = lines(spark, path, through=True).filter("trim(value) <> ''")
    return df.select((F.col("line_no") - 1).alias("i"), F.posexplode(F.split(F.trim("value"), sep)).alias("j", "v")).select("i", "j", F.col("v").try_cast("double").alias("value"))


def cooccurrence_file(spark: SparkSession, path: str) -> DataFrame:
    """[S24] (target, source, n): a header line names the target of the ``count source`` lines below it, through all files.

    Headers are carried down within each split, and from split to split by one row for each.
    """
    fields = F.split(F.trim("value"), "\t")
    head = F.when((F.size(fields) == 1) & (F.trim("value") != ""), F.get(fields, F.lit(0)))
    raw = _raw(spark, path, "UTF-8").withColumns({"_f": fields, "_head": head})
    splits = _splits(raw, True, F.max_by("_head", F.when(F.col("_head").isNotNull(), F.col("_id"))).alias("_last"))
    above = F.last("_last", ignorenulls=True).over(Window.orderBy("file", "_at").rowsBetween(Window.unboundedPreceding, -1))
    splits = _keyed(splits.withColumn("_above", above)).select("_task", "_split", "_above")
    if len(raw.inputFiles()) <= MOST_FILES:
        splits = F.broadcast(splits)
    w = Window.partitionBy("_task", "_split").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = _keyed(raw).withColumn("_own", F.last("_head", ignorenulls=True).over(w)).filter(F.size("_f") == 2).join(splits, ["_task", "_split"])
    return rows.select(F.coalesce("_own", "_above").alias("target"), _field(1).alias("source"), _field(0).try_cast("bigint").alias("n"))


def load_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """[S4] A table that is built and written once, and read where it is there already."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
