"""Reading CSV, JSON and Parquet files, and facts about the files themselves."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scalars import normalise_names
from plumbline.operators.quality import string_columns
from plumbline.sources.records import may_go_on, numbered_lines, records

# Delimiters tried, the words read as missing, encodings tried after UTF-8.
DELIMITERS = (",", ";", "\t", "|")
NULL_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
FALLBACK_ENCODINGS = ("ISO-8859-1", "windows-1252")
CORRUPT = "_corrupt_record"
# The control characters of Latin-1 and the signs that windows-1252 has in their places.
_signs = [(chr(b), bytes([b]).decode("windows-1252", "ignore")) for b in range(0x80, 0xA0)]
WINDOWS_SIGNS = "".join(a for a, b in _signs if b), "".join(b for _, b in _signs)


def _paths(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


class Judged(NamedTuple):
    """What one file was found to be."""

    path: str
    delimiter: str
    encoding: str
    first: bytes  # the first line that is not blank
    goes_on: bool  # whether a line may end inside quotes


def manifest(spark: SparkSession, paths: str | Sequence[str]) -> list[Judged]:
    """Every file below the paths, judged from all of its own lines, in one pass over all files.

    The delimiter is the one with which most lines have as many fields as the first one, and among these the one of
    most fields; a comma if none divides the first line. UTF-8 if every line is valid, else windows-1252 if it has
    bytes that are control characters in Latin-1, else Latin-1, which accepts any byte. The result has a row for each file.
    """
    value = F.col("value")
    plain = F.regexp_replace(value, r'"[^"]*"', "")
    controls = ~F.is_valid_utf8(value) & F.decode(value.cast("binary"), FALLBACK_ENCODINGS[0]).rlike("[\x80-\x9f]")
    lines = numbered_lines(spark, _paths(paths)).select(
        "file", "start", "number", "value", (F.trim(F.replace(value, F.lit("\r"), F.lit(""))) != "").alias("filled"),
        *[(F.length(plain) - F.length(F.replace(plain, F.lit(d), F.lit(""))) + 1).alias(f"w{k}") for k, d in enumerate(DELIMITERS)],
        F.is_valid_utf8(value).alias("valid"), controls.alias("controls"), may_go_on(value).alias("goes_on"),
    )
    widths = [f"w{k}" for k in range(len(DELIMITERS))]
    alike = lines.groupBy("file", "filled", *widths).agg(
        F.count("*").alias("n"), F.min(F.struct("start", "number", F.col("value").cast("binary").alias("value"))).alias("first"),
        F.bool_and("valid").alias("valid"), F.bool_or("controls").alias("controls"), F.bool_or("goes_on").alias("goes_on"),
    )
    head = F.struct(F.col("first.start").alias("start"), F.col("first.number").alias("number"), F.col("first.value").alias("value"), *widths)
    files = alike.groupBy("file").agg(
        F.min(F.when(F.col("filled"), head)).alias("head"), F.collect_list(F.when(F.col("filled"), F.struct("n", *widths))).alias("kinds"),
        F.bool_and("valid").alias("valid"), F.bool_or("controls").alias("controls"), F.bool_or("goes_on").alias("goes_on"),
    )

    def like_first(w: str) -> Column:
        return F.aggregate("kinds", F.lit(0).cast("long"), lambda n, x: n + F.when(x[w] == F.col("head")[w], x["n"]).otherwise(F.lit(0)))

    matches = [like_first(w).alias(f"m{k}") for k, w in enumerate(widths)]
    out = []
    for row in files.select("file", "head", "valid", "controls", "goes_on", *matches).orderBy("file").collect():
        head_ = row["head"]
        scores = {d: (row[f"m{k}"], head_[f"w{k}"]) for k, d in enumerate(DELIMITERS) if head_ and head_[f"w{k}"] > 1}
        encoding = "UTF-8" if row["valid"] else FALLBACK_ENCODINGS[bool(row["controls"])]
        first = bytes(head_["value"]) if head_ else b""
        out.append(Judged(row["file"], max(scores, key=scores.get, default=","), encoding, first, bool(row["goes_on"])))
    return out


def judge_files(spark: SparkSession, paths: str | Sequence[str]) -> list[tuple[str, str]]:
    """Delimiter and encoding of each path; of a folder, those of its first file. See ``manifest``."""
    out = []
    for path in _paths(paths):
        found = manifest(spark, path)
        out.append((found[0].delimiter, found[0].encoding) if found else (",", "UTF-8"))
    return out


def infer_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter of one path; see ``judge_files``."""
    return judge_files(spark, path)[0][0]


def file_facts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Per file: name, bytes, SHA-256 of the whole content, whether it is UTF-8, and a dataset id.

    ``binaryFile`` holds one file per row, so this is for uploads, not for large tables.
    """
    files = spark.read.format("binaryFile").load(_paths(paths))
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    digest = F.sha2("content", 256)
    stamp = F.date_format("modificationTime", "yyyyMMdd_HHmmss")
    clean_stem = F.substring(F.regexp_replace(F.lower(stem), " ", "_"), 1, 20)
    return files.select(
        "path",
        name.alias("file_name"),
        F.col("length").alias("file_size"),
        digest.alias("content_hash"),
        F.is_valid_utf8(F.col("content").cast("string")).alias("is_utf8"),
        F.concat_ws("_", clean_stem, stamp, F.substring(digest, 1, 8)).alias("dataset_id"),
    )


def duplicate_uploads(facts: DataFrame) -> DataFrame:
    """Contents that were stored more than once, with their number of files and the first path."""
    return facts.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("path").alias("first_path")).filter("copies > 1")


def choose_encoding(spark: SparkSession, path: str) -> str:
    """The encoding of one path; see ``judge_files``."""
    return judge_files(spark, path)[0][1]


def null_words(df: DataFrame, words: Sequence[str] = NULL_WORDS) -> DataFrame:
    """Text columns with the words for "missing" as NULL; other values stay as they are."""
    changes = {c: F.when(~F.trim(F.col(c)).isin(list(words)), F.col(c)) for c in string_columns(df)}
    return df.withColumns(changes) if changes else df


def tidy(df: DataFrame) -> DataFrame:
    """Drop all-missing rows and unnamed columns, normalise the names, keep the first of equal names."""
    marked = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # names may differ only in case
    named = [(f"c{i}", c) for i, c in enumerate(df.columns) if not c.startswith("Unnamed")]
    names = normalise_names(c for _, c in named)
    first = [i for i, n in enumerate(names) if n not in names[:i]]
    return marked.select(*[F.col(named[i][0]).alias(names[i]) for i in first]).na.drop(how="all")


# What a text can be read as: a bit for each, so that one aggregation tells what a column holds.
SHORT_INTEGER, INTEGER, LONG_INTEGER, DECIMAL, BOOLEAN, TEXT = (1 << k for k in range(6))
PATTERNS = (
    (SHORT_INTEGER, r"^[+-]?\d{1,15}$"), (INTEGER, r"^[+-]?\d{1,18}$"), (LONG_INTEGER, r"^[+-]?\d{1,38}$"),
    (DECIMAL, r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), (BOOLEAN, r"(?i)^(true|false)$"),
)


def infer_types(df: DataFrame) -> DataFrame:
    """Give text columns the narrowest type that all their values fit, decided in one aggregation.

    Integers keep all digits: those of up to 18 are bigint, longer ones decimal(38, 0). Decimals are doubles unless
    the column has integers too long for a double as well; then it stays text.
    """
    columns = string_columns(df)
    if not columns:
        return df

    def kind(c: str) -> Column:
        # A pattern, not a tried cast: a failing cast raises inside, which is slow on text columns.
        value, chain = F.trim(F.col(c)), F.when(F.col(c).isNull(), 0)
        for bit, pattern in PATTERNS:
            chain = chain.when(value.rlike(pattern), bit)
        return chain.otherwise(TEXT)

    row = df.agg(*[F.bit_or(kind(c)).alias(f"k{i}") for i, c in enumerate(columns)]).first()
    changes = {}
    for i, c in enumerate(columns):
        seen = row[f"k{i}"] or 0
        types = (
            ("bigint", SHORT_INTEGER | INTEGER), ("decimal(38,0)", SHORT_INTEGER | INTEGER | LONG_INTEGER),
            ("double", SHORT_INTEGER | DECIMAL), ("boolean", BOOLEAN),
        )
        found = next((name for name, fits in types if seen and seen | fits == fits), None)
        if found:
            changes[c] = F.trim(F.col(c)).cast(found)
    return df.withColumns(changes) if changes else df


def _names(line: bytes, delimiter: str, encoding: str) -> tuple[str, ...]:
    """The names in the first line. A repeated name gets a number, an empty one becomes unnamed."""
    text = line.decode(encoding, "replace").removeprefix("\ufeff").rstrip("\r")
    fields = next(csv.reader([text], delimiter=delimiter, skipinitialspace=True), [])
    seen: dict[str, int] = {}
    names = []
    for i, name in enumerate(fields):
        name = name if name.strip() else f"Unnamed: {i}"
        seen[name] = seen.get(name, -1) + 1
        names.append(f"{name}.{seen[name]}" if seen[name] else name)
    return tuple(names)


def read_csv(
    spark: SparkSession, paths: str | Sequence[str], *, schema: T.StructType | str | None = None,
    delimiter: str | None = None, encoding: str | None = None, infer: bool = True, multi_line: bool | None = None, errors: str | None = None,
) -> DataFrame:
    """CSV with header. Delimiter and encoding are found for each file by itself, also inside a folder, unless given.

    Every column is read as text, the words for "missing" become NULL, and then types follow: from ``schema`` (by
    position; the right choice for large data, as it saves a pass) or from the values. A value that does not fit the
    schema raises; with ``errors`` it becomes NULL instead and the column of that name maps column to text.
    Line breaks inside quotes belong to their field. Files without any are found in the pass that judges them and read as
    lines; the others are cut at true record ends in parallel (``records``). ``multi_line=False`` tells that there are none,
    ``True`` that there may be some, and either saves the pass if all else is given. UTF-16 and UTF-32 are read as lines.
    """
    paths = _paths(paths)
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    byte_wise = encoding is None or not encoding.upper().replace("-", "").startswith(("UTF16", "UTF32"))
    known = None not in (schema, delimiter, encoding) and (multi_line is not None or not byte_wise)
    alike: dict[tuple, list[str]] = {}
    if known:
        alike[delimiter, encoding, tuple(schema.names), bool(multi_line) and byte_wise] = paths
    else:
        for file in manifest(spark, paths):
            own_delimiter, own_encoding = delimiter or file.delimiter, encoding or file.encoding
            names = tuple(schema.names) if schema is not None else _names(file.first, own_delimiter, own_encoding)
            goes_on = byte_wise and (file.goes_on if multi_line is None else multi_line)
            if names:
                alike.setdefault((own_delimiter, own_encoding, names, goes_on), []).append(unquote(file.path))
        if len(alike) == 1:
            alike = {key: paths for key in alike}
    frames = []
    for (own_delimiter, own_encoding, names, goes_on), own in alike.items():
        text = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        options = {"sep": own_delimiter, "ignoreLeadingWhiteSpace": "true", "mode": "PERMISSIVE", "escape": '"'}
        readable = own_encoding.replace("windows-1252", "ISO-8859-1")
        if goes_on:
            value = F.col("value").cast("string") if readable.upper() == "UTF-8" else F.decode("value", readable)
            found = records(spark, own, own_delimiter).where(~F.col("header"))
            raw = found.select(F.from_csv(value, text.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options).alias("r")).select("r.*")
        else:
            raw = spark.read.options(header=True, encoding=readable, enforceSchema=True, **options).schema(text).csv(own)
        if own_encoding == "windows-1252":
            # Spark reads Latin-1; the two differ only in what Latin-1 has as control characters.
            raw = raw.select(*[F.translate(c, *WINDOWS_SIGNS).alias(c) for c in raw.columns])
        frames.append(null_words(raw.toDF(*names) if schema is not None else tidy(raw.toDF(*names))))
    if not frames:
        return spark.createDataFrame([], schema or T.StructType())
    df = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
    if schema is not None:
        return _typed(df, schema, errors)
    df = df.na.drop(how="all")
    return infer_types(df) if infer else df


def _typed(df: DataFrame, schema: T.StructType, errors: str | None) -> DataFrame:
    text = [f for f in schema.fields if isinstance(f.dataType, T.StringType)]
    if errors is None:
        return df.select(*[F.col(f.name) if f in text else F.trim(F.col(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields])
    tried = {f.name: F.trim(F.col(f.name)).try_cast(f.dataType) for f in schema.fields if f not in text}
    unread = [F.when(value.isNull() & F.col(name).isNotNull(), F.struct(F.lit(name).alias("key"), F.col(name).alias("value"))) for name, value in tried.items()]
    listed = F.map_from_entries(F.array_compact(F.array(*unread))) if unread else F.create_map().cast("map<string,string>")
    return df.select(*[tried.get(f.name, F.col(f.name)).alias(f.name) for f in schema.fields], listed.alias(errors))


def read_json(spark: SparkSession, paths: str | Sequence[str], *, schema=None, array: bool = False) -> DataFrame:
    """JSON lines, or with ``array`` one array of records per file."""
    reader = spark.read.option("multiLine", array)
    return (reader.schema(schema) if schema is not None else reader).json(_paths(paths))


def read_parquet(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return spark.read.parquet(*_paths(paths))


def read_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """By suffix: .csv, .txt, .tsv, .json, .parquet."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "json":
        return read_json(spark, path, **options)
    if suffix == "parquet":
        return read_parquet(spark, path)
    if suffix == "tsv":
        options.setdefault("delimiter", "\t")
    return read_csv(spark, path, **options)


def read_batch(spark: SparkSession, paths: Sequence[str], schema: T.StructType, delimiter: str = ",") -> DataFrame:
    """Many CSV files as one table with ``source_file``; a bad file only yields corrupt rows of its own."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    rows = (
        spark.read.option("header", True).option("sep", delimiter).option("ignoreLeadingWhiteSpace", True)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(full).csv(list(paths))
    )
    return rows.withColumn("source_file", F.element_at(F.split("_metadata.file_path", "/"), -1))


def batch_report(rows: DataFrame, key: str = "source_file") -> DataFrame:
    """Per source: rows, rows that did not fit the schema and rows without any value."""
    bad = F.col(CORRUPT).isNotNull()
    values = [F.col(c) for c in rows.columns if c not in (CORRUPT, "source_file", key)]
    return rows.groupBy(key).agg(
        F.count("*").alias("n_rows"),
        F.count_if(bad).alias("corrupt_rows"),
        F.count_if(F.coalesce(*[v.cast("string") for v in values]).isNull()).alias("empty_rows"),
        (F.count_if(bad) == 0).alias("succeeded"),
    )


def field_count_report(spark: SparkSession, paths: str | Sequence[str], delimiter: str = ",") -> DataFrame:
    """Lines per file and number of fields, from the raw lines; delimiters inside quotes do not count."""
    lines = spark.read.text(_paths(paths)).select(
        "value", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("source_file")
    ).filter(F.trim("value") != "")
    quoteless = F.regexp_replace("value", r'"[^"]*"', "")
    fields = F.char_length(quoteless) - F.char_length(F.replace(quoteless, F.lit(delimiter), F.lit(""))) + 1
    return lines.groupBy("source_file", fields.alias("n_fields")).agg(F.count("*").alias("n_lines"))


def file_report(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """One row for a CSV file: validity, errors, rows, columns, delimiter and encoding."""
    from pyspark.errors import AnalysisException

    try:
        first = spark.read.text(path).limit(1).collect()
    except AnalysisException as error:
        raise FileNotFoundError(path) from error
    schema = "is_valid boolean, errors string, row_count bigint, column_count int, delimiter string, encoding string"
    if not first:
        return spark.createDataFrame([(False, "file is empty", 0, 0, None, None)], schema)
    delimiter = delimiter or infer_delimiter(spark, path)
    columns = len(next(csv.reader([first[0][0]], delimiter=delimiter)))
    counts = field_count_report(spark, path, delimiter)
    wrong = F.sum(F.when(F.col("n_fields") != columns, F.col("n_lines")).otherwise(0))
    return counts.agg(F.coalesce(wrong, F.lit(0)).alias("wrong"), F.sum("n_lines").alias("lines")).select(
        (F.col("wrong") == 0).alias("is_valid"),
        F.when(F.col("wrong") > 0, F.format_string("column count differs in %d lines", "wrong")).otherwise("").alias("errors"),
        (F.col("lines") - 1).alias("row_count"),
        F.lit(columns).alias("column_count"),
        F.lit(delimiter).alias("delimiter"),
        F.lit(choose_encoding(spark, path)).alias("encoding"),
    )


def fixed_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in the order of a seeded hash of the key: the same rows in every run, and in any engine with MD5."""
    return df.orderBy(F.md5(F.concat_ws("-", F.lit(seed), F.col(key).cast("string")).cast("binary")), key).limit(n)
