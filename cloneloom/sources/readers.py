"""Readers and writers: repertoire TSVs, folders, FASTA and FASTQ, JDBC, and results kept by their arguments."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloneloom.functions.scalars import without_suffix

#: Columns of a repertoire that features use, with their types after normalising.
REPERTOIRE = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in ("nucleotide", "aminoAcid")],
        T.StructField("templates", T.IntegerType()),
        T.StructField("frequency", T.DoubleType()),
        T.StructField("productive", T.BooleanType()),
        *[T.StructField(c, T.IntegerType()) for c in ("cdr3Length", "vDeletion", "n1Insertion", "d5Deletion", "d3Deletion", "n2Insertion", "jDeletion")],
        *[T.StructField(c, T.StringType()) for c in ("vFamilyName", "vGeneName", "dFamilyName", "jFamilyName", "jGeneName")],
        *[T.StructField(c, T.IntegerType()) for c in ("vIndex", "n1Index", "dIndex", "n2Index", "jIndex")],
    ]
)
#: Names that a column may bear in a file.
ALIASES = {
    "templates": ("count (templates)", "count (templates/reads)", "count (reads)", "templates"),
    "frequency": ("frequencyCount (%)", "frequency"),
}


def normalize_repertoire(raw: DataFrame) -> DataFrame:
    """A raw table under its one schema: unified names, -1 indexes null, gene names without prefix, unresolved ones null."""
    have = set(raw.columns)

    def find(name: str) -> F.Column | None:
        return next((F.col(f"`{c}`") for c in ALIASES.get(name, (name,)) if c in have), None)

    out = []
    for field in REPERTOIRE:
        if field.name == "productive":
            col = F.col("sequenceStatus") == "In" if "sequenceStatus" in have else F.lit(None)
        else:
            col = find(field.name)
            col = F.lit(None) if col is None else col
        if field.name.endswith("Name"):
            name = F.regexp_replace(col.cast("string"), "^TCRB", "")
            col = F.when(~F.contains(name, F.lit("unresolved")), name)
        elif field.name.endswith("Index"):
            number = col.try_cast("int")
            col = F.when(number != -1, number)
        out.append(col.try_cast(field.dataType).alias(field.name))
    extra = [F.col("sample")] if "sample" in have else []
    return raw.select(*extra, *out)


def read_repertoires(spark: SparkSession, path: str) -> DataFrame:
    """All samples' TSVs of a folder, with the sample from each file's name.

    Files may differ in their headers: those of one header are read together under its names, and the groups are united.
    Finding the headers costs a scan of the text; what reaches the driver is the different headers with their files' names.
    """
    lines = spark.read.text(path).select("value", F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    first = lines.where("at = 0").groupBy("file").agg(F.min_by("value", "n").alias("head"))  # one row a file
    parts = []
    for head, files in first.groupBy("head").agg(F.collect_list("file")).collect():
        names = T.StructType([T.StructField(c, T.StringType()) for c in _unique(head.rstrip("\r").split("\t"))])
        raw = spark.read.option("sep", "\t").option("header", True).option("enforceSchema", True).schema(names).csv(files)
        file = F.element_at(F.split(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), "/"), -1)
        parts.append(normalize_repertoire(raw.withColumn("_file", file).withColumn("sample", without_suffix("_file", ".tsv")).drop("_file")))
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField("sample", T.StringType()), *REPERTOIRE.fields]))
    return reduce(DataFrame.unionByName, parts)


def _unique(names: Sequence[str]) -> list[str]:
    """Header names, repeated ones numbered."""
    return [f"{n}.{names[:i].count(n)}" if n in names[:i] else n for i, n in enumerate(names)]


def read_columns(spark: SparkSession, path: str, places: Sequence[int], names: Sequence[str], sep: str = "\t") -> DataFrame:
    """Columns of a delimited file by place, header and empty cells left out."""
    raw = spark.read.option("sep", sep).option("header", True).csv(path)
    out = raw.select(*[F.col(f"`{raw.columns[i]}`").alias(n) for i, n in zip(places, names)])
    return out.where(" and ".join(f"`{n}` is not null and `{n}` <> ''" for n in names))


def read_any(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A file or folder by its ending: parquet, orc, json, csv or tsv; with another ending by what it holds."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("csv", "tsv"):
        return reader.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)
    if kind in ("orc", "json", "parquet"):
        return reader.format(kind).load(path)
    head = spark.read.text(path).select(F.substring("value", 1, 10_000)).first()
    line = head[0] if head else ""
    if line.startswith(("PAR1", "ORC")):
        return reader.format("parquet" if line.startswith("PAR1") else "orc").load(path)
    if line.lstrip().startswith("{"):
        return reader.json(path)
    return reader.option("header", True).option("sep", "\t" if "\t" in line else ",").csv(path)


def read_folder(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Union of tables by name, absent columns null."""
    first, *rest = [read_any(spark, p) for p in paths]
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def sample_list(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Names of the files in a folder, without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")
    return files.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("sample")).distinct()


def read_jdbc(spark: SparkSession, url: str, table: str, columns: Sequence[str], where: str | None = None, **options) -> DataFrame:
    """A database table with projection and predicate pushed down."""
    df = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().select(*columns)
    return df.where(where) if where else df


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, sequence) of each record (S11); records are split where a line begins with '>'."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("r")).where("trim(r) <> ''")
    lines = F.split("r", r"\r?\n")
    return records.select(F.trim(lines[0]).alias("name"), F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "").alias("sequence"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(name, sequence, quality) of each record of four lines (S11), in the order of the files.

    Files are split where a line begins with '@'.  That cuts a record in two where its quality begins so: a piece of
    three lines, which then goes together with the piece of one line that follows it in its file.
    """
    pieces = spark.read.option("lineSep", "\n@").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    pieces = pieces.withColumn("lines", F.split(F.regexp_replace("value", r"\r?\n?$", ""), r"\r?\n")).withColumn("k", F.size("lines"))
    cut = Window.partitionBy("file").orderBy("at", "n")
    halves = pieces.where("k = 1 or k = 3").withColumn("rest", F.lead(F.col("lines")[0]).over(cut)).where("k = 3")
    whole = pieces.where("k = 4").withColumn("quality", F.col("lines")[3])
    rows = whole.unionByName(halves.withColumn("quality", F.concat(F.lit("@"), "rest")).drop("rest"))
    return rows.orderBy("file", "at", "n").select(F.regexp_replace(F.col("lines")[0], "^@", "").alias("name"), F.col("lines")[1].alias("sequence"), "quality")


@dataclass
class Settings:
    """What a run reads and writes (S12), from a dict, or a file of JSON or of ``name: value`` lines."""

    inputs: list[str] = field(default_factory=list)
    output: str = ""
    options: dict[str, str] = field(default_factory=dict)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Settings:
        import json

        text = "\n".join(r[0] for r in spark.read.text(path).collect())
        if text.lstrip().startswith("{"):
            return cls.of(json.loads(text))
        pairs = (line.split(":", 1) for line in text.split("\n") if ":" in line and not line.lstrip().startswith("#"))
        return cls.of({k.strip(): v.strip() for k, v in pairs})

    @classmethod
    def of(cls, values: dict) -> Settings:
        inputs = values.get("inputs", [])
        inputs = [x.strip() for x in inputs.split(",")] if isinstance(inputs, str) else list(inputs)
        return cls(inputs, values.get("output", ""), {k: v for k, v in values.items() if k not in ("inputs", "output")})


def materialized(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at a path, built and written first if it is not there."""
    if not force:
        try:
            return spark.read.parquet(path)
        except AnalysisException as err:
            if err.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """A table as parquet, csv or tsv by the path's ending."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    writer = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    if kind in ("csv", "tsv"):
        writer.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)
    else:
        writer.parquet(path)
