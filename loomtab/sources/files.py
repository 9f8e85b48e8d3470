"""Tables from and to CSV and JSON files, under the rules that cells follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtab.functions import cells


def read_cells(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """A headered CSV or TSV file, also compressed by gzip, as trimmed strings.

    Ragged rows fail whichever columns are asked for, and so do headers that are
    empty or occur twice, and files without a header.
    """
    reader = spark.read.option("sep", separator)
    head = reader.option("header", False).csv(path).first()
    names = ["" if c is None else c.strip() for c in (head or [])]
    if not names or "" in names or len(set(names)) != len(names):
        raise ValueError("a table needs a header of distinct, non-empty names")
    # With pruned columns, Spark wouldn't see that a row is ragged; the column of broken rows makes it parse each one whole.
    schema = ", ".join(f"`{n}` string" for n in names)
    lines = spark.read.option("header", True).option("sep", separator).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__broken").option("enforceSchema", True).schema(schema + ", `__broken` string").csv(path)
    checked = lines.select(F.struct(*(F.trim(F.col(f"`{c}`")).alias(c) for c in names)).alias("row"), F.col("__broken").alias("broken"))
    row = F.when(F.col("broken").isNull(), F.col("row")).otherwise(F.raise_error(F.concat(F.lit("a row has another number of cells than the header: "), F.substring("broken", 1, 200))).cast(checked.schema["row"].dataType))
    return checked.select(row.alias("row")).select(*(F.col("row")[c].alias(c) for c in names))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file of one JSON object a line; a line that is none, or not of the schema, fails when it is read."""
    return spark.read.option("mode", "FAILFAST").option("columnNameOfCorruptRecord", "__broken").schema(schema).json(path)


def read_units(spark: SparkSession, path: str, width: int) -> DataFrame:
    """A headerless CSV file of numbers in [0, 1], target last; blanks are missing, values outside are cut off."""
    names = [f"x{k}" for k in range(width - 1)] + ["y"]
    df = spark.read.option("header", False).schema(", ".join(f"{n} string" for n in names)).csv(path)
    return df.select(*(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cells.present_number(F.col(n)))).alias(n) for n in names))


def infer(df: DataFrame, target: str, numeric_share: float = 0.98, id_levels: int = 100, id_share: float = 0.5) -> DataFrame:
    """column, kind (number, category, dropped) and counts for each column of cells, in one aggregation.

    A column is a number if numeric_share of its present cells parse; text with
    more than id_levels distinct values that make up over id_share of its rows
    looks like an identifier and is dropped, as is a column with no present cell.
    """
    aggs = []
    for c in df.columns:
        cell = F.col(f"`{c}`")
        there = ~cells.is_missing(cell)
        aggs.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(there).alias("present"), F.count(F.when(there, cells.parse_number(cell))).alias("numbers"), F.count_distinct(F.when(there, cell)).alias("levels")))
    found = df.agg(F.array(*aggs).alias("all")).select(F.explode("all").alias("c")).select("c.*")
    kind = (
        F.when(F.col("present") == 0, "dropped")
        .when(F.col("numbers") >= numeric_share * F.col("present"), "number")
        .when((F.col("levels") > id_levels) & (F.col("levels") > id_share * F.col("rows")) & (F.col("column") != target), "dropped")
        .otherwise("category")
    )
    return found.withColumn("kind", kind)


def target_last(df: DataFrame, target: str) -> DataFrame:
    return df.select(*(c for c in df.columns if c != target), target)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def storage_plan(df: DataFrame, grid: int = 256) -> DataFrame:
    """column and storage of numeric columns: bits (0 and 1), uint16 (whole numbers of that range), grid (so few distinct values), float32 where that loses nothing, else float64."""
    aggs = []
    for c in df.columns:
        x = F.col(f"`{c}`").cast("double")
        kind = (
            F.when(F.count_if((x != 0) & (x != 1)) == 0, "bits")
            .when(F.count_if((x != F.floor(x)) | (x < 0) | (x > 65535)) == 0, "uint16")
            .when(F.count_distinct(x) <= grid, "grid")
            .when(F.count_if(x.cast("float").cast("double") != x) == 0, "float32")
            .otherwise("float64")
        )
        aggs.append(F.struct(F.lit(c).alias("column"), kind.alias("storage")))
    return df.agg(F.array(*aggs).alias("all")).select(F.explode("all").alias("c")).select("c.*")


def write_packed(df: DataFrame, path: str, task: str, order: str) -> None:
    """A folder for each task, rows in order within each file, columns in the types of their storage plan."""
    types = {"bits": "boolean", "uint16": "int", "grid": "double", "float32": "float", "float64": "double"}
    numbers = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint") and c not in (task, order)]
    plan = {r["column"]: types[r["storage"]] for r in storage_plan(df.select(*numbers)).collect()}
    packed = df.select(*(F.col(f"`{c}`").cast(plan[c]).alias(c) if c in plan else F.col(f"`{c}`") for c in df.columns))
    packed.repartition(task).sortWithinPartitions(task, order).write.partitionBy(task).parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """A packed corpus with booleans as numbers again."""
    df = spark.read.parquet(path)
    return df.select(*(F.col(f"`{c}`").cast("int").alias(c) if t == "boolean" else F.col(f"`{c}`") for c, t in df.dtypes))


def raw_output(df: DataFrame, numbers: dict[str, tuple[float, float, bool, bool]], levels: dict[str, list[str]]) -> DataFrame:
    """Unit codes as cells in original units: numbers by (lo, hi, logged, whole), categories by the nearest of their evenly spaced levels; missing codes stay missing."""
    out = []
    for c in df.columns:
        u = F.col(f"`{c}`")
        if c in numbers:
            lo, hi, logged, whole = numbers[c]
            out.append(cells.format_number(cells.from_unit(u, F.lit(lo), F.lit(hi), F.lit(logged), whole)).alias(c))
        elif c in levels:
            at = F.least(F.lit(len(levels[c]) - 1), F.greatest(F.lit(0), F.floor(u * (len(levels[c]) - 1) + 0.5))).cast("int")
            out.append(F.get(F.array(*map(F.lit, levels[c])), at).alias(c))
        else:
            out.append(u)
    return df.select(*out)
