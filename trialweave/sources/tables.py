"""Input tables: catalog tables, parquet folders and CSV files with declared schemas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class TableSpec:
    """Where a logical input lives and how its columns map to our names.

    ``location`` is a path (it contains ``/``) or a catalog name such as ``db.table``.
    ``columns`` maps our column name to the stored one; an empty map keeps all columns.
    ``schema`` is required for CSV and optional elsewhere.
    """

    location: str
    columns: Mapping[str, str] | None = None
    format: str = "parquet"
    schema: T.StructType | None = None


def read_input(spark: SparkSession, spec: TableSpec) -> DataFrame:
    """Scan one input with an explicit projection, so the file scan reads only those columns."""
    if spec.format == "csv":
        if spec.schema is None:
            raise ValueError(f"CSV input {spec.location} needs a schema; types are never inferred")
        df = read_csv(spark, spec.location, spec.schema)
    elif "/" in spec.location:
        df = spark.read.format(spec.format).load(spec.location)
    else:
        df = spark.table(spec.location)
    if not spec.columns:
        return df
    return df.select(*[F.col(stored).alias(ours) for ours, stored in spec.columns.items()])


#: Times in reports keep their microseconds.
CSV_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """CSV with a header line, read with a declared schema; strings stay strings.

    A header that does not name the declared columns in order is an error, not a silent shift.
    """
    reader = spark.read.options(timestampNTZFormat=CSV_TIME, timestampFormat=CSV_TIME)
    return reader.csv(path, schema=schema, header=True, enforceSchema=False, mode="FAILFAST")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system its scheme names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop))


def _available(spark: SparkSession, spec: TableSpec) -> bool:
    if "/" in spec.location:
        return path_exists(spark, spec.location)
    return spark.catalog.tableExists(spec.location)


def resolve_source(
    spark: SparkSession,
    files: Mapping[str, Sequence[TableSpec]],
    tables: Mapping[str, TableSpec],
) -> dict[str, DataFrame]:
    """Pick the inputs of an analysis: files if every input has one, else the tables.

    For each logical input the first existing file candidate is taken.  The choice between
    files and tables is joint: when one input has no file, all inputs come from tables.
    """
    chosen = {
        name: next((spec for spec in candidates if _available(spark, spec)), None)
        for name, candidates in files.items()
    }
    if all(spec is not None for spec in chosen.values()):
        return {name: read_input(spark, spec) for name, spec in chosen.items()}
    missing = [name for name in files if name not in tables or not _available(spark, tables[name])]
    if missing:
        raise FileNotFoundError(f"no file and no table for inputs: {', '.join(sorted(missing))}")
    return {name: read_input(spark, tables[name]) for name in files}


# Column names and types of the case file, in file order.
CASE_SCHEMA = T.StructType(
    [
        T.StructField("gender", T.IntegerType()),
        T.StructField("Age", T.IntegerType()),
        T.StructField("HT", T.IntegerType()),
        T.StructField("T2DM", T.IntegerType()),
        T.StructField("PE", T.IntegerType()),
        T.StructField("CI", T.IntegerType()),
        T.StructField("MI", T.IntegerType()),
        T.StructField("HAEM", T.IntegerType()),
        T.StructField("HyperT", T.IntegerType()),
        T.StructField("CA", T.IntegerType()),
        T.StructField("LTUH", T.IntegerType()),
        T.StructField("CRD", T.IntegerType()),
        T.StructField("CHF", T.IntegerType()),
        T.StructField("CLD", T.IntegerType()),
        T.StructField("CKD", T.IntegerType()),
        T.StructField("WBC", T.DoubleType()),
        T.StructField("NEPER", T.DoubleType()),
        T.StructField("LYMPH", T.DoubleType()),
        T.StructField("HGB", T.IntegerType()),
        T.StructField("PLT", T.IntegerType()),
        T.StructField("CRP", T.DoubleType()),
        T.StructField("PCT", T.DoubleType()),
        T.StructField("PT", T.DoubleType()),
        T.StructField("INR", T.DoubleType()),
        T.StructField("APTT", T.DoubleType()),
        T.StructField("TBIL", T.DoubleType()),
        T.StructField("BUN", T.DoubleType()),
        T.StructField("CREA", T.DoubleType()),
        T.StructField("NTproBNP", T.DoubleType()),
        T.StructField("TNI", T.DoubleType()),
        T.StructField("Lac", T.DoubleType()),
        T.StructField("OIPaO2_FiO2", T.DoubleType()),
        T.StructField("SOFA", T.IntegerType()),
        T.StructField("GCS", T.IntegerType()),
        T.StructField("HR", T.IntegerType()),
        T.StructField("RR", T.IntegerType()),
        T.StructField("BP", T.IntegerType()),
        T.StructField("T", T.DoubleType()),
        T.StructField("CD3_PER", T.DoubleType()),
        T.StructField("CD3_CD4_PER", T.DoubleType()),
        T.StructField("CD3_CD8_PER", T.DoubleType()),
        T.StructField("CD3_CD4__CD3_CD8", T.DoubleType()),
        T.StructField("CD3", T.IntegerType()),
        T.StructField("CD3_CD4", T.IntegerType()),
        T.StructField("CD3_CD8", T.IntegerType()),
        T.StructField("CD3_CD16__CD56_PER", T.DoubleType()),
        T.StructField("CD3_CD16__CD56", T.IntegerType()),
        T.StructField("BCD19PER", T.DoubleType()),
        T.StructField("BCD19", T.IntegerType()),
        T.StructField("N_CT", T.DoubleType()),
        T.StructField("ORF1AB_CT", T.DoubleType()),
        T.StructField("survive_die", T.IntegerType()),
    ]
)
