from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lakehaul.names import quote

# Columns that tell of a row that could not be read.
BAD_RECORD, BAD_FILE, BAD_REASON = "bad_record", "bad_file", "bad_reason"
# Marks a record with another number of fields than the schema.
_ODD = "_odd_record"
# What is set for a scan of files and means nothing for one record.
_SCAN_ONLY = {"header", "enforceschema", "inferschema", "mode", "columnnameofcorruptrecord"}


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType | str | None = None,
    **options,
) -> DataFrame:
    """A CSV folder whose files start with a header row.

    Without ``schema`` the types are inferred, which reads all the data once more.
    With ``schema`` there is no such pass and one odd value cannot turn a whole
    column into text, so give it for any large folder.  Each file's header must then
    name the schema's columns in their order; ``enforceSchema=True`` takes columns by
    position whatever the header says.  A value that does not fit its type fails the
    job; ``mode="PERMISSIVE"`` makes it null.  ``options`` go to the reader, e.g. ``sep``,
    ``multiLine`` and ``escape``.
    """
    if schema is None:
        return spark.read.options(**{"header": True, "inferSchema": True, **options}).csv(path)
    checked = {"header": True, "enforceSchema": False, "mode": "FAILFAST", **options}
    return spark.read.options(**checked).schema(schema).csv(path)


def read_csv_marked(
    spark: SparkSession, path: str | list[str], schema: StructType | str, **options
) -> DataFrame:
    """A CSV folder in which rows that do not fit the schema are kept and marked.

    Behind the columns of ``schema`` come ``bad_record`` (the record as it stands in the file),
    ``bad_file`` and ``bad_reason``, all null for a row that fits.  A marked row has
    another number of fields than the schema, or a value that does not fit its type; its other
    values are what could be read.  Headers are checked as in ``read_csv``.  One scan.
    """
    columns = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    clash = {BAD_RECORD, BAD_FILE, BAD_REASON, _ODD}.intersection(f.name.lower() for f in columns)
    if clash:
        raise ValueError(f"columns of these names mark bad rows: {', '.join(sorted(clash))}")
    marked = StructType([StructField(f.name, f.dataType) for f in columns] + [StructField(BAD_RECORD, StringType())])
    fixed = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_RECORD}
    reader = spark.read.options(**{"header": True, "enforceSchema": False, **options, **fixed})
    record = F.col(BAD_RECORD)
    return reader.schema(marked).csv(path).select(
        *map(quote, marked.names),
        F.when(record.isNotNull(), F.col("_metadata.file_path")).alias(BAD_FILE),
        F.when(record.isNotNull(), _reason(columns, options)).alias(BAD_REASON),
    )


def _reason(columns: StructType, options: dict) -> Column:
    """Why a record does not fit: each field as text beside what was read of it."""
    texts = StructType([StructField(f.name, StringType()) for f in columns] + [StructField(_ODD, StringType())])
    given = {key: _option(value) for key, value in options.items() if key.lower() not in _SCAN_ONLY}
    fields = F.from_csv(
        F.col(BAD_RECORD), texts.toDDL(), {**given, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _ODD}
    )
    wrong = [
        F.when(
            fields.getField(f.name).isNotNull() & F.col(quote(f.name)).isNull(),
            F.concat(F.lit(f"{f.name}: '"), fields.getField(f.name), F.lit(f"' is no {f.dataType.simpleString()}")),
        )
        for f in columns
    ]
    told = F.concat_ws("; ", *wrong)
    return (
        F.when(fields.getField(_ODD).isNotNull(), F.lit(f"not {len(columns)} fields"))
        .when(told != "", told)
        .otherwise(F.lit("cannot be read"))
    )


def _option(value: object) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def read_folder(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    provider: str = "parquet",
) -> DataFrame:
    """The files of one folder; a given ``schema`` saves opening a file to find it."""
    reader = spark.read.format(provider)
    return (reader.schema(schema) if schema is not None else reader).load(path)
