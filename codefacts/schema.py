"""Constants and schemas of the engine's relations."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

#: Texts and bits that an index must hold to be read by its consumers.
MISSING_DOC = "No documentation available."
SCHEME = "cxx"
DEFINITION, READ_ACCESS, WRITE_ACCESS = 1, 8, 4
MAX_OVERLOADS, MAX_ENUM_CASES, MAX_GRAPH_STEPS = 16, 64, 10_000

COMMAND_OBJECT = StructType(
    [
        StructField("directory", StringType()),
        StructField("file", StringType()),
        StructField("command", StringType()),
        StructField("arguments", ArrayType(StringType())),
        StructField("output", StringType()),
    ]
)
PACKAGE_ENTRY = StructType([StructField("path", StringType()), StructField("package", StringType())])
RELATIONSHIP = StructType(
    [StructField("symbol", StringType()), *[StructField(f"is_{k}", BooleanType()) for k in ("definition", "reference", "type_definition", "implementation")]]
)
OCCURRENCE = StructType(
    [
        StructField("task_id", LongType()),
        StructField("relative_path", StringType()),
        StructField("symbol", StringType()),
        *[StructField(c, IntegerType()) for c in ("start_line", "start_char", "end_line", "end_char", "roles")],
    ]
)
