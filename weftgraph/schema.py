"""Schemas of the property graph: one table per node label, one table of typed edges."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, B, D, TS = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.DoubleType(), T.TimestampType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


REPOSITORY = struct(repo_id=S, name=S, path=S, language=S, description=S, last_indexed=TS)
FILE = struct(repo_id=S, id=S, name=S, path=S, extension=S, language=S, lines_of_code=I, content_hash=S)
MODULE = struct(repo_id=S, id=S, name=S, path=S, module_type=S)
CLASS = struct(
    repo_id=S, id=S, name=S, path=S, docstring=S, start_line=I, end_line=I, is_abstract=B, decorators=T.ArrayType(S),
    base_classes=T.ArrayType(S), interfaces=T.ArrayType(S), language_type=S,
)
FUNCTION = struct(
    repo_id=S, id=S, name=S, path=S, class_id=S, signature=S, docstring=S, start_line=I, end_line=I, is_async=B, is_static=B,
    is_method=B, return_type=S, complexity=I, parameters=S, visibility=S,
)
VARIABLE = struct(repo_id=S, id=S, name=S, path=S, var_type=S, scope=S, is_constant=B)
IMPORT = struct(repo_id=S, id=S, name=S, path=S, source=S, is_external=B, symbols=T.ArrayType(S))
INTERFACE = struct(repo_id=S, id=S, name=S, path=S, docstring=S, methods=T.ArrayType(S))
EDGE = struct(
    repo_id=S, rel_type=S, src_id=S, dst_id=S, line_numbers=S, confidence=D, detection_method=S, context=S, visibility=S,
    symbols=S, dependency_type=S, kind=S,
)

NODE_SCHEMAS = {
    "Repository": REPOSITORY, "File": FILE, "Module": MODULE, "Class": CLASS, "Function": FUNCTION,
    "Variable": VARIABLE, "Import": IMPORT, "Interface": INTERFACE,
}

# The labels that the two ends of each edge type must have.
EDGE_LABELS: dict[str, tuple[str, str]] = {
    "CONTAINS_FILE": ("Repository", "File"),
    "CONTAINS_MODULE": ("Repository", "Module"),
    "BELONGS_TO_MODULE": ("File", "Module"),
    "DEFINES_CLASS": ("File", "Class"),
    "DEFINES_FUNCTION": ("File", "Function"),
    "DEFINES_INTERFACE": ("File", "Interface"),
    "HAS_METHOD": ("Class", "Function"),
    "HAS_VARIABLE": ("Class", "Variable"),
    "EXTENDS": ("Class", "Class"),
    "IMPLEMENTS": ("Class", "Class|Interface"),
    "CALLS": ("Function", "Function"),
    "USES_CLASS": ("Function", "Class"),
    "IMPORTS": ("File", "Import"),
    "IMPORTS_FROM": ("File", "File"),
    "DEPENDS_ON": ("File", "File"),
    "INSTANTIATES": ("Function", "Class"),
    "USES_VARIABLE": ("Function", "Variable"),
    "RETURNS_TYPE": ("Function", "Class"),
    "TESTS": ("Function", "Function"),
}
