"""The four stored tables: columns, nullability and declared keys."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


def _schema(*columns: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, not required) for name, kind, required in columns])


_LONG, _INT, _TEXT, _BOOL = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType()
_INSTANT = T.TimestampType()

PROJECTS = _schema(
    ("id", _LONG, True),
    ("name", _TEXT, True),
    ("created_at", _INSTANT, True),
    ("git_url", _TEXT, False),
    ("git_raw_url", _TEXT, False),
)

EMBEDDING_MODELS = _schema(
    ("id", _LONG, True),
    ("provider", _TEXT, True),
    ("model", _TEXT, True),
    ("dimensions", _INT, True),
    ("normalized", _BOOL, True),
    ("configuration", _TEXT, False),
    ("created_at", _INSTANT, True),
)

CODE_DOCUMENTS = _schema(
    ("id", _LONG, True),
    ("document_id", _TEXT, True),
    ("embedding_model_id", _LONG, True),
    ("project_id", _LONG, True),
    ("schema_version", _TEXT, False),
    ("kind", _TEXT, True),
    ("language", _TEXT, False),
    ("namespace", _TEXT, False),
    ("type_name", _TEXT, False),
    ("member", _TEXT, False),
    ("source_file", _TEXT, False),
    ("source_hash", _TEXT, False),
    ("analyzed_at", _INSTANT, False),
    ("embedding_text", _TEXT, True),
    ("embedding_text_hash", _TEXT, True),
    ("embedding", T.ArrayType(T.FloatType(), False), True),
    ("embedding_provider", _TEXT, True),
    ("embedding_dimensions", _INT, True),
    ("metadata", _TEXT, True),
    ("indexed_at", _INSTANT, True),
)

CODE_QUERY_FEEDBACK = _schema(
    ("id", _LONG, True),
    ("project_id", _LONG, True),
    ("question", _TEXT, True),
    ("useful", _BOOL, True),
    ("similarities", T.ArrayType(T.DoubleType(), False), True),
    ("reason", _TEXT, False),
    ("username", _TEXT, True),
    ("created_at", _INSTANT, True),
)


@dataclass(frozen=True)
class TableRules:
    """Declared constraints of one table."""

    schema: T.StructType
    primary_key: tuple[str, ...] = ("id",)
    unique: tuple[tuple[str, ...], ...] = ()
    foreign_keys: dict[str, str] = field(default_factory=dict)

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.schema.fields if not f.nullable]


TABLES: dict[str, TableRules] = {
    "projects": TableRules(PROJECTS, unique=(("name",),)),
    "embedding_models": TableRules(EMBEDDING_MODELS, unique=(("provider", "model", "dimensions"),)),
    "code_documents": TableRules(
        CODE_DOCUMENTS,
        unique=(("document_id", "embedding_model_id"),),
        foreign_keys={"embedding_model_id": "embedding_models", "project_id": "projects"},
    ),
    "code_query_feedback": TableRules(CODE_QUERY_FEEDBACK, foreign_keys={"project_id": "projects"}),
}
