"""Tables of the evidence store and helpers for their evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


SCHEMAS: dict[str, dict[str, str]] = {
    "documents": dict(doc_id="string", filename="string", sha256="string", size_bytes="long", media_type="string", doc_kind="string", doc_role="string", page_count="int", uploaded_at="string", started_at="string", finished_at="string", status="string", stage="string", progress="string", error="string"),
    "pages": dict(doc_id="string", page_num="int", image_path="string", ocr_conf="double", ocr_words="int", route="string", text="string", text_source="string", model="string", error="string"),
    "triples": dict(triple_id="string", doc_id="string", page_num="int", subject_type="string", subject_name="string", predicate="string", object_type="string", object_name="string", event_date="string", event_date_basis="string", allegation_ref="string", quote="string", model="string", created_at="string", loaded_at="string"),
    "entities": dict(entity_id="string", entity_type="string", canonical_name="string", merged_into="string", mention_count="long", first_seen="string"),
    "chunks": dict(chunk_id="string", doc_id="string", page_num="int", ord="int", text="string", embedding="array<float>", dims="int", model="string", created_at="string"),
    "entity_links": dict(a_id="string", b_id="string", pairing="string", relation="string", subject_id="string", confidence="double", basis="string", model="string", run_id="string", created_at="string"),
    "reports": dict(report_id="string", objective="string", body="string", model="string", documents="int", assertions="long", created_at="string"),
    "settings": dict(key="string", value="string", updated_at="string"),
}
#: Types of entities, kinds and statuses of documents.
ENTITY_TYPES = ("CLAIM", "DOCUMENT", "EVENT", "LOCATION", "ORG", "PERSON")
TERMINAL = ("done", "failed", "incomplete", "text_only")


def ddl(name: str) -> str:
    return ", ".join(f"{c} {k}" for c, k in SCHEMAS[name].items())


def ensure_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    """df with the column, null where it was missing: additive evolution."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with exactly the table's columns and types."""
    for name, kind in SCHEMAS[table].items():
        df = ensure_column(df, name, kind)
    return df.select(*[F.col(n).cast(k).alias(n) for n, k in SCHEMAS[table].items()])
