"""Schemas of what is read."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _D, _B, _TS = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


LINE = _struct(line_id=_S, page_index=_I, page_number=_I, text=_S, confidence=_D, retry_confidence=_D, normalized_bbox=T.ArrayType(_D), disposition=_S)
ELEMENT = _struct(type=_S, bbox=T.ArrayType(_D), content=_S, index=_I, page_index=_I)
CELL = _struct(row=_I, col=_I, row_span=_I, col_span=_I, text=_S, bbox=T.ArrayType(_D))
TABLE = _struct(table_index=_I, page_index=_I, bbox=T.ArrayType(_D), geometry_normalized=_B, status=_S, quality_score=_D, cells=T.ArrayType(CELL))
RESULT = _struct(job_id=_S, full_text=_S, language=_S, document_profile=_S, page_count=_I, lines=T.ArrayType(LINE), elements=T.ArrayType(ELEMENT), tables=T.ArrayType(TABLE), _corrupt_record=_S)
JOB = _struct(job_id=_S, input_name=_S, workflow=_S, input_kind=_S, status=_S, item_count=_I, error=_S, language=_S, document_profile=_S, quality_score=_D, warning_count=_I, pinned=_B, imported_from_job_id=_S, created_at=_TS, started_at=_TS, completed_at=_TS, updated_at=_TS)
PREDICTION = _struct(doc_id=T.LongType(), page_index=_I, rec_texts=T.ArrayType(_S), rec_scores=T.ArrayType(_D), rec_boxes=T.ArrayType(T.ArrayType(_D)), rec_polys=T.ArrayType(T.ArrayType(_D)))
SYNC_EVENT = _struct(event_id=_S, event_type=_S, occurred_at=_TS, tenant_id=_S, device_id=_S, resource_id=_S, resource_version=_I, idempotency_key=_S, evidence_hash=_S, overlay_hash=_S, payload=_S)
AUDIT_EVENT = _struct(event_id=T.LongType(), ts=_TS, user_id=T.LongType(), event_type=_S, value=_D, props=_S)
