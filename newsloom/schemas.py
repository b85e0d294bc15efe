"""Explicit schemas of the main tables: nothing is inferred, every optional field is nullable."""

from __future__ import annotations

from pyspark.sql import types as T

from newsloom.functions.priority import ASSESSMENT, BILINGUAL

_S, _B = T.StringType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


IDENTITY = _struct(subject=_S, action=_S, object=_S, period=_S, numbers=T.ArrayType(_S), version=_S)
EVIDENCE = _struct(status=_S, level=_S, retrieved_at=_S, sha256=_S, source_published_at=_S, final_url=_S)
SOURCE = _struct(publisher=_S, url=_S)

CARD = _struct(
    id=_S, date=T.DateType(), published_at=_S, headline=BILINGUAL, summary=BILINGUAL, gps=T.ArrayType(_S),
    sectors=T.ArrayType(_S), region=_S, source=SOURCE, review_status=_S, origin=_S, source_headline=_S,
    source_fingerprint=_S, assessment=ASSESSMENT, relevance_reason=_S, event_identity=IDENTITY, evidence=EVIDENCE,
    source_origin=_S, published_basis=_S, source_published_at=_S, observed_at=_S, supersedes_card_id=_S,
    material_update_confirmed=_B,
)
ENTRY = _struct(
    feed=_S, title=_S, url=_S, publisher=_S, published=T.TimestampType(), description=_S, origin=_S,
    domains=T.ArrayType(_S), gps=T.ArrayType(_S), form=_S, discovery=_S, published_basis=_S,
)
CLAIM = _struct(
    claim_id=_S, statement=_S, article_id=_S, evidence_span=_S, amount=T.DoubleType(), currency=_S, unit=_S,
    basis=_S, period=_S,
)
EVIDENCE_RECORD = _struct(
    article_id=_S, title=_S, original_url=_S, canonical_url=_S, publisher=_S, originating_publisher=_S,
    discovery_method=_S, source_kind=_S, published_at=_S, published_date_precision=_S, event_date=_S,
    first_seen_at=_S, retrieved_at=_S, access_status=_S, evidence_scope=_S, evidence_hash=_S,
    evidence_local_ref=_S, claims=T.ArrayType(CLAIM), supersedes_article_id=_S,
)
PAYLOAD = _struct(feed=_S, payload=_S, landed_at=T.TimestampType())
REVIEW = _struct(
    seq=T.LongType(), event_id=_S, revision=_S, content_hash=_S, reviewer_id=_S, reviewed_at=_S, status=_S, notes=_S,
)
SPEND = _struct(
    seq=T.LongType(), kind=_S, request_id=_S, charged_usd=T.DecimalType(18, 6), usage_unknown=_B,
)
