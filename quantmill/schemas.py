"""Schemas of the logical tables."""

from __future__ import annotations

SPAN = "struct<start:int,end:int>"
COLLECTION = "doc_id bigint, sentence string, normalized_sentence string, values array<double>, units array<string>"
QUANTITY = "doc_id bigint, pos int, unit string, value double"
QUERY = "qid int, query_text string, keywords string, unit string, value double, value2 double, condition string"
RUN = "qid string, doc_id string, rank int, score double"
QREL = "split string, qid string, doc_id string, rel int"
SPARSE = "doc_id bigint, term_id int, w float"
TOKEN_VECTOR = "pid bigint, tok int, vec array<float>"
CONCEPT_INDEX = f"keyword string, unit string, value double, sentence string, value_spans array<{SPAN}>, unit_spans array<{SPAN}>"
CONDITIONS = ("=", ">", "<", "<<")
