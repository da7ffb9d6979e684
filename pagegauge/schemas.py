"""Schemas of the capture data, stated once; readers never infer."""

from __future__ import annotations

# Field names and types of the logged records.
POINT = "struct<x:double,y:double>"
QUAD = f"array<{POINT}>"
BOX = "struct<x:double,y:double,width:double,height:double>"

PROBE_EVENT = (
    "type string, t double, session_id bigint, event_id bigint, source string, warmUp boolean, ok boolean, accepted boolean, "
    f"quad {QUAD}, confidence double, frameAt double, passMs double, intervalMs double, mainMs double, computeMs double, lane string, "
    "opacity double, locked boolean, ready boolean, capturing boolean, countdown double, corners map<string,string>, "
    "key string, shown boolean, trigger string, stillUsed boolean, stillAttempt bigint, grab bigint, frameW int, frameH int, "
    f"doneAt double, cornersFrom string, detector string, bufferAgeMs double, stillCrop {BOX}, input {QUAD}, output {QUAD}, "
    "changed boolean, mode string, reason string, ms double, edited boolean, wholePhoto boolean, fellThrough boolean, "
    "mlSkipped string, separate boolean, attempt bigint"
)
DIAGNOSTICS_EVENT = "v int, seq bigint, t bigint, type string, payload variant, _corrupt_record string"
FLOW_EVENT = (
    "name string, step string, source string, page double, `from` double, `to` double, outcome string, verdict string, "
    "rung double, bytes double, pages double, ms double, code string, recoverable boolean, reason string"
)
LABEL_ITEM = "struct<corners:array<array<double>>,uncertain:array<boolean>,noDocument:boolean,labeller:string,t:string,`from`:string>"
LABELS_DOCUMENT = f"struct<version:int,items:map<string,{LABEL_ITEM}>>"
RESULT_ROW = (
    "run_id string, schema int, suite string, synthetic boolean, scene_id bigint, family string, setting string, variant string, "
    f"ok boolean, accepted boolean, quad {QUAD}, coverage double, confidence double, source string, ms double"
)
PAGE_RECORD = (
    "document_id bigint, page_id bigint, `order` int, revision int, source_revision int, gate_revision int, status string, "
    f"corners {QUAD}, rotation int, finish string, bytes bigint, gate string, error string"
)
