"""Row types of the engine."""

OBSERVATION = "struct<time_ms:bigint,x:int,y:int,width:int,height:int,confidence:double>"
FINDING = f"video_id bigint, id string, type string, value string, modality string, start_ms bigint, end_ms bigint, confidence double, reason string, visual_location string, observations array<{OBSERVATION}>, action string, sources array<string>"
MODEL_FINDING = "type string, value string, modality string, start_seconds double, end_seconds double, confidence double, reason string, visual_location string"
ASSESSMENT = "index int, classification string, confidence double, quality string, reason_codes array<string>"
EVENT = "timestamp string, level string, event string, run_id string, fields map<string,string>"
MANIFEST = "filename string, scenario string, subjects string, region string, size string, motion string, expected_faces int"
ANNOTATIONS = "filename string, width int, height int, fps double, frame_count int, duration_seconds double, placements array<struct<subject:string,region:string,size:string,motion:string>>, frames array<struct<frame:int,faces:array<struct<subject:string,box:array<int>>>>>"
