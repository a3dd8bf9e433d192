"""Explicit schemas of all record types; nothing is inferred on a hot path."""

from __future__ import annotations

BOX = "struct<x:int,y:int,w:int,h:int>"
MATCH = "struct<type:string,tier:string,label:string,start:int,end:int,value:string>"
MATCHES = f"array<{MATCH}>"
ELEMENT = f"struct<id:int,tag:string,role:string,text:string,label:string,bbox:{BOX},value:string>"
REDACTION = f"struct<type:string,tier:string,token:string,bbox:{BOX},source:string,masked:string>"
TILE = "struct<x:int,y:int,w:int,h:int,tag:string,cls:int,label:string,conf:double>"
DECISIONS = f"struct<escalate:array<{BOX}>,ocrPriority:array<{BOX}>,captchaLike:array<{BOX}>>"
PERCEPTION = f"struct<version:int,model:string,enabled:boolean,tiles:array<{TILE}>,summary:map<string,int>,decisions:{DECISIONS},ms:double,modelMB:double>"
FINDINGS = f"struct<faces:array<{BOX}>,ocr:array<struct<type:string,value:string,bbox:{BOX},region:{BOX}>>,perception:{PERCEPTION},stats:map<string,string>>"
#: One wide record for the nine action variants; ``type`` says which fields count.
ACTION = "struct<amount:int,answer:string,direction:string,key:string,ms:int,options:array<string>,question:string,target:int,text:string,type:string,url:string>"
STEP = "struct<action:string,result:string,subgoal:string,blocked:boolean>"
REQUEST = f"task string, history array<{STEP}>, screenshot_b64 string, imageMime string, dom array<{ELEMENT}>, model string, lessons array<string>, warnings array<string>, verifiedTargets array<struct<id:int,desc:string>>, screenPerception {PERCEPTION}"
RESPONSE = "thought string, action string, done boolean, subgoal string, blocked boolean, model_used string"
FRAME = f"struct<step:int,verdict:string,shot:string,orig:string,regions:array<{REDACTION}>>"
SESSION = f"id string, kind string, task string, started timestamp, ended timestamp, status string, entries array<string>, frames array<{FRAME}>"
ELEMENT_ROWS = "id int, tag string, role string, text string, label string, value string, visible boolean, attrs map<string,string>, start int, stop int"
