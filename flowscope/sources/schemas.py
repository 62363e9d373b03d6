"""Schemas of recorded sessions. Readers never infer them."""

from __future__ import annotations

from pyspark.sql.types import StructType

FRAME = "id string, timestamp bigint, data string, dimensions struct<width int, height int>, frameNumber bigint, metadata map<string,string>"
EVENT = "id string, type string, timestamp bigint, target struct<x double, y double, width double, height double, elementId string>, data map<string,string>"
REGION = "bounds struct<x double, y double, width double, height double>, changeType string, confidence double, intensity double"
CHANGE = f"changedPixels bigint, changePercentage double, regions array<struct<{REGION.replace(' ', ':', 1).replace(', ', ',')}>>, overallIntensity double"
DISCOVERY = (
    "url string, timestamp bigint, states array<struct<id:string,url:string,title:string,possibleInteractions:bigint>>, "
    "interactions array<struct<id:string,type:string,selector:string,fromState:string,toState:string,successful:boolean>>, "
    "transitions array<struct<id:string,fromState:string,toState:string,interaction:string,count:bigint>>, "
    "stateGraph struct<nodes:array<struct<id:string,label:string>>,edges:array<struct<`from`:string,to:string,label:string>>>, coverage double"
)
BOX = "shot bigint, pos bigint, x double, y double, w double, h double, confidence double, type_no int"
CAPTURE = "id string, timestamp bigint, scrollPosition struct<x:double,y:double>, viewport struct<width:int,height:int>, metrics struct<renderTime:double,paintTime:double,scriptTime:double>"
_BOX = "struct<x:double,y:double,width:double,height:double>"
#: A session document: its eight sections under their own names. Texts stand for parts of free form.
DOCUMENT = (
    "version string, "
    "metadata struct<captureId:string,captureTimestamp:string,"
    "captureEnvironment:struct<platform:string,browserEngine:string,gpuInfo:struct<vendor:string,model:string,driver:string,vram:double,features:array<string>>,displayInfo:struct<resolution:array<double>,dpi:double,colorDepth:double,refreshRate:double,hdr:boolean>>,"
    "targetUrl:string,fidelityScore:struct<overall:double,visual:double,behavioral:double,timing:double,color:double>,"
    "viewportConfigurations:array<struct<name:string,width:double,height:double,deviceScaleFactor:double,userAgent:string,hasTouch:boolean>>,"
    "captureSettings:struct<frameRate:double,colorSpace:string,captureMode:string,interactionDepth:double,scrollStrategy:string,networkThrottling:string>,"
    "edgeCasesDetected:array<struct<type:string,description:string,handlingStrategy:string,occurrences:double>>>, "
    "visualData struct<tensor4D:struct<format:string,dimensions:array<double>,encoding:string,dataUrl:string,compressionRatio:double,temporalResolution:double,spatialResolution:array<double>,bitDepth:double>,"
    "keyframes:array<struct<timestamp:double,significance:string,visualHash:string,deltaFromPrevious:double,associatedEvents:array<string>>>,"
    "depthMaps:array<struct<timestamp:double,resolution:array<double>,encoding:string,dataUrl:string,minDepth:double,maxDepth:double>>,"
    "colorProfiles:array<struct<space:string,gamut:array<array<double>>,whitePoint:array<double>,transferFunction:string>>>, "
    f"molecules array<struct<id:string,type:string,visualSignature:string,bounds:struct<static:{_BOX},dynamic:string,transformations:array<string>,zIndex:double,opacity:double>,properties:string,interactions:map<string,string>,"
    "relationships:array<struct<type:string,target:string,strength:double,bidirectional:boolean,metadata:string>>,lifecycle:string>>, "
    f"stateGraph struct<nodes:array<struct<id:string,visualHash:string,molecules:array<struct<moleculeId:string,properties:map<string,string>,bounds:{_BOX},visible:boolean>>,timestamp:double,frequency:double,stability:double>>,"
    "edges:array<struct<id:string,fromState:string,toState:string,trigger:struct<type:string,details:map<string,string>,conditions:array<string>>,duration:double,probability:double,reversible:boolean,animations:array<string>>>,"
    "initialState:string,terminalStates:array<string>,stateGroups:array<struct<id:string,name:string,states:array<string>,type:string,metadata:string>>>, "
    "executionTrace struct<renderingCommands:array<struct<timestamp:double,type:string,target:string,command:string,duration:double,gpuAccelerated:boolean>>,networkSequence:array<string>,"
    "computedStyles:array<struct<timestamp:double,moleculeId:string,styles:map<string,string>,inherited:array<string>,cascadeOrder:double>>,performanceMetrics:array<struct<timestamp:double,type:string,value:double,context:string>>,"
    "consoleOutput:array<string>,memorySnapshots:array<struct<timestamp:double,heapSize:double,heapUsed:double,external:double,arrayBuffers:double>>>, "
    "behavioralEquations array<struct<id:string,element:string,property:string,equation:string,variables:array<struct<name:string,type:string,range:array<double>,unit:string>>,constraints:struct<min:double,max:double,step:double>,"
    "domain:struct<states:array<string>,timeRange:string,viewports:array<string>,conditions:array<string>>,accuracy:double>>, "
    "validationChecksums struct<visualDataChecksum:string,moleculeTreeChecksum:string,stateGraphChecksum:string,crossValidation:array<struct<source:string,target:string,method:string,score:double,details:string>>>"
)


def of(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
