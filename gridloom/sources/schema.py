"""Declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

from ..functions import vocab as V

KINDS = {"STRING": T.StringType(), "BOOLEAN": T.BooleanType(), "INT": T.IntegerType(), "DOUBLE": T.DoubleType()}


def flat(fields: str, *more: tuple) -> T.StructType:
    """A struct of 'name KIND' fields and further (name, type) pairs; needs no session."""
    pairs = [f.split() for f in fields.split(",")]
    return T.StructType([T.StructField(n, KINDS[k]) for n, k in pairs] + [T.StructField(n, t) for n, t in more])


def many(kind: T.DataType) -> T.ArrayType:
    return T.ArrayType(kind)


ITEM = flat(
    "text STRING, verbatim BOOLEAN, sourceNote STRING, fillColor STRING, borderColor STRING, sourceSection STRING, sourceHeader STRING, "
    "mappingConfidence STRING, mappedBy STRING, mappingNote STRING, sourcePage INT, sourceColumn INT"
)
GROUP = T.StructType([T.StructField("name", T.StringType()), T.StructField("items", T.ArrayType(ITEM))])
BOX = T.StructType([T.StructField("content", T.ArrayType(GROUP))])
CORRECTION = (
    "at STRING, fileId STRING, action STRING, itemKey STRING, itemText STRING, fromDomain STRING, toDomain STRING, sourceSection STRING, "
    "sourceHeader STRING, note STRING, autoSuggestedDomain STRING, mismatchScore DOUBLE, layoutFamily STRING"
)
REGION = "page DOUBLE, xStart DOUBLE, xEnd DOUBLE, note STRING"

MODEL = T.StructType(
    [T.StructField(f, T.StringType()) for f in V.PLAIN]
    + [T.StructField(f, T.StructType([T.StructField("content", T.StringType())])) for f in V.OVERVIEW]
    + [T.StructField(f, BOX) for f in V.GROUPED]
    + [
        T.StructField("colorLegend", T.StringType()),
        T.StructField("layoutFamily", T.StringType()),
        T.StructField("mappingCorrections", T.ArrayType(flat(CORRECTION))),
        T.StructField("extractionStatus", T.StringType()),
        T.StructField("extractionConfidence", T.StringType()),
        T.StructField("extractionBlockers", T.ArrayType(T.StringType())),
        T.StructField("documentTypeAssessment", T.StringType()),
        T.StructField("documentTypeNote", T.StringType()),
        T.StructField("possiblyMissedRegions", T.ArrayType(flat(REGION))),
    ]
)
OPTIONS = flat("sourceText STRING, lowLegibility BOOLEAN, textOnlyFallback BOOLEAN")
FIXTURE = T.StructType([T.StructField("id", T.StringType()), T.StructField("promptVersion", T.StringType()), T.StructField("options", OPTIONS), T.StructField("raw", MODEL)])
TEXTS = many(T.StringType())
COLUMN = flat("heading STRING, domain STRING", ("items", TEXTS), ("labels", TEXTS), ("splits", T.MapType(T.StringType(), TEXTS)))
SLIDE = flat("title STRING", ("columns", many(COLUMN)))
SPEC = flat("id STRING, label STRING, covers STRING, organization STRING, program STRING, documentTypeAssessment STRING", ("slides", many(SLIDE)))
BUNDLE = flat(
    "textTrack STRING, sourceFormat STRING", ("images", TEXTS), ("imageRefs", many(flat("page INT, column INT"))), ("previewImages", TEXTS), ("warnings", TEXTS)
)
#: Keys that a model must have.
REQUIRED = ("organization", "program", "mission", "targetPopulation", "inputs", "activities", "outputs", "shortTermOutcomes", "mediumTermOutcomes", "longTermOutcomes", "impact")
