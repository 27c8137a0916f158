"""Models written as plain dictionaries, for small tests."""

from gridloom.functions import vocab as V
from gridloom.sources.schema import MODEL
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.StringType()), *MODEL.fields, T.StructField("sourceText", T.StringType()), T.StructField("lowLegibility", T.BooleanType()), T.StructField("textOnlyFallback", T.BooleanType())])


def item(value):
    known = dict(value) if isinstance(value, dict) else {"text": value}
    return tuple(known.get(f.name) for f in MODEL["inputs"].dataType["content"].dataType.elementType["items"].dataType.elementType.fields)


def model(doc_id, source=None, low=None, text_only=None, **fields):
    """fields: a domain as {group: [texts or item dictionaries]} or pairs; overview fields and the rest as they are."""
    out = [doc_id]
    for f in MODEL.fields:
        value = fields.get(f.name)
        if f.name in V.GROUPED:
            pairs = value.items() if isinstance(value, dict) else value or ()
            value = ([(name, [item(x) for x in found]) for name, found in pairs],)
        elif f.name in V.OVERVIEW:
            value = (value,)
        out.append(value)
    return (*out, source, low, text_only)


def models(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def groups(row, domain):
    return {g["name"]: [i["text"] for i in g["items"]] for g in row[domain]["content"]}
