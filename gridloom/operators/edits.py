"""Edits of reviewers on the long form: items moved to another domain, reworded, marked as reviewed, noted."""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions import vocab as V
from ..functions.headers import synonym_domain
from ..functions.labels import item_key
from ..functions.text import not_blank, strip

PLACE = ["doc_id", "domain", "group_ord", "item_ord"]


EVENT = "at string, action string, fromDomain string, toDomain string, sourceSection string, sourceHeader string, text string, ownGroup string, item_ord int, note string"


def replay(groups: dict[str, list[dict]], move: dict) -> dict | None:
    """Apply one move to a document's groups (name, strip, items, by domain) and return its event; None if no item is there.

    A moved item goes to the end of the General group of its new domain or, back among the unmapped, of the group named like
    its header; the group is made where it is missing. An item whose wording stands there already is not added again.
    Groups that a move leaves empty go, and so later moves count places without them.
    """
    came, goes = move["domain"], move["to_domain"]
    source = groups.get(came, [])
    at, place = move["group_ord"], move["item_ord"]
    if at is None or place is None or not (0 <= at < len(source) and 0 <= place < len(source[at]["items"])):
        return None
    group = source[at]
    item = dict(group["items"][place], mappedBy="user", mappingConfidence="user")
    note = move["note"] or None
    if note:
        item["mappingNote"] = note
    if not item["header"] and group["name"] and group["name"] != "General":
        item["sourceHeader"], item["header"] = group["name"], group["strip"]
        item["sourceSection"] = item["sourceSection"] or group["name"]
    left = [*group["items"][:place], *group["items"][place + 1 :]]
    groups[came] = [g for g in ({**g, "items": left} if i == at else g for i, g in enumerate(source)) if g["items"]]
    back = goes == V.UNMAPPED
    name = (item["header"] or group["name"] or "Unmapped") if back else "General"
    target = groups.setdefault(goes, [])
    there = next((g for g in target if g["name"] == name), None)
    if there is None:
        there = {"name": name, "strip": name.strip(), "items": []}
        target.append(there)
    if all(i["same"] != item["same"] for i in there["items"]):
        there["items"] = [*there["items"], item]
    action = "return_unmapped" if back else "assign_domain" if came == V.UNMAPPED else "remap_domain"
    known = lambda d: None if d == V.UNMAPPED else d
    return {
        "at": move["at"], "action": action, "fromDomain": known(came), "toDomain": known(goes), "sourceSection": item["sourceSection"], "sourceHeader": item["sourceHeader"],
        "text": item["text"], "ownGroup": group["name"], "item_ord": place, "note": note,
    }


def moved(items: DataFrame, moves: DataFrame, families: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, events) after a log of moves: doc_id, domain, group_ord, item_ord, to_domain, note, at, and optionally seq.

    Moves of a document apply in order of at and seq (0 where it is missing), then of their other columns; each names its
    item by the place that it has by then, so an item may move on and on, and every move that meets an item is an event.
    Moves that meet none have no effect. items: the long form with all attributes, blank items included where the
    model has some, as places count them. Documents without moves are left as they are. families: doc_id, layoutFamily of the
    models, for the events. A task holds the items and moves of one document at a time.
    """
    helpers = {"same": F.lower(strip(F.coalesce("text", F.lit("")))), "header": F.coalesce(strip("sourceHeader"), F.lit("")), "strip": F.coalesce(strip("group_name"), F.lit(""))}
    columns = items.columns
    log = moves if "seq" in moves.columns else moves.withColumn("seq", F.lit(0))
    log = log.select(*PLACE, "to_domain", F.coalesce(strip("note"), F.lit("")).alias("note"), "at", F.col("seq").cast("long").alias("seq"))
    log = log.select([F.col(c).alias(f"move_{c}") for c in log.columns])  # moves are often made from the items; names of their own keep the two apart
    item_type, order = items.schema, {d: i for i, d in enumerate(V.GROUPED)}
    out_type = f"item {item_type.simpleString()}, event struct<doc_id:{item_type['doc_id'].dataType.simpleString()},{EVENT.replace(' string', ':string').replace(' int', ':int').replace(', ', ',')}>"

    def fold(found: pa.Table, log: pa.Table) -> pa.Table:
        rows, events = sorted(found.to_pylist(), key=lambda r: (order.get(r["domain"], -1), r["group_ord"], r["item_ord"])), []
        if log.num_rows:
            log = log.rename_columns([c.removeprefix("move_") for c in log.column_names])
            doc_id = log.column("doc_id")[0].as_py()
            groups: dict[str, list[dict]] = {}
            for (domain, _), members in groupby(rows, key=lambda r: (r["domain"], r["group_ord"])):
                members = list(members)
                groups.setdefault(domain, []).append({"name": members[0]["group_name"], "strip": members[0]["strip"], "items": members})
            for move in sorted(log.to_pylist(), key=lambda m: tuple((m[c] is not None, m[c] if m[c] is not None else 0) for c in ("at", "seq", "domain", "group_ord", "item_ord", "to_domain", "note"))):
                if (event := replay(groups, move)) is not None:
                    events.append({"doc_id": doc_id, **event})
            rows = [{**r, "domain": d, "domain_ord": order.get(d), "group_ord": i, "group_name": g["name"], "item_ord": j} for d, gs in groups.items() for i, g in enumerate(gs) for j, r in enumerate(g["items"])]
        rows = [{c: r[c] for c in columns} for r in rows]
        return pa.Table.from_pylist([{"item": r, "event": None} for r in rows] + [{"item": None, "event": e} for e in events], schema=arrow)

    arrow = to_arrow_schema(_parse_datatype_string(out_type))
    both = items.withColumns(helpers).groupBy("doc_id").cogroup(log.groupBy("move_doc_id")).applyInArrow(fold, out_type)
    after = both.where("item is not null").select("item.*")
    found = both.where("event is not null").select("event.*")
    events = found.select(
        "doc_id", "at", F.lit("").alias("fileId"), "action", item_key("sourceHeader", "text", F.col("item_ord")).alias("itemKey"), F.col("text").alias("itemText"), "fromDomain", "toDomain",
        "sourceSection", "sourceHeader", "note", synonym_domain(F.coalesce(F.nullif("sourceHeader", F.lit("")), "ownGroup", F.lit(""))).alias("autoSuggestedDomain"),
    )
    if families is not None:
        events = events.join(families.select("doc_id", "layoutFamily"), "doc_id", "left")
    return after, events


def edited(items: DataFrame, edits: DataFrame) -> DataFrame:
    """Items after edits: PLACE, at, text, reviewed, note; null leaves an attribute as it is. Of several edits of an attribute
    the last counts. A reviewed item is verbatim; a blank text takes the item away."""
    changes = edits.groupBy(*PLACE).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(f"new_{c}") for c in ("text", "reviewed", "note")])
    rows = items.join(changes, PLACE, "left")
    rows = rows.withColumns({"text": F.coalesce("new_text", "text"), "verbatim": F.when(F.col("new_reviewed"), F.lit(True)).otherwise(F.col("verbatim")), "sourceNote": F.coalesce("new_note", "sourceNote")})
    return rows.where(not_blank("text")).select(*items.columns)
