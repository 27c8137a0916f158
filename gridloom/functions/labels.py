"""Texts and keys of sessions, errors and colours: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V
from .headers import label_of
from .text import col, colour, is_blank, norm_text, squeeze, strip


def surfaces(kind: Column | str) -> Column:
    """Whether an error of this kind (its name) must be shown as it is, and not be passed over by a reading as text only."""
    return F.coalesce(col(kind).isin(*V.SURFACING), F.lit(False))


def friendly_error(message: Column | str, kind: Column | str | None = None, service: str = "The model's service", setting: str = "its key") -> Column:
    """What a user is told about an error's text: the first pattern that it holds, else the text itself.

    Errors that surface are written for the user already and pass through. service, setting: what the caller's model and the
    setting of its key are called.
    """
    text = F.when(F.coalesce(col(message), F.lit("")) == "", F.lit("Something went wrong")).otherwise(col(message))
    out = text
    for pattern, told in reversed(V.ERRORS):
        out = F.when(text.rlike(pattern), F.lit(told.format(service=service, setting=setting))).otherwise(out)
    return out if kind is None else F.when(surfaces(kind), F.coalesce(col(message), F.lit(""))).otherwise(out)


def deck_failure(cause: Column | str, retried: Column | str) -> Column:
    """What is told of a deck that could not be drawn: the cause on one line of a bounded length, and whether to try again."""
    clean = squeeze(F.coalesce(col(cause), F.lit("")))
    short = F.when(F.length(clean) > V.REASON_MOST, F.concat(F.substring(clean, 1, V.REASON_MOST - 1), F.lit("…"))).otherwise(clean)
    what = F.concat(F.lit(V.DECK_FAILED), F.when(short != "", F.concat(F.lit(" ("), short, F.lit(")"))).otherwise(""), F.lit("."))
    return F.concat(what, F.when(col(retried), V.DECK_RETRIED).otherwise(V.DECK_REFUSED))


def prompt_variant(vision: Column, text_track: Column, low_legibility: Column) -> Column:
    base = F.when(vision, F.when(text_track, "vision+text").otherwise("vision-only")).otherwise("text-only")
    return F.concat(base, F.when(low_legibility, "+lowleg").otherwise(""))


def display_name(name: Column | str, part: Column | str) -> Column:
    """A file's name, and the part of it that a split document is."""
    return F.when(F.coalesce(col(part), F.lit("")) == "", col(name)).otherwise(F.concat(col(name), F.lit(" — "), col(part)))


def colour_code(fill: Column | str, border: Column | str) -> Column:
    """Fill and border of an item in one cell."""
    some = lambda c: F.nullif(strip(c), F.lit(""))
    return F.concat_ws(" ", some(fill), F.concat(F.lit("border:"), some(border)))


def record_hash(*columns: str) -> Column:
    """A change key of a record: equal records, nulls among them, have equal keys."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def served_model(response: Column | str) -> Column:
    """The model that an answer says it comes from; null if it does not say."""
    kept = F.try_variant_get(F.try_parse_json(col(response)), "$.modelVersion", "string")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(col(response)), "$.modelVersion", "variant"))
    return F.when(kind == "STRING", F.nullif(strip(kept), F.lit("")))


def payload(data: Column | str) -> Column:
    """Bytes of base64 text; null if it is not valid."""
    return F.try_to_binary(col(data), F.lit("base64"))


def status_label(status: Column | str) -> Column:
    return label_of(col(status), V.STATUS_LABELS)


def fallback_warning(reason: Column | str) -> Column:
    """The warning of a document read as text only, with its reason on one line of a bounded length."""
    clean = squeeze(reason)
    short = F.when(F.length(clean) > V.REASON_MOST, F.concat(F.substring(clean, 1, V.REASON_MOST - 1), F.lit("…"))).otherwise(clean)
    return F.when(is_blank(reason), F.lit(V.TEXT_ONLY)).otherwise(F.concat(F.lit(V.TEXT_ONLY + " Reason: "), short))


def with_fallback(vision: Column, text_only: Column, reason: Column, surfaces: Column) -> Column:
    """What vision read, else the text; an error that must surface is raised instead."""
    return F.when(vision.isNotNull(), vision).when(surfaces, F.raise_error(reason)).otherwise(text_only)


def possibly_no_grid(assessment: Column | str) -> Column:
    return F.coalesce(col(assessment).isin("not_logic_model", "unclear"), F.lit(False))


def has_colour(fill: Column | str, wanted: Column) -> Column:
    """Whether an item has a colour; no colour wanted means all."""
    return F.coalesce(wanted == "", F.lit(True)) | F.coalesce(colour(fill) == wanted, F.lit(False))


def holds(text: Column | str, needle: Column | str) -> Column:
    """Whether a text holds another, case and white space aside."""
    return F.contains(norm_text(text), norm_text(needle))


def colour_notes(kind: Column, has_legend: Column, stamped: Column) -> Column:
    """Notes on what colours mean; stamped: domains of one colour each."""
    names = F.array_join(F.transform(stamped, lambda d: label_of(d, V.FIELD_LABELS)), ", ")
    be = F.when(F.size(stamped) == 1, " is ").otherwise(" are ")
    notes = F.array(F.when((kind == "cross_cutting") & ~has_legend, F.lit(V.COLOUR_NO_KEY)), F.when(F.size(stamped) > 0, F.concat(names, be, F.lit(V.COLOUR_STAMPED))))
    return F.filter(notes, lambda n: n.isNotNull())


def name_list(names: Column, n: Column) -> Column:
    """The first five of n names, and how many more there are."""
    shown = F.array_join(F.slice(names, 1, V.NAMES_MOST), ", ")
    return F.when(n <= V.NAMES_MOST, shown).otherwise(F.concat(shown, F.lit(" and "), (n - V.NAMES_MOST).cast("string"), F.lit(" more")))


def item_key(header: Column | str, text: Column | str, at: Column) -> Column:
    """The key by which a correction names an item: header, wording and place."""
    return F.concat_ws("|", F.substring(F.coalesce(col(header), F.lit("")), 1, 40), F.substring(strip(text), 1, 60), at.cast("string"))


def content_scale(dominant: Column, factor: Column, base: float, large: float, least: float, most: float) -> Column:
    """Scale of a page: image pages from ``least``, others from 1, none above ``most``."""
    return F.least(F.lit(most), F.when(dominant, F.greatest(F.lit(least), large * factor)).otherwise(F.greatest(F.lit(1.0), base * factor)))


def padded_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, pad: float) -> Column:
    """A pixel box as padded fractions of its page."""
    low = lambda v, size: F.greatest(F.lit(0.0), v / size - pad)
    high = lambda v, size: F.least(F.lit(1.0), v / size + pad)
    return F.when(x0.isNotNull(), F.struct(low(x0, width).alias("x0"), low(y0, height).alias("y0"), high(x1, width).alias("x1"), high(y1, height).alias("y1")))

