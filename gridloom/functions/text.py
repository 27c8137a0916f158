"""Text functions: Column -> Column, one for each way of normalizing, built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V

#: White space, beyond ASCII too: Java's \s and trim() stop at ASCII. Most characters are told from it by two tests, what
#: Latin texts consist of and whether one lies in the range of the rest; a plain list would be walked for each character.
WS = r"[\t\n\x0b\f\r \u00a0[\u1680-\ufeff&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]]]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"^{WS}+|{WS}+\\z", "")


def squeeze(c: Column | str) -> Column:
    """White space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(col(c), f"{WS}+", " "))


def is_blank(c: Column | str) -> Column:
    return F.coalesce(~col(c).rlike(f"[^{WS[1:-1]}]"), F.lit(True))


def not_blank(c: Column | str) -> Column:
    return ~is_blank(c)


def norm_text(c: Column | str) -> Column:
    """Lower case, white space squeezed: the key under which items are the same."""
    return squeeze(F.lower(col(c)))


def norm_header(c: Column | str) -> Column:
    return squeeze(F.regexp_replace(F.lower(col(c)), "[_/]+", " "))


def bare_header(c: Column | str) -> Column:
    """A normalized header without trailing stops, colons and dashes."""
    return squeeze(F.regexp_replace(norm_header(c), "[:.\\-–—]+\\z", ""))


def strip_markup(c: Column | str) -> Column:
    plain = F.regexp_replace(col(c), r"\\([\\`*_{}\[\]()#+\-.!])", "$1")
    return squeeze(F.regexp_replace(plain, "[*_`~]", ""))


def norm_match(c: Column | str) -> Column:
    """Markdown off, hyphen breaks joined, quotes straight, white space squeezed, lower case."""
    s = F.regexp_replace(col(c), r"\\([\\`*_{}\[\]()#+\-.!])", "$1")
    s = F.regexp_replace(s, "[*_`~]", "")
    s = F.regexp_replace(s, rf"([A-Za-z0-9_])-{WS}+([A-Za-z0-9_])", "$1-$2")
    s = F.translate(s, "‘’“”", "''\"\"")
    return F.lower(squeeze(s))


def tokens(c: Column | str) -> Column:
    """Runs of a-z and 0-9 of the match form, in order, repeats kept."""
    return match_tokens(norm_match(c))


def match_tokens(c: Column) -> Column:
    """The tokens of a text that is in match form already."""
    return F.filter(F.split(F.regexp_replace(c, "[^a-z0-9 ]+", " "), " "), lambda t: t != "")


def let(value: Column, use) -> Column:
    """use(value), with the value computed once, however often use reads it."""
    return F.transform(F.array(value), use)[0]


def in_source(item: Column | str, source: Column | str) -> Column:
    """Whether an item's wording stands in a source, both texts raw.

    Found whole; or what follows its first ': ' (all but the first letter when there is none) is
    found and over 8 characters; or nine tenths of its tokens are. Both texts are normalized once.
    """

    def found(pair):
        needle, hay = pair["needle"], pair["hay"]
        at = F.instr(needle, ": ")
        rest = F.substr(needle, F.when(at > 0, at + 2).otherwise(F.lit(2)))
        whole = (needle == "") | F.contains(hay, needle) | ((F.length(rest) > V.AFTER_COLON) & F.contains(hay, rest))
        return F.when(whole, F.lit(True)).otherwise(let(F.struct(match_tokens(needle).alias("ours"), match_tokens(hay).alias("theirs")), share))

    def share(pair):
        ours = pair["ours"]
        return let(F.array_except(ours, pair["theirs"]), lambda absent: F.size(F.filter(ours, lambda t: ~F.array_contains(absent, t))) >= V.IN_SOURCE * F.size(ours))

    return let(F.struct(norm_match(item).alias("needle"), norm_match(source).alias("hay")), found)


def word_count(c: Column | str) -> Column:
    return F.regexp_count(col(c), F.lit(f"[^{WS[1:-1]}]+"))


def hygiene(c: Column | str) -> Column:
    """Data URIs out; where any was, blank lines squeezed and line ends trimmed too."""
    s = F.regexp_replace(col(c), r"!\[[^\]]*\]\(\s*data:[^)]*\)", "")
    s = F.regexp_replace(s, r"\[([^\]]*)\]\(\s*data:[^)]*\)", "$1")
    s = F.regexp_replace(s, r"(?i)data:[a-z0-9.+-]+/[a-z0-9.+-]+\s*;\s*base64\s*,\s*[A-Za-z0-9+/=]{40,}", "")
    s = F.regexp_replace(F.regexp_replace(s, "\n{3,}", "\n\n"), r"(?m)[ \t]+$", "")
    return F.when(F.contains(col(c), F.lit("data:")), strip(s)).otherwise(col(c))


def binary_chars(c: Column | str) -> Column:
    return F.length(col(c)) - F.length(hygiene(c))


def decode_entities(c: Column | str) -> Column:
    """XML entities, &amp; last; numeric references in decimal and hexadecimal."""
    s = col(c)
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        s = F.replace(s, F.lit(name), F.lit(value))
    for pattern, base in (("&#([0-9]+);", 10), ("(?i)&#x([0-9a-f]+);", 16)):
        parts, codes = F.split(s, pattern), F.regexp_extract_all(s, F.lit(pattern), F.lit(1))
        point = lambda h: F.decode(F.unhex(F.lpad(F.conv(h, base, 16), 8, "0")), "UTF-32")  # noqa: E731, B023
        joined = F.array_join(F.zip_with(parts, codes, lambda p, h: F.concat(p, F.when(h.isNotNull(), point(h)).otherwise(F.lit("")))), "")
        s = F.when(F.size(codes) > 0, joined).otherwise(s)
    return F.replace(s, F.lit("&amp;"), F.lit("&"))


def starts_with_label(text: Column | str, label: Column | str) -> Column:
    """Whether an item opens with a label and a joiner."""
    t, lab = norm_text(text), norm_text(label)
    ends = [F.startswith(t, F.concat(lab, F.lit(j))) for j in (*V.JOINERS, *(f" {j}" for j in V.JOINERS if j != ":"))]
    hit = ends[0]
    for e in ends[1:]:
        hit = hit | e
    return (lab != "") & (t != lab) & hit


def group_matches(a: Column | str, b: Column | str) -> Column:
    x, y = norm_text(a), norm_text(b)
    return F.contains(x, y) | F.contains(y, x)


def char_grams(c: Column | str, n: int = V.GRAM, folded: bool = False) -> Column:
    """Distinct runs of n of the a-z0-9 characters of a text (folded: already lower case and bare).

    A look-ahead matches at every place, so that all runs are cut in one pass.
    """
    flat = col(c) if folded else F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "")
    return F.coalesce(F.array_distinct(F.regexp_extract_all(flat, F.lit(f"(?=(.{{{n}}}))"), F.lit(1))), F.expr("cast(array() as array<string>)"))


def fingerprint(content: Column | str) -> Column:
    """First 16 hexadecimal digits of SHA-256; null stays unknown."""
    return F.substring(F.sha2(col(content).cast("binary"), 256), 1, 16)


def seed(*parts: Column | str) -> Column:
    """Signed 32-bit seed: SHA-256 of the non-empty parts joined by NUL, first four bytes, big-endian."""
    kept = F.filter(F.array(*map(col, parts)), lambda p: p.isNotNull() & (p != ""))
    n = F.conv(F.substring(F.sha2(F.array_join(kept, "\0").cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.when(n > 2147483647, n - 4294967296).otherwise(n).cast("int")


def colour(c: Column | str) -> Column:
    return F.nullif(F.lower(strip(c)), F.lit(""))


def truncate(c: Column | str, n: int = 90) -> Column:
    return F.when(F.length(col(c)) > n, F.concat(F.substring(col(c), 1, n - 1), F.lit("…"))).otherwise(col(c))


def csv_cell(c: Column | str) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def source_format(name: Column | str) -> Column:
    """Format by extension; pdf for all others."""
    out = F.lit("pdf")
    for ext, kind in V.FORMATS:
        out = F.when(F.endswith(F.lower(F.trim(col(name))), F.lit(f".{ext}")), F.lit(kind)).otherwise(out)
    return out


def is_supported(name: Column | str) -> Column:
    return F.lower(F.trim(col(name))).rlike(r"\.(pdf|docx|pptx|xlsx|png|jpg|jpeg)\z")
