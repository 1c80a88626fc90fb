"""Text functions as column expressions.

White space is what Python calls so: the Unicode spaces and U+001C to U+001F.
Java's ``(?U)\\s`` lacks the latter, so they are listed.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweft.functions.columns import bind
from lexweft.functions.unicode import compose, fold

WS = r"(?U)[\s\x1C-\x1F]"
MAX_VALUE = 256


def ws_collapse(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(f"{WS}+"), F.lit(" "))


def ws_strip(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(rf"{WS[:4]}\A{WS[4:]}+|{WS[4:]}+\z"), F.lit(""))


def ws_rstrip(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(rf"{WS}+\z"), F.lit(""))


def is_blank(c: Column) -> Column:
    """Whether a string is empty or white space only."""
    return ~F.regexp_like(c, F.lit(r"(?U)[^\s\x1C-\x1F]"))


# The patterns of normalize_markdown and plain_text.
def normalize_markdown(c: Column) -> Column:
    """Line feeds only, no blanks before them, at most two empty lines running, one line feed at the end."""
    lines = F.regexp_replace(c, F.lit(r"\r\n?"), F.lit("\n"))
    lines = F.regexp_replace(lines, F.lit(r"[ \t]+\n"), F.lit("\n"))
    body = ws_strip(F.regexp_replace(lines, F.lit(r"\n{4,}"), F.lit("\n\n\n")))
    return bind(body, lambda b: F.when(b != "", F.concat(b, F.lit("\n"))).otherwise(b))


def plain_text(c: Column) -> Column:
    """Markdown without its fenced blocks, images, link targets and signs, on one line."""
    out = F.regexp_replace(c, F.lit(r"(?s)`{3}.*?`{3}"), F.lit(" "))
    out = F.regexp_replace(out, F.lit(r"!\[[^\]]*\]\([^)]+\)"), F.lit(" "))
    out = F.regexp_replace(out, F.lit(r"\[([^\]]+)\]\([^)]+\)"), F.lit("$1"))
    return ws_strip(ws_collapse(F.translate(out, "#>*_`|~-", "        ")))


def label_key(c: Column) -> Column:
    """The key under which labels are looked up."""
    return ws_strip(ws_collapse(fold(c)))


def slug(c: Column, sign: str, otherwise: str) -> Column:
    """ASCII letters and digits with ``sign`` between."""
    out = F.regexp_replace(c, F.lit("[^a-z0-9]+"), F.lit(sign))
    return F.coalesce(F.nullif(F.btrim(out, F.lit(sign)), F.lit("")), F.lit(otherwise))


def metadata_code(c: Column) -> Column:
    return slug(fold(c), "_", "unknown")


def file_stem(filename: Column) -> Column:
    """A name without its folders and its last suffix; a name that is all suffix is its own stem."""
    base = F.regexp_extract(filename, r"([^/]*)/*\z", 1)
    return F.regexp_replace(base, F.lit(r"(?s)(?<=.)\.[^.]+\z"), F.lit(""))


def document_id(filename: Column, content: Column) -> Column:
    """A slug of the name and twelve digits of the content's SHA-256."""
    return F.concat(slug(F.lower(file_stem(filename)), "-", "documento"), F.lit("-"), F.substring(F.sha2(content, 256), 1, 12))


def safe_filename(name: Column) -> Column:
    """The name of the error record for a file."""
    return F.concat(F.regexp_replace(F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown.pdf")), F.lit(r"[^a-zA-Z0-9_.-]+"), F.lit("-")), F.lit(".error.json"))


#: What is left of usual quotes and dashes after a wrong decoding, and what they read.
_BROKEN = (("\ufffd", ""), ("â€œ", '"'), ("â€\x9d", '"'), ("â€˜", "'"), ("â€™", "'"), ("â€“", "-"), ("â€”", "-"))


def repair_mojibake(c: Column) -> Column:
    """Undoes UTF-8 that was read as Latin-1, for strings as a whole, and what is left of usual quotes and dashes.

    ``c`` stands in it several times and is meant to be a column, not a long expression.
    """
    # Strings with other characters than Latin-1 can't be encoded back; the guard keeps encode from raising.
    latin = F.regexp_like(c, F.lit(r"\A[\x{00}-\x{FF}]*\z"))
    as_text = F.encode(F.when(latin, c).otherwise(F.lit("")), "ISO-8859-1").cast("string")
    repaired = F.when(latin & F.is_valid_utf8(as_text), as_text).otherwise(c)
    for broken, sign in _BROKEN:
        repaired = F.replace(repaired, F.lit(broken), F.lit(sign))
    return F.when(F.regexp_like(c, F.lit("[ÃÂâ]")), repaired).otherwise(c)


def tidy_text(c: Column) -> Column:
    """Text without no-break blanks and control characters, white space collapsed."""
    out = F.replace(c, F.lit("\u00a0"), F.lit(" "))
    out = F.regexp_replace(out, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), F.lit(""))
    return ws_strip(ws_collapse(out))


def clean_text(c: Column) -> Column:
    """Text for people: repaired, composed, without control characters, white space collapsed, null as empty."""
    return bind(F.coalesce(c, F.lit("")), lambda x: bind(repair_mojibake(x), lambda y: tidy_text(compose(y))))


def fit_value(c: Column, most: int = MAX_VALUE) -> Column:
    """At most ``most`` characters: as it is, else the first sentence, else clipped with dots."""
    return bind(ws_strip(ws_collapse(c)), lambda compact: fit_tidy(compact, most))


def fit_tidy(compact: Column, most: int = MAX_VALUE) -> Column:
    """``fit_value`` of a column whose white space is collapsed already."""
    stop = F.instr(compact, F.lit(". "))
    clipped = F.concat(ws_rstrip(F.substring(compact, 1, most - 3)), F.lit("..."))
    sentence = F.when(stop.between(1, most), F.substring(compact, F.lit(1), stop)).otherwise(clipped)
    return F.when(F.char_length(compact) <= most, compact).otherwise(sentence)


def strip_code_fence(c: Column) -> Column:
    """What stands between Markdown fences, if the text opens with one."""

    def inner(body):
        opened = ws_strip(F.regexp_replace(body, F.lit(r"\A```(?:json)?"), F.lit("")))
        closed = ws_strip(F.regexp_replace(opened, F.lit(r"```\n?\z"), F.lit("")))
        return F.when(F.startswith(body, F.lit("```")), closed).otherwise(body)

    return bind(ws_strip(c), inner)


def concat_parts(parts: Column) -> Column:
    """Non-blank parts, stripped, with an empty line between."""
    return F.array_join(F.filter(F.transform(parts, ws_strip), lambda p: p != ""), "\n\n")


def response_text(text: Column, parts: Column) -> Column:
    return F.coalesce(F.nullif(ws_strip(text), F.lit("")), concat_parts(F.coalesce(parts, F.expr("cast(array() as array<string>)"))))


def layout_text(full: Column, segments: Column) -> Column:
    """Slices [start, end) of a text, joined; a missing start is 0."""
    cut = F.transform(segments, lambda s: F.substring(full, F.coalesce(s["start"], F.lit(0)) + 1, s["end"] - F.coalesce(s["start"], F.lit(0))))
    return ws_strip(F.array_join(cut, ""))


def ocr_markdown(full: Column, pages: Column) -> Column:
    """Pages (arrays of lines) under headings; a page without lines shows the whole text; without pages the text alone."""
    page = F.transform(
        pages,
        lambda lines, i: F.concat(
            F.lit("\n\n## Pagina "), (i + 1).cast("string"), F.lit("\n\n"),
            F.when(F.size(lines) == 0, full).otherwise(F.array_join(F.filter(F.transform(lines, ws_strip), lambda x: x != ""), "\n")),
        ),
    )
    return F.when(F.size(pages) > 0, ws_strip(F.array_join(page, "\n"))).otherwise(full)


def warning(stage: str, error: Exception) -> str:
    """What a stage's failure leaves among a document's warnings."""
    return f"{stage}: {type(error).__name__}: {error}"


def float_text(c: Column) -> Column:
    """A double as shortest decimal text: small ones plain down to 0.0001, then with an exponent of two digits."""
    usual = c.cast("string")
    parts = F.split(usual, "E")
    digits = F.replace(F.replace(parts[0], F.lit("."), F.lit("")), F.lit("-"), F.lit(""))
    digits = F.regexp_replace(digits, F.lit("0+$"), F.lit(""))
    power = -F.try_element_at(parts, F.lit(2)).cast("int")
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    plain = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), power - 1), digits)
    mantissa = F.regexp_replace(parts[0], F.lit(r"\.0$"), F.lit(""))
    short = F.concat(mantissa, F.lit("e-"), F.lpad(power.cast("string"), 2, "0"))
    small = (F.abs(c) < 1e-3) & (c != 0)
    return F.when(small & (F.abs(c) >= 1e-4), plain).when(small, short).otherwise(usual)
