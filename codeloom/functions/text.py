"""Column builders for source text: all native expressions."""

from functools import reduce

from pyspark.sql import Column, functions as F, types as T

# --- fixed values: patterns ----------------------------------------------------------
# possessive runs keep the Java matcher from recursing over long literals
STRING_LITERAL = "|".join(
    rf"{q}[^{q}\\]*+(?:\\[^\n\r\x{2028}\x{2029}][^{q}\\]*+)*+{q}" for q in ("\"", "'", "`")
)
LINE_COMMENT = r"//[^\n\r\x{2028}\x{2029}]*"
BLOCK_COMMENT = r"/\*[\s\S]*?\*/"
TYPE_ARGUMENT = r"^[\w\s]+<(.+)>\z"
# every word-boundary suffix of the text in front of an opening parenthesis
CALL_TOKEN = (
    r"(?=((?<!\w)(?:operator [^\w\s()]++|\w[\w$.]*+)"
    r"|(?<=\w)(?:\$[\w$.]*+|[^\w\s()]++))\s*\()"
)
# an opening parenthesis in text written backwards, and what stands before it: all that a call token can be part of
BEFORE_PAREN = r"\(\s*+([^\s()]++(?: rotarepo\w?)?)"
PACKAGE_IMPORT = r"import\s+['\"]package:(\w+)/"

# fixed values: control characters written as \uXXXX, then the short escapes in order
UNICODE_ESCAPED = [*range(0x00, 0x08), 0x0B, *range(0x0E, 0x20), 0x7F]
SHORT_ESCAPES = [("\r\n", "\\n"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\f", "\\f"), ("\b", "\\b")]

# marks the second half of a character outside the basic plane while columns are counted
SURROGATE_FILLER = "\ufdd0"


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def _bare_type(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"\?\z", "")


def _unwrap_once(c: Column) -> Column:
    inner = _bare_type(F.regexp_extract(c, TYPE_ARGUMENT, 1))
    return F.when(inner != "", inner).otherwise(c)


def base_type_name(c: Column) -> Column:
    """Innermost type argument, without library prefix; null for null or empty input."""
    opened = F.length(c) - F.length(F.replace(c, F.lit("<"), F.lit("")))
    core = F.when(opened == 0, _bare_type(c)).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.greatest(opened, F.lit(1))), _bare_type(c), lambda s, _: _unwrap_once(s))
    )
    last = F.substring_index(F.substring_index(core, ".", -1), " ", -1)
    return F.when(c != "", F.when(last != "", last).otherwise(core))


def escape_regex(c: Column) -> Column:
    return F.regexp_replace(c, r"[.*+?^${}()|\[\]\\]", r"\\$0")


def strip_comments_and_strings(c: Column) -> Column:
    no_line = F.regexp_replace(c, LINE_COMMENT, "")
    no_block = F.regexp_replace(no_line, BLOCK_COMMENT, "")
    return F.regexp_replace(no_block, STRING_LITERAL, "")


def sanitize_json(c: Column) -> Column:
    """Escape control characters; text free of them is returned as it is."""
    coded = reduce(
        lambda s, code: F.replace(s, F.lit(chr(code)), F.lit(f"\\u{code:04x}")), UNICODE_ESCAPED, c
    )
    coded = F.when(c.rlike(r"[\x00-\x07\x0b\x0e-\x1f\x7f]"), coded).otherwise(c)
    return reduce(lambda s, pair: F.replace(s, F.lit(pair[0]), F.lit(pair[1])), SHORT_ESCAPES, coded)


def sanitize_nested(c: Column, dtype: T.DataType) -> Column:
    """`sanitize_json` on every string value inside a nested column."""
    if isinstance(dtype, T.StringType):
        return sanitize_json(c)
    if isinstance(dtype, T.ArrayType) and _holds_text(dtype):
        return F.transform(c, lambda x: sanitize_nested(x, dtype.elementType))
    if isinstance(dtype, T.MapType) and _holds_text(dtype.valueType):
        return F.transform_values(c, lambda _, v: sanitize_nested(v, dtype.valueType))
    if isinstance(dtype, T.StructType) and _holds_text(dtype):
        fields = [sanitize_nested(c.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def _holds_text(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _holds_text(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _holds_text(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return any(_holds_text(f.dataType) for f in dtype.fields)
    return isinstance(dtype, T.StringType)


def lines_of(content: Column) -> Column:
    # a single character is found without a pattern
    return F.split(F.replace(content, F.lit("\r\n"), F.lit("\n")), "\n")


def _columns_from(line: Column, start: Column, end: Column | None) -> Column:
    """JavaScript-style substring by UTF-16 columns (swapped ends, clamped below zero)."""
    start = F.greatest(start, F.lit(0))
    if end is None:
        lo, size = start, F.lit(2147483647)
    else:
        end = F.greatest(end, F.lit(0))
        lo, size = F.least(start, end), F.abs(end - start)
    plain = F.substring(line, lo + 1, size)
    widened = F.regexp_replace(line, r"([\x{10000}-\x{10FFFF}])", "$1" + SURROGATE_FILLER)
    wide = F.replace(F.substring(widened, lo + 1, size), F.lit(SURROGATE_FILLER), F.lit(""))
    return F.when(line.rlike(r"[\x{10000}-\x{10FFFF}]"), wide).otherwise(plain)


def slice_range(lines: Column, rng: Column) -> Column:
    """Text of a line/column range; empty when the range leaves the file."""
    sl, sc, el, ec = (rng.getField(n) for n in ("sl", "sc", "el", "ec"))
    first, last = F.get(lines, sl), F.get(lines, el)
    middle = F.slice(lines, sl + 2, F.greatest(el - sl - 1, F.lit(0)))
    body = F.when(sl == el, _columns_from(first, sc, ec)).otherwise(
        F.concat(
            _columns_from(first, sc, None),
            F.lit("\n"),
            F.when(el - sl > 1, F.concat(F.array_join(middle, "\n"), F.lit("\n"))).otherwise(F.lit("")),
            _columns_from(last, F.lit(0), ec),
        )
    )
    inside = rng.isNotNull() & (sl >= 0) & (el >= 0) & (sl < F.size(lines)) & (el < F.size(lines))
    return F.when(inside, body).otherwise(F.lit(""))


def snippet_before(lines: Column, line: Column, above: int = 5) -> Column:
    """The declaration line and up to `above` lines in front of it."""
    start = F.greatest(line - above, F.lit(0))
    end = F.least(F.size(lines), line + 1)
    return F.array_join(F.slice(lines, start + 1, F.greatest(end - start, F.lit(0))), "\n")


def package_imports(content: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(content, F.lit(PACKAGE_IMPORT), 1))


def link_targets(html: Column) -> Column:
    """Distinct targets of links in a web page, the import list of a page."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), 1))


def call_tokens(body: Column) -> Column:
    """Distinct names that are followed by an opening parenthesis.

    CALL_TOKEN looks at every character, so it is shown only the words in front of the parentheses, which are found by
    these: read backwards, a parenthesis comes first.
    """
    words = F.regexp_extract_all(F.reverse(body), F.lit(BEFORE_PAREN), 1)
    return F.array_distinct(F.regexp_extract_all(F.reverse(F.concat(F.lit("("), F.array_join(words, " ("))), F.lit(CALL_TOKEN), 1))


def format_message(template: Column, *args: Column) -> Column:
    """Fill {0}, {1}, ... each at its first occurrence."""
    out = template
    for i, arg in enumerate(args):
        slot = "{%d}" % i
        at = F.instr(out, slot)
        filled = F.concat(F.substring(out, F.lit(1), at - 1), arg, F.substring(out, at + len(slot), F.length(out)))
        out = F.when(at > 0, filled).otherwise(out)
    return out
