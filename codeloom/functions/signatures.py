"""Column builders that read declarations: class headers, fields, parameters, return types."""

from pyspark.sql import Column, functions as F

from codeloom.functions.text import base_type_name, escape_regex, strip  # noqa: F401
from codeloom.schemas import KIND_FIELD, KIND_FUNCTION, KIND_METHOD, KIND_PROPERTY

# --- fixed values: patterns ----------------------------------------------------------
FIELD_TYPE = (
    r"^\s*(?:(?:@[\w.]+\s*)*(?:late|final|const|static|required|covariant)\s+)*"
    r"([\w<>\[\]\{\},?().\s]+?)\s+[\w$]+\s*(?:=.*)?\z"
)
MODIFIERS = r"(?<!\w)(?:static|external|async|sync|factory|late|final|const|required)(?!\w)\s*"
RETURN_CHARS = r"[\w<>{}\[\]\s.,?()]"
_DEFAULT = r"\s*(?:=.*)?\z"
PARAM_THIS = r"(?s)^(required\s+)?this\.([\w$]+)" + _DEFAULT
PARAM_FUNCTION = (
    r"(?s)^(?:(required|covariant)\s+)?((?:[\w$<>?,.\s\[\]]+\s+)?Function\s*\((?:[^)]*?\))?\s*\??)\s+([\w$]+)"
    + _DEFAULT
)
PARAM_TYPED = (
    r"(?s)^(?:(required|covariant)\s+)?((?:[\w$.<>?\[\]\s(),']+?|Function\s*\((?:[^)]*\))?\s*\??))\s+([\w$]+)"
    + _DEFAULT
)
PARAM_BARE = (
    r"^((?:[\w$]+(?:<[\w$,\s<>?]+(?:<[\w$,\s<>?]+>)?\??>)?\??)"
    r"|(?:(?:[\w$<>?,.\s\[\]]+\s+)?Function\s*\((?:[^)]*?\))?\s*\??)|(?:[\w$.]+))\s*\z"
)
BARE_IS_TYPE = (
    r"(?i)[<>?()]|Function|^void\z|^dynamic\z|^Never\z|^Null\z|^Object\z|^bool\z|^int\z|^double\z|^num\z|^String\z"
)
ANNOTATION = r"@\w+(?:\([^)]*\))?"
HOVER_FIELD = r"```dart\s*(?:[\w\s]+\s)?(.+?)\s+"
HOVER_RETURN = (r"```dart\s*(?:static\s+)?(.+?)\s+(?:get\s+)?[\"'`]?", r"[\"'`]?\s*\(")
SNIPPET_FIELD_TAIL = r"\s*(?:;|=)"
SNIPPET_RETURN = (r"(?:get\s+)?", r"\s*\(")

# --- comma lists ---------------------------------------------------------------------
# brackets masked in the pass that is under way still count as brackets until it ends
_NO_BRACKET = "[^()<>\\[\\]{}\ue010-\ue017]"
_PAIRS = [(r"\(", r"\)", "\ue000", "\ue001"), ("<", ">", "\ue002", "\ue003"), (r"\[", r"\]", "\ue004", "\ue005"),
          (r"\{", r"\}", "\ue006", "\ue007")]
_OPENED = "(?:" + "|".join(rf"{o}(?={_NO_BRACKET}*{c})" for o, c, _, _ in _PAIRS) + ")"
_INNER_COMMA = rf"({_OPENED}|\G(?!\A))([^,()<>\[\]{{}}]*),"
_INNER_EXTENDS = rf"({_OPENED}|\G(?!\A))({_NO_BRACKET}*?)(?<!\w)extends(?!\w)"
_COMMA, _EXTENDS = "\ue008", "\ue009"
_INNERMOST = "|".join(rf"{o}{_NO_BRACKET}*+{c}" for o, c, _, _ in _PAIRS)


def _paired(plain: str, depth: int) -> str:
    """Pattern of one or more `plain` characters or bracket pairs that nest at most `depth` deep; never backs off."""
    inside = _NO_BRACKET + "*+"
    for _ in range(depth):
        pairs = "|".join(f"{o}{inside}{c}" for o, c, _, _ in _PAIRS)
        whole, inside = rf"(?:{plain}++|{pairs})++", rf"(?:{_NO_BRACKET}++|{pairs})*+"
    return whole


#: an entry of a list whose brackets are all paired, and a text that is such a list
_ENTRY = _paired(r"[^,()<>\[\]{}]", 3)
_PLAIN_LIST = rf"\A,*+(?:{_ENTRY},*+)*+\z"


def _let(value: Column, body) -> Column:
    """Bind a value that `body` uses more than once, so that it is computed once."""
    return F.transform(F.array(value), body)[0]


def _extract(text: Column, pattern: Column | str, group: int) -> Column:
    """regexp_extract that also takes a pattern column and yields null for no match."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    return _let(F.call_function("regexp_extract", text, pattern, F.lit(group)), lambda f: F.when(f != "", f))


def _masked(text: Column, pattern: str, mark: str) -> Column:
    """Brackets in pairs, and what `pattern` finds inside them, replaced by marks; any depth.

    One pass over the text masks all innermost pairs, so there are as many passes as the pairs nest deep; a running
    count over the bracket characters alone bounds them. Once no pair is left the text is handed on as it is.
    """
    def step(held: Column, _) -> Column:
        def more(t: Column) -> Column:
            t = F.regexp_replace(t, pattern, "$1$2" + mark)
            for opening, closing, left, right in _PAIRS:
                t = F.regexp_replace(t, f"{opening}({_NO_BRACKET}*+){closing}", chr(ord(left) + 16) + "$1" + chr(ord(right) + 16))
            return F.translate(t, "".join(map(chr, range(0xE010, 0xE018))), "".join(map(chr, range(0xE000, 0xE008))))
        return F.when(held["open"] & held["text"].rlike(_INNERMOST), F.struct(more(held["text"]).alias("text"), F.lit(True).alias("open"))) \
            .otherwise(F.struct(held["text"].alias("text"), F.lit(False).alias("open")))
    start = F.struct(text.alias("text"), F.lit(True).alias("open"))
    done = F.aggregate(F.sequence(F.lit(1), F.greatest(_deepest(text), F.lit(1))), start, step, lambda held: held["text"])
    return F.when(text.rlike(r"[(<\[{]"), done).otherwise(text)


def _deepest(text: Column) -> Column:
    """At least how deep pairs can nest: the highest count of open brackets, closing ones without an opening left out."""
    signs = F.split(F.regexp_replace(text, f"{_NO_BRACKET}++", ""), "")
    count = F.aggregate(
        signs, F.struct(F.lit(0).alias("open"), F.lit(0).alias("most")),
        lambda held, sign: _let(
            F.when(sign.isin("(", "<", "[", "{"), held["open"] + 1).otherwise(F.greatest(held["open"] - 1, F.lit(0))),
            lambda now: F.struct(now.alias("open"), F.greatest(held["most"], now).alias("most"))),
        lambda held: held["most"])
    return count


def _unmasked(text: Column) -> Column:
    marks = "".join(left + right for _, _, left, right in _PAIRS)
    return F.replace(F.translate(text, marks + _COMMA, "()<>[]{},"), F.lit(_EXTENDS), F.lit("extends"))


def split_list(text: Column) -> Column:
    """Top-level comma split, entries trimmed, empty ones dropped. Unpaired brackets are plain characters.

    Where all brackets are paired and nest at most three deep, one match reads all entries; other texts are masked first.
    """
    masked = F.transform(F.split(_masked(text, _INNER_COMMA, _COMMA), ","), lambda p: strip(_unmasked(p)))
    plain = F.transform(F.regexp_extract_all(text, F.lit(_ENTRY), 0), strip)
    # most lists are one word or two, which no pattern has to take apart
    parts = F.when(~text.rlike(r"[,()<>\[\]{}]"), F.array(strip(text))).when(text.rlike(_PLAIN_LIST), plain).otherwise(masked)
    return F.filter(parts, lambda p: p != "")


# --- class headers -------------------------------------------------------------------
_BOUNDED = r"(?s)[(<\[{].*?(?<!\w)extends(?!\w)"


def class_relations(detail: Column) -> Column:
    """Struct of three name arrays read from a class header."""
    def clause(header: Column, keyword: str) -> Column:
        pattern = rf"(?s)(?<!\w){keyword}\s+(.+?)\s*(?=(?<!\w)(?:extends|with|implements)\s|[{{\ue006]|\z)"
        found = F.when(header.contains(keyword), _let(_unmasked(F.regexp_extract(header, pattern, 1)), split_list))
        return F.coalesce(found, F.array().cast("array<string>"))

    def read(header: Column) -> Column:
        return F.struct(*[clause(header, keyword).alias(keyword) for keyword in ("extends", "with", "implements")])

    # an `extends` between brackets bounds a type parameter and starts no clause
    return _let(F.when(detail.rlike(_BOUNDED), _masked(detail, _INNER_EXTENDS, _EXTENDS)).otherwise(detail), read)


def relation_rows(relations: Column) -> Column:
    """The three arrays as one array of (rel_kind, ord, target_name)."""
    def tagged(kind: str) -> Column:
        return F.transform(
            relations.getField(kind),
            lambda name, i: F.struct(F.lit(kind).alias("rel_kind"), i.alias("ord"), name.alias("target_name")),
        )
    return F.concat(tagged("extends"), tagged("with"), tagged("implements"))


def lowered_relations(relations: Column) -> Column:
    """All relation names in lower case, cut at their type arguments."""
    names = F.concat(*[relations.getField(k) for k in ("extends", "implements", "with")])
    return F.transform(names, lambda n: F.substring_index(F.lower(n), "<", 1))


# --- declarations --------------------------------------------------------------------
def is_field(kind: Column) -> Column:
    return kind.isin(KIND_FIELD, KIND_PROPERTY)


def field_type(detail: Column) -> Column:
    return strip(_extract(detail, FIELD_TYPE, 1))


def _between(text: Column, opening: str, closing: str) -> Column:
    """Struct of the text before the first opening mark and inside up to the last closing mark; null without both."""
    start = F.instr(text, opening)
    end = F.length(text) - F.instr(F.reverse(text), closing) + 1
    found = (start > 0) & text.contains(closing) & (end > start)
    return F.when(found, F.struct(
        F.substring(text, F.lit(1), start - 1).alias("before"),
        F.substring(text, start + 1, end - start - 1).alias("inside"),
        F.substring(text, start, F.length(text)).alias("tail"),
    ))


def parameter_blocks(detail: Column) -> Column:
    """Struct of the required, optional and named parts of a parameter list."""
    def positional(head: Column, named: Column) -> Column:
        def build(cut: Column) -> Column:
            has = cut.isNotNull() & ~cut["tail"].contains("{")
            return F.struct(
                F.when(has, cut["before"]).otherwise(head).alias("required"),
                F.when(has, cut["inside"]).otherwise(F.lit("")).alias("optional"), named.alias("named"))
        return _let(_between(head, "[", "]"), build)

    def split(whole: Column) -> Column:
        def build(cut: Column) -> Column:
            has = cut.isNotNull() & ~F.substring_index(cut["before"], "[", -1).contains("}")
            parts = F.struct(F.when(has, strip(cut["before"])).otherwise(whole).alias("head"),
                             F.when(has, cut["inside"]).otherwise(F.lit("")).alias("named"))
            return _let(parts, lambda x: positional(x["head"], x["named"]))
        return _let(_between(whole, "{", "}"), build)

    return _let(strip(F.regexp_extract(detail, r"(?s)\((.*)\)", 1)), split)


def _groups(text: Column, pattern: str) -> Column:
    """The three groups of a pattern that takes in the whole text, from one match; a single item where it doesn't."""
    return F.split(F.regexp_replace(text, pattern, "$1\ue000$2\ue000$3"), "\ue000")


def _one_param(piece: Column, named: bool, optional: bool) -> Column:
    no_text = F.lit(None).cast("string")

    def param(name: Column, ptype: Column, required: Column, opt: bool) -> Column:
        return F.struct(
            name.alias("name"), F.regexp_replace(strip(ptype), r"\s+", " ").alias("type"),
            F.lit(named).alias("is_named"), (F.lit(named) & required).alias("is_required"),
            F.lit(opt).alias("is_optional_positional"),
        )

    def own(name: Column) -> Column:
        return param(name, F.concat(F.lit("self_field:"), name), F.regexp_extract(piece, PARAM_THIS, 1) != "", False)

    def bare(text: Column) -> Column:
        marked = piece.startswith("required ")
        shown_as_type = F.lit(named or optional) | text.rlike(BARE_IS_TYPE)
        return F.when(text != "", F.when(shown_as_type, param(no_text, text, marked, optional)).otherwise(
            param(text, F.lit("dynamic"), marked, optional)))

    def typed(parts: Column) -> Column:
        found = param(parts[2], parts[1], parts[0] == "required", optional)
        return F.when(F.size(parts) == 3, found).otherwise(_let(F.regexp_extract(piece, PARAM_BARE, 1), bare))

    # the longer patterns are only asked where the word they need is there
    function = F.when(piece.contains("Function"), _groups(piece, PARAM_FUNCTION))
    plain = _let(F.coalesce(F.when(F.size(function) == 3, function), _groups(piece, PARAM_TYPED)), typed)
    return F.when(piece.contains("this.") & piece.rlike(PARAM_THIS), _let(F.regexp_extract(piece, PARAM_THIS, 2), own)).otherwise(plain)


def _until_unreadable(read: Column) -> Column:
    broken = F.array_position(F.transform(read, lambda p: p.isNull()), True)
    return F.when(broken > 0, F.slice(read, F.lit(1), (broken - 1).cast("int"))).otherwise(read)


def parameters(detail: Column) -> Column:
    """Ordered parameter structs; each block ends at its first unreadable entry."""
    def block(text: Column, named: bool, optional: bool) -> Column:
        return _let(F.transform(split_list(text), lambda p: _one_param(p, named, optional)), _until_unreadable)

    def read(blocks: Column) -> Column:
        every = F.concat(block(blocks["required"], False, False), block(blocks["optional"], False, True),
                         block(blocks["named"], True, False))
        return F.transform(every, lambda p, i: F.struct(
            (i + 1).alias("pos"), p["name"].alias("name"), p["type"].alias("type"), p["is_named"].alias("is_named"),
            p["is_required"].alias("is_required"), p["is_optional_positional"].alias("is_optional_positional"),
        ))

    return _let(parameter_blocks(detail), read)


def constructor_parameters(detail: Column) -> Column:
    """`parameters`, or every `this.x` when the list could not be read but starts with `({this.`."""
    return _let(parameters(detail), lambda read: F.when(
        (F.size(read) == 0) & detail.rlike(r"^\s*\(\s*\{\s*this\.[\w$]+"), own_field_params(detail, True)).otherwise(read))


def own_field_params(text: Column, named: bool | None) -> Column:
    """Every `this.x` in the text as a self-field parameter."""
    flag = F.lit(named).cast("boolean")
    off = F.lit(None if named is None else False).cast("boolean")
    names = F.regexp_extract_all(text, F.lit(r"this\.([\w$]+)"), 1)
    return F.transform(names, lambda n, i: F.struct(
        (i + 1).alias("pos"), n.alias("name"), F.concat(F.lit("self_field:"), n).alias("type"),
        flag.alias("is_named"), off.alias("is_required"), off.alias("is_optional_positional"),
    ))


def _not_void(t: Column) -> Column:
    return _let(t, lambda x: F.when(F.lower(x) != "void", x))


def return_type(detail: Column, name: Column, keep_void: bool = False) -> Column:
    """`keep_void` shows a declared void as such; otherwise it is null like an unknown type."""
    bare = strip(F.regexp_replace(F.regexp_replace(detail, r"@[\w.]+\s*", ""), MODIFIERS, ""))
    pattern = F.concat(F.lit(rf"^({RETURN_CHARS}+?)\s+"), escape_regex(name), F.lit(r"\s*\("))
    found = strip(_extract(bare, pattern, 1))
    return found if keep_void else _not_void(found)


def hover_field_type(text: Column, name: Column) -> Column:
    return strip(_extract(text, F.concat(F.lit(HOVER_FIELD), escape_regex(name)), 1))


def hover_return_type(text: Column, name: Column, keep_void: bool = False) -> Column:
    found = strip(_extract(text, F.concat(F.lit(HOVER_RETURN[0]), escape_regex(name), F.lit(HOVER_RETURN[1])), 1))
    return found if keep_void else _not_void(found)


def _last_type(head: Column) -> Column:
    """The type at the end of a text: its last line, without the plain words in front of the type.

    Words are left out where the line is not indented, or where the line before it ends in a word or an
    annotation; an indented line after other text keeps its modifiers.
    """
    def read(head: Column, line: Column) -> Column:
        before = F.rtrim(F.substring(head, F.lit(1), F.length(head) - F.length(line) - 1), F.lit(" \t\n\x0b\f\r"))
        goes_on = _let(before, lambda b: F.right(b, F.lit(1)).rlike(r"\w") | (b.endswith(")") & b.rlike(r"@\w+\([^)]*\)\z")))
        bare = F.regexp_replace(strip(line), rf"^(?:{ANNOTATION}\s*)+", "")
        typed = _extract(bare, r"\w*+[^\w\s].*\z|\w+\z", 0)
        shown = F.when(line.rlike(r"^\s") & ~goes_on, line).otherwise(typed)
        return strip(F.regexp_replace(shown, ANNOTATION, ""))
    return _let(head, lambda h: _let(F.substring_index(h, "\n", -1), lambda line: read(h, line)))


def _text_before(snippet: Column, name: Column, lead: str, tail: str) -> Column:
    """Text in front of the first place where the name is followed by `tail`."""
    pattern = F.concat(F.lit(r"(?s)^(.*?\S)\s+" + lead), escape_regex(name), F.lit(tail))
    return F.when(snippet.contains(name), _extract(snippet, pattern, 1))


def snippet_field_type(snippet: Column, name: Column) -> Column:
    return _last_type(_text_before(snippet, name, "", SNIPPET_FIELD_TAIL))


def snippet_return_type(snippet: Column, name: Column) -> Column:
    return _not_void(_last_type(_text_before(snippet, name, *SNIPPET_RETURN)))



def is_plain_callable(kind: Column) -> Column:
    return kind.isin(KIND_METHOD, KIND_FUNCTION)
