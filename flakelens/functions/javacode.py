"""Method and field spans of a Java source held in one column.

One regular expression cuts the text into statements, each ending with its
``{``, ``}`` or ``;`` (braces inside strings, character literals and comments do
not count), and one ``aggregate`` folds over the statements with a stack of
open blocks.  A block is a method when the text before its ``{`` looks like a
method header, at whatever depth: methods of nested and anonymous classes are
found too.

The fold costs time linear in the text, needs no shuffle and stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import count_of, let, lines, span_slice

_OPAQUE = (
    r'"""(?:[^"\\]++|\\.|"(?!""))*+"""'
    r'|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
    r"|'(?:\\[^\n]{1,6}?|[^'\\\n])'"
    r"|/\*.*?\*/"
    r"|//[^\n]*+"
)
_STATEMENTS = r"(?s)(?:[^\"'/{};]++|" + _OPAQUE + r"|[\"'/])*+[{};]"
_PIECES = r"(?s)" + _OPAQUE + r"|[^\"'/]++|[\"'/]"
_IS_OPAQUE = r"(?s)^(?:\".|'.|//|/\*)"
_ARGS = r"\([^()]*+(?:\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)[^()]*+)*+\)"
_MODIFIERS = (
    r"(?s)^(?:\s++"
    r"|@(?!interface\b)[\w.$]++(?:\s*" + _ARGS + r")?"
    r"|(?:public|protected|private|static|final|abstract|synchronized|native"
    r"|default|strictfp|transient|volatile)\b)*+"
)
_HEADER = r"(?s)^(.*?)(?<![\w$])([\w$]+)\s*" + _ARGS + r"\s*(?:throws\s[^=(]*|default\s.*)?$"
_TYPE = r"(?s)^(?:[\w$.,<>\[\]?&\s]+[\s>\]])$"
_NOT_A_TYPE = r"^(?:return|new|throw|else|case|do|assert|import|package|record)\b"
_CONTROL = r"^\s*+(?:else\s++)?(?:if|for|while|switch|catch|synchronized|try|do|else|return)\b"
_CLASS = r"(?s)(?:^|[\s)])@?(?:class|interface|enum|record)\s+[\w$]+"
_CLASS_NAME = r"\b(?:class|enum|record)\s+([\w$]+)"
_ANONYMOUS = r"(?s)\bnew\s[^;={}]*\)\s*$"
_ASSIGNMENT = r"(?s)(?:^|[^=!<>])=(?:[^=]|$)"
_FIELD = (
    r"(?s)^[\w$.]+(?:\s*<[^=;(]*>)?(?:\s*\[\s*\])*\s+([\w$]+)\s*(?:\[\s*\])*\s*(?:[=,].*)?$"
)

# The fold copies its state at every step, so the state holds no nested data:
# the block stack and the results are strings with these separators.
_BLOCK_SEP, _PART_SEP, _FIELD_SEP, _ROW_SEP = "\u0001", "\u0002", "\u0003", "\n"
_STATE = ("line", "column", "head", "head_column", "open", "methods", "fields")
_METHOD, _CLASS_BLOCK, _PLAIN = "m", "c", "b"


def _pack(*parts: Column) -> Column:
    return F.concat_ws(_FIELD_SEP, *[p.cast("string") for p in parts])


def _modifiers(head: Column) -> Column:
    return F.regexp_extract(head, _MODIFIERS, 0)


def _method_of(state: Column, class_names: Column) -> Column:
    """Method a header opens (end not yet known), or null."""
    head = state["head"]

    def from_parts(parts: Column) -> Column:
        return F.when(
            F.size(parts) == 2,
            let(_modifiers(parts[0]), lambda mods: from_mods(parts[0], parts[1], mods)),
        )

    def from_mods(prefix: Column, name: Column, mods: Column) -> Column:
        kind = F.substring(prefix, F.length(mods) + 1, F.length(prefix))
        is_ctor = F.rlike(kind, F.lit(r"(?s)^(?:<.*>\s*)?$"))
        is_method = F.rlike(kind, F.lit(_TYPE)) & ~F.rlike(kind, F.lit(_NOT_A_TYPE))
        # position counted back from the end of the header, where we stand now
        rest = F.substring(head, F.length(mods) + 1, F.length(head))
        breaks = count_of(rest, "\n")
        column = (
            F.when(breaks == 0, state["column"] - F.length(rest))
            .when(F.contains(mods, F.lit("\n")), F.length(F.substring_index(mods, "\n", -1)) + 1)
            .otherwise(state["head_column"] + F.length(mods))
        )
        annotations = F.when(
            F.contains(mods, F.lit("@")),
            F.array_join(
                F.regexp_extract_all(
                    F.regexp_replace(mods, _ARGS, ""), F.lit(r"@([\w.$]+)"), F.lit(1)
                ),
                ",",
            ),
        ).otherwise(F.lit(""))

        def packed(flag: str) -> Column:
            return _pack(name, state["line"] - breaks, column, annotations, F.lit(flag))

        return F.when(is_ctor & F.array_contains(class_names, name), packed("1")).when(
            ~is_ctor & is_method, packed("0")
        )

    return F.when(
        F.contains(head, F.lit("(")) & ~F.rlike(head, F.lit(_CONTROL)),
        let(
            F.split(F.regexp_replace(head, _HEADER, "$1" + _PART_SEP + "$2"), _PART_SEP, 2),
            from_parts,
        ),
    )


def _top(state: Column) -> Column:
    """Innermost open block: kind, restore flag, head column, line, head, method."""
    return F.substring_index(state["open"], _BLOCK_SEP, -1)


def _part(block: Column, number: int) -> Column:
    return F.try_element_at(F.split(block, _PART_SEP, -1), F.lit(number))


def _in_class(state: Column) -> Column:
    return F.startswith(_top(state), F.lit(_CLASS_BLOCK))


def _next(state: Column, **new: Column) -> Column:
    return F.struct(*[new.get(n, state[n]).alias(n) for n in _STATE])


def _added(rows: Column, row: Column) -> Column:
    return F.concat(rows, row, F.lit(_ROW_SEP))


def _on_open(state: Column, class_names: Column) -> Column:
    head, column = state["head"], state["column"]

    def pushed(kind: Column, restore: Column, saved: Column, method: Column) -> Column:
        block = F.concat_ws(
            _PART_SEP, kind, restore, state["head_column"].cast("string"),
            state["line"].cast("string"), saved, method,
        )
        return _next(
            state, column=column + 1, head=F.lit(""), head_column=column + 1,
            open=F.concat(state["open"], F.lit(_BLOCK_SEP), block),
        )

    def other_block(anonymous: Column) -> Column:
        kind = F.when(anonymous | F.rlike(head, F.lit(_CLASS)), F.lit(_CLASS_BLOCK)).otherwise(
            F.lit(_PLAIN)
        )
        unfinished = (
            anonymous
            | (F.contains(head, F.lit("(")) & (count_of(head, "(") > count_of(head, ")")))
            | (
                F.contains(head, F.lit("="))
                & _in_class(state)
                & F.rlike(F.regexp_replace(head, _ARGS, ""), F.lit(_ASSIGNMENT))
            )
        )
        return F.when(unfinished, pushed(kind, F.lit("1"), head, F.lit(""))).otherwise(
            pushed(kind, F.lit("0"), F.lit(""), F.lit(""))
        )

    def push(method: Column) -> Column:
        anonymous = F.contains(head, F.lit("new")) & F.rlike(head, F.lit(_ANONYMOUS))
        return F.when(
            method.isNotNull(), pushed(F.lit(_METHOD), F.lit("0"), F.lit(""), method)
        ).otherwise(let(anonymous, other_block))

    return let(_method_of(state, class_names), push)


def _on_close(state: Column) -> Column:
    column = state["column"]

    def popped(block: Column, **new: Column) -> Column:
        rest = F.length(state["open"]) - F.length(block) - 1
        return _next(
            state, **{
                "column": column + 1, "head": F.lit(""), "head_column": column + 1,
                "open": F.substring(state["open"], F.lit(1), F.greatest(rest, F.lit(0))), **new,
            }
        )

    def resumed(block: Column) -> Column:
        # the braces as one unit that keeps its line breaks
        breaks = F.repeat(F.lit("\n"), state["line"] - _part(block, 4).try_cast("int"))
        return popped(
            block, head=F.concat(_part(block, 5), F.lit("{"), breaks, F.lit("}")),
            head_column=_part(block, 3).try_cast("int"),
        )

    def pop(block: Column) -> Column:
        is_method = F.startswith(block, F.lit(_METHOD))
        unfinished = F.startswith(F.substring(block, 2, 2), F.lit(_PART_SEP + "1"))
        row = _pack(_part(block, 6), state["line"], column)
        return F.when(is_method, popped(block, methods=_added(state["methods"], row))).when(
            unfinished, resumed(block)
        ).otherwise(popped(block))

    return let(_top(state), pop)


def _on_statement_end(state: Column, class_names: Column) -> Column:
    head, column = state["head"], state["column"]

    def finish(method: Column) -> Column:
        body = F.substring(head, F.length(_modifiers(head)) + 1, F.length(head))
        is_field = F.rlike(body, F.lit(_FIELD)) & ~F.rlike(body, F.lit(_NOT_A_TYPE))
        field = _pack(
            F.regexp_extract(body, _FIELD, 1), state["line"] - count_of(body, "\n"), state["line"]
        )
        def done(**rows: Column) -> Column:
            return _next(state, column=column + 1, head=F.lit(""), head_column=column + 1, **rows)

        return F.when(
            method.isNotNull(),
            done(methods=_added(state["methods"], _pack(method, state["line"], column))),
        ).when(is_field, done(fields=_added(state["fields"], field))).otherwise(done())

    return let(_method_of(state, class_names), finish)


def _masked(text: Column) -> Column:
    """Blank out strings, character literals and comments; line breaks stay."""
    pieces = F.transform(
        F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)),
        lambda t: F.when(F.rlike(t, F.lit(_IS_OPAQUE)), F.regexp_replace(t, r"[^\n]", " "))
        .otherwise(t),
    )
    return F.when(F.rlike(text, F.lit("[\"'/]")), F.array_join(pieces, "")).otherwise(text)


def _moved(state: Column, text: Column, breaks: Column) -> dict[str, Column]:
    """Line and column behind a text."""
    return {
        "line": state["line"] + breaks,
        "column": F.when(breaks > 0, F.length(F.substring_index(text, "\n", -1)) + 1)
        .otherwise(state["column"] + F.length(text)),
    }


def _advance(state: Column, text: Column, breaks: Column) -> Column:
    """State at a delimiter that needs the header text before it."""
    return _next(
        state,
        **_moved(state, text, breaks),
        head=F.concat(state["head"], _masked(text)),
        head_column=F.when(state["head"] == "", state["column"])
        .otherwise(state["head_column"]),
    )


def scan(content: Column) -> Column:
    """``struct<methods: array<method>, fields: array<field>, unclosed: boolean>``.

    ``unclosed`` says that blocks were still open at the end: a cut or broken
    source, whose later spans are not to be trusted.
    """
    # bound once per row: inside the fold it would be evaluated per statement
    return let(
        F.regexp_extract_all(content, F.lit(_CLASS_NAME), F.lit(1)),
        lambda class_names: _fold(content, class_names),
    )


def _fold(content: Column, class_names: Column) -> Column:
    def event(statement: Column) -> Column:
        return let(
            F.left(statement, F.length(statement) - 1),
            lambda text: F.struct(
                F.right(statement, F.lit(1)).alias("kind"), text.alias("text"), count_of(text, "\n").alias("breaks")
            ),
        )

    # every ``let`` here copies a state: what a statement says is bound before the fold
    def step(state: Column, e: Column) -> Column:
        moved = _moved(state, e["text"], e["breaks"])
        headed = _advance(state, e["text"], e["breaks"])
        return (
            F.when(e["kind"] == "{", let(headed, lambda s: _on_open(s, class_names)))
            .when(e["kind"] == "}", let(_next(state, **moved), _on_close))
            .when(_in_class(state), let(headed, lambda s: _on_statement_end(s, class_names)))
            .otherwise(_next(state, line=moved["line"], column=moved["column"] + 1, head=F.lit("")))
        )

    zero = F.struct(
        F.lit(1).alias("line"), F.lit(1).alias("column"), F.lit("").alias("head"),
        F.lit(1).alias("head_column"), *[F.lit("").alias(n) for n in _STATE[4:]],
    )
    # the added delimiter ends a rest without one; searching for it again from
    # every position of that rest would take quadratic time
    separators = _BLOCK_SEP + _PART_SEP + _FIELD_SEP
    clean = F.concat(
        F.when(F.rlike(content, F.lit(f"[{separators}]")), F.translate(content, separators, "   ")).otherwise(content),
        F.lit("\n;"),
    )
    return F.aggregate(
        F.transform(F.regexp_extract_all(clean, F.lit(_STATEMENTS), F.lit(0)), event), zero, step,
        lambda s: F.struct(
            F.array_sort(
                _rows(s["methods"], _method_row),
                lambda a, b: F.when(a["start"] < b["start"], -1)
                .when(a["start"] > b["start"], 1).otherwise(0),
            ).alias("methods"),
            _rows(s["fields"], _field_row).alias("fields"),
            (s["open"] != "").alias("unclosed"),
        ),
    )


def _rows(packed: Column, make) -> Column:
    rows = F.filter(F.split(packed, _ROW_SEP), lambda r: r != "")
    return F.transform(rows, lambda r: let(F.split(r, _FIELD_SEP, -1), make))


def _int(part: Column) -> Column:
    return part.try_cast("int")


def _method_row(p: Column) -> Column:
    def position(at: int) -> Column:
        return F.struct(_int(p[at]).alias("line"), _int(p[at + 1]).alias("column"))

    return F.struct(
        p[0].alias("name"), position(1).alias("start"), position(5).alias("end"),
        F.filter(F.split(p[3], ","), lambda a: a != "").alias("annotations"),
        (p[4] == "1").alias("is_constructor"),
    )


def _field_row(p: Column) -> Column:
    return F.struct(
        p[0].alias("name"), _int(p[1]).alias("start_line"), _int(p[2]).alias("end_line")
    )


def methods(content: Column) -> Column:
    """Method and constructor spans in order of their start."""
    return scan(content)["methods"]


def fields(content: Column) -> Column:
    return scan(content)["fields"]


def code_of(content: Column, method: Column) -> Column:
    return span_slice(content, method["start"]["line"], method["end"]["line"])


def last_named(found: Column, name: Column) -> Column:
    """Last method with the name, by position in the file."""
    return F.try_element_at(F.filter(found, lambda m: m["name"] == name), F.lit(-1))


def package_statement(content: Column) -> Column:
    name = F.regexp_extract(content, r"(?m)^\s*package\s+([\w.]+)\s*;", 1)
    return F.when(name != "", F.concat(F.lit("package "), name, F.lit(";")))


def import_lines(content: Column) -> Column:
    return F.filter(lines(content), lambda x: F.rlike(x, F.lit(r"^\s*import ")))


def without_imports(content: Column) -> Column:
    kept = F.filter(lines(content), lambda x: ~F.rlike(x, F.lit(r"^\s*import ")))
    return F.array_join(kept, "\n")


def without_header(content: Column, anchor: str = "package ") -> Column:
    """Text from the anchor on; unchanged when there is no anchor.

    The head before the anchor is removed wherever it occurs again.
    """
    head = F.substring_index(content, anchor, 1)
    return F.when(
        F.contains(content, F.lit(anchor)),
        F.when(head == "", content).otherwise(F.replace(content, head, F.lit(""))),
    ).otherwise(content)


def clean_code(content: Column) -> Column:
    return without_imports(without_header(content))


