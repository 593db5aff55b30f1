"""Method and field spans of sources of any size, from their lines.

``javacode.scan`` folds over a whole source in one task.  Here a source is cut into
chunks of lines, and nothing needs more than one chunk of a source at a time.

1. Lexer.  What is left open at the end of a chunk (nothing, a comment, a text block)
   is a function of what was open at its start: it is worked out for all three cases at
   once, and a fold over the chunks of a source (one small row each) picks the case that
   holds.  Strings and comments are blanked; lines and columns stay.
2. Brackets.  A chunk is summed up by its depth change and its lowest depth; running
   sums of these give the depth at which each chunk starts, and so every statement's
   depth and the block it lies in.
3. Statements.  The statements directly inside one block, blocks inside them left out,
   are a stream of their own.  The rules of ``javacode`` fold over each stream chunk by
   chunk.  What a chunk of a stream starts with (text of an unfinished statement, a block
   still open) is what the one before ends with: all are first folded as if that were
   nothing, and those for which it was something are folded again.
4. A few rules ask whether the block around a statement is a class.  Streams are folded
   for both answers; the block's own kind, known from its header, chooses.

Rows equal those of ``javacode.scan``.  One difference: a comment or text block that is
never closed reaches to the end of the source; such a source counts as unclosed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import javacode as java
from ..functions.text import count_of, let
from ..session import stored
from . import scans

CHUNK_LINES = 2_000
_CODE, _COMMENT, _TEXT = 0, 1, 2
_TEXT_BODY = r'(?:[^"\\]++|\\.|"(?!""))*+'
_TEXT_BLOCK = '"""' + _TEXT_BODY + '"""'
# as in ``javacode``, but a comment or text block may be open at the end
_TOKENS = (
    "(?s)" + _TEXT_BLOCK + r'|"""(?s:.*)' + java._OPAQUE.removeprefix(_TEXT_BLOCK) + r"|/\*(?s:.*)|[^\"'/]++|[\"'/]"
)
_TO_COMMENT_END = r"(?s)^.*?\*/"
_TO_TEXT_END = "(?s)^" + _TEXT_BODY + '"""'
_STATEMENTS = r"[^{};]*+[{};]|[^{};]++"
_CALLED = r"[\w$]++(?=\s*+(?:\(|\z))"
_EVENT = ("idx", "kind", "text", "line", "col", "text_col")


def _lexed(text: Column, entry: int) -> tuple[Column, Column]:
    """Length of what is still inside the open comment or text block, and tokens after it."""
    if entry == _CODE:
        return F.lit(0), F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0))
    closing = _TO_COMMENT_END if entry == _COMMENT else _TO_TEXT_END
    inside = F.length(F.regexp_extract(text, closing, 0))
    inside = F.when(inside == 0, F.length(text)).otherwise(inside)
    rest = F.substring(text, inside + 1, F.length(text))
    return inside, F.regexp_extract_all(rest, F.lit(_TOKENS), F.lit(0))


def _exit(text: Column, entry: int) -> Column:
    inside, tokens = _lexed(text, entry)

    def after(last: Column) -> Column:
        comment = F.startswith(last, F.lit("/*")) & ~((F.length(last) > 3) & F.endswith(last, F.lit("*/")))
        block = F.startswith(last, F.lit('"""')) & ~F.rlike(last, F.lit("(?s)^" + _TEXT_BLOCK + "$"))
        return F.when(comment, _COMMENT).when(block, _TEXT).otherwise(_CODE)

    code = F.when(F.size(tokens) > 0, let(F.try_element_at(tokens, F.lit(-1)), after)).otherwise(F.lit(_CODE))
    if entry == _CODE:
        return code
    closing = _TO_COMMENT_END if entry == _COMMENT else _TO_TEXT_END
    return F.when(F.rlike(text, F.lit(closing)), code).otherwise(F.lit(entry))


def _blanked(text: Column, entry: int) -> Column:
    inside, tokens = _lexed(text, entry)
    pieces = F.transform(
        tokens, lambda t: F.when(F.rlike(t, F.lit(java._IS_OPAQUE)), F.regexp_replace(t, r"[^\n]", " ")).otherwise(t)
    )
    return F.concat(F.regexp_replace(F.substring(text, F.lit(1), inside), r"[^\n]", " "), F.array_join(pieces, ""))


def chunks(lines: DataFrame, keys: Sequence[str], chunk_lines: int = CHUNK_LINES) -> tuple[DataFrame, DataFrame]:
    """Blanked chunks of sources, ``(keys, chunk, is_open, text)``, and the class names that each can
    use, ``(keys, chunk, names)``.

    A source has as many class names as it has classes, so no chunk is given them all: it
    gets those that stand in it where a constructor's name can, before a parenthesis or at
    its end.
    """
    keys = list(keys)
    text = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: F.concat(r["line"], F.lit("\n"))), ""
    )
    raw = stored(
        lines.withColumn("chunk", F.floor((F.col("line_no") - 1) / chunk_lines)).groupBy(*keys, "chunk")
        .agg(F.translate(text, java._BLOCK_SEP + java._PART_SEP + java._FIELD_SEP, "   ").alias("text")),
        "source_chunks",
    )
    order = Window.partitionBy(*keys).orderBy("chunk")
    named = stored(raw.select(
        *keys, "chunk", F.regexp_extract_all("text", F.lit(java._CLASS_NAME), F.lit(1)).alias("_names"),
        F.rlike("text", F.lit(r"\b(?:class|enum|record)\s+$")).alias("_cut"),
        F.regexp_extract("text", r"^\s*([\w$]+)", 1).alias("_first"),
        F.array(*[_exit(F.col("text"), e) for e in (_CODE, _COMMENT, _TEXT)]).alias("_exits"),
    ).withColumn(
        "_names", F.when(F.col("_cut"), F.array_append("_names", F.lead("_first").over(order))).otherwise(F.col("_names"))
    ).drop("_cut", "_first"), "class_names")
    # one row for each source, one small entry for each of its chunks
    listed = F.array_sort(F.collect_list(F.struct("chunk", "_exits")))
    whole = named.groupBy(*keys).agg(listed.alias("_chunks"))
    entries = F.aggregate(
        "_chunks", F.struct(F.lit(_CODE).alias("now"), F.array().cast("array<int>").alias("at")),
        lambda s, c: F.struct(c["_exits"][s["now"]].alias("now"), F.array_append(s["at"], s["now"]).alias("at")),
        lambda s: F.array_append(s["at"], s["now"]),
    )
    entered = whole.withColumn("_entries", entries).select(
        *keys, (F.element_at("_entries", -1) != _CODE).alias("is_open"),
        F.inline(F.arrays_zip(F.transform("_chunks", lambda c: c["chunk"]).alias("chunk"), F.slice("_entries", F.lit(1), F.size("_chunks")).alias("entry"))),
    )
    blank = F.when(F.col("entry") == _CODE, _blanked(F.col("text"), _CODE))
    blank = blank.when(F.col("entry") == _COMMENT, _blanked(F.col("text"), _COMMENT)).otherwise(_blanked(F.col("text"), _TEXT))
    last = F.max("chunk").over(Window.partitionBy(*keys)) == F.col("chunk")
    joined = raw.join(entered.withColumn("is_last", last), [*keys, "chunk"])
    # as in ``javacode``: an added delimiter ends a rest without one
    blanked = stored(
        joined.select(*keys, "chunk", "is_open", F.concat(blank, F.when(F.col("is_last"), ";").otherwise("")).alias("text")),
        "blanked",
    )
    words = blanked.select(
        *keys, "chunk", F.explode_outer(F.array_distinct(F.regexp_extract_all("text", F.lit(_CALLED), F.lit(0)))).alias("name")
    ).filter("name is not null")
    # a row for each class of a source: never to be broadcast, however small its files are
    of_source = named.select(*keys, F.explode_outer("_names").alias("name")).filter("name is not null").distinct().hint("merge")
    names = words.join(of_source, [*keys, "name"]).groupBy(*keys, "chunk").agg(F.collect_list("name").alias("names"))
    return blanked, names


def statements(blanked: DataFrame, keys: Sequence[str], chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Statements with their place, depth and the block they lie in, blocks named by their opening.

    ``kind`` is the delimiter, or empty for the unfinished rest of a chunk.
    """
    keys = list(keys)
    cut = blanked.select(*keys, "chunk", F.posexplode(F.regexp_extract_all("text", F.lit(_STATEMENTS), F.lit(0))).alias("idx", "piece"))
    here = Window.partitionBy(*keys, "chunk").orderBy("idx")
    so_far = here.rowsBetween(Window.unboundedPreceding, 0)
    last = F.right("piece", F.lit(1))
    kind = F.when(last.isin("{", "}", ";"), last).otherwise(F.lit(""))
    text = F.when(kind == "", F.col("piece")).otherwise(F.left("piece", F.length("piece") - 1))
    rows = cut.select(*keys, "chunk", "idx", kind.alias("kind"), text.alias("text")).withColumns({
        "_end": F.sum(F.length("text") + F.length("kind")).over(so_far), "_breaks": F.sum(count_of(F.col("text"), "\n")).over(so_far),
    }).withColumns({
        "_begin": F.col("_end") - F.length("text") - F.length("kind"),
        "_delta": (F.col("kind") == "{").cast("int") - (F.col("kind") == "}").cast("int"),
    })
    in_text = F.length("text") - F.length(F.substring_index("text", "\n", -1))
    rows = rows.withColumn("_break", F.when(count_of(F.col("text"), "\n") > 0, F.col("_begin") + in_text))
    rows = rows.withColumns({
        "_line_at": F.coalesce(F.max("_break").over(so_far), F.lit(0)),
        "_line_before": F.coalesce(F.max("_break").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_sum": F.sum("_delta").over(so_far),
    }).withColumn("_low", F.min("_sum").over(so_far))
    rows = stored(
        rows.select(
            *keys, "chunk", "idx", "kind", F.when(F.col("kind") == "}", "").otherwise(F.col("text")).alias("text"),
            (F.col("chunk") * chunk_lines + 1 + F.col("_breaks")).cast("int").alias("line"),
            (F.col("_end") - F.col("_line_at")).cast("int").alias("col"),
            (F.col("_begin") - F.col("_line_before") + 1).cast("int").alias("text_col"), "_sum", "_low",
        ),
        "statements",
    )
    # the depth never falls below 0: a closing brace too many closes nothing
    total = rows.groupBy(*keys, "chunk").agg(F.max_by("_sum", "idx").alias("_sum"), F.min("_low").alias("_low"))
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = total.withColumn("_at", F.coalesce(F.sum("_sum").over(before), F.lit(0))).withColumn(
        "_least", F.coalesce(F.min(F.col("_at") + F.col("_low")).over(before), F.lit(0))
    ).select(*keys, "chunk", "_at", "_least")
    placed = rows.join(starts, [*keys, "chunk"])
    floor = F.least(F.lit(0), F.col("_least"), F.col("_at") + F.col("_low"))
    placed = placed.withColumn("depth", F.col("_at") + F.col("_sum") - floor).drop("_sum", "_low", "_at", "_least")
    level = F.col("depth") - (F.col("kind") == "{").cast("int")
    one = placed.withColumns({"level": level, "block": F.lit(None).cast("struct<chunk:bigint,idx:int>")})
    opened = placed.filter("kind = '{'").withColumns({
        "level": F.col("depth"), "block": F.struct("chunk", "idx"), "kind": F.lit("o"), "text": F.lit("")
    })
    both = one.unionByName(opened).withColumn("_at", F.col("chunk"))
    inside = scans.last_known(both, [*keys, "level"], ["idx"], F.col("_at"), {"parent": F.col("block")})
    return inside.filter("kind <> 'o'").drop("_at", "block")


def _state(open_blocks: Column) -> Column:
    return F.struct(
        F.lit(1).alias("line"), F.lit(1).alias("column"), F.lit("").alias("head"), F.lit(1).alias("head_column"),
        open_blocks.alias("open"), F.lit("").alias("methods"), F.lit("").alias("fields"),
    )


def _step(state: Column, event: Column, names: Column) -> Column:
    kind = event["kind"]
    needed = (kind == "{") | (kind == "") | ((kind == ";") & java._in_class(state))
    placed = java._next(
        state, line=event["line"], column=event["col"],
        head=F.when(needed, F.concat(state["head"], event["text"])).otherwise(F.lit("")),
        head_column=F.when(state["head"] == "", event["text_col"]).otherwise(state["head_column"]),
    )

    def named(s: Column) -> Column:
        row = F.concat_ws(java._FIELD_SEP, F.lit("#"), event["idx"].cast("string"), F.left(java._top(s), F.lit(1)))
        return java._next(s, methods=java._added(s["methods"], row))

    return let(
        placed,
        lambda s: F.when(kind == "{", let(java._on_open(s, names), named))
        .when(kind == "}", java._on_close(s))
        .when((kind == ";") & java._in_class(s), java._on_statement_end(s, names))
        .when(kind == ";", java._next(s, column=s["column"] + 1))
        .otherwise(s),
    )


def _folded(streams: DataFrame) -> DataFrame:
    """Streams with an ``entry`` state to their ``exit`` state, rows found apart from it.

    ``names`` holds the class names in a stream's own chunk and in the unfinished statement it
    starts with; ``exit_names`` are those in the one that it leaves.
    """
    done = F.aggregate("events", F.col("entry"), lambda s, e: _step(s, e, F.col("names")))
    out = streams.withColumn("_done", done)
    carried = F.filter("names", lambda n: F.contains(F.col("_done.head"), n))
    return out.withColumns({
        "exit_names": carried,
        "found_methods": F.col("_done.methods"), "found_fields": F.col("_done.fields"),
        "exit": java._next(F.col("_done"), methods=F.lit(""), fields=F.lit("")),
    }).drop("_done")


def _all_folded(events: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """The streams of all blocks, for both kinds of the block around them: ``found_methods`` and
    ``found_fields`` of each of their chunks.

    A block's stream begins in the chunk that opens the block, with nothing.  Only what goes on in
    a later chunk can begin with something: its statements alone are kept and folded again.
    """
    of = [*keys, "level", "parent", "around"]
    goes_on = F.coalesce(F.col("chunk") > F.col("parent.chunk"), F.lit(True))
    nothing = _state(F.when(F.col("around") == "", "").otherwise(F.concat(F.lit(java._BLOCK_SEP), F.col("around"))))

    def streams(rows: DataFrame) -> DataFrame:
        # dealt by chunk, as the names are: one shuffle
        return (
            rows.repartition(*keys, "chunk").groupBy(*keys, "level", "parent", "chunk")
            .agg(F.array_sort(F.collect_list(F.struct(*_EVENT))).alias("events"))
            .join(names, [*keys, "chunk"], "left")
            .withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
            .withColumn("around", F.explode(F.when(F.col("parent").isNull(), F.array(F.lit(""))).otherwise(
                F.array(F.lit(java._CLASS_BLOCK), F.lit(java._PLAIN)))))
        )

    def same(columns: Sequence[str]) -> Column:
        matches = F.lit(True)
        for c in columns:
            matches &= F.col(f"s.{c}").eqNullSafe(F.col(f"w.{c}"))
        return matches

    kept = [*of, "chunk", "entry", "names", "exit", "exit_names", "found_methods", "found_fields"]
    folded = stored(
        _folded(streams(events).withColumn("entry", nothing)).withColumn("names", F.when(goes_on, F.col("names"))).select(*kept),
        "streams",
    )
    later = stored(streams(events.filter(goes_on)).select(*of, "chunk", "events"), "later_streams")
    # files are far smaller than the rows in them: by their size these would be broadcast whole
    going_on = later.select(*of).distinct().hint("merge")
    chain = stored(folded.alias("s").join(going_on.alias("w"), same(of), "left_semi"), "chains")
    order = Window.partitionBy(*of).orderBy("chunk")
    while True:
        begun = chain.select(
            *of, "chunk", "entry", "names", F.coalesce(F.lag("exit").over(order), "entry").alias("_entry"),
            F.lag("exit_names").over(order).alias("_more"),
        )
        wrong = stored(begun.filter("entry <> _entry").select(
            *of, "chunk", F.col("_entry").alias("entry"), F.array_union("names", "_more").alias("names")
        ), "unfinished")
        if wrong.isEmpty():
            return folded.filter(~goes_on).unionByName(chain.filter(goes_on)).drop("entry", "names", "exit", "exit_names")
        other = wrong.hint("merge").alias("w")
        here = same([*of, "chunk"])
        anew = _folded(later.alias("s").join(other, here).select("s.*", "w.entry", "w.names")).select(*kept)
        chain = stored(chain.alias("s").join(other, here, "left_anti").unionByName(anew), "chains")


def _of_kind(rows: DataFrame, kinds: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of streams that were folded for the true kind of their block."""
    # a row for each block: never to be broadcast, however small its files are
    true_kind = kinds.select(
        *[F.col(c).alias(f"_{c}") for c in keys], F.col("block").alias("_block"), F.col("kind").alias("_kind")
    ).hint("merge")
    match = F.col("parent") == F.col("_block")
    for c in keys:
        match &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    inner = F.when(F.col("_kind") == java._CLASS_BLOCK, F.lit(java._CLASS_BLOCK)).otherwise(F.lit(java._PLAIN))
    chosen = rows.filter("parent is not null").join(true_kind, match).filter(F.col("around") == inner)
    return rows.filter("parent is null").unionByName(chosen.select(*rows.columns))


def _kinds(folded: DataFrame, keys: list[str]) -> DataFrame:
    """Kind of every block.  A header says the same whatever is around it, with rare exceptions
    that are settled from the outermost block inwards."""
    rows = stored(
        folded.select(*keys, "parent", "around", "chunk", F.explode(F.split("found_methods", java._ROW_SEP)).alias("_row"))
        .filter(F.startswith("_row", F.lit("#"))).withColumn("_p", F.split("_row", java._FIELD_SEP, -1))
        .select(*keys, "parent", "around", F.struct("chunk", F.col("_p")[1].cast("int").alias("idx")).alias("block"), F.col("_p")[2].alias("kind")),
        "blocks",
    )
    sure = rows.groupBy(*keys, "block").agg(F.min("kind").alias("kind"), F.max("kind").alias("_other"))
    known = stored(sure.filter("kind = _other").drop("_other"), "kinds")
    doubtful = sure.filter("kind <> _other").select(*keys, "block")
    left = stored(rows.join(doubtful, [*keys, "block"], "left_semi"), "doubtful")
    while not left.isEmpty():
        settled = _of_kind(left, known, keys).select(*keys, "block", "kind")
        known = stored(known.unionByName(settled), "kinds")
        left = stored(left.join(known.select(*keys, "block").hint("merge"), [*keys, "block"], "left_anti"), "doubtful")
    return known


def spans_of_lines(lines: DataFrame, keys: Sequence[str], chunk_lines: int = CHUNK_LINES) -> tuple[DataFrame, DataFrame]:
    """Methods and fields of sources held as ``(keys, line_no, line)``.

    Methods: ``keys, start_line, start_column, end_line, end_column, name, annotations,
    is_constructor, is_unclosed``; fields: ``keys, name, start_line, end_line, is_unclosed``.
    """
    keys = list(keys)
    blanked, names = chunks(lines, keys, chunk_lines)
    events = stored(statements(blanked, keys, chunk_lines), "events")
    folded = _all_folded(events, names, keys)
    true = _of_kind(folded.select(*keys, "parent", "around", "found_methods", "found_fields"), _kinds(folded, keys), keys)
    open_end = events.groupBy(*keys).agg((F.max_by("depth", F.struct("chunk", "idx")) > 0).alias("_deep"))
    state = blanked.select(*keys, "is_open").distinct().join(open_end, keys).select(*keys, (F.col("is_open") | F.col("_deep")).alias("is_unclosed"))

    def found(packed: str, make) -> DataFrame:
        rows = true.select(*keys, F.explode(F.split(packed, java._ROW_SEP)).alias("_row"))
        rows = rows.filter((F.col("_row") != "") & ~F.startswith("_row", F.lit("#")))
        return rows.select(*keys, let(F.split("_row", java._FIELD_SEP, -1), make).alias("_f")).join(state, keys)

    methods = found("found_methods", java._method_row).select(
        *keys, F.col("_f.start.line").alias("start_line"), F.col("_f.start.column").alias("start_column"),
        F.col("_f.end.line").alias("end_line"), F.col("_f.end.column").alias("end_column"),
        "_f.name", "_f.annotations", "_f.is_constructor", "is_unclosed",
    )
    fields = found("found_fields", java._field_row).select(*keys, "_f.name", "_f.start_line", "_f.end_line", "is_unclosed")
    return methods, fields
