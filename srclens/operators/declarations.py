"""Declaration extraction: Java text to packages, imports, types, methods, fields.

The unit of work is the *run*: the text up to the next brace outside comments and
literals. Running sums over the runs of a file give the brace depth and the enclosing
block; runs in type bodies are then cut at ``;`` into declarations. A file is thus
segmented by windows alone, without a grammar.
Where brackets nest, a block that can hold no type or anonymous body (most method bodies)
stays whole inside its run: it adds its opener and its decision count, and no rows of its own.
A flat file (packages, imports, classes and interfaces, no body inside an expression) passes the windows
as one run and is cut into its declarations by one expression after them; all others are cut by the windows.

One shuffle: the comment-free text is hash-partitioned by path before it is exploded.
Every window and aggregate below has ``path`` as its first key, so all later steps
stay in that partitioning. Method bodies are reduced to a running decision count in
the first window and dropped right after the second one; only declarations and block
ends go on. A file is one input value, so its runs fit where it did.

Semantics fixed here
  * classes and interfaces anywhere in a file are found, nested and local ones too;
  * a type owns every method and field inside it, also those of types nested in it
    and of anonymous classes (``recursive=False`` keeps the directly declared ones);
  * constructors, initialisers and annotation members are not methods;
  * type names are bare: no type arguments, no dimensions, no qualifier;
  * modifiers keep source order;
  * a body's score is 1 + the decision words in it, comments and literals removed.
Known limit: methods in an anonymous class one of whose constructor arguments holds a
block are not seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The modifiers of the Java language.
MODIFIERS = [
    "public", "protected", "private", "abstract", "static", "final", "strictfp",
    "native", "synchronized", "transient", "volatile", "default", "sealed", "non-sealed",
]
# Words and operators that count as one decision each.
DECISION_WORDS = ["if", "for", "while", "case", "catch"]
DECISION_OPERATORS = ["&&", "||", "?"]

# Words that can stand where a type name stands but never are one.
NOT_A_TYPE = ["new", "return", "throw", "else", "case", "assert", "package", "import"]

TYPE_KINDS = ["class", "interface", "enum", "record", "annotation"]
BODY_KINDS = ["class", "interface", "enum", "record", "anonymous"]

# Comments, text blocks, strings and characters in one alternation, so that a quote in
# a comment or a brace in a string is never misread. Possessive groups keep the match
# free of recursion on long literals; an unclosed comment runs to the end of the text.
# The first sign is read before the alternatives, which spares all other places them.
COMMENT_OR_LITERAL = (
    r"[/\"'](?:"
    r"(?<=/)(?:\*[\s\S]*?(?:\*/|\z)|/[^\r\n]*+)"
    r'|(?<=")(?:""[^\\"]*+(?:(?:\\[\s\S]|"(?!""))[^\\"]*+)*+"""'
    r'|[^"\\\r\n]*+(?:\\.[^"\\\r\n]*+)*+")'
    r"|(?<=')[^'\\\r\n]*+(?:\\.[^'\\\r\n]*+)*+')"
)
# A block opener whose header could make its block a type or anonymous body is replaced by
# this sign; the tests are wider than those of ``kind``, so no such block is missed.
LIVE = "\x03"
_BODY_WORDS = "class|interface|enum|record|new"
OPENS_BODY = (
    rf"([ceinr,](?:(?:(?<=c)lass|(?<=i)nterface|(?<=e)num|(?<=r)ecord|(?<=n)ew)(?![A-Za-z0-9_])(?<![A-Za-z0-9_](?:{_BODY_WORDS}))"
    r"|(?<=[\s;{}],|^,)(?<=(?:^|[;{}])\s{0,9},|\s{10},)\s*+[A-Za-z_$\p{L}])[^;{}]*+)\{"
)
# The first block in an enum can be the body of a constant.
AFTER_ENUM = r"(enum(?![A-Za-z0-9_])(?<![A-Za-z0-9_]enum)[^;{}\x03]*+\x03[^;{}\x03]*+)\{"


def _dead_block(depth: int) -> str:
    """A block without bodies in it, of any length; one nested deeper is read run by run."""
    inner = r"\{[^{}\x03]*+\}"
    for _ in range(depth):
        inner = r"\{(?:[^{}\x03]++|" + inner + r")*+\}"
    return inner


DEAD = _dead_block(7)
RUN = rf"(?:[^{{}}\x03]++|{DEAD})++[{{}}\x03]?|[{{}}\x03]"
PIECE = rf"[^;{{}}]++(?:;|{DEAD}|[{{}}])?+|;|{DEAD}|[{{}}]"


def _parens(depth: int, inside: str) -> str:
    """Balanced parentheses without ``;`` and live openers, ``inside`` allowed in them."""
    group = rf"\((?:[^(){{}};\x03]++|{inside})*+\)"
    for _ in range(depth):
        group = rf"\((?:[^(){{}};\x03]++|{inside}|{group})*+\)"
    return group


# A flat file holds packages, imports, classes and interfaces only, and no body opens in an
# initialiser or in parentheses: each match of ``DECLARATION`` is then one whole declaration or
# the end of a type. Files that are not flat are read run by run.
_PLAIN = r"[^;{}()=\x03]++"
_PAREN, _BARE_PAREN = _parens(5, DEAD), _parens(5, r"(?!)")
_HEADER = rf"(?:{_PLAIN}|{_PAREN})*+"
# the block of an initialiser has an '=' before it, and no other block between them
_VALUES = rf"(?:=(?:{_PLAIN}|{_BARE_PAREN})*+(?:{DEAD})?+(?:{_PLAIN}|{_PAREN})*+)++;"
_TYPE_END = r"[^;{}()\x03]*+\}"
DECLARATION = rf"{_HEADER}(?:;|{DEAD}|\x03|{_VALUES})|{_TYPE_END}"
_AT_FILE = r"\s*+(?:package|import)(?![\w$\p{L}])"
# the opener of a class or interface: one of these words is not far before it
_OPENS_TYPE = r"\x03(?<=(?<![\w$.])(?:class|interface)\s{1,9}[A-Za-z_$\p{L}][^;{}\x03]{0,400}\x03)"


def _flat_file(depth: int) -> str:
    """A whole flat file, its types at most ``depth`` inside each other."""
    member = rf"(?!{_AT_FILE}){_HEADER}(?:;|{DEAD}|{_VALUES})"
    for _ in range(depth - 1):
        member = rf"(?!{_AT_FILE}){_HEADER}(?:;|{DEAD}|{_VALUES}|{_OPENS_TYPE}(?:{member})*+{_TYPE_END})"
    return rf"\A(?:{_AT_FILE}{_PLAIN};|\s*+;|(?!{_AT_FILE}){_HEADER}{_OPENS_TYPE}(?:{member})*+{_TYPE_END})*+\s*+\z"


FLAT_FILE = _flat_file(4)
# Passes of the bracket test; a text nested deeper is walked bracket by bracket.
NESTING = 12
# Most texts nest no deeper than this and are known to nest by one look.
SHALLOW = 4

_WORD = r"[A-Za-z_$\p{L}][\w$\p{L}]*"
_MODS = "|".join(MODIFIERS)


def _nests(depth: int) -> str:
    """The whole text, its brackets closing each other's inside first and at most ``depth`` deep."""
    inside = r"[^{}()]*+"
    for _ in range(depth):
        inside = rf"(?:[^{{}}()]++|\({inside}\)|\{{{inside}\}})*+"
    return rf"\A{inside}\z"


def _count(col: Column, char: str) -> Column:
    return F.octet_length(col) - F.octet_length(F.replace(col, F.lit(char), F.lit("")))


def _repeat(times: Column, text: Column, step) -> Column:
    """Apply ``step`` to ``text`` ``times`` times."""
    return F.when(times > 0, F.aggregate(F.sequence(F.lit(1), times), text, lambda acc, _: step(acc))).otherwise(text)


def _passes(text: Column, opening: str, closing: str) -> Column:
    """How often innermost brackets must be removed: their count, or for many their depth."""
    count = _count(text, opening).cast("int")
    marks = F.split(F.regexp_replace(text, f"[^{opening}{closing}]", ""), "")

    def walk(acc: Column, mark: Column) -> Column:
        depth = F.greatest(acc["d"] + F.when(mark == opening, 1).when(mark == closing, -1).otherwise(0), F.lit(0))
        return F.struct(depth.alias("d"), F.greatest(acc["m"], depth).alias("m"))

    depth = F.aggregate(marks, F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), walk)["m"]
    return F.when(count > 8, depth).otherwise(count)


def _folded(text: Column) -> Column:
    """Balanced parentheses and what is in them become ``#``."""
    return _repeat(
        _passes(text, "(", ")"), text, lambda t: F.regexp_replace(t, r"\([^()]*\)", "#")
    )


def _without_parens(text: Column) -> Column:
    """As ``_folded``, and text inside an unbalanced parenthesis is cut."""
    return F.regexp_replace(F.regexp_replace(_folded(text), r"^[^(]*\)", ""), r"\([\s\S]*$", "")


def _in_order(code: Column) -> Column:
    """No bracket closes before it opens: one walk over the brackets of a text."""
    marks = F.split(F.regexp_replace(code, r"[^{}()]++", ""), "")

    def walk(acc: Column, mark: Column) -> Column:
        brace = acc["b"] + F.when(mark == "{", 1).when(mark == "}", -1).otherwise(0)
        paren = acc["p"] + F.when(mark == "(", 1).when(mark == ")", -1).otherwise(0)
        return F.struct(brace.alias("b"), paren.alias("p"), F.least(acc["low"], brace, paren).alias("low"))

    return F.aggregate(marks, F.struct(F.lit(0).alias("b"), F.lit(0).alias("p"), F.lit(0).alias("low")), walk)["low"] == 0


def clean_files(files: DataFrame) -> DataFrame:
    """``path, code, nested, usable``: text without comments and literals; do its brackets and quotes close in order.

    ``nested``: parentheses and braces close each other's inside first, as in all Java; null text gives null.
    """
    code = F.col("code")
    marks = F.regexp_replace(code, r"[^{}()]++", "")
    for _ in range(NESTING):
        marks = F.replace(F.replace(marks, F.lit("()"), F.lit("")), F.lit("{}"), F.lit(""))
    in_order = (_count(code, "{") == _count(code, "}")) & (_count(code, "(") == _count(code, ")")) & _in_order(code)
    return (
        files.select("path", F.regexp_replace("content", COMMENT_OR_LITERAL, " ").alias("code"))
        .select("path", "code", F.when(code.rlike(_nests(min(SHALLOW, NESTING))), True).otherwise(marks == "").alias("nested"))
        .select(
            "path",
            "code",
            "nested",
            (
                ~F.contains(code, F.lit('"'))
                & ~F.contains(code, F.lit("'"))
                & F.when(F.col("nested"), True).otherwise(in_order)
            ).alias("usable"),
        )
    )


def _decisions(text: Column) -> Column:
    """Decision words and operators of a text."""
    words = "|".join(DECISION_WORDS)
    signs = "|".join("".join("\\" + c for c in o) for o in DECISION_OPERATORS)
    return F.regexp_count(F.lower(text), F.lit(rf"(?=[cfiw&|?])(?:(?:{words})(?<![\w$](?:{words}))(?![\w$])|{signs})"))


def _is_flat(marked: Column) -> Column:
    """Does a nested text hold only what ``DECLARATION`` reads: all live openers are those of classes and interfaces?"""
    return ~(F.contains(marked, F.lit("interface")) & marked.rlike(r"@\s*interface")) & marked.rlike(FLAT_FILE)


def brace_runs(files: DataFrame) -> DataFrame:
    """One row per run of text up to the next brace, placed in its block.

    Only files whose brackets balance; ``blk`` is the position of the first run of the
    enclosing block (its ``{`` ends the run before), ``bkind`` what that block is; ``dec`` the decisions in
    the block that the run opens. A flat file is a single run (``flat``): its declarations need no windows.
    """
    # The number is set outright: merging by size would judge by the packed text, while
    # each partition goes on to hold many times that as rows.
    partitions = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # An unusable text becomes null and explodes to nothing: a filter here would be
    # pushed below and run the expression above once more for each mention of it.
    code = F.col("code")
    # Where brackets nest, openers of possible bodies are marked: other blocks stay whole in their run.
    marked = F.regexp_replace(code, OPENS_BODY, "$1" + LIVE)
    exploded = (
        clean_files(files)
        .select("path", F.when(F.col("usable"), F.replace(code, F.lit(LIVE), F.lit("\x04"))).alias("code"), "nested")
        .repartition(partitions, "path")
        .withColumn("code", F.when(F.col("nested"), marked).otherwise(F.replace(code, F.lit("{"), F.lit(LIVE))))
        .withColumn("code", F.when(F.contains(code, F.lit("enum")), F.regexp_replace(code, AFTER_ENUM, "$1" + LIVE)).otherwise(code))
        .withColumn("flat", F.col("nested") & _is_flat(code))
        .select(
            "path",
            "flat",
            F.posexplode(F.when(F.col("flat"), F.array("code")).otherwise(F.regexp_extract_all("code", F.lit(RUN), F.lit(0)))).alias("pos", "seg"),
        )
    )
    flat = F.col("flat")
    last = F.when(flat, "").otherwise(F.right("seg", F.lit(1)))
    front = F.left("seg", F.char_length("seg") - 1)
    # the part after the last ';' or whole block is what a '{' belongs to
    pieces = exploded.select(
        "path",
        "flat",
        "pos",
        F.when(last.isin("{", LIVE), F.concat(front, F.lit("{"))).otherwise(F.col("seg")).alias("seg"),
        F.when(last.isin("{", LIVE), "{").when(last == "}", "}").otherwise("").alias("brace"),
        F.when(last.isin("{", LIVE), F.concat(F.substring_index(F.substring_index(front, "}", -1), ";", -1), F.lit("{"))).alias("head"),
        F.when(~flat, F.contains(front, F.lit("{"))).alias("blocks"),
    )
    head = F.col("head")

    def named(word: str, pattern: str) -> Column:
        # a plain substring test spares most runs the regular expression
        return F.contains(head, F.lit(word)) & head.rlike(pattern)

    kind = (
        F.when(head.isNull(), None)
        .when(named("interface", r"@\s*interface\s+" + _WORD), "annotation")
        .when(named("interface", r"(?:^|[^\w$.])interface\s+" + _WORD), "interface")
        .when(named("class", r"(?:^|[^\w$.])class\s+" + _WORD), "class")
        .when(named("enum", r"(?:^|[^\w$.])enum\s+" + _WORD), "enum")
        .when(named("record", r"(?:^|[^\w$.])record\s+" + _WORD + r"\s*(?:<[^{};()]*>)?\s*\("), "record")
        .when(
            named("new", r"\bnew\b[\s\S]*\)\s*\{$")
            & _folded(head).rlike(r"(?:^|[^\w$.])new\s+[\w$.\p{L}]+\s*(?:<[\s\S]*>)?\s*#\s*\{$"),
            "anonymous",
        )
        # the body of an enum constant that follows another one
        .when(F.startswith(F.ltrim(head), F.lit(",")) & _folded(head).rlike(rf"^(?:\s*,\s*{_WORD}\s*#?)+\s*\{{$"), "anonymous")
        .when(~F.contains("seg", F.lit(";")) & ~F.col("blocks"), "plain")
        .otherwise("other")
    )
    rows = pieces.select(
        "path",
        "flat",
        "pos",
        "seg",
        "brace",
        F.when(flat, 0).otherwise(_count(F.col("seg"), "(") - _count(F.col("seg"), ")")).alias("par"),
        kind.alias("kind"),
        "head",
    )
    file_order = Window.partitionBy("path").orderBy("pos")
    in_file = file_order.rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("brace") == "{", 1).when(F.col("brace") == "}", -1).otherwise(0)
    # Decisions are summed over runs only where a block other than that of a type is open in runs.
    other = F.max(F.col("kind").isin("plain", "other", "anonymous")).over(in_file)
    rows = rows.withColumn("counted", other).withColumn("dec", F.when(F.col("counted"), _decisions(F.col("seg"))).otherwise(0))
    placed = rows.select(
        "*",
        F.sum("par").over(in_file).alias("cpar"),
        F.sum("dec").over(in_file).alias("cdec"),
        # depth of the block the run sits in, not of the one it opens
        (F.sum(step).over(in_file) - step).alias("depth"),
        F.lag("kind").over(file_order).alias("before"),
        F.lag("kind", 2).over(file_order).alias("before2"),
    )
    # Blocks of one depth follow each other; each begins right after the run with its '{'.
    so_far = Window.partitionBy("path", "depth").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.col("before").isNotNull() | (F.col("pos") == 0)
    start = F.struct(
        F.col("pos").alias("blk"),
        # an enum begins with its constants: a block before any ';' is the body of one
        F.when((F.col("before") == "plain") & (F.col("before2") == "enum"), "anonymous")
        .otherwise(F.coalesce("before", F.lit("file")))
        .alias("bkind"),
        (F.col("cpar") - F.col("par")).alias("base"),
    )
    # the next run of the same depth follows the block that this run opens
    after = Window.partitionBy("path", "depth").orderBy("pos")
    return placed.select(
        "path", "flat", "pos", "seg", "brace", "kind", "head", "cpar",
        F.last(F.when(fresh, start), ignorenulls=True).over(so_far).alias("block"),
        (F.lead(F.col("cdec") - F.col("dec")).over(after) - F.col("cdec")).alias("dec"),
    ).select(
        "path", "flat", "pos", "seg", "brace", "kind", "head", "dec", "block.blk", "block.bkind",
        (F.col("cpar") - F.col("block.base")).alias("rel"),
    )


def _with_flat_header(df: DataFrame, text: Column) -> DataFrame:
    """Add ``head``: one line without braces, nested parentheses, annotations, type arguments.

    Step by step, so that each step is computed once.
    """
    head = F.col("head")
    starts = lambda p, c: F.startswith(p, F.lit(c))
    # keep parentheses of the first level, drop what is nested deeper
    folded = F.aggregate(
        F.split(head, r"(?=[()])"),
        F.struct(F.lit(0).alias("d"), F.lit("").alias("s")),
        lambda acc, p: F.struct(
            (acc["d"] + F.when(starts(p, "("), 1).when(starts(p, ")"), -1).otherwise(0)).alias("d"),
            F.when(starts(p, "(") & (acc["d"] > 0), acc["s"])
            .when(starts(p, ")") & (acc["d"] > 2), acc["s"])
            .when(starts(p, ")") & (acc["d"] == 2), F.concat(acc["s"], F.substr(p, F.lit(2))))
            .otherwise(F.concat(acc["s"], p))
            .alias("s"),
        ),
    )["s"]
    inside = r"[\w\s.,?&\[\]$\p{L}]"
    arguments = f"<{inside}*>"
    nested_arguments = f"<(?:{inside}++|<(?:{inside}++|<{inside}*+>)*+>)*+>"
    for step in (
        F.trim(F.regexp_replace(text, r"[{};\s]+", " ")),
        F.when((_count(head, "(") > 1) & head.rlike(r"\([^()]*+\("), folded).otherwise(head),
        F.when(
            F.contains(head, F.lit("@")), F.regexp_replace(head, r"@(?! ?interface\b) ?[\w$.]+( ?\([^()]*\))?", " ")
        ).otherwise(head),
        # most are no deeper than this; the rest goes from the innermost on
        F.when(F.contains(head, F.lit("<")), F.regexp_replace(head, nested_arguments, " ")).otherwise(head),
        _repeat(_passes(head, "<", ">"), head, lambda t: F.regexp_replace(t, arguments, " ")),
        F.replace(head, F.lit("..."), F.lit(" [] ")),
        # most headers have neither a dot nor a double space
        F.when(F.contains(head, F.lit(".")), F.regexp_replace(head, r" ?\. ?", ".")).otherwise(head),
        F.trim(F.when(F.contains(head, F.lit("  ")), F.regexp_replace(head, r" {2,}", " ")).otherwise(head)),
    ):
        df = df.withColumn("head", step)
    return df


def _bare(col: Column) -> Column:
    """Last component of a dotted name."""
    return F.substring_index(F.trim(col), ".", -1)


def _none() -> Column:
    return F.array().cast("array<string>")


def _names(text: Column) -> Column:
    """Bare names of a comma list; an empty text gives an empty array."""
    return F.when(text == "", _none()).otherwise(F.filter(F.transform(F.split(text, ","), _bare), lambda n: n != ""))


def _mods(prefix: Column) -> Column:
    return F.when(prefix == "", _none()).otherwise(F.filter(F.split(F.trim(prefix), " "), lambda w: w.isin(MODIFIERS)))


# Each pattern covers a whole header; its groups are read as fields parted by ';'.
_TYPE = r"^(.*?)(?:^|(?<=[^\w$.]))(?:class|interface|enum|record) (" + _WORD + r")(.*)$"
_FILE_LEVEL = r"^(package|import) (?:static )?([\w$.\p{L}]+?)(?:\.\*)?$"
_MEMBER = (
    rf"^((?:(?:{_MODS}) )*)(?!(?:{_MODS}|{'|'.join(NOT_A_TYPE)})\b)([\w$.\p{{L}}]+)(?: ?\[ ?\])* ({_WORD})"
    r" ?(\([^()]*\))?(.*)$"
)
_FIELD_REST = r"^(?: ?\[ ?\])* ?(?:[=,].*)?$"


def _parameters(text: Column) -> Column:
    cleaned = F.regexp_replace(text, r"\[ ?\]|\.\.\.|\bfinal\b", " ")
    each = F.filter(F.transform(F.split(cleaned, ","), lambda p: F.trim(p)), lambda p: F.contains(p, F.lit(" ")))
    return F.transform(
        each,
        lambda p: F.struct(
            F.substring_index(p, " ", -1).alias("name"),
            _bare(F.regexp_extract(p, r"^(\S+)", 1)).alias("type"),
        ),
    )


def _blocks_and_members(files: DataFrame) -> DataFrame:
    """One row per declaration or block end, with the text of declarations."""
    in_body = F.col("bkind").isin("file", *BODY_KINDS)
    is_type = F.col("kind").isin(TYPE_KINDS)
    flat = F.col("flat")
    # Only type bodies are cut at ';'. Elsewhere a type is the last piece of its run,
    # and a block end needs no text.
    pieces = (
        F.when(flat, F.array("seg"))
        .when(in_body, F.regexp_extract_all("seg", F.lit(PIECE), F.lit(0)))
        .when(is_type, F.array("head"))
        .otherwise(F.array(F.lit("")))
    )
    cut = (
        brace_runs(files)
        .filter(in_body | is_type | (F.col("brace") == "}"))
        .select("*", pieces.alias("pieces"))
        .select("*", F.posexplode_outer("pieces").alias("sub", "piece"))
        .withColumn("last", F.col("sub") == F.size("pieces") - 1)
        .drop("seg", "head", "pieces")
        # a whole block is read here as its opener and the decisions in it
        .withColumn("whole", ~flat & F.endswith("piece", F.lit("}")) & F.contains("piece", F.lit("{")))
        .withColumn("inside", F.when(F.col("whole"), _decisions(F.substr("piece", F.instr("piece", F.lit("{"))))))
        .withColumn("piece", F.when(F.col("whole"), F.concat(F.substring_index("piece", "{", 1), F.lit("{"))).otherwise(F.col("piece")))
    )
    piece, whole = F.col("piece"), F.col("whole")
    opens = F.col("last") & (F.col("brace") == "{")
    # A declaration ends at ';' or at the '{' of its body; the '{' of an initialiser
    # (an '=' before it) or within parentheses does not end it.
    initialiser = F.contains(piece, F.lit("=")) & F.contains(_without_parens(piece), F.lit("="))
    in_block = Window.partitionBy("path", "blk").orderBy("pos", "sub")
    open_parens = F.sum(F.when(~flat, _count(piece, "(") - _count(piece, ")"))).over(in_block.rowsBetween(Window.unboundedPreceding, 0))
    rel = F.when(whole, F.col("open_parens")).otherwise(F.col("rel"))
    ends = F.when(flat, True).when(whole | opens, (rel == 0) & ~initialiser).otherwise(F.endswith(piece, F.lit(";")))
    before = in_block.rowsBetween(Window.unboundedPreceding, -1)
    parts = F.struct(
        "pos", "sub", "piece",
        F.when(opens & is_type, F.col("kind")).alias("tkind"),
        F.when(F.col("ends") & whole, F.col("inside")).when(F.col("ends") & opens, F.col("dec")).alias("dec"),
        (F.col("last") & (F.col("brace") == "}")).alias("is_end"),
        "bkind",
        "flat",
    )
    gathered = (
        cut.withColumn("open_parens", open_parens)
        .withColumn("ends", ends)
        .withColumn("mem", F.coalesce(F.sum(F.col("ends").cast("int")).over(before), F.lit(0)))
        # the pieces of a declaration in order, once, with what its last piece says
        .groupBy("path", "blk", "mem")
        .agg(F.sort_array(F.collect_list(parts)).alias("pieces"))
        .select("path", "pieces", F.element_at("pieces", -1).alias("end"))
        .select(
            "path", "end.*",
            F.when(F.size("pieces") == 1, F.col("end.piece")).otherwise(F.array_join("pieces.piece", "")).alias("text"),
        )
    )
    has_text = ~F.col("is_end") & (F.col("text") != "")
    return _with_flat_files(gathered.filter(has_text | F.col("bkind").isin("class", "interface")))


def _with_flat_files(gathered: DataFrame) -> DataFrame:
    """Cut the texts of flat files into their declarations and type ends; other rows stay."""
    flat, text = F.col("flat"), F.col("text")
    each = F.when(flat, F.regexp_extract_all("text", F.lit(DECLARATION), F.lit(0))).otherwise(F.array("text"))
    opens_type, block = F.endswith(text, F.lit(LIVE)), F.contains(text, F.lit("{"))
    closes = F.endswith(text, F.lit("}"))
    # what a type is stands after the last block of its annotations
    head = F.substring_index(text, "}", -1)
    is_interface = F.contains(head, F.lit("interface")) & head.rlike(rf"(?<![\w$.])interface\s+{_WORD}")
    at_file = (F.contains(text, F.lit("import")) | F.contains(text, F.lit("package"))) & text.rlike(rf"\A{_AT_FILE}")
    body = F.element_at(F.regexp_extract_all("text", F.lit(DEAD), F.lit(0)), -1)
    return gathered.select(
        "path", "pos", "sub", "tkind", "dec", "is_end", "bkind", "flat", F.posexplode_outer(each).alias("nth", "text")
    ).select(
        "path",
        "pos",
        F.when(flat, F.col("nth")).otherwise(F.col("sub")).alias("sub"),
        F.when(~flat, F.col("tkind")).when(opens_type, F.when(is_interface, "interface").otherwise("class")).alias("tkind"),
        F.when(~flat, F.col("dec")).when(closes & block, _decisions(body)).alias("dec"),
        F.when(~flat, F.col("is_end")).otherwise(closes & ~block).alias("is_end"),
        F.when(~flat, F.col("bkind")).when(at_file, "file").otherwise("class").alias("bkind"),
        F.when(~flat, text)
        .otherwise(F.replace(F.when(block, F.regexp_replace(text, DEAD, "{")).otherwise(text), F.lit(LIVE), F.lit("{")))
        .alias("text"),
    )


def declarations(files: DataFrame) -> DataFrame:
    """Every declaration of every usable file, in one table.

    ``kind`` is package, import, class, interface, method, field, or ``end`` for the
    end of a class or interface; ``level`` counts the classes and interfaces around
    (for a type: itself included). ``bkind`` tells apart the blocks that members stand in; in flat files
    it is file for packages and imports and class for all else.
    """
    in_body = F.col("bkind").isin(BODY_KINDS)
    of_type = F.col("tkind").isNotNull()
    head = F.col("head")
    fields_of = (
        F.when(F.col("is_end"), None)
        .when(of_type, F.regexp_replace(head, _TYPE, "$1;$2;$3"))
        .when(F.col("bkind") == "file", F.regexp_replace(head, _FILE_LEVEL, "$1;$2"))
        .when(in_body, F.regexp_replace(head, _MEMBER, "$1;$2;$3;$4;$5"))
    )
    text = F.when(~F.col("is_end"), F.col("text"))
    part = F.col("part")
    named = (
        _with_flat_header(_blocks_and_members(files), text)
        # one row each: the generator keeps filters on ``kind`` from running the header steps anew
        .withColumn("part", F.explode(F.array(F.split(fields_of, ";", -1))))
        .withColumn(
            "kind",
            F.when(F.col("is_end"), F.when(F.col("bkind").isin("class", "interface"), "end"))
            .when(of_type, F.col("tkind"))
            .when((F.col("bkind") == "file") & (F.size(part) == 2), part[0])
            .when(in_body & (F.size(part) == 5) & (part[3] != ""), "method")
            .when(in_body & (F.size(part) == 5) & part[4].rlike(_FIELD_REST), "field"),
        )
    )
    kind = F.col("kind")
    tail = part[2]
    # initialisers go, then every declarator after the first begins at a comma
    end = F.get(part, F.lit(4))
    plain = F.when(F.contains(end, F.lit("(")), F.regexp_replace(end, r"\([^()]*\)", " ")).otherwise(end)
    rest = F.split(plain, ",")
    others = F.transform(
        F.slice(rest, F.lit(2), F.greatest(F.size(rest) - 1, F.lit(0))),
        lambda d: F.regexp_extract(d, rf"^ ?({_WORD})", 1),
    )
    by_pos = Window.partitionBy("path").orderBy("pos")
    in_order = by_pos.rowsBetween(Window.unboundedPreceding, 0)
    whole = by_pos.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = F.when(kind.isin("class", "interface"), 1).when(kind == "end", -1).otherwise(0)
    parsed = named.select(
        "path",
        # two declarations can share a run: its position is told apart by the cut
        (F.col("pos").cast("long") * 2**31 + F.col("sub")).alias("pos"),
        "kind",
        "bkind",
        F.when(kind.isin("package", "import", "class", "interface"), part[1])
        .when(kind.isin("method", "field"), part[2])
        .alias("name"),
        # what stands before a member is modifiers only
        F.when(kind.isin("class", "interface"), _mods(part[0]))
        .when(kind.isin("method", "field"), F.when(part[0] == "", _none()).otherwise(F.split(F.rtrim(part[0]), " ")))
        .alias("modifiers"),
        F.when(kind == "class", _names(F.regexp_extract(tail, r"\bextends ([\w$.\p{L}]+)", 1)))
        .when(kind == "interface", _names(F.regexp_extract(tail, r"\bextends (.*?)(?: permits .*)?$", 1)))
        .alias("extends"),
        F.when(kind == "class", _names(F.regexp_extract(tail, r"\bimplements (.*?)(?: permits .*)?$", 1))).alias("implements"),
        F.when(kind.isin("method", "field"), _bare(part[1])).alias("type"),
        F.when(kind == "method", _parameters(F.translate(part[3], "()", ""))).alias("parameters"),
        F.when((kind == "field") & ~F.contains(plain, F.lit(",")), F.array(part[2]))
        .when(kind == "field", F.filter(F.concat(F.array(part[2]), others), lambda n: n != ""))
        .alias("declarators"),
        F.when(kind == "method", 1 + F.coalesce("dec", F.lit(0))).alias("complexity"),
    )
    return (
        parsed.withColumn("level", F.sum(step).over(in_order))
        .withColumn("package", F.max(F.when(kind == "package", F.col("name"))).over(whole))
        .filter(kind.isin("package", "import", "class", "interface", "method", "field", "end"))
    )


def _signature() -> Column:
    args = F.array_join(F.transform("parameters", lambda p: F.concat(p["type"], F.lit(" "), p["name"])), ", ")
    return F.trim(
        F.concat(F.array_join("modifiers", " "), F.lit(" "), F.col("type"), F.lit(" "), F.col("name"), F.lit("("), args, F.lit(")"))
    )


def owned(decls: DataFrame, recursive: bool = True) -> DataFrame:
    """Types, and each method and field once per type that owns it.

    A member at level n has exactly one enclosing type on each level 1..n: the latest
    type that began on that level. So the member is copied to its levels and picks the
    type up in a window; no interval join is needed.
    """
    is_type = F.col("kind").isin("class", "interface")
    is_member = F.col("kind").isin("method", "field")
    first_level = F.lit(1) if recursive else F.col("level")
    wanted = is_type | (is_member & (F.col("level") > 0))
    if not recursive:
        wanted = is_type | (is_member & F.col("bkind").isin("class", "interface"))
    leveled = decls.filter(wanted).withColumn(
        "at", F.explode(F.when(is_type, F.array("level")).otherwise(F.sequence(first_level, F.col("level"))))
    )
    w = Window.partitionBy("path", "at").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.struct("pos", "name", "kind", "modifiers", "extends", "implements")
    return leveled.withColumn("owner", F.last(F.when(is_type, owner), ignorenulls=True).over(w))


def methods(decls: DataFrame, recursive: bool = True) -> DataFrame:
    """One row per method and owning type."""
    return (
        owned(decls, recursive)
        .filter(F.col("kind") == "method")
        .select(
            "path",
            "package",
            F.col("owner.pos").alias("type_pos"),
            F.col("owner.name").alias("type_name"),
            F.col("owner.kind").alias("type_kind"),
            "pos",
            "name",
            _signature().alias("signature"),
            "modifiers",
            F.col("type").alias("return_type"),
            "parameters",
            "complexity",
        )
    )


def fields(decls: DataFrame, recursive: bool = True) -> DataFrame:
    """One row per declared variable and owning type."""
    return (
        owned(decls, recursive)
        .filter(F.col("kind") == "field")
        .select(
            "path",
            "package",
            F.col("owner.pos").alias("type_pos"),
            F.col("owner.name").alias("type_name"),
            F.col("owner.kind").alias("type_kind"),
            "pos",
            F.posexplode("declarators").alias("idx", "name"),
            "type",
            "modifiers",
        )
    )


def types(decls: DataFrame, recursive: bool = True, nested: bool = False) -> DataFrame:
    """One row per class or interface, with counts and mean method complexity.

    ``nested=True`` adds the member lists ``methods`` and ``fields``; a list holds the
    members of one type of one file, in source order.
    """
    rows = owned(decls, recursive)
    is_method = F.col("kind") == "method"
    is_field = F.col("kind") == "field"
    aggs = [
        F.first("package").alias("package"),
        F.first("owner").alias("owner"),
        F.count_if(is_method).alias("method_count"),
        F.coalesce(F.sum(F.when(is_field, F.size("declarators"))), F.lit(0)).cast("long").alias("field_count"),
        F.coalesce(F.avg(F.when(is_method, F.col("complexity"))), F.lit(0.0)).alias("avg_complexity"),
    ]
    lists = []
    if nested:
        method = F.struct(
            "pos", "name", _signature().alias("signature"), "modifiers", F.col("type").alias("return_type"),
            "parameters", "complexity",
        )
        field = F.struct("pos", "declarators", "type", "modifiers")
        aggs += [
            F.array_sort(F.collect_list(F.when(is_method, method))).alias("m"),
            F.array_sort(F.collect_list(F.when(is_field, field))).alias("f"),
        ]
        lists = [
            F.transform("m", lambda m: m.dropFields("pos")).alias("methods"),
            F.flatten(
                F.transform(
                    "f",
                    lambda f: F.transform(
                        f["declarators"],
                        lambda n: F.struct(n.alias("name"), f["type"].alias("type"), f["modifiers"].alias("modifiers")),
                    ),
                )
            ).alias("fields"),
        ]
    return (
        rows.groupBy("path", F.col("owner.pos").alias("type_pos"))
        .agg(*aggs)
        .select(
            "path",
            "type_pos",
            F.col("owner.name").alias("name"),
            F.col("owner.kind").alias("kind"),
            "package",
            F.col("owner.modifiers").alias("modifiers"),
            F.col("owner.extends").alias("extends"),
            F.coalesce("owner.implements", F.array().cast("array<string>")).alias("implements"),
            "method_count",
            "field_count",
            "avg_complexity",
            *lists,
        )
    )


def packages(decls: DataFrame) -> DataFrame:
    """Package of each file that names one."""
    return decls.filter(F.col("kind") == "package").select("path", F.col("name").alias("package"))


def imports(decls: DataFrame) -> DataFrame:
    """Imported paths of each file in source order, without the trailing ``.*``."""
    return (
        decls.filter(F.col("kind") == "import")
        .groupBy("path")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("i"))
        .select("path", F.transform("i", lambda x: x["name"]).alias("imports"))
    )


def rejects(files: DataFrame) -> DataFrame:
    """``path, reason`` of the files that give no declarations, in one pass over the texts.

    ``encoding`` where the reader could not decode the file (a null text), ``unbalanced`` where brackets or
    quotes do not close in order.
    """
    reason = F.when(F.col("code").isNull(), "encoding").when(~F.col("usable"), "unbalanced")
    # An array of one or none: a filter would be pushed below and run the cleaning once more.
    return clean_files(files).select("path", F.explode(F.array_compact(F.array(reason))).alias("reason"))


def edges(type_rows: DataFrame) -> DataFrame:
    """Inheritance edges ``path, child, relation, parent``."""
    def out(col: str) -> DataFrame:
        return type_rows.select("path", F.col("name").alias("child"), F.lit(col).alias("relation"), F.explode(col).alias("parent"))

    return out("extends").unionByName(out("implements"))
