"""Declarations, imports, calls and heritage of TypeScript and JavaScript source.

A small lexer gives the tokens of a file as rows, with their brackets; everything else is windows over the tokens of a file and joins on brackets. There is no
grammar: type arguments that hold braces, and calls with type arguments, are not told apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import fingerprint
from tessera.operators.lineage import stored

LEXER = re.compile(
    r"(?P<space>\s+|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<string>'(?:\\[\s\S]|[^'\\\n])*'?|\"(?:\\[\s\S]|[^\"\\\n])*\"?)|(?P<word>[A-Za-z_$#@\u0080-￿][\w$]*)|(?P<number>\d[\w.]*)|(?P<sign>\?\.(?!\d)|=>|\.\.\.|&&|\|\||\?\?|[\s\S])"
)
TEMPLATE = re.compile(r"(?:\\[\s\S]|(?!\$\{)[^`\\])*(?P<end>`|\$\{|\Z)")
PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
CLOSES = {")": "(", "]": "[", "}": "{"}
# Words that no call or expression ends with, words in front of a declaration, and signs after which something is an expression.
KEYWORDS = ["if", "for", "while", "switch", "catch", "return", "typeof", "await", "new", "function", "case", "in", "of", "do", "else", "void", "delete", "yield", "throw", "import", "super", "with", "instanceof", "extends", "export", "default", "const", "let", "var", "class"]
MODIFIERS = ["export", "default", "async", "abstract", "declare", "public", "private", "protected", "static", "readonly", "override"]
OPERATORS = ["=", "(", ",", ":", "?", "=>", "[", "!", "&&", "||", "??", "+", "-", "*", "&", "|", "<", ">", "...", "return", "new", "typeof", "void", "await", "yield", "extends", "."]
TYPE_SIGNS = [":", "|", "&", "=>", "<", ",", "(", "is", "keyof", "readonly", "extends", "infer"]
TOKEN = "path string, i int, kind string, text string, line int, outer int, closed int, opened int, left string, fresh boolean"


def tokens_of(text: str) -> list[tuple]:
    """``kind, text, line, outer`` (the bracket around), ``closed, opened`` (the other bracket of a pair), ``left`` (what a called member belongs to), ``fresh`` (after ``new``)."""
    rows: list[list] = []
    spans, begins, stack = [], [], []
    at, line, n = 0, 1, len(text)

    def ends(i: int) -> bool:
        """Whether an expression may end with a token."""
        return i >= 0 and (rows[i][0] in ("string", "number") or rows[i][0] == "word" and rows[i][1] not in KEYWORDS or rows[i][1] in (")", "]", "!") and begins[i] >= 0)

    def add(kind: str, start: int, stop: int) -> None:
        nonlocal line
        word, i = text[start:stop], len(rows)
        outer, opened = stack[-1] if stack else None, None
        if kind == "sign" and word in CLOSES and stack:
            opened = stack.pop()
            rows[opened][4], outer = i, stack[-1] if stack else None
        before = rows[i - 1][1] if i else ""
        begin = i
        if kind != "sign":
            begin = begins[i - 2] if before in (".", "?.") and i > 1 and begins[i - 2] >= 0 else i
        elif word in (")", "]") and opened is not None:
            begin = begins[opened - 1] if ends(opened - 1) else opened
        elif word == "!" and ends(i - 1):
            begin = begins[i - 1]
        else:
            begin = -1
        rows.append([kind, word if kind != "string" else word, line, outer, None, opened, None, False])
        spans.append((start, stop))
        begins.append(begin)
        if kind == "sign" and word in CLOSES.values():
            stack.append(i)
            if word == "(" and i and rows[i - 1][0] == "word":
                first = begins[i - 1]
                fresh = first > 0 and rows[first - 1][1] == "new"
                chain = [r[1] for r in rows[first : i - 1]] if first >= 0 else []
                rows[i - 1][7] = fresh and ")" not in chain
                if i > 1 and rows[i - 2][1] in (".", "?.") and begins[i - 3] >= 0:
                    rows[i - 1][6] = text[spans[first - 1 if fresh else first][0] : spans[i - 3][1]]
        line += word.count("\n")

    while at < n:
        if text[at] == "`" or text[at] == "}" and stack and rows[stack[-1]][1] == "${":
            if text[at] == "}":
                opened = stack.pop()
                rows[opened][4] = len(rows)
            m = TEMPLATE.match(text, at + 1)
            add("string", at, m.end() if m["end"] != "${" else m.end() - 2)
            at = m.end()
            if m["end"] == "${":
                add("sign", at - 2, at)
                stack.append(len(rows) - 1)
            continue
        m = PATTERN.match(text, at) if text[at] == "/" and text[at + 1 : at + 2] not in ("/", "*") and not ends(len(rows) - 1) else None
        if m:
            add("string", at, m.end())
        else:
            m = LEXER.match(text, at)
            if m["space"]:
                line += m[0].count("\n")
            else:
                add(m.lastgroup, at, m.end())
        at = m.end()
    return [tuple(r) for r in rows]


def tokens(files: DataFrame) -> DataFrame:
    """The tokens of files (``path, text``) in order; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in TOKEN.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = [(path, i, *t) for i, t in enumerate(tokens_of(text or ""))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    # dealt out first: a small file of rows is one task, and lexing it is most of the work
    return files.select("path", "text").repartition("path").mapInArrow(run, TOKEN)


def _near(k: int, column: str = "text") -> Column:
    """A column of the token ``k`` places on."""
    w = Window.partitionBy("path").orderBy("i")
    return F.lead(column, k).over(w) if k > 0 else F.lag(column, -k).over(w)


def contexts(found: DataFrame) -> DataFrame:
    """Tokens with their neighbours, the line on which a declaration that they belong to begins, and the bracket that a body may open with after them."""
    after = Window.partitionBy("path", "outer").orderBy("i").rowsBetween(1, Window.unboundedFollowing)
    starts = F.col("line")
    for k in (1, 2, 3, 4):
        mods = [_near(-j).isin(MODIFIERS) for j in range(1, k + 1)]
        all_mods = mods[0]
        for m in mods[1:]:
            all_mods = all_mods & m
        starts = F.when(all_mods, _near(-k, "line")).otherwise(starts)
    rows = found.withColumns({"prev": _near(-1), "prev_kind": _near(-1, "kind"), "prev_line": _near(-1, "line"), "prev2": _near(-2), "next": _near(1), "next_kind": _near(1, "kind"), "next2": _near(2), "next2_kind": _near(2, "kind"), "next3": _near(3), "start_line": starts})
    # a body opens with the first brace of that level that no type begins with; without one a semicolon ends what is declared
    ending = F.when((F.col("text") == ";") | ((F.col("text") == "{") & ~F.coalesce(F.col("prev"), F.lit("")).isin(TYPE_SIGNS)), F.struct("i", "closed", "line"))
    return rows.withColumn("body", F.first(ending, ignorenulls=True).over(after))


def may_begin() -> Column:
    """Whether a token may begin a member of the brackets around it, modifiers aside."""
    return F.col("prev").isin("{", ";", "}", ",", "*", ")") | F.col("prev").isin(MODIFIERS) | ((F.col("prev_line") < F.col("line")) & ~F.col("prev").isin(OPERATORS))


NAME = r"^[A-Za-z_$\x{80}-\x{ffff}][\w$]*$"
SYMBOLS = "path string, type string, name string, owner string, start_line int, end_line int, at int, opens int, closes int"


def declared(rows: DataFrame) -> DataFrame:
    """Classes, interfaces, functions and methods among tokens (as from ``contexts``): where they begin and end, and the tokens of their bodies."""
    free = ~F.coalesce("prev", F.lit("")).isin(OPERATORS) | F.coalesce(F.col("prev"), F.lit("")).isin("default")
    ends = rows.where("text IN ('}', ';')").select("path", F.col("i").alias("last"), F.col("line").alias("end_line"))
    named = F.when((F.col("text") == "function") & (F.col("next") == "*"), F.col("next2")).otherwise(F.col("next"))
    plain = (
        rows.where(F.col("text").isin("class", "interface", "function") & (F.col("kind") == "word") & free & named.rlike(NAME) & ~named.isin("extends", "implements"))
        .where((F.col("text") != "interface") | F.col("next2").isin("{", "extends", "<"))
        .select("path", F.col("text").alias("type"), named.alias("name"), "outer", "start_line", F.col("i").alias("at"), F.col("body.i").alias("opens"), F.coalesce("body.closed", "body.i").alias("last"))
    )
    # methods stand in the body of a class, or with a body of their own in a literal
    braces = rows.where("text = '{'").select("path", F.col("i").alias("outer"), F.coalesce("prev", F.lit("")).isin("=", "(", ",", ":", "[", "return", "?", "&&", "||", "??", "default", "...").alias("literal"))
    classes = plain.where("type = 'class'").select("path", F.col("opens").alias("outer"), F.col("name").alias("owner"))
    closing = rows.where("text = ')'").select("path", F.col("i").alias("paren"), F.col("next").alias("then"), F.col("body").alias("own"))
    opening = rows.where("text = '('").select("path", (F.col("i") - 1).alias("i"), F.col("closed").alias("paren"))
    heads = rows.where((F.col("kind").isin("word", "string")) & (F.col("next") == "(") & may_begin() & ~F.col("text").isin("constructor", *KEYWORDS) & ~F.col("prev").isin("get", "set"))
    found = heads.join(opening, ["path", "i"]).join(braces, ["path", "outer"]).join(classes, ["path", "outer"], "left").join(closing, ["path", "paren"])
    in_class = F.col("owner").isNotNull()
    in_literal = F.col("literal") & F.col("prev").isin("{", ",", "*", "async") & ((F.col("then") == "{") | ((F.col("then") == ":") & F.col("own.closed").isNotNull()))
    methods = found.where(in_class & F.col("then").isin("{", ":", ";") | in_literal).select(
        "path", F.lit("method").alias("type"), F.col("text").alias("name"), "owner", "start_line", F.col("i").alias("at"), F.col("own.i").alias("opens"), F.coalesce("own.closed", "own.i").alias("last")
    )
    both = plain.select("path", "type", "name", F.lit(None).cast("string").alias("owner"), "start_line", "at", "opens", "last").unionByName(methods)
    return both.join(ends, ["path", "last"], "left").select("path", "type", "name", "owner", "start_line", F.coalesce("end_line", "start_line").alias("end_line"), "at", "opens", F.col("last").alias("closes"))


def with_owners(found: DataFrame) -> DataFrame:
    """Methods of literals belong to the class around them: the innermost that holds them."""
    classes = found.where("type = 'class'").select("path", F.col("name").alias("around"), F.col("opens").alias("a"), F.col("closes").alias("z"))
    bare = found.where("type = 'method' AND owner IS NULL").select("path", "at")
    inner = bare.join(classes, "path").where("a < at AND at < z").groupBy("path", "at").agg(F.max_by("around", "a").alias("around"))
    out = found.join(inner, ["path", "at"], "left").withColumn("owner", F.coalesce("owner", "around")).drop("around")
    qualified = F.when(F.col("type") == "method", F.concat_ws(".", "owner", "name")).otherwise(F.col("name"))
    return out.withColumn("qualified", qualified).withColumn("id", fingerprint("path", "type", qualified, F.col("at").cast("string"), size=24))


def calls(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """``path, at, line, name, qualifier, caller``: calls, and the innermost function or method whose body or head they stand in (null: none).

    Tokens meet the brackets around them: each function marks where it opens and closes, and the sum of what is open tells its depth, so no
    call is compared with every function of its file.
    """
    head = rows.where((F.col("kind") == "word") & (F.col("next") == "(") & ~F.col("text").isin(KEYWORDS) & ~F.col("fresh") & ~F.col("prev").isin("function", "class", "@") & ~F.col("text").startswith("@"))
    head = head.where(((F.col("prev") != "*") | (F.col("prev2") != "function")) & ~(F.col("prev").isin("get", "set") & F.col("prev2").isin("{", ",", ";", "}")))
    # what begins a member of a class or stands in an interface is declared, not called
    bodies = symbols.where("type IN ('class', 'interface')").select("path", F.col("opens").alias("outer"), F.col("type").alias("holder"))
    head = head.join(bodies, ["path", "outer"], "left").where((F.col("holder").isNull() | ((F.col("holder") == "class") & ~(may_begin() | F.col("prev").isin("get", "set")))))
    heads = head.join(symbols.where("type IN ('method', 'function')").select("path", F.col("at").alias("i")), ["path", "i"], "left_anti").select("path", "i", "line", F.col("text").alias("name"), F.col("left").alias("qualifier"))
    bodies = symbols.where("type IN ('function', 'method')").select("path", "id", "at", "closes")
    marks = bodies.select("path", F.col("at").alias("i"), F.lit(1).alias("d"), "id").unionByName(bodies.select("path", F.col("closes").alias("i"), F.lit(-1).alias("d"), "id")).withColumn("call", F.lit(False))
    both = marks.select("path", "i", "d", "id", "call", F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("qualifier")).unionByName(
        heads.select("path", "i", F.lit(0).alias("d"), F.lit(None).cast("string").alias("id"), F.lit(True).alias("call"), "line", "name", "qualifier")
    )
    order = Window.partitionBy("path").orderBy("i", "d").rowsBetween(Window.unboundedPreceding, 0)
    deep = both.withColumn("depth", F.sum("d").over(order)).withColumn("level", F.when(F.col("d") == 1, F.col("depth")).when(F.col("d") == 0, F.col("depth")))
    same = Window.partitionBy("path", "level").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    out = deep.where("level IS NOT NULL").withColumn("caller", F.last(F.when(F.col("d") == 1, F.col("id")), ignorenulls=True).over(same))
    return out.where("call").select("path", F.col("i").alias("at"), "line", "name", "qualifier", F.when(F.col("depth") > 0, F.col("caller")).alias("caller"))


def _gathered(rows: DataFrame, first: Column, last: Column) -> DataFrame:
    """Tokens from each ``first`` to the next ``last`` of a file, as an array: statements, no longer than one."""
    w = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = rows.withColumn("no", F.sum(first.cast("int")).over(w)).where("no > 0")
    inside = Window.partitionBy("path", "no").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("over", F.coalesce(F.sum(last.cast("int")).over(inside), F.lit(0))).where("over = 0")
    return each.groupBy("path", "no").agg(F.min("i").alias("at"), F.array_sort(F.collect_list(F.struct("i", "text", "kind"))).alias("t"))


def _unquoted(text: Column) -> Column:
    return F.substring(text, F.lit(2), F.length(text) - 2)


PAIR = "array<struct<local:string,imported:string,kind:string>>"


def linked(rows: DataFrame) -> DataFrame:
    """``path, at, word`` (import or export), ``source, bindings`` (``local, imported, kind``) of import statements and of exports from elsewhere."""
    first = (F.col("text").isin("import", "export")) & (F.col("kind") == "word") & F.col("outer").isNull() & (~F.coalesce("prev", F.lit("")).isin(".", "?."))
    opens = first & ((F.col("text") == "import") & (F.col("next") != "(") & (F.col("next") != ".") | F.col("next").isin("{", "*") | ((F.col("next") == "type") & F.col("next2").isin("{", "*")))
    # a source is the string after from, or right after import; without one before the next statement it is no import
    found = _gathered(rows, opens, ((F.col("kind") == "string") & F.col("prev").isin("from", "import")) | (F.col("text") == ";"))
    texts = F.transform("t", lambda x: x["text"])
    code = F.array_join(F.filter(texts, lambda x: x != "type"), " ")
    source = F.element_at("t", -1)
    named = F.regexp_extract(code, r"\{([^}]*)\}", 1)
    parts = F.filter(F.transform(F.split(named, ","), lambda p: F.trim(p)), lambda p: p != "")
    pairs = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"(\S+)$", 1).alias("local"), F.regexp_extract(p, r"^(\S+)", 1).alias("imported"), F.lit("named").alias("kind")))
    one = lambda pattern, imported, kind: F.when(F.regexp_extract(code, pattern, 1) != "", F.array(F.struct(F.regexp_extract(code, pattern, 1).alias("local"), F.lit(imported).alias("imported"), F.lit(kind).alias("kind")))).otherwise(F.array().cast(PAIR))
    everything = F.when(code.rlike(r"^export \* from"), F.array(F.struct(F.lit("*").alias("local"), F.lit("*").alias("imported"), F.lit("all").alias("kind")))).otherwise(F.array().cast(PAIR))
    bindings = F.concat(one(r"^import ([A-Za-z_$][\w$]*) (?:,|from )", "default", "default"), pairs, one(r"\* as ([\w$]+)", "*", "namespace"), everything)
    ok = found.where((source["kind"] == "string"))
    return ok.select("path", "at", F.element_at("t", 1)["text"].alias("word"), _unquoted(F.element_at("t", -1)["text"]).alias("source"), bindings.alias("bindings"))


def heritage(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """``id, path, parent, kind`` (INHERITS, IMPLEMENTS) of classes: the last name of each that is listed before the body."""
    heads = symbols.where("type = 'class'").select("path", "id", "at", "opens")
    w = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.join(heads.select("path", F.col("at").alias("i"), "id", "opens"), ["path", "i"], "left").withColumn("cls", F.last(F.when(F.col("id").isNotNull(), F.struct("id", "opens", "outer")), ignorenulls=True).over(w))
    head = inside.where("cls IS NOT NULL AND i < cls.opens AND outer <=> cls.outer").withColumn("id", F.col("cls.id"))
    own = Window.partitionBy("path", "id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    head = head.withColumn("clause", F.last(F.when(F.col("text").isin("extends", "implements"), F.col("text")), ignorenulls=True).over(own))
    angle = F.sum(F.when(F.col("text") == "<", 1).when((F.col("text") == ">") & (F.col("prev") != "="), -1).otherwise(0)).over(own)
    names = head.withColumn("angle", angle).where("clause IS NOT NULL AND angle = 0 AND kind = 'word' AND text NOT IN ('extends', 'implements')").where(~F.coalesce("next", F.lit("")).isin(".", "?."))
    return names.select("id", "path", F.col("text").alias("parent"), F.when(F.col("clause") == "extends", "INHERITS").otherwise("IMPLEMENTS").alias("kind"))


def parsed(files: DataFrame) -> dict[str, DataFrame]:
    """``symbols``, ``calls``, ``links`` and ``heritage`` of files (``path, text``); tokens and symbols are written once."""
    rows = stored(contexts(stored(tokens(files), "tokens")), "contexts")
    symbols = stored(with_owners(stored(declared(rows), "declared")), "symbols")
    return {"symbols": symbols, "calls": stored(calls(rows, symbols), "calls"), "links": stored(linked(rows), "links"), "heritage": heritage(rows, symbols)}
