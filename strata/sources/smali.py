"""Assembler text of the Dalvik machine as instruction rows, by column expressions over numbered lines.

A file is a table of lines (app_id, file, line_no, line). Methods are islands between `.method` and `.end method`,
instructions are numbered within them, and what stands in payloads and annotations is none. Windows are partitioned
by file, which the platform's limit on a class bounds; no text passes through Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Opcodes that refer to call sites and handles, and the ones that they count as.
NORMALISED = {
    "invoke-polymorphic": "invoke-virtual",
    "invoke-polymorphic/range": "invoke-virtual",
    "invoke-custom": "invoke-static",
    "invoke-custom/range": "invoke-static",
    "const-method-handle": "const-string",
    "const-method-type": "const-string",
}
#: Directives that open an island without instructions.
PAYLOADS = "annotation|subannotation|array-data|packed-switch|sparse-switch"
_REGISTER = r"^[vp]\d+$"


def _at(text: Column | str, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null if there is no match or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _starts(text: str, *prefixes: str) -> Column:
    """Whether a text starts with one of some prefixes; for most lines that spares the patterns."""
    test = F.lit(False)
    for p in prefixes:
        test = test | F.col(text).startswith(p)
    return test


def _listed(text: Column) -> Column:
    """The registers of a list, with a range such as `v0 .. v5` spelt out; anything else in it is left out."""
    low, high = (F.regexp_extract(text, r"^\s*[vp](\d+)\s*\.\.\s*[vp](\d+)\s*$", i) for i in (1, 2))
    spelt = F.transform(F.sequence(F.nullif(low, F.lit("")).cast("int"), F.nullif(high, F.lit("")).cast("int")), lambda i: F.concat(F.substring(F.trim(text), 1, 1), i.cast("string")))
    named = F.regexp_extract_all(text, F.lit(r"(?:^|,) *([vp]\d+) *(?=,|$)"), F.lit(1))
    return F.when(F.contains(text, F.lit("..")) & low.rlike(r"^\d") & (low.cast("int") <= high.cast("int")), spelt).otherwise(named)


def _number(text: Column) -> Column:
    """The value of an integer literal such as -0x1f or 0x10L, null for anything else."""
    digits = _at(text, r"(?:^|,\s*)-?0x([0-9a-fA-F]{1,15})[LtsS]?$")
    return F.conv(digits, 16, 10).cast("long") * F.when(text.rlike(r"-0x[0-9a-fA-F]+[LtsS]?$"), -1).otherwise(1)


def _placed(lines: DataFrame) -> DataFrame:
    """The lines within methods that are an instruction or a label, with what is known of their place: class_name, method_no,
    `_of` (what the method's header says), pos (of a label, that of the instruction before it) and entered."""
    file = Window.partitionBy("app_id", "file").orderBy("line_no")
    so_far = file.rowsBetween(Window.unboundedPreceding, 0)
    text, directive = F.trim(F.coalesce("line", F.lit(""))), F.col("_t").startswith(".")
    only = lambda prefix, pattern: F.when(F.col("_t").startswith(prefix), F.col("_t").rlike(pattern)).otherwise(False)
    header = F.struct(
        _at("_t", r"([^\s(]+)\([^\s]*$").alias("name"), _at("_t", r"(\([^\s]*)$").alias("descriptor"), _at("_t", r"([^\s(]+\([^\s]*)$").alias("signature"), F.col("_t").rlike(r"\sstatic\s").alias("static")
    )
    opens, closes = F.when(directive, F.col("_t").rlike(rf"^\.({PAYLOADS})\b")).otherwise(False), only(".end ", rf"^\.end ({PAYLOADS})\b")
    marked = lines.select("app_id", "file", "line_no", text.alias("_t")).withColumns({
        "class_name": F.last(F.when(F.col("_t").startswith(".class"), _at("_t", r"^\.class\s.*?(L[^;\s]+;)\s*$")), ignorenulls=True).over(so_far),
        "method_no": F.sum(only(".method", r"^\.method\s").cast("int")).over(so_far),
        "_ended": F.sum(only(".end method", r"^\.end method\b").cast("int")).over(so_far),
        "_of": F.last(F.when(only(".method", r"^\.method\s.*$"), header), ignorenulls=True).over(so_far),
        "_payload": F.sum(opens.cast("int") - closes.cast("int")).over(so_far),
    })
    blank = F.when(F.length("_t") <= 2, F.col("_t").rlike("^$")).otherwise(False)
    inside = marked.where((F.col("method_no") > F.col("_ended")) & (F.col("_payload") <= 0) & ~_starts("_t", ".", "#") & ~blank)
    method = Window.partitionBy("app_id", "file", "method_no").orderBy("line_no")
    is_label = F.col("_t").startswith(":")
    return inside.withColumns({
        "pos": (F.sum((~is_label).cast("int")).over(method.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"),
        "entered": F.coalesce(F.lag(is_label).over(method), F.lit(False)),
    })


def instructions(lines: DataFrame) -> DataFrame:
    """The instructions of (app_id, file, line_no, line), one row each:

    class_name, method_no (from 1 in the file), method_name, descriptor, method (class->name descriptor), static, pos
    (from 0 in the method), line_no, opcode (lower case, normalised), kind (its family: invoke, const-string, const, or
    the opcode), raw, registers (those named, ranges spelt out), dst (the first one, where the opcode writes it), text
    and num (its literal), ref (what it refers to) with ref_class, ref_name and ref_desc, label (where it jumps) and
    entered (whether a label stands before it). What a line doesn't have is null. A line that is no instruction, or
    stands outside of a method, gives no row; an unfinished method gives what it has.

    """
    return _read(_placed(lines).where(~F.col("_t").startswith(":")))


def _read(placed: DataFrame) -> DataFrame:
    """The columns of instructions() for rows of _placed().

    A pattern is matched once a line, and only on lines that may fit it: a null for an empty match is put outside of the
    `when` that chooses the pattern, as Spark matches twice for one within.
    """
    numbered = placed.withColumn("_written", F.regexp_extract("_t", r"^(\S+)", 1))
    written = F.nullif(F.lower("_written"), F.lit(""))
    tail = numbered.withColumns({"_lower": written, "_tail": F.substring("_t", F.length("_written") + 1, F.length("_t"))})
    odd = _starts("_lower", "invoke-polymorphic", "invoke-custom", "const-method")
    normal = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in NORMALISED.items() for x in p)), F.col("_lower")), F.col("_lower"))
    rest = F.trim(F.when(F.contains("_tail", F.lit("#")), F.regexp_replace("_tail", r'^([^"]*?)\s*#.*$', "$1")).otherwise(F.col("_tail")))
    cut = tail.withColumns({"opcode": F.when(odd, normal).otherwise(F.col("_lower")), "_rest": F.coalesce(rest, F.lit(""))})
    code, text = F.col("opcode"), F.col("_rest")
    invoke, strings = code.startswith("invoke"), code.startswith("const-string")
    field = F.substring(code, 1, 4).isin("iget", "iput", "sget", "sput")
    constant = (code == "const") | _starts("opcode", "const/", "const-wide")
    typed = _starts("opcode", "new-instance", "check-cast", "instance-of", "new-array", "filled-new-array", "const-class")
    brace, quote = F.instr(text, "{"), F.instr(text, '"')
    parsed = cut.withColumns({
        "_ref": F.when(invoke, F.regexp_extract(text, r"\}\s*,\s*(.*)$", 1)).when(typed, F.regexp_extract(text, r",\s*(\[*[LZBCSIJFDV][^,\s]*)$", 1)),
        "_list": F.when((brace > 0) & ((quote == 0) | (brace < quote)), F.regexp_extract(text, r"\{([^}]*)\}", 1)).when(quote > 0, F.regexp_replace(text, r'".*$', "")).otherwise(text),
        "text": F.nullif(F.when(strings, F.regexp_extract(text, r'"((?:[^"\\]|\\.)*)"', 1)), F.lit("")),
        "num": F.when(constant | _starts("opcode", "add-int/lit", "rsub-int"), _number(text)),
        "label": F.nullif(F.when(_starts("opcode", "if-", "goto"), F.regexp_extract(text, r"(:\S+)$", 1)), F.lit("")),
        "kind": F.when(invoke, "invoke").when(strings, "const-string").when(constant, "const").otherwise(code),
    }).withColumns({
        "ref": F.when(field, F.trim(F.element_at(F.split("_rest", ","), -1))).otherwise(F.nullif("_ref", F.lit(""))),
        "registers": _listed(F.col("_list")),
    })
    writes = ~(_starts("opcode", "invoke", "iput", "sput", "aput", "return", "throw", "if-", "goto", "packed", "sparse", "monitor", "nop", "fill", "filled"))
    either = lambda call, access: F.nullif(F.when(invoke, F.regexp_extract("ref", call, 1)).when(field, F.regexp_extract("ref", access, 1)), F.lit(""))
    return parsed.select(
        "app_id", "file", "class_name", "method_no",
        F.col("_of.name").alias("method_name"), F.col("_of.descriptor").alias("descriptor"),
        F.concat("class_name", F.lit("->"), "_of.signature").alias("method"), F.col("_of.static").alias("static"),
        "pos", "line_no", "opcode", "kind", F.col("_t").alias("raw"), "registers",
        F.when(writes, F.get("registers", F.lit(0))).alias("dst"), "text", "num", "ref",
        either(r"^([^(]*)->[^(]*\(", r"^(.*?)->").alias("ref_class"), either(r"^[^(]*->([^(]*)\(", r"->([^:]*)").alias("ref_name"), either(r"^[^(]*(\(.*)$", r":(.*)$").alias("ref_desc"),
        "label", "entered",
    )


_METHOD = ("app_id", "file", "method_no")


def targets(code: DataFrame, value: Column) -> Column:
    """The least value among the labels of a method that a row's `label` names, where code has rows for labels too, with
    themselves as `label`; null where there is none."""
    return F.min(F.when(F.col("raw").startswith(":"), value)).over(Window.partitionBy(*_METHOD, "label"))


def _numbered_blocks(lines: DataFrame) -> DataFrame:
    """Instructions and labels of lines (raw, pos, opcode, label) with `block`, from 0 in a method (of a label, the block
    that it leads), and on instructions `last`, whether its block ends there.

    A block begins at a label and after what jumps, returns or throws. Everything is a window by method, so that nothing
    is dealt again after the reader's windows by file.
    """
    code = _read(_placed(lines)).select(*_METHOD, "line_no", "raw", "pos", "opcode", "label", "entered")
    is_label = F.col("raw").startswith(":")
    order = Window.partitionBy(*_METHOD).orderBy("line_no")
    instruction = F.when(~is_label, F.col("opcode").rlike("^(if-|goto|return|throw|packed-switch|sparse-switch)"))
    before = F.last(instruction, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    led = code.withColumns({"label": F.when(is_label, F.col("raw")).otherwise(F.col("label")), "_leads": ~is_label & ((F.col("pos") == 0) | F.col("entered") | F.coalesce(before, F.lit(False)))})
    so_far = F.sum(F.col("_leads").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    block = (so_far - F.when(is_label, 0).otherwise(1)).cast("int")
    return led.withColumns({"block": block, "last": F.coalesce(is_label | F.lead("_leads").over(order) | F.lead(is_label).over(order), F.lit(True))})


def block_ways(lines: DataFrame) -> DataFrame:
    """(app_id, file, method_no, block, ways): each block with the blocks that its last instruction may go to, falling
    through or jumping, in an array of two at most."""
    code = _numbered_blocks(lines)
    every = Window.partitionBy(*_METHOD)
    is_label, ends = F.col("raw").startswith(":"), F.col("opcode").rlike("^(goto|return|throw)")
    aimed = code.withColumn("_final", F.max(F.when(~is_label, F.col("block"))).over(every)).withColumn("_to", targets(code, F.col("block")))
    falls = F.when(~ends & (F.col("block") < F.col("_final")), F.col("block") + 1)
    jumps = F.when(F.col("_to") <= F.col("_final"), F.col("_to"))
    return aimed.where(~is_label & F.col("last")).select(*_METHOD, "block", F.array_distinct(F.array_compact(F.array(falls, jumps))).alias("ways"))


def flow_graph(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks (app_id, file, method_no, pos, block) and edges (app_id, file, method_no, src, dst) of the methods of
    lines: a block begins at a label and after what jumps, returns or throws; an edge falls through or jumps."""
    blocks = _numbered_blocks(lines).where(~F.col("raw").startswith(":")).select(*_METHOD, "pos", "opcode", "block")
    return blocks, block_ways(lines).select(*_METHOD, F.col("block").alias("src"), F.explode("ways").alias("dst"))


def for_detectors(code: DataFrame) -> DataFrame:
    """code as the method-level detectors read it: registers are numbers, those of parameters from 1000 on, and arg1 and
    arg2 are the first arguments of a call without `this`."""
    number = lambda r: F.when(F.substring(r, 1, 1) == "p", 1000).otherwise(0) + F.substring(r, F.lit(2), F.length(r)).cast("int")
    this = F.when(F.col("opcode").startswith("invoke-static"), 0).otherwise(1)
    argument = lambda i: F.when(F.col("kind") == "invoke", number(F.get("registers", this + i)))
    return code.select(
        "method", "pos", "class_name", "method_name", "kind", "ref", "text", F.col("num").cast("int").alias("num"), number(F.col("dst")).alias("dst"),
        argument(0).alias("arg1"), argument(1).alias("arg2"),
    )
