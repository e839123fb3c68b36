"""Queries over assembler text: instructions, flow graphs and detectors fed from them, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.catalogues import flows as labels
from strata.catalogues import taint as values
from strata.operators import detectors, flows, taint
from strata.plans import detect
from strata.plans.views import VIEWS, table, with_views
from strata.plans.views import values as rows_sql
from strata.sources import smali

QUERIES, SQL = {}, {}

#: Lines of a method, cut at |: $a and $b are registers, $n and $l numbers, $c the file, ~ a backslash.
TEMPLATES = (
    'const-string $a, "AES/ECB/PKCS5Padding"', "const/4 $a, 0x$n|move-object $a, p0", "move-object/from16 $a, $b",
    "invoke-virtual {$b}, Landroid/telephony/TelephonyManager;->getDeviceId()Ljava/lang/String;|.line $l|move-result-object $a",
    "invoke-static {$a, $b}, Landroid/util/Log;->d(Ljava/lang/String;Ljava/lang/String;)I",
    "invoke-static {$a}, Ljavax/crypto/Cipher;->getInstance(Ljava/lang/String;)Ljavax/crypto/Cipher;|move-result-object $b",
    "iput-object $a, $b, Lcom/app/Box;->f$n:Ljava/lang/String;", "iget-object $a, $b, Lcom/app/Box;->f$n:Ljava/lang/String;",
    "invoke-virtual/range {v0 .. v3}, Lcom/app/Wide;->put(IILjava/lang/String;)V", "if-eqz $a, :cond_$l|nop|:cond_$l|move-object $a, $b", "goto :goto_$l|const/16 $a, -0x1f|:goto_$l",
    "sput-object $a, Lcom/app/G;->s$n:Ljava/lang/String;", "sget-object $a, Lcom/app/G;->s$n:Ljava/lang/String;",
    "invoke-polymorphic {$a, $b}, Ljava/lang/invoke/MethodHandle;->invoke([Ljava/lang/Object;)Ljava/lang/Object;, (I)V", "const-method-handle $a, invoke-static@Lcom/app/H;->h()V",
    "aput-object $a, $b, v3", "aget-object $a, $b, v3    # of $b", "invoke-static {$a}, Lcom/app/C$c;->m$n(Ljava/lang/String;)Ljava/lang/String;|move-result-object $b",
    "invoke-virtual {$a, $b}, Ljava/lang/StringBuilder;->append(Ljava/lang/String;)Ljava/lang/StringBuilder;|move-result-object v$n", "invoke-virtual {$a}, Ljava/lang/StringBuilder;->toString()Ljava/lang/String;|move-result-object $b",
    "invoke-interface {$a, $b}, Ljava/util/List;->add(Ljava/lang/Object;)Z", "invoke-interface {$b, v3}, Ljava/util/List;->get(I)Ljava/lang/Object;|move-result-object $a",
    "invoke-static {$a, $b}, Ljava/net/URLEncoder;->encode(Ljava/lang/String;Ljava/lang/String;)Ljava/lang/String;|move-result-object $b",
    "invoke-virtual {$a, $b}, Landroid/text/Html;->escapeHtml(Ljava/lang/CharSequence;)Ljava/lang/String;",
    "invoke-virtual {v1, $b}, Ljava/lang/Runtime;->exec(Ljava/lang/String;)Ljava/lang/Process;", "invoke-virtual {$a, $b}, Landroid/webkit/WebView;->loadUrl(Ljava/lang/String;)V",
    'const-string $a, "MD5, or ~"v$n~" # no"|const-string/jumbo $b, "MD5"', "invoke-static {$b}, Ljava/security/MessageDigest;->getInstance(Ljava/lang/String;)Ljava/security/MessageDigest;|move-result-object $a",
    ".array-data 4|    0x1t|.end array-data|nop", "# a comment|throw $a", "invoke-virtual {$a, $b, $a}, Lcom/app/Native;->nativePost(Ljava/lang/String;Ljava/lang/String;)V",
    "invoke-static {$b}, Lcom/app/Native;->decrypt(Ljava/lang/String;)Ljava/lang/String;|move-result-object $a", "invoke-static {}, Lcom/app/Native;->loadKey()[B|move-result-object $a",
    "invoke-virtual {$a, $b}, Lcom/app/Native;->hash(Ljava/lang/String;)V", "invoke-static {$a}, Landroid/util/Log;->v(", "new-instance $a, Ljava/util/Random;|invoke-direct {$a}, Ljava/util/Random;-><init>()V",
    "invoke-virtual {v3}, Landroid/widget/EditText;->getText()Landroid/text/Editable;|move-result-object $b", "invoke-virtual {v3}, Landroid/telephony/TelephonyManager;->getImei()Ljava/lang/String;|move-result-object $a",
    "invoke-static {v2, $b}, Landroid/util/Log;->d(Ljava/lang/String;Ljava/lang/String;)I", "invoke-virtual {v3, $a}, Ljava/lang/Runtime;->exec(Ljava/lang/String;)Ljava/lang/Process;",
    "invoke-static {$b}, Lcom/app/C$c;->m$n(Ljava/lang/String;)Ljava/lang/String;|move-result-object $a", "move-object $b, $a|return-object $b",
)


def _templates() -> str:
    parts = " ".join(f"when {i} then '{t.replace(chr(39), chr(39) * 2)}'" for i, t in enumerate(TEMPLATES))
    return f"case (l_partkey * 7 + l_suppkey * 3 + l_linenumber * 5) % {len(TEMPLATES)} {parts} end"


_TEXT = "cast({} as varchar(20))"
_FILE = "(l_orderkey - l_orderkey % 4)"
_FILLED = _templates()
for _mark, _value in (
    ("$a", "'v' || " + _TEXT.format("l_suppkey % 4")), ("$b", "'v' || " + _TEXT.format("(l_partkey + l_linenumber) % 4")), ("$n", _TEXT.format("l_partkey % 4")),
    ("$l", _TEXT.format("l_linenumber")), ("$c", _TEXT.format(_FILE)), ("~", "chr(92)"),
):
    _FILLED = f"replace({_FILLED}, '{_mark}', {_value})"
_CLASS = f"'.class public final Lcom/app/C' || {_TEXT.format(_FILE)} || ';|.super Ljava/lang/Object;'".replace(_FILE, "file")
_METHOD = f"'.method public ' || case when l_orderkey % 3 = 0 then 'static ' else '' end || 'm' || {_TEXT.format('l_orderkey % 4')} || '(Ljava/lang/String;)Ljava/lang/String;|    .registers 6'"
_END = f"'    return-object v' || {_TEXT.format('l_orderkey % 4')} || '|.end method'"
VIEWS["smali"] = (
    "lineitem",
    f"""select file % 13 as app_id, file, cast(row_number() over (partition by file order by o, s, k) as int) as line_no, line from (
        select file, o, s, k, split_part(body, '|', k) as line from (
            select {_FILE} as file, l_orderkey as o, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) as s, {_FILLED} as body from lineitem
            union all select distinct {_FILE}, cast(-1 as bigint), cast(0 as bigint), '.class public final Lcom/app/C' || {_TEXT.format(_FILE)} || ';|.super Ljava/lang/Object;' from lineitem
            union all select distinct {_FILE}, l_orderkey, cast(0 as bigint), '.method public ' || case when l_orderkey % 3 = 0 then 'static ' else '' end || 'm' || {_TEXT.format('l_orderkey % 4')} || '(Ljava/lang/String;)Ljava/lang/String;|    .registers 6' from lineitem
            union all select distinct {_FILE}, l_orderkey, cast(1000 as bigint), '    return-object v' || {_TEXT.format('l_orderkey % 4')} || '|.end method' from lineitem
        ) t cross join (values (1), (2), (3), (4)) as n(k)) x where line <> ''""",
)

#: The reader in SQL: lines with their method, then instructions, as CTEs after the view smali.
PARSED = r""", marked as (
        select app_id, file, line_no, trim(line) as t, last_value(nullif(regexp_extract(trim(line), '^\.class\s.*?(L[^;\s]+;)\s*$', 1), '') ignore nulls) over w as class_name,
            cast(sum(case when trim(line) like '.method %' then 1 else 0 end) over w as bigint) as method_no, sum(case when trim(line) = '.end method' then 1 else 0 end) over w as ended,
            last_value(case when trim(line) like '.method %' then trim(line) end ignore nulls) over w as header,
            sum(case when regexp_matches(trim(line), '^\.(annotation|subannotation|array-data|packed-switch|sparse-switch)\b') then 1 when regexp_matches(trim(line), '^\.end (annotation|subannotation|array-data|packed-switch|sparse-switch)\b') then -1 else 0 end) over w as payload
        from smali window w as (partition by file order by line_no)
    ), inside as (select *, t[1] = ':' as is_label from marked where method_no > ended and payload <= 0 and t[1] not in ('.', '#')
    ), placed as materialized (
        select *, cast(sum(case when is_label then 0 else 1 end) over (partition by file, method_no order by line_no) - 1 as int) as pos, coalesce(lag(is_label) over (partition by file, method_no order by line_no), false) as entered from inside
    ), labels as (select file, method_no, t as label, min(pos) + 1 as target from placed where is_label group by all
    ), split as (
        select *, lower(split_part(t, ' ', 1)) as written, trim(regexp_replace(substr(t, length(split_part(t, ' ', 1)) + 1), '^([^"]*?)\s*#.*$', '\1')) as rest, trim(split_part(header, '(', 1)) as named, '(' || split_part(header, '(', 2) as descriptor from placed where not is_label
    ), coded as (
        select *, case written when 'invoke-polymorphic' then 'invoke-virtual' when 'invoke-polymorphic/range' then 'invoke-virtual' when 'invoke-custom' then 'invoke-static' when 'invoke-custom/range' then 'invoke-static'
            when 'const-method-handle' then 'const-string' when 'const-method-type' then 'const-string' else written end as opcode,
            string_split(named, ' ')[-1] as method_name, class_name || '->' || string_split(named, ' ')[-1] || descriptor as method,
            case when starts_with(written, 'invoke') then nullif(trim(ltrim(trim(split_part(rest, '}', 2)), ',')), '') when regexp_matches(written, '^[is](get|put)') then trim(string_split(rest, ',')[-1])
                when regexp_matches(written, '^(new-instance|check-cast|instance-of|new-array|filled-new-array|const-class)') then trim(string_split(rest, ',')[-1]) end as ref,
            case when contains(rest, '..') and contains(rest, '{') then [trim(rest)[2] || i for i in range(cast(regexp_extract(rest, '[vp](\d+)\s*\.\.', 1) as int), cast(regexp_extract(rest, '\.\.\s*[vp](\d+)', 1) as int) + 1)]
                else [trim(x) for x in string_split(case when contains(rest, '{') then regexp_extract(rest, '\{([^}]*)\}', 1) else split_part(rest, '"', 1) end, ',') if regexp_full_match(trim(x), '[vp]\d+')] end as registers
        from split
    ), instr as materialized (
        select app_id, file, class_name, method_no, method_name, method, pos, line_no, opcode, entered, registers, ref,
            case when starts_with(opcode, 'invoke') then 'invoke' when starts_with(opcode, 'const-string') then 'const-string' when regexp_matches(opcode, '^const(/|-wide|$)') then 'const' else opcode end as kind,
            case when not regexp_matches(opcode, '^(invoke|[is]put|aput|return|throw|if-|goto|packed|sparse|monitor|nop|fill|filled)') then registers[1] end as dst,
            case when starts_with(opcode, 'const-string') then nullif(regexp_extract(rest, '"((?:[^"\\]|\\.)*)"', 1), '') end as text,
            case when regexp_matches(opcode, '^const(/|-wide|$)') then cast(replace(regexp_extract(rest, ',\s*(-?0x[0-9a-f]+)$', 1), '0x', '') as int) end as small,
            case when regexp_matches(opcode, '^const(/|-wide|$)') then case regexp_extract(rest, ',\s*(-?0x[0-9a-f]+)$', 1) when '-0x1f' then -31 else cast(right(rest, 1) as bigint) end end as num,
            case when starts_with(opcode, 'invoke') and contains(ref, '(') then split_part(split_part(ref, '(', 1), '->', 1) when regexp_matches(opcode, '^[is](get|put)') then split_part(ref, '->', 1) end as ref_class,
            case when starts_with(opcode, 'invoke') and contains(ref, '(') then split_part(split_part(ref, '(', 1), '->', 2) when regexp_matches(opcode, '^[is](get|put)') then split_part(split_part(ref, '->', 2), ':', 1) end as ref_name,
            case when starts_with(opcode, 'invoke') and contains(ref, '(') then substr(ref, strpos(ref, '(')) when regexp_matches(opcode, '^[is](get|put)') then split_part(ref, ':', 2) end as ref_desc,
            case when regexp_matches(opcode, '^(if-|goto)') then nullif(regexp_extract(rest, '(:\S+)$', 1), '') end as label
        from coded
    )
"""
PARSED = "\n".join(line for line in PARSED.split("\n") if " as small," not in line)


def _query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, with_views(sql, "smali")
        return f

    return put


def lines(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the view smali by columns. Its SQL fills a template anew for each line that it is cut into; here an
    order's items are filled once, after the one shuffle by file, which also serves the reader's windows."""
    keys = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax"]
    items = table(spark, d, "lineitem").select(F.expr(_FILE).alias("file"), "l_orderkey", *keys).repartition("file")
    order = Window.partitionBy("file").orderBy("l_orderkey", *keys)
    first = F.lag("l_orderkey").over(order)
    placed = items.withColumns({"_before": first, "_after": F.lead("l_orderkey").over(order)})
    new, done = ~F.col("_before").eqNullSafe(F.col("l_orderkey")), ~F.col("_after").eqNullSafe(F.col("l_orderkey"))
    text = F.concat_ws(
        "|",
        F.when(F.col("_before").isNull(), F.expr(_CLASS)), F.when(new, F.expr(_METHOD)), F.expr(_FILLED), F.when(done, F.expr(_END)),
    )
    cut = placed.select("file", "l_orderkey", *keys, F.array_remove(F.split(text, r"\|"), "").alias("lines"))
    counted = cut.withColumn("_n", F.sum(F.size("lines")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.size("lines"))
    each = counted.select("file", "_n", F.posexplode("lines").alias("_i", "line"))
    return each.select((F.col("file") % 13).alias("app_id"), "file", (F.col("_n") + F.col("_i") + 1).cast("int").alias("line_no"), "line")


def code(spark: SparkSession, d: str) -> DataFrame:
    return smali.instructions(lines(spark, d))


_COLUMNS = "app_id, file, method_no, method_name, method, pos, line_no, opcode, kind, dst, text, num, ref, ref_class, ref_name, ref_desc, label, entered"


@_query(PARSED + f"select {_COLUMNS}, array_to_string(registers, ' ') as registers from instr")
def smali_instructions(spark: SparkSession, d: str) -> DataFrame:
    return code(spark, d).withColumn("registers", F.array_join("registers", " ")).select(*_COLUMNS.split(", "), "registers")


@_query(
    PARSED
    + """, led as (select i.*, case when pos = 0 or entered or regexp_matches(lag(opcode) over m, '^(if-|goto|return|throw|packed-switch|sparse-switch)') then 1 else 0 end as leads from instr i window m as (partition by file, method_no order by pos)
    ), blocks as (select *, cast(sum(leads) over (partition by file, method_no order by pos) - 1 as int) as block from led
    ), ends as (select *, row_number() over (partition by file, method_no, block order by pos desc) as o from blocks
    ), last as (select b.*, l.target from ends b left join labels l on l.file = b.file and l.method_no = b.method_no and l.label = b.label where o = 1
    ), heads as (select file, method_no, block, min(pos) as start from blocks group by all)
    select distinct a.app_id, a.file, a.method_no, a.block as src, b.block as dst from last a join heads b on a.file = b.file and a.method_no = b.method_no
    where (b.block = a.block + 1 and not regexp_matches(a.opcode, '^(goto|return|throw)')) or b.start = a.target"""
)
def smali_flow_graph(spark: SparkSession, d: str) -> DataFrame:
    return smali.flow_graph(lines(spark, d))[1]


@_query(
    PARSED
    + """, led as (select i.*, case when pos = 0 or entered or regexp_matches(lag(opcode) over m, '^(if-|goto|return|throw|packed-switch|sparse-switch)') then 1 else 0 end as leads from instr i window m as (partition by file, method_no order by pos)
    ), blocks as (select *, cast(sum(leads) over (partition by file, method_no order by pos) - 1 as int) as block, max(pos) over (partition by file, method_no) as final from led
    ), ends as (select *, row_number() over (partition by file, method_no, block order by pos desc) as o from blocks)
    select e.app_id, e.file, e.method_no, e.block from ends e where o = 1 and not exists (select 1 from labels l where l.file = e.file and l.method_no = e.method_no and l.label = e.label) and (pos = final or regexp_matches(opcode, '^(goto|return|throw)'))"""
)
def smali_exit_blocks(spark: SparkSession, d: str) -> DataFrame:
    return smali.block_ways(lines(spark, d)).where(F.size("ways") == 0).drop("ways")


_NUMBER = "case when {0}[1] = 'p' then 1000 else 0 end + cast(substr({0}, 2) as int)"
_CODE = (
    f"""code as (select method, pos, class_name, method_name, kind, ref, text, cast(num as int) as num, {_NUMBER.format('dst')} as dst, {_NUMBER.format('arg1')} as arg1, {_NUMBER.format('arg2')} as arg2 from (
    select *, case when kind = 'invoke' then registers[case when opcode like 'invoke-static%' then 1 else 2 end] end as arg1, case when kind = 'invoke' then registers[case when opcode like 'invoke-static%' then 2 else 3 end] end as arg2 from instr) z)"""
)


#: What crypto_detectors leaves to crypto_small_keys, for code that has the sizes in registers.
_KEYS = f""" union all select f.method, pos, 'CRYPTO_SMALL_KEY', 'HIGH', 'MEDIUM'
    from (select *, coalesce(num, (select arg_max(y.num, y.pos) from code y where y.method = z.method and y.kind = 'const' and y.dst = z.arg1 and y.pos < z.pos and y.num is not null)) as size
        from facts z where kind = 'invoke' and (contains(ref, 'KeyPairGenerator;->initialize') or contains(ref, 'KeyGenerator;->init'))) f
    left join (select method, arg_min(least, dst * 100 + i) as own from pool join {detect._SIZES} on contains(upper(text), name) group by method) o on o.method = f.method
    left join (select class_name, arg_min(least, s1) as told from (select class_name, s1, arg_min(least, i) as least from facts join {detect._SIZES} on contains(upper(s1), name)
        where kind = 'invoke' and (contains(ref, 'KeyPairGenerator;->getInstance') or contains(ref, 'KeyGenerator;->getInstance')) group by class_name, s1) s group by class_name) t on t.class_name = f.class_name
    where size between 64 and 16384 and size < coalesce(own, told, 2048)"""


@_query(PARSED + ", " + detect.SQL["crypto_detectors"].replace(f"with code as ({VIEWS['code'][1]})", _CODE, 1).replace("p.text as s1", "coalesce(p.text, q.text) as s1", 1) + _KEYS)
def smali_crypto(spark: SparkSession, d: str) -> DataFrame:
    return detectors.crypto(smali.for_detectors(code(spark, d)), whole=True)


@_query(PARSED + ", " + detect.SQL["log_detectors"].replace(f"with code as ({VIEWS['code'][1]})", _CODE, 1))
def smali_logs(spark: SparkSession, d: str) -> DataFrame:
    return detectors.logs(smali.for_detectors(code(spark, d)))


# ---------------------------------------------------------------- data flow

#: Calls on the way that the SQL follows; it enumerates the stacks of calls, where the operator has contexts.
NESTED = 5


def _any(column: str, parts) -> str:
    return "(" + " or ".join(f"contains({column}, '{p}')" for p in parts) + ")"


def _table(name: str, rows, columns: str) -> str:
    return f"{name} as (select * from {rows_sql(rows, columns)})"


_VERSION = "{0} || '#' || (select count(distinct z.pos) from stamps z where z.method = c.method and z.reg = {0} and z.pos < {1})"
_PATH = (
    "case op when 'copy' then f.path when 'put' then regexp_extract('.' || field || f.path, '^((?:\\.[^.]*){1," + str(flows.LONGEST) + "})', 1)"
    " else case when f.path = '' then '' when f.path = '.' || field or starts_with(f.path, '.' || field || '.') then substr(f.path, length(field) + 2) end end"
)
_BUILDER = _any("ref", ("StringBuilder;->append", "StringBuffer;->append"))
_TEXT_OF = _any("ref", ("StringBuilder;->toString", "StringBuffer;->toString"))
_HARMLESS = "case sink_label " + " ".join(f"when '{k}' then {v}" for k, v in sorted(flows.covers().items())) + " else 0 end"
def _listed(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


_SEVERITY = "case " + " ".join(f"when sink = '{k}'" + (f" and label in ({_listed(of)})" if of else "") + f" then '{w}'" for k, of, w in labels.SEVERITIES) + " else 'MEDIUM' end"
_CERTAIN = "(" + " or ".join(f"label = '{a}' and sink = '{b}'" for a, b in labels.CERTAIN_PAIRS) + ")"
FLOWS = (
    PARSED
    + ", "
    + ", ".join((
        _table("sources", [(c, m, label) for c, m, label, _ in values.SOURCES], "c, m, label"),
        _table("sinks", [(c, m, label, p) for c, m, label, p in values.SINKS], "c, m, label, p"),
        _table("cleaners", [(c, m, flows.bits([label])) for c, m, label, _ in values.SANITIZERS], "c, m, bit"),
        _table("gives", [(n[0], n[1], a) for n in values.NATIVES for a in n[2]], "c, m, a"),
        _table("makes", [(n[0], n[1], label) for n in values.NATIVES for label in n[3]], "c, m, label"),
        _table("stamping", [(n[0], n[1], a, flows.bits([label])) for n in values.NATIVES for a, label in n[4]], "c, m, a, bit"),
        _table("takes", [(n[0], n[1], a, label) for n in values.NATIVES for a, label in n[5]], "c, m, a, label"),
    ))
    + f""", code as materialized (
        select i.app_id, i.method, i.pos, i.opcode, i.kind, i.registers as regs, i.ref, ref_class as rc, ref_name as rn, i.ref_desc, case when opcode like 'invoke-static%' then 0 else 1 end as this,
            case when lead(opcode) over m like 'move-result%' then lead(dst) over m end as res, lead(pos) over m as got from instr i window m as (partition by file, method_no order by pos)
    ), stamps as materialized (
        select method, pos, reg, bit_or(bit) as bit from (
            select method, pos, unnest(regs[2:]) as reg, bit from code join cleaners on rc = c and m in (rn, '*')
            union all select method, pos, regs[a + this + 1], bit from code join stamping on c in (rc, '*') and m in (rn, '*') and kind = 'invoke') t where reg is not null group by all
    ), cleaned as (select method, pos, bit_or(bit) as bit from code join cleaners on rc = c and m in (rn, '*') group by all
    ), plain as (select *, {_BUILDER} as builder, {_TEXT_OF} as texted from code where kind = 'invoke'
    ), moves as materialized (
        select method, pos, pos as got, regs[2] as src, regs[1] as dst, 'copy' as op, null as field from code where opcode like 'move%' and opcode not like '%result%'
        union all select method, pos, pos, regs[1], regs[2], 'put', rn from code where opcode like 'iput%'
        union all select method, pos, pos, regs[2], regs[1], 'get', rn from code where opcode like 'iget%'
        union all select method, pos, pos, regs[1], regs[2], 'put', '[]' from code where opcode like 'aput%'
        union all select method, pos, pos, regs[2], regs[1], 'get', '[]' from code where opcode like 'aget%'
        union all select method, pos, pos, regs[1], 'return', 'copy', null from code where opcode in ('return', 'return-object', 'return-wide')
        union all select method, pos, pos, unnest(regs[2:]), regs[1], 'copy', null from plain where builder
        union all select method, pos, got, unnest(regs), res, 'copy', null from plain where builder
        union all select method, pos, got, regs[1], res, 'copy', null from plain where texted
        union all select method, pos, pos, unnest(regs[2:]), regs[1], 'put', '[]' from plain where not builder and not texted and {_any('ref', labels.CONTAINER_WRITES)}
        union all select method, pos, got, regs[1], res, 'get', '[]' from plain where not builder and not texted and {_any('ref', labels.CONTAINER_READS)}
        union all select method, pos, got, regs[a + this + 1], res, 'copy', null from code join gives on c in (rc, '*') and m in (rn, '*') where kind = 'invoke' and rc is not null
    ), edges as materialized (
        select 'step' as kind, c.method, {_VERSION.format('c.src', 'c.pos')} as read, c.pos as seen, c.method as into_method, case when dst = 'return' then dst else {_VERSION.format('c.dst', 'c.got')} end as write, got, op, field,
            case when got > c.pos then coalesce(k.bit, 0) else 0 end as bit, '' as site from moves c left join cleaned k on k.method = c.method and k.pos = c.pos where src is not null and dst is not null
        union all select 'step', method, {_VERSION.format('c.reg', 'c.pos')}, pos, method, {_VERSION.format('c.reg', 'c.pos + 1')}, pos, 'copy', null, bit, '' from stamps c
        union all select 'call', c.method, {_VERSION.format('c.reg', 'c.pos')}, pos, callee, 'p' || i || '#0', -1, 'copy', null, 0, c.method || ' ' || pos from (select method, pos, rc || '->' || rn || ref_desc as callee, unnest(regs) as reg, unnest(range(len(regs))) as i from code where kind = 'invoke') c where callee in (select method from code)
        union all select 'back', rc || '->' || rn || ref_desc, 'return', 1000000, c.method, {_VERSION.format('c.res', 'c.got')}, got, 'copy', null, 0, c.method || ' ' || pos from code c where kind = 'invoke' and res is not null and rc is not null
    ), seeds as (
        select distinct app_id, method, got as pos, {_VERSION.format('c.res', 'c.got')} as slot, label from (
            select app_id, method, got, res, label from code join sources on rc = c and m in (rn, '*') union all select app_id, method, got, res, label from code join makes on c in (rc, '*') and m in (rn, '*') where kind = 'invoke' and rc is not null) c where res is not null
    ), ends as materialized (
        select distinct method, pos, {_VERSION.format('c.reg', 'c.pos')} as slot, label from (
            select method, pos, regs[p + this + 1] as reg, label from code join sinks on rc = c and m in (rn, '*') where p + this >= 0 union all select method, pos, regs[a + this + 1], label from code join takes on c in (rc, '*') and m in (rn, '*') where kind = 'invoke' and rc is not null) c where reg is not null
    ), flow(app_id, source, source_pos, label, method, slot, path, since, bits, stack) as (
        select app_id, method, pos, label, method, slot, '', pos, 0, []::varchar[] from seeds
        union select * from (select app_id, source, source_pos, label, e.into_method, e.write, {_PATH} as path, e.got, f.bits | e.bit,
            case e.kind when 'call' then list_append(stack, site) when 'back' then stack[:-2] else stack end from flow f join edges e on e.method = f.method and e.read = f.slot and e.seen > f.since
            where (e.kind <> 'call' or len(stack) < {NESTED}) and (e.kind <> 'back' or len(stack) = 0 or stack[-1] = site)) t where path is not null
    )"""
)


HITS = (
    FLOWS
    + """, hits as (
        select app_id, source, source_pos, f.label, e.method as sink_method, e.pos as sink_pos, e.label as sink_label, min(len(stack)) as chain, bit_and(bits) as mask from flow f join ends e on e.method = f.method and e.slot = f.slot and e.pos > f.since group by all)"""
)


@_query(
    HITS
    + f""" select app_id, source as source_method, source_pos, label as source_label, sink_method, sink_pos, sink_label, cast(chain as int) as chain, cast(mask as bigint) as mask,
        case when mask & ({_HARMLESS}) <> 0 then 'full' when mask <> 0 then 'partial' else 'none' end as neutralisation from hits"""
)
def smali_flows(spark: SparkSession, d: str) -> DataFrame:
    return flows.findings(flows.steps(code(spark, d)), NESTED)


@_query(
    HITS
    + f""", named as (select *, case when mask & ({_HARMLESS}) <> 0 then 'full' when mask <> 0 then 'partial' else 'none' end as neutralisation, chain + 1 as methods, label as source_label,
        case when label in ({_listed(labels.PERSONAL)}) and sink_label = 'LOG' then 'PII_LOG' when label in ({_listed(labels.PERSONAL)}) and sink_label = 'NETWORK_OUT' then 'PII_NETWORK' else sink_label end as sink from hits)
    select app_id, source as source_method, source_pos, sink_method, sink_pos, 'TAINT_' || label || '_TO_' || sink as rule_id, {_SEVERITY} as severity, case neutralisation when 'full' then 'LOW' when 'partial' then 'MEDIUM' else
        case when label in ({_listed(labels.NOISY_SOURCES)}) then 'LOW' when {_CERTAIN} and methods <= 5 then 'HIGH' when methods <= 3 then 'HIGH' when methods <= 8 then 'MEDIUM' else 'LOW' end end as confidence, case when starts_with(sink, 'PII_') then 'PRIVACY' else 'TAINT' end as category from named"""
)
def smali_findings(spark: SparkSession, d: str) -> DataFrame:
    found = flows.findings(flows.steps(code(spark, d)), NESTED).withColumn("chain", F.col("chain") + 1)
    return taint.classified(found).select("app_id", "source_method", "source_pos", "sink_method", "sink_pos", "rule_id", "severity", "confidence", "category")


@_query(
    FLOWS
    + f""", levels(method, source_pos, label, slot, path, since, n) as (
        select method, pos, label, slot, '', pos, 0 from seeds
        union select * from (select f.method, source_pos, label, e.write, {_PATH} as path, e.got, f.n + 1 from levels f join edges e on e.kind = 'step' and e.method = f.method and e.read = f.slot and e.seen > f.since) t where path is not null
    ), near as materialized (select method, source_pos, label, slot, path, since, min(n) as n from levels group by all
    ), before as materialized (
        select t.method, t.source_pos, t.label, t.slot, t.path, t.since, f.slot as slot0, f.path as path0, f.since as since0,
            row_number() over (partition by t.method, t.source_pos, t.label, t.slot, t.path, t.since order by f.slot, f.path, f.since) as o
        from near f join edges e on e.kind = 'step' and e.method = f.method and e.read = f.slot and e.seen > f.since
        join near t on t.method = f.method and t.source_pos = f.source_pos and t.label = f.label and t.n = f.n + 1 and t.slot = e.write and t.since = e.got and t.path = {_PATH}
    ), hit as (
        select f.*, e.pos as sink_pos, e.label as sink_label, row_number() over (partition by f.method, f.source_pos, f.label, e.pos, e.label order by f.n, f.slot, f.path, f.since) as o
        from near f join ends e on e.method = f.method and e.slot = f.slot and e.pos > f.since
    ), way(method, source_pos, label, sink_pos, sink_label, step, slot, path, since) as (
        select method, source_pos, label, sink_pos, sink_label, n, slot, path, since from hit where o = 1
        union all select w.method, w.source_pos, w.label, sink_pos, sink_label, step - 1, slot0, path0, since0 from way w
            join before b on o = 1 and b.method = w.method and b.source_pos = w.source_pos and b.label = w.label and b.slot = w.slot and b.path = w.path and b.since = w.since
    )
    select method, source_pos, label as source_label, sink_pos, sink_label, cast(step as int) as step, slot, path, since from way"""
)
def smali_flow_steps(spark: SparkSession, d: str) -> DataFrame:
    return flows.ways_within(code(spark, d))
