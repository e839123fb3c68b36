"""The reader of assembler text, the data flow over it, and the readers of files, on small cases by hand."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strata.operators import detectors, flows, reports, reuse, taint
from strata.sources import binaries, smali

HEAD = [".class public final Lcom/app/C;", ".super Ljava/lang/Object;"]
SOURCE = ["invoke-virtual {v9}, Landroid/telephony/TelephonyManager;->getDeviceId()Ljava/lang/String;", "move-result-object v0"]
EXEC = "invoke-virtual {{v8, {}}}, Ljava/lang/Runtime;->exec(Ljava/lang/String;)Ljava/lang/Process;"
LOAD = "invoke-virtual {{v8, {}}}, Landroid/webkit/WebView;->loadUrl(Ljava/lang/String;)V"


def method(name, *body, descriptor="(Ljava/lang/String;)Ljava/lang/String;"):
    return [f".method public static {name}{descriptor}", *body, ".end method"]


@pytest.fixture
def lines(spark):
    def of(*methods):
        text = [*HEAD, *(line for m in methods for line in m)]
        return spark.createDataFrame([(1, 7, i, line) for i, line in enumerate(text)], "app_id long, file long, line_no int, line string").repartition(3)

    return of


def found(lines, *methods):
    return {(r.source_method.split("->")[1].split("(")[0], r.sink_method.split("->")[1].split("(")[0], r.sink_label): (r.chain, r.neutralisation) for r in flows.findings(flows.steps(smali.instructions(lines(*methods)))).collect()}


def test_instructions(lines):
    rows = smali.instructions(lines(
        method("a", "invoke-virtual {v0, v1}, Landroid/telephony/TelephonyManager;->getDeviceId()Ljava/lang/String;", ".line 3", "move-result-object v3", "  move-object v5, v2  # copy", "",
               "invoke-virtual/range {v1 .. v4}, LX;->y(I)V", "invoke-polymorphic {p0, v1}, LH;->invoke([LO;)LO;, (I)V", 'const-string v2, "a, v1 # \\"{b}\\""', "const/16 v1, -0x1f", "sput-object v1, LG;->f:LT;",
               ".array-data 4", "0x1t", ".end array-data", "INVOKE-STATIC {}, LX;->z()V", "invoke-static {v0}, broken"),
        ["nop", ".method abstract b()V", ".end method"],
    )).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(10)) and {r.method for r in rows} == {"Lcom/app/C;->a(Ljava/lang/String;)Ljava/lang/String;"}
    first = rows[0]
    assert (first.ref_class, first.ref_name, first.ref_desc, first.registers, first.dst) == ("Landroid/telephony/TelephonyManager;", "getDeviceId", "()Ljava/lang/String;", ["v0", "v1"], None)
    assert rows[1].dst == "v3" and rows[2].registers == ["v5", "v2"] and rows[3].registers == ["v1", "v2", "v3", "v4"]
    assert (rows[4].opcode, rows[4].ref_desc) == ("invoke-virtual", "([LO;)LO;, (I)V") and rows[5].text == 'a, v1 # \\"{b}\\"' and rows[5].registers == ["v2"] and rows[6].num == -31
    assert (rows[7].ref_class, rows[7].ref_name, rows[7].ref_desc) == ("LG;", "f", "LT;") and rows[8].opcode == "invoke-static" and rows[8].registers == [] and rows[9].ref_class is None


def test_flow_graph(lines):
    blocks, edges = smali.flow_graph(lines(method("a", "if-eqz v0, :end", "nop", ":loop", "nop", "goto :loop", ":end", "return-void")))
    assert {(r.pos, r.block) for r in blocks.collect()} == {(0, 0), (1, 1), (2, 2), (3, 2), (4, 3)}
    assert {(r.src, r.dst) for r in edges.collect()} == {(0, 1), (0, 3), (1, 2), (2, 2)}


def shuffles(df):
    """How often the plan of df deals its rows anew."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_flow_graph_deals_lines_once(lines):
    table = lines(method("a", "if-eqz v0, :end", "nop", ":end", "return-void"), method("b", "nop"))
    assert shuffles(smali.flow_graph(table)[1]) == 1 and shuffles(smali.block_ways(table)) == 1
    assert {(r.method_no, r.block, *r.ways) for r in smali.block_ways(table).collect()} == {(1, 0, 1, 2), (1, 1, 2), (1, 2), (2, 0)}


def test_labels_of_payloads_are_no_places(lines):
    """What a payload lists are references, not labels; a label without an instruction after it leads nowhere."""
    table = lines(method("a", "if-eqz v0, :x", "nop", ".packed-switch 0x0", ":x", ".end packed-switch", "nop", ":x", "goto :gone", ":gone"))
    edges = smali.flow_graph(table)[1]
    assert {(r.src, r.dst) for r in edges.collect()} == {(0, 1), (0, 2), (1, 2)}


def test_made_lines_are_those_of_the_view(spark, small):
    from strata.plans import smali as plans
    from strata.plans.views import view

    made, want = plans.lines(spark, small), view(spark, small, "smali")
    assert made.count() == want.count() > 0 and made.exceptAll(want).isEmpty() and shuffles(made) <= 1 and "Exchange" in made._jdf.queryExecution().executedPlan().toString()


def test_facts_of_methods_deal_code_once(lines):
    code = smali.for_detectors(smali.instructions(lines(method("a", 'const-string v1, "MD5"', 'const-string v1, "SHA"', 'const-string v0, "x"', "invoke-static {v1}, Lq;->q(I)V"))))
    rows = detectors.facts(code)
    assert shuffles(rows) == 2  # by file for the reader, by method for the rest
    assert [(r.s1, r.s2, r.strings) for r in rows.orderBy("pos").collect()][3] == ("SHA", None, ["x", "SHA"])


@pytest.mark.parametrize("text,rules", [("AES/ECB/PKCS5Padding", {"CRYPTO_ECB_MODE"}), ("AES/GCM/NoPadding", set()), ("DES/CBC/PKCS5Padding", {"CRYPTO_WEAK_ALGORITHM"}), (" des / ecb ", {"CRYPTO_WEAK_ALGORITHM", "CRYPTO_ECB_MODE"})])
def test_cipher_through_the_reader(lines, text, rules):
    code = smali.instructions(lines(method("e", f'const-string v1, "{text}"', "invoke-static {v1}, Ljavax/crypto/Cipher;->getInstance(Ljava/lang/String;)Ljavax/crypto/Cipher;")))
    assert {r.rule_id for r in detectors.crypto(smali.for_detectors(code)).collect()} == rules


def test_sizes_of_keys_through_the_reader(lines):
    """By the method's strings, by another method of the class, or at least 2048 bits; held against the SQL on these lines."""
    import duckdb

    from strata.plans import smali as plans

    init, pair = "invoke-virtual {{v0, {}}}, Ljavax/crypto/KeyGenerator;->init(I)V", "invoke-virtual {v0, v1}, Ljava/security/KeyPairGenerator;->initialize(I)V"
    get = "invoke-static {{{}}}, Ljavax/crypto/Cipher;->getInstance(Ljava/lang/String;Ljava/lang/String;)Ljavax/crypto/Cipher;"
    table = lines(
        method("make", 'const-string v1, "EC"', "invoke-static {v1}, Ljava/security/KeyPairGenerator;->getInstance(Ljava/lang/String;)Ljava/security/KeyPairGenerator;"),
        method("rsa", 'const-string v2, "RSA"', "const/16 v1, 0x800", "const/16 v1, 0x400", pair, "const/16 v1, 0x800", pair),
        method("aes", 'const-string v2, "AES"', "const/16 v1, 0x70", init.format("v1"), "const/16 v3, 0x80", init.format("v3")),
        method("ec", "const/16 v1, 0xa0", pair, "const/16 v1, 0x100", pair, "const/4 v1, 0x1", pair, init.format("p0")),
        method("second", 'const-string v1, "DES"', get.format("v4, v1"), get.format("v1, v4")),
    )
    got = sorted(tuple(r) for r in detectors.crypto(smali.for_detectors(smali.instructions(table)), whole=True).collect())
    short = [(m.split("->")[1].split("(")[0], pos, rule) for m, pos, rule, *_ in got]
    assert short == [("aes", 2, "CRYPTO_SMALL_KEY"), ("ec", 1, "CRYPTO_SMALL_KEY"), ("make", 1, "CRYPTO_KEYSTORE_BYPASS"), ("rsa", 3, "CRYPTO_SMALL_KEY"), ("second", 1, "CRYPTO_WEAK_ALGORITHM"), ("second", 2, "CRYPTO_WEAK_ALGORITHM")]
    con, rows = duckdb.connect(), [tuple(r) for r in table.collect()]
    con.execute("create table given (app_id bigint, file bigint, line_no int, line varchar)")
    con.executemany("insert into given values (?, ?, ?, ?)", rows)
    number = "case regexp_extract(rest, ',\\s*(-?0x[0-9a-f]+)$', 1) when '-0x1f' then -31 else cast(right(rest, 1) as bigint) end"
    sql = plans.SQL["smali_crypto"].replace(plans.VIEWS["smali"][1], "select * from given").replace(number, "cast(regexp_extract(rest, '(0x[0-9a-f]+)$', 1) as bigint)")
    assert number not in sql and sorted(con.execute(sql).fetchall()) == got


def test_paths_containers_and_builders(lines):
    got = found(
        lines,
        method("field", *SOURCE, "iput-object v0, v1, LB;->f:LS;", "move-object v2, v1", "iget-object v3, v2, LB;->g:LS;", LOAD.format("v3"), "iget-object v4, v2, LB;->f:LS;", EXEC.format("v4")),
        method("deep", *SOURCE, "iput-object v0, v1, LB;->f:LS;", "iput-object v1, v2, LB;->g:LS;", "iget-object v3, v2, LB;->g:LS;", "iget-object v4, v3, LB;->f:LS;", EXEC.format("v4")),
        method("list", *SOURCE, "invoke-interface {v1, v0}, Ljava/util/List;->add(Ljava/lang/Object;)Z", LOAD.format("v1").replace("loadUrl", "other"), "invoke-interface {v1, v7}, Ljava/util/List;->get(I)Ljava/lang/Object;", "move-result-object v2", EXEC.format("v2")),
        method("build", *SOURCE, "invoke-virtual {v1, v0}, Ljava/lang/StringBuilder;->append(Ljava/lang/String;)Ljava/lang/StringBuilder;", "invoke-virtual {v1}, Ljava/lang/StringBuilder;->toString()Ljava/lang/String;", "move-result-object v2", EXEC.format("v2")),
        method("late", EXEC.format("v0"), *SOURCE),
    )
    assert got == {(m, m, "EXEC"): (0, "none") for m in ("field", "deep", "list", "build")}


def test_sanitisers_on_every_way(lines):
    clean = "invoke-virtual {v8, v0}, Landroid/text/Html;->escapeHtml(Ljava/lang/CharSequence;)Ljava/lang/String;"
    got = found(
        lines,
        method("full", *SOURCE, clean, LOAD.format("v0")),
        method("partly", *SOURCE, clean, EXEC.format("v0")),
        method("before", *SOURCE, LOAD.format("v0"), clean),
        method("other", *SOURCE, "move-object v1, v0", clean, LOAD.format("v1")),
        method("both", *SOURCE, "move-object v1, v0", clean, "move-object v1, v0", LOAD.format("v1")),
        method("result", *SOURCE, "invoke-static {v0, v7}, Ljava/net/URLEncoder;->encode(Ljava/lang/String;Ljava/lang/String;)Ljava/lang/String;", "move-result-object v2", LOAD.format("v2")),
    )
    assert {k[0]: v[1] for k, v in got.items()} == {"full": "full", "partly": "partial", "before": "none", "other": "none", "both": "none", "result": "full"}


def test_a_helper_keeps_its_callers_apart(lines):
    call = "invoke-static {{{}}}, Lcom/app/C;->help(Ljava/lang/String;)Ljava/lang/String;"
    got = found(
        lines,
        method("help", "move-object v5, p0", "return-object v5"),
        method("tainted", *SOURCE, call.format("v0"), "move-result-object v1", EXEC.format("v1")),
        method("clean", *SOURCE, 'const-string v3, "x"', call.format("v3"), "move-result-object v1", EXEC.format("v1")),
        method("sink", EXEC.format("p0"), "return-void"),
        method("down", *SOURCE, "invoke-static {v0}, Lcom/app/C;->middle(Ljava/lang/String;)Ljava/lang/String;"),
        method("middle", "invoke-static {p0}, Lcom/app/C;->sink(Ljava/lang/String;)Ljava/lang/String;", "invoke-static {p0}, Lcom/app/C;->middle(Ljava/lang/String;)Ljava/lang/String;"),
        method("give", *SOURCE, "return-object v0"),
        method("take", "invoke-static {}, Lcom/app/C;->give(Ljava/lang/String;)Ljava/lang/String;", "move-result-object v1", EXEC.format("v1")),
    )
    assert got == {("tainted", "tainted", "EXEC"): (0, "none"), ("down", "sink", "EXEC"): (2, "none"), ("give", "take", "EXEC"): (0, "none")}


def test_native_effects(lines):
    call = "invoke-{} {{{}}}, Lcom/app/N;->{}(Ljava/lang/String;)Ljava/lang/String;"
    got = found(
        lines,
        method("through", *SOURCE, call.format("static", "v0", "decrypt"), "move-result-object v2", EXEC.format("v2")),
        method("shifted", *SOURCE, call.format("virtual", "v0, v7", "decrypt"), "move-result-object v2", EXEC.format("v2")),
        method("made", call.format("static", "", "loadKey"), "move-result-object v2", EXEC.format("v2")),
        method("sent", *SOURCE, call.format("virtual", "v7, v6, v0", "nativePost")),
        method("hashed", *SOURCE, call.format("virtual", "v7, v0", "hash"), EXEC.format("v0")),
    )
    assert {k[::2]: v[1] for k, v in got.items()} == {("through", "EXEC"): "none", ("made", "EXEC"): "none", ("sent", "NETWORK_OUT"): "none", ("hashed", "EXEC"): "partial"}


def test_shortest_way(lines):
    tables = flows.steps(smali.instructions(lines(method("w", *SOURCE, *(f"move-object v{i + 1}, v{i}" for i in range(5)), "move-object v5, v0", EXEC.format("v5"), EXEC.format("v3")))))
    known, _ = flows.facts(tables)
    ways = {}
    for r in sorted(flows.shortest_ways(known, tables["sinks"]).collect(), key=lambda r: r.step):
        ways.setdefault(r.sink_pos, []).append((r.slot, r.since))
    assert ways == {8: [("v0#0", 1), ("v5#0", 7)], 9: [("v0#0", 1), ("v1#0", 2), ("v2#0", 3), ("v3#0", 4)]}


def test_rounds_do_not_grow_with_a_method(lines, monkeypatch):
    """Facts within a method are closed in one turn, however many instructions they pass."""
    tables = flows.steps(smali.instructions(lines(method("w", *SOURCE, *(f"move-object v{i + 1}, v{i}" for i in range(12)), EXEC.format("v12")))))
    kept = []
    monkeypatch.setattr(flows, "keep", lambda df, keep=flows.keep: kept.append(1) or keep(df))
    known, _ = flows.facts(tables)
    assert known.where("slot = 'v12#0'").count() == 1 and known.count() == 13 and len(kept) <= 12


def _calling(name, inner, result="v1"):
    return [*SOURCE, f"invoke-static {{v0}}, L{name};->{inner}(Ljava/lang/String;)Ljava/lang/String;", f"move-result-object {result}"]


def test_classes_are_closed_where_they_lie(spark, lines, monkeypatch):
    """Calls within a class take no rounds of joins, ways within a method no kept table; the rounds give the same flows."""
    clean = "invoke-virtual {v8, p0}, Landroid/text/Html;->escapeHtml(Ljava/lang/CharSequence;)Ljava/lang/String;"
    code = smali.instructions(lines(
        method("a", *_calling("com/app/C", "b"), EXEC.format("v1"), LOAD.format("v1")), method("b", *_calling("com/app/C", "c", "v2"), "return-object v2"),
        method("c", clean, "iput-object p0, v3, LB;->f:LS;", "invoke-static {v3}, Lcom/app/C;->d(Ljava/lang/String;)Ljava/lang/String;", "move-result-object v4", "return-object v4"),
        method("d", "iget-object v5, p0, LB;->f:LS;", EXEC.format("v5"), "invoke-static {p0}, Lcom/app/C;->c(Ljava/lang/String;)Ljava/lang/String;", "return-object v5"),
    ))
    kept = []
    monkeypatch.setattr(flows, "keep", lambda df, keep=flows.keep: kept.append(1) or keep(df))
    tables = flows.steps(code)
    found_ = flows.findings(tables, 3).drop("neutralisation")
    got = sorted(map(tuple, found_.collect()))
    assert len(kept) == 1 and sorted((r[1][13], r[4][13], r[6], r[7]) for r in got) == [("b", "a", "EXEC", 0), ("b", "a", "WEBVIEW", 0), ("b", "d", "EXEC", 2)]
    assert got == sorted(map(tuple, flows._in_rounds(flows._tables(tables["acts"]), 3).select(*found_.columns).collect()))
    monkeypatch.setattr(flows, "keep", lambda df: pytest.fail("a table was kept"))
    monkeypatch.setattr(flows, "written", lambda df: pytest.fail("a table was kept"))
    ways = [(r.step, r.slot) for r in flows.ways_within(smali.instructions(lines(method("w", *SOURCE, "move-object v1, v0", EXEC.format("v1"))))).orderBy("step").collect()]
    assert ways == [(0, "v0#0"), (1, "v1#0")]


def test_calls_between_classes(spark):
    """Values pass through other classes of the app, and through no class of another app; classes alone stay as they are."""
    text = {
        (1, 1, "LA;"): [method("a", *_calling("B", "b"), EXEC.format("v1"))],
        (1, 2, "LB;"): [method("b", "move-object v5, p0", LOAD.format("v5"), "return-object v5")],
        (1, 3, "LD;"): [method("d", *_calling("D", "e"), EXEC.format("v1")), method("e", "return-object p0")],
        (2, 4, "LE;"): [method("f", *_calling("B", "b"), EXEC.format("v1"))],
    }
    rows = [(app, file, i, line) for (app, file, name), methods in text.items() for i, line in enumerate([f".class public {name}", *(line for m in methods for line in m)])]
    code = smali.instructions(spark.createDataFrame(rows, "app_id long, file long, line_no int, line string").repartition(3))
    got = {(r.app_id, r.source_method.split(";")[0], r.sink_method.split(";")[0], r.sink_label, r.chain) for r in flows.findings(flows.steps(code)).collect()}
    assert got == {(1, "LA", "LA", "EXEC", 0), (1, "LA", "LB", "WEBVIEW", 1), (1, "LD", "LD", "EXEC", 0)}


def test_code_without_calls(spark, lines):
    assert found(lines, method("n", "nop")) == {} and flows.findings(flows.steps(smali.instructions(lines().limit(0)))).collect() == []


def test_confidence_of_neutralised_flows(spark):
    rows = spark.createDataFrame([(i, "USER_INPUT", "EXEC", 1, n) for i, n in enumerate(("none", "partial", "full"))], "i int, source_label string, sink_label string, chain int, neutralisation string")
    assert [(r.confidence, r.category) for r in taint.classified(rows).orderBy("i").collect()] == [("HIGH", "TAINT"), ("MEDIUM", "TAINT"), ("LOW", "TAINT")]


def test_reuse_of_earlier_results(lines):
    logs = lambda code: detectors.logs(smali.for_detectors(code))
    log = "invoke-static {{v1, v2}}, Landroid/util/Log;->{}(Ljava/lang/String;Ljava/lang/String;)I"
    before = smali.instructions(lines(method("a", log.format("d")), method("b", log.format("v")), method("gone", log.format("d"))))
    after = smali.instructions(lines(method("b", log.format("v")), ["", "# moved"], method("a", log.format("e"), log.format("d")), method("new", log.format("v"))))
    seen = []
    kept = reuse.analysed(before, logs)
    got = reuse.current(after, kept, lambda code: (seen.extend(r.method_name for r in code.select("method_name").distinct().collect()), logs(code))[1])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, logs(after).collect())) and sorted(seen) == ["a", "new"]


def test_bodies_tell_places_and_order(lines):
    """A method's hash is that of its instructions in their order; it is summed up, not collected, and lines don't count."""
    bodies = lambda *body: {r.method.split(";->")[1][0]: bytes(r.body) for r in reuse.body_hashes(smali.instructions(lines(method("a", *body), method("b", *body)))).collect()}
    one = bodies("nop", 'const-string v0, "x"', "nop")
    assert one == bodies(".line 4", "nop", "", 'const-string v0, "x"', "# c", "nop") and one["a"] != one["b"]
    others = [bodies('const-string v0, "x"', "nop", "nop"), bodies("nop", 'const-string v0, "x"'), bodies("nop", 'const-string v1, "x"', "nop"), bodies("nop", 'const-string v0, "y"', "nop")]
    assert len({o["a"] for o in (one, *others)}) == 5
    plan = reuse.body_hashes(smali.instructions(lines(method("a", "nop"))))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan


def test_binaries_cut_short(spark):
    from strata.plans.files import _elf

    whole = bytes.fromhex(_elf(3, ((0x6474E551, 6), (0x6474E552, 4)), True, False))
    rows = [(1, str(i), data) for i, data in enumerate((None, b"", b"\x7fELF", whole[:40], whole[:-1], whole, whole + b"__stack_chk_fail", b"#!/bin/sh"))]
    got = {r.path: tuple(r)[2:] for r in binaries.elf_facts(spark.createDataFrame(rows, "app_id long, path string, content binary")).collect()}
    none = (None,) * 6
    assert got == {"0": none, "1": none, "2": none, "3": none, "4": (3, 1, True, False, False, False), "5": (3, 2, True, True, False, False), "6": (3, 2, True, True, True, False), "7": none}


def test_binaries_are_read_whole(spark):
    """A table of program headers beyond the first pages counts, and so do names beyond the first 64 MB."""
    from strata.plans.files import _elf

    head, size = bytes.fromhex(_elf(3, ((0x6474E551, 6), (0x6474E552, 4)), True, True)), 64
    far = head[:32] + (9000).to_bytes(8, "little") + head[40:size] + bytes(9000 - size) + head[size:]
    late = head + bytes(64 << 20) + b"__stack_chk_guard.debug_str"
    facts = binaries.elf_facts(spark.createDataFrame([(1, "far", far)], "app_id long, path string, content binary"))
    assert [tuple(r)[2:] for r in facts.collect()] == [(3, 2, True, True, False, False)]
    batch = pa.RecordBatch.from_pydict({"app_id": [1], "path": ["late"], "content": [late]})
    assert [list(r.values())[2:] for b in binaries._read(iter([batch])) for r in b.to_pylist()] == [[3, 2, True, True, True, True]]


@pytest.mark.parametrize("wide,told", [(True, 54), (False, 42)])
def test_binaries_cut_after_the_size_of_the_header(spark, wide, told):
    """The type is read wherever the header tells its own size; a byte less is no header."""
    from strata.plans.files import _elf

    whole = bytes.fromhex(_elf(2, (), wide, True))
    facts = binaries.elf_facts(spark.createDataFrame([(1, str(n), whole[:n]) for n in (told - 1, told, len(whole))], "app_id long, path string, content binary"))
    assert {tuple(r)[1:] for r in facts.collect()} == {(str(told - 1), *(None,) * 6), *((str(n), 2, 0, False, False, False, False) for n in (told, len(whole)))}
    assert {r.rule_id for r in binaries.native_rules(facts).where(f"path = '{told}'").collect()} == {"NATIVE_NO_PIE", "NATIVE_NO_NX", "NATIVE_NO_RELRO", "NATIVE_NO_STACK_CANARY"}


def test_a_handle_leaves_the_string_of_its_register(lines):
    digest = "invoke-static {v1}, Ljava/security/MessageDigest;->getInstance(Ljava/lang/String;)Ljava/security/MessageDigest;"
    code = smali.instructions(lines(method("h", 'const-string v1, "MD5"', digest, "const-method-handle v1, invoke-static@LH;->h()V"), method("only", "const-method-handle v1, invoke-static@LH;->h()V", digest)))
    assert [(r.method.split("->")[1][0], r.pos, r.rule_id) for r in detectors.crypto(smali.for_detectors(code)).collect()] == [("h", 1, "CRYPTO_WEAK_HASH")]


def test_malformed_network_configuration(spark):
    rows = [(1, "<network-security-config><base"), (2, None), (3, ""), (4, "<network-security-config/>"), (5, '<network-security-config><domain-config cleartextTrafficPermitted="TRUE"><domain-config><pin-set expiration="2030"/></domain-config></domain-config></network-security-config>')]
    got = {tuple(r) for r in reports.network_config(spark.createDataFrame(rows, "app_id long, xml string")).collect()}
    assert got == {(4, "NETWORK_PINNING_MISSING", "LOW", ""), (5, "NETWORK_NSC_DOMAIN_CLEARTEXT", "MEDIUM", "(unspecified)"), (5, "NETWORK_PIN_EXPIRY", "INFO", "2030")}


def test_tree_of_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("a/1.xml", "a/2.XML", "3.txt", "4.png"):
        (tmp_path / name).write_text(name)
    files = binaries.tree(spark, str(tmp_path)).selectExpr("1L as app_id", "path", "length")
    got = {r.path.rsplit("/", 1)[1]: r.skipped for r in binaries.within_limits(files, (".xml", ".txt"), 6, 1).collect()}
    assert got == {"1.xml": "size", "2.XML": "size", "3.txt": None}


def test_xor_search_of_odd_inputs(spark):
    from strata.functions import text

    data = [None, "", "4", "zz", "".join(f"{ord(c) ^ 77:02X}" for c in "SecretKey1"), "00FF8041"]
    rows = spark.createDataFrame(list(enumerate(data)), "i int, h string").select("i", text.xor_decoded(F.col("h")).alias("x")).orderBy("i").collect()

    def brute(h):
        coded = [int(h[i : i + 2], 16) for i in range(0, len(h) - 1, 2)]
        key = max(range(1, 256), key=lambda k: (sum(chr(b ^ k).isalnum() and b ^ k < 128 for b in coded), -k))
        return key, "".join(chr(b ^ key) for b in coded)

    assert [tuple(r.x) for r in rows if r.i in (1, 2, 4, 5)] == [brute(data[i]) for i in (1, 2, 4, 5)]


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_method_detectors_get_whole_methods(spark, size):
    import pandas as pd

    from strata.operators import plugins

    rows = pd.DataFrame([(m, p, (m or 0) * 7 % 3 * p % 2) for m in (*range(9), None) for p in range(1 + (m or 4) % 5)], columns=["method", "pos", "op"])
    cut = [b["method"].astype(str).tolist() for b in plugins.whole_methods(rows[i : i + size] for i in range(0, len(rows), size))]
    assert sum(cut, []) == rows["method"].astype(str).tolist() and all(set(a).isdisjoint(b) for i, a in enumerate(cut) for b in cut[i + 1 :])
    registry, code = plugins.example_registry(), spark.createDataFrame([(m, p, op, 0) for m, ops in ((1, [0, 1, 0, 1]), (2, [1, 0]), (3, [0]), (4, [1])) for p, op in enumerate(ops)], "method long, pos int, op int, num int")

    @registry.method
    def alone(rows):
        return pd.DataFrame({"method": rows["method"][:1], "rule_id": "N", "severity": "LOW", "evidence": str(len(rows))})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = sorted((r.method, r.rule_id, r.evidence) for r in plugins.run(registry, code).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(1, "N", "4"), (1, "PLUGIN_ADJACENT", "at 0"), (1, "PLUGIN_ADJACENT", "at 2"), (2, "N", "2"), (3, "N", "1"), (4, "N", "1")]


def test_constants_of_ways_that_meet(spark, monkeypatch):
    """Ways that agree or not, a loop, a loop that nothing enters, methods in several partitions; no round is written out."""
    from strata.operators import code
    from strata.plans import keep

    monkeypatch.setattr(keep, "keep", lambda df: pytest.fail("a round was kept"))
    monkeypatch.setattr(code, "keep", lambda df: pytest.fail("a round was kept"), raising=False)
    own = [(0, 1, 7, True), (0, 2, 5, True), (1, 1, 8, True), (2, 1, 8, True), (2, 2, None, False), (4, 3, 1, True), (6, 1, 3, True)]
    ways = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 3), (4, 5), (6, 7), (7, 6)]
    blocks = spark.createDataFrame([(m, *o) for m in range(50) for o in own], "method long, block int, register int, value int, known boolean").repartition(7)
    edges = spark.createDataFrame([(m, *w) for m in range(50) for w in ways], "method long, src int, dst int").repartition(5)
    want = {(1, 1, 7), (1, 2, 5), (2, 1, 7), (2, 2, 5), (3, 1, 8), (4, 1, 8), (5, 1, 8), (5, 3, 1)}
    assert sorted(map(tuple, code.constants(blocks, edges).collect())) == sorted((m, *w) for m in range(50) for w in want)


def test_code_is_read_once_for_reuse(spark, small):
    """What is given back reads the code that was written, not the lines again."""
    from strata.plans.files import smali_reuse

    result = smali_reuse(spark, small)
    assert not [f for f in result.inputFiles() if "lineitem" in f] and result.count() > 0
