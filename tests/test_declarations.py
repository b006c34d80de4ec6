"""Hand-written files, one for each rule of the extraction."""

import pytest
from pyspark.sql import functions as F

from srclens.operators import declarations as D
from srclens.operators import records, stats

OUTER = r'''
package com.acme.app; // package fake;
import java.util.List;
import static java.lang.Math.*;
/* class Fake { don't */
@Table(name="x;{", value={"a","b"})
public abstract class Outer<T extends Comparable<T>> extends base.Base<T> implements I0, pkg.I1<String, Map<A,B>> {
  private static final String URL = "http://x/{ class Q", OTHER = f(1, 2);
  int[] arr = {1, 2, 3}, brr = {4};
  Map<String, List<Integer>> m = new HashMap<String, List<Integer>>(), n;
  char c = '"'; char d = '\'';
  String block = """
    class Text { "quoted" \""" }
    """;
  static { init(); }
  @Inject(@Named(value = (1+2) + "x")) public Outer(int a) { if (a > 1) {} }
  @Override @SuppressWarnings({"a", "b"}) public static <K, V extends K> List<K> make(final Map<K, V> in, @A({1}) int[] xs, java.lang.String... rest) throws IOException {
     if (a && b || c) { for (int i = 0; i < 3; i++) { x(); } } // if
     Runnable r = () -> { while (true) {} };
     foo(new Handler(a(b)) { public void handle(int q) { if (q > 1) {} } private int z; }, y -> { return y; });
     class Local { void loc() {} }
     return null;
  }
  abstract void abs();
  protected final synchronized int plain() { switch (k) { case 1: return a ? 1 : 2; default: return 0; } }
  Foo anon = new Foo() { @Override public String toString() { return "}"; } };
  static class Inner { void z() {} interface Deep { int CONST = 1; void deep(); } }
  enum Color { RED, GREEN(1); int q; int get() { return 1; } }
  @interface Ann { int value() default 1; String[] names() default {}; }
}
interface Svc extends A, b.B<C> { void a(); default int b(int x) { return x; } }
'''
FILES = {
    "a/Outer.java": OUTER,
    "b/OnlyEnum.java": "package p; public enum E { A, B }",
    "c/Open.java": "package p; class Bad { void x() { }",
    "d/Crossed.java": "} class X {",
    "e/NoPackage.java": "class Same { int f() { return 1; } }",
    "f/Same.java": "package q; class Same { }",
    "g/Empty.java": "",
    "h/Quote.java": 'class Q { String s = "open; }',
    "h/Single.java": "class A { char c = 'a; }",
    "i/Record.java": "package r; record Point(int x, int y) { int sum() { return x + y; } } class After { boolean t = record instanceof Foo; }",
}


@pytest.fixture(scope="module")
def decls(spark):
    rows = [(k, v) for k, v in FILES.items()]
    return D.declarations(spark.createDataFrame(rows, "path string, content string")).cache()


@pytest.fixture(scope="module")
def types(decls):
    return {(r["path"], r["name"]): r for r in D.types(decls, nested=True).collect()}


def test_packages_and_imports(decls):
    packages = {r["path"]: r["package"] for r in D.packages(decls).collect()}
    assert packages == {"a/Outer.java": "com.acme.app", "b/OnlyEnum.java": "p", "f/Same.java": "q", "i/Record.java": "r"}
    assert D.imports(decls).first()["imports"] == ["java.util.List", "java.lang.Math"]


def test_types(types):
    assert set(types) == {
        ("a/Outer.java", n) for n in ("Outer", "Local", "Inner", "Deep", "Svc")
    } | {("e/NoPackage.java", "Same"), ("f/Same.java", "Same"), ("i/Record.java", "After")}
    outer = types["a/Outer.java", "Outer"]
    assert outer["modifiers"] == ["public", "abstract"]
    assert outer["extends"] == ["Base"] and outer["implements"] == ["I0", "I1"]
    assert types["a/Outer.java", "Svc"]["extends"] == ["A", "B"]
    assert types["a/Outer.java", "Deep"]["kind"] == "interface"
    assert types["e/NoPackage.java", "Same"]["package"] is None


def test_methods_of_all_descendants(types):
    outer = types["a/Outer.java", "Outer"]
    assert [m["name"] for m in outer["methods"]] == ["make", "handle", "loc", "abs", "plain", "toString", "z", "deep", "get"]
    assert outer["method_count"] == 9
    make = outer["methods"][0]
    assert make["signature"] == "public static List make(Map in, int xs, String rest)"
    assert [(p["name"], p["type"]) for p in make["parameters"]] == [("in", "Map"), ("xs", "int"), ("rest", "String")]
    assert make["return_type"] == "List"


def test_complexity(types):
    score = {m["name"]: m["complexity"] for m in types["a/Outer.java", "Outer"]["methods"]}
    # if && || for while, and the if of the anonymous class inside
    assert score["make"] == 7
    assert score["abs"] == 1 and score["loc"] == 1
    assert score["plain"] == 3  # case ?
    assert types["f/Same.java", "Same"]["avg_complexity"] == 0.0


def test_fields(types):
    fields = [(f["name"], f["type"]) for f in types["a/Outer.java", "Outer"]["fields"]]
    assert fields == [
        ("URL", "String"), ("OTHER", "String"), ("arr", "int"), ("brr", "int"), ("m", "Map"), ("n", "Map"),
        ("c", "char"), ("d", "char"), ("block", "String"), ("z", "int"), ("anon", "Foo"), ("CONST", "int"), ("q", "int"),
    ]
    assert types["i/Record.java", "After"]["field_count"] == 1


def test_direct_members_only(decls):
    direct = {r["name"]: (r["method_count"], r["field_count"]) for r in D.types(decls, recursive=False).filter("path = 'a/Outer.java'").collect()}
    assert direct == {"Outer": (3, 10), "Local": (1, 0), "Inner": (1, 0), "Deep": (1, 1), "Svc": (2, 0)}


def test_enum_constant_bodies(spark):
    text = """class Ops { enum Op {
      ADD(1) { int apply(int a) { if (a > 0) { return a; } return 0; } int k; }, PLAIN, SUB { int apply(int a) { return -a; } };
      Op(int x) { int local; } Op() { } abstract int apply(int a); private int q;
      void later() { call(() -> { int n; }, other); int[][] m = {{1}, {2}}; for (int i = 0; i < 2; i++) { int w; } }
    } }"""
    row = D.types(D.declarations(spark.createDataFrame([("o", text)], "path string, content string")), nested=True).first()
    assert [m["name"] for m in row["methods"]] == ["apply", "apply", "apply", "later"]
    assert [m["complexity"] for m in row["methods"]] == [2, 1, 1, 2]
    assert [f["name"] for f in row["fields"]] == ["k", "q"]


def test_rejects(spark):
    rows = [(k, v) for k, v in FILES.items()]
    found = D.rejects(spark.createDataFrame(rows, "path string, content string"))
    bad = {"c/Open.java", "d/Crossed.java", "h/Quote.java", "h/Single.java"}
    assert {tuple(r) for r in found.collect()} == {(p, "unbalanced") for p in bad}
    unread = D.rejects(spark.createDataFrame([("x", None), ("y", ""), ("z", "class A { }"), ("p", "class B { int a = )(; }")], "path string, content string"))
    assert {tuple(r) for r in unread.collect()} == {("x", "encoding"), ("p", "unbalanced")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Union" not in plan


def test_nested_types_of_one_name_stay_apart(spark):
    """Two classes B in one file: five classes give five requests, answers and documents."""
    text = "class T { static class D { static class B { } } static class E { static class B { int one() { return 1; } } } }"
    types = D.types(D.declarations(spark.createDataFrame([("t", text)], "path string, content string")), nested=True)
    classes = records.class_records(types)
    answers = classes.select("request_id", F.concat(F.col("name"), F.lit(" "), F.col("method_count")).alias("response"))
    summed = records.with_summary(classes, answers)
    assert sorted(r["summary"] for r in summed.collect()) == ["B 0", "B 1", "D 0", "E 1", "T 1"]
    none = spark.createDataFrame([], "text string")
    assert records.documents(none, summed, records.interface_records(types)).select("doc_key").distinct().count() == 5


def test_pieces_of_one_declaration_are_gathered_once(spark):
    """A field whose initialiser chains many blocks: linear in their number."""
    text = "class A { Object f = b" + ".then(x -> { x.go(); })" * 8_000 + ", g; int h; }"
    found = D.fields(D.declarations(spark.createDataFrame([("a", text)], "path string, content string")))
    assert [r["name"] for r in found.orderBy("pos", "idx").collect()] == ["f", "g", "h"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Window [" in line and "collect_list" in line]


def test_edges(decls):
    edges = {tuple(r)[1:] for r in D.edges(D.types(decls)).collect()}
    assert edges == {
        ("Outer", "extends", "Base"), ("Outer", "implements", "I0"), ("Outer", "implements", "I1"),
        ("Svc", "extends", "A"), ("Svc", "extends", "B"),
    }


def test_statistics_leave_interfaces_and_enum_files_out(decls):
    row = stats.corpus_stats(D.types(decls)).first()
    assert row["total_files"] == 4 and row["total_classes"] == 6 and row["total_interfaces"] == 2
    assert row["total_methods"] == 9 + 1 + 2 + 1
    assert row["unique_packages"] == 3


def test_first_match_keeps_a_null_package(decls):
    types = D.types(decls).filter("kind = 'class'")
    asked = types.select("path", "name").unionByName(types.sparkSession.createDataFrame([("x", "Nobody")], "path string, name string"))
    found = {(r["path"], r["name"]): r["package"] for r in stats.first_match(asked, "name", types, "name", "package", "path", "N/A").collect()}
    # e/NoPackage.java comes first and names no package
    assert found["f/Same.java", "Same"] is None
    assert found["x", "Nobody"] == "N/A"


def test_records_and_prompts(decls):
    types = D.types(decls, nested=True)
    prompt = records.class_prompts(records.class_records(types).filter("name = 'Inner'")).first()["messages"]
    assert [m["role"] for m in prompt] == ["system", "user"]
    assert '{"name":"Inner","type":"class","extends":null,"implements":[],"methods":[{"signature":"void z()","complexity":1}' in prompt[1]["content"]
    svc = records.interface_records(types).filter("name = 'Svc'").first()
    assert [m["signature"] for m in svc["methods"]] == ["void a()", "default int b(int x)"]


def test_long_literals_and_wide_files(spark):
    """Whole texts: a long string, a long comment, many members and deep nesting."""
    wide = "class W { String s = \"" + "x\\\"" * 200_000 + "\"; /*" + "*" * 300_000 + "*/ " + "".join(
        f"int m{i}() {{ if (a) {{}} return {i}; }} " for i in range(2000)
    ) + "}"
    deep = "".join(f"class D{i} {{ void f{i}() {{}} " for i in range(60)) + "}" * 60
    df = spark.createDataFrame([("w", wide), ("d", deep)], "path string, content string")
    found = {r["name"]: r for r in D.types(D.declarations(df)).collect()}
    assert found["W"]["method_count"] == 2000 and found["W"]["avg_complexity"] == 2.0 and found["W"]["field_count"] == 1
    assert [found[f"D{i}"]["method_count"] for i in range(60)] == [60 - i for i in range(60)]


def test_headers_with_many_brackets(spark):
    calls = " + ".join(f"f{i}(g((1)), {i})" for i in range(300))
    generic = "Map<String, List<K>> m0 = new HashMap<String, List<K>>()"
    chain = ", ".join(f"v{i} = of(new HashMap<String, List<Map<K, V>>>())" for i in range(20))
    text = f"class A {{ int x = {calls}, y; {generic}, {chain}; Foo z = g({calls}, new Foo(h(1)) {{ void q() {{ }} }}); }}"
    row = D.types(D.declarations(spark.createDataFrame([("a", text)], "path string, content string")), nested=True).first()
    assert [f["name"] for f in row["fields"]] == ["x", "y", "m0", *[f"v{i}" for i in range(20)], "z"]
    assert [m["name"] for m in row["methods"]] == ["q"]


def test_one_shuffle(spark):
    df = spark.createDataFrame([("w", "class A { }")], "path string, content string")
    plan = D.types(D.declarations(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Join" not in plan and "InPandas" not in plan and "PythonUDF" not in plan


BLOCKS = {
    "Deep.java": "class A { int f(int a) { if (a > 1) { while (b && c) { { x(); } } } else { y(z -> { return q ? 1 : 2; }); } return 1; } int g; }",
    "Live.java": "class A { int f() { if (x) { run(new B(1) { void h() { for (;;) { } } int k; }, y -> { }); } class L { void m() { if (z) { } } } } int[] q = {1, 2}, r = { {3} }; }",
    "Enum.java": "enum E { A(1) { int f() { if (x) { } return 1; } }, B { int g() { return 2; } }; class In { } int h() { new C() { int i() { return 3; } }; } }",
    "Notes.java": "class A { @S({1, 2}) @T(x = {3}) int f(@U({4}) int a) throws X { if (a) { } } static { if (b) { } } A(int q) { if (c) { } } int a = new int[] {1}.length, b; }",
    "Crossed.java": "class A { void f( { if (x) { } ) } int g() { while (y) { } } }",
    "Marks.java": "class A { int \x03 x; void f() { if (a) { \x03 } } }",
}


def test_whole_blocks_are_read_as_run_by_run(spark, monkeypatch):
    df = spark.createDataFrame([*FILES.items(), *BLOCKS.items()], "path string, content string")

    def read():
        decls = D.declarations(df)
        out = [D.types(decls, nested=True).drop("type_pos"), D.types(decls, recursive=False).drop("type_pos"), D.methods(decls).drop("pos", "type_pos")]
        out += [D.fields(decls).drop("pos", "type_pos"), D.packages(decls), D.imports(decls), D.rejects(df)]
        return [sorted(str(r) for r in rows.collect()) for rows in out]

    whole = read()
    monkeypatch.setattr(D, "NESTING", 0)  # no text with brackets is then known to nest
    assert read() == whole


def test_blocks_without_bodies_make_no_rows(spark):
    """A class of one method is three runs' work, however many blocks the method holds."""
    text = "class A { void f() { " + "if (a) { while (b) { x -> { }; } } " * 50 + "} }"
    df = spark.createDataFrame([("a", text)], "path string, content string")
    assert D.brace_runs(df).count() <= 3
    assert [r["complexity"] for r in D.methods(D.declarations(df)).collect()] == [101]


def test_openers_and_block_ends_meet_without_a_sort_of_their_own(spark):
    """A method read run by run gets its decisions from the next run of its depth; texts nest as bracket by bracket."""
    df = spark.createDataFrame([("a", BLOCKS["Live.java"])], "path string, content string")
    decls = D.declarations(df)
    assert {r["name"]: r["complexity"] for r in D.methods(decls, recursive=False).collect()} == {"f": 4, "m": 2}
    plan = decls._jdf.queryExecution().executedPlan().toString()
    assert len([line for line in plan.splitlines() if "Sort [" in line]) <= 4
    texts = ["", "a", "({})", "({)}", "}{", "((((()))))", "{(" * 5 + ")}" * 5, "(){}(", "{" * 13 + "}" * 13, "(" * 4 + ")" * 5]
    rows = D.clean_files(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string")).collect()
    assert [r["nested"] for r in sorted(rows, key=lambda r: int(r["path"]))] == [True, True, True, False, False, True, True, False, False, False]


FLAT = {
    "Plain.java": "package p; import a.b; class A extends B { @S({1}) int f(@U(x = {4}) int a) throws X { if (a) { } } int[] q = {1, 2}; int[][] r = { {3} }; static { b(); } };",
    "Nested.java": "interface I<T> extends J, K.L<T> { default void d() { while (a && b) { } } class C { class D { int x = f(y -> { if (z) { } }), w; } void c(); } }",
    "After.java": "@T({1}) public final class A { A(int q) { for (;;) { } } } ; interface B { ; }",
}
RUNWISE = {
    "Comma.java": "class A { int[] q = {1, 2}, r = {3}; }",
    "Values.java": "class A { int a = {1} {2}; int[] b = g({1}) {2}; int c; }",
    "Body.java": "class A { Object o = new B() { int f() { return 1; } }, p = q(new C(1) { int g; }); }",
    "Inside.java": "class A { import x.y; int f(a; b); } int top; import z;",
    "Kinds.java": "@interface N { int v() default 1; } enum E { A { int f() { return 1; } }, B; class In { int i; } }",
}


def test_flat_files_are_one_run_and_read_as_run_by_run(spark, monkeypatch):
    """Files of packages, imports, classes and interfaces need no windows to be cut; all others are cut by them."""
    df = spark.createDataFrame([*FLAT.items(), *RUNWISE.items()], "path string, content string")
    runs = {r["path"]: r["count"] for r in D.brace_runs(df).groupBy("path").count().collect()}
    assert {p for p, n in runs.items() if n == 1} == set(FLAT)

    def read():
        decls = D.declarations(df)
        out = [D.types(decls, nested=True).drop("type_pos"), D.types(decls, recursive=False).drop("type_pos"), D.methods(decls).drop("pos", "type_pos")]
        out += [D.fields(decls).drop("pos", "type_pos"), D.packages(decls), D.imports(decls)]
        return [sorted(str(r) for r in rows.collect()) for rows in out]

    flat = read()
    monkeypatch.setattr(D, "FLAT_FILE", "(?!)")
    assert D.brace_runs(df).count() > sum(runs.values())
    assert read() == flat
