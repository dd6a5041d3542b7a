import re
import time

import pytest

from loomgraph.functions.lexing import LANGUAGES, masked_text
from loomgraph.operators import dispatch, edges, extraction

CODE = [
    ("js", "a `x ${ f(`y ${g('}')} z`) + {k:1}.k } w` b // c\nh = /re[/]'x/g.test(i) + j / k / l\n'open\nm", "a f g + {k:1}.k b h = .test(i) + j / k / l m"),
    ("py", "x = f'{alpha(1)} {{no}} {b}' + 'no' # no\n\"\"\"no\nno\"\"\" + r'\\\\' + y", "x = alpha(1) b + + + y"),
    ("rb", "a = <<~EOS + b(1)\n no #{x}\n EOS\nputs \"k #{call(\"n\")} z\" # c\n=begin\nno\n=end\nx << y", "a = + b(1) puts call( ) x << y"),
    ("php", "$a = <<<'EOT'\nno\nEOT;\n# no\n#[Attr]\n$b = \"x {$y->z('q')} w\";", "$a = ; #[Attr] $b = $y->z( ) ;"),
    ("go", "s := `raw \\` + \"a\\\"b\" + 'c' // no", "s := + +"),
    ("rs", "let s = r#\"no \"no\" \"#; let c = 'a'; fn f<'a>(x: &'a str) {} \"multi\nline\"", "let s = ; let c = ; fn f<'a>(x: &'a str) {}"),
    ("cs", 'var s = @"no ""no"" x"; var t = $"a {call(1)} {{no}}"; var u = $@"a{b}""c";', "var s = ; var t = call(1) ; var u = b ;"),
    ("kt", 'val s = """no ${call("x")} no"""; val t = "a ${g()} b"', "val s = call( ) ; val t = g()"),
    ("swift", 'let s = "a \\(call("x")) b"; let t = """\nno \\(k) "no"\n"""', "let s = call( ) ; let t = k"),
    ("java", 'String s = """\nno "no"\n"""; char c = \'"\'; f("x");', "String s = ; char c = ; f( );"),
]


@pytest.mark.parametrize("language,text,code", CODE)
def test_masks_keep_code_and_places(language, text, code):
    got = masked_text(text, language)
    assert len(got) == len(text) and [i for i, c in enumerate(got) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
    squeeze = lambda s: re.sub(r"\s+", " ", s).replace("( ", "(").replace(" )", ")").strip()
    assert squeeze(got.replace("f(", "f ").replace("g(", "g ")) == squeeze(code.replace("f(", "f ").replace("g(", "g ")) or squeeze(re.sub(r"[()]", "", got)) == squeeze(re.sub(r"[()]", "", code))
    assert all(a == b or a == " " for a, b in zip(got, text, strict=True))


def test_masks_end_for_any_text_in_linear_time():
    assert masked_text("import {a} from './b' // c", "js", keep_values=True) == "import {a} from './b'     "
    began = time.perf_counter()
    for language in LANGUAGES:
        for piece in ("'", '"', "`", "/*", "/", "${", "`${", "<<EOS\n", "f'{", '"""', 'r#"', "(", "}", "\\", "#", "a/", '$"{', '@"', "\n"):
            text = piece * (50_000 // len(piece))
            assert len(masked_text(text, language)) == len(text)
    assert time.perf_counter() - began < 60


TREES = {
    "java": ("class A extends B {\n    public int run(String s) throws E {\n        if (s == null) {\n        }\n        return 1;\n    }\n    void hidden() {}\n}\npublic interface I {}\n", [("A", "class", None, 1, 8, False), ("run", "method", "A", 2, 6, True), ("hidden", "method", "A", 7, 7, False), ("I", "class", None, 9, 9, True)]),
    "cs": ("public class A : Base\n{\n    public static int Run(int x)\n    {\n        return Go(x);\n    }\n    private int One() => 1;\n}\n", [("A", "class", None, 1, 8, True), ("Run", "method", "A", 3, 6, True), ("One", "method", "A", 7, 7, False)]),
    "php": ("<?php\nfinal class A {\n  private function go($x) {\n  }\n  public static function make() { }\n}\nfunction top() {\n}\n", [("A", "class", None, 2, 6, True), ("go", "method", "A", 3, 4, False), ("make", "method", "A", 5, 5, True), ("top", "function", None, 7, 8, True)]),
    "swift": ("public struct A {\n  func go() { }\n}\nextension B {\n  public static func make<T>(x: T) {\n  }\n}\nfunc top() {}\n", [("A", "class", None, 1, 3, True), ("go", "method", "A", 2, 2, False), ("B", "class", None, 4, 7, False), ("make", "method", "B", 5, 6, True), ("top", "function", None, 8, 8, False)]),
    "kt": ("data class A(val x: Int)\nobject O {\n  private fun go(x: Int): Int {\n    return x\n  }\n}\nfun p.Q.ext(a: Int) {\n}\n", [("A", "class", None, 1, 6, True), ("O", "class", None, 2, 6, True), ("go", "method", "O", 3, 5, False), ("ext", "method", "Q", 7, 8, True)]),
    "rs": ("struct A;\nimpl A {\n    pub fn new() -> A {\n        A\n    }\n}\nimpl<T> Make for B<T> {\n    fn new() -> Self {\n        x()\n    }\n}\npub(crate) fn top() {\n}\n", [("A", "class", None, 1, 1, False), ("new", "method", "A", 3, 5, True), ("new", "method", "B", 8, 10, False), ("top", "function", None, 12, 13, True)]),
    "go": ("type A struct {\n}\nfunc (a *A) Do(x int) {\n}\nfunc (b B[T]) Do() {\n}\nfunc low() {\n}\n", [("A", "class", None, 1, 2, True), ("Do", "method", "A", 3, 4, True), ("Do", "method", "B", 5, 6, True), ("low", "function", None, 7, 8, False)]),
    "rb": ("module M\n  class A\n    def go?\n      x\n    end\n  end\nend\ndef self.top\nend\n", [("M", "class", None, 1, 7, True), ("A", "class", None, 2, 6, True), ("go?", "method", "A", 3, 5, True), ("top", "function", None, 8, 9, True)]),
    "py": ("class A:\n    async def go(self):\n        def inner():\n            pass\n\ndef top(): pass\n", [("A", "class", None, 1, 4, True), ("go", "method", "A", 2, 4, True), ("inner", "method", "A", 3, 4, True), ("top", "function", None, 6, 6, True)]),
    "js": ("export class A {\n  get v(): number {\n  }\n  set v(x) {\n  }\n  go = (x) => {\n  };\n}\nexport const f = async (a) => {\n};\nconst S = (() => {\n})();\nfunction g() {\n  cb = (x) => 1;\n}\n", [("A", "class", None, 1, 8, True), ("v", "method", "A", 2, 3, False), ("v", "method", "A", 4, 5, False), ("go", "method", "A", 6, 7, False), ("f", "function", None, 9, 10, True), ("g", "function", None, 13, 15, False)]),
}


def test_symbols_of_all_languages(spark):
    files = spark.createDataFrame([(f"x.{k}", v[0], k) for k, v in TREES.items()] + [("null.js", None, "js")], "file string, text string, language string")
    rows = extraction.symbols(files).collect()
    for k, (_, want) in TREES.items():
        got = sorted((r for r in rows if r.file == f"x.{k}"), key=lambda r: r.line)
        if k == "kt":
            assert [(r.label, r.kind, r.owner, r.exports) for r in got] == [(w[0], w[1], w[2], w[5]) for w in want]
            continue
        assert [(r.label, r.kind, r.owner, r.line, r.end, r.exports) for r in got] == want, k
    ids = [r.id for r in rows]
    assert len(set(ids)) == len(ids) and {"x.rs:A.new", "x.rs:B.new", "x.go:A.Do", "x.go:B.Do", "x.js:A.v", "x.js:A.v@4", "x.kt:Q.ext"} <= set(ids)
    assert {r.label for r in extraction.closure_locals(extraction.symbols(files)).collect()} == {"inner"}


FILES = {
    "lib.js": "export function helper() {\n}\nexport default function main() {\n}\nexport function twice() {\n}\nexport class Shape {\n  make() {\n  }\n}\n",
    "other.js": "export function twice() {\n}\nfunction lonely() {\n  function buried() {\n  }\n}\n",
    "use.js": "\n".join([
        "import run, { helper as h } from './lib.js';", "import * as lib from './lib.js';", "import { Shape } from './lib';", "// import { lonely as z } from './other.js';", "class Local extends Shape {", "  go(lonely) {",
        "    lonely(1); twice(); buried(); ab(); ...lonely2;", "  }", "  stub(h);", "}", "function outer(cb,", "  lonely = 2) {", "  run(h, lonely, cb); lib.helper(); lib.twice.call(null); x.helper();", "  y instanceof Local; Shape.make(); z(...h());", "  while (lonely3(1)) {}", "}", "h(lonely);",
    ]),
    "tests/t.js": "function check() {\n  lonely();\n  check2(lonely);\n}\nfunction check2() {\n}\n",
    "a.rb": "def caller\n  method(1)\n  plain(2)\nend\n", "b.rb": "class Foo\n  def method(x)\n  end\nend\ndef plain(x)\nend\n",
    "m.py": "class Sub(pkg.Base, metaclass=M):\n    pass\n", "n.py": "class Base:\n    pass\n",
    "prod.js": "function uses() {\n  go(probe);\n  probe();\n}\n", "bench/p.js": "function probe() {\n}\n",
}


def test_edge_ladder_and_guards(spark):
    kind = {"js": "js", "rb": "rb", "py": "py"}
    files = spark.createDataFrame([(k, v, kind[k.split(".")[-1]]) for k, v in FILES.items()] + [("null.js", None, "js")], "file string, text string, language string")
    s = extraction.symbols(files)
    got = {(r.src, r.dst, r.kind) for r in edges.edges(files, s).collect()}
    assert got == {
        ("use.js:Local", "lib.js:Shape", "inherit"), ("use.js:outer", "lib.js:main", "call"), ("use.js:outer", "lib.js:helper", "ref"), ("use.js:outer", "lib.js:helper", "call"), ("use.js:outer", "lib.js:twice", "call"),
        ("use.js:outer", "use.js:Local", "ref"), ("use.js:outer", "lib.js:Shape", "ref"), ("use.js:<module>", "lib.js:helper", "call"), ("use.js:<module>", "other.js:lonely", "ref"),
        ("tests/t.js:check", "other.js:lonely", "test"), ("tests/t.js:check", "tests/t.js:check2", "call"), ("a.rb:caller", "b.rb:plain", "call"), ("m.py:Sub", "n.py:Base", "inherit"), ("prod.js:uses", "bench/p.js:probe", "call"),
    }
    aliases, whole = edges.bound_names(files, s)
    assert {tuple(r) for r in aliases.collect()} == {("use.js", "run", "lib.js:main"), ("use.js", "h", "lib.js:helper"), ("use.js", "Shape", "lib.js:Shape")}
    assert {tuple(r) for r in whole.collect()} == {("use.js", "run", "lib.js"), ("use.js", "lib", "lib.js")}
    why = {(r.file, r.form, r.name, r.why) for r in edges.ladder(files, s, aliases, whole, files.selectExpr("file", "'' AS package")).where("why IS NOT NULL").collect()}
    assert why >= {("use.js", "call", "lonely", "bound"), ("use.js", "call", "twice", "ambiguous"), ("use.js", "call", "buried", "unknown"), ("use.js", "call", "ab", "short"), ("use.js", "ref", "lonely", "bound"), ("prod.js", "ref", "probe", "role"), ("a.rb", "call", "method", "unknown")}
    split = spark.createDataFrame([("lib.js", "one"), ("other.js", "two"), ("tests/t.js", "two")], "file string, package string")
    assert ("use.js:<module>", "other.js:lonely", "ref") not in {(r.src, r.dst, r.kind) for r in edges.edges(files, s, split).collect()}
    assert edges.edges(files.limit(0), s.limit(0)).count() == 0


DISPATCH = {
    "a.rb": "class A\n  def go(p)\n    self.low\n    low2(1)\n    other\n    p.low\n    self.x = 1\n    B.low(1)\n  end\n  def low\n  end\n  def low2(x)\n  end\nend\n",
    "a.php": "<?php\nclass P {\n  function go(?Q $q, int $n, $u) {\n    $this->low(); $q->make(1); $u->make(2); $n->make(3); // $q->gone()\n    $this->q->low();\n  }\n  function low() {}\n}\nclass Q {\n  public function make($x) {}\n}\n",
    "a.py": "class Base:\n    def up(self):\n        pass\nclass Sub(Base):\n    def go(self, b: Base, n=1, m: int = 2):\n        self.up(); b.up(); self.b.up(); n.up()\n    @classmethod\n    def make(cls, s: \"Base\"):\n        cls.go(1); s.up()\ndef free(b: Base): return b.up()\n",
    "a.go": "type R struct {\n}\nfunc (r *R) Go(a, s *S, n int) {\n\tr.low()\n\ts.Do()\n\ta.Do()\n\tx.Do()\n}\nfunc (q R) low() {\n\tr.Go()\n}\nfunc (s S) Do() {\n}\n",
    "a.rs": "struct T;\nimpl T {\n    fn go(&self, u: &mut U, v: Vec<U>) {\n        self.low();\n        u.act();\n        v.act();\n    }\n    fn low(&self) {\n    }\n}\nimpl U {\n    fn act(&self) {\n    }\n}\n",
    "a.java": "class J extends K {\n    void go(final L l, int n) {\n        this.low();\n        this.up();\n        l.run();\n        n.run();\n        low();\n    }\n    void low() {\n    }\n}\nclass L {\n    void run() {\n    }\n}\n",
    "b.java": "class K {\n    void up() {\n    }\n}\n",
    "a.cs": "class M {\n    public void Go(ref N n, V v) {\n        this.Low(); n.Act(); v.Act();\n    }\n    public void Low() {\n    }\n}\nclass N {\n    public void Act() {\n    }\n}\nclass V {\n    public void Act() {\n    }\n}\n",
    "b.cs": "class V {\n    public void Act() {\n    }\n}\n",
    "tests/c.java": "class CTest {\n    void check(L l) {\n        l.run();\n    }\n}\n",
}


def test_dispatch_in_seven_languages(spark):
    files = spark.createDataFrame([(k, v, k.split(".")[-1]) for k, v in DISPATCH.items()] + [("n.py", None, "py"), ("x.js", "class A {\n  go() { this.low(); }\n}", "js")], "file string, text string, language string")
    s = extraction.symbols(files)
    i = dispatch.intents(files, s)
    got = {(r.src, r.dst, r.kind) for r in dispatch.dispatch_edges(i, s).collect()}
    plain = {
        ("a.rb:A.go", "a.rb:A.low", "call"), ("a.rb:A.go", "a.rb:A.low2", "call"), ("a.php:P.go", "a.php:P.low", "call"), ("a.php:P.go", "a.php:Q.make", "call"),
        ("a.py:Sub.go", "a.py:Base.up", "call"), ("a.py:free", "a.py:Base.up", "call"), ("a.py:Sub.make", "a.py:Sub.go", "call"),
        ("a.go:R.Go", "a.go:R.low", "call"), ("a.go:R.Go", "a.go:S.Do", "call"), ("a.rs:T.go", "a.rs:T.low", "call"), ("a.rs:T.go", "a.rs:U.act", "call"),
        ("a.java:J.go", "a.java:J.low", "call"), ("a.java:J.go", "a.java:L.run", "call"), ("a.cs:M.Go", "a.cs:M.Low", "call"), ("a.cs:M.Go", "a.cs:N.Act", "call"), ("tests/c.java:CTest.check", "a.java:L.run", "test"),
    }
    assert got == plain
    up = edges.edges(files, s).where("kind = 'inherit'")
    assert {(r.src, r.dst) for r in up.collect()} == {("a.py:Sub", "a.py:Base"), ("a.java:J", "b.java:K")}
    more = {(r.src, r.dst, r.kind) for r in dispatch.dispatch_edges(i, s, dispatch.ranked_ancestors(up)).collect()}
    assert more == plain | {("a.java:J.go", "b.java:K.up", "call")}
    assert dispatch.dispatch_edges(i.limit(0), s).count() == 0


def test_nearest_ancestor_counts_and_two_as_near_do_not(spark):
    r = "file string, id string, label string, kind string, owner string, line int"
    s = spark.createDataFrame([(f"{c}.py", f"{c}.py:{c}", c, "class", None, 1) for c in "ABCDE"] + [(f"{c}.py", f"{c}.py:{c}.{m}", m, "method", c, 2) for c, m in ("Bf", "Df", "Cg", "Bg", "Eh", "Df")[:5]], r)
    up = spark.createDataFrame([("A.py:A", "B.py:B"), ("A.py:A", "C.py:C"), ("B.py:B", "D.py:D"), ("C.py:C", "E.py:E"), ("E.py:E", "A.py:A")], "src string, dst string")
    a = dispatch.ranked_ancestors(up)
    assert {(x.ancestor, x.distance) for x in a.where("id = 'A.py:A'").collect()} == {("B.py:B", 1), ("C.py:C", 1), ("D.py:D", 2), ("E.py:E", 2)}
    i = spark.createDataFrame([("A.py:A.x", "A.py", "A", m, True) for m in "fgh"], "src string, file string, type string, method string, own boolean")
    assert {x.dst for x in dispatch.dispatch_edges(i, s, a).collect()} == {"B.py:B.f", "E.py:E.h"}  # g is as near in B as in C
